"""Streaming queries: given tables are written as arriving files and drained."""

from pyspark.sql import functions as F

from eccentra.operators import averages
from eccentra.plans.q_projection import PARSED
from eccentra.plans.registry import query
from eccentra.session import scratch_path
from eccentra.streaming import acquisition as A
from eccentra.streaming.folder import complete_files, lines_of


def _arrive(b, df, label, slices=1, files_per_batch=None, order="ts"):
    """Write ``df`` as ``slices`` successive deliveries in time order."""
    path = scratch_path(b.spark, label)
    if slices == 1:
        df.write.parquet(path)
    else:
        lo, hi = df.agg(F.min(F.unix_timestamp(order)), F.max(F.unix_timestamp(order))).first()
        part = F.floor((F.unix_timestamp(order) - lo) * slices / (hi - lo + 1))
        for k in range(slices):
            df.filter(part == k).write.mode("append").parquet(path)
    return A.arriving(b.spark, path, df.schema, files_per_batch)


@query("acquisition_stream", f"WITH {PARSED} SELECT file_no, subject_id, session_id, modality, x_position, y_position FROM parsed WHERE modality IN ('Confocal', 'CalculatedSplit')")
def _(b):
    """Delivery lists arrive as files of a folder and are read once two listings agree; a run is a listing."""
    path, done = scratch_path(b.spark, "arriving"), scratch_path(b.spark, "acquisitions")
    b.v_files.select(F.concat_ws("\t", "file_no", "file_name").alias("line")).write.text(path)
    cells = F.split("line", "\t")
    lines = lines_of(complete_files(b.spark, path, settle=0), b.spark.sparkContext.defaultParallelism)
    files = lines.select(F.get(cells, F.lit(0)).cast("long").alias("file_no"), F.get(cells, F.lit(1)).alias("file_name"))
    for _ in range(2):  # the first listing releases nothing
        out = A.drain(A.known_acquisitions(files, ["Confocal", "CalculatedSplit"]), "acquisitions", done)
    return out.select("file_no", "subject_id", "session_id", "modality", "x_position", "y_position")


@query("acquisition_group", """WITH e AS (SELECT user_id, event_type, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts)),
    g AS (SELECT *, sum(new) OVER (PARTITION BY user_id, event_type ORDER BY ts, new DESC ROWS UNBOUNDED PRECEDING) AS grp FROM e)
    SELECT user_id, event_type, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_files FROM g GROUP BY user_id, event_type, grp
    HAVING max(ts) + INTERVAL 2 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def _(b):
    s = _arrive(b, b.events.select("user_id", "event_type", F.col("ts").cast("timestamp")), "events")
    out = A.drain(A.acquisition_groups(s, ["user_id", "event_type"], "ts", "2 hours", "10 minutes"), "groups")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_ts", "last_ts")})


@query("exponential_average_state", """SELECT user_id, list_reduce(list(struct_pack(v := v, ok := TRUE) ORDER BY ts, event_id), lambda acc, x: struct_pack(
      v := CASE WHEN x.v IS NULL THEN NULL WHEN acc.v IS NULL THEN x.v ELSE 25e-2 * x.v + 75e-2 * acc.v END, ok := TRUE)).v AS average
    FROM (SELECT user_id, ts, event_id, CASE WHEN event_id % 211 = 0 THEN NULL ELSE value END AS v FROM events) AS t GROUP BY user_id""", rounded="average")
def _(b):
    e = b.events.select("user_id", "ts", "event_id", F.when(F.col("event_id") % 211 != 0, F.col("value")).alias("v"))
    return averages.exponential_average(e, ["user_id"], ["ts", "event_id"], "v", 0.25)


@query("exponential_average_stream", """SELECT user_id, list_reduce(list(struct_pack(v := v, ok := TRUE) ORDER BY ts, event_id), lambda acc, x: struct_pack(
      v := CASE WHEN x.v IS NULL THEN NULL WHEN acc.v IS NULL THEN x.v ELSE 25e-2 * x.v + 75e-2 * acc.v END, ok := TRUE)).v AS average
    FROM (SELECT user_id, ts, event_id, CASE WHEN event_id % 211 = 0 THEN NULL ELSE value END AS v FROM events) AS t GROUP BY user_id""", rounded="average")
def _(b):
    """Averages of all readings: the last delivery ends with a mark of a later time, with which the watermark closes every slot but the mark's own."""
    A.stateful(b.spark)
    e = b.events.select("user_id", F.col("ts").cast("timestamp"), "event_id", F.when(F.col("event_id") % 211 != 0, F.col("value")).alias("v"))
    end = F.max("ts") + F.expr("INTERVAL 7 HOURS")  # a slot and the delay of the watermark, and more
    mark = e.agg(end.alias("ts")).select(F.lit(None).cast("long").alias("user_id"), "ts", F.lit(None).cast("long").alias("event_id"), F.lit(None).cast("double").alias("v")).filter("ts IS NOT NULL")
    out = A.drain(A.exponential_average(_arrive(b, e.unionByName(mark), "readings", slices=3, files_per_batch=None), "user_id", ["ts", "event_id"], "v", 0.25, slot="6 hours"), "averages")
    return out.groupBy("user_id").agg(F.max_by("average", "last_ts").alias("average"))


@query("tile_density_stream", """WITH t AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, CAST(floor(event_id * 7 % 720 / 180) AS INT) AS ty, CAST(floor(user_id * 53 % 720 / 180) AS INT) AS tx FROM events)
    SELECT window_start, ty, tx, count(*) AS n_points FROM t WHERE window_start + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY window_start, ty, tx""")
def _(b):
    p = b.events.select(F.col("ts").cast("timestamp"), (F.col("event_id") * 7 % 720).alias("y"), (F.col("user_id") * 53 % 720).alias("x"))
    out = A.drain(A.tile_counts(_arrive(b, p, "points"), "ts", "1 day", "10 minutes", 180), "tiles")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
