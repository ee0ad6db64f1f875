"""Layer vectors and layer tables before they become profiles.

A vector is one scan line: its length is set by the instrument, so windows
over one vector stay small however many vectors there are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from eccentra import constants as K


def canonical_layer(name: Column) -> Column:
    out = name
    for alias, full in K.LAYER_ALIASES.items():
        out = F.when(name == alias, F.lit(full)).otherwise(out)
    return out


def allow_deny(df: DataFrame, layer: str, allow: Sequence[str] | None = None,
               deny: Sequence[str] = ()) -> DataFrame:
    if allow is not None:
        df = df.filter(F.col(layer).isin(list(allow)))
    return df.filter(~F.col(layer).isin(list(deny))) if deny else df


def exclude_subjects(df: DataFrame, ids: Sequence[int] | DataFrame) -> DataFrame:
    """Drop listed subjects: a literal list reaches the scan as a filter, a
    table of any size is an anti join."""
    if isinstance(ids, DataFrame):
        return df.join(ids.select("subject_id").distinct(), "subject_id", "left_anti")
    return df.filter(~F.col("subject_id").isin([int(i) for i in ids]))


def axis_of_name(name: Column) -> Column:
    """Axis letter at the start, the end or after an underscore."""
    up = F.upper(name)
    out = F.lit(None).cast("string")
    for axis in ("Y", "X"):
        out = F.when(up.startswith(axis) | up.endswith(axis) | up.contains("_" + axis), F.lit(axis)).otherwise(out)
    return out


def scan_to_degrees(df: DataFrame, slice_off: Column, sample_off: Column,
                    mm_per_slice: float, mm_per_sample: float) -> DataFrame:
    """Offsets in scan indices -> whole pixels -> distance in degrees."""
    dx = F.bround(sample_off * F.lit(mm_per_sample) / K.MM_PER_DEGREE * K.PIXELS_PER_DEGREE, 0)
    dy = F.bround(slice_off * F.lit(mm_per_slice) / K.MM_PER_DEGREE * K.PIXELS_PER_DEGREE, 0)
    return (df.withColumn("dx_px", dx).withColumn("dy_px", dy).withColumn(
        "distance_deg", F.sqrt(F.col("dx_px") * F.col("dx_px") + F.col("dy_px") * F.col("dy_px")) / K.PIXELS_PER_DEGREE))


def mirror_scan(df: DataFrame, slice_col: str, sample_col: str, last_slice: Column,
                last_sample: Column, right_eye: Column) -> DataFrame:
    """Slices always run the other way; samples only for left eyes."""
    return (df.withColumn("slice_no", (last_slice - F.col(slice_col)).cast("int"))
            .withColumn("sample_no", F.when(right_eye, F.col(sample_col)).otherwise(
                last_sample - F.col(sample_col)).cast("int")))


def centre_pad(df: DataFrame, keys: Sequence[str], within: Sequence[str], pos: str) -> DataFrame:
    """Index each vector as if padded evenly to the longest one in ``within``."""
    keys, within = list(keys), list(within)
    lengths = df.groupBy(*within, *keys).agg((F.max(pos) + 1).alias("_n"))
    longest = lengths.groupBy(*within).agg(F.max("_n").alias("_widest"))
    shift = lengths.join(longest, within).select(
        *keys, F.floor((F.col("_widest") - F.col("_n")) / 2).cast("int").alias("_shift"))
    return df.join(shift, keys).withColumn("padded_pos", (F.col(pos) + F.col("_shift")).cast("int")).drop("_shift")


def _edges(df: DataFrame, keys: Sequence[str], pos: str, v: str) -> DataFrame:
    known = F.when(F.col(v).isNotNull(), F.col(pos))
    w = W.partitionBy(*keys)
    return (df.withColumn("_n", F.max(pos).over(w) + 1).withColumn("_first", F.min(known).over(w))
            .withColumn("_last", F.max(known).over(w)))


def _trimmed(n: Column, first: Column, last: Column, goal: Column) -> tuple[Column, Column]:
    """First and stop position of a vector of ``n`` that is trimmed to about the goal length."""
    s, z = first, n - 1 - last
    left, right = n - z - goal, n - s - goal
    ns = F.when(left > 0, F.least(s, left)).otherwise(s)
    ne = F.when(right > 0, F.least(z, right)).otherwise(z)
    ratio = (n - ne - ns) / goal.cast("double")
    near = n - z - s < F.lit(1.08) * goal
    close = (ratio > 0.92) & (ratio < 1.08)
    half = F.floor((n - goal) / 2).cast("int")
    start = F.when(near, s).when(close, ns).otherwise(half)
    return start, n - F.when(near, z).when(close, ne).otherwise(n - half - goal)


def trim_null_edges(df: DataFrame, keys: Sequence[str], pos: str, v: str, goal: int | str) -> DataFrame:
    """Strip null ends to about the goal length (within 8 %), else centre crop. ``goal`` is a number or a column.

    Positions restart at 0 and remaining nulls become 0; vectors without any
    value are dropped.
    """
    e = _edges(df, keys, pos, v).filter(F.col("_first").isNotNull())
    start, stop = _trimmed(F.col("_n"), F.col("_first"), F.col("_last"), F.col(goal) if isinstance(goal, str) else F.lit(goal))
    return (e.filter((F.col(pos) >= start) & (F.col(pos) < stop))
            .select(*keys, (F.col(pos) - start).cast("int").alias(pos), F.coalesce(F.col(v), F.lit(0.0)).alias(v)))


def resample(df: DataFrame, keys: Sequence[str], pos: str, v: str, length: int | str) -> DataFrame:
    """Stretch each vector linearly to ``length``, a number or a column; nulls count as 0 and exact
    zeros become null again. Each sample emits the targets up to its successor,
    so one shuffle on the vector key is enough."""
    w = W.partitionBy(*keys)
    e = df.select(*keys, F.col(pos).alias("_p"), F.coalesce(F.col(v), F.lit(0.0)).alias("_v"), ((F.col(length) if isinstance(length, str) else F.lit(length)) - 1).cast("int").alias("_goal"))
    e = (e.withColumn("_n", F.max("_p").over(w) + 1)
         .withColumn("_next", F.lead("_v").over(w.orderBy("_p"))))
    span, goal = F.col("_n") - 1, F.col("_goal")
    lo = F.when(span == 0, F.lit(0)).otherwise(F.ceil(F.col("_p") * goal / span).cast("int"))
    hi = F.when(span == 0, goal).when(goal == 0, F.when(F.col("_p") == 0, 0).otherwise(-1)).when(F.col("_p") == span, goal).otherwise(
        F.ceil((F.col("_p") + 1) * goal / span).cast("int") - 1)
    t = e.withColumn("_lo", lo).withColumn("_hi", hi).filter("_lo <= _hi").withColumn(
        "_j", F.explode(F.sequence("_lo", "_hi")))
    at = F.when(goal == 0, 0.0).otherwise(F.col("_j") * span / F.when(goal != 0, goal.cast("double")))
    val = F.col("_v") + (F.coalesce("_next", "_v") - F.col("_v")) * (at - F.floor(at))
    return t.select(*keys, F.col("_j").alias(pos), val.alias("_x")).select(
        *keys, pos, F.when(F.col("_x") != 0, F.col("_x")).alias(v))


def resample_array(vector: Column, length: Column) -> Column:
    """``resample`` of a vector held as an array."""
    x, span, goal = F.transform(vector, lambda v: F.coalesce(v, F.lit(0.0))), F.size(vector) - 1, length - 1

    def value(j: Column) -> Column:
        at = F.when(goal == 0, 0.0).otherwise(j * span / F.when(goal != 0, goal.cast("double")))
        p = F.floor(at).cast("int")
        one, two = F.get(x, p), F.get(x, F.least(p + 1, span))
        return one + (two - one) * (at - p)

    return F.transform(F.sequence(F.lit(0), goal), lambda j: F.nullif(value(j), F.lit(0.0)))


def trim_array(vector: Column, goal: Column) -> Column:
    """``trim_null_edges`` of a vector held as an array; null if there is no value in it."""
    known = F.filter(F.transform(vector, lambda v, i: F.when(v.isNotNull(), i)), lambda i: i.isNotNull())
    start, stop = _trimmed(F.size(vector), F.array_min(known), F.array_max(known), goal)
    return F.when(F.size(known) > 0, F.transform(F.slice(vector, start + 1, stop - start), lambda v: F.coalesce(v, F.lit(0.0))))


def fill_zero_gaps(df: DataFrame, keys: Sequence[str], pos: str, v: str) -> DataFrame:
    """Zeros between samples are interpolated to whole numbers, ends are held."""
    w = W.partitionBy(*keys).orderBy(pos)
    known = F.when(F.col(v).isNotNull() & (F.col(v) != 0), F.struct(F.col(pos).alias("p"), F.col(v).alias("v")))
    e = (df.withColumn("_k", known)
         .withColumn("_l", F.last("_k", True).over(w.rowsBetween(W.unboundedPreceding, 0)))
         .withColumn("_r", F.first("_k", True).over(w.rowsBetween(0, W.unboundedFollowing))))
    lv, rv = F.col("_l.v"), F.col("_r.v")
    slope = (rv - lv) / (F.col("_r.p") - F.col("_l.p"))
    mid = F.bround(lv + (F.col(pos) - F.col("_l.p")) * slope, 0)
    out = (F.when(F.col("_k").isNotNull(), F.col("_k.v")).when(F.col("_l").isNull(), rv)
           .when(F.col("_r").isNull(), lv).otherwise(mid))
    return e.select(*keys, pos, out.alias(v))


def border_trim(df: DataFrame, keys: Sequence[str], pos: str, v: str) -> DataFrame:
    """Cut the null run at the end; only where there is none, the one at the start."""
    e = _edges(df, keys, pos, v)
    keep = F.when(F.col("_last") < F.col("_n") - 1, F.col(pos) <= F.col("_last")).otherwise(
        F.col(pos) >= F.col("_first"))
    return e.filter(keep).select(*df.columns)
