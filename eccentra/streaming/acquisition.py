"""Arriving files and readings as Structured Streaming queries.

Every query takes a streaming (or static) DataFrame and returns one; ``drain``
runs it over what has arrived so far and stops, for jobs started on a schedule.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from datetime import timedelta
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F, types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from eccentra.functions.naming import parse_file_name
from eccentra.operators.cells import tile_of
from eccentra.session import scratch_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def arriving(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files of a folder, oldest first."""
    r = spark.readStream.schema(schema)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    return r.parquet(path)


def known_acquisitions(files: DataFrame, modalities: Sequence[str]) -> DataFrame:
    """Parsed names of known modalities; anything else is left in the folder."""
    return parse_file_name(files).filter(F.col("modality").isin(list(modalities)))


def acquisition_groups(rows: DataFrame, keys: Sequence[str], ts: str, gap: str, delay: str) -> DataFrame:
    """Rows of one acquisition that follow each other within ``gap``; a group is
    emitted once the watermark has passed its end."""
    return (rows.withWatermark(ts, delay).groupBy(*keys, F.session_window(ts, gap).alias("w"))
            .agg(F.count("*").alias("n_files"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
            .select(*keys, "first_ts", "last_ts", "n_files"))


def tile_counts(points: DataFrame, ts: str, every: str, delay: str, size: int) -> DataFrame:
    """Points per tumbling window and tile."""
    return (points.withWatermark(ts, delay)
            .groupBy(F.window(ts, every).alias("w"), tile_of("y", size).alias("ty"), tile_of("x", size).alias("tx"))
            .agg(F.count("*").alias("n_points")).select(F.col("w.start").alias("window_start"), "ty", "tx", "n_points"))


#: A stretch of readings as a function of the average before it: ``cut`` says that it does not matter (a null reading is
#: among them), ``weight`` and ``total`` what becomes of it, ``alone`` the result without one.
FOLD = "cut boolean, weight double, total double, alone double"


def fold_of(readings: Column, alpha: float) -> Column:
    """``FOLD`` of an array of structs with ``v``, in its order."""
    start = F.struct(F.lit(False).alias("cut"), F.lit(1.0).alias("weight"), F.lit(0.0).alias("total"), F.lit(None).cast("double").alias("alone"))

    def step(a: Column, x: Column) -> Column:
        v, keep = x["v"].cast("double"), 1 - alpha
        none = F.struct(F.lit(True).alias("cut"), F.lit(0.0).alias("weight"), F.lit(0.0).alias("total"), F.lit(None).cast("double").alias("alone"))
        some = F.struct(a["cut"].alias("cut"), (a["weight"] * keep).alias("weight"), (a["total"] * keep + alpha * v).alias("total"),
                        F.when(a["alone"].isNull(), v).otherwise(alpha * v + keep * a["alone"]).alias("alone"))
        return F.when(v.isNull(), none).otherwise(some)

    return F.aggregate(readings, start, step)


def applied(fold: Any, before: float | None) -> float | None:
    """The average after a stretch."""
    return fold["alone"] if fold["cut"] or before is None else fold["weight"] * before + fold["total"]


class Average(StatefulProcessor):
    """Average per key. After ``live_ms`` of event time without readings it starts anew, and the state is dropped."""

    def __init__(self, key: str, live_ms: int):
        self.key, self.live_ms = key, live_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("average", "v double, at long")

    def handleInputRows(self, key: Any, rows: Iterator[Any], timers: Any) -> Iterator[Row]:
        held = self.state.get()
        v, at = (held[0], held[1]) if held else (None, None)
        slots = sorted(rows, key=lambda r: r.at)  # a row per slot
        for r in slots:  # the timer may not have gone off yet
            v = applied(r.fold, v if at is not None and r.at - at <= self.live_ms else None)
            at = r.at
        self.state.update((v, at))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(slots[-1].at + self.live_ms)
        yield Row(**{self.key: key[0], "last_ts": slots[-1].last_ts, "average": v})

    def handleExpiredTimer(self, key: Any, timers: Any, expired: Any) -> Iterator[Row]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def slot_folds(rows: DataFrame, key: str, order: Sequence[str], value: str, alpha: float, slot: str, delay: str) -> DataFrame:
    """(key, closed, at, last_ts, fold): readings of a key folded per slot of time, in parallel however many a key has; ``order`` starts with the time."""
    ts = order[0]
    return (rows.withWatermark(ts, delay).groupBy(key, F.window(ts, slot).alias("_w"))
            .agg(F.sort_array(F.collect_list(F.struct(*order, F.col(value).alias("v")))).alias("_r"), F.max(ts).alias("last_ts"))
            .select(key, F.window_time("_w").alias("closed"), F.unix_millis("last_ts").alias("at"), "last_ts", fold_of(F.col("_r"), alpha).alias("fold")))


def exponential_average(rows: DataFrame, key: str, order: Sequence[str], value: str, alpha: float, slot: str = "1 hour", delay: str = "10 minutes",
                        live: timedelta = timedelta(days=30)) -> DataFrame:
    """Running exponential average per key; a null reading clears it. One row per key and batch that closes a slot.

    Readings are folded per key and slot first (a slot is complete once the
    watermark is past it, so their order of arrival does not matter), the folds
    are put on the average kept as state, which ends ``live`` after a key's last reading.
    Needs the RocksDB state store (``stateful``).
    """
    folds = slot_folds(rows, key, order, value, alpha, slot, delay)
    out = T.StructType([rows.schema[key], T.StructField("last_ts", T.TimestampType()), T.StructField("average", T.DoubleType())])
    return folds.groupBy(key).transformWithState(Average(key, int(live.total_seconds() * 1000)), out, "Append", "EventTime")


def stateful(spark: SparkSession) -> None:
    """State with timers is kept in RocksDB; to be set before such a query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def drain(stream: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Run over all files present, write the rows to the shared folder and read
    them back. With the ``path`` of an earlier run, go on from there."""
    spark = stream.sparkSession
    path = path or scratch_path(spark, label)
    q = (stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state")
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
