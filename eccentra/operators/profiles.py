"""Profiles on the 0.1 degree grid: at most 201 steps per axis, so windows over
one profile are small and all profiles run in parallel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from eccentra import constants as K


def on_grid(df: DataFrame, keys: Sequence[str], lo: int = -K.GRID_LIMIT, hi: int = K.GRID_LIMIT) -> DataFrame:
    """Every grid step of every profile; missing values are null."""
    keys = list(keys)
    steps = df.select(*keys).distinct().withColumn("e10", F.explode(F.sequence(F.lit(lo), F.lit(hi))))
    return steps.join(df, keys + ["e10"], "left")


def own_range(df: DataFrame, keys: Sequence[str], end_exclusive: bool = False) -> DataFrame:
    """Grid steps from the smallest to the largest step of each profile."""
    r = df.groupBy(*keys).agg(F.min("e10").alias("_lo"), F.max("e10").alias("_hi"))
    if end_exclusive:
        r = r.withColumn("_hi", F.col("_hi") - 1).filter("_lo <= _hi")
    steps = r.withColumn("e10", F.explode(F.sequence("_lo", "_hi"))).drop("_lo", "_hi")
    return steps.join(df, [*keys, "e10"], "left")


def fill_small_gaps(df: DataFrame, keys: Sequence[str], value: str, widest: int = 4) -> DataFrame:
    """Linear fill across gaps of at most ``widest`` steps; wider ones stay
    absent. Each known step emits the steps up to its successor."""
    w = W.partitionBy(*keys).orderBy("e10")
    n = (df.filter(F.col(value).isNotNull()).select(*keys, "e10", value)
         .withColumn("_ne", F.lead("e10").over(w)).withColumn("_nv", F.lead(value).over(w)))
    gap = F.col("_ne") - F.col("e10")
    last = F.when(gap <= widest, F.col("_ne") - 1).otherwise(F.col("e10"))
    t = n.withColumn("_s", F.explode(F.sequence("e10", last)))
    val = F.when(F.col("_s") == F.col("e10"), F.col(value)).otherwise(
        F.col(value) + (F.col("_nv") - F.col(value)) * (F.col("_s") - F.col("e10")) / gap)
    return t.select(*keys, F.col("_s").alias("e10"), val.alias(value))


def interpolate_nulls(df: DataFrame, keys: Sequence[str], value: str, order: str = "e10") -> DataFrame:
    """Linear fill of nulls by position; ends are held flat."""
    w = W.partitionBy(*keys).orderBy(order)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("p"), F.col(value).alias("v")))
    t = (df.withColumn("_l", F.last(known, True).over(w.rowsBetween(W.unboundedPreceding, 0)))
         .withColumn("_r", F.first(known, True).over(w.rowsBetween(0, W.unboundedFollowing))))
    mid = F.col("_l.v") + (F.col("_r.v") - F.col("_l.v")) * (F.col(order) - F.col("_l.p")) / (F.col("_r.p") - F.col("_l.p"))
    out = (F.when(F.col(value).isNotNull(), F.col(value)).when(F.col("_l").isNull(), F.col("_r.v"))
           .when(F.col("_r").isNull(), F.col("_l.v")).otherwise(mid))
    return t.withColumn(value, out).drop("_l", "_r")


def gap_ranges(df: DataFrame, keys: Sequence[str], longer_than: int = 2) -> DataFrame:
    """Runs of missing steps: last missing step and length, with the two ends
    of the profile as sentinels of length 0."""
    keys = list(keys)
    w = W.partitionBy(*keys).orderBy("e10")
    n = df.select(*keys, "e10").withColumn("_ne", F.lead("e10").over(w))
    missing = F.col("_ne") - F.col("e10") - 1
    runs = n.filter(missing > longer_than).select(*keys, (F.col("_ne") - 1).alias("e10"), missing.alias("length"))
    ends = df.groupBy(*keys).agg(F.min("e10").alias("_a"), F.max("e10").alias("_b")).select(
        *keys, F.explode(F.array("_a", "_b")).alias("e10"), F.lit(0).alias("length"))
    return runs.unionByName(ends)


def step_median(raw: DataFrame, keys: Sequence[str], ecc: Column, value: str) -> DataFrame:
    """Median of the raw readings strictly within half a step of each grid step."""
    from eccentra.operators import ordered

    scaled = ecc * K.GRID_PER_DEGREE
    step = F.floor(scaled + 0.5)
    t = raw.withColumn("e10", step.cast("int")).filter((F.abs(scaled - step) < 0.5) & (F.abs(step) <= K.GRID_LIMIT))
    med = ordered.quantiles(t, [*keys, "e10"], value, {value: 0.5})
    return on_grid(med, keys)


def nth_curves(obs: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The k-th reading at each step as curve k, up to the smallest step count.

    Only the first ``min`` readings of a step survive. The numbering is a
    distributed one, so a step may hold any number of readings.
    """
    from eccentra.operators import ordered

    keys = list(keys)
    n = obs.groupBy(*keys, "e10").agg(F.count("*").alias("_n")).groupBy(*keys).agg(F.min("_n").alias("_least"))
    numbered = ordered.row_numbers(obs, keys + ["e10"], order, "curve")
    return numbered.join(n, keys).filter(F.col("curve") <= F.col("_least")).drop("_least")


def running_trapezoid(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(x)
    area = (F.col(x) - F.lag(x).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2.0
    t = df.withColumn("_a", F.coalesce(area, F.lit(0.0)))
    return t.withColumn("cumulative", F.sum("_a").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_a")
