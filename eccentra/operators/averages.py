"""Exponential averages over ordered readings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from eccentra.operators import ordered


def exponential_average(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, alpha: float) -> DataFrame:
    """Last value of v = alpha*new + (1-alpha)*old per key; the first reading
    starts it and a null starts it anew.

    Unrolled, every reading since the last null has a weight that depends only
    on its distance from the end, so the result is a weighted sum and a long
    series is spread over many tasks. ``order`` must be unique within a key.
    """
    keys, order = list(keys), list(order)
    reset = df.groupBy(*keys).agg(F.max(F.when(F.col(value).isNull(), F.struct(*order))).alias("_reset"))
    live = df.join(reset, keys).filter(F.col("_reset").isNull() | (F.struct(*order) > F.col("_reset"))).select(*keys, *order, value)
    place = ordered.running_sums(live, keys, order, {"_v": F.col(value), "_one": F.lit(1).cast("long")})
    back = F.col("_one_total") - F.col("_one_before") - 1
    w = F.pow(F.lit(1 - alpha), back.cast("double")) * F.when(F.col("_one_before") == 0, 1.0).otherwise(alpha)
    out = place.groupBy(*keys).agg(F.sum(w * F.col("_v")).alias("average"))
    return reset.select(*keys).join(out, keys, "left")
