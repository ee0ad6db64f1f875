"""Order statistics and running sums that never hold one group in one task.

A window ordered over a whole group would put the group into one task. These
operators first collapse ties (with map-side combine), range-partition the
distinct values over the cluster, sum inside each block, and add the totals of
the preceding blocks. A group may therefore span any number of tasks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from eccentra.session import cut


def running_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                 sums: Mapping[str, Column]) -> DataFrame:
    """One row per distinct (keys, order) with own, preceding and total sums.

    For every name ``s`` in ``sums`` the result has ``s`` (sum over the tied
    rows), ``s_before`` (sum over rows ordered strictly earlier) and
    ``s_total`` (sum over the key group).
    """
    keys, order = list(keys), list(order)
    tied = df.groupBy(*keys, *order).agg(*[F.sum(c).alias(s) for s, c in sums.items()])
    blocks = cut(tied.repartitionByRange(*[F.col(c) for c in keys + order])
                 .withColumn("_block", F.spark_partition_id()))
    per_block = blocks.groupBy(*keys, "_block").agg(
        *[F.sum(s).alias(f"_{s}_block") for s in sums])
    in_key = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    earlier = in_key.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    offsets = per_block.select(
        *keys, "_block",
        *[F.coalesce(F.sum(f"_{s}_block").over(earlier), F.lit(0)).alias(f"_{s}_offset") for s in sums],
        *[F.sum(f"_{s}_block").over(in_key).alias(f"{s}_total") for s in sums])
    inside = (W.partitionBy(*keys, "_block").orderBy(*order)
              .rowsBetween(W.unboundedPreceding, -1))
    local = blocks.select(
        "*", *[F.coalesce(F.sum(s).over(inside), F.lit(0)).alias(f"_{s}_local") for s in sums])
    return local.join(offsets, keys + ["_block"]).select(
        *keys, *order, *list(sums),
        *[(F.col(f"_{s}_local") + F.col(f"_{s}_offset")).alias(f"{s}_before") for s in sums],
        *[f"{s}_total" for s in sums])


def positions(df: DataFrame, keys: Sequence[str], value: str,
              weight: Column | None = None) -> DataFrame:
    """Distinct values with ``tied``, ``tied_before``, ``tied_total`` and the
    average rank ``avg_rank`` shared by ties. Nulls are left out."""
    w = F.lit(1).cast("long") if weight is None else weight.cast("long")
    out = running_sums(df.filter(F.col(value).isNotNull()), keys, [value], {"tied": w})
    return out.withColumn("avg_rank", F.col("tied_before") + (F.col("tied") + 1) / 2.0)


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                name: str = "number") -> DataFrame:
    """``row_number`` over a unique order without one task per group."""
    out = running_sums(df, keys, order, {"_one": F.lit(1).cast("long")})
    num = out.select(*keys, *order, (F.col("_one_before") + 1).alias(name))
    return df.join(num, list(keys) + list(order))


def quantiles(df: DataFrame, keys: Sequence[str], value: str,
              probs: Mapping[str, float]) -> DataFrame:
    """Exact interpolated quantiles per group (same rule as ``percentile``)."""
    return quantiles_weighted(df, keys, value, F.lit(1), probs)


def quantiles_weighted(df: DataFrame, keys: Sequence[str], value: str, weight: Column,
                       probs: Mapping[str, float]) -> DataFrame:
    """The same where a row stands for ``weight`` (a whole number) equal ones."""
    pos = positions(df, keys, value, weight)
    picks = []
    for name, p in probs.items():
        at = F.lit(float(p)) * (F.col("tied_total") - 1)
        for end, k in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            inside = (F.col("tied_before") <= k) & (k < F.col("tied_before") + F.col("tied"))
            picks.append(F.max(F.when(inside, F.col(value))).alias(f"_{name}_{end}"))
    found = pos.groupBy(*keys).agg(F.max("tied_total").alias("_n"), *picks)
    outs = []
    for name, p in probs.items():
        at = F.lit(float(p)) * (F.col("_n") - 1)
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        outs.append((lo + (hi - lo) * (at - F.floor(at))).alias(name))
    return found.select(*keys, *outs)
