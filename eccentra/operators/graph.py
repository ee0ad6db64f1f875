"""Chains and components by pointer doubling and label exchange.

Every round is a plain equi-join; lineage is cut by a reliable checkpoint, so a
lost executor repeats at most one round.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from eccentra.session import cut


def chain_roots(df: DataFrame, node: str, parent: str, max_rounds: int = 64) -> DataFrame:
    """Root of every node; a root is its own parent. Each round doubles the
    distance a pointer spans, so depth d needs about log2(d) rounds."""
    cur = cut(df.select(F.col(node).alias("node"), F.col(parent).alias("root")))
    for _ in range(max_rounds):
        up = cur.select(F.col("node").alias("_n"), F.col("root").alias("_up"))
        nxt = cut(cur.join(up, F.col("root") == F.col("_n"), "left").select(
            "node", F.coalesce("_up", "root").alias("root"), (F.coalesce("_up", "root") != F.col("root")).alias("_moved")))
        moved = not nxt.filter("_moved").isEmpty()
        cur = nxt.select("node", "root")
        if not moved:
            return cur
    raise ValueError("parent pointers contain a cycle")


def dangling_parents(df: DataFrame, node: str, parent: str) -> DataFrame:
    """Nodes whose parent is not a node: impossible matches."""
    known = df.select(F.col(node).alias(parent))
    return df.join(known, parent, "left_anti")


def chain_transforms(df: DataFrame, node: str, parent: str, max_rounds: int = 64) -> DataFrame:
    """Product of the relative 2x3 transforms from a node up to its root.

    The product stops below the root, whose own transform is not applied.
    Pointer doubling carries the partial product along.
    """
    names = ["a11", "a12", "a13", "a21", "a22", "a23"]
    cur = cut(df.select(F.col(node).alias("node"), F.col(parent).alias("next"), *names,
                        (F.col(node) == F.col(parent)).alias("is_root")))
    from eccentra.functions.geometry import affine_product

    for _ in range(max_rounds):
        up = cur.select(F.col("node").alias("_n"), F.col("next").alias("_next"), F.col("is_root").alias("_top"),
                        *[F.col(c).alias("o_" + c) for c in names])
        j = cur.join(up, F.col("next") == F.col("_n"))
        stop = F.col("is_root") | F.col("_top")
        prod = affine_product("", "o_")
        nxt = cut(j.select("node", F.when(stop, F.col("next")).otherwise(F.col("_next")).alias("next"),
                           *[F.when(stop, F.col(c)).otherwise(p).alias(c) for c, p in zip(names, prod)],
                           "is_root", (~stop).alias("_moved")))
        moved = not nxt.filter("_moved").isEmpty()
        cur = nxt.drop("_moved")
        if not moved:
            return cur.select("node", F.col("next").alias("root"), *names)
    raise ValueError("parent pointers contain a cycle")


def _fingerprint(df: DataFrame) -> tuple:
    """Row count and two order-free hash sums: three numbers for the driver."""
    def h(seed):
        return F.sum(F.xxhash64(F.lit(seed), *df.columns).cast("decimal(38,0)"))
    return tuple(df.agg(F.count("*"), h(1), h(2)).first())


def components(nodes: DataFrame, edges: DataFrame, keys: Sequence[str], id_col: str,
               a: str, b: str) -> DataFrame:
    """Smallest id of the connected component of every node.

    Alternates the two star steps (neighbours point to the smallest id they
    see), each of which groups by node and pre-aggregates the minimum, then
    reads the labels off the remaining star edges.
    """
    keys = list(keys)
    both = edges.select(*keys, F.col(a).alias("u"), F.col(b).alias("v"))
    cur = cut(both.select(*keys, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    before = _fingerprint(cur)
    while True:
        sym = cur.unionByName(cur.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy(*keys, "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (sym.join(low, keys + ["u"]).filter("v > u").select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
                 .filter("u <> v").distinct())
        large = cut(large)
        mins = large.groupBy(*keys, "u").agg(F.min("v").alias("m"))
        small = large.join(mins, keys + ["u"])
        small = (small.select(*keys, F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
                 .unionByName(mins.select(*keys, "u", F.col("m").alias("v"))).distinct())
        nxt = cut(small.select(*keys, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
        now = _fingerprint(nxt)
        cur = nxt
        if now == before:
            break
        before = now
    labels = cur.groupBy(*keys, F.col("u").alias(id_col)).agg(F.min("v").alias("_label"))
    return nodes.join(labels, keys + [id_col], "left").withColumn(
        "component", F.coalesce("_label", F.col(id_col))).drop("_label")
