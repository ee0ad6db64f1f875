"""Detected points: shifting, merging, thinning, scoring."""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F, types as T

from eccentra import constants as K
from eccentra.operators import batches, closeness, graph, images, joins
from eccentra.session import cut

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def to_image(points: DataFrame, x: str, y: str, ox: str, oy: str, swap: bool = False, size: int = K.IMAGE_SIZE) -> DataFrame:
    """Patch points to image coordinates; a point on the far border moves in by
    one pixel. ``inside`` is false for impossible points beyond it, which keep
    their coordinates."""
    a, b = (F.col(oy), F.col(ox)) if swap else (F.col(ox), F.col(oy))
    t = points.withColumn("image_x", a + F.col(x)).withColumn("image_y", b + F.col(y))
    t = t.withColumn("inside", (F.col("image_x") <= size) & (F.col("image_y") <= size))
    return t.withColumns({c: F.when(F.col("inside"), F.least(c, F.lit(size - 1))).otherwise(F.col(c)) for c in ("image_x", "image_y")})


def _spot(x: str, y: str) -> Column:
    return F.struct(F.col(x).cast("bigint").alias("x"), F.col(y).cast("bigint").alias("y"))


def labelled(points: DataFrame, image: Sequence[str], d: float) -> DataFrame:
    """Distinct positions with the component they form at distance ``d``."""
    image = list(image)
    spots = cut(joins.distinct_points(points, image).withColumn("spot", _spot("x", "y")))
    near = joins.within_distance(spots, image, d).select(*image, _spot("ax", "ay").alias("sa"), _spot("bx", "by").alias("sb"))
    return graph.components(spots, near, image, "spot", "sa", "sb")


def centroids(spots: DataFrame, image: Sequence[str], label: str) -> DataFrame:
    n = F.sum("n_here")
    return spots.groupBy(*image, label).agg(
        F.bround(F.sum(F.col("x") * F.col("n_here")) / n, 0).cast("int").alias("x"),
        F.bround(F.sum(F.col("y") * F.col("n_here")) / n, 0).cast("int").alias("y"), n.alias("n_points")).drop(label)


def split_tiles(points: DataFrame, image: Sequence[str]) -> tuple[DataFrame, DataFrame | None]:
    """Points of images that lie in one tile, and those of the others (none: no such image).

    Images with a point of no known place, and points of no known image, are among the others.
    """
    image = list(image)

    def inside(c: str) -> Column:
        return (F.col(c) >= -joins.HALO) & (F.col(c) < joins.TILE - joins.HALO)

    known = F.lit(True)
    for c in image:
        known = known & F.col(c).isNotNull()
    odd = points.filter(~known | ~F.coalesce(inside("x") & inside("y"), F.lit(False)))
    if odd.isEmpty():
        return points, None
    wide = cut(odd.filter(known).select(*image).distinct())
    return points.filter(known).join(wide, image, "left_anti"), points.join(wide, image, "left_semi").unionByName(points.filter(~known))


def merge_close(points: DataFrame, image: Sequence[str], d: float) -> DataFrame:
    """Clusters of points linked by steps of at most ``d`` -> rounded centroid.

    With two points enough for a cluster, density clustering and single linkage
    cut at ``d`` give the same groups; lone points stay as they are.
    Images of one tile are worked on as arrays, many at a time; others exchange labels.
    """
    image = list(image)
    near, wide = split_tiles(points, image)

    def work(values, starts):
        own = batches.owners(starts, len(values["x"]))
        return _middles(values, closeness.components(own, values["x"], values["y"], d))

    out = _in_tiles(joins.distinct_points(near, image), image, ["n_here"], work)
    return out if wide is None else out.unionByName(centroids(labelled(wide, image, d), image, "component"))


MIDDLE = [("x", "int"), ("y", "int"), ("n_points", "bigint")]


def _middles(values: dict, label: np.ndarray) -> tuple[np.ndarray, dict]:
    """Rounded weighted means of the positions of a label, in the rows of those that give it."""
    at, of = np.unique(label, return_inverse=True)
    n = values["n_here"]
    total = np.bincount(of, n, len(at))
    return at, {**{c: np.rint(np.bincount(of, values[c].astype(np.int64) * n, len(at)) / total).astype(np.int32) for c in ("x", "y")}, "n_points": total.astype(np.int64)}


def _in_tiles(spots: DataFrame, image: list[str], columns: list[str], work, results=MIDDLE, kept=None) -> DataFrame:
    return batches.map_profiles(spots, image, ["x", "y"], ["x", "y", *columns], work, results, kept=kept)


#: Positions of an image whose components are merged in one group of rows, about.
HELD = 16384


def merge_greedy(points: DataFrame, image: Sequence[str], d: float) -> DataFrame:
    """Order-dependent merging: each still unlabelled point takes every point
    within ``d``, also from earlier groups; order is by (x, y).

    Images of one tile are worked on as arrays, many at a time.
    """
    image = list(image)
    near, wide = split_tiles(points, image)

    def work(values, starts):
        own = batches.owners(starts, len(values["x"]))
        return _middles(values, closeness.taken(own, values["x"], values["y"], d, np.arange(len(own))))

    out = _in_tiles(joins.distinct_points(near, image), image, ["n_here"], work)
    return out if wide is None else out.unionByName(_merge_greedy_wide(wide, image, d))


def _merge_greedy_wide(points: DataFrame, image: list[str], d: float) -> DataFrame:
    """``merge_greedy`` of images of any extent.

    Labels never reach beyond a component at distance ``d``, so components are
    independent. A group of rows holds many small ones: the components of an image are
    dealt to a group per ``HELD`` positions.
    """
    spots = labelled(points, image, d)
    schema = T.StructType([*[spots.schema[c] for c in image], spots.schema["component"], T.StructField("x", T.IntegerType()),
                           T.StructField("y", T.IntegerType()), T.StructField("n_here", T.LongType()), T.StructField("label", T.LongType())])

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["x", "y"])
        x, y = pdf["x"].to_numpy(float), pdf["y"].to_numpy(float)
        label = np.full(len(pdf), -1, dtype=np.int64)
        for i in range(len(pdf)):
            if label[i] == -1:
                lo, hi = np.searchsorted(x, x[i] - d), np.searchsorted(x, x[i] + d, side="right")
                near = (x[lo:hi] - x[i]) ** 2 + (y[lo:hi] - y[i]) ** 2 <= d * d
                label[lo:hi][near] = i
        return pdf.assign(label=label)[[f.name for f in schema]]

    sizes = spots.groupBy(*image).agg(F.ceil(F.count("*") / HELD).alias("_groups"))
    dealt = spots.join(sizes, image).select(*image, "component", "x", "y", "n_here", F.pmod(F.xxhash64("component"), "_groups").alias("_group"))
    walked = dealt.groupBy(*image, "_group").applyInPandas(walk, schema)
    return centroids(walked.withColumn("_l", F.struct("component", "label")), image, "_l")


def suppress_close(points: DataFrame, image: Sequence[str], d: float, quality: str) -> DataFrame:
    """Keep the best of close points: best first, each kept point removes its
    neighbours of lower quality (ties: smaller position first).

    Images of one tile are worked on as arrays, many at a time.
    """
    image = list(image)
    near, wide = split_tiles(points, image)

    def work(values, starts):
        own, q = batches.owners(starts, len(values["x"])), values[quality]
        none = values["_none"] == 1
        nan = np.isnan(q) & ~none  # NaN is larger than any number, as in Spark
        order = np.lexsort((np.where(np.isnan(q), 0, -q), ~nan, none))
        return np.flatnonzero(closeness.taken(own, values["x"], values["y"], d, order) == np.arange(len(q))), {}

    best = near.groupBy(*image, "x", "y").agg(F.max(quality).alias(quality)).withColumn("_none", F.col(quality).isNull().cast("int"))
    out = _in_tiles(best, image, [quality, "_none"], work, [], kept=[*image, "x", "y", quality])
    return out if wide is None else out.unionByName(_suppress_close_wide(wide, image, d, quality))


def _suppress_close_wide(points: DataFrame, image: list[str], d: float, quality: str) -> DataFrame:
    """``suppress_close`` of images of any extent.

    Every round all points that beat their undecided neighbours are kept at
    once, which gives the same set as going through them one by one.
    """
    best = points.groupBy(*image, "x", "y").agg(F.max(quality).alias(quality))
    spots = cut(best.withColumn("spot", _spot("x", "y")))
    pairs = joins.within_distance(spots, image, d).select(*image, _spot("ax", "ay").alias("sa"), _spot("bx", "by").alias("sb"))
    q = spots.select(*image, F.col("spot").alias("sa"), F.struct(F.col(quality).alias("q"), (-F.col("spot.x")).alias("x"), (-F.col("spot.y")).alias("y")).alias("qa"))
    both = pairs.join(q, image + ["sa"]).join(q.withColumnsRenamed({"sa": "sb", "qa": "qb"}), image + ["sb"])
    # arrows point from the better to the worse point
    arrows = cut(both.select(*image, F.when(F.col("qa") > F.col("qb"), F.col("sa")).otherwise(F.col("sb")).alias("up"),
                             F.when(F.col("qa") > F.col("qb"), F.col("sb")).otherwise(F.col("sa")).alias("down")))
    linked = arrows.select(*image, F.col("up").alias("spot")).union(arrows.select(*image, F.col("down").alias("spot"))).distinct()
    kept = [spots.join(linked, image + ["spot"], "left_anti").select(*image, "spot")]
    open_ = cut(linked)
    while not open_.isEmpty():
        beaten = arrows.select(*image, F.col("down").alias("spot")).distinct()
        win = cut(open_.join(beaten, image + ["spot"], "left_anti"))
        kept.append(win)
        lost = arrows.join(win.withColumnRenamed("spot", "up"), image + ["up"], "left_semi").select(*image, F.col("down").alias("spot")).distinct()
        gone = win.unionByName(lost)
        open_ = cut(open_.join(gone, image + ["spot"], "left_anti"))
        arrows = cut(arrows.join(gone.withColumnRenamed("spot", "up"), image + ["up"], "left_anti")
                     .join(gone.withColumnRenamed("spot", "down"), image + ["down"], "left_anti"))
    ids = kept[0]
    for k in kept[1:]:
        ids = ids.unionByName(k)
    return spots.join(ids, image + ["spot"], "left_semi").drop("spot")


def bright_enough(points: DataFrame, image: Sequence[str], quality: str, k: float) -> DataFrame:
    """Points brighter than the most probable quality minus k deviations."""
    s = images.robust_mode(points, image, quality)
    return points.join(s, list(image)).filter(F.col(quality) > F.col("mode") - k * F.col("std")).drop("mode", "std")


def distance_score(nearest: DataFrame, threshold: Column) -> DataFrame:
    return nearest.withColumn("score", 1.0 / (1.0 + F.exp(threshold - F.col("distance"))))


def best_source(points: DataFrame, image: Sequence[str], source: str, rank: Sequence[str]) -> DataFrame:
    """Rows of the detector with most points per image; the earlier in ``rank``
    among equals."""
    place = F.array_position(F.array(*[F.lit(r) for r in rank]), F.col(source))
    n = points.groupBy(*image, source).agg(F.count("*").alias("_n"))
    top = n.groupBy(*image).agg(F.max_by(source, F.struct("_n", (-place).alias("p"))).alias(source))
    return points.join(top, [*image, source], "left_semi")
