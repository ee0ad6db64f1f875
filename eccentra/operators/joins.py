"""Distance, range and look-up joins without pairing whole groups."""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from eccentra import constants as K
from eccentra.session import cut

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def distinct_points(points: DataFrame, image: Sequence[str]) -> DataFrame:
    """Pixel positions with their number of points.

    Coordinates are whole pixels, so after this step a cell of side s holds at
    most s*s rows whatever the data look like.
    """
    return points.groupBy(*image, "x", "y").agg(F.count("*").alias("n_here"))


def _cells(df: DataFrame, size: int) -> DataFrame:
    return df.withColumn("_cx", F.floor(F.col("x") / size)).withColumn("_cy", F.floor(F.col("y") / size))


def _around(df: DataFrame, size: int, reach: int = 1) -> DataFrame:
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    return (_cells(df, size).withColumn("_ox", F.explode(steps)).withColumn("_cx", F.col("_cx") + F.col("_ox"))
            .withColumn("_oy", F.explode(steps)).withColumn("_cy", F.col("_cy") + F.col("_oy")).drop("_ox", "_oy"))


def within_distance(points: DataFrame, image: Sequence[str], d: float) -> DataFrame:
    """Distinct positions of one image at most ``d`` apart (a before b in x, y).

    A cell meets itself and the cells ahead of it only, so every pair is formed once.
    """
    size = max(1, int(d))
    reach = range(2 if d > size else 1, -1, -1)
    ahead = [(i, j) for i in reach for j in range(-max(reach), max(reach) + 1) if i > 0 or j >= 0]
    image = list(image)
    b = _cells(points, size).select(*image, "_cx", "_cy", F.col("x").alias("bx"), F.col("y").alias("by"))
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ahead])
    a = _cells(points, size).withColumn("_o", F.explode(steps)).select(
        *image, (F.col("_cx") + F.col("_o.i")).alias("_cx"), (F.col("_cy") + F.col("_o.j")).alias("_cy"), F.col("x").alias("ax"), F.col("y").alias("ay"),
        ((F.col("_o.i") == 0) & (F.col("_o.j") == 0)).alias("_own"))
    j = a.join(b, image + ["_cx", "_cy"])
    dx, dy = F.col("ax").cast("long") - F.col("bx"), F.col("ay").cast("long") - F.col("by")
    one, two = F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by").alias("y"))
    near = j.filter((~F.col("_own") | (one < two)) & (dx * dx + dy * dy <= d * d)).select(
        *image, F.least(one, two).alias("_a"), F.greatest(one, two).alias("_b"), F.sqrt((dx * dx + dy * dy).cast("double")).alias("distance"))
    return near.select(*image, F.col("_a.x").alias("ax"), F.col("_a.y").alias("ay"), F.col("_b.x").alias("bx"), F.col("_b.y").alias("by"), "distance")


#: Side of a tile of an image, and how far around it a tile looks. Tiles start at -HALO, so that an image of 720 pixels is one.
TILE, HALO = 1024, 64


def _nearest_squared(x: np.ndarray, y: np.ndarray, mine: np.ndarray, reach: int, small: int = 1024) -> np.ndarray:
    """Squared distance of every one of ``mine`` to the nearest other position, -1 beyond ``reach``.

    Few positions are compared all with all, many ring by ring in cells of about two.
    """
    far = np.iinfo(np.int64).max
    who = np.flatnonzero(mine)
    best = np.full(len(who), far)
    if len(x) <= small:
        d = (x[who, None] - x) ** 2 + (y[who, None] - y) ** 2
        d[np.arange(len(who)), who] = far
        best = d.min(axis=1, initial=far)
    else:
        cx, cy = x - x.min(), y - y.min()
        side = max(1, int(np.sqrt(2.0 * (cx.max() + 1) * (cy.max() + 1) / len(x))))
        cx, cy = cx // side, cy // side
        width = cy.max() + 1
        cell = cx * width + cy
        order = np.argsort(cell, kind="stable")
        held = cell[order]
        left = np.arange(len(who))
        for r in range(reach // side + 2):
            for i in range(-r, r + 1):
                for j in range(-r, r + 1) if abs(i) == r else (-r, r):
                    p = who[left]
                    ox, oy = cx[p] + i, cy[p] + j
                    at = np.where((ox >= 0) & (oy >= 0) & (oy < width), ox * width + oy, -1)
                    lo, hi = np.searchsorted(held, at), np.searchsorted(held, at, side="right")
                    for k in range(int((hi - lo).max(initial=0))):
                        some = np.flatnonzero(lo + k < hi)
                        q = order[lo[some] + k]
                        d = (x[p[some]] - x[q]) ** 2 + (y[p[some]] - y[q]) ** 2
                        best[left[some]] = np.minimum(best[left[some]], np.where(q == p[some], far, d))
            left = left[best[left] > (r * side) ** 2]  # beyond this ring all is farther
            if not len(left):
                break
    return np.where(best <= reach * reach, best, -1)


def _nearest_in_tiles(spots: DataFrame, image: list[str]) -> DataFrame:
    """(image, x, y, n_here, _d2): every position with the squared distance of its nearest within ``HALO``, -1 without one.

    A tile is sent the positions at most ``HALO`` away, (TILE + 2 * HALO) ** 2 at most.
    """
    here = [*image, "x", "y", "n_here"]

    def seen(c: str) -> Column:
        return F.explode(F.sequence(F.floor(F.col(c) / TILE), F.floor((F.col(c) + 2 * HALO) / TILE)))

    laid = spots.select(*here).withColumn("_tx", seen("x")).withColumn("_ty", seen("y"))
    schema = T.StructType([*[laid.schema[c] for c in here], T.StructField("_d2", T.LongType())])

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf["x"].to_numpy(np.int64), pdf["y"].to_numpy(np.int64)
        mine = ((x + HALO) // TILE == pdf["_tx"].to_numpy()) & ((y + HALO) // TILE == pdf["_ty"].to_numpy())
        return pdf.loc[mine, here].assign(_d2=_nearest_squared(x, y, mine, HALO))

    return laid.groupBy(*image, "_tx", "_ty").applyInPandas(walk, schema)


def nearest_distance(points: DataFrame, image: Sequence[str]) -> DataFrame:
    """Distance of every distinct position to the nearest other point.

    Positions look around in their tile of the image. Those without a certain answer
    (nothing closer than ``HALO``) descend a pyramid of occupied cells, so that a lone point
    beside a dense patch meets the cells at the patch's near edge and not the patch.
    Positions holding several points have distance 0. A point alone on its
    image stays null.
    """
    image = list(image)
    spots = cut(distinct_points(points, image))
    here = [*image, "x", "y", "n_here"]
    tried = cut(_nearest_in_tiles(spots, image))
    sure = (F.col("n_here") > 1) | (F.col("_d2") >= 0)
    distance = F.when(F.col("n_here") > 1, 0.0).otherwise(F.sqrt(F.col("_d2").cast("double")))
    near = tried.filter(sure).select(*here, distance.alias("distance"))
    open_ = cut(tried.filter(~sure).select(*here))
    if open_.isEmpty():
        return near
    counts = spots.join(open_.select(*image).distinct(), image, "left_semi").groupBy(*image).agg(F.count("*").alias("_spots"))
    open_ = open_.join(counts, image)
    single = open_.filter("_spots = 1").select(*here, F.lit(None).cast("double").alias("distance"))
    others = cut(open_.filter("_spots > 1").select(*here))
    out = near.unionByName(single)
    if others.isEmpty():
        return out
    return out.unionByName(_descended(others, spots.join(others.select(*image).distinct(), image, "left_semi"), image))


def _descended(open_: DataFrame, spots: DataFrame, image: list[str]) -> DataFrame:
    """The nearest other spot of every position, from the top of a pyramid of occupied cells downwards.

    A cell is the box of its spots. At each level the cells whose near side is beyond
    the far side of another one drop out, and the others are opened.
    """
    box = ["_x0", "_x1", "_y0", "_y1"]
    x, y = F.col("x").cast("long"), F.col("y").cast("long")
    levels = [cut(spots.select(*image, x.alias("_cx"), y.alias("_cy"), x.alias("_x0"), x.alias("_x1"), y.alias("_y0"), y.alias("_y1")))]
    low, high = spots.agg(F.min(F.least("x", "y")), F.max(F.greatest("x", "y"))).first()
    for _ in range(int(max(abs(low), abs(high))).bit_length()):  # then an image has four cells at most
        up = [F.shiftright(c, 1).alias(c) for c in ("_cx", "_cy")]
        levels.append(cut(levels[-1].groupBy(*image, *up).agg(*[(F.min if c[-1] == "0" else F.max)(c).alias(c) for c in box])))
    own = [*image, "x", "y", "n_here"]
    found = open_.join(levels[-1].select(*image, "_cx", "_cy"), image)
    for level in levels[-2::-1]:
        below = level.withColumns({"_px": F.shiftright("_cx", 1), "_py": F.shiftright("_cy", 1)})
        t = found.select(*own, F.col("_cx").alias("_px"), F.col("_cy").alias("_py")).join(below, [*image, "_px", "_py"])
        t = t.filter(~((F.col("_x0") == x) & (F.col("_x1") == x) & (F.col("_y0") == y) & (F.col("_y1") == y)))  # the position itself
        zero = F.lit(0).cast("long")
        nx, ny = F.greatest(zero, F.col("_x0") - x, x - F.col("_x1")), F.greatest(zero, F.col("_y0") - y, y - F.col("_y1"))
        fx, fy = F.greatest(x - F.col("_x0"), F.col("_x1") - x), F.greatest(y - F.col("_y0"), F.col("_y1") - y)
        t = t.withColumns({"_near": nx * nx + ny * ny, "_far": F.min(fx * fx + fy * fy).over(W.partitionBy(*image, "x", "y"))})
        found = cut(t.filter("_near <= _far").select(*own, "_cx", "_cy", "_near"))
    return found.groupBy(*own).agg(F.sqrt(F.min("_near").cast("double")).alias("distance"))


def regions_of(df: DataFrame, value: Column, regions: Sequence[tuple[str, float, float]]) -> DataFrame:
    """Assign half-open named intervals; a short literal list needs no join."""
    table = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi"))
                      for n, lo, hi in regions])
    hit = F.filter(table, lambda r: (value >= r["lo"]) & (value < r["hi"]))
    return df.withColumn("region", F.explode(F.transform(hit, lambda r: r["name"])))


def join_regions(df: DataFrame, regions: DataFrame, step_col: str = "e10") -> DataFrame:
    """Range join against a table of regions (region, start, stop in degrees):
    each region is expanded to the grid steps it covers, then equi-joined.
    Open ends reach to the ends of the grid."""
    top = float(K.GRID_LIMIT)
    lo = F.ceil(F.greatest(F.col("start") * 10, F.lit(-top))).cast("int")
    hi = (F.ceil(F.least(F.col("stop") * 10, F.lit(top + 1))) - 1).cast("int")
    steps = regions.withColumn("_lo", lo).withColumn("_hi", hi).filter("_lo <= _hi").select(
        "region", F.explode(F.sequence("_lo", "_hi")).alias(step_col))
    return df.join(steps, step_col)


def first_at_least(source: DataFrame, ref: DataFrame, keys: Sequence[str], at: str, value: str) -> DataFrame:
    """For each source row the smallest reference ``value`` whose ``at`` is not
    below its own. Meant for histograms, i.e. a fixed number of rows per key."""
    keys = list(keys)
    s = source.select(*keys, F.col(at).alias("_at"), F.col(value).alias("_src"), F.lit(None).cast("double").alias("_ref"))
    r = ref.select(*keys, F.col(at).alias("_at"), F.lit(None).cast("double").alias("_src"), F.col(value).cast("double").alias("_ref"))
    both = s.withColumn("_src", F.col("_src").cast("double")).unionByName(r)
    w = W.partitionBy(*keys).orderBy(F.col("_at")).rangeBetween(W.currentRow, W.unboundedFollowing)
    look = both.withColumn("lookup", F.min("_ref").over(w)).filter(F.col("_src").isNotNull())
    back = W.partitionBy(*keys).orderBy("_src").rowsBetween(W.unboundedPreceding, 0)
    return look.select(*keys, F.col("_src").alias(value), F.coalesce(
        F.last("lookup", True).over(back), F.lit(0.0)).alias("lookup"))


def shared_pixels(pixels: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pixels lit in both images of each pair, relative to the first's corner."""
    lit = pixels.filter("v > 0").select("image_id", "x", "y")
    corner = lit.groupBy("image_id").agg(F.min("x").alias("_left"), F.min("y").alias("_top"))
    a = lit.join(pairs.select(F.col("image_a").alias("image_id"), "image_b"), "image_id").join(corner, "image_id")
    b = lit.select(F.col("image_id").alias("image_b"), "x", "y")
    return a.join(b, ["image_b", "x", "y"]).select(
        F.col("image_id").alias("image_a"), "image_b", (F.col("x") - F.col("_left")).alias("x"), (F.col("y") - F.col("_top")).alias("y"))
