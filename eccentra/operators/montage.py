"""Montage elements: neighbours, bounds, overlaps, matches, patches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from eccentra import constants as K
from eccentra.functions import geometry as G

MATRIX = ["a11", "a12", "a13", "a21", "a22", "a23"]
FOUR = [(1, 0), (-1, 0), (0, 1), (0, -1)]
EIGHT = FOUR + [(-1, -1), (-1, 1), (1, 1), (1, -1)]


def neighbours(elements: DataFrame, offsets: Sequence[tuple[int, int]] = FOUR,
               carry: Sequence[str] = tuple(MATRIX)) -> DataFrame:
    """Each element with its grid neighbours of the same mosaic (columns o_*).

    Every element asks for a fixed number of positions, so this is an
    equi-join on position, not a pairing of all elements of a mosaic. It is merged: the
    compressed size of the elements' files would pass for one to broadcast.
    """
    want = F.explode(F.array(*[F.struct((F.col("x") + dx).alias("wx"), (F.col("y") + dy).alias("wy"))
                               for dx, dy in offsets]))
    asked = elements.withColumn("_w", want).withColumn("_wx", F.col("_w.wx")).withColumn("_wy", F.col("_w.wy")).drop("_w")
    other = elements.select(F.col("mosaic_id").alias("_m"), F.col("x").alias("_ox"), F.col("y").alias("_oy"),
                            F.col("element_id").alias("other_id"), *[F.col(c).alias("o_" + c) for c in carry])
    return asked.join(other.hint("merge"), (F.col("mosaic_id") == F.col("_m")) & (F.col("_wx") == F.col("_ox"))
                      & (F.col("_wy") == F.col("_oy"))).drop("_m", "_wx", "_wy", "_ox", "_oy")


def _corner_values(size: float) -> tuple[list[Column], list[Column]]:
    xs, ys = [], []
    for cx in (0.0, size):
        for cy in (0.0, size):
            x, y = G.affine(F.lit(cx), F.lit(cy))
            xs.append(x)
            ys.append(y)
    return xs, ys


def mosaic_bounds(elements: DataFrame, mosaic: str, size: float = K.IMAGE_SIZE) -> DataFrame:
    """Whole-pixel bounding box of the transformed images of each mosaic."""
    xs, ys = _corner_values(float(size))
    return elements.groupBy(mosaic).agg(
        F.ceil(F.max(F.greatest(*xs))).cast("bigint").alias("max_x"),
        F.ceil(F.max(F.greatest(*ys))).cast("bigint").alias("max_y"),
        F.floor(F.min(F.least(*xs))).cast("bigint").alias("min_x"),
        F.floor(F.min(F.least(*ys))).cast("bigint").alias("min_y"))


def translate_to_origin(elements: DataFrame, mosaic: str, size: float = K.IMAGE_SIZE) -> DataFrame:
    box = mosaic_bounds(elements, mosaic, size).select(mosaic, "min_x", "min_y")
    return (elements.join(box, mosaic).withColumn("a13", F.col("a13") - F.col("min_x"))
            .withColumn("a23", F.col("a23") - F.col("min_y")).drop("min_x", "min_y"))


def overlap_box(size: float = K.IMAGE_SIZE) -> dict[str, Column]:
    """Overlap of two translated images (columns a13/a23 and o_a13/o_a23)."""
    left, right = F.greatest("a13", "o_a13"), F.least("a13", "o_a13") + size
    top, bottom = F.greatest("a23", "o_a23"), F.least("a23", "o_a23") + size
    return {"left": left, "top": top, "right": right, "bottom": bottom,
            "area": F.greatest(right - left, F.lit(0.0)) * F.greatest(bottom - top, F.lit(0.0))}


def neighbour_distance(elements: DataFrame, corrected: bool = False) -> DataFrame:
    """Translation distance to each neighbour; without overlap the distance is
    unknown unless the montage was corrected by hand."""
    n = neighbours(elements)
    if not corrected:
        n = n.filter(overlap_box()["area"] > 1e-10)
    dx, dy = F.col("a13") - F.col("o_a13"), F.col("a23") - F.col("o_a23")
    return n.withColumn("distance", F.sqrt(dx * dx + dy * dy))


def box_overlaps(elements: DataFrame) -> DataFrame:
    o = overlap_box()
    return neighbours(elements).filter(o["area"] > 0).select(
        "element_id", "other_id", *[c.alias(n) for n, c in o.items()])


def manhattan_candidates(elements: DataFrame, level: int) -> DataFrame:
    """Reference candidates at city-block distance 1..level in the same mosaic."""
    reach = [(dx, dy) for dx in range(-level, level + 1) for dy in range(-level, level + 1)
             if 0 < abs(dx) + abs(dy) <= level]
    return neighbours(elements, reach, carry=["x", "y"]).withColumn(
        "distance", F.abs(F.col("x") - F.col("o_x")) + F.abs(F.col("y") - F.col("o_y")))


def best_match(candidates: DataFrame, node: Sequence[str], inliers: str, matches: str, ref: str,
               threshold: int, min_ratio: float = 0.1) -> DataFrame:
    """Candidate with most inliers, then the highest inlier share, then the
    smallest reference; accepted above the threshold or by share."""
    share = F.col(inliers) / F.col(matches)
    best = candidates.filter(F.col(inliers) > 0).groupBy(*node).agg(F.max(F.struct(
        F.col(inliers).alias("n"), share.alias("share"), (-F.col(ref)).alias("neg_ref"))).alias("b"))
    out = best.select(*node, (-F.col("b.neg_ref")).alias(ref), F.col("b.n").alias(inliers), F.col("b.share").alias("share"))
    return out.filter((F.col(inliers) > threshold) | ((F.col("share") > min_ratio) & (F.col(inliers) > 1)))


def patch_grid(images: DataFrame, width: str, height: str, patch: int) -> DataFrame:
    """Numbered patch positions of each image, column by column."""
    out = (images.withColumn("_ys", G.patch_offsets(F.col(height), patch))
           .select("*", F.posexplode(G.patch_offsets(F.col(width), patch)).alias("_i", "patch_x"))
           .select("*", F.posexplode("_ys").alias("_j", "patch_y")))
    return out.withColumn("patch_no", (F.col("_i") * F.size("_ys") + F.col("_j") + 1).cast("bigint")).drop("_ys", "_i", "_j")


def patch_overlaps(images: DataFrame, key: str, width: str, height: str, patch: int) -> DataFrame:
    """Overlap rectangles of patches in one row or one column of an image.

    Only patch positions are compared, a number fixed by the image size; the
    rectangles come from array functions without any self-join.
    """
    xs, ys = G.patch_offsets(F.col(width), patch), G.patch_offsets(F.col(height), patch)
    base = images.select(key, xs.alias("xs"), ys.alias("ys"))

    def side(along: str, across: str, horizontal: bool) -> DataFrame:
        a = base.select(key, along, across, F.posexplode(along).alias("_i", "_p"))
        a = a.select(key, across, "_p", F.explode(F.slice(along, F.col("_i") + 2, F.size(along))).alias("_q"))
        a = a.filter(F.least("_p", "_q") + patch > F.greatest("_p", "_q"))
        a = a.select(key, "_p", "_q", F.explode(across).alias("_c"))
        s, e = F.greatest("_p", "_q"), F.least("_p", "_q") + patch
        lo, hi = F.col("_c"), F.col("_c") + patch
        cols = (s, lo, e, hi) if horizontal else (lo, s, hi, e)
        return a.select(key, *[c.alias(n) for c, n in zip(cols, ("x0", "y0", "x1", "y1"))])

    return side("xs", "ys", True).unionByName(side("ys", "xs", False))


def max_shift(df: DataFrame, keys: Sequence[str], dx: str, dy: str) -> DataFrame:
    """Largest absolute shift per axis within ``keys``, joined back."""
    top = df.groupBy(*keys).agg(F.max(F.abs(F.col(dx))).alias("pad_x"), F.max(F.abs(F.col(dy))).alias("pad_y"))
    return df.join(top, list(keys))


def cross_image_distance(x1: Column, y1: Column, x2: Column, y2: Column, gap: Column) -> Column:
    """Distance of two patches on different images in a row, a column or diagonal."""
    column = gap - F.abs(y1 - y2)
    row = gap - F.abs(x1 - x2)
    diagonal = F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))
    return F.when(x1 == x2, column).when(y1 == y2, row).otherwise(diagonal)
