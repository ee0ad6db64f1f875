"""Counts, areas and densities of detected points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from eccentra import constants as K
from eccentra.functions import geometry as G


def clean_density(df: DataFrame, density: str, top: float = K.MAX_PLAUSIBLE_DENSITY) -> DataFrame:
    return df.filter((F.col(density) != 0) & (F.col(density) <= top))


def obvious_low_filter(df: DataFrame, density: str) -> DataFrame:
    e = F.abs(F.col("e10")) / 10.0
    return df.filter(F.abs(F.col("e10")).between(10, 100) & (F.col(density) > 20000.0 / (1.0 + F.pow(e, F.lit(1.4)))))


def tile_of(col: str, size: int) -> Column:
    return F.floor(F.col(col) / size).cast("int")


def drop_mostly_dark(pixels: DataFrame, image: Sequence[str], size: int, bright: Column, share: float) -> DataFrame:
    """Tiles whose bright pixels make up at least ``share`` of the tile's area;
    pixels without a row count as dark."""
    t = pixels.groupBy(*image, tile_of("x", size).alias("tx"), tile_of("y", size).alias("ty")).agg(
        F.count(F.when(bright, 1)).alias("bright"), F.count("*").alias("n"))
    return t.filter(F.col("bright") >= share * size * size)


def _both_axes(df: DataFrame) -> DataFrame:
    return df.withColumn("axis", F.explode(F.array(F.lit("X"), F.lit("Y"))))


def signed_steps(points: DataFrame, cx: float, cy: float) -> DataFrame:
    """One row per point and sector it lies in, with its signed grid step."""
    dx, dy = F.col("x") - F.lit(cx), F.col("y") - F.lit(cy)
    p = _both_axes(points).filter(G.in_count_sector(F.col("axis"), G.pixel_steps(dx), G.pixel_steps(dy)))
    side = F.when(F.when(F.col("axis") == "X", dx).otherwise(dy) < 0, -1).otherwise(1)
    return p.withColumn("e10", side * G.pixel_steps(F.sqrt(dx * dx + dy * dy)))


def point_counts(points: DataFrame, image: Sequence[str], cx: float, cy: float,
                 mask: DataFrame | None = None) -> DataFrame:
    """Points per signed grid step; with a mask only points on valid pixels."""
    if mask is not None:
        points = points.join(mask.select(*image, "x", "y").distinct(), [*image, "x", "y"], "left_semi")
    return signed_steps(points, cx, cy).groupBy(*image, "axis", "e10").agg(F.count("*").alias("n_points"))


def mask_areas(pixels: DataFrame, image: Sequence[str], cx: float, cy: float, size: int = K.IMAGE_SIZE) -> DataFrame:
    """Valid pixels per signed grid step; distances beyond the reach of the
    axis fall on its last step."""
    dx, dy = F.col("x") - F.lit(cx), F.col("y") - F.lit(cy)
    p = _both_axes(pixels)
    along = F.when(F.col("axis") == "X", dx).otherwise(dy)
    across = F.when(F.col("axis") == "X", dy).otherwise(dx)
    p = p.filter(F.abs(across) <= K.SECTOR_SLOPE * F.abs(along) + K.SECTOR_OFFSET_PX)
    reach_x = G.pixel_steps(F.lit(float(max(cx, size - 1 - cx))))
    reach_y = G.pixel_steps(F.lit(float(max(cy, size - 1 - cy))))
    reach = F.when(F.col("axis") == "X", reach_x).otherwise(reach_y)
    step = F.least(G.pixel_steps(F.sqrt(dx * dx + dy * dy)), reach)
    return (p.withColumn("e10", F.when(along < 0, -step).otherwise(step))
            .groupBy(*image, "axis", "e10").agg(F.count("*").alias("area")))


def relocate_orphans(steps: DataFrame, keys: Sequence[str], count: str, area: str) -> DataFrame:
    """Move counts of steps without area toward zero.

    Steps are visited in ascending order: on the non-positive side counts run
    into the next step with area (at most step 1); on the positive side they
    would reach a step already done, so they drop out.
    """
    w = W.partitionBy(*keys).orderBy("e10").rowsBetween(0, W.unboundedFollowing)
    nxt = F.first(F.when(F.col(area).isNotNull(), F.col("e10")), True).over(w)
    t = steps.withColumn("_to", F.when(F.col(area).isNotNull(), F.col("e10")).when(
        (F.col("e10") <= 0) & (nxt <= 1), nxt))
    moved = t.filter(F.col("_to").isNotNull()).groupBy(*keys, F.col("_to").alias("e10")).agg(F.sum(count).alias(count))
    return moved


def density_by_step(near: DataFrame, far: DataFrame, areas: DataFrame, keys: Sequence[str],
                    threshold: float = K.AREA_THRESHOLD, near_limit: float = K.NEAR_LIMIT_DEG,
                    far_limit: float = K.FAR_LIMIT_DEG) -> DataFrame:
    """Density per source and their average, from counts and areas."""
    keys = list(keys)
    tagged = (near.select(*keys, "e10", F.col("n_points").alias("n_near"), F.lit(0).cast("bigint").alias("n_far"), F.lit(None).cast("bigint").alias("area"))
              .unionByName(far.select(*keys, "e10", F.lit(0).cast("bigint").alias("n_near"), F.col("n_points").alias("n_far"), F.lit(None).cast("bigint").alias("area")))
              .unionByName(areas.select(*keys, "e10", F.lit(0).cast("bigint").alias("n_near"), F.lit(0).cast("bigint").alias("n_far"), "area")))
    per = tagged.groupBy(*keys, "e10").agg(F.sum("n_near").alias("n_near"), F.sum("n_far").alias("n_far"), F.max("area").alias("area"))
    moved = relocate_orphans(per, keys, "n_far", "area")
    d = F.abs(F.col("e10")) / 10.0
    out = (per.drop("n_far").join(moved, keys + ["e10"]).filter(F.col("area") > threshold)
           .withColumn("far_density", F.when(d > far_limit, G.count_density(F.col("n_far"), F.col("area"), threshold)))
           .withColumn("near_density", F.when(d < near_limit, G.count_density(F.col("n_near"), F.col("area"), threshold))))
    n, f = F.col("near_density"), F.col("far_density")
    avg = F.when(n.isNotNull() & f.isNotNull(), (n + f) / 2).otherwise(F.coalesce(f, n))
    return out.withColumn("density", avg).select(*keys, "e10", "near_density", "far_density", "density")


def tile_density(points: DataFrame, pixels: DataFrame, image: Sequence[str], size: int, um_per_pixel: float,
                 min_bright: float = 0.3, image_size: int = K.IMAGE_SIZE) -> DataFrame:
    """Count, bright area and density of fixed square windows.

    Both sides are aggregated to tiles before they meet; tiles that are too
    dark are zeroed.
    """
    image = list(image)
    t = [tile_of("y", size).alias("ty"), tile_of("x", size).alias("tx")]
    n = points.groupBy(*image, *t).agg(F.count("*").alias("n_points"))
    a = pixels.filter("v > 0").groupBy(*image, *t).agg(F.count("*").alias("bright_area"))
    j = n.join(a, image + ["ty", "tx"], "full")
    side = [F.least((F.col(c) + 1) * size, F.lit(image_size)) - F.col(c) * size for c in ("ty", "tx")]
    ratio = F.coalesce("bright_area", F.lit(0)) / side[0] / side[1]
    ok = F.col("bright_ratio") >= min_bright
    return (j.withColumn("bright_ratio", ratio)
            .withColumn("n_points", F.when(ok, F.coalesce("n_points", F.lit(0))).otherwise(0).cast("bigint"))
            .withColumn("bright_area", F.when(ok, F.col("bright_area")).otherwise(0).cast("bigint"))
            .withColumn("density", F.when(F.col("bright_area") > 0, F.col("n_points") / F.col("bright_area")).otherwise(0.0)
                        / (um_per_pixel / 1000) ** 2))


def extent_ok(points: DataFrame, areas: DataFrame, image: Sequence[str]) -> DataFrame:
    """Whether the bounding box of the points exceeds half of the valid area."""
    box = points.groupBy(*image).agg(((F.max("x") - F.min("x")) * (F.max("y") - F.min("y"))).cast("bigint").alias("covered"))
    return areas.join(box, list(image), "left").withColumn(
        "detected_well", F.coalesce(F.col("covered") > F.floor(F.col("area") / 2), F.lit(False)))


def box_groups(df: DataFrame, density: str, limit: float = 1e5) -> Column:
    return F.when(F.col(density) > limit, "above").otherwise("below")


def confusion_scores(df: DataFrame, keys: Sequence[str], density: str, area: str,
                     limit: float = 1e5, threshold: float = K.AREA_THRESHOLD) -> DataFrame:
    """Small area as a predictor of an implausibly high density."""
    hi, small = F.col(density) > limit, F.col(area) < threshold
    c = df.groupBy(*keys).agg(F.count(F.when(hi & small, 1)).alias("tp"), F.count(F.when(hi & ~small, 1)).alias("fp"),
                              F.count(F.when(~hi & small, 1)).alias("fn"), F.count(F.when(~hi & ~small, 1)).alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    p, r = tp / F.nullif(tp + fp, F.lit(0)), tp / F.nullif(tp + fn, F.lit(0))
    return (c.withColumn("accuracy", (tp + tn) / (tp + fp + fn + tn)).withColumn("precision", p).withColumn("recall", r)
            .withColumn("f1", 2 * F.col("precision") * F.col("recall")
                        / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0))))
