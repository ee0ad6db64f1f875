"""Tiles as pixel rows: histograms, look-ups, paired metrics, clean-up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from eccentra.session import cut
from eccentra.operators import joins


def level_histogram(df: DataFrame, keys: Sequence[str], v: str = "v") -> DataFrame:
    """Counts per whole level (0..255)."""
    return df.groupBy(*keys, F.floor(v).cast("int").alias("level")).agg(F.count("*").alias("n"))


def normalized_cdf(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    w = W.partitionBy(*keys)
    run = F.sum("n").over(w.orderBy("level").rowsBetween(W.unboundedPreceding, 0))
    return hist.withColumn("cdf", run / F.sum("n").over(w))


def match_lookup(cdf: DataFrame) -> DataFrame:
    """Level look-up that carries each tile's histogram to the next tile's."""
    ref = cdf.select((F.col("tile_id") - 1).alias("tile_id"), "level", "cdf")
    have = ref.select("tile_id").distinct()
    return joins.first_at_least(cdf.join(have, "tile_id", "left_semi"), ref.join(
        cdf.select("tile_id").distinct(), "tile_id", "left_semi"), ["tile_id"], "cdf", "level")


def lut_apply(pixels: DataFrame, lut: DataFrame) -> DataFrame:
    return (pixels.withColumn("level", F.floor("v").cast("double")).join(lut, ["tile_id", "level"])
            .select("tile_id", "pos", F.col("lookup").alias("v")))


def count_histogram(df: DataFrame, keys: Sequence[str], n: str) -> DataFrame:
    """Unit-width histogram over [0, max]; the last bin is closed."""
    counts = df.groupBy(*keys, n).agg(F.count("*").alias("_c"))
    top = counts.groupBy(*keys).agg(F.max(n).alias("_max"))
    return counts.join(top, list(keys)).groupBy(*keys, F.least(F.col(n), F.col("_max") - 1).alias("bin")).agg(
        F.sum("_c").alias("n_patches"))


def histogram_stats(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Weighted mean, variance and median of level midpoints (at most 256 rows
    per key)."""
    w = W.partitionBy(*keys)
    mid = F.col("level") + 0.5
    h = (hist.withColumn("_total", F.sum("n").over(w))
         .withColumn("_run", F.sum("n").over(w.orderBy("level").rowsBetween(W.unboundedPreceding, 0)))
         .withColumn("_mean", F.sum(F.col("n") * mid).over(w) / F.col("_total")))
    return h.groupBy(*keys).agg(
        F.first("_mean").alias("mean"), (F.sum(F.col("n") * (mid - F.col("_mean")) * (mid - F.col("_mean"))) / F.first("_total")).alias("var"),
        F.min(F.when(F.col("_run") >= F.col("_total") / 2, mid)).alias("median"))


def robust_mode(df: DataFrame, keys: Sequence[str], v: str, bins: int = 100, width: int = 5) -> DataFrame:
    """Most probable value and population deviation.

    A histogram of ``bins`` cells is summed over ``width`` trailing cells; the
    two highest sums give the mode. Values are collapsed to distinct ones
    before the range is joined back.
    """
    keys = list(keys)
    distinct = df.groupBy(*keys, v).agg(F.count("*").alias("_n"))
    r = df.groupBy(*keys).agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"), F.stddev_pop(v).alias("std"))
    cell = F.when(F.col("_hi") > F.col("_lo"), F.least(F.lit(bins - 1), F.floor(
        (F.col(v) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins).cast("int"))).otherwise(0)
    h = distinct.join(r, keys).groupBy(*keys, cell.alias("_c")).agg(F.sum("_n").alias("_n"))
    spread = h.withColumn("_i", F.explode(F.sequence(F.col("_c"), F.col("_c") + width - 1)))
    m = spread.groupBy(*keys, "_i").agg(F.sum("_n").alias("_m"))
    top = m.groupBy(*keys).agg(F.slice(F.sort_array(F.collect_list(F.struct("_m", "_i")), asc=False), 1, 2).alias("_t"))
    t = top.join(r, keys)
    step = (F.col("_hi") - F.col("_lo")) / bins
    i1, i0 = F.col("_t")[0]["_i"], F.coalesce(F.get(F.col("_t"), 1)["_i"], F.lit(0))
    m1, m0 = F.col("_t")[0]["_m"], F.coalesce(F.get(F.col("_t"), 1)["_m"], F.lit(0))

    def edge(i):
        return F.col("_lo") + step * F.least(i, F.lit(bins))
    mode = F.when(m1 > m0 * 2, edge(i1)).otherwise((edge(F.least(i0, i1)) + edge(F.greatest(i0, i1) + 1)) / 2)
    return t.select(*keys, mode.alias("mode"), "std")


# --- paired metrics: rows (keys, pos, a, b) ---------------------------------------------------------

def tile_pairs(pixels: DataFrame) -> DataFrame:
    """Each tile with the following one, pixel by pixel."""
    nxt = pixels.select((F.col("tile_id") - 1).alias("tile_id"), "pos", F.col("v").alias("b"))
    return pixels.select("tile_id", "pos", F.col("v").alias("a")).join(nxt, ["tile_id", "pos"])


def pair_moments(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cross-correlations and mean squared difference; pairs with a constant
    side have no correlation."""
    d = F.col("a") - F.col("b")
    s = pairs.groupBy(*keys).agg(F.avg(F.col("a") * F.col("b")).alias("_ab"), F.stddev_pop("a").alias("_sa"), F.stddev_pop("b").alias("_sb"),
                                 F.covar_pop("a", "b").alias("_c"), F.avg(d * d).alias("mse"))
    ok = (F.col("_sa") > 0) & (F.col("_sb") > 0)
    return s.select(*keys, F.when(ok, F.col("_ab") / (F.col("_sa") * F.col("_sb"))).alias("ncc"),
                    F.when(ok, F.col("_c") / (F.col("_sa") * F.col("_sb"))).alias("zncc"), "mse")


def _information(joint: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mutual information and entropies (nats) of joint counts (i, j, n)."""
    keys, joint = list(keys), cut(joint)  # a histogram, read four times
    px = joint.groupBy(*keys, "i").agg(F.sum("n").alias("ni"))
    py = joint.groupBy(*keys, "j").agg(F.sum("n").alias("nj"))
    tot = joint.groupBy(*keys).agg(F.sum("n").alias("t"))

    def h(p, c):
        return p.join(tot, keys).groupBy(*keys).agg(F.sum(-F.col(c) / F.col("t") * F.ln(F.col(c) / F.col("t"))).alias("h_" + c))
    mi = joint.join(px, keys + ["i"]).join(py, keys + ["j"]).join(tot, keys).groupBy(*keys).agg(
        F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("ni") * F.col("nj")))).alias("mi"))
    return mi.join(h(px, "ni"), keys).join(h(py, "nj"), keys)


def mutual_information(pairs: DataFrame, keys: Sequence[str], bins: int = 20) -> DataFrame:
    """From a joint histogram over the ranges of both sides."""
    keys = list(keys)
    r = pairs.groupBy(*keys).agg(F.min("a").alias("_la"), F.max("a").alias("_ha"), F.min("b").alias("_lb"), F.max("b").alias("_hb"))

    def cell(v, lo, hi):
        at = F.floor((F.col(v) - F.col(lo)) / F.nullif(F.col(hi) - F.col(lo), F.lit(0.0)) * bins)
        return F.least(F.lit(bins - 1), F.coalesce(at, F.lit(0))).cast("int")
    joint = pairs.join(r, keys).groupBy(*keys, cell("a", "_la", "_ha").alias("i"), cell("b", "_lb", "_hb").alias("j")).agg(F.count("*").alias("n"))
    return _information(joint, keys).select(*keys, "mi")


def normalised_information(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mutual information of raw values over the mean of both entropies."""
    joint = pairs.groupBy(*keys, F.col("a").alias("i"), F.col("b").alias("j")).agg(F.count("*").alias("n"))
    mean = (F.col("h_ni") + F.col("h_nj")) / 2
    return _information(joint, keys).select(*keys, F.when(mean <= 0, 1.0).otherwise(F.col("mi") / F.nullif(mean, F.lit(0.0))).alias("nmi"))


def entropy(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Base-2 entropy: log2(total) - sum(n log2 n) / total, one pass."""
    n = F.col("n").cast("double")
    return hist.filter("n > 0").groupBy(*keys).agg(
        (F.log2(F.sum(n)) - F.sum(n * F.log2(n)) / F.sum(n)).alias("entropy"))


def ssim_1d(pairs: DataFrame, keys: Sequence[str], pos: str = "pos", width: int = 7, data_range: float = 255.0) -> DataFrame:
    """Structural similarity along the flattened arrays, full windows only."""
    w = W.partitionBy(*keys).orderBy(pos).rowsBetween(-(width // 2), width // 2)
    a, b = F.col("a"), F.col("b")
    t = (pairs.withColumn("_k", F.count("*").over(w)).withColumn("_ua", F.avg("a").over(w)).withColumn("_ub", F.avg("b").over(w))
         .withColumn("_aa", F.avg(a * a).over(w)).withColumn("_bb", F.avg(b * b).over(w)).withColumn("_ab", F.avg(a * b).over(w)))
    norm = width / (width - 1)
    c1, c2 = (0.01 * data_range) ** 2, (0.03 * data_range) ** 2
    ua, ub = F.col("_ua"), F.col("_ub")
    va, vb, vab = norm * (F.col("_aa") - ua * ua), norm * (F.col("_bb") - ub * ub), norm * (F.col("_ab") - ua * ub)
    s = (2 * ua * ub + c1) * (2 * vab + c2) / ((ua * ua + ub * ub + c1) * (va + vb + c2))
    return t.filter(F.col("_k") == width).groupBy(*keys).agg(F.avg(s).alias("ssim"))


def overlap_crop(pairs: DataFrame, dx: Column, dy: Column, side: int) -> DataFrame:
    """Pixels inside the box both arrays share after a shift."""
    r, c = F.floor(F.col("pos") / side), F.col("pos") % side
    return pairs.filter((r >= F.greatest(F.lit(0), dy)) & (r < side + F.least(F.lit(0), dy))
                        & (c >= F.greatest(F.lit(0), dx)) & (c < side + F.least(F.lit(0), dx)))


# --- clean-up -----------------------------------------------------------------------------------------

def clip_outliers(pixels: DataFrame, keys: Sequence[str], v: str, lower: bool = True, upper: bool = True, zero: bool = False,
                  replace: str = "median", spread: str = "std", overall: DataFrame | None = None,
                  overall_keys: Sequence[str] = ()) -> DataFrame:
    """Replace values beyond mean -+ spread, and values <= 0, step by step.

    Locally the statistics of a tile (a fixed number of pixels) are taken again
    after each step. With ``overall`` (mean, var, median per ``overall_keys``)
    the same limits serve all tiles.
    """
    if replace not in ("median", "border") or spread not in ("std", "var"):
        raise ValueError("replace is 'median' or 'border', spread is 'std' or 'var'")
    cols = pixels.columns
    t = pixels
    if overall is not None:
        t = t.join(overall.select(*overall_keys, F.col("mean").alias("_m"), F.col("var").alias("_var"), F.col("median").alias("_med")), list(overall_keys))
        t = t.withColumn("_s", F.sqrt("_var") if spread == "std" else F.col("_var"))
    w = W.partitionBy(*keys)
    for side, on in (("lower", lower), ("upper", upper), ("zero", zero)):
        if not on:
            continue
        if overall is None:
            t = (t.withColumn("_m", F.avg(v).over(w)).withColumn("_s", (F.stddev_pop if spread == "std" else F.var_pop)(v).over(w))
                 .withColumn("_med", F.percentile(v, F.lit(0.5)).over(w)))
        lo, hi = F.col("_m") - F.col("_s"), F.col("_m") + F.col("_s")
        hit = {"lower": F.col(v) <= lo, "upper": F.col(v) >= hi, "zero": F.col(v) <= 0}[side]
        new = F.col("_med") if replace == "median" else (hi if side == "upper" else lo)
        t = t.withColumn(v, F.when(hit, new).otherwise(F.col(v)))
    return t.select(*cols)


def zero_fill(pixels: DataFrame, keys: Sequence[str], row: str, col: str, v: str) -> DataFrame:
    """Zeros become the mean of their non-zero 4-neighbours. Pixels send their
    value to the four places around them, so one aggregation does it."""
    keys = list(keys)
    own = pixels.select(*keys, row, col, F.col(v).alias("_own"), F.lit(None).cast("double").alias("_nb"))
    step = F.explode(F.array(*[F.struct(F.lit(a).alias("r"), F.lit(c).alias("c")) for a, c in ((1, 0), (-1, 0), (0, 1), (0, -1))]))
    sent = pixels.filter(F.col(v) != 0).withColumn("_d", step).select(
        *keys, (F.col(row) + F.col("_d.r")).alias(row), (F.col(col) + F.col("_d.c")).alias(col), F.lit(None).cast("double").alias("_own"), F.col(v).alias("_nb"))
    g = own.unionByName(sent).groupBy(*keys, row, col).agg(F.max("_own").alias("_own"), F.avg("_nb").alias("_nb")).filter("_own IS NOT NULL")
    return g.select(*keys, row, col, F.when(F.col("_own") == 0, F.coalesce("_nb", "_own")).otherwise(F.col("_own")).alias(v))
