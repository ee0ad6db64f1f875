"""Peaks, valleys, widths and turning points of gridded profiles."""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from eccentra.operators import batches

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def split_parts(df: DataFrame, limits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Four parts around two peak positions (columns lower, upper); a peak
    itself belongs to both neighbouring parts, the centre to none. Without
    peaks a profile has two parts, left and right."""
    e = F.col("e10")
    tests = [("left", (e < 0) & F.col("lower").isNull()), ("right", (e > 0) & F.col("lower").isNull()), ("first", (e < 0) & (e <= F.col("lower"))), ("second", (e < 0) & (e >= F.col("lower"))),
             ("third", (e > 0) & (e <= F.col("upper"))), ("fourth", (e > 0) & (e >= F.col("upper")))]
    parts = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in tests]), lambda p: p.isNotNull())
    return df.join(limits, list(keys)).withColumn("part", F.explode(parts))


def find_peaks(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Strict local maxima (+1) and minima (-1); a flat top counts once, at the
    middle of its run. Positions are 0-based places within the profile."""
    keys = list(keys)
    kinds = {f.name: f.dataType.simpleString() for f in df.select(order, value).schema}
    t = df.withColumn("_null", F.col(value).isNull().cast("int"))

    def work(values, starts):
        null, v, n = values["_null"] == 1, values[value], len(values["_null"])
        nan = np.isnan(v) & ~null  # NaN is larger than any number, as in Spark
        own = batches.owners(starts, n)
        new = np.r_[True, (own[1:] != own[:-1]) | null[1:] | null[:-1] | (nan[1:] != nan[:-1]) | (~nan[1:] & (v[1:] != v[:-1]))]
        a = np.flatnonzero(new)
        z = np.r_[a[1:], n] - 1
        top, big, gone, of = v[a], nan[a], null[a], own[a]

        def higher(i, j):
            return (of[i] == of[j]) & ~gone[i] & ~gone[j] & ((big[i] & ~big[j]) | (top[i] > top[j]))
        mid, left, right = np.arange(1, len(a) - 1), np.arange(0, len(a) - 2), np.arange(2, len(a))
        up, down = higher(mid, left) & higher(mid, right), higher(left, mid) & higher(right, mid)
        hit = mid[up | down]
        first = starts[of[hit]]
        place = (a[hit] - first + z[hit] - first) // 2
        at = first + place
        return at, {"place": place, "kind": np.where(up[hit - 1], 1, -1), value: values[value][at], order: values[order][at]}

    return batches.map_profiles(t, keys, [order], ["_null", value, order], work, [("place", "int"), ("kind", "int"), (value, kinds[value]), (order, kinds[order])])


def peak_limits(peaks: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Positions of the two peaks of profiles that have exactly two."""
    p = peaks.filter("kind = 1").groupBy(*keys).agg(F.min(order).alias("lower"), F.max(order).alias("upper"), F.count("*").alias("_n"))
    return p.filter("_n = 2").drop("_n")


def width_at(df: DataFrame, keys: Sequence[str], order: str, value: str, percent: float) -> DataFrame:
    """Width of the highest peak at a percentage of its height, with linear
    crossings; open sides end at the profile's end."""
    keys = list(keys)
    w = W.partitionBy(*keys).orderBy(order)
    me = F.struct(F.col(order).cast("double").alias("x"), F.col(value).alias("y"))
    t = df.filter(F.col(value).isNotNull()).withColumn("_i", F.row_number().over(w)).withColumn("_me", me)
    t = t.withColumn("_next", F.lead("_me").over(w)).withColumn("_prev", F.lag("_me").over(w))
    top = t.groupBy(*keys).agg(F.max(F.struct(F.col(value).alias("v"), (-F.col("_i")).alias("neg"))).alias("m"))
    j = t.join(top, keys).withColumn("_top", -F.col("m.neg")).withColumn("_thr", F.col("m.v") * percent / 100.0)
    below = F.col(value) <= F.col("_thr")
    left, right = below & (F.col("_i") < F.col("_top")), below & (F.col("_i") >= F.col("_top"))
    e = F.struct("_i", "_me", "_next", "_prev")
    a = j.groupBy(*keys).agg(F.first("_thr").alias("thr"), F.first("_top").alias("top"),
                             F.coalesce(F.max_by(e, F.when(left, F.col("_i"))), F.min_by(e, "_i")).alias("l"),
                             F.coalesce(F.min_by(e, F.when(right, F.col("_i"))), F.max_by(e, "_i")).alias("r"))

    def cross(p, q):
        flat = F.col(q + ".y") == F.col(p + ".y")
        return F.when(flat, F.col(p + ".x")).otherwise(F.col(p + ".x") + (F.col("thr") - F.col(p + ".y")) * (
            F.col(q + ".x") - F.col(p + ".x")) / (F.col(q + ".y") - F.col(p + ".y")))
    lx = F.when(F.col("l._i") < F.col("top") - 1, cross("l._me", "l._next")).otherwise(F.col("l._me.x"))
    rx = F.when(F.col("r._i") > F.col("top"), cross("r._prev", "r._me")).otherwise(F.col("r._me.x"))
    return a.select(*keys, F.abs(rx - lx).alias("width"))


def _gradient(value: str, order: str, w) -> Column:
    l, r = F.lag(value).over(w), F.lead(value).over(w)  # noqa: E741
    x, lx, rx = F.col(order), F.lag(order).over(w), F.lead(order).over(w)
    inner = (r - l) / (rx - lx)
    return F.when(lx.isNull(), (r - F.col(value)) / (rx - x)).when(rx.isNull(), (F.col(value) - l) / (x - lx)).otherwise(inner)


def inflection(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Steepest descent among the turning points of an evenly spaced profile."""
    w = W.partitionBy(*keys).orderBy(x)
    t = df.filter(F.col(y).isNotNull()).select(*keys, F.col(x).cast("double").alias(x), y)
    t = t.withColumn("d1", _gradient(y, x, w))
    t = t.withColumn("d2", _gradient("d1", x, w))
    t = t.withColumn("d3", _gradient("d2", x, w)).withColumn("_turn", F.signum("d2") != F.signum(F.lead("d2").over(w)))
    return t.filter(F.col("_turn") & (F.col("d3") > 0)).groupBy(*keys).agg(F.min(F.struct("d1", x)).alias("b")).select(
        *keys, F.col(f"b.{x}").alias(x), F.col("b.d1").alias("slope"))


def pit_minimum(df: DataFrame, keys: Sequence[str], x: str, y: str, points: int = 10, flat: float = 0.0) -> DataFrame:
    """Vertex value of the parabola through the lowest points of a profile;
    null where they do not make one or its bend is at most ``flat``."""
    w = W.partitionBy(*keys).orderBy(y, x)
    low = df.filter(F.col(y).isNotNull()).withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= points)
    u, v = F.col(x).cast("double"), F.col(y)
    s = low.groupBy(*keys).agg(F.count("*").alias("n"), *[F.sum(F.pow(u, F.lit(float(k)))).alias(f"s{k}") for k in range(1, 5)],
                               *[F.sum(F.pow(u, F.lit(float(k))) * v).alias(f"t{k}") for k in range(3)])
    n, s1, s2, s3, s4, t0, t1, t2 = (F.col(c).cast("double") for c in ("n", "s1", "s2", "s3", "s4", "t0", "t1", "t2"))
    det = s4 * (s2 * n - s1 * s1) - s3 * (s3 * n - s1 * s2) + s2 * (s3 * s1 - s2 * s2)
    a = (t2 * (s2 * n - s1 * s1) - s3 * (t1 * n - s1 * t0) + s2 * (t1 * s1 - s2 * t0)) / F.col("_det")
    b = (s4 * (t1 * n - s1 * t0) - t2 * (s3 * n - s1 * s2) + s2 * (s3 * t0 - t1 * s2)) / F.col("_det")
    c = (s4 * (s2 * t0 - t1 * s1) - s3 * (s3 * t0 - t1 * s2) + t2 * (s3 * s1 - s2 * s2)) / F.col("_det")
    f = s.withColumn("_det", F.nullif(det, F.lit(0.0))).select(*keys, a.alias("a"), b.alias("b"), c.alias("c"))
    return f.select(*keys, "a", F.when(F.abs("a") > flat, F.col("c") - F.col("b") * F.col("b") / (4 * F.col("a"))).alias("minimum"))


def otsu(hist: DataFrame, keys: Sequence[str], bin_col: str = "bin", n: str = "n") -> DataFrame:
    """Threshold of largest between-class variance, the least among equals; bins of unit width.

    The variance is one quotient of whole numbers (the sums are halves at most), so that equal ones are equal.
    """
    w = W.partitionBy(*keys).orderBy(bin_col)
    mid = F.col(bin_col) + 0.5
    up = w.rowsBetween(W.unboundedPreceding, 0)
    rest = w.rowsBetween(1, W.unboundedFollowing)
    t = (hist.withColumn("_w1", F.sum(n).over(up)).withColumn("_m1", F.sum(F.col(n) * mid).over(up))
         .withColumn("_w2", F.sum(n).over(rest)).withColumn("_m2", F.sum(F.col(n) * mid).over(rest)))
    w1, w2 = F.col("_w1").cast("double"), F.col("_w2").cast("double")
    gap = F.col("_m1") * w2 - F.col("_m2") * w1
    t = t.filter("_w2 > 0").withColumn("_v", gap * gap / (w1 * w2))
    best = t.groupBy(*keys).agg(F.max(F.struct("_v", (-F.col(bin_col)).alias("neg"))).alias("b"))
    return best.select(*keys, (0.5 - F.col("b.neg")).alias("threshold"))


def valley_threshold(hist: DataFrame, keys: Sequence[str], bin_col: str, n: str, bins: int) -> DataFrame:
    """Bin of the largest slope change between 25 and 75 % of the way to the
    main peak of a smoothed, dense histogram; the middle bin without one."""
    keys = list(keys)
    w = W.partitionBy(*keys).orderBy(bin_col)
    t = hist.withColumn("_s", F.lead(n).over(w) - F.col(n))
    t = t.withColumn("_d", F.lead("_s").over(w) - F.col("_s"))
    centre = (bins - 1) / 2.0
    spread = ((bins * bins - 1) / 12.0) ** 0.5
    p = find_peaks(hist, keys, bin_col, n).filter("kind = 1")
    main = p.groupBy(*keys).agg(
        F.max(F.when(F.col(bin_col) > centre - spread, F.struct(F.col(n).alias("v"), (-F.col("place")).alias("neg")))).alias("_m"),
        F.min("place").alias("_first")).select(*keys, F.coalesce(-F.col("_m.neg"), F.col("_first")).alias("_peak"))
    j = t.join(main, keys)
    i, pk = F.col(bin_col), F.col("_peak")
    ok = (i + 1 < pk - 3) & (i >= 0.25 * pk) & (i <= 0.75 * pk)
    best = j.filter(ok).groupBy(*keys).agg(F.max(F.struct("_d", (-i).alias("neg"))).alias("_b"))
    return hist.select(*keys).distinct().join(best, keys, "left").select(
        *keys, F.coalesce(-F.col("_b.neg"), F.lit(round(bins / 2))).cast("int").alias("threshold"))


def model_slopes(params: DataFrame, side: int, target: float = 8000.0) -> DataFrame:
    """Width where the model's slope falls to ``target`` (0.5..6 degrees from
    the centre) and its largest slope within 3 degrees.

    Log density is a - b*X + d/(X + e) at distance X; both numbers come from a
    fixed grid of distances, row by row.
    """
    a, b, d, e = (F.col(c) for c in ("a", "b", "d", "e"))

    def slope(x):
        return F.exp(a - b * x + d / (x + e)) * (b + d / ((x + e) * (x + e)))
    xs = F.transform(F.sequence(F.lit(50), F.lit(600)), lambda k: k / 100.0)
    low = F.filter(xs, lambda x: slope(x) <= target)[0]
    before = low - 0.01
    width = F.when(low <= 0.5, low).otherwise(before + 0.01 * (slope(before) - target) / (slope(before) - slope(low)))
    steep = F.array_max(F.transform(F.sequence(F.lit(0), F.lit(999)), lambda k: slope(0.001 + k * (2.999 / 999))))
    return params.withColumn("width", width).withColumn("max_slope", steep).withColumn("side", F.lit(side))


# --- whole-profile searches: array work inside the task that holds one profile ----------------------

def _mirror_smooth(v: np.ndarray, sigma: float) -> np.ndarray:
    """Mirror-ended Gaussian that ignores NaN."""
    if sigma <= 0:
        return v.astype(float)
    r, n = int(4 * sigma + 0.5), len(v)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    at = np.arange(-r, n + r) % (2 * n)
    at = np.where(at < n, at, 2 * n - 1 - at)
    ok = ~np.isnan(v)
    num = np.convolve(np.where(ok, v, 0)[at], k, mode="valid")
    den = np.convolve(ok.astype(float)[at], k, mode="valid")
    return np.where(den > 0, num / np.where(den > 0, den, 1), np.nan)


def _maxima(v: np.ndarray) -> np.ndarray:
    """Places of strict maxima, flat tops at their middle."""
    if len(v) < 3:
        return np.zeros(0, int)
    start = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
    stop = np.r_[start[1:] - 1, len(v) - 1]
    run = v[start]
    inner = (run[1:-1] > run[:-2]) & (run[1:-1] > run[2:])
    return (start[1:-1][inner] + stop[1:-1][inner]) // 2


def _has_two_peaks(s: np.ndarray) -> np.ndarray | None:
    """Places of the two peaks of a profile with one valley."""
    p = _maxima(s)
    return p if len(p) == 2 and len(_maxima(-s)) == 1 else None


def _mirror_waves(n: int, sigmas: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cosines of a profile of ``n`` values, which mirror-ended smoothing only scales: their
    values, the steps between neighbours, and the scale of each wave at each of ``sigmas``."""
    k = np.arange(1, n)
    waves = np.cos(np.pi * k[None, :] * (np.arange(n)[:, None] + 0.5) / n)
    folded = []  # kernels, wrapped around the profile and its mirror image
    for sigma in sigmas:
        d = np.arange(-int(4 * sigma + 0.5), int(4 * sigma + 0.5) + 1)
        w = np.exp(-0.5 * (d / sigma) ** 2)
        folded.append(np.bincount(d % (2 * n), w / w.sum(), 2 * n))
    scale = np.array(folded) @ np.cos(np.pi * (np.arange(2 * n)[:, None] * k[None, :] % (2 * n)) / n)
    return waves * (2 / n), np.diff(waves, axis=0).T.copy(), scale


def _least_sigma(v: np.ndarray, top: int, waves: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Least sigma (-1: none) and both peak places of profiles of one length, as rows.

    Only the signs of the steps between neighbours decide. They are taken from the waves
    wherever a step is far above rounding; a profile with a step that is not, such as a flat top, is
    smoothed by the plain sum at that sigma.
    """
    analysis, steps, scale = waves
    found, places = np.full(len(v), -1), np.full((len(v), 2), -1)
    if v.shape[1] < 5:  # too short for two peaks and a valley
        return found, places
    amount = (v - v.mean(1, keepdims=True)) @ analysis
    slack = 1e-11 * np.abs(v).max(1)
    open_ = np.arange(len(v))
    for lo in range(0, top + 1, 8):
        sigmas = np.arange(lo, min(lo + 8, top + 1))
        d = np.empty((len(open_), len(sigmas), v.shape[1] - 1))
        smooth = sigmas > 0
        if not smooth[0]:
            d[:, 0] = np.diff(v[open_])
        d[:, smooth] = (amount[open_, None, :] * scale[None, sigmas[smooth] - 1]) @ steps
        bound = np.where(smooth[None, :], slack[open_, None], 0.0)[:, :, None]
        up = d > bound
        unsure = ~(up | (d < -bound)).all(2)
        turns = up[:, :, 1:] != up[:, :, :-1]
        good = ~unsure & up[:, :, 0] & (turns.sum(2) == 3)
        for i in np.flatnonzero((good | unsure).any(1)):
            for j in np.flatnonzero(good[i] | unsure[i]):
                row = open_[i]
                p = np.flatnonzero(turns[i, j])[[0, 2]] + 1 if good[i, j] else _has_two_peaks(_mirror_smooth(v[row], int(sigmas[j])))
                if p is not None:
                    found[row], places[row] = sigmas[j], p
                    break
        open_ = open_[found[open_] < 0]
        if not len(open_):
            break
    return found, places


def two_peaks_one_valley(df: DataFrame, keys: Sequence[str], order: str, value: str, top: int = 100) -> DataFrame:
    """Smallest whole sigma whose smoothed profile has two peaks and one valley,
    with the peak positions; null where none up to ``top`` does."""
    d = df.filter(F.col(value).isNotNull()).select(*keys, order, F.col(value).cast("double").alias(value))
    kept = {}

    def work(values, starts):
        v, at = values[value], values[order]
        size = np.diff(np.r_[starts, len(v)])
        sigma, lower, upper = (np.full(len(starts), np.nan) for _ in range(3))
        for n in np.unique(size):
            if n < 5:
                continue
            if n not in kept:
                if len(kept) >= 256:
                    kept.clear()
                kept[n] = _mirror_waves(int(n), np.arange(1, top + 1))
            of = np.flatnonzero(size == n)
            lot = max(1, (1 << 20) // (8 * n))
            for lo in range(0, len(of), lot):
                some = of[lo: lo + lot]
                found, places = _least_sigma(v[starts[some, None] + np.arange(n)], top, kept[n])
                hit = found >= 0
                sigma[some[hit]] = found[hit]
                lower[some[hit]], upper[some[hit]] = (at[starts[some[hit]] + places[hit, c]] for c in (0, 1))
        return starts, {"sigma": sigma, "lower": lower, "upper": upper}

    return batches.map_profiles(d, keys, [order], [order, value], work, [("sigma", "int"), ("lower", "int"), ("upper", "int")])


def pit_width(df: DataFrame, keys: Sequence[str], order: str, value: str, reach: int = 60) -> DataFrame:
    """Width of the central pit at 20 % of its depth, in degrees.

    Smooth until a peak stands in each outer third, level the profile between
    the mean peaks, smooth again and take the outermost crossings.
    """
    d = df.filter((F.abs(F.col(order)) <= reach)).select(*keys, order, F.col(value).cast("double").alias(value))

    def measure(x: np.ndarray, y: np.ndarray) -> float:
        at = np.arange(-reach, reach + 1)
        x, y = x[~np.isnan(y)], y[~np.isnan(y)]
        if len(x) < 3:
            return np.nan
        v = np.interp(at, x, y, left=np.nan, right=np.nan)
        left, right, sigma, n = [], [], 3, len(at)
        while not (len(left) and len(right)) and sigma < 10:
            p = _maxima(_mirror_smooth(v, sigma))
            left, right = p[p < n / 3], p[p > 2 * n / 3]
            sigma += 1
        if not (len(left) and len(right)):
            return np.nan
        a, z = round(float(np.mean(left))), round(float(np.mean(right)))
        level = v - (v[z] - v[a]) / (z - a) * (np.arange(n) - a)
        s = _mirror_smooth(level, 2)
        low = np.nanmin(s[a:z]) if z > a and not np.isnan(s[a:z]).all() else np.nan
        cross = np.flatnonzero(np.diff(np.sign(s - (low + (s[a] - low) / 5))))
        if np.isnan(low) or not len(cross):
            return np.nan
        return (at[cross[-1] + 1] - at[cross[0]]) / 10.0

    def work(values, starts):
        ends = np.r_[starts[1:], len(values[value])]
        return starts, {"width": np.array([measure(values[order][a:z], values[value][a:z]) for a, z in zip(starts, ends)], dtype=float)}

    return batches.map_profiles(d, keys, [order], [order, value], work, [("width", "double")])
