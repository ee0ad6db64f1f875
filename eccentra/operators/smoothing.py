"""Linear smoothers on positions 0..n-1 of a profile or a surface line.

Each sample scatters its weighted value to the positions it reaches and the
positions sum up. The rows are already partitioned by profile, so the sum needs
no further shuffle, and the work per sample is the kernel width.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from eccentra.operators import batches, ordered
from eccentra.session import cut

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def indexed(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Position ``_i`` from 0 and length ``_n`` of each profile."""
    w = W.partitionBy(*keys)
    return (df.withColumn("_i", F.row_number().over(w.orderBy(order)) - 1)
            .withColumn("_n", F.count("*").over(w).cast("int")))


def _scatter_gauss(df: DataFrame, keys: Sequence[str], cols: Sequence[str], sigma: float) -> DataFrame:
    """Weighted sums of ``cols`` over the mirrored neighbourhood of each position."""
    r = int(4 * sigma + 0.5)
    n, i, q = F.col("_n"), F.col("_i"), F.col("_q")
    turns = F.ceil((F.lit(r) + 1) / (2 * n)).cast("int")
    # places of the sample in the mirrored continuation of the profile
    mirror = F.transform(F.sequence(-turns, turns), lambda m: F.array(i + 2 * n * m, -1 - i + 2 * n * m))
    seen = F.filter(F.flatten(mirror), lambda p: (p >= -r) & (p <= n - 1 + r))
    near = (i < r) | (i >= n - r)
    t = df.select(*keys, *cols, "_n", F.explode(F.when(near, seen).otherwise(F.array(i))).alias("_q"))
    t = t.select(*keys, *cols, "_q", F.explode(F.sequence(F.greatest(F.lit(0), q - r), F.least(n - 1, q + r))).alias("_j"))
    d = q - F.col("_j")
    w = F.exp(d * d * (-0.5 / (sigma * sigma)))
    return t.groupBy(*keys, F.col("_j").alias("_i")).agg(
        F.sum(w).alias("_w"), *[F.sum(w * F.col(c)).alias(c) for c in cols])


def gaussian(df: DataFrame, keys: Sequence[str], order: str, value: str, sigma: float) -> DataFrame:
    """Gaussian filter with mirrored ends that ignores nulls; radius 4 sigma."""
    if sigma <= 0:
        return df.select(*keys, order, value)
    t = indexed(df.select(*keys, order, value), keys, order)
    ok = F.col(value).isNotNull()
    s = t.withColumn("_v", F.coalesce(F.col(value), F.lit(0.0))).withColumn("_ok", F.when(ok, 1.0).otherwise(0.0))
    g = _scatter_gauss(s, keys, ["_v", "_ok"], sigma).select(
        *keys, "_i", F.when(F.col("_ok") > 0, F.col("_v") / F.col("_ok")).alias(value))
    return t.drop(value).join(g, [*keys, "_i"]).select(*keys, order, value)


def gaussian_surface(df: DataFrame, keys: Sequence[str], row: str, col: str, value: str, sigma: float) -> DataFrame:
    """The same filter on a surface, along rows and then along columns."""
    keys = list(keys)
    ok = F.col(value).isNotNull()
    t = df.select(*keys, row, col, F.coalesce(F.col(value), F.lit(0.0)).alias("_v"), F.when(ok, 1.0).otherwise(0.0).alias("_ok"))
    for fixed, along in ((row, col), (col, row)):
        at = indexed(t, keys + [fixed], along)
        g = _scatter_gauss(at, keys + [fixed], ["_v", "_ok"], sigma)
        g = g.withColumn("_v", F.col("_v") / F.col("_w")).withColumn("_ok", F.col("_ok") / F.col("_w")).drop("_w")
        t = at.select(*keys, fixed, along, "_i").join(g, keys + [fixed, "_i"]).drop("_i")
    return t.select(*keys, row, col, F.when(F.col("_ok") > 0, F.col("_v") / F.col("_ok")).alias(value))


def moving_average(df: DataFrame, keys: Sequence[str], order: str, value: str, width: int) -> DataFrame:
    """Mean of ``width`` (odd) neighbours, ends repeated."""
    h = width // 2
    t = indexed(df, keys, order)
    p = W.partitionBy(*keys).orderBy(order)
    inside = F.sum(value).over(p.rowsBetween(-h, h))
    full = p.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = F.greatest(F.lit(0), F.lit(h) - F.col("_i"))
    after = F.greatest(F.lit(0), F.col("_i") + h - (F.col("_n") - 1))
    out = (inside + before * F.first(value).over(full) + after * F.last(value).over(full)) / float(width)
    return t.select(*keys, order, out.alias(value))


def savgol_weights(width: int, degree: int = 2) -> np.ndarray:
    """Row p: weights of a window that give the fitted polynomial at place p."""
    x = np.arange(width) - width // 2
    v = np.vander(x, degree + 1, increasing=True).astype(float)
    return v @ np.linalg.pinv(v)


def savgol(df: DataFrame, keys: Sequence[str], order: str, value: str, width: int, degree: int = 2) -> DataFrame:
    """Savitzky-Golay filter; at the ends the polynomial of the outermost
    window is read off. Profiles shorter than the window stay as they are, with
    ``smoothed`` false."""
    m, h = savgol_weights(width, degree), width // 2
    t = indexed(df.select(*keys, order, value), keys, order)
    n, i = F.col("_n"), F.col("_i")
    table = F.array(*[F.array(*[F.lit(float(c)) for c in row]) for row in m])

    def hit(j):
        start = F.greatest(F.lit(0), F.least(j - h, n - width))
        return F.struct(j.alias("j"), table[j - start][i - start].alias("w"))

    lo = F.when(i < width, F.lit(0)).otherwise(i - h)
    hi = F.when(i >= n - width, n - 1).otherwise(i + h)
    targets = F.filter(F.sequence(lo, hi), lambda j: (i >= F.greatest(F.lit(0), F.least(j - h, n - width)))
                       & (i < F.greatest(F.lit(0), F.least(j - h, n - width)) + width))
    s = t.filter(n >= width).select(*keys, value, F.explode(F.transform(targets, hit)).alias("_h"))
    g = s.groupBy(*keys, F.col("_h.j").alias("_i")).agg(F.sum(F.col("_h.w") * F.col(value)).alias("_s"))
    return t.join(g, [*keys, "_i"], "left").select(*keys, order, F.coalesce("_s", value).alias(value), (n >= width).alias("smoothed"))


def _windows(x: np.ndarray, at: np.ndarray, k: int, first: np.ndarray | int = 0, last: np.ndarray | int | None = None) -> np.ndarray:
    """First place of the ``k`` values of the sorted ``x`` nearest to each value of ``at``, within the places ``first`` to ``last`` (left out)."""
    lo, hi = np.zeros(len(at), dtype=np.int64) + first, np.full(len(at), (len(x) if last is None else last) - k, dtype=np.int64)
    while (lo < hi).any():
        mid = (lo + hi) // 2
        ahead = at - x[mid] > x[np.minimum(mid + k, len(x) - 1)] - at
        lo, hi = np.where((lo < hi) & ahead, mid + 1, lo), np.where((lo < hi) & ~ahead, mid, hi)
    return lo


def _local_lines(x: np.ndarray, y: np.ndarray, robust: np.ndarray, at: np.ndarray, k: int, spread: np.ndarray | float, cells: int = 1 << 20,
                 first: np.ndarray | int = 0, last: np.ndarray | int | None = None) -> np.ndarray:
    """Local lines at ``at`` over the ``k`` nearest of the sorted ``x``, NaN where no weight is left; a bounded number of ``cells`` at a time.

    Profiles may lie end to end: ``first`` and ``last`` then bound the own one of each value of ``at``.
    """
    start, out = _windows(x, at, k, first, last), np.empty(len(at))
    level = 0.001 * np.broadcast_to(spread, len(at))
    rows = max(1, cells // k)
    for a in range(0, len(at), rows):
        near = start[a: a + rows, None] + np.arange(k)
        u = x[near] - at[a: a + rows, None]
        reach = np.maximum(np.maximum(np.abs(u[:, 0]), np.abs(u[:, -1])), 1e-12)[:, None]
        near_by = 1 - (np.minimum(np.abs(u) / reach, 1)) ** 3
        w = near_by * near_by * near_by * robust[near]
        total = w.sum(1)
        w /= np.where(total > 0, total, 1)[:, None]
        v = y[near]
        mx, my = (w * u).sum(1), (w * v).sum(1)
        u -= mx[:, None]
        w *= u
        sx, sxy = (w * u).sum(1), (w * v).sum(1)
        slope = np.where(np.sqrt(sx) > level[a: a + rows], sxy / np.where(sx > 0, sx, 1), 0)
        out[a: a + rows] = np.where(total > 0, my - slope * mx, np.nan)
    return out


def _bisquare(r: np.ndarray, scale: float) -> np.ndarray:
    return (1 - np.minimum(r / scale, 1) ** 2) ** 2


def _lowess_arrays(x: np.ndarray, y: np.ndarray, starts: np.ndarray, share: float, rounds: int) -> np.ndarray:
    """Robust local lines of profiles laid end to end, each ordered by x, over the nearest ``share`` of its known values; read off at every x."""
    own, count, out = batches.owners(starts, len(x)), len(starts), y.astype(float)
    known = ~np.isnan(y)
    kx, ky, of = x[known], y[known].astype(float), own[known]
    n = np.bincount(of, minlength=count)
    last = np.cumsum(n)
    first = last - n
    k = np.where(n >= 3, (share * n + 1e-10).astype(np.int64), 0)
    ends = np.where(n > 0, n, 1) - 1
    spread, top = np.zeros(count), np.zeros(count)
    some = n > 0
    if some.any():
        spread[some] = kx[(first + ends)[some]] - kx[first[some]]
        top[some] = np.maximum.reduceat(np.abs(ky), first[some])
    widths = [w for w in np.unique(k) if w >= 2]

    def fit(at: np.ndarray, owner: np.ndarray, robust: np.ndarray) -> np.ndarray:
        found = np.full(len(at), np.nan)
        for w in widths:
            rows = np.flatnonzero(k[owner] == w)
            o = owner[rows]
            found[rows] = _local_lines(kx, ky, robust, at[rows], int(w), spread[o], 1 << 17, first[o], last[o])
        return found

    robust = np.ones(len(kx))
    for _ in range(rounds):
        f = fit(kx, of, robust)
        r = np.abs(ky - np.where(np.isnan(f), ky, f))
        scale = 6 * batches.medians(r, of, count)
        moved = (scale > 1e-12 * top)[of]  # the others fit exactly: only rounding is left, and weights stay
        robust[moved] = _bisquare(r[moved], scale[of][moved])
    f = fit(x, own, robust)
    return np.where(np.isnan(f), out, f)


def _lowess_array(x: np.ndarray, y: np.ndarray, share: float, rounds: int) -> np.ndarray:
    """The same for one profile."""
    return _lowess_arrays(x, y, np.zeros(1, dtype=np.int64), share, rounds)


def lowess(df: DataFrame, keys: Sequence[str], x: str, y: str | Sequence[str], share: float = 0.1, rounds: int = 3, everywhere: bool = False) -> DataFrame:
    """Robust local linear smoothing of gridded profiles; ``everywhere`` also where the value is null.

    A profile has at most a few hundred positions; many of them are array work at
    once inside the task that holds them. Several columns ``y`` over the same positions
    are smoothed each by its own known values, then ``everywhere``. For readings without that bound see ``lowess_blocks``.
    """
    ys = [y] if isinstance(y, str) else list(y)
    if len(ys) > 1 and not everywhere:
        raise ValueError("several columns are smoothed everywhere")
    d = df if everywhere else df.filter(F.col(ys[0]).isNotNull())
    d = d.select(*keys, *[F.col(c).cast("double").alias(c) for c in (x, *ys)])

    def work(values, starts):
        at, own = values[x], batches.owners(starts, len(values[x]))
        found = {x: at}
        for c in ys:
            order = np.lexsort((values[c], at, own))  # values at one place in their order
            found[c] = np.empty(len(at))
            found[c][order] = _lowess_arrays(at[order], values[c][order], starts, share, rounds)
        return np.arange(len(at)), found

    return batches.map_profiles(d, keys, [x], [x, *ys], work, [(c, "double") for c in (x, *ys)])


def _lowess_readings(d: DataFrame, keys: Sequence[str], x: str, y: str, share: float, rounds: int) -> DataFrame:
    """``lowess_blocks`` of groups that one task can hold."""
    def work(values, starts):
        at, v = values["_x"], values["_y"]
        fit = _lowess_arrays(at, v, starts, share, rounds)
        new = np.r_[True, (at[1:] != at[:-1]) | (v[1:] != v[:-1])]
        new[starts] = True
        first = np.flatnonzero(new)
        return first, {x: at[first], y: fit[first]}

    return batches.map_profiles(d, keys, ["_x", "_y"], ["_x", "_y"], work, [(x, "double"), (y, "double")])


def lowess_blocks(df: DataFrame, keys: Sequence[str], x: str, y: str, share: float = 0.1, rounds: int = 3, least: int = 4096) -> DataFrame:
    """``lowess`` of irregular readings in groups of any size: (keys, x, y), a row per distinct reading, repeated ones counted.

    Readings are numbered along x and cut into blocks of about the width of a
    neighbourhood, k = share * n readings. A block is sent the k readings beside it
    on either side, so a reading is in three or four blocks and a block is about three
    neighbourhoods. Between rounds the median of the residuals is taken over
    the whole group, by sorting in parallel. Groups too small for a line keep their values. Groups
    of up to ``least`` readings need no blocks: each is smoothed whole, many in a task.
    """
    keys = list(keys)
    one = F.lit(1).cast("long")
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    large = cut(d.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > least).select(*keys))
    if large.isEmpty():
        return _lowess_readings(d, keys, x, y, share, rounds)
    small = _lowess_readings(d.join(large, keys, "left_anti"), keys, x, y, share, rounds)
    d = d.join(large, keys, "left_semi")
    at = ordered.running_sums(d, keys, ["_x", "_y"], {"_m": one})
    size = d.groupBy(*keys).agg((F.max("_x") - F.min("_x")).alias("_spread"), F.max(F.abs("_y")).alias("_top"))
    k = F.floor(F.lit(share) * F.col("_m_total") + 1e-10).cast("long")
    base = at.select(*keys, "_x", "_y", "_m", F.col("_m_before").alias("_i"), F.col("_m_total").alias("_n"), k.alias("_k")).join(size, keys)
    rest = base.filter("_k < 2 OR _n < 3")
    points = cut(base.filter("_k >= 2 AND _n >= 3").withColumns({"_r": F.lit(1.0), "_wide": F.greatest("_k", F.lit(least))}))
    fields = ["_x", "_y", "_m", "_i", "_n", "_k", "_spread", "_r"]

    def fitted(t: DataFrame) -> DataFrame:
        """Fit at every reading, NaN for none."""
        own = F.floor(F.col("_i") / F.col("_wide"))
        # the blocks a reading is in or beside
        blocks = F.sequence(F.greatest(F.floor((F.col("_i") - F.col("_k")) / F.col("_wide")), F.lit(0)), F.floor((F.col("_i") + F.col("_m") + F.col("_k")) / F.col("_wide")))
        laid = t.select(*keys, *fields, own.alias("_own"), F.explode(blocks).alias("_block"))
        schema = T.StructType([t.schema[c] for c in keys] + [t.schema[c] for c in ("_x", "_y")] + [T.StructField("_fit", T.DoubleType())])

        def fit(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("_i", kind="stable")
            mine = pdf[(pdf["_own"] == pdf["_block"])]
            if not len(mine):
                return mine.assign(_fit=0.0)[[f.name for f in schema]]
            m = pdf["_m"].to_numpy()
            px, py, pr = (np.repeat(pdf[c].to_numpy(), m) for c in ("_x", "_y", "_r"))
            out = _local_lines(px, py, pr, mine["_x"].to_numpy(), int(pdf["_k"].iloc[0]), float(pdf["_spread"].iloc[0]))
            return mine.assign(_fit=out)[[f.name for f in schema]]

        return laid.groupBy(*keys, "_block").applyInPandas(fit, schema)

    for turn in range(rounds):
        fits = cut(fitted(points)).join(points, keys + ["_x", "_y"])
        res = cut(fits.withColumn("_res", F.abs(F.col("_y") - F.nanvl("_fit", "_y"))))
        mid = ordered.quantiles_weighted(res, keys, "_res", F.col("_m"), {"_median": 0.5})
        scale = 6 * F.col("_median")
        held = scale <= 1e-12 * F.col("_top")  # an exact fit: only rounding is left, and weights stay
        u = F.least(F.col("_res") / F.nullif(scale, F.lit(0.0)), F.lit(1.0))
        points = cut(res.join(mid, keys).withColumn("_r", F.when(held, F.col("_r")).otherwise(F.pow(1 - u * u, 2))).select(*points.columns))
    out = fitted(points).select(*keys, F.col("_x").alias(x), F.nanvl("_fit", "_y").alias(y))
    return out.unionByName(rest.select(*keys, F.col("_x").alias(x), F.col("_y").alias(y))).unionByName(small)


def to_grid_varying_gap(df: DataFrame, keys: Sequence[str], x: str, y: str, limit: int = 100) -> DataFrame:
    """Linear reading of a smoothed profile on the 0.1 degree grid.

    Gaps wider than 1 - 0.85/(1 + x*x/10) stay open; the last point is extended
    by one step along the last segment. Readings at one place are averaged.
    """
    w = W.partitionBy(*keys).orderBy("_x")
    t = (df.groupBy(*keys, F.col(x).alias("_x")).agg(F.avg(y).alias("_y"))
         .withColumn("_nx", F.lead("_x").over(w)).withColumn("_ny", F.lead("_y").over(w))
         .withColumn("_px", F.lag("_x").over(w)).withColumn("_py", F.lag("_y").over(w)))
    X, NX = F.col("_x"), F.col("_nx")
    wide = NX - X > 1 - 0.85 / (1 + X * X / 10)
    first = F.ceil(X * 10).cast("int")
    here = F.when(first / 10.0 == X, first).otherwise(first - 1)
    last = F.when(NX.isNull(), F.floor(X * 10).cast("int") + 1).when(wide, here).otherwise(F.ceil(NX * 10).cast("int") - 1)
    slope = F.when(NX.isNotNull(), (F.col("_ny") - F.col("_y")) / (NX - X)).otherwise(
        (F.col("_y") - F.col("_py")) / (X - F.col("_px")))
    s = t.withColumn("_slope", slope).withColumn("_first", F.greatest(first, F.lit(-limit))).withColumn(
        "_last", F.least(last, F.lit(limit))).filter("_first <= _last").withColumn("e10", F.explode(F.sequence("_first", "_last")))
    return s.select(*keys, "e10", (F.col("_y") + F.coalesce("_slope", F.lit(0.0)) * (F.col("e10") / 10.0 - X)).alias(y))
