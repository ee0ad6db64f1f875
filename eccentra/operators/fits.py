"""Profile fits as searches over a few shape values.

With the shape fixed, the models are linear, so no general solver is needed.
Parameters agree with a solver's to the resolution of the search.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence
from typing import Any, Tuple

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from eccentra.constants import MM_PER_DEGREE
from eccentra.operators import batches, ordered
from eccentra.session import cut

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _weighted_line(t: DataFrame, w, x: Column, y: Column) -> DataFrame:
    """Intercept ``_p0`` and slope ``_p1`` by weights ``_w`` over a window."""
    W0, X, Y = F.col("_w"), x, y
    t = (t.withColumn("_s", F.sum(W0).over(w)).withColumn("_sx", F.sum(W0 * X).over(w)).withColumn("_sy", F.sum(W0 * Y).over(w))
         .withColumn("_sxx", F.sum(W0 * X * X).over(w)).withColumn("_sxy", F.sum(W0 * X * Y).over(w)))
    det = F.col("_s") * F.col("_sxx") - F.col("_sx") * F.col("_sx")
    slope = F.when(F.abs(det) > 1e-12 * F.col("_s") * F.col("_sxx"), (F.col("_s") * F.col("_sxy") - F.col("_sx") * F.col("_sy")) / F.nullif(det, F.lit(0.0))).otherwise(0.0)
    t = t.withColumn("_p1", slope)
    return t.withColumn("_p0", (F.col("_sy") - F.col("_p1") * F.col("_sx")) / F.col("_s"))


def line_l1(df: DataFrame, keys: Sequence[str], x: str, y: str, scale: float = 5.0, rounds: int = 10) -> DataFrame:
    """Robust line (soft L1) of a profile by re-weighting; one shuffle, all
    rounds are windows over the same partitioning."""
    w = W.partitionBy(*keys)
    X, Y = F.col("_x"), F.col("_y")
    t = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).alias("_y")).withColumn("_w", F.lit(1.0))
    for _ in range(rounds):
        t = _weighted_line(t, w, X, Y)
        r = (Y - F.col("_p0") - F.col("_p1") * X) / scale
        t = t.withColumn("_w", 1 / F.sqrt(1 + r * r))
    t = _weighted_line(t, w, X, Y)
    return t.groupBy(*keys).agg(F.first("_p0").alias("intercept"), F.first("_p1").alias("slope"), F.count("*").alias("n"))


def exponential(df: DataFrame, keys: Sequence[str], x: str, y: str, scale: float = 3000.0, rounds: int = 3,
                rates: Sequence[float] | None = None) -> DataFrame:
    """y = p0 + p1*exp(-p2*x) with non-negative values under soft L1.

    For one rate the model is a line in exp(-p2*x). A profile has at most 200
    points and meets all rates of a grid at once, as an array in the task that holds it; of
    rates that are equally good to a thousandth the least is taken. A profile
    without known points has nulls.
    """
    keys = list(keys)
    grid = np.array(rates if rates is not None else [0.02 * 1.06 ** k for k in range(90)], dtype=float)
    d = df.select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    names = ["p0", "p1", "p2", "loss"]
    schema = T.StructType([d.schema[k] for k in keys] + [T.StructField(n, T.DoubleType()) for n in names])

    def bounded(u, v, w):
        s, su, sv, suu, suv = w.sum(1), (w * u).sum(1), (w * v).sum(1), (w * u * u).sum(1), (w * u * v).sum(1)
        det = s * suu - su * su
        p1 = np.where(np.abs(det) > 1e-12 * s * suu, (s * suv - su * sv) / np.where(det != 0, det, 1), 0)
        p0 = (sv - p1 * su) / s
        alone = np.maximum(0, suv / np.where(suu != 0, suu, 1))
        return np.where(p1 < 0, np.maximum(0, sv / s), np.where(p0 < 0, 0, p0)), np.where(p1 < 0, 0, np.where(p0 < 0, alone, p1))

    def fit(key: Tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=["_x", "_y"])
        if not len(pdf):
            return pd.DataFrame([[*key, None, None, None, None]], columns=[f.name for f in schema])
        u, v = np.exp(-grid[:, None] * pdf["_x"].to_numpy()[None, :]), pdf["_y"].to_numpy()[None, :]
        w = np.ones_like(u)
        for turn in range(rounds + 1):
            q0, q1 = bounded(u, v, w)
            r = (v - q0[:, None] - q1[:, None] * u) / scale
            w = 1 / np.sqrt(1 + r * r)
        loss = (2 * scale * scale * (np.sqrt(1 + r * r) - 1)).sum(1)
        best = min(range(len(grid)), key=lambda i: (math.floor(loss[i] * 1024 + 0.5), grid[i]))
        return pd.DataFrame([[*key, q0[best], q1[best], grid[best], loss[best]]], columns=[f.name for f in schema])

    return d.groupBy(*keys).applyInPandas(fit, schema)


# --- two-sided model of the log density ---------------------------------------------------------------
# log d = P - b*X + d*(1/(X + e) - 1/e) on each side of the centre, X in mm; P is shared.

LEAST, MOST = np.array([0, 0.5, 0, 0.5]), np.array([0.5, 1.0, 0.5, 1.0])


def _normal_solve(m: np.ndarray, v: np.ndarray, free: np.ndarray) -> np.ndarray:
    """``_solved`` with the systems in front."""
    return _solved(np.moveaxis(m, 0, 2), v.T, free.T).T


def _solved(m: np.ndarray, v: np.ndarray, free: np.ndarray) -> np.ndarray:
    """Solutions (unknown, system) of many small symmetric systems in their ``free`` unknowns, the others 0;
    systems that are nearly singular have the shortest solution."""
    n = len(v)
    low = np.where(free[:, None] & free[None], m, 0.0)
    low[range(n), range(n)] += ~free
    b = np.where(free, v, 0.0)
    whole, weak = np.abs(low[range(n), range(n)]), np.zeros(v.shape[1], bool)
    for i in range(n):  # elimination without exchange of rows: the diagonal is positive unless nearly singular
        weak |= ~(low[i, i] > 1e-11 * whole[i])
        pivot = np.where(low[i, i] != 0, low[i, i], 1)
        for k in range(i + 1, n):
            f = low[k, i] / pivot
            low[k, i:] -= f * low[i, i:]
            b[k] -= f * b[i]
    out = np.zeros_like(b)
    for i in range(n - 1, -1, -1):
        pivot = np.where(low[i, i] != 0, low[i, i], 1)
        out[i] = (b[i] - (low[i, i + 1:] * out[i + 1:]).sum(0)) / pivot
    for j in np.flatnonzero(weak):
        f = free[:, j]
        out[:, j] = 0
        out[f, j] = np.linalg.lstsq(m[:, :, j][np.ix_(f, f)], v[f, j], rcond=None)[0]
    return out


def _clamped(m: np.ndarray, v: np.ndarray, p: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
    """Solves into ``p``, in which unknowns outside their bounds are clamped and the rest fitted again."""
    free, live = np.ones(v.shape, bool), np.arange(v.shape[1])
    for _ in range(5):
        f, q, a = free[:, live], p[:, live], m[:, :, live]
        held = np.where(f, 0.0, q)
        rest = v[:, live] - (a * held).sum(1) if held.any() else v[:, live]
        q = np.where(f, _solved(a, rest, f), q)
        out = f & ((q < lo[:, live]) | (q > hi[:, live]))
        p[:, live] = np.clip(q, lo[:, live], hi[:, live])
        free[:, live] = f & ~out
        live = live[out.any(0) & (f & ~out).any(0)]
        if not len(live):
            break


def _bilateral(x: np.ndarray, y: np.ndarray, n: np.ndarray, centre: np.ndarray, el: np.ndarray, er: np.ndarray, peak: np.ndarray, rounds: int = 6):
    """Loss (infinite where the shape is not allowed) by profile, centre and shapes of both sides, and P, b_l, d_l, b_r, d_r before them.

    Profiles are the rows of ``x``, ``y`` and the weights ``n``, which end in zero weights, and of the centres and shapes that are tried. What
    depends on a centre alone, or on one side's shape, is held once: sums over a round's weights are products of matrices. The loss is an
    asymmetric weighted soft L1: central readings may lie too low, outer ones too high, so those directions are not punished.
    """
    c = 0.3
    count, tried, A, B, L = len(x), centre.shape[1], el.shape[1], er.shape[1], x.shape[1]
    q = count * tried
    of, po = np.repeat(np.arange(count), tried), centre.reshape(-1, 1)
    px, Y, N = x[of], y[of], n[of]
    dist, left = np.abs(px - po), px < po
    outer, base = 1 / (1 + np.exp(-5 * (dist - 1))), N * (1 - np.exp(-5 * dist))
    hl, hr, one = np.where(left, dist, 0), np.where(left, 0, dist), np.ones_like(dist)

    def side(e, own):
        e = e[of][:, :, None]
        return np.where(own[:, None], 1 / (dist[:, None] + e) - 1 / e, 0)
    gl, gr = side(el, left), side(er, ~left)
    shared = np.stack([one, Y, hl, hl * hl, hl * Y, hr, hr * hr, hr * Y], axis=2)
    plain = np.stack([Y, one, hl, hr], axis=1)
    sides = [np.stack([g, g * h[:, None], g * g, g * Y[:, None]], axis=3) for g, h in ((gl, hl), (gr, hr))]
    many = (q, A, B)
    lo, hi = (np.empty((5, *many)) for _ in range(2))
    for to, limits, i in ((lo, LEAST, 0), (hi, MOST, 1)):
        to[0] = peak[of, i][:, None, None]
        to[1:] = np.asarray(limits)[:, None, None, None]
    p = np.empty((5, *many))
    p[0], p[1:] = (0.5 * peak[of].sum(1))[:, None, None], np.array([0.17, 0.86, 0.17, 0.86])[:, None, None, None]
    m, v = np.zeros((5, 5, *many)), np.empty((5, *many))
    r, t, w, far = np.empty((*many, L)), np.empty((*many, L)), np.empty((*many, L)), np.empty((*many, L), bool)
    w[:] = base[:, None, None]
    low, high = (base * np.maximum(o, 1e-6) for o in (outer, 1 - outer))
    for k in range(rounds):
        s = np.moveaxis((w.reshape(q, A * B, L) @ shared).reshape(*many, 8), 3, 0)
        m[0, 0], v[0] = s[0], s[1]
        for i, at, g in ((1, 2, np.moveaxis(w @ sides[0], 3, 0)), (3, 5, np.moveaxis(w.transpose(0, 2, 1, 3) @ sides[1], 3, 0).swapaxes(2, 3))):
            m[0, i] = m[i, 0] = -s[at]
            m[0, i + 1] = m[i + 1, 0] = g[0]
            m[i, i], m[i + 1, i + 1] = s[at + 1], g[2]
            m[i, i + 1] = m[i + 1, i] = -g[1]
            v[i], v[i + 1] = -s[at + 2], g[3]
        _clamped(m.reshape(5, 5, -1), v.reshape(5, -1), p.reshape(5, -1), lo.reshape(5, -1), hi.reshape(5, -1))
        terms = np.stack([np.ones(many), -p[0], p[1], p[3]], axis=3).reshape(q, A * B, 4)
        np.matmul(terms, plain, out=r.reshape(q, A * B, L))  # what the curve leaves
        r -= np.multiply(gl[:, :, None], p[2][..., None], out=t)
        r -= np.multiply(gr[:, None], p[4][..., None], out=t)
        if k == rounds - 1:
            break
        w[:] = base[:, None, None]
        np.copyto(w, high[:, None, None], where=np.greater_equal(r, c, out=far))
        np.copyto(w, low[:, None, None], where=np.less_equal(r, -c, out=far))
        np.multiply(r, 1 / c, out=t)
        t *= t
        t += 1
        w /= np.sqrt(t, out=t)

    def model(z):
        d, s = np.abs(z - po), z < po
        gs = [1 / (d[:, None] + e[of][:, :, None]) - 1 / e[of][:, :, None] for e in (el, er)]
        s = s[:, None, None]
        return p[0][..., None] - np.where(s, p[1][..., None], p[3][..., None]) * d[:, None, None] + np.where(s, p[2][..., None] * gs[0][:, :, None], p[4][..., None] * gs[1][:, None])
    steps = np.linspace(-MM_PER_DEGREE, MM_PER_DEGREE, 21)
    rise = np.abs(model(steps + 1e-4) - model(steps)) / 1e-4
    allowed = (model(np.array([3.0, -3.0])).min(3) >= math.log(7200)) & (rise.max(3) <= 10)
    np.multiply(r, 1 / c, out=t)
    soft = 2 * c * (np.sqrt(1 + t * t) - 1)
    soft *= base[:, None, None]
    lost = (outer[:, None, None] * np.where(r < c, soft, 0) + (1 - outer)[:, None, None] * np.where(r > -c, soft, 0)).sum(3)
    loss = np.where(allowed, lost / N.sum(1)[:, None, None], np.inf)
    return loss.reshape(count, tried, A, B), p.reshape(5, count, tried, A, B)


def _best_shapes(x: np.ndarray, y: np.ndarray, n: np.ndarray, peak: np.ndarray, centre: np.ndarray, el: np.ndarray, er: np.ndarray, cells: int = 1 << 18) -> np.ndarray:
    """(loss, centre, e_l, e_r, P, b_l, d_l, b_r, d_r) of the first best of every profile's tries; the loss is infinite for none."""
    out = np.full((len(x), 9), np.inf)
    step = max(1, cells // max(1, centre.shape[1] * el.shape[1] * er.shape[1] * x.shape[1]))
    for at in range(0, len(x), step):
        lot = slice(at, at + step)
        loss, p = _bilateral(x[lot], y[lot], n[lot], centre[lot], el[lot], er[lot], peak[lot])
        row, best = np.arange(len(loss)), loss.reshape(len(loss), -1).argmin(1)
        c, a, b = np.unravel_index(best, loss.shape[1:])
        out[lot] = np.c_[loss[row, c, a, b], centre[lot][row, c], el[lot][row, a], er[lot][row, b], p[:, row, c, a, b].T]
    return out


def _shapes_about(ee: np.ndarray) -> list[float]:
    """Shapes to try on both sides about the best ones, two to six."""
    return sorted({round(v, 3) for e in ee.tolist() for v in (e - 0.06, e, e + 0.06) if 0.1 <= v <= 0.6})


BILATERAL_FIELDS = ["loss", "centre", "e_left", "e_right", "log_peak", "b_left", "d_left", "b_right", "d_right"]


def _fit_profiles(values: dict, starts: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``BILATERAL_FIELDS`` by profile and the reason of those without a fit; ``wanted`` peaks hold, NaN is none."""
    size = np.diff(np.r_[starts, len(values["_x"])])
    peak = np.tile([math.log(145_000), math.log(350_000)], (len(starts), 1))
    held = ~np.isnan(wanted)
    peak[held, 0] = np.maximum(peak[held, 0], np.log(np.maximum(wanted[held] - 5000, 1)))
    peak[held, 1] = np.minimum(peak[held, 1], np.log(wanted[held] + 5000))
    reason = np.where(size < 6, "too few points", np.where(peak[:, 0] > peak[:, 1], "no room for the peak", "no allowed shape")).astype(object)
    found = np.full((len(starts), 9), np.nan)
    todo = np.flatnonzero((size >= 6) & (peak[:, 0] <= peak[:, 1]))
    for some in np.array_split(todo[np.argsort(size[todo], kind="stable")], max(1, len(todo) // 64)):
        if not len(some):
            continue
        at = np.minimum(np.arange(size[some].max()), size[some, None] - 1)
        inside = np.arange(at.shape[1]) < size[some, None]
        at = starts[some, None] + at
        x, y, n = values["_x"][at] * MM_PER_DEGREE, np.log(values["_y"][at]), np.where(inside, values["_n"][at], 0.0)
        e = np.tile([0.1, 0.25, 0.4, 0.6], (len(some), 1))
        best = _best_shapes(x, y, n, peak[some], np.tile(np.linspace(-0.1, 0.1, 5), (len(some), 1)), e, e)
        fit = np.flatnonzero(np.isfinite(best[:, 0]))
        near = [_shapes_about(ee) for ee in best[fit, 2:4]]
        tries = np.array([len(t) for t in near], np.int64)
        for k in np.unique(tries):
            mine = np.flatnonzero(tries == k)
            e, mine = np.array([near[i] for i in mine]), fit[mine]
            fine = _best_shapes(x[mine], y[mine], n[mine], peak[some][mine], best[mine, 1, None] + [-0.025, 0, 0.025], e, e)
            best[mine] = np.where((fine[:, 0] < best[mine, 0])[:, None], fine, best[mine])
        found[some[fit]], reason[some[fit]] = best[fit], None
    return found, reason


FIT_RESULTS = [*[(f, "double") for f in BILATERAL_FIELDS], ("reason", "string")]


def _fit_columns(ecc_deg: str, density: str, weight: str | None) -> list[Column]:
    return [F.col(ecc_deg).cast("double").alias("_x"), F.col(density).cast("double").alias("_y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_n")]


def bilateral(df: DataFrame, keys: Sequence[str], ecc_deg: str, density: str, weight: str | None = None,
              target: str | None = None) -> DataFrame:
    """Two-sided fit of gridded profiles (at most 201 weighted points each).

    ``target`` names a column with a wanted peak; the peak is then held within
    5000 of it. Profiles without a fit have nulls and a ``reason``: too few
    points, no room for the peak, or no allowed shape.
    """
    wanted = (F.col(target).cast("double") if target else F.lit(None).cast("double")).alias("_t")
    d = df.filter(F.col(density) > 0).select(*keys, *_fit_columns(ecc_deg, density, weight), wanted)

    def work(values, starts):
        found, reason = _fit_profiles(values, starts, values["_t"][starts].astype(float))
        return starts, {**dict(zip(BILATERAL_FIELDS, found.T.copy())), "reason": reason}

    return batches.map_profiles(d, keys, ["_x"], ["_x", "_y", "_n", "_t"], work, FIT_RESULTS)


def _common_peaks(of: np.ndarray, axis: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Wanted peak of every profile, common to its subject's axes: each axis weighs by the loss of the other, NaN for none."""
    loss, peak = (np.full((2, of.max(initial=-1) + 1), np.nan) for _ in range(2))
    for i, name in enumerate("XY"):
        own = axis == name
        loss[i, of[own]], peak[i, of[own]] = found[own, 0], np.exp(found[own, 4])
    both = loss.sum(0)
    one = np.where(np.isnan(peak[0]), peak[1], peak[0])
    some = both > 0
    one[some] = ((loss[1] * peak[0] + loss[0] * peak[1])[some]) / both[some]
    return one[of]


def bilateral_both_axes(df: DataFrame, subject: Sequence[str], ecc_deg: str, density: str, weight: str | None = None) -> DataFrame:
    """Two-sided fit in two passes: the peaks of the first one, joined over the two axes, are wanted in the second.

    A subject's axes are sorted side by side, so that both passes see them in one task.
    """
    subject = list(subject)
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named: a row is much work, tasks shall not be coalesced by their bytes
    d = df.filter(F.col(density) > 0).dropna(subset=subject).select(*subject, "axis", *_fit_columns(ecc_deg, density, weight)).repartition(tasks, *subject)

    def work(values, starts):
        axis, of = values["axis"], batches.owners(starts, len(values["_x"]))
        first = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (axis[1:] != axis[:-1])])
        found, _ = _fit_profiles(values, first, np.full(len(first), np.nan))
        found, reason = _fit_profiles(values, first, _common_peaks(of[first], axis[first], found))
        return first, {**dict(zip(BILATERAL_FIELDS, found.T.copy())), "reason": reason}

    return batches.map_profiles(d, subject, ["axis", "_x"], ["axis", "_x", "_y", "_n"], work, FIT_RESULTS, kept=[*subject, "axis"])


def band_split(df: DataFrame, log_density: Column, model: Column, slope: Column, width: float = 0.2) -> DataFrame:
    """Flag readings farther than ``width`` from the log curve, measured across it."""
    gap = F.abs(log_density - model) / F.sqrt(1 + slope * slope)
    return df.withColumn("inside", gap <= width)


# --- Theil-Sen ----------------------------------------------------------------------------------------

PAIR_BLOCK = 4096
PAIR_ROWS = 32
PAIR_TASKS = 2000


def theil_sen(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Median of all pairwise slopes, the matching intercept and the 95 % limits.

    Exact for groups of any size. Points are dealt into blocks and every pair of
    blocks is a task's work, so no pair of points is ever a row: a first pass
    counts the slopes between edges taken from a sample, a second lists those
    in the few intervals that hold the wanted places, and these are picked by
    their distributed positions.
    """
    keys = list(keys)
    d = cut_complete(df, keys, x, y)
    n = d.groupBy(*keys).agg(F.count("*").alias("n"))
    blocks = F.ceil(F.col("n") / PAIR_BLOCK).cast("int")
    pairs = n.agg(F.sum(blocks.cast("long") * (blocks + 1) / 2)).first()[0] or 1
    own = d.join(n, keys).repartition("_i").withColumn("_blocks", blocks).withColumn("_b", F.pmod(F.xxhash64("_i"), F.col("_blocks")).cast("int"))
    dealt = own.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    dealt = dealt.select(*keys, F.least("_b", "_o").alias("_p"), F.greatest("_b", "_o").alias("_q"), "_b", "_x", "_y")
    # about a hundred points a group give the edges
    some = own.filter(F.pmod(F.xxhash64("_i", F.lit(3)), F.ceil(F.col("n") / 96)) == 0).groupBy(*keys).agg(F.collect_list(F.struct("_x", "_y")).alias("_s"))
    edges = cut(n.join(some, keys, "left").select(*keys, _edges("_s").alias("_e")))

    counted = _by_blocks(dealt, edges, keys, None, pairs)
    below = W.partitionBy(*keys).orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
    bins = cut(counted.groupBy(*keys, "_bin").agg(F.sum("_n").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(below), F.lit(0).cast("long"))))
    lim = cut(_limits(d, keys, n.join(bins.groupBy(*keys).agg(F.sum("_n").alias("m")), keys)))
    names = ["k_lo", "k_hi", "k_lower", "k_upper"]
    want = lim.select(*keys, F.explode(F.array(*[F.struct(F.lit(k).alias("_name"), F.col(k).alias("_k")) for k in names])).alias("_w")).select(*keys, "_w._name", "_w._k")
    hit = cut(bins.join(want, keys).filter("_before <= _k AND _k < _before + _n").select(*keys, "_bin", "_name", (F.col("_k") - F.col("_before")).alias("_k")))
    chosen = edges.join(hit.groupBy(*keys).agg(F.collect_set("_bin").alias("_bins")), keys)
    listed = _by_blocks(dealt, chosen, keys, "_bins", pairs)
    pos = ordered.running_sums(listed, keys + ["_bin"], ["_s"], {"_c": F.col("_n")})
    got = pos.join(hit, keys + ["_bin"]).filter("_c_before <= _k AND _k < _c_before + _c")
    r = got.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == k, F.col("_s"))).alias(k) for k in names])
    s = n.join(r, keys, "left").select(*keys, "n", ((F.col("k_lo") + F.col("k_hi")) / 2).alias("slope"), F.col("k_lower").alias("lower"), F.col("k_upper").alias("upper"))
    med = ordered.quantiles(d, keys, "_x", {"mx": 0.5}).join(ordered.quantiles(d, keys, "_y", {"my": 0.5}), keys)
    return s.join(med, keys).select(*keys, "n", "slope", (F.col("my") - F.col("slope") * F.col("mx")).alias("intercept"), "lower", "upper")


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _edges(samples: pd.Series) -> pd.Series:
    """Up to 255 distinct quantiles of the slopes between sampled points."""
    out = []
    for s in samples:
        p = np.array([[v["_x"], v["_y"]] for v in s]) if s is not None and len(s) else np.zeros((0, 2))
        slopes = _slopes(p, p, np.triu(np.ones((len(p), len(p)), bool), 1))
        out.append(np.unique(np.quantile(slopes, np.linspace(0, 1, 257)[1:-1])) if len(slopes) else np.zeros(0))
    return pd.Series(out)


def _slopes(a: np.ndarray, b: np.ndarray, which: np.ndarray | None = None) -> np.ndarray:
    dx, dy = b[None, :, 0] - a[:, None, 0], b[None, :, 1] - a[:, None, 1]
    if which is None and dx.all():
        return np.divide(dy, dx, out=dy).ravel()
    good = dx != 0 if which is None else (dx != 0) & which
    return dy[good] / dx[good]


def _block_work(keys: Sequence[str], names: Sequence[str], listed: bool):
    """The slopes of one pair of blocks, as ``_by_blocks`` has them."""
    def work(key: Tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        own = key[: len(keys)]
        info = pdf[pdf["_e"].notna()]
        if not len(info):
            return pd.DataFrame(columns=names)
        e = np.asarray(info["_e"].iloc[0], dtype=float)
        wanted = None if not listed else np.asarray(info["_bins"].iloc[0], dtype=int)
        pts = pdf[pdf["_e"].isna()]
        p, q = key[len(keys):]
        a = pts.loc[pts["_b"] == p, ["_x", "_y"]].to_numpy()
        b = a if p == q else pts.loc[pts["_b"] == q, ["_x", "_y"]].to_numpy()
        total, found = np.zeros(len(e) + 1, dtype=np.int64), []
        for lo in range(0, len(a), PAIR_ROWS):
            part = a[lo: lo + PAIR_ROWS]
            which = (np.arange(len(b))[None, :] > np.arange(lo, lo + len(part))[:, None]) if p == q else None
            s = _slopes(part, b, which)
            if wanted is not None:  # only those between the outermost wanted edges are sorted
                some = s >= e[wanted.min() - 1] if wanted.min() > 0 else np.ones(len(s), bool)
                s = s[some & ~(s >= e[wanted.max()])] if wanted.max() < len(e) else s[some]
            # a few edges are sought among sorted slopes, not the slopes among the edges
            s.sort()
            ends = np.r_[0, np.searchsorted(s, e, side="left"), len(s)]
            if wanted is None:
                total += np.diff(ends)
            else:
                for w in wanted:  # tied slopes once, with their number
                    some = s[ends[w]: ends[w + 1]]
                    first = np.flatnonzero(np.r_[True, some[1:] != some[:-1]][: len(some)])
                    found.append((some[first], np.diff(np.r_[first, len(some)])))
        if wanted is None:
            k = np.flatnonzero(total)
            return pd.DataFrame({**dict(zip(keys, own)), "_bin": k.astype("int32"), "_n": total[k]}, columns=names)
        s, at = np.unique(np.concatenate([v for v, _ in found] or [np.zeros(0)]), return_inverse=True)
        c = np.bincount(at, np.concatenate([k for _, k in found] or [np.zeros(0)]), len(s)).astype(np.int64)
        return pd.DataFrame({**dict(zip(keys, own)), "_bin": np.searchsorted(e, s, side="right").astype("int32"), "_s": s, "_n": c}, columns=names)

    return work


def _by_blocks(dealt: DataFrame, edges: DataFrame, keys: Sequence[str], bins: str | None, pairs: float) -> DataFrame:
    """Slopes of every pair of blocks: counts per interval, or with ``bins`` the
    distinct slopes in those intervals with their numbers.

    The ``pairs`` of blocks are shuffled by themselves: a join on the group leaves a whole group
    in one task, which would do for grouping by pairs, and their few bytes would be coalesced.
    """
    keys = list(keys)
    told = dealt.select(*keys, "_p", "_q").distinct().join(edges, keys)
    rows = dealt.withColumn("_e", F.lit(None).cast("array<double>")).withColumn("_bins", F.lit(None).cast("array<int>"))
    told = told.select(*keys, "_p", "_q", F.lit(None).cast("int").alias("_b"), F.lit(None).cast("double").alias("_x"), F.lit(None).cast("double").alias("_y"), "_e",
                       (F.col(bins) if bins else F.lit(None)).cast("array<int>").alias("_bins"))
    both = rows.unionByName(told)
    out = [both.schema[k] for k in keys] + [T.StructField("_bin", T.IntegerType())] + ([T.StructField("_s", T.DoubleType())] if bins else []) + [T.StructField("_n", T.LongType())]
    schema = T.StructType(out)

    apart = both.repartition(int(min(max(pairs, 1), PAIR_TASKS)), *keys, "_p", "_q")
    return apart.groupBy(*keys, "_p", "_q").applyInPandas(_block_work(keys, schema.names, bins is not None), schema)


def cut_complete(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    return cut(df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"),
                                                                             F.monotonically_increasing_id().alias("_i")))


def _limits(d: DataFrame, keys: Sequence[str], n_slopes: DataFrame) -> DataFrame:
    """0-based places of the median (two) and of the 95 % limits."""
    n = F.col("n").cast("double")

    def ties(c):
        t = F.col("_t").cast("double")
        return d.groupBy(*keys, c).agg(F.count("*").alias("_t")).groupBy(*keys).agg(F.sum(t * (t - 1) * (2 * t + 5)).alias("_tie" + c))
    s = n_slopes.join(ties("_x"), list(keys)).join(ties("_y"), list(keys))
    sigma = F.sqrt(F.greatest(F.lit(0.0), (n * (n - 1) * (2 * n + 5) - F.col("_tie_x") - F.col("_tie_y")) / 18))
    z = 1.959963984540054
    m = F.col("m")
    upper = F.least(F.bround((m + z * sigma) / 2, 0).cast("bigint"), m - 1)
    lower = F.greatest(F.bround((m - z * sigma) / 2, 0).cast("bigint") - 1, F.lit(0))
    return s.select(*keys, "n", "m", F.floor((m - 1) / 2).alias("k_lo"), F.floor(m / 2).alias("k_hi"), lower.alias("k_lower"), upper.alias("k_upper"))
