"""Integrals over profiles and over the fitted pit surface.

Interpolation on the grid is linear in the grid values, so an integral along
fixed radii is a weighted sum over the rows of a profile, with weights known
beforehand: one aggregation and no expansion of radii.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from eccentra import constants as K
from eccentra.operators import profiles

MIDDLE = K.GRID_LIMIT


def dense(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Complete grid profiles: nulls interpolated, ends held."""
    full = profiles.on_grid(df.select(*keys, "e10", value), keys)
    return profiles.interpolate_nulls(full, keys, value)


def interp_at(profile: DataFrame, positions: DataFrame, keys: Sequence[str], value: str, at: str) -> DataFrame:
    """Linear interpolation of complete grid profiles at arbitrary positions
    (degrees), clamped to the grid: two equi-joins on the neighbouring steps."""
    keys = list(keys)
    p = F.greatest(F.lit(-float(MIDDLE)), F.least(F.lit(float(MIDDLE)), F.col(at) * 10))
    q = positions.withColumn("_at", p).withColumn("_lo", F.least(F.floor("_at").cast("int"), F.lit(MIDDLE - 1)))
    lo = profile.select(*keys, F.col("e10").alias("_lo"), F.col(value).alias("_vl"))
    hi = profile.select(*keys, (F.col("e10") - 1).alias("_lo"), F.col(value).alias("_vh"))
    j = q.join(lo, keys + ["_lo"]).join(hi, keys + ["_lo"])
    return j.withColumn(value, F.col("_vl") + (F.col("_vh") - F.col("_vl")) * (F.col("_at") - F.col("_lo"))).drop("_at", "_lo", "_vl", "_vh")


def with_sub_grid_peak(profile: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Add ``peak``: the vertex (in steps) of the parabola through the five
    values around the top of each profile."""
    w = W.partitionBy(*keys)
    top = F.max(F.struct(F.col(value), (-F.col("e10")).alias("neg"))).over(w)
    t = profile.withColumn("_c", F.greatest(F.lit(2 - MIDDLE), F.least(F.lit(MIDDLE - 2), -top["neg"])))
    d = F.col("e10") - F.col("_c")
    bend = F.when(F.abs(d) == 2, 2).when(F.abs(d) == 1, -1).when(d == 0, -2).otherwise(0)
    tilt = F.when(F.abs(d) <= 2, d).otherwise(0)
    t = t.withColumn("_a", F.sum(bend * F.col(value)).over(w) / 14.0).withColumn("_b", F.sum(tilt * F.col(value)).over(w) / 10.0)
    vertex = F.when(F.col("_a") != 0, -F.col("_b") / (2 * F.nullif(F.col("_a"), F.lit(0.0)))).otherwise(0.0)
    return t.withColumn("peak", F.col("_c") + vertex).drop("_a", "_b", "_c")


def disk_cell_count(profile: DataFrame, subject: Sequence[str], value: str, radius_deg: float, points: int = 500) -> DataFrame:
    """Cells in a disk around the peak: mean of four rays, trapezoid over r.

    The sample radii r = a + k*h that fall between two grid steps form a run of
    whole k, over which the linear reading sums in closed form. Every grid step
    therefore adds one term per ray direction; readings are clamped outside the
    grid, so the outer runs use the end value.
    """
    subject = list(subject)
    keys = subject + ["axis"]
    a, h = 0.0001, (radius_deg - 0.0001) / (points - 1)
    e, v = F.col("e10"), F.col(value)
    t = with_sub_grid_peak(profile, keys, value).withColumn(
        "_next", F.coalesce(F.lead(value).over(W.partitionBy(*keys).orderBy("e10")), v))

    def before(step: Column, sign: int) -> Column:
        """Number of samples of a ray that lie before ``step`` along the ray."""
        k = F.ceil((sign * (step - F.col("peak")) / 10 - a) / h)
        return F.greatest(F.lit(0), F.least(F.lit(points), k)).cast("double")

    t = (t.withColumn("_up0", before(e, 1)).withColumn("_up1", before(e + 1, 1))
         .withColumn("_down0", before(e, -1)).withColumn("_down1", before(e + 1, -1)))
    first, last, end = e == -MIDDLE, e == MIDDLE, F.lit(float(points))

    def piece(lo, hi, v1, sign: float) -> Column:
        return F.struct(lo.alias("_lo"), hi.alias("_hi"), v1.alias("_v1"), F.lit(sign).alias("_sign"))
    pieces = F.array(
        piece(F.col("_up0"), F.when(last, end).otherwise(F.col("_up1")), F.col("_next"), 1.0),
        piece(F.when(last, F.lit(0.0)).otherwise(F.col("_down1")), F.col("_down0"), F.col("_next"), -1.0),
        piece(F.lit(0.0), F.when(first, F.col("_up0")).otherwise(F.lit(0.0)), v, 1.0),
        piece(F.col("_down0"), F.when(first, end).otherwise(F.col("_down0")), v, -1.0))
    r = (t.select(*keys, "e10", "peak", v.alias("_v"), F.explode(pieces).alias("_p"))
         .select(*keys, "e10", "peak", "_v", "_p.*").filter("_lo < _hi"))
    lo, hi, rise = F.col("_lo"), F.col("_hi"), F.col("_v1") - F.col("_v")
    r = r.withColumn("_rise", rise * 10 * F.col("_sign")).withColumn("_flat", F.col("_v") + rise * (F.col("peak") - e))
    n, s1 = hi - lo, (hi - lo) * (lo + hi - 1) / 2
    s2 = (hi - 1) * hi * (2 * hi - 1) / 6 - (lo - 1) * lo * (2 * lo - 1) / 6
    total = F.col("_flat") * (a * n + h * s1) + F.col("_rise") * (a * a * n + 2 * a * h * s1 + h * h * s2)
    for k, rad in ((0, a), (points - 1, radius_deg)):  # end points count half
        total = total - F.when((lo <= k) & (hi > k), 0.5 * rad * (F.col("_flat") + F.col("_rise") * rad)).otherwise(0.0)
    out = r.groupBy(*subject).agg(F.sum(total).alias("_s"), (F.min("axis") != F.max("axis")).alias("_both"))
    return out.filter("_both").select(*subject, (F.col("_s") / 4.0 * h * K.MM_PER_DEGREE ** 2 * 2 * math.pi).alias("cells"))


def simpson_weights(n: int) -> np.ndarray:
    """Weights of n evenly spaced points in units of the spacing; an even n ends
    with the third-order correction of the last interval."""
    m = n if n % 2 else n - 1
    w = np.zeros(n)
    w[:m] = 2 / 3
    w[1:m:2] = 4 / 3
    w[0] = w[m - 1] = 1 / 3
    if n % 2 == 0:
        w[-3:] += np.array([-1, 8, 5]) / 12
    return w


def _readings(radii_mm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Grid step below each radius and the fraction beyond it."""
    at = radii_mm / K.MM_PER_DEGREE * 10
    lo = np.minimum(np.floor(at).astype(int), MIDDLE - 1)
    return lo, at - lo


def _at_step(values: np.ndarray) -> Column:
    """Constant of the row's grid step (0..100)."""
    return F.array(*[F.lit(float(v)) for v in values])[F.col("e10")]


def polar_integrals(profile: DataFrame, subject: Sequence[str], value: str, disks: dict[str, tuple[float, float]],
                    points: int = 400, maxima: float | None = None) -> DataFrame:
    """Integrals of (X cos^2 + Y sin^2) r over disks {name: (radius, hole)} in mm.

    The angle integrates to pi on both axes, so each disk is one weighted sum
    over both profiles. ``maxima`` adds the largest reading of each axis up to
    that radius.
    """
    half = profile.filter(F.col("e10") >= 0)
    aggs = [(F.min("axis") != F.max("axis")).alias("_both")]
    for name, (radius, hole) in disks.items():
        r = np.linspace(hole, radius, points)
        w = simpson_weights(points) * r * (radius - hole) / (points - 1) * math.pi
        lo, f = _readings(r)
        c = np.bincount(lo, w * (1 - f), MIDDLE + 1) + np.bincount(lo + 1, w * f, MIDDLE + 1)
        aggs.append(F.sum(_at_step(c) * F.col(value)).alias(name))
    if maxima is not None:
        lo, f = _readings(np.linspace(0, maxima, points))
        ends = np.full((2, MIDDLE + 1), np.nan)
        for k, fr in zip(lo, f):
            ends[0, k] = np.fmin(ends[0, k], fr)
            ends[1, k] = np.fmax(ends[1, k], fr)
        used = ~np.isnan(ends[0])
        keys = [*subject, "axis"]
        half = half.withColumn("_next", F.coalesce(F.lead(value).over(W.partitionBy(*keys).orderBy("e10")), F.col(value)))
        step = F.col("_next") - F.col(value)
        top = F.greatest(*[F.col(value) + step * _at_step(np.where(used, e, 0)) for e in ends])
        top = F.when(_at_step(used) > 0, top)
        aggs += [F.max(F.when(F.col("axis") == a, top)).alias(f"max_{a.lower()}") for a in "XY"]
    return half.groupBy(*subject).agg(*aggs).filter("_both").drop("_both")


def strip_integral(df: DataFrame, keys: Sequence[str], x: str, y: str, radius: float, hole: float | None = None) -> DataFrame:
    """Simpson integral of each profile on (-radius, radius), uneven spacing
    allowed, optionally without the centre."""
    keys = list(keys)
    p = W.partitionBy(*keys)
    w = p.orderBy(x)
    inside = F.abs(F.col(x)) < radius
    if hole is not None:
        inside = inside & (F.abs(F.col(x)) > hole)
    t = (df.filter(inside & F.col(y).isNotNull()).withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(p))
         .withColumn("_h0", F.col(x) - F.lag(x).over(w)).withColumn("_h1", F.lead(x).over(w) - F.col(x))
         .withColumn("_f0", F.lag(y).over(w)).withColumn("_f2", F.lead(y).over(w)))
    h0, h1, f0, f1, f2 = F.col("_h0"), F.col("_h1"), F.col("_f0"), F.col(y), F.col("_f2")
    pair = (h0 + h1) / 6 * ((2 - h1 / h0) * f0 + (h0 + h1) * (h0 + h1) / (h0 * h1) * f1 + (2 - h0 / h1) * f2)
    last = f2 * (2 * h1 * h1 + 3 * h0 * h1) / (6 * (h0 + h1)) + f1 * (h1 * h1 + 3 * h0 * h1) / (6 * h0) - f0 * h1 * h1 * h1 / (6 * h0 * (h0 + h1))
    two = h1 * (f1 + f2) / 2
    n, i = F.col("_n"), F.col("_i")
    part = (F.when((n == 2) & (i == 0), two)
            .when((n > 2) & (i % 2 == 1) & (i <= n - 2), pair).otherwise(0.0)
            + F.when((n > 2) & (n % 2 == 0) & (i == n - 2), last).otherwise(0.0))
    return t.groupBy(*keys).agg(F.sum(part).alias("integral"))


# --- the pit surface: polynomial minus a Gaussian -------------------------------------------------

def pit_height(x: Column, y: Column) -> Column:
    dx, dy = x - F.col("center_x"), y - F.col("center_y")
    bowl = (F.col("A00") + F.col("A10") * x + F.col("A01") * y - F.col("A20") * x * x - F.col("A02") * y * y + F.col("A11") * x * y)
    bump = F.col("depth") * F.exp(-(dx * dx / (2 * F.col("width_x") * F.col("width_x")) + dy * dy / (2 * F.col("width_y") * F.col("width_y"))))
    return bowl - bump


def pit_gradient(x: Column, y: Column) -> tuple[Column, Column]:
    dx, dy = x - F.col("center_x"), y - F.col("center_y")
    wx2, wy2 = F.col("width_x") * F.col("width_x"), F.col("width_y") * F.col("width_y")
    bump = F.col("depth") * F.exp(-(dx * dx / (2 * wx2) + dy * dy / (2 * wy2)))
    return (F.col("A10") - 2 * F.col("A20") * x + F.col("A11") * y + bump * dx / wx2,
            F.col("A01") - 2 * F.col("A02") * y + F.col("A11") * x + bump * dy / wy2)


def pit_volume(params: DataFrame, keys: Sequence[str], radius: float, inner: float = 0.0, n_r: int = 24, n_theta: int = 64) -> DataFrame:
    """Volume under the surface on an annulus around the pit centre: Gauss
    points along r and evenly spaced angles (both converge exponentially)."""
    node, weight = np.polynomial.legendre.leggauss(n_r)
    half, mid = (radius - inner) / 2, (radius + inner) / 2
    rs = F.array(*[F.struct(F.lit(float(mid + half * u)).alias("r"), F.lit(float(half * w)).alias("w")) for u, w in zip(node, weight)])
    t = params.withColumn("_r", F.explode(rs)).withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(n_theta - 1))))
    ang = F.col("_k") * (2 * math.pi / n_theta)
    r = F.col("_r.r")
    f = pit_height(r * F.cos(ang) + F.col("center_x"), r * F.sin(ang) + F.col("center_y"))
    return t.groupBy(*keys).agg((F.sum(F.col("_r.w") * r * f) * (2 * math.pi / n_theta)).alias("volume"))


def directional_slopes(distance: float = 0.1) -> list[Column]:
    cx, cy = F.col("center_x"), F.col("center_y")
    at = {"temporal": (cx - distance, cy), "nasal": (cx + distance, cy), "superior": (cx, cy - distance), "inferior": (cx, cy + distance)}
    return [((pit_height(x, y) - pit_height(cx, cy)) / distance).alias(f"{n}_slope") for n, (x, y) in at.items()]


def max_slope(params: DataFrame, keys: Sequence[str], n: int = 41) -> DataFrame:
    """Largest gradient within the ellipse of seven half-widths squared, on a
    grid instead of a solver."""
    reach = math.sqrt(14.0)
    step = F.sequence(F.lit(0), F.lit(n - 1))
    t = params.withColumn("_i", F.explode(step)).withColumn("_j", F.explode(step))
    u, v = F.col("_i") * (2 * reach / (n - 1)) - reach, F.col("_j") * (2 * reach / (n - 1)) - reach
    gx, gy = pit_gradient(F.col("center_x") + u * F.col("width_x"), F.col("center_y") + v * F.col("width_y"))
    inside = u * u / 2 + v * v / 2 <= 7
    return t.filter(inside).groupBy(*keys).agg(F.max(F.sqrt(gx * gx + gy * gy)).alias("max_slope"))


def flatness(surface: DataFrame, keys: Sequence[str], row: str, col: str, value: str, inside: Column, dx: float, dy: float) -> DataFrame:
    """1 over the 40 % quantile of the gradient of the twice smoothed surface
    inside a region."""
    from eccentra.operators import ordered, smoothing
    from eccentra.operators.peaks import _gradient

    keys = list(keys)
    s = smoothing.gaussian_surface(surface, keys, row, col, value, 2)
    rest = surface.join(s.withColumnRenamed(value, "_s"), keys + [row, col]).withColumn("_r", F.col(value) - F.col("_s"))
    r = smoothing.gaussian_surface(rest.select(*keys, row, col, "_r"), keys, row, col, "_r", 2)
    z = rest.select(*keys, row, col, "_s").join(r, keys + [row, col]).withColumn("_z", F.col("_s") + F.col("_r"))
    z = z.withColumn("_x", F.col(row) * dx).withColumn("_y", F.col(col) * dy)
    gx = _gradient("_z", "_x", W.partitionBy(*keys, col).orderBy("_x"))
    gy = _gradient("_z", "_y", W.partitionBy(*keys, row).orderBy("_y"))
    g = z.withColumn("_gx", gx).withColumn("_gy", gy).withColumn("_g", F.sqrt(F.col("_gx") * F.col("_gx") + F.col("_gy") * F.col("_gy")))
    q = ordered.quantiles(g.filter(inside), keys, "_g", {"q": 0.4})
    return q.select(*keys, F.when(F.col("q") > 0, 1 / F.nullif(F.col("q"), F.lit(0.0))).alias("flatness"))


def thin_surface(points: DataFrame, keys: Sequence[str], distance: Column, value: str, ids: Sequence[str], target: int = K.SURFACE_TARGET, least: int = K.SURFACE_LEAST) -> DataFrame:
    """Known points of a surface, thinned with their distance from the centre to about ``target``; surfaces of fewer than ``least`` have none.

    Up to ``target`` all stay. Beyond, a point stays with a probability that falls off past a
    shift, which depends on the surface's size. The draw is a digest of the
    point's ``ids``, so a repeated task keeps the same points and equal points share their fate.
    """
    known = points.filter(F.col(value).isNotNull())
    size = known.groupBy(*keys).agg(F.count("*").cast("double").alias("_size")).filter(F.col("_size") >= least)
    a, b, c, width = K.SURFACE_THINNING
    shift = a - F.ln(b * F.col("_size") / target - 1) / c
    beyond = F.greatest(distance - shift, F.lit(0.0)) / width
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", *ids)), 1, 10), 16, 10).cast("double") / float(1 << 40)
    stays = (F.col("_size") <= target) | (draw < F.when(F.col("_size") > target, F.exp(-beyond * beyond)))
    return known.join(size, list(keys)).filter(stays).select(*points.columns)


def blend_sources(far: DataFrame, near: DataFrame, keys: Sequence[str], value: str, near_limit: float, far_limit: float) -> DataFrame:
    """Near source on its own steps, faded into the interpolated far source
    between the two limits; beyond the near range the far source alone."""
    keys = list(keys)
    far_full = profiles.fill_small_gaps(far, keys, value, widest=2 * K.GRID_LIMIT + 1).withColumnRenamed(value, "_far")
    x = (F.abs(F.col("e10")) / 10.0 - far_limit) / (near_limit - far_limit)
    soft = 1 / (1 + F.exp((1 - 2 * x) / (x - x * x)))
    weight = F.when(x >= 0.95, 1.0).when((x > 0.05) & (x < 0.95), soft).otherwise(0.0)
    mixed = near.select(*keys, "e10", value).join(far_full, keys + ["e10"], "left").select(
        *keys, "e10", ((1 - weight) * F.col(value) + weight * F.coalesce("_far", F.lit(0.0))).alias(value))
    span = near.groupBy(*keys).agg(F.min("e10").alias("_lo"), F.max("e10").alias("_hi"))
    outer = far.select(*keys, "e10", value).join(span, keys).filter((F.col("e10") < F.col("_lo")) | (F.col("e10") > F.col("_hi"))).drop("_lo", "_hi")
    return mixed.unionByName(outer)
