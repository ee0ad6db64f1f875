"""Correlation, regression and robust statistics.

Everything that is a sum stays an ordinary aggregate with map-side combine.
Rank statistics use the distributed positions of ``ordered``; where a group is
known to be one profile (at most 201 steps) arrays are enough (``bounded``).
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import ArrayType, DoubleType

from eccentra.functions.pvalues import binomial_upper, correlation_p, normal_two_sided, t_two_sided
from eccentra.operators import batches, ordered
from eccentra.session import cut

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _complete(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())


def _no_nan(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def pearson(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    spread = F.nullif(F.sqrt(F.var_pop(x) * F.var_pop(y)), F.lit(0.0))  # corr() raises where a value does not vary
    out = _complete(df, x, y).groupBy(*keys).agg((F.covar_pop(x, y) / spread).alias("r"), F.count("*").alias("n"))
    out = out.withColumn("r", _no_nan(F.col("r")))
    return out.withColumn("p", correlation_p(F.col("r"), F.col("n")))


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str, bounded: bool = False) -> DataFrame:
    """Rank correlation with averaged ties, n and two-sided p.

    Ranks are centred by their known mean before multiplying, so the sums stay
    accurate for any group size.
    """
    keys = list(keys)
    d = _complete(df, x, y)
    if bounded:
        return _spearman_profiles(d, keys, x, y)
    d = cut(d.groupBy(*keys, x, y).agg(F.count("*").alias("_w")))  # read three times
    px = ordered.positions(d, keys, x, F.col("_w")).select(*keys, x, F.col("avg_rank").alias("_rx"), F.col("tied_total").alias("_n"))
    py = ordered.positions(d, keys, y, F.col("_w")).select(*keys, y, F.col("avg_rank").alias("_ry"))
    r = d.join(px, keys + [x]).join(py, keys + [y])
    mid = (F.col("_n") + 1) / 2.0
    a, b = F.col("_rx") - mid, F.col("_ry") - mid
    s = r.groupBy(*keys).agg(F.sum(F.col("_w") * a * b).alias("_ab"), F.sum(F.col("_w") * a * a).alias("_aa"),
                             F.sum(F.col("_w") * b * b).alias("_bb"), F.sum("_w").alias("n"))
    den = F.sqrt(F.col("_aa") * F.col("_bb"))
    out = s.select(*keys, F.when(den > 0, F.col("_ab") / den).alias("rho"), "n")
    return out.withColumn("p", correlation_p(F.col("rho"), F.col("n")))


def _spearman_profiles(d: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """``spearman`` of complete rows in groups of one profile at most: a task sorts its rows once, whatever is ranked."""
    def work(values, starts):
        u, v = values["_x"], values["_y"]
        own = batches.owners(starts, len(u))
        n = np.diff(np.r_[starts, len(u)])
        mid = ((n + 1) / 2)[own]
        a, b = batches.average_ranks(u, own) - mid, batches.average_ranks(v, own) - mid
        ab, aa, bb = (np.add.reduceat(s, starts) for s in (a * b, a * a, b * b))
        den = np.sqrt(aa * bb)
        return starts, {"rho": np.where(den > 0, ab / np.where(den > 0, den, 1), np.nan), "n": n}

    t = d.select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    out = batches.map_profiles(t, keys, ["_x"], ["_x", "_y"], work, [("rho", "double"), ("n", "bigint")])
    return out.withColumn("p", correlation_p(F.col("rho"), F.col("n")))


def _pair_counts(d: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Concordant and discordant pairs of weighted distinct rows (x, y, _w),
    counted without forming pairs.

    y is replaced by its dense rank and read bit by bit: two values differ
    first at exactly one bit, where they share the higher bits. At every bit,
    running sums along x count how many zeros precede each one (concordant) and
    how many ones precede each zero (discordant). n values cost n*log2(n) rows.
    """
    keys = list(keys)
    ranks = ordered.running_sums(d.groupBy(*keys, y).agg(F.sum("_w").alias("_t")), keys, [y],
                                 {"_one": F.lit(1).cast("long")})
    ranked = d.join(ranks.select(*keys, y, F.col("_one_before").alias("_dense"), F.col("_one_total").alias("_d")), keys + [y])
    bits = F.greatest(F.ceil(F.log2(F.col("_d").cast("double"))).cast("int"), F.lit(1))
    lv = ranked.withColumn("_level", F.explode(F.sequence(F.lit(0), bits - 1)))
    shifted = F.expr("shiftright(_dense, _level)")
    lv = lv.select(*keys, "_level", F.expr("shiftright(_dense, _level + 1)").alias("_prefix"), x, "_w", (shifted % 2).alias("_bit"))
    rs = ordered.running_sums(lv, keys + ["_level", "_prefix"], [x], {
        "_z": F.when(F.col("_bit") == 0, F.col("_w")).otherwise(0), "_o": F.when(F.col("_bit") == 1, F.col("_w")).otherwise(0)})
    return rs.groupBy(*keys).agg(F.sum(F.col("_o") * F.col("_z_before")).alias("concordant"),
                                 F.sum(F.col("_z") * F.col("_o_before")).alias("discordant"))


def discordant_pairs(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    return _pair_counts(df.groupBy(*keys, x, y).agg(F.count("*").alias("_w")), keys, x, y).select(*keys, "discordant")


def kendall(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Tau-b with its normal p-value."""
    keys = list(keys)
    d = cut(_complete(df, x, y).groupBy(*keys, x, y).agg(F.count("*").alias("_w")))  # read five times
    pairs = _pair_counts(d, keys, x, y)

    def ties(c, tag):
        t = F.col("_t").cast("double")
        return d.groupBy(*keys, c).agg(F.sum("_w").alias("_t")).groupBy(*keys).agg(
            F.sum(t).alias(f"_n_{tag}"), F.sum(t * (t - 1) / 2).alias(f"_{tag}1"), F.sum(t * (t - 1) * (t - 2)).alias(f"_{tag}2"),
            F.sum(t * (t - 1) * (2 * t + 5)).alias(f"_{tag}3"))
    out = pairs.join(ties(x, "x"), keys).join(ties(y, "y"), keys)
    n = F.col("_n_x")
    total = n * (n - 1) / 2
    score = (F.col("concordant") - F.col("discordant")).cast("double")
    den = F.sqrt((total - F.col("_x1")) * (total - F.col("_y1")))
    var = ((n * (n - 1) * (2 * n + 5) - F.col("_x3") - F.col("_y3")) / 18 + 2 * F.col("_x1") * F.col("_y1") / (n * (n - 1))
           + F.when(n > 2, F.col("_x2") * F.col("_y2") / (9 * n * (n - 1) * (n - 2))).otherwise(0.0))
    return out.filter(n > 1).select(
        *keys, n.cast("bigint").alias("n"), F.when(den > 0, score / den).alias("tau"),
        F.when(var > 0, score / F.sqrt(var)).alias("z")).withColumn("p", normal_two_sided("z"))


def linear_fit(df: DataFrame, keys: Sequence[str], x: str, y: str, least: int = 2) -> DataFrame:
    """Slope, intercept, r, p, standard error and RMSE of y on x per group."""
    d = _complete(df, x, y)
    s = d.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(x).alias("_mx"), F.avg(y).alias("_my"), F.var_pop(x).alias("_vx"),
        F.var_pop(y).alias("_vy"), F.covar_pop(x, y).alias("_c")).filter(F.col("n") >= least)
    s = s.withColumn("slope", F.when(F.col("_vx") > 0, F.col("_c") / F.col("_vx")))
    s = s.withColumn("r", F.when((F.col("_vx") > 0) & (F.col("_vy") > 0), F.greatest(F.lit(-1.0), F.least(
        F.lit(1.0), F.col("_c") / F.sqrt(F.col("_vx") * F.col("_vy"))))))
    rest = F.greatest(F.lit(0.0), 1 - F.col("r") * F.col("r"))
    return s.select(
        *keys, "n", "slope", (F.col("_my") - F.col("slope") * F.col("_mx")).alias("intercept"), "r",
        F.when((F.col("n") > 2) & (F.col("_vx") > 0), F.sqrt(rest * F.col("_vy") / F.col("_vx") / (F.col("n") - 2))).alias("stderr"),
        F.sqrt(rest * F.col("_vy")).alias("rmse")).withColumn("p", correlation_p(F.col("r"), F.col("n")))


def zscore(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Standardise columns within ``keys`` by population mean and deviation.

    The moments are aggregated first and joined back, so a key shared by all
    subjects is never gathered.
    """
    keys = list(keys)
    m = df.groupBy(*keys).agg(*[f(c).alias(f"_{n}_{c}") for c in cols for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    out = df.join(m, keys)
    for c in cols:
        s = F.col(f"_s_{c}")
        out = out.withColumn(c, F.when(s > 0, (F.col(c) - F.col(f"_m_{c}")) / s))
    return out.drop(*[f"_{n}_{c}" for c in cols for n in "ms"])


@F.pandas_udf(ArrayType(DoubleType()))
def _solve_centred(cov: pd.Series, rhs: pd.Series) -> pd.Series:
    """Least-squares coefficients of stacked k x k systems."""
    b = np.array([np.asarray(v, float) for v in rhs])
    k = b.shape[1] if len(b) else 0
    a = np.array([np.asarray(v, float) for v in cov]).reshape(-1, k, k) if len(b) else np.zeros((0, 0, 0))
    ok = np.isfinite(a).all(axis=(1, 2)) & np.isfinite(b).all(axis=1)
    beta = np.full(b.shape, np.nan)
    beta[ok] = np.einsum("nij,nj->ni", np.linalg.pinv(a[ok], hermitian=True), b[ok])
    return pd.Series(list(beta))


def residualise(df: DataFrame, keys: Sequence[str], y: str, covariates: Sequence[str], out: str = "residual") -> DataFrame:
    """Residuals of y on the covariates (with intercept) per group.

    Only moments travel: k*(k+1)/2 + k covariances per group are aggregated,
    solved in one vectorised call and joined back. Null for groups with fewer
    than k+1 complete rows and for incomplete rows.
    """
    keys, cov = list(keys), list(covariates)
    ok = F.col(y).isNotNull()
    for c in cov:
        ok = ok & F.col(c).isNotNull()
    d = df.filter(ok)
    aggs = [F.count("*").alias("_n"), F.avg(y).alias("_my"), *[F.avg(c).alias(f"_m_{c}") for c in cov]]
    mat = F.array(*[F.covar_pop(a, b) for a in cov for b in cov]).alias("_cov")
    rhs = F.array(*[F.covar_pop(a, y) for a in cov]).alias("_rhs")
    fit = d.groupBy(*keys).agg(*aggs, mat, rhs).filter(F.col("_n") >= len(cov) + 1).withColumn(
        "_beta", _solve_centred("_cov", "_rhs")).drop("_cov", "_rhs", "_n")
    j = df.join(fit, keys, "left")
    res = F.col(y) - F.col("_my")
    for i, c in enumerate(cov):
        res = res - F.col("_beta")[i] * (F.col(c) - F.col(f"_m_{c}"))
    return j.withColumn(out, res).drop("_beta", "_my", *[f"_m_{c}" for c in cov])


def correlation(df: DataFrame, keys: Sequence[str], x: str, y: str, method: str = "spearman") -> DataFrame:
    """(keys, r, n, p) by ``pearson``, ``spearman`` or ``kendall``."""
    if method == "pearson":
        return pearson(df, keys, x, y).select(*keys, "r", "n", "p")
    if method == "spearman":
        return spearman(df, keys, x, y).select(*keys, F.col("rho").alias("r"), "n", "p")
    if method == "kendall":
        return kendall(df, keys, x, y).select(*keys, F.col("tau").alias("r"), "n", "p")
    raise ValueError(f"no correlation method {method!r}")


def pair_rows(df: DataFrame, cols: Sequence[str], against: Sequence[str] | None = None) -> DataFrame:
    """Long rows (a, b, va, vb) for column pairs of a wide table, without a join."""
    if against is None:
        pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    else:
        pairs = [(a, b) for a in cols for b in against]
    s = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("double").alias("va"),
                           F.col(b).cast("double").alias("vb")) for a, b in pairs])
    return df.select(F.explode(s).alias("p")).select("p.*")


def quadrants(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Sign agreement of standardised pairs and its one-sided binomial p."""
    d = _complete(df, x, y)
    same = (F.col(x) > 0) == (F.col(y) > 0)
    s = d.groupBy(*keys).agg(F.count_if(same).alias("concordant"), F.count_if(~same).alias("discordant"), F.corr(x, y).alias("r"))
    hits = F.when(F.col("r") < 0, F.col("discordant")).otherwise(F.col("concordant"))
    return s.withColumn("p", binomial_upper(hits, F.col("concordant") + F.col("discordant")))


def mean_vs_zero(df: DataFrame, keys: Sequence[str], v: str) -> DataFrame:
    """Mean with a one-sample t-test against zero."""
    s = df.groupBy(*keys).agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("_s"), F.count(v).alias("n"))
    s = s.withColumn("t", F.when(F.col("_s") > 0, F.col("mean") / (F.col("_s") / F.sqrt(F.col("n").cast("double"))))).drop("_s")
    return s.withColumn("p", t_two_sided(F.col("t"), F.col("n") - 1))


def goodness_of_fit(df: DataFrame, keys: Sequence[str], y: str, f: str) -> DataFrame:
    """R squared of fitted against observed values, for more than one pair."""
    d = _complete(df, y, f)
    e = F.col(y) - F.col(f)
    s = d.groupBy(*keys).agg(F.sum(e * e).alias("_sse"), (F.var_pop(y) * F.count("*")).alias("_sst"), F.count("*").alias("n"))
    return s.filter("n > 1").select(*keys, "n", F.when(F.col("_sst") > 0, 1 - F.col("_sse") / F.col("_sst")).alias("r2"))


def winsorize(df: DataFrame, keys: Sequence[str], v: str, share: float = 0.05) -> DataFrame:
    """Clamp the lowest and highest ``share`` of the rows to the next value."""
    keys = list(keys)
    pos = ordered.positions(df, keys, v)
    k = F.floor(F.lit(share) * F.col("tied_total"))
    lo, hi = k, F.col("tied_total") - k - 1

    def at(i):
        return F.max(F.when((F.col("tied_before") <= i) & (i < F.col("tied_before") + F.col("tied")), F.col(v)))
    lim = pos.groupBy(*keys).agg(at(lo).alias("_lo"), at(hi).alias("_hi"))
    return df.join(lim, keys).withColumn(v, F.least(F.greatest(F.col(v), "_lo"), F.col("_hi"))).drop("_lo", "_hi")


#: Sums per subject from which the mixed model follows.
MOMENTS = ("n", "sx", "sy", "sxx", "sxy", "syy")


def _moments(x: str, y: str) -> list[Column]:
    a, b = F.col(x), F.col(y)
    return [F.count("*").cast("double").alias("n"), F.sum(a).alias("sx"), F.sum(b).alias("sy"), F.sum(a * a).alias("sxx"), F.sum(a * b).alias("sxy"), F.sum(b * b).alias("syy")]


def in_ranges(df: DataFrame, order: str, ranges: Sequence[tuple[str, int, int]]) -> DataFrame:
    """Rows once per named range (ends included) that holds their ``order``."""
    tests = F.array(*[F.when(F.col(order).between(lo, hi), F.lit(name)) for name, lo, hi in ranges])
    return df.withColumn("range", F.explode(F.filter(tests, lambda r: r.isNotNull())))


def range_moments(df: DataFrame, keys: Sequence[str], subject: str, order: str, x: str, y: str, ranges: Sequence[tuple[str, int, int]], lo: int, hi: int) -> DataFrame:
    """``MOMENTS`` per (keys, range, subject): running sums along each profile's grid lo..hi, so a range costs two look-ups.

    A profile has at most hi - lo + 1 steps and is one array.
    """
    steps = _complete(df, x, y).groupBy(*keys, subject, order).agg(*_moments(x, y))
    w = W.partitionBy(*keys, subject).orderBy(order)
    running = steps.select(*keys, subject, order, *[F.sum(m).over(w).alias(m) for m in MOMENTS])
    profile = running.groupBy(*keys, subject).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("at"), *MOMENTS))).alias("_p"))

    def upto(limit: Column) -> Column:
        """Running sums at the last step that is not beyond ``limit``."""
        return F.get("_p", F.size(F.filter("_p", lambda s: s["at"] <= limit)) - 1)

    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("range"), F.lit(max(a, lo)).alias("a"), F.lit(min(z, hi)).alias("z")) for n, a, z in ranges])).alias("_r")
    t = profile.select(*keys, subject, "_p", rows).withColumns({"_z": upto(F.col("_r.z")), "_a": upto(F.col("_r.a") - 1)})
    zero = F.lit(0.0)
    out = t.select(*keys, F.col("_r.range").alias("range"), subject, *[(F.coalesce(F.col(f"_z.{m}"), zero) - F.coalesce(F.col(f"_a.{m}"), zero)).alias(m) for m in MOMENTS])
    return out.filter("n > 0")


def random_intercept(df: DataFrame, keys: Sequence[str], subject: str, x: str, y: str,
                     ratios: Sequence[float] | None = None, refine: int = 40) -> DataFrame:
    """y ~ x with a random intercept per subject, by REML."""
    per = _complete(df, x, y).groupBy(*keys, subject).agg(*_moments(x, y))
    return random_intercept_of(per, keys, ratios, refine)


def random_intercept_of(per: DataFrame, keys: Sequence[str], ratios: Sequence[float] | None = None, refine: int = 40) -> DataFrame:
    """The mixed model from one row of ``MOMENTS`` per subject.

    For a fixed variance ratio everything follows from the six sums, so the rows
    are expanded by a grid of ratios and summed; the best ratio is refined once. Groups
    of two rows or fewer, or with one value of x only, have nulls.
    """
    keys = list(keys)
    per = cut(per.select(*keys, *MOMENTS)) if refine else per  # read twice
    grid = list(ratios) if ratios is not None else [0.0] + [10 ** (k / 10) for k in range(-50, 31)]

    def profile(t: DataFrame) -> DataFrame:
        lam = F.col("ratio")
        c = lam / (1 + F.col("n") * lam)
        s = t.groupBy(*keys, "ratio").agg(
            F.sum("n").alias("N"), F.sum(F.log1p(F.col("n") * lam)).alias("logd"),
            F.sum(F.col("n") - c * F.col("n") * F.col("n")).alias("s11"), F.sum(F.col("sx") - c * F.col("n") * F.col("sx")).alias("s1x"),
            F.sum(F.col("sxx") - c * F.col("sx") * F.col("sx")).alias("sxx"), F.sum(F.col("sy") - c * F.col("n") * F.col("sy")).alias("s1y"),
            F.sum(F.col("sxy") - c * F.col("sx") * F.col("sy")).alias("sxy"), F.sum(F.col("syy") - c * F.col("sy") * F.col("sy")).alias("syy"))
        det = F.col("s11") * F.col("sxx") - F.col("s1x") * F.col("s1x")
        s = s.withColumn("det", F.when((det > 0) & (F.col("N") > 2), det))
        s = s.withColumn("slope", (F.col("s11") * F.col("sxy") - F.col("s1x") * F.col("s1y")) / F.col("det"))
        s = s.withColumn("intercept", (F.col("sxx") * F.col("s1y") - F.col("s1x") * F.col("sxy")) / F.col("det"))
        free = F.nullif(F.col("N") - 2, F.lit(0.0))
        s = s.withColumn("var", (F.col("syy") - F.col("intercept") * F.col("s1y") - F.col("slope") * F.col("sxy")) / free)
        s = s.withColumn("se", F.sqrt(F.col("var") * F.col("s11") / F.col("det")))
        ll = -0.5 * (F.col("logd") + F.ln("det") + (F.col("N") - 2) * F.ln("var"))
        return s.withColumn("ll", ll).groupBy(*keys).agg(F.max(F.struct(
            "ll", "ratio", "slope", "intercept", "se", F.col("N").cast("bigint").alias("n"))).alias("b"))

    best = profile(per.withColumn("ratio", F.explode(F.array(*[F.lit(float(g)) for g in grid]))))
    if refine:
        around = best.select(*keys, F.col("b.ratio").alias("_r"))
        fine = F.transform(F.sequence(F.lit(-refine), F.lit(refine)), lambda k: F.when(
            F.col("_r") > 0, F.col("_r") * F.pow(F.lit(10.0), k / (10.0 * refine))).otherwise(F.lit(0.0)))
        best = profile(per.join(around, keys).withColumn("ratio", F.explode(F.array_distinct(fine))))
    fitted = F.col("b.slope").isNotNull()
    out = best.select(*keys, F.col("b.n").alias("n"), F.col("b.slope").alias("slope"), F.col("b.intercept").alias("intercept"),
                      F.when(fitted, F.col("b.ratio")).alias("ratio"), F.col("b.se").alias("se"))
    return out.withColumn("p", normal_two_sided(F.col("slope") / F.col("se")))
