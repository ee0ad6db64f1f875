"""Inference over the bound views."""

from pyspark.sql import Window as W, functions as F

from eccentra.functions import geometry as G
from eccentra.operators import cohort, joins, peaks, profiles, smoothing, stats
from eccentra.plans.q_join import REG, REG_SQL
from eccentra.plans.q_ordered import robust_lowess, scale_space
from eccentra.plans.registry import query
from eccentra.session import cut

KEY = ["subject_id", "session_id", "axis"]


def t_tail(t: str, nu: str, narrow: bool = False) -> str:
    """Two-sided Student tail in SQL: Simpson's rule on the angle integral.

    The integrand is about 1 / sqrt(nu) wide; ``narrow`` spends the steps on its first twelve widths, for any ``nu``.
    """
    th = f"atan(abs({t}) / sqrt({nu}))"
    span = f"least(pi() / 2 - {th}, 12 / sqrt({nu}))" if narrow else f"(pi() / 2 - {th})"
    return (f"CASE WHEN {nu} > 0 THEN 2 * exp(lgamma(({nu} + 1) / 2e0) - lgamma({nu} / 2e0)) / sqrt(pi()) * {span} / 6000 * "
            f"list_sum(list_transform(range(0, 2001), lambda k: (CASE WHEN k = 0 OR k = 2000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * "
            f"power(greatest(0e0, cos({th} + {span} * k / 2000e0)), {nu} - 1))) END")


def r_tail(r: str, n: str, narrow: bool = False) -> str:
    return f"CASE WHEN abs({r}) >= 1 THEN 0e0 ELSE {t_tail(f'({r} * sqrt(({n} - 2) / (1 - {r} * {r})))', f'({n} - 2)', narrow)} END"


def rho_sql(source: str, keys: str, x: str, y: str) -> str:
    """Rank correlation with averaged ties from a SQL relation."""
    return f"""(SELECT {keys}, corr(rx, ry) AS rho, count(*) AS n FROM (
        SELECT {keys}, rank() OVER (PARTITION BY {keys} ORDER BY {x}) + (count(*) OVER (PARTITION BY {keys}, {x}) - 1) / 2e0 AS rx,
               rank() OVER (PARTITION BY {keys} ORDER BY {y}) + (count(*) OVER (PARTITION BY {keys}, {y}) - 1) / 2e0 AS ry
        FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL) AS rk GROUP BY {keys})"""


def clean(r: str) -> str:
    return f"CASE WHEN isfinite({r}) THEN {r} END"


PAIRS = """pairs AS (SELECT subject_id, session_id, axis, e10, layer, p.density, l.thickness
    FROM v_profile p JOIN v_layer_profile l USING (subject_id, session_id, axis, e10))"""


def pairs(b):
    return b.v_profile.drop("thickness", "n_obs").join(b.v_layer_profile, KEY + ["e10"])


@query("spearman_simple", f"""WITH {PAIRS}, s AS (SELECT *, CASE WHEN e10 < 0 THEN 'left' ELSE 'right' END AS side FROM pairs WHERE e10 <> 0)
    SELECT subject_id, axis, layer, side, {clean('rho')} AS rho, n, CASE WHEN n > 2 AND isfinite(rho) THEN {r_tail('rho', 'n')} END AS p FROM {rho_sql('s', 'subject_id, axis, layer, side', 'density', 'thickness')} AS r""", rounded="rho p", digits=4)
def _(b):
    s = pairs(b).filter("e10 <> 0").withColumn("side", F.when(F.col("e10") < 0, "left").otherwise("right"))
    return stats.spearman(s, ["subject_id", "axis", "layer", "side"], "density", "thickness", bounded=True)


PARTS = f"""{PAIRS}, {scale_space('v_layer_profile', 'subject_id, axis, layer', 'e10', 'thickness')}, s AS (
      SELECT pairs.*, u.part FROM pairs JOIN least USING (subject_id, axis, layer),
      LATERAL (SELECT unnest(list_filter([CASE WHEN e10 < 0 AND lower IS NULL THEN 'left' END, CASE WHEN e10 > 0 AND lower IS NULL THEN 'right' END, CASE WHEN e10 < 0 AND e10 <= lower THEN 'first' END,
        CASE WHEN e10 < 0 AND e10 >= lower THEN 'second' END, CASE WHEN e10 > 0 AND e10 <= upper THEN 'third' END, CASE WHEN e10 > 0 AND e10 >= upper THEN 'fourth' END], lambda x: x IS NOT NULL)) AS part) AS u)"""


@query("spearman_parts", f"""WITH {PARTS}
    SELECT subject_id, axis, layer, part, {clean('rho')} AS rho, n, CASE WHEN n > 2 AND isfinite(rho) THEN {r_tail('rho', 'n')} END AS p FROM {rho_sql('s', 'subject_id, axis, layer, part', 'density', 'thickness')} AS r""", rounded="rho p")
def _(b):
    """Correlation and its p on parts around the two peaks of the profile's own smoothed thickness; left and right where it has no such peaks."""
    keys = ["subject_id", "axis", "layer"]
    limits = peaks.two_peaks_one_valley(b.v_layer_profile, keys, "e10", "thickness").drop("sigma")
    s = peaks.split_parts(pairs(b), limits, keys)
    return stats.spearman(s, keys + ["part"], "density", "thickness", bounded=True)


FILLED = """lt AS (SELECT subject_id, layer, axis, e10, thickness, lead(e10) OVER w AS ne, lead(thickness) OVER w AS nv FROM v_layer_profile WINDOW w AS (PARTITION BY subject_id, layer, axis ORDER BY e10)),
    filled AS (SELECT subject_id, axis, layer, CAST(g.e AS INT) AS e10, CASE WHEN g.e = e10 THEN thickness ELSE thickness + (nv - thickness) * (g.e - e10) / (ne - e10) END AS thickness
      FROM lt, range(-100, 101) g(e) WHERE g.e = e10 OR (ne - e10 <= 4 AND g.e > e10 AND g.e < ne))"""
STEP = "floor({} * 1048576e0 + 5e-1) / 1048576e0"


@query("layer_analysis", f"""WITH {FILLED}, {robust_lowess('filled', 'subject_id, axis, layer', 'e10', 'thickness')},
    sm AS (SELECT subject_id, axis, layer, e10, fit AS thickness FROM lw), {scale_space('sm', 'subject_id, axis, layer', 'e10', 'thickness')},
    both_ AS (SELECT subject_id, axis, layer, e10, density, {STEP.format('sm.thickness')} AS thickness FROM sm JOIN v_profile p USING (subject_id, axis, e10)),
    s AS (SELECT both_.*, lower, upper, u.part FROM both_ JOIN least USING (subject_id, axis, layer),
      LATERAL (SELECT unnest(list_filter([CASE WHEN e10 < 0 AND lower IS NULL THEN 'left' END, CASE WHEN e10 > 0 AND lower IS NULL THEN 'right' END, CASE WHEN e10 < 0 AND e10 <= lower THEN 'first' END,
        CASE WHEN e10 < 0 AND e10 >= lower THEN 'second' END, CASE WHEN e10 > 0 AND e10 <= upper THEN 'third' END, CASE WHEN e10 > 0 AND e10 >= upper THEN 'fourth' END], lambda x: x IS NOT NULL)) AS part) AS u)
    SELECT subject_id, axis, layer, part, any_value(lower) AS lower, any_value(upper) AS upper, any_value(rho) AS rho, any_value(n) AS n
    FROM s JOIN (SELECT subject_id, axis, layer, part, {clean('rho')} AS rho, n FROM {rho_sql('s', 'subject_id, axis, layer, part', 'density', 'thickness')} AS r) AS q USING (subject_id, axis, layer, part) GROUP BY subject_id, axis, layer, part""", rounded="rho", digits=4)
def _(b):
    """The whole way of a subject: mean thickness per step, small gaps filled, LOWESS, the two peaks, rank correlation with density by part."""
    keys = ["subject_id", "axis", "layer"]
    filled = profiles.fill_small_gaps(b.v_layer_profile.select(*keys, "e10", "thickness"), keys, "thickness")
    smooth = cut(smoothing.lowess(filled, keys, "e10", "thickness").withColumn("e10", F.col("e10").cast("int")))  # read twice
    limits = peaks.two_peaks_one_valley(smooth, keys, "e10", "thickness").drop("sigma")
    both = b.v_profile.select("subject_id", "axis", "e10", "density").join(smooth, ["subject_id", "axis", "e10"])
    parts = peaks.split_parts(both.withColumn("thickness", F.floor(F.col("thickness") * 1048576.0 + 0.5) / 1048576.0), limits, keys)
    rho = stats.spearman(parts, keys + ["part"], "density", "thickness", bounded=True).drop("p")
    return rho.join(limits, keys).select(*keys, "part", "lower", "upper", "rho", "n")


ECC = f"""{PAIRS}, ew AS (SELECT *, {r_tail('rho', 'n')} AS p FROM {rho_sql('pairs', 'axis, e10, layer', 'density', 'thickness')} AS r WHERE n > 2 AND isfinite(rho))"""


@query("eccwise_correlation", f"""WITH {ECC}, pw AS (SELECT axis, e10, layer, corr(density, thickness) AS rho, count(*) AS n FROM pairs GROUP BY axis, e10, layer)
    SELECT axis, e10, layer, 'spearman' AS method, rho, n, p FROM ew UNION ALL
    SELECT axis, e10, layer, 'pearson', rho, n, {r_tail('rho', 'n')} FROM pw WHERE n > 2 AND isfinite(rho)""", rounded="rho p", digits=4)
def _(b):
    """One correlation per step and layer, by either method."""
    keys = ["axis", "e10", "layer"]
    own = [stats.correlation(pairs(b), keys, "density", "thickness", m).withColumn("method", F.lit(m)) for m in ("spearman", "pearson")]
    return own[0].unionByName(own[1]).filter("n > 2 AND r IS NOT NULL").select(*keys, "method", F.col("r").alias("rho"), "n", "p")


SIDED = f"""{PAIRS}, s AS (SELECT *, CASE WHEN e10 < 0 THEN 'left' ELSE 'right' END AS side FROM pairs WHERE e10 <> 0),
    c AS (SELECT *, {r_tail('rho', 'n')} AS p FROM {rho_sql('s', 'subject_id, axis, layer, side', 'density', 'thickness')} AS r WHERE n > 2 AND isfinite(rho))"""


def sided(b):
    s = pairs(b).filter("e10 <> 0").withColumn("side", F.when(F.col("e10") < 0, "left").otherwise("right"))
    return stats.spearman(s, ["subject_id", "axis", "layer", "side"], "density", "thickness", bounded=True).filter("n > 2 AND rho IS NOT NULL")


@query("significant_ratio", f"""WITH {SIDED} SELECT axis, layer, side, count(*) FILTER (p < 5e-2) AS n_significant, count(*) FILTER (p > 5e-2) AS n_other, avg(rho) FILTER (p < 5e-2) AS mean_rho,
      list_sort(list(round(rho, 6)) FILTER (p < 5e-2)) AS rhos, count(*) FILTER (p < 5e-2) / CAST(count(*) FILTER (p < 5e-2) + count(*) FILTER (p > 5e-2) AS DOUBLE) AS share FROM c GROUP BY axis, layer, side""", rounded="share mean_rho")
def _(b):
    """The list holds one number per significant subject of twelve groups: a few megabytes for a million."""
    yes, no = F.count_if(F.col("p") < 0.05), F.count_if(F.col("p") > 0.05)
    return sided(b).groupBy("axis", "layer", "side").agg(yes.alias("n_significant"), no.alias("n_other"), F.avg(
        F.when(F.col("p") < 0.05, F.col("rho"))).alias("mean_rho"), F.nullif(F.sort_array(F.collect_list(F.when(F.col("p") < 0.05, F.round("rho", 6)))), F.array().cast("array<double>")).alias("rhos"), (yes / F.nullif(yes + no, F.lit(0))).alias("share"))


@query("significant_correlations", f"WITH {SIDED} SELECT axis, layer, side, subject_id, rho FROM c WHERE p < 5e-2", rounded="rho")
def _(b):
    """One row per significant correlation."""
    return sided(b).filter("p < 0.05").select("axis", "layer", "side", "subject_id", "rho")


@query("zscore_inter", """SELECT subject_id, axis, e10, (density - avg(density) OVER w) / nullif(stddev_pop(density) OVER w, 0) AS density,
    (thickness - avg(thickness) OVER w) / nullif(stddev_pop(thickness) OVER w, 0) AS thickness FROM v_profile WINDOW w AS (PARTITION BY axis, e10)""", rounded="density thickness")
def _(b):
    return stats.zscore(b.v_profile, ["axis", "e10"], ["density", "thickness"]).select("subject_id", "axis", "e10", "density", "thickness")


@query("zscore_intra", """SELECT subject_id, axis, e10, (density - avg(density) OVER w) / nullif(stddev_pop(density) OVER w, 0) AS density
    FROM v_profile WINDOW w AS (PARTITION BY subject_id, axis)""", rounded="density")
def _(b):
    return stats.zscore(b.v_profile, ["subject_id", "axis"], ["density"]).select("subject_id", "axis", "e10", "density")


@query("log_density", """SELECT subject_id, axis, e10, (ln(density) - avg(ln(density)) OVER w) / nullif(stddev_pop(ln(density)) OVER w, 0) AS density
    FROM v_profile WHERE density > 0 WINDOW w AS (PARTITION BY axis, e10)""", rounded="density")
def _(b):
    t = b.v_profile.filter("density > 0").withColumn("density", F.ln("density"))
    return stats.zscore(t, ["axis", "e10"], ["density"]).select("subject_id", "axis", "e10", "density")


SUBJ = """subj AS (SELECT subject_id, (visit_date - birth_date) / 365e0 AS age, CASE WHEN laterality = 'OD' THEN axial_right ELSE axial_left END AS axial_length,
    CASE WHEN laterality = 'OD' THEN sphere_right ELSE sphere_left END AS sphere FROM v_baseline)"""


@query("residualise", f"""
    WITH {SUBJ}, d AS (SELECT subject_id, axis, e10, density AS y, age AS x1, axial_length AS x2 FROM v_profile JOIN subj USING (subject_id)),
    m AS (SELECT axis, e10, count(*) AS n, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, var_pop(x1) AS s11, var_pop(x2) AS s22, covar_pop(x1, x2) AS s12, covar_pop(x1, y) AS s1y, covar_pop(x2, y) AS s2y FROM d GROUP BY axis, e10),
    k AS (SELECT *, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1, (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2 FROM m WHERE n >= 3)
    SELECT subject_id, axis, e10, y - my - b1 * (x1 - m1) - b2 * (x2 - m2) AS residual FROM d LEFT JOIN k USING (axis, e10)""", rounded="residual", digits=3)
def _(b):
    t = cohort.join_baseline(b.v_profile, b.v_baseline)
    r = stats.residualise(t, ["axis", "e10"], "density", ["age", "axial_length"])
    return r.select("subject_id", "axis", "e10", "residual")


@query("pearson_p", f"""SELECT axis, e10, {clean('r')} AS r, n, CASE WHEN isfinite(r) AND n > 2 THEN {r_tail('r', 'n')} END AS p FROM (
    SELECT axis, e10, corr(density, thickness) AS r, count(*) AS n FROM v_profile WHERE thickness IS NOT NULL GROUP BY axis, e10) AS t WHERE n > 2""", rounded="r p", digits=4)
def _(b):
    return stats.pearson(b.v_profile, ["axis", "e10"], "density", "thickness").filter("n > 2")


@query("kendall_tau", """
    WITH d AS (SELECT subject_id, axis, e10, density AS x, CAST(floor(thickness) AS DOUBLE) AS y FROM v_profile WHERE thickness IS NOT NULL),
    p AS (SELECT a.axis, a.e10, sum(sign(a.x - o.x) * sign(a.y - o.y)) AS s, count(*) FILTER (a.x = o.x) AS tx, count(*) FILTER (a.y = o.y) AS ty, count(*) AS tot
      FROM d a JOIN d o ON a.axis = o.axis AND a.e10 = o.e10 AND a.subject_id < o.subject_id GROUP BY a.axis, a.e10),
    n AS (SELECT axis, e10, count(*) AS n FROM d GROUP BY axis, e10),
    gx AS (SELECT axis, e10, sum(t * (t - 1)) AS x1, sum(t * (t - 1) * (t - 2)) AS x2, sum(t * (t - 1) * (2 * t + 5)) AS x3 FROM (SELECT axis, e10, x, count(*)::DOUBLE AS t FROM d GROUP BY ALL) GROUP BY ALL),
    gy AS (SELECT axis, e10, sum(t * (t - 1)) AS y1, sum(t * (t - 1) * (t - 2)) AS y2, sum(t * (t - 1) * (2 * t + 5)) AS y3 FROM (SELECT axis, e10, y, count(*)::DOUBLE AS t FROM d GROUP BY ALL) GROUP BY ALL),
    v AS (SELECT p.*, n, (n * (n - 1) * (2 * n + 5) - x3 - y3) / 18e0 + x1 * y1 / (2e0 * n * (n - 1)) + CASE WHEN n > 2 THEN x2 * y2 / (9e0 * n * (n - 1) * (n - 2)) ELSE 0 END AS var
      FROM p JOIN n USING (axis, e10) JOIN gx USING (axis, e10) JOIN gy USING (axis, e10))
    SELECT axis, e10, n, CASE WHEN tot > tx AND tot > ty THEN s / sqrt((tot - tx) * CAST(tot - ty AS DOUBLE)) END AS tau, CASE WHEN var > 0 THEN s / sqrt(var) END AS z FROM v""", rounded="tau z", digits=4)
def _(b):
    t = b.v_profile.filter("thickness IS NOT NULL").withColumn("y", F.floor("thickness").cast("double"))
    return stats.kendall(t, ["axis", "e10"], "density", "y").drop("p")


FEATURES = ["age", "axial_length", "sphere", "peak", "mean_thickness", "spread"]
WIDE = f"""{SUBJ}, pf AS (SELECT subject_id, max(density) AS peak, avg(thickness) AS mean_thickness, stddev_pop(density) AS spread FROM v_profile GROUP BY subject_id),
    wide AS (SELECT subject_id, age, axial_length, CASE WHEN subject_id % 4 = 0 THEN NULL ELSE sphere END AS sphere, peak, mean_thickness, spread FROM subj JOIN pf USING (subject_id)),
    long AS (UNPIVOT wide ON age, axial_length, sphere, peak, mean_thickness, spread INTO NAME feature VALUE v),
    pr AS (SELECT a.feature AS a, o.feature AS b, a.v AS va, o.v AS vb FROM long a JOIN long o USING (subject_id))"""
ORDER = "list_position(['age', 'axial_length', 'sphere', 'peak', 'mean_thickness', 'spread'], {})"


def wide(b):
    s = cohort.with_subject_values(b.v_baseline).withColumn("sphere", F.when(F.col("subject_id") % 4 != 0, F.col("sphere")))
    p = b.v_profile.groupBy("subject_id").agg(F.max("density").alias("peak"), F.avg("thickness").alias("mean_thickness"), F.stddev_pop("density").alias("spread"))
    return s.join(p, "subject_id")


@query("pairwise_corr_matrix", f"""WITH {WIDE}, u AS (SELECT * FROM pr WHERE {ORDER.format('a')} < {ORDER.format('b')}),
    pe AS (SELECT a, b, corr(va, vb) AS r, count(*) AS n FROM u GROUP BY a, b), sp AS (SELECT a, b, rho FROM {rho_sql('u', 'a, b', 'va', 'vb')} AS t)
    SELECT a, b, r, n, {r_tail('r', 'n')} AS p, rho FROM pe JOIN sp USING (a, b)""", rounded="r p rho", digits=4)
def _(b):
    t = stats.pair_rows(wide(b), FEATURES)
    return stats.pearson(t, ["a", "b"], "va", "vb").join(stats.spearman(t, ["a", "b"], "va", "vb").select("a", "b", "rho"), ["a", "b"])


@query("param_vs_metric", f"""WITH {WIDE}, u AS (SELECT * FROM pr WHERE a IN ('age', 'axial_length', 'sphere') AND b IN ('peak', 'spread')),
    l AS (SELECT a, b, count(*) AS n, regr_slope(vb, va) AS slope, regr_intercept(vb, va) AS intercept FROM u GROUP BY a, b)
    SELECT a, b, l.n, rho, slope, intercept FROM l JOIN {rho_sql('u', 'a, b', 'va', 'vb')} AS s USING (a, b) WHERE l.n >= 5""", rounded="rho slope intercept", digits=4)
def _(b):
    t = stats.pair_rows(wide(b), ["age", "axial_length", "sphere"], ["peak", "spread"])
    line = stats.linear_fit(t, ["a", "b"], "va", "vb", least=5).select("a", "b", "n", "slope", "intercept")
    return line.join(stats.spearman(t, ["a", "b"], "va", "vb").select("a", "b", "rho"), ["a", "b"])


@query("binned_linregress", f"""
    WITH s AS (SELECT axis, e10, count(*) AS n, regr_slope(thickness, density) AS slope, regr_intercept(thickness, density) AS intercept, corr(thickness, density) AS r,
        var_pop(thickness) AS vy, var_pop(density) AS vx FROM v_profile WHERE thickness IS NOT NULL GROUP BY axis, e10)
    SELECT axis, e10, n, slope * 1e4 AS slope_e4, intercept, r, CASE WHEN n > 2 THEN sqrt((1 - r * r) * vy / vx / (n - 2)) * 1e4 END AS stderr_e4, sqrt((1 - r * r) * vy) AS rmse, CASE WHEN n > 2 THEN {r_tail('r', 'n')} END AS p FROM s WHERE n >= 2""",
       rounded="slope_e4 intercept r stderr_e4 rmse p", digits=4)
def _(b):
    f = stats.linear_fit(b.v_profile, ["axis", "e10"], "density", "thickness", least=2)
    return f.select("axis", "e10", "n", (F.col("slope") * 1e4).alias("slope_e4"), "intercept", "r", (F.col("stderr") * 1e4).alias("stderr_e4"), "rmse", "p")


@query("significant_bin_slopes", f"""WITH {ECC}, pe AS (SELECT axis, e10, layer, corr(thickness, density) AS slope FROM pairs GROUP BY axis, e10, layer),
    g AS (SELECT layer, region, slope FROM ew JOIN pe USING (axis, e10, layer), {REG_SQL} WHERE ew.p < 5e-2 AND e10 / 10e0 >= lo AND e10 / 10e0 < hi),
    m AS (SELECT layer, region, avg(slope) AS mean, count(slope) AS n, CASE WHEN stddev_samp(slope) > 0 THEN avg(slope) / (stddev_samp(slope) / sqrt(count(slope))) END AS t FROM g GROUP BY layer, region)
    SELECT layer, region, mean, n, t, CASE WHEN t IS NOT NULL THEN {t_tail('t', '(n - 1)')} END AS p FROM m""", rounded="mean t p", digits=4)
def _(b):
    pr = pairs(b)
    ew = stats.spearman(pr, ["axis", "e10", "layer"], "density", "thickness").filter("n > 2 AND p < 0.05").drop("n")
    slopes = stats.linear_fit(pr, ["axis", "e10", "layer"], "density", "thickness").select("axis", "e10", "layer", F.col("r").alias("slope"))
    g = joins.regions_of(ew.join(slopes, ["axis", "e10", "layer"]), G.degrees_of(F.col("e10")), REG)
    return stats.mean_vs_zero(g, ["layer", "region"], "slope")


BIN = "CAST(floor((e10 + 100) / 5e0) AS INT)"


@query("interval_axial_corr", f"""WITH {SUBJ}, a AS (SELECT subject_id, layer, axis, {BIN} AS bin, floor(avg(thickness) * 1048576e0 + 5e-1) / 1048576e0 AS v FROM v_layer_profile GROUP BY ALL),
    j AS (SELECT a.*, axial_length FROM a JOIN subj USING (subject_id))
    SELECT layer, axis, bin, CASE WHEN bin = 40 THEN 10e0 ELSE (bin * 5 - 98) / 10e0 END AS centre, rho, n FROM {rho_sql('j', 'layer, axis, bin', 'axial_length', 'v')} AS t WHERE n > 2""", rounded="rho")
def _(b):
    a = b.v_layer_profile.groupBy("subject_id", "layer", "axis", F.floor((F.col("e10") + 100) / 5).cast("int").alias("bin")).agg(
        (F.floor(F.avg("thickness") * 1048576.0 + 0.5) / 1048576.0).alias("v"))  # equal means stay ties
    j = a.join(cohort.with_subject_values(b.v_baseline).select("subject_id", "axial_length"), "subject_id")
    out = stats.spearman(j, ["layer", "axis", "bin"], "axial_length", "v").filter("n > 2").drop("p")
    return out.withColumn("centre", F.when(F.col("bin") == 40, 10.0).otherwise((F.col("bin") * 5 - 98) / 10.0))


@query("interval_axial_regression", f"""WITH {SUBJ}, j AS (SELECT layer, axis, {BIN} AS bin, thickness AS y, axial_length AS x FROM v_layer_profile JOIN subj USING (subject_id)),
    s AS (SELECT layer, axis, bin, count(*) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, corr(y, x) AS r FROM j GROUP BY layer, axis, bin)
    SELECT layer, axis, bin, n, slope, intercept, r, p FROM (SELECT *, {r_tail('r', 'n')} AS p FROM s WHERE n > 2 AND isfinite(r)) AS t WHERE p < 2e-1""", rounded="slope intercept r p", digits=4)
def _(b):
    j = b.v_layer_profile.join(cohort.with_subject_values(b.v_baseline).select("subject_id", "axial_length"), "subject_id").withColumn(
        "bin", F.floor((F.col("e10") + 100) / 5).cast("int"))
    return stats.linear_fit(j, ["layer", "axis", "bin"], "axial_length", "thickness", least=3).filter("p < 0.2").select(
        "layer", "axis", "bin", "n", "slope", "intercept", "r", "p")


ZP = """z AS (SELECT layer, axis, e10, subject_id, (density - avg(density) OVER w) / nullif(stddev_pop(density) OVER w, 0) AS x, (thickness - avg(thickness) OVER w) / nullif(stddev_pop(thickness) OVER w, 0) AS y
      FROM pairs WINDOW w AS (PARTITION BY layer, axis, e10)), zz AS (SELECT * FROM z WHERE x IS NOT NULL AND y IS NOT NULL)"""
QUAD = f"""q AS (SELECT layer, axis, count(*) FILTER ((x > 0) = (y > 0)) AS concordant, count(*) FILTER ((x > 0) <> (y > 0)) AS discordant, corr(x, y) AS r FROM zz GROUP BY layer, axis),
    qp AS (SELECT *, concordant + discordant AS nn, CASE WHEN r < 0 THEN discordant ELSE concordant END AS kk FROM q),
    qq AS (SELECT layer, axis, concordant, discordant, r, list_sum(list_transform(range(kk, nn + 1), lambda i: exp(lgamma(nn + 1) - lgamma(i + 1) - lgamma(nn - i + 1) - nn * ln(2)))) AS p FROM qp)"""


def zpairs(b):
    return stats.zscore(pairs(b), ["layer", "axis", "e10"], ["density", "thickness"])


@query("quadrant_binomial", f"WITH {PAIRS}, {ZP}, {QUAD} SELECT layer, axis, concordant, discordant, r, p FROM qq", rounded="r p", digits=4)
def _(b):
    return stats.quadrants(zpairs(b), ["layer", "axis"], "density", "thickness")


GRIDL = "(SELECT unnest([0e0] || list_transform(range(-50, 31), lambda k: power(1e1, k / 1e1))) AS ratio)"


def reml(keys: str, refine: int = 40) -> str:
    """CTEs from ``per``, the sums per subject: ``mm`` with slope, se, n and p of the random-intercept model."""
    def one(tag: str, rows: str) -> str:
        return f"""s{tag} AS (SELECT {keys}, ratio, sum(n) AS nn, sum(ln(1 + n * ratio)) AS logd, sum(n - c * n * n) AS s11, sum(sx - c * n * sx) AS s1x, sum(sxx - c * sx * sx) AS qxx, sum(sy - c * n * sy) AS s1y,
        sum(sxy - c * sx * sy) AS qxy, sum(syy - c * sy * sy) AS qyy FROM (SELECT *, ratio / (1 + n * ratio) AS c FROM {rows}) AS g GROUP BY {keys}, ratio),
    e{tag} AS (SELECT *, s11 * qxx - s1x * s1x AS det, (s11 * qxy - s1x * s1y) / (s11 * qxx - s1x * s1x) AS slope, (qxx * s1y - s1x * qxy) / (s11 * qxx - s1x * s1x) AS intercept FROM s{tag} WHERE nn > 2 AND s11 * qxx - s1x * s1x > 0),
    f{tag} AS (SELECT *, (qyy - intercept * s1y - slope * qxy) / (nn - 2) AS var FROM e{tag}),
    h{tag} AS (SELECT {keys}, arg_max(struct_pack(ratio := ratio, slope := slope, se := sqrt(var * s11 / det), nn := nn), -5e-1 * (logd + ln(det) + (nn - 2) * ln(var))) AS b FROM f{tag} GROUP BY {keys})"""

    fine = f"(SELECT per.*, u.ratio FROM per JOIN h0 USING ({keys}), LATERAL (SELECT DISTINCT b.ratio * power(1e1, k / {10 * refine}e0) AS ratio FROM range(-{refine}, {refine} + 1) r(k)) AS u)"
    tail = "2 / sqrt(2 * pi()) * 12e0 / 12000 * list_sum(list_transform(range(0, 4001), lambda k: (CASE WHEN k = 0 OR k = 4000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * exp(-5e-1 * power(z + k * 12e0 / 4000, 2))))"
    return f"""{one(0, f'(SELECT * FROM per, {GRIDL} AS r)')}, {one(1, fine)},
    mm AS (SELECT {keys}, b.slope AS slope, b.se AS se, CAST(b.nn AS BIGINT) AS n, {tail} AS p FROM (SELECT *, abs(b.slope / b.se) AS z FROM h1) AS t)"""


PER = "count(*)::DOUBLE AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy, sum(y * y) AS syy"
#: Single steps and ranges of steps, in tenths of a degree.
SLICES = [("at 1", 10, 10), ("0.5 to 1.5", 5, 15), ("-6 to -2", -60, -20), ("1 to 10", 10, 100), ("all", -100, 100)]
SLICED = f"""{ZP.replace("zz AS (SELECT * FROM z WHERE", "zz AS (SELECT layer, axis, range, lo, hi, subject_id, floor(x * 1048576e0 + 5e-1) / 1048576e0 AS x, floor(y * 1048576e0 + 5e-1) / 1048576e0 AS y FROM z JOIN rg ON e10 BETWEEN lo AND hi WHERE")}"""


@query("slice_correlation", f"""WITH {PAIRS}, rg(range, lo, hi) AS (VALUES {', '.join(f"('{n}', {a}, {z})" for n, a, z in SLICES)}), {SLICED}, {QUAD.replace('layer, axis', 'layer, axis, range')},
    per AS (SELECT layer, axis, range, subject_id, {PER} FROM zz WHERE lo < hi GROUP BY layer, axis, range, subject_id), {reml('layer, axis, range')},
    s AS {rho_sql('zz', 'layer, axis, range', 'x', 'y')}
    SELECT layer, axis, range, s.rho, s.n, CASE WHEN s.n > 2 THEN {r_tail('s.rho', 's.n', narrow=True)} END AS rho_p, q.r AS pearson, qq.p AS binomial_p, mm.slope, mm.p AS slope_p
    FROM s JOIN q USING (layer, axis, range) JOIN qq USING (layer, axis, range) LEFT JOIN mm USING (layer, axis, range)""", rounded="rho rho_p pearson binomial_p slope slope_p", digits=4)
def _(b):
    """Every layer on every slice; the mixed model needs a slice of several steps."""
    keys = ["layer", "axis", "range"]
    z = zpairs(b)
    for c in ("density", "thickness"):  # equal readings must stay ties after scaling
        z = z.withColumn(c, F.floor(F.col(c) * 1048576.0 + 0.5) / 1048576.0)
    t = stats.in_ranges(z, "e10", SLICES)
    s = stats.spearman(t, keys, "density", "thickness").withColumnRenamed("p", "rho_p")
    q = stats.quadrants(t, keys, "density", "thickness").select(*keys, F.col("r").alias("pearson"), F.col("p").alias("binomial_p"))
    per = stats.range_moments(z, keys[:2], "subject_id", "e10", "density", "thickness", [r for r in SLICES if r[1] < r[2]], -100, 100)
    m = stats.random_intercept_of(per, keys).select(*keys, "slope", F.col("p").alias("slope_p"))
    return s.join(q, keys).join(m, keys, "left")


@query("mixed_model_random_intercept", f"""WITH {PAIRS}, {ZP}, per AS (SELECT layer, axis, subject_id, {PER} FROM zz GROUP BY layer, axis, subject_id), {reml('layer, axis')}
    SELECT layer, axis, n, slope, se, p FROM mm""", rounded="slope se p", digits=4)
def _(b):
    return stats.random_intercept(zpairs(b), ["layer", "axis"], "subject_id", "density", "thickness").select("layer", "axis", "n", "slope", "se", "p")


@query("mixed_model_grid", f"""WITH {PAIRS}, {ZP}, per AS (SELECT layer, axis, subject_id, CAST(count(*) AS DOUBLE) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy, sum(y * y) AS syy FROM zz GROUP BY ALL),
    g AS (SELECT per.*, ratio, ratio / (1 + n * ratio) AS c FROM per, {GRIDL} AS r),
    s AS (SELECT layer, axis, ratio, sum(n) AS nn, sum(ln(1 + n * ratio)) AS logd, sum(n - c * n * n) AS s11, sum(sx - c * n * sx) AS s1x, sum(sxx - c * sx * sx) AS qxx, sum(sy - c * n * sy) AS s1y,
        sum(sxy - c * sx * sy) AS qxy, sum(syy - c * sy * sy) AS qyy FROM g GROUP BY ALL),
    e AS (SELECT *, s11 * qxx - s1x * s1x AS det, (s11 * qxy - s1x * s1y) / (s11 * qxx - s1x * s1x) AS slope, (qxx * s1y - s1x * qxy) / (s11 * qxx - s1x * s1x) AS intercept FROM s),
    f AS (SELECT *, (qyy - intercept * s1y - slope * qxy) / (nn - 2) AS var FROM e),
    h AS (SELECT *, -5e-1 * (logd + ln(det) + (nn - 2) * ln(var)) AS ll FROM f)
    SELECT layer, axis, arg_max(slope, ll) AS slope, arg_max(sqrt(var * s11 / det), ll) AS se, CAST(max(nn) AS BIGINT) AS n FROM h GROUP BY layer, axis""", rounded="slope se")
def _(b):
    """The grid pass alone (refinement window of width zero)."""
    m = stats.random_intercept(zpairs(b), ["layer", "axis"], "subject_id", "density", "thickness", refine=0)
    return m.select("layer", "axis", "slope", "se", "n")


@query("goodness_of_fit", """WITH d AS (SELECT subject_id, axis, density AS y, 1.2e6 / (10 + abs(e10)) + 5000 AS f FROM v_profile)
    SELECT subject_id, axis, count(*) AS n, 1 - sum((y - f) * (y - f)) / (var_pop(y) * count(*)) AS r2 FROM d GROUP BY subject_id, axis HAVING count(*) > 1""", rounded="r2")
def _(b):
    t = b.v_profile.withColumn("fitted", 1.2e6 / (10 + F.abs("e10")) + 5000)
    return stats.goodness_of_fit(t, ["subject_id", "axis"], "density", "fitted")


@query("winsorize", """WITH r AS (SELECT subject_id, axis, e10, density, row_number() OVER (PARTITION BY axis ORDER BY density, subject_id, e10) - 1 AS i, count(*) OVER (PARTITION BY axis) AS n FROM v_profile),
    l AS (SELECT axis, max(density) FILTER (i = floor(5e-2 * n)) AS lo, max(density) FILTER (i = n - floor(5e-2 * n) - 1) AS hi FROM r GROUP BY axis)
    SELECT subject_id, axis, e10, least(greatest(density, lo), hi) AS density FROM r JOIN l USING (axis)""")
def _(b):
    return stats.winsorize(b.v_profile, ["axis"], "density").select("subject_id", "axis", "e10", "density")
