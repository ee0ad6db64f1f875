"""Aggregations, strata and bands over the bound views."""

from pyspark.sql import functions as F

from eccentra.functions import geometry as G
from eccentra.operators import cells, cohort, images, joins, montage, ordered, profiles, smoothing
from eccentra.plans.q_ordered import robust_lowess
from eccentra.plans.q_projection import parsed
from eccentra.plans.registry import query
from eccentra.session import cut

KEY = ["subject_id", "session_id", "axis"]


@query("mean_thickness_by_ecc", """SELECT subject_id, session_id, layer, axis, e10, avg(thickness) AS thickness, count(*) AS n
    FROM v_obs WHERE thickness > 0 GROUP BY subject_id, session_id, layer, axis, e10""")
def _(b):
    return b.v_obs.filter("thickness > 0").groupBy("subject_id", "session_id", "layer", "axis", "e10").agg(
        F.avg("thickness").alias("thickness"), F.count("*").alias("n"))


SECTOR = """sec AS (SELECT p.*, a.axis, CAST(CASE WHEN (CASE WHEN a.axis = 'X' THEN x - 360 ELSE y - 360 END) < 0 THEN -1 ELSE 1 END
        * round_even(sqrt((x - 360) * (x - 360) + (y - 360) * (y - 360)) / 480e0 * 10, 0) AS INT) AS e10
      FROM (SELECT *, abs(round_even((x - 360) / 480e0 * 10, 0)) / 10e0 AS ax, abs(round_even((y - 360) / 480e0 * 10, 0)) / 10e0 AS ay FROM v_points) AS p,
           (VALUES ('X'), ('Y')) AS a(axis)
      WHERE CASE WHEN a.axis = 'X' THEN ay <= 2e-1 * ax + 200 / 480e0 ELSE ax <= 2e-1 * ay + 200 / 480e0 END)"""
AREA = """area AS (SELECT image_id, axis, CAST(CASE WHEN along < 0 THEN -step ELSE step END AS INT) AS e10, count(*) AS area FROM (
        SELECT image_id, a.axis, CASE WHEN a.axis = 'X' THEN x - 360 ELSE y - 360 END AS along, CASE WHEN a.axis = 'X' THEN y - 360 ELSE x - 360 END AS across,
          least(round_even(sqrt((x - 360) * (x - 360) + (y - 360) * (y - 360)) / 480e0 * 10, 0), round_even(360 / 480e0 * 10, 0)) AS step
        FROM v_pixels, (VALUES ('X'), ('Y')) AS a(axis)) AS t WHERE abs(across) <= 2e-1 * abs(along) + 200 GROUP BY ALL)"""


@query("point_counts_by_ecc", f"WITH {SECTOR} SELECT image_id, axis, e10, count(*) AS n_points FROM sec GROUP BY ALL")
def _(b):
    return cells.point_counts(b.v_points, ["image_id"], 360, 360)


@query("point_counts_masked", f"""WITH {SECTOR} SELECT image_id, axis, e10, count(*) AS n_points FROM sec s
    WHERE EXISTS (SELECT 1 FROM v_pixels m WHERE m.image_id = s.image_id AND m.x = s.x AND m.y = s.y) GROUP BY ALL""")
def _(b):
    return cells.point_counts(b.v_points, ["image_id"], 360, 360, mask=b.v_pixels)


@query("area_by_ecc", f"WITH {AREA} SELECT image_id, axis, e10, area FROM area")
def _(b):
    return cells.mask_areas(b.v_pixels, ["image_id"], 360, 360)


STEPS = f"""{SECTOR}, {AREA},
    near AS (SELECT image_id, axis, e10, count(*) AS n FROM sec WHERE source = 'near' GROUP BY ALL),
    far AS (SELECT image_id, axis, e10, count(*) AS n FROM sec WHERE source = 'far' GROUP BY ALL),
    target AS (SELECT f.image_id, f.axis, f.n, CASE WHEN EXISTS (SELECT 1 FROM area a WHERE a.image_id = f.image_id AND a.axis = f.axis AND a.e10 = f.e10) THEN f.e10
        WHEN f.e10 <= 0 THEN (SELECT min(a.e10) FROM area a WHERE a.image_id = f.image_id AND a.axis = f.axis AND a.e10 > f.e10 AND a.e10 <= 1) END AS e10 FROM far f),
    moved AS (SELECT image_id, axis, e10, CAST(sum(n) AS BIGINT) AS n FROM target WHERE e10 IS NOT NULL GROUP BY ALL)"""


@query("relocate_orphan_counts", f"WITH {STEPS} SELECT image_id, axis, e10, n AS n_points FROM moved")
def _(b):
    far = cells.point_counts(b.v_points.filter("source = 'far'"), ["image_id"], 360, 360)
    steps = far.join(cells.mask_areas(b.v_pixels, ["image_id"], 360, 360), ["image_id", "axis", "e10"], "full").withColumn(
        "n_points", F.coalesce("n_points", F.lit(0)))
    return cells.relocate_orphans(steps, ["image_id", "axis"], "n_points", "area").filter("n_points > 0")


@query("density_by_ecc", f"""
    WITH {STEPS}, d AS (SELECT a.image_id, a.axis, a.e10, CASE WHEN abs(a.e10) / 10e0 > 2e-1 THEN power(480 / 291e-3, 2) * coalesce(m.n, 0) / a.area END AS far_density,
        CASE WHEN abs(a.e10) / 10e0 < 5e-1 THEN power(480 / 291e-3, 2) * coalesce(n.n, 0) / a.area END AS near_density
      FROM area a LEFT JOIN moved m USING (image_id, axis, e10) LEFT JOIN near n USING (image_id, axis, e10) WHERE a.area > 2)
    SELECT image_id, axis, e10, near_density, far_density, CASE WHEN near_density IS NOT NULL AND far_density IS NOT NULL THEN (near_density + far_density) / 2
      ELSE coalesce(far_density, near_density) END AS density FROM d""", rounded="near_density far_density density", digits=3)
def _(b):
    near = cells.point_counts(b.v_points.filter("source = 'near'"), ["image_id"], 360, 360)
    far = cells.point_counts(b.v_points.filter("source = 'far'"), ["image_id"], 360, 360)
    areas = cells.mask_areas(b.v_pixels, ["image_id"], 360, 360)
    return cells.density_by_step(near, far, areas, ["image_id", "axis"], threshold=2, near_limit=0.5, far_limit=0.2)


@query("profile_range", """SELECT subject_id, least(min(p_lo), min(l_lo)) AS first_step, greatest(max(p_hi), max(l_hi)) AS last_step FROM
    (SELECT subject_id, min(e10) AS p_lo, max(e10) AS p_hi FROM v_profile GROUP BY subject_id) JOIN
    (SELECT subject_id, min(e10) AS l_lo, max(e10) AS l_hi FROM v_layer_profile WHERE layer <> 'RNFL' GROUP BY subject_id) USING (subject_id) GROUP BY subject_id""")
def _(b):
    p = b.v_profile.groupBy("subject_id").agg(F.min("e10").alias("a"), F.max("e10").alias("z"))
    layer = b.v_layer_profile.filter("layer <> 'RNFL'").groupBy("subject_id").agg(F.min("e10").alias("la"), F.max("e10").alias("lz"))
    return p.join(layer, "subject_id").select("subject_id", F.least("a", "la").alias("first_step"), F.greatest("z", "lz").alias("last_step"))


MS = "median(value) AS median, stddev_samp(value) AS std, count(*) AS n"
LONG = """(SELECT subject_id, axis, e10, 'density' AS feature, density AS value FROM v_profile UNION ALL
           SELECT subject_id, axis, e10, 'thickness', thickness FROM v_profile WHERE thickness IS NOT NULL)"""


@query("median_std_by_location", f"SELECT axis, e10, feature, {MS} FROM {LONG} AS t GROUP BY axis, e10, feature", rounded="median std")
def _(b):
    return cohort.median_std(b.v_profile, ["axis", "e10"], ["density", "thickness"])


def _strat_sql(label):
    return f"""WITH s AS (SELECT *, (visit_date - birth_date) / 365e0 AS age, CASE WHEN laterality = 'OD' THEN axial_right ELSE axial_left END AS axial_length,
          CASE WHEN laterality = 'OD' THEN sphere_right ELSE sphere_left END AS sphere FROM v_baseline),
        t AS (SELECT {label} AS stratum, subject_id FROM s)
        SELECT stratum, axis, e10, feature, {MS} FROM {LONG} AS l JOIN t USING (subject_id) WHERE stratum IS NOT NULL GROUP BY stratum, axis, e10, feature"""


AGE_SQL = "CASE WHEN age >= 20 AND age < 35 THEN '20-35' WHEN age >= 35 AND age < 50 THEN '35-50' WHEN age >= 50 AND age <= 65 THEN '50-65' END"
AGE_BINS = [20, 35, 50, 65]


def _strat(b, stratum):
    return cohort.stratified(cohort.join_baseline(b.v_profile, b.v_baseline), stratum, ["axis", "e10"], ["density", "thickness"])


@query("stratify_age", _strat_sql(AGE_SQL), rounded="median std")
def _(b):
    return _strat(b, cohort.half_open_bins(F.col("age"), AGE_BINS))


@query("stratify_axial", _strat_sql("CASE WHEN axial_length >= 21 AND axial_length < 23 THEN '21-23' WHEN axial_length >= 23 AND axial_length < 24 THEN '23-24' "
                                    "WHEN axial_length >= 24 AND axial_length < 25 THEN '24-25' WHEN axial_length >= 25 AND axial_length <= 29 THEN '25-29' END"), rounded="median std")
def _(b):
    return _strat(b, cohort.half_open_bins(F.col("axial_length"), [21, 23, 24, 25, 29]))


@query("stratify_spherical", _strat_sql("CASE WHEN sphere BETWEEN -712e-2 AND -312e-2 THEN '-7.12..-3.12' WHEN sphere BETWEEN -15e-1 AND -112e-2 THEN '-1.5..-1.12' "
                                        "WHEN sphere BETWEEN 212e-2 AND 537e-2 THEN '2.12..5.37' END"), rounded="median std")
def _(b):
    return _strat(b, cohort.closed_intervals(F.col("sphere"), [(-7.12, -3.12), (-1.5, -1.12), (2.12, 5.37)]))


@query("stratify_sex", _strat_sql("sex"), rounded="median std")
def _(b):
    return _strat(b, F.col("sex"))


@query("stratify_visit_date", _strat_sql("CASE WHEN visit_date < DATE '2021-07-01' THEN 'before 2021-07' WHEN visit_date <= DATE '2022-01-01' THEN '2021-07 to 2022-01' ELSE 'after 2022-01' END"), rounded="median std")
def _(b):
    return _strat(b, cohort.visit_period(F.col("visit_date")))


@query("stratum_size", f"""WITH s AS (SELECT subject_id, (visit_date - birth_date) / 365e0 AS age FROM v_baseline)
    SELECT {AGE_SQL} AS stratum, count(DISTINCT subject_id) AS n_subjects FROM s WHERE subject_id IN (SELECT subject_id FROM v_profile) AND {AGE_SQL} IS NOT NULL GROUP BY ALL""")
def _(b):
    return cohort.stratum_sizes(cohort.join_baseline(b.v_profile, b.v_baseline), cohort.half_open_bins(F.col("age"), AGE_BINS))


@query("percentile_band", """SELECT axis, e10, layer, CASE WHEN ok THEN median END AS median, CASE WHEN ok THEN lower END AS lower, CASE WHEN ok THEN upper END AS upper FROM (
      SELECT axis, e10, layer, median(v) AS median, quantile_cont(v, 15e-2) AS lower, quantile_cont(v, 85e-2) AS upper, avg(CASE WHEN v IS NULL THEN 1e0 ELSE 0e0 END) < 5e-1 AS ok
      FROM (SELECT axis, e10, layer, CASE WHEN thickness > 25 THEN thickness END AS v FROM v_layer_profile) AS t GROUP BY axis, e10, layer)""", rounded="median lower upper")
def _(b):
    t = b.v_layer_profile.select("axis", "e10", "layer", F.when(F.col("thickness") > 25, F.col("thickness")).alias("v"))
    return cohort.percentile_band(t, ["axis", "e10", "layer"], "v")


BANDED = """base AS (SELECT subject_id, axis, e10, density FROM v_profile),
    long AS (SELECT subject_id, axis, e10, 'density' AS feature, density AS v FROM base UNION ALL
      SELECT b.subject_id, b.axis, b.e10, f.feature, l.thickness FROM base b CROSS JOIN (VALUES ('GCL+IPL'), ('Choroid'), ('RNFL')) f(feature)
      LEFT JOIN v_layer_profile l ON l.subject_id = b.subject_id AND l.axis = b.axis AND l.e10 = b.e10 AND l.layer = f.feature),
    oth AS (SELECT a.subject_id, a.axis, a.e10, a.feature, a.v, median(o.v) AS median, quantile_cont(o.v, 15e-2) AS lower, quantile_cont(o.v, 85e-2) AS upper,
        count(*) FILTER (o.subject_id IS NOT NULL AND o.v IS NULL) < 5e-1 * count(o.subject_id) AS most
      FROM long a LEFT JOIN long o ON o.axis = a.axis AND o.e10 = a.e10 AND o.feature = a.feature AND o.subject_id <> a.subject_id GROUP BY a.subject_id, a.axis, a.e10, a.feature, a.v),
    band AS (SELECT subject_id, axis, e10, feature, v AS result, CASE WHEN most THEN median END AS median, CASE WHEN most THEN lower END AS lower, CASE WHEN most THEN upper END AS upper FROM oth)"""


@query("compare_to_band", f"""WITH {BANDED}, curves AS MATERIALIZED (SELECT subject_id, axis, feature, e10, u.curve, u.w FROM band, LATERAL (VALUES ('result', result), ('median', median), ('lower', lower), ('upper', upper)) u(curve, w)),
    {robust_lowess("(SELECT * FROM curves WHERE feature <> 'density')", 'subject_id, axis, feature, curve', '(e10 / 10e0)', 'w')},
    every AS (SELECT subject_id, axis, feature, e10, curve, fit FROM lw UNION ALL SELECT subject_id, axis, feature, e10, curve, w FROM curves WHERE feature = 'density')
    SELECT subject_id, axis, e10, feature, max(fit) FILTER (curve = 'result') AS result, max(fit) FILTER (curve = 'median') AS median, max(fit) FILTER (curve = 'lower') AS lower, max(fit) FILTER (curve = 'upper') AS upper
    FROM every GROUP BY subject_id, axis, e10, feature""", rounded="result median lower upper", digits=3)
def _(b):
    """Every subject against all others, density and layers alike; layers' curves are smoothed."""
    key = ["subject_id", "axis", "e10"]
    base = b.v_profile.select(*key, "density")
    layers = base.select(*key, F.explode(F.array(*[F.lit(x) for x in ("GCL+IPL", "Choroid", "RNFL")])).alias("feature")).join(
        b.v_layer_profile.select(*key, F.col("layer").alias("feature"), F.col("thickness").alias("result")), [*key, "feature"], "left")
    long = layers.unionByName(base.select(*key, F.lit("density").alias("feature"), F.col("density").alias("result")))
    band = cut(cohort.leave_one_out_bands(long, ["axis", "e10", "feature"], "result"))
    names = ["result", "median", "lower", "upper"]
    curves = band.filter("feature <> 'density'").withColumn("x", F.col("e10") / 10.0)
    smooth = smoothing.lowess(curves, ["subject_id", "axis", "feature"], "x", names, everywhere=True)
    wide = smooth.select("subject_id", "axis", F.round(F.col("x") * 10).cast("int").alias("e10"), "feature", *names)
    return wide.unionByName(band.filter("feature = 'density'").select(*wide.columns))


@query("central_summary", """SELECT subject_id, axis, avg(density) AS density_mean, median(density) AS density_median, stddev_samp(density) AS density_std,
    avg(thickness) AS thickness_mean, median(thickness) AS thickness_median, stddev_samp(thickness) AS thickness_std
    FROM v_profile WHERE abs(e10) <= 40 AND e10 <> 0 GROUP BY subject_id, axis""", rounded="density_mean density_median density_std thickness_mean thickness_median thickness_std")
def _(b):
    """One subject and axis has at most 80 steps here, so plain medians do."""
    aggs = [f(c).alias(f"{c}_{n}") for c in ("density", "thickness") for n, f in (("mean", F.avg), ("median", F.median), ("std", F.stddev_samp))]
    return b.v_profile.filter("abs(e10) <= 40 AND e10 <> 0").groupBy("subject_id", "axis").agg(*aggs)


RANGES = [("fovea", -5, 5), ("left_side", -30, -5), ("right_side", 5, 30)]


@query("range_mean", """SELECT subject_id, avg(density) FILTER (e10 BETWEEN -5 AND 5) AS fovea, avg(density) FILTER (e10 BETWEEN -30 AND -5) AS left_side,
    avg(density) FILTER (e10 BETWEEN 5 AND 30) AS right_side FROM v_profile WHERE abs(e10) <= 30 GROUP BY subject_id""", rounded="fovea left_side right_side")
def _(b):
    cols = [F.avg(F.when(F.col("e10").between(lo, hi), F.col("density"))).alias(n) for n, lo, hi in RANGES]
    return b.v_profile.filter("abs(e10) <= 30").groupBy("subject_id").agg(*cols)


@query("step_median", """
    WITH m AS (SELECT subject_id, axis, CAST(floor(ecc * 10 + 5e-1) AS INT) AS e10, median(density) AS density FROM v_raw_density
      WHERE abs(ecc * 10 - floor(ecc * 10 + 5e-1)) < 5e-1 AND abs(floor(ecc * 10 + 5e-1)) <= 100 GROUP BY ALL),
    k AS (SELECT DISTINCT subject_id, axis FROM m)
    SELECT k.subject_id, k.axis, CAST(g.e AS INT) AS e10, m.density FROM k CROSS JOIN range(-100, 101) g(e) LEFT JOIN m ON m.subject_id = k.subject_id AND m.axis = k.axis AND m.e10 = g.e""")
def _(b):
    return profiles.step_median(b.v_raw_density, ["subject_id", "axis"], F.col("ecc"), "density")


@query("normalise_by_max", "SELECT subject_id, axis, e10, density / max(density) OVER (PARTITION BY subject_id, session_id, axis) AS relative FROM v_profile")
def _(b):
    top = b.v_profile.groupBy(*KEY).agg(F.max("density").alias("top"))
    return b.v_profile.join(top, KEY).select("subject_id", "axis", "e10", (F.col("density") / F.col("top")).alias("relative"))


@query("mean_profile", """WITH n AS (SELECT *, density / max(density) OVER (PARTITION BY subject_id, session_id, axis) AS relative FROM v_profile)
    SELECT e10, avg(density) FILTER (axis = 'X') AS mean_x, avg(density) FILTER (axis = 'Y') AS mean_y, avg(density) AS mean_both, avg(relative) AS relative_both FROM n GROUP BY e10""",
       rounded="mean_x mean_y mean_both relative_both")
def _(b):
    top = b.v_profile.groupBy(*KEY).agg(F.max("density").alias("top"))
    n = b.v_profile.join(top, KEY)
    x, y = (F.avg(F.when(F.col("axis") == a, F.col("density"))) for a in "XY")
    return n.groupBy("e10").agg(x.alias("mean_x"), y.alias("mean_y"), F.avg("density").alias("mean_both"),
                                F.avg(F.col("density") / F.col("top")).alias("relative_both"))


@query("profile_extreme", "SELECT subject_id, axis, max(density) AS top, min(density) AS bottom FROM v_profile GROUP BY subject_id, axis")
def _(b):
    return b.v_profile.groupBy("subject_id", "axis").agg(F.max("density").alias("top"), F.min("density").alias("bottom"))


@query("ratio_at_radii", """
    WITH m AS (SELECT axis, e10, avg(density) AS d FROM v_profile GROUP BY axis, e10),
    r AS (SELECT * FROM (VALUES (15e-2), (3e-1), (12e-1)) AS t(radius)),
    p AS (SELECT radius, axis, s.s AS side, arg_min(d, e10) AS d FROM r, m, (VALUES (1), (-1)) s(s) WHERE e10 / 10e0 * 291e-3 >= s.s * radius GROUP BY ALL)
    SELECT radius, avg(d) AS mean_density FROM p GROUP BY radius""", rounded="mean_density")
def _(b):
    m = b.v_profile.groupBy("axis", "e10").agg(F.avg("density").alias("d"))
    points = F.explode(F.array(*[F.struct(F.lit(r).alias("radius"), F.lit(s).alias("side")) for r in (0.15, 0.3, 1.2) for s in (1, -1)]))
    p = m.withColumn("_p", points).select("axis", "e10", "d", "_p.*").filter(F.col("e10") / 10.0 * 0.291 >= F.col("side") * F.col("radius"))
    first = p.groupBy("radius", "axis", "side").agg(F.min_by("d", "e10").alias("d"))
    return first.groupBy("radius").agg(F.avg("d").alias("mean_density"))


@query("cohort_cov", """WITH s AS (SELECT subject_id, axis, max(density) AS v FROM v_profile GROUP BY ALL)
    SELECT axis, avg(v) AS mean, stddev_pop(v) AS std, min(v) AS low, max(v) AS high, stddev_pop(v) / avg(v) * 100 AS cov FROM s GROUP BY axis""", rounded="mean std cov")
def _(b):
    s = b.v_profile.groupBy("subject_id", "axis").agg(F.max("density").alias("v"))
    return s.groupBy("axis").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("low"), F.max("v").alias("high"),
                                 (F.stddev_pop("v") / F.avg("v") * 100).alias("cov"))


@query("value_histogram", "SELECT tile_id, CAST(floor(v) AS INT) AS level, count(*) AS n FROM v_tile GROUP BY ALL")
def _(b):
    return images.level_histogram(b.v_tile, ["tile_id"])


@query("count_histogram", """WITH c AS (SELECT image_id, x % 40 AS g, count(*) AS n FROM v_points GROUP BY ALL), m AS (SELECT image_id, max(n) AS m FROM c GROUP BY image_id)
    SELECT image_id, least(n, m - 1) AS bin, count(*) AS n_patches FROM c JOIN m USING (image_id) GROUP BY image_id, least(n, m - 1)""")
def _(b):
    c = b.v_points.groupBy("image_id", (F.col("x") % 40).alias("g")).agg(F.count("*").alias("n"))
    return images.count_histogram(c, ["image_id"], "n")


@query("histogram_stats", """
    WITH h AS (SELECT label, CAST(floor(v) AS INT) AS level, count(*) AS n FROM v_tile GROUP BY ALL),
    m AS (SELECT label, sum(n * (level + 5e-1)) / sum(n) AS mean, sum(n) AS total FROM h GROUP BY label),
    c AS (SELECT label, level, sum(n) OVER (PARTITION BY label ORDER BY level) AS run FROM h),
    d AS (SELECT label, min(level) + 5e-1 AS median FROM c JOIN m USING (label) WHERE run >= total / 2 GROUP BY label)
    SELECT label, mean, sum(n * power(level + 5e-1 - mean, 2)) / sum(n) AS var, median FROM h JOIN m USING (label) JOIN d USING (label) GROUP BY label, mean, median""", rounded="mean var")
def _(b):
    return images.histogram_stats(images.level_histogram(b.v_tile, ["label"]), ["label"])


@query("robust_mode_stats", """
    WITH r AS (SELECT label, min(v) AS lo, max(v) AS hi, stddev_pop(v) AS std, (max(v) - min(v)) / 100 AS w FROM v_tile GROUP BY label),
    h AS (SELECT label, least(99, CAST(floor((v - lo) / (hi - lo) * 100) AS INT)) AS bin, count(*) AS n FROM v_tile JOIN r USING (label) GROUP BY label, least(99, CAST(floor((v - lo) / (hi - lo) * 100) AS INT))),
    s AS (SELECT r.label, g.i, coalesce((SELECT sum(n) FROM h WHERE h.label = r.label AND h.bin BETWEEN g.i - 4 AND g.i), 0) / 5e0 AS m FROM r, range(0, 104) g(i)),
    t AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY m DESC, i DESC) AS k FROM s),
    p AS (SELECT label, max(i) FILTER (k = 1) AS i1, max(m) FILTER (k = 1) AS m1, max(i) FILTER (k = 2) AS i0, max(m) FILTER (k = 2) AS m0 FROM t GROUP BY label)
    SELECT label, CASE WHEN m1 > m0 * 2 THEN lo + w * least(i1, 100) ELSE (lo + w * least(least(i0, i1), 100) + lo + w * least(greatest(i0, i1) + 1, 100)) / 2 END AS mode, std
    FROM p JOIN r USING (label)""", rounded="mode std")
def _(b):
    return images.robust_mode(b.v_tile, ["label"], "v")


@query("tile_density", """
    WITH n AS (SELECT image_id, CAST(floor(y / 90) AS INT) AS ty, CAST(floor(x / 90) AS INT) AS tx, count(*) AS n FROM v_points GROUP BY ALL),
    a AS (SELECT image_id, CAST(floor(y / 90) AS INT) AS ty, CAST(floor(x / 90) AS INT) AS tx, count(*) AS n FROM v_pixels WHERE v > 0 GROUP BY ALL),
    j AS (SELECT image_id, ty, tx, coalesce(n.n, 0) AS np, coalesce(a.n, 0) AS na, coalesce(a.n, 0) / 90e0 / 90 AS ratio FROM n FULL JOIN a USING (image_id, ty, tx))
    SELECT image_id, ty, tx, CASE WHEN ratio >= 1e-3 THEN np ELSE 0 END AS n_points, CASE WHEN ratio >= 1e-3 THEN na ELSE 0 END AS bright_area, ratio AS bright_ratio,
      CASE WHEN ratio >= 1e-3 AND na > 0 THEN np / CAST(na AS DOUBLE) ELSE 0 END / power(6e-1 / 1000, 2) AS density FROM j""", rounded="bright_ratio density", digits=3)
def _(b):
    return cells.tile_density(b.v_points, b.v_pixels, ["image_id"], 90, 0.6, min_bright=1e-3)


@query("detection_extent_ok", """
    WITH a AS (SELECT image_id, count(*) AS area FROM v_pixels WHERE v > 0 GROUP BY image_id),
    p AS (SELECT image_id, CAST((max(x) - min(x)) * (max(y) - min(y)) AS BIGINT) AS covered FROM v_points GROUP BY image_id)
    SELECT image_id, area * 900 AS area, covered, coalesce(covered > floor(area * 900 / 2), FALSE) AS detected_well FROM a LEFT JOIN p USING (image_id)""")
def _(b):
    areas = b.v_pixels.filter("v > 0").groupBy("image_id").agg((F.count("*") * 900).alias("area"))
    return cells.extent_ok(b.v_points, areas, ["image_id"])


@query("points_per_patch", "SELECT image_id, source, CAST(floor(x / 185) AS INT) AS px, CAST(floor(y / 185) AS INT) AS py, count(*) AS n FROM v_points GROUP BY ALL")
def _(b):
    return b.v_points.groupBy("image_id", "source", cells.tile_of("x", 185).alias("px"), cells.tile_of("y", 185).alias("py")).agg(F.count("*").alias("n"))


@query("mosaic_bounds", """
    WITH c AS (SELECT mosaic_id, a11 * cx.c + a12 * cy.c + a13 AS x, a21 * cx.c + a22 * cy.c + a23 AS y FROM v_elements, (VALUES (0), (720)) cx(c), (VALUES (0), (720)) cy(c))
    SELECT mosaic_id, CAST(ceil(max(x)) AS BIGINT) AS max_x, CAST(ceil(max(y)) AS BIGINT) AS max_y, CAST(floor(min(x)) AS BIGINT) AS min_x, CAST(floor(min(y)) AS BIGINT) AS min_y FROM c GROUP BY mosaic_id""")
def _(b):
    return montage.mosaic_bounds(b.v_elements, "mosaic_id")


@query("filled_bounds", 'SELECT image_id, min(y) AS top, max(y) AS bottom, min(x) AS "left", max(x) AS "right" FROM v_pixels WHERE v <> 0 GROUP BY image_id')
def _(b):
    return b.v_pixels.filter("v <> 0").groupBy("image_id").agg(F.min("y").alias("top"), F.max("y").alias("bottom"), F.min("x").alias("left"), F.max("x").alias("right"))


@query("group_patches_by_image", r"""SELECT regexp_replace(file_name, '^CROP_\d+_x\d+y\d+_', '') AS image_name, file_no, file_name, count(*) OVER (PARTITION BY regexp_replace(file_name, '^CROP_\d+_x\d+y\d+_', '')) AS n_patches FROM v_files""")
def _(b):
    files = b.v_files.select(F.regexp_replace("file_name", r"^CROP_\d+_x\d+y\d+_", "").alias("image_name"), "file_no", "file_name")
    # one row per member with the size of its group
    return files.join(files.groupBy("image_name").agg(F.count("*").alias("n_patches")), "image_name")


@query("axis_comparison", f"""WITH m AS (SELECT axis, e10, median(density) AS m, stddev_samp(density) AS s FROM v_profile GROUP BY axis, e10)
    SELECT e10, max(m) FILTER (axis = 'X') AS median_x, max(s) FILTER (axis = 'X') AS std_x, max(m) FILTER (axis = 'Y') AS median_y, max(s) FILTER (axis = 'Y') AS std_y FROM m GROUP BY e10""", rounded="median_x median_y std_x std_y")
def _(b):
    m = cohort.median_std(b.v_profile, ["axis", "e10"], ["density"])
    cols = [F.max(F.when(F.col("axis") == a.upper(), F.col(c))).alias(f"{c}_{a}") for a in "xy" for c in ("median", "std")]
    return m.groupBy("e10").agg(*cols)


@query("chain_center", """
    WITH RECURSIVE r(node, root) AS (SELECT node, node FROM v_matches WHERE parent = node UNION ALL SELECT m.node, r.root FROM v_matches m JOIN r ON m.parent = r.node WHERE m.parent <> m.node)
    SELECT root, median(CAST(x AS DOUBLE)) AS cx, median(CAST(y AS DOUBLE)) AS cy FROM r JOIN v_elements ON element_id = node GROUP BY root""")
def _(b):
    from eccentra.operators import graph
    chains = graph.chain_roots(b.v_matches, "node", "parent")
    p = chains.join(b.v_elements.select(F.col("element_id").alias("node"), F.col("x").cast("double"), F.col("y").cast("double")), "node")
    cx = ordered.quantiles(p, ["root"], "x", {"cx": 0.5})
    cy = ordered.quantiles(p, ["root"], "y", {"cy": 0.5})
    return cx.join(cy, "root")


@query("confusion_scores", """
    WITH t AS (SELECT axis, count(*) FILTER (density > 5e4 AND n_obs * 3000 < 4819) AS tp, count(*) FILTER (density > 5e4 AND n_obs * 3000 >= 4819) AS fp,
        count(*) FILTER (density <= 5e4 AND n_obs * 3000 < 4819) AS fn, count(*) FILTER (density <= 5e4 AND n_obs * 3000 >= 4819) AS tn FROM v_profile GROUP BY axis)
    SELECT axis, tp, fp, fn, tn, (tp + tn) / CAST(tp + fp + fn + tn AS DOUBLE) AS accuracy, tp / CAST(tp + fp AS DOUBLE) AS "precision", tp / CAST(tp + fn AS DOUBLE) AS recall,
      2 * (tp / CAST(tp + fp AS DOUBLE)) * (tp / CAST(tp + fn AS DOUBLE)) / (tp / CAST(tp + fp AS DOUBLE) + tp / CAST(tp + fn AS DOUBLE)) AS f1 FROM t""", rounded="accuracy recall f1")
def _(b):
    t = b.v_profile.withColumn("area", F.col("n_obs") * 3000)
    return cells.confusion_scores(t, ["axis"], "density", "area", limit=5e4)


@query("area_groups", """SELECT CASE WHEN density > 5e4 THEN 'above' ELSE 'below' END AS side, quantile_cont(thickness, 25e-2) AS q1, median(thickness) AS q2, quantile_cont(thickness, 75e-2) AS q3,
    min(thickness) AS low, max(thickness) AS high FROM v_profile WHERE thickness IS NOT NULL GROUP BY ALL""", rounded="q1 q2 q3")
def _(b):
    t = b.v_profile.filter("thickness IS NOT NULL").withColumn("side", cells.box_groups(b.v_profile, "density", 5e4))
    q = ordered.quantiles(t, ["side"], "thickness", {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    return q.join(t.groupBy("side").agg(F.min("thickness").alias("low"), F.max("thickness").alias("high")), "side")


SETS = """sets AS (SELECT o_custkey AS patient, o_orderkey AS dataset, CAST(o_totalprice AS BIGINT) % 4 * 256 + 256 AS rows_y, CAST(o_orderkey % 3 * 128 + 128 AS BIGINT) AS cols_x, CAST(o_orderkey % 5 * 10 + 1 AS BIGINT) AS slices_z,
      CASE o_orderpriority WHEN '1-URGENT' THEN 'CUBE' WHEN '2-HIGH' THEN 'LINE_0' WHEN '3-MEDIUM' THEN 'LINE_90' ELSE 'OTHER' END AS variant,
      CASE WHEN o_orderkey % 7 = 0 THEN 'L' ELSE 'R' END AS laterality, o_orderkey % 2 AS study FROM orders)"""


def _sets(b):
    o = b.orders
    v = F.when(F.col("o_orderpriority") == "1-URGENT", "CUBE").when(F.col("o_orderpriority") == "2-HIGH", "LINE_0").when(
        F.col("o_orderpriority") == "3-MEDIUM", "LINE_90").otherwise("OTHER")
    return o.select(F.col("o_custkey").alias("patient"), F.col("o_orderkey").alias("dataset"),
                    (F.round("o_totalprice").cast("bigint") % 4 * 256 + 256).alias("rows_y"), (F.col("o_orderkey") % 3 * 128 + 128).alias("cols_x"),
                    (F.col("o_orderkey") % 5 * 10 + 1).alias("slices_z"), v.alias("variant"),
                    F.when(F.col("o_orderkey") % 7 == 0, "L").otherwise("R").alias("laterality"), (F.col("o_orderkey") % 2).alias("study"))


@query("dataset_best_resolution", f"""
    WITH {SETS.replace("CAST(o_totalprice AS BIGINT)", "CAST(round(o_totalprice) AS BIGINT)")}, r AS (SELECT *, rows_y * cols_x * slices_z AS total FROM sets),
    k AS (SELECT *, rank() OVER (PARTITION BY patient ORDER BY rows_y DESC, total DESC) AS k FROM r)
    SELECT patient, min(dataset) AS dataset, any_value(rows_y) AS rows_y, any_value(total) AS total, count(*) AS n_best FROM k WHERE k = 1 GROUP BY patient""")
def _(b):
    return cohort.best_resolution(_sets(b), ["patient"], "dataset", "rows_y", F.col("rows_y") * F.col("cols_x") * F.col("slices_z"))


@query("study_valid", f"""
    WITH {SETS.replace("CAST(o_totalprice AS BIGINT)", "CAST(round(o_totalprice) AS BIGINT)")}
    SELECT patient, study, count(*) FILTER (variant = 'CUBE' AND laterality = 'R') > 0 AND count(*) FILTER (variant = 'LINE_0' AND laterality = 'R') > 0
       AND count(*) FILTER (variant = 'LINE_90' AND laterality = 'R') > 0 AS valid, count(*) AS n_datasets FROM sets GROUP BY patient, study""")
def _(b):
    return cohort.study_validity(_sets(b), ["patient", "study"], "R")
