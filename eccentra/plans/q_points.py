"""Point sets, graphs, paired metrics, clean-up and fits over the bound views."""

from pyspark.sql import Window as W, functions as F

from eccentra.functions import geometry as G
from eccentra.operators import fits, graph, images, joins, montage, points as P
from eccentra.plans.q_join import HIST
from eccentra.plans.q_ordered import DENSE, KEY, dense
from eccentra.plans.registry import query


@query("patch_points_to_image", """SELECT image_id, source, CAST(CASE WHEN inside THEN least(x % 185 + ox, 719) ELSE x % 185 + ox END AS INT) AS image_x, CAST(CASE WHEN inside THEN least(y % 185 + oy, 719) ELSE y % 185 + oy END AS INT) AS image_y, inside
    FROM (SELECT *, x % 185 + ox <= 720 AND y % 185 + oy <= 720 AS inside FROM (
      SELECT *, CAST(floor(x / 185) AS INT) * 178 + 3 AS ox, CAST(floor(y / 185) AS INT) * 180 AS oy FROM v_points) AS t) AS u""")
def _(b):
    t = b.v_points.select("image_id", "source", (F.col("x") % 185).alias("px"), (F.col("y") % 185).alias("py"),
                          (F.floor(F.col("x") / 185).cast("int") * 178 + 3).alias("ox"), (F.floor(F.col("y") / 185).cast("int") * 180).alias("oy"))
    return P.to_image(t, "px", "py", "ox", "oy").select("image_id", "source", "image_x", "image_y", "inside")


def cluster_sql(d):
    return f"""WITH RECURSIVE s AS (SELECT image_id, x, y, count(*) AS n, x * 1048576::BIGINT + y AS id FROM v_points GROUP BY ALL),
      e AS (SELECT a.image_id, a.id AS u, o.id AS v FROM s a JOIN s o USING (image_id) WHERE a.id <> o.id AND power(a.x - o.x, 2) + power(a.y - o.y, 2) <= {d * d}),
      r(image_id, id, lab) AS (SELECT image_id, id, id FROM s UNION SELECT r.image_id, e.v, r.lab FROM r JOIN e ON e.image_id = r.image_id AND e.u = r.id),
      c AS (SELECT image_id, id, min(lab) AS lab FROM r GROUP BY ALL)
      SELECT s.image_id, CAST(round_even(sum(x * n) / CAST(sum(n) AS DOUBLE), 0) AS INT) AS x, CAST(round_even(sum(y * n) / CAST(sum(n) AS DOUBLE), 0) AS INT) AS y, CAST(sum(n) AS BIGINT) AS n_points
      FROM s JOIN c USING (image_id, id) GROUP BY s.image_id, lab"""


@query("merge_close_points_dbscan", cluster_sql(9))
def _(b):
    return P.merge_close(b.v_points, ["image_id"], 9)


@query("merge_close_points_single_link", cluster_sql(7))
def _(b):
    return P.merge_close(b.v_points, ["image_id"], 7)


@query("merge_close_points_greedy")
def _(b):
    return P.merge_greedy(b.v_points, ["image_id"], 12)


@query("suppress_close_low_quality")
def _(b):
    return P.suppress_close(b.v_points, ["image_id"], 9, "quality")


@query("luminance_filter", """
    WITH r AS (SELECT image_id, min(quality) AS lo, max(quality) AS hi, stddev_pop(quality) AS std, (max(quality) - min(quality)) / 100 AS w FROM v_points GROUP BY image_id),
    h AS (SELECT image_id, least(99, CAST(floor((quality - lo) / (hi - lo) * 100) AS INT)) AS bin, count(*) AS n FROM v_points JOIN r USING (image_id) GROUP BY ALL),
    g AS (SELECT r.image_id, g.i FROM r, range(0, 104) g(i)),
    s AS (SELECT g.image_id, g.i, coalesce(sum(n), 0) AS m FROM g LEFT JOIN h ON h.image_id = g.image_id AND h.bin BETWEEN g.i - 4 AND g.i GROUP BY g.image_id, g.i),
    t AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY m DESC, i DESC) AS k FROM s),
    p AS (SELECT image_id, max(i) FILTER (k = 1) AS i1, max(m) FILTER (k = 1) AS m1, max(i) FILTER (k = 2) AS i0, max(m) FILTER (k = 2) AS m0 FROM t GROUP BY image_id),
    q AS (SELECT image_id, CASE WHEN m1 > m0 * 2 THEN lo + w * least(i1, 100) ELSE (lo + w * least(least(i0, i1), 100) + lo + w * least(greatest(i0, i1) + 1, 100)) / 2 END AS mode, std FROM p JOIN r USING (image_id))
    SELECT image_id, x, y, quality FROM v_points JOIN q USING (image_id) WHERE quality > mode - 5e-1 * std""")
def _(b):
    return P.bright_enough(b.v_points, ["image_id"], "quality", 0.5).select("image_id", "x", "y", "quality")


@query("neighbor_distance_score", """
    WITH s AS (SELECT image_id, x, y, count(*) AS n_here FROM v_points GROUP BY ALL)
    SELECT a.image_id, a.x, a.y, 1 / (1 + exp(12 - CASE WHEN a.n_here > 1 THEN 0e0 ELSE sqrt(min(power(a.x - o.x, 2) + power(a.y - o.y, 2)) FILTER (a.x <> o.x OR a.y <> o.y)) END)) AS score
    FROM s a JOIN s o USING (image_id) GROUP BY a.image_id, a.x, a.y, a.n_here""", rounded="score")
def _(b):
    return P.distance_score(joins.nearest_distance(b.v_points, ["image_id"]), F.lit(12.0)).select("image_id", "x", "y", "score")


@query("best_point_source", """WITH n AS (SELECT image_id, source, count(*) AS n FROM v_points GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, CASE source WHEN 'near' THEN 0 ELSE 1 END) AS k FROM n)
    SELECT p.image_id, p.source, x, y, quality FROM v_points p JOIN k ON k.image_id = p.image_id AND k.source = p.source AND k.k = 1""")
def _(b):
    return P.best_source(b.v_points, ["image_id"], "source", ["near", "far", "third"]).select("image_id", "source", "x", "y", "quality")


CHAIN = """r(node, root) AS (SELECT node, node FROM v_matches WHERE parent = node UNION ALL SELECT m.node, r.root FROM v_matches m JOIN r ON m.parent = r.node WHERE m.parent <> m.node)"""


@query("matched_chains", f"WITH RECURSIVE {CHAIN} SELECT root, node FROM r")
def _(b):
    return graph.chain_roots(b.v_matches, "node", "parent")


@query("impossible_matches", "SELECT node, parent FROM (SELECT node, CASE WHEN node % 100 = 7 THEN node + 1000000000 ELSE parent END AS parent FROM v_matches) t WHERE parent NOT IN (SELECT node FROM v_matches)")
def _(b):
    broken = b.v_matches.select("node", F.when(F.col("node") % 100 == 7, F.col("node") + 1_000_000_000).otherwise(F.col("parent")).alias("parent"))
    return graph.dangling_parents(broken, "node", "parent").select("node", "parent")


@query("compose_chain_transforms", """WITH RECURSIVE r(node, root, tx, ty, root_here) AS (SELECT node, node, dx, dy, TRUE FROM v_matches WHERE parent = node
      UNION ALL SELECT m.node, r.root, m.dx + CASE WHEN r.root_here THEN 0 ELSE r.tx END, m.dy + CASE WHEN r.root_here THEN 0 ELSE r.ty END, FALSE FROM v_matches m JOIN r ON m.parent = r.node WHERE m.parent <> m.node)
    SELECT node, root, tx AS a13, ty AS a23 FROM r""")
def _(b):
    m = b.v_matches.select("node", "parent", F.lit(1.0).alias("a11"), F.lit(0.0).alias("a12"), F.col("dx").alias("a13"),
                           F.lit(0.0).alias("a21"), F.lit(1.0).alias("a22"), F.col("dy").alias("a23"))
    return graph.chain_transforms(m, "node", "parent").select("node", "root", "a13", "a23")


@query("find_reference_nodes", "SELECT node, mosaic_id FROM v_matches WHERE parent = node")
def _(b):
    return b.v_matches.filter("parent = node").select("node", "mosaic_id")


@query("unmatched_closest_seed", """WITH u AS (SELECT e.* FROM v_elements e WHERE NOT EXISTS (SELECT 1 FROM v_matches m WHERE m.node = e.element_id AND m.parent <> m.node)),
    k AS (SELECT *, row_number() OVER (PARTITION BY mosaic_id ORDER BY abs(x), element_id) AS k FROM u) SELECT mosaic_id, element_id FROM k WHERE k = 1""")
def _(b):
    matched = b.v_matches.filter("parent <> node").select(F.col("node").alias("element_id"))
    u = b.v_elements.join(matched, "element_id", "left_anti")
    return u.groupBy("mosaic_id").agg(F.min_by("element_id", F.struct(F.abs("x"), "element_id")).alias("element_id"))


# --- paired metrics ---------------------------------------------------------------------------------

TP = "tp AS (SELECT a.tile_id, a.pos, a.v AS a, o.v AS b FROM v_tile a JOIN v_tile o ON o.tile_id = a.tile_id + 1 AND o.pos = a.pos)"


@query("metric_ncc", f"WITH {TP} SELECT tile_id, avg(a * b) / (stddev_pop(a) * stddev_pop(b)) AS ncc, covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)) AS zncc FROM tp GROUP BY tile_id", rounded="ncc zncc")
def _(b):
    return images.pair_moments(images.tile_pairs(b.v_tile), ["tile_id"]).select("tile_id", "ncc", "zncc")


@query("metric_mse", f"WITH {TP} SELECT tile_id, avg((a - b) * (a - b)) AS mse FROM tp GROUP BY tile_id")
def _(b):
    return images.pair_moments(images.tile_pairs(b.v_tile), ["tile_id"]).select("tile_id", "mse")


INFO = """px AS (SELECT tile_id, i, sum(n) AS ni FROM j GROUP BY ALL), py AS (SELECT tile_id, j, sum(n) AS nj FROM j GROUP BY ALL), tt AS (SELECT tile_id, sum(n) AS t FROM j GROUP BY ALL),
    mi AS (SELECT j.tile_id, sum(n / CAST(t AS DOUBLE) * ln(n * t / CAST(ni * nj AS DOUBLE))) AS mi FROM j JOIN px ON px.tile_id = j.tile_id AND px.i = j.i JOIN py ON py.tile_id = j.tile_id AND py.j = j.j JOIN tt ON tt.tile_id = j.tile_id GROUP BY j.tile_id)"""


@query("metric_mi", f"""WITH {TP}, rg AS (SELECT tile_id, min(a) AS la, max(a) AS ha, min(b) AS lb, max(b) AS hb FROM tp GROUP BY tile_id),
    j AS (SELECT tile_id, least(19, CAST(floor((a - la) / (ha - la) * 20) AS INT)) AS i, least(19, CAST(floor((b - lb) / (hb - lb) * 20) AS INT)) AS j, count(*) AS n FROM tp JOIN rg USING (tile_id) GROUP BY ALL), {INFO}
    SELECT tile_id, mi FROM mi""", rounded="mi")
def _(b):
    return images.mutual_information(images.tile_pairs(b.v_tile), ["tile_id"])


@query("metric_nmi", f"""WITH {TP}, j AS (SELECT tile_id, a AS i, b AS j, count(*) AS n FROM tp GROUP BY ALL), {INFO},
    hx AS (SELECT tile_id, sum(-ni / CAST(t AS DOUBLE) * ln(ni / CAST(t AS DOUBLE))) AS h FROM px JOIN tt USING (tile_id) GROUP BY tile_id), hy AS (SELECT tile_id, sum(-nj / CAST(t AS DOUBLE) * ln(nj / CAST(t AS DOUBLE))) AS h FROM py JOIN tt USING (tile_id) GROUP BY tile_id)
    SELECT tile_id, mi / ((hx.h + hy.h) / 2) AS nmi FROM mi JOIN hx USING (tile_id) JOIN hy USING (tile_id)""", rounded="nmi")
def _(b):
    return images.normalised_information(images.tile_pairs(b.v_tile), ["tile_id"])


@query("metric_entropy", """WITH h AS (SELECT tile_id, v, count(*) AS n FROM v_tile GROUP BY ALL), t AS (SELECT tile_id, CAST(sum(n) AS DOUBLE) AS t FROM h GROUP BY ALL)
    SELECT tile_id, -sum(n / t * log2(n / t)) AS entropy FROM h JOIN t USING (tile_id) GROUP BY tile_id""", rounded="entropy")
def _(b):
    return images.entropy(images.level_histogram(b.v_tile, ["tile_id"]), ["tile_id"])


SSIM = """SELECT tile_id, avg((2 * ua * ub + 65025e-4) * (2 * 7 / 6e0 * (ab - ua * ub) + 585225e-4) / ((ua * ua + ub * ub + 65025e-4) * (7 / 6e0 * (aa - ua * ua) + 7 / 6e0 * (bb - ub * ub) + 585225e-4))) AS ssim FROM (
      SELECT tile_id, count(*) OVER w AS k, avg(a) OVER w AS ua, avg(b) OVER w AS ub, avg(a * a) OVER w AS aa, avg(b * b) OVER w AS bb, avg(a * b) OVER w AS ab FROM tp
      WINDOW w AS (PARTITION BY tile_id ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)) AS s WHERE k = 7 GROUP BY tile_id"""


@query("metric_ssim_1d", f"WITH {TP} {SSIM}", rounded="ssim")
def _(b):
    return images.ssim_1d(images.tile_pairs(b.v_tile), ["tile_id"])


@query("overlap_crop", f"""WITH {TP} SELECT tile_id, pos, a, b FROM tp WHERE CAST(floor(pos / 8) AS INT) >= greatest(0, tile_id % 5 - 2) AND CAST(floor(pos / 8) AS INT) < 8 + least(0, tile_id % 5 - 2)
    AND pos % 8 >= greatest(0, tile_id % 7 - 3) AND pos % 8 < 8 + least(0, tile_id % 7 - 3)""")
def _(b):
    return images.overlap_crop(images.tile_pairs(b.v_tile), F.col("tile_id") % 7 - 3, F.col("tile_id") % 5 - 2, 8)


@query("registration_score_table", f"""WITH {TP}, m AS (SELECT tile_id, avg(a * b) / (stddev_pop(a) * stddev_pop(b)) AS ncc, covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)) AS zncc, avg((a - b) * (a - b)) AS mse FROM tp GROUP BY tile_id),
    s AS ({SSIM}), j AS (SELECT * FROM m JOIN s USING (tile_id))
    SELECT tile_id, metric, score FROM j UNPIVOT INCLUDE NULLS (score FOR metric IN (ncc, zncc, mse, ssim))""", rounded="score")
def _(b):
    p = images.tile_pairs(b.v_tile)
    j = images.pair_moments(p, ["tile_id"]).join(images.ssim_1d(p, ["tile_id"]), "tile_id")
    return j.unpivot("tile_id", ["ncc", "zncc", "mse", "ssim"], "metric", "score")


@query("clip_outliers", """
    WITH a AS (SELECT tile_id, pos, CASE WHEN v <= avg(v) OVER w - stddev_pop(v) OVER w THEN median(v) OVER w ELSE v END AS v FROM v_tile WINDOW w AS (PARTITION BY tile_id)),
    b AS (SELECT tile_id, pos, CASE WHEN v >= avg(v) OVER w + stddev_pop(v) OVER w THEN median(v) OVER w ELSE v END AS v FROM a WINDOW w AS (PARTITION BY tile_id)) SELECT tile_id, pos, v FROM b""")
def _(b):
    return images.clip_outliers(b.v_tile.select("tile_id", "pos", "v"), ["tile_id"], "v")


@query("clip_outliers_global", """
    WITH h AS (SELECT label, CAST(floor(v) AS INT) AS level, count(*) AS n FROM v_tile GROUP BY ALL),
    m AS (SELECT label, sum(n * (level + 5e-1)) / sum(n) AS mean, sum(n) AS total FROM h GROUP BY label), s AS (SELECT h.label, any_value(mean) AS mean, sqrt(sum(n * power(level + 5e-1 - mean, 2)) / sum(n)) AS std FROM h JOIN m USING (label) GROUP BY h.label),
    a AS (SELECT tile_id, pos, mean, std, CASE WHEN v <= mean - std THEN mean - std ELSE v END AS v FROM v_tile JOIN s USING (label))
    SELECT tile_id, pos, CASE WHEN CASE WHEN v >= mean + std THEN mean + std ELSE v END <= 0 THEN mean - std WHEN v >= mean + std THEN mean + std ELSE v END AS v FROM a""", rounded="v")
def _(b):
    st = images.histogram_stats(images.level_histogram(b.v_tile, ["label"]), ["label"])
    return images.clip_outliers(b.v_tile, ["tile_id"], "v", zero=True, replace="border", overall=st, overall_keys=["label"]).select("tile_id", "pos", "v")


Z = "z AS (SELECT tile_id, CAST(floor(pos / 8) AS INT) AS r, pos % 8 AS c, CASE WHEN (pos * 7 + tile_id) % 5 = 0 THEN 0e0 ELSE v END AS v FROM v_tile)"


@query("zero_fill_4nbr", f"""WITH {Z} SELECT a.tile_id, a.r, a.c, CASE WHEN a.v = 0 THEN coalesce(avg(o.v) FILTER (o.v <> 0), 0) ELSE a.v END AS v FROM z a LEFT JOIN z o ON o.tile_id = a.tile_id AND abs(a.r - o.r) + abs(a.c - o.c) = 1
    GROUP BY a.tile_id, a.r, a.c, a.v""", rounded="v")
def _(b):
    z = b.v_tile.select("tile_id", F.floor(F.col("pos") / 8).cast("int").alias("r"), (F.col("pos") % 8).alias("c"),
                        F.when((F.col("pos") * 7 + F.col("tile_id")) % 5 == 0, 0.0).otherwise(F.col("v")).alias("v"))
    return images.zero_fill(z, ["tile_id"], "r", "c", "v")


@query("histogram_match", f"WITH {HIST} SELECT t.tile_id, k.lookup AS v, count(*) AS n FROM v_tile t JOIN look k ON k.tile_id = t.tile_id AND k.level = t.v GROUP BY ALL")
def _(b):
    cdf = images.normalized_cdf(images.level_histogram(b.v_tile, ["tile_id"]), ["tile_id"])
    return images.lut_apply(b.v_tile, images.match_lookup(cdf)).groupBy("tile_id", "v").agg(F.count("*").alias("n"))


# --- fits --------------------------------------------------------------------------------------------

def exponential_sql(source: str, keys: str, scale: str = "3e3", rounds: int = 3) -> str:
    """CTEs: ``ex``, the soft-L1 fit of p0 + p1 * exp(-p2 * x) for every profile and rate of the grid."""
    def one(no: int, w: str) -> str:
        return f"""m{no} AS (SELECT {keys}, rate, sum({w}) AS s, sum({w} * u) AS su, sum({w} * y) AS sv, sum({w} * u * u) AS suu, sum({w} * u * y) AS suv FROM t{no} GROUP BY {keys}, rate),
    a{no} AS (SELECT *, CASE WHEN abs(s * suu - su * su) > 1e-12 * s * suu THEN (s * suv - su * sv) / nullif(s * suu - su * su, 0) ELSE 0 END AS p1 FROM m{no}),
    b{no} AS (SELECT *, (sv - p1 * su) / s AS p0 FROM a{no}),
    q{no} AS (SELECT {keys}, rate, CASE WHEN p1 < 0 THEN greatest(0, sv / s) WHEN p0 < 0 THEN 0 ELSE p0 END AS q0, CASE WHEN p1 < 0 THEN 0 WHEN p0 < 0 THEN greatest(0, suv / nullif(suu, 0)) ELSE p1 END AS q1 FROM b{no}),
    t{no + 1} AS MATERIALIZED (SELECT {keys}, rate, u, y, q0, q1, 1 / sqrt(1 + power((y - q0 - q1 * u) / {scale}, 2)) AS w FROM (SELECT * FROM (SELECT {keys}, rate, u, y FROM t{no}) AS z JOIN q{no} USING ({keys}, rate)) AS zz)"""
    steps = ", ".join(one(no, "1e0" if no == 0 else "w") for no in range(rounds + 1))
    return f"""t0 AS MATERIALIZED (SELECT {keys}, r.rate, exp(-r.rate * x) AS u, y FROM {source} AS src, (SELECT 2e-2 * power(106e-2, k) AS rate FROM range(0, 90) g(k)) AS r), {steps},
    ex AS (SELECT {keys}, rate, any_value(q0) AS q0, any_value(q1) AS q1, sum(2 * {scale} * {scale} * (1 / w - 1)) AS loss FROM t{rounds + 1} GROUP BY {keys}, rate)"""


@query("profile_fit_exponential", f"""WITH {exponential_sql("(SELECT subject_id, axis, abs(e10) / 1e1 AS x, density AS y FROM v_profile WHERE abs(e10) BETWEEN 10 AND 100 AND density > 2e4 / (1 + power(abs(e10) / 1e1, 14e-1)))", 'subject_id, axis')}
    SELECT subject_id, axis, q0 AS p0, q1 AS p1, rate AS p2, loss FROM ex QUALIFY row_number() OVER (PARTITION BY subject_id, axis ORDER BY floor(loss * 1024 + 5e-1), rate) = 1""", rounded="p0 p1 p2 loss", digits=3)
def _(b):
    from eccentra.operators.cells import obvious_low_filter
    t = obvious_low_filter(b.v_profile, "density").withColumn("x", F.abs("e10") / 10.0)
    return fits.exponential(t, KEY, "x", "density")


@query("profile_fit_bilateral")
def _(b):
    t = b.v_profile.withColumn("x", F.col("e10") / 10.0).withColumn("d", F.col("density") * 1.5)
    return fits.bilateral_both_axes(t, ["subject_id"], "x", "d", "n_obs")


BAND = "9e0 - 17e-2 * abs(e10) * 291e-4 + 86e-2 / (abs(e10) * 291e-4 + 3e-1)"
BSL = "(17e-2 + 86e-2 / power(abs(e10) * 291e-4 + 3e-1, 2))"


@query("fit_band_outliers", f"SELECT subject_id, axis, e10, density, abs(ln(density) - ({BAND})) / sqrt(1 + {BSL} * {BSL}) <= 2e-1 AS inside FROM v_profile")
def _(b):
    x = F.abs("e10") * 0.0291
    model = 9.0 - 0.17 * x + 0.86 / (x + 0.3)
    slope = 0.17 + 0.86 / F.pow(x + 0.3, F.lit(2.0))
    return fits.band_split(b.v_profile, F.ln("density"), model, slope).select("subject_id", "axis", "e10", "density", "inside")


def l1_sql(rounds, scale):
    parts = ["l0 AS (SELECT subject_id, axis, e10 / 1e1 AS x, thickness AS y, 1e0 AS w FROM v_profile WHERE thickness IS NOT NULL)"]
    for i in range(rounds + 1):
        parts.append(f"s{i} AS (SELECT subject_id, axis, sum(w) AS s, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * x * y) AS sxy, count(*) AS n FROM l{i} GROUP BY ALL)")
        parts.append(f"p{i} AS (SELECT subject_id, axis, n, (s * sxy - sx * sy) / (s * sxx - sx * sx) AS b, (sy - (s * sxy - sx * sy) / (s * sxx - sx * sx) * sx) / s AS a FROM s{i})")
        if i < rounds:
            parts.append(f"l{i + 1} AS (SELECT l.subject_id, l.axis, x, y, 1 / sqrt(1 + power((y - a - b * x) / {scale}e0, 2)) AS w FROM l{i} l JOIN p{i} USING (subject_id, axis))")
    return f"WITH {', '.join(parts)} SELECT subject_id, axis, a AS intercept, b AS slope, n FROM p{rounds}"


@query("line_fit_l1", l1_sql(6, 5), rounded="intercept slope")
def _(b):
    t = b.v_profile.withColumn("x", F.col("e10") / 10.0)
    return fits.line_l1(t, KEY, "x", "thickness", rounds=6)


@query("theil_sen", """
    WITH d AS (SELECT axis, subject_id, max(density) AS x, max(thickness) AS y FROM v_profile GROUP BY ALL),
    s AS (SELECT a.axis, (o.y - a.y) / (o.x - a.x) AS s FROM d a JOIN d o ON a.axis = o.axis AND o.x > a.x),
    m AS (SELECT axis, median(x) AS mx, median(y) AS my, count(*) AS n FROM d GROUP BY axis),
    tx AS (SELECT axis, sum(t * (t - 1) * (2 * t + 5)) AS tie FROM (SELECT axis, x, count(*)::DOUBLE AS t FROM d GROUP BY ALL) GROUP BY axis),
    ty AS (SELECT axis, sum(t * (t - 1) * (2 * t + 5)) AS tie FROM (SELECT axis, y, count(*)::DOUBLE AS t FROM d WHERE y IS NOT NULL GROUP BY ALL) GROUP BY axis),
    l AS (SELECT s.axis, n, mx, my, median(s) AS slope, list_sort(list(s)) AS ss, count(*) AS c, any_value(sqrt((n * (n - 1) * (2 * n + 5) - tx.tie - ty.tie) / 18e0)) AS sigma
      FROM s JOIN m USING (axis) JOIN tx USING (axis) JOIN ty USING (axis) WHERE s IS NOT NULL GROUP BY s.axis, n, mx, my)
    SELECT axis, n, slope * 1e4 AS slope_e4, my - slope * mx AS intercept,
      ss[1 + greatest(CAST(round_even((c - 1959963984540054e-15 * sigma) / 2, 0) AS BIGINT) - 1, 0)] * 1e4 AS lower_e4, ss[1 + least(CAST(round_even((c + 1959963984540054e-15 * sigma) / 2, 0) AS BIGINT), c - 1)] * 1e4 AS upper_e4 FROM l""", rounded="slope_e4 intercept lower_e4 upper_e4")
def _(b):
    d = b.v_profile.groupBy("axis", "subject_id").agg(F.max("density").alias("x"), F.max("thickness").alias("y"))
    return fits.theil_sen(d, ["axis"], "x", "y").select("axis", "n", (F.col("slope") * 1e4).alias("slope_e4"), "intercept", (F.col("lower") * 1e4).alias("lower_e4"), (F.col("upper") * 1e4).alias("upper_e4"))
