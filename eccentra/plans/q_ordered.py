"""Ordered operators and integrals over the bound views."""

import numpy as np
from pyspark.sql import Window as W, functions as F

from eccentra.functions import geometry as G
from eccentra.operators import images, integrals as I, ordered, peaks, profiles, smoothing
from eccentra.plans.registry import query

KEY = ["subject_id", "axis"]
# every profile as a dense grid, nulls interpolated and ends held
PROF = "pf AS (SELECT subject_id, axis, e10, density, thickness FROM v_profile)"
DENSE = f"""{PROF}, gk AS (SELECT subject_id, axis, CAST(g.e AS INT) AS e10 FROM (SELECT DISTINCT subject_id, axis FROM pf), range(-100, 101) g(e)),
    gl AS (SELECT gk.*, pf.density AS v FROM gk LEFT JOIN pf USING (subject_id, axis, e10)),
    gn AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN e10 END) OVER (PARTITION BY subject_id, axis ORDER BY e10) AS pl,
                     min(CASE WHEN v IS NOT NULL THEN e10 END) OVER (PARTITION BY subject_id, axis ORDER BY e10 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS pr FROM gl),
    dn AS (SELECT gn.subject_id, gn.axis, gn.e10, CASE WHEN gn.v IS NOT NULL THEN gn.v WHEN pl IS NULL THEN r.v WHEN pr IS NULL THEN l.v
        ELSE l.v + (r.v - l.v) * (gn.e10 - pl) / (pr - pl) END AS v
      FROM gn LEFT JOIN gl l ON l.subject_id = gn.subject_id AND l.axis = gn.axis AND l.e10 = pl LEFT JOIN gl r ON r.subject_id = gn.subject_id AND r.axis = gn.axis AND r.e10 = pr)"""


def prof(b):
    return b.v_profile.select("subject_id", "axis", "e10", "density", "thickness")


def dense(b):
    return I.dense(prof(b).withColumnRenamed("density", "v"), KEY, "v")


@query("sort_by_ecc", "SELECT subject_id, axis, e10, density, row_number() OVER (PARTITION BY subject_id, axis ORDER BY e10) AS place FROM v_profile")
def _(b):
    return prof(b).select("subject_id", "axis", "e10", "density", F.row_number().over(W.partitionBy(*KEY).orderBy("e10")).cast("bigint").alias("place"))


@query("gap_fill_small", """
    WITH t AS (SELECT subject_id, layer, axis, e10, thickness, lead(e10) OVER w AS ne, lead(thickness) OVER w AS nv FROM v_layer_profile WINDOW w AS (PARTITION BY subject_id, layer, axis ORDER BY e10))
    SELECT subject_id, layer, axis, CAST(g.e AS INT) AS e10, CASE WHEN g.e = e10 THEN thickness ELSE thickness + (nv - thickness) * (g.e - e10) / (ne - e10) END AS thickness
    FROM t, range(-100, 101) g(e) WHERE g.e = e10 OR (ne - e10 <= 4 AND g.e > e10 AND g.e < ne)""", rounded="thickness")
def _(b):
    return profiles.fill_small_gaps(b.v_layer_profile, ["subject_id", "layer", "axis"], "thickness")


@query("interpolate_nulls", f"WITH {DENSE} SELECT subject_id, axis, e10, v FROM dn", rounded="v")
def _(b):
    return dense(b)


@query("smooth_to_grid_varying_gap", """
    WITH p AS (SELECT subject_id, layer, axis, e10 / 10e0 - (subject_id % 16) / 256e0 AS x, thickness AS y FROM v_layer_profile),
    t AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lag(x) OVER w AS px, lag(y) OVER w AS py FROM p WINDOW w AS (PARTITION BY subject_id, layer, axis ORDER BY x)),
    g AS (SELECT t.*, CAST(g.e AS INT) AS e10, g.e / 10e0 AS ex FROM t, range(-100, 101) g(e)
      WHERE CASE WHEN nx IS NULL THEN (g.e / 10e0 >= x AND g.e <= floor(x * 10) + 1) WHEN nx - x > 1 - 85e-2 / (1 + x * x / 10) THEN g.e / 10e0 = x ELSE g.e / 10e0 >= x AND g.e / 10e0 < nx END)
    SELECT subject_id, layer, axis, e10, y + coalesce(CASE WHEN nx IS NOT NULL THEN (ny - y) / (nx - x) ELSE (y - py) / (x - px) END, 0) * (ex - x) AS y FROM g""", rounded="y")
def _(b):
    p = b.v_layer_profile.select("subject_id", "layer", "axis", (F.col("e10") / 10.0 - (F.col("subject_id") % 16) / 256.0).alias("x"), F.col("thickness").alias("y"))
    return smoothing.to_grid_varying_gap(p, ["subject_id", "layer", "axis"], "x", "y")


def robust_lowess(source: str, keys: str, x: str, y: str, tag: str = "", rounds: int = 3, share: str = "1e-1") -> str:
    """CTEs from ``source``: ``lw``, robust local lines over the nearest tenth of the known values, at every row; nulls of y are no points."""
    on = f"USING ({keys})"

    def line(no: int, weight: str) -> str:
        return f"""m{no}{tag} AS (SELECT {keys}, i, sum(w * r) AS sw, sum(w * r * dx) / nullif(sum(w * r), 0) AS mx, sum(w * r * yj) / nullif(sum(w * r), 0) AS my FROM (SELECT nb{tag}.*, {weight} AS r FROM {f'nb{tag}' if weight == '1e0' else f'nb{tag} JOIN r{no - 1}{tag} rr USING ({keys}, j)'}) AS t GROUP BY {keys}, i),
    l{no}{tag} AS (SELECT {keys}, i, any_value(sw) AS sw, any_value(mx) AS mx, any_value(my) AS my, sum(w * r * (dx - mx) * (dx - mx)) / any_value(sw) AS sx, sum(w * r * (dx - mx) * yj) / any_value(sw) AS sxy
      FROM (SELECT nb{tag}.*, {weight} AS r, sw, mx, my FROM {f'nb{tag}' if weight == '1e0' else f'nb{tag} JOIN r{no - 1}{tag} rr USING ({keys}, j)'} JOIN m{no}{tag} USING ({keys}, i) WHERE sw > 0) AS t GROUP BY {keys}, i),
    f{no}{tag} AS MATERIALIZED (SELECT {keys}, i, my - CASE WHEN sqrt(sx) > 1e-3 * spread THEN sxy / sx ELSE 0 END * mx AS fit FROM l{no}{tag} JOIN kn{tag} {on})"""

    steps, weight = [], "1e0"
    for no in range(rounds):
        steps.append(line(no, weight))
        steps.append(f"""e{no}{tag} AS (SELECT {keys}, p.j, abs(p.y - coalesce(fit, p.y)) AS res FROM pt{tag} p LEFT JOIN f{no}{tag} f USING ({keys}, i)),
    r{no}{tag} AS MATERIALIZED (SELECT {keys}, e.j, CASE WHEN 6 * mid <= 1e-12 * top THEN {'1e0' if no == 0 else 'o.r'} ELSE power(1 - power(least(res / nullif(6 * mid, 0), 1), 2), 2) END AS r
      FROM e{no}{tag} e JOIN (SELECT {keys}, median(res) AS mid FROM e{no}{tag} GROUP BY {keys}) AS m {on} JOIN kn{tag} {on} {'' if no == 0 else f'JOIN r{no - 1}{tag} o USING ({keys}, j)'})""")
        weight = "rr.r"
    steps.append(line(rounds, weight))
    return f"""al{tag} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY xx, y) AS i FROM (SELECT *, CAST({x} AS DOUBLE) AS xx, CAST({y} AS DOUBLE) AS y FROM {source} AS s1) AS s2),
    pt{tag} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY i) AS j FROM al{tag} WHERE y IS NOT NULL),
    kn{tag} AS MATERIALIZED (SELECT {keys}, count(*) AS n, CAST(floor(count(*) * {share} + 1e-10) AS INT) AS k, max(xx) - min(xx) AS spread, max(abs(y)) AS top FROM pt{tag} GROUP BY {keys}),
    cd{tag} AS (SELECT a.{keys.replace(', ', ', a.')}, a.i, o.j, o.xx - a.xx AS dx, o.y AS yj, kn{tag}.k, row_number() OVER (PARTITION BY a.{keys.replace(', ', ', a.')}, a.i ORDER BY abs(o.xx - a.xx), o.j) AS rn
      FROM al{tag} a JOIN kn{tag} {on} JOIN pt{tag} o {on} WHERE kn{tag}.k >= 2 AND kn{tag}.n >= 3),
    nb{tag} AS MATERIALIZED (SELECT {keys}, i, j, dx, yj, power(1 - power(least(abs(dx) / greatest(reach, 1e-12), 1), 3), 3) AS w FROM (SELECT *, max(abs(dx)) OVER (PARTITION BY {keys}, i) AS reach FROM cd{tag} WHERE rn <= k) AS t),
    {', '.join(steps)},
    lw{tag} AS (SELECT al{tag}.*, coalesce(f.fit, al{tag}.y) AS fit FROM al{tag} LEFT JOIN f{rounds}{tag} f USING ({keys}, i))"""


@query("lowess_profile", f"WITH {robust_lowess('(SELECT subject_id, axis, e10, density FROM v_profile WHERE density IS NOT NULL)', 'subject_id, axis', 'e10', 'density')} SELECT subject_id, axis, e10, fit AS density FROM lw", rounded="density", digits=3)
def _(b):
    out = smoothing.lowess(prof(b).select(*KEY, "e10", "density"), KEY, "e10", "density")
    return out.withColumn("e10", F.col("e10").cast("int"))


GRIDDED = """t AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lag(x) OVER w AS px, lag(y) OVER w AS py FROM p WINDOW w AS (PARTITION BY subject_id, axis ORDER BY x)),
    g AS (SELECT t.*, CAST(g.e AS INT) AS e10, g.e / 10e0 AS ex FROM t, range(-100, 101) g(e)
      WHERE CASE WHEN nx IS NULL THEN (g.e / 10e0 >= x AND g.e <= floor(x * 10) + 1) WHEN nx - x > 1 - 85e-2 / (1 + x * x / 10) THEN g.e / 10e0 = x ELSE g.e / 10e0 >= x AND g.e / 10e0 < nx END)"""


@query("smooth_raw_readings", f"""WITH {robust_lowess('v_raw_density', 'subject_id, axis', 'ecc', 'density')}, p AS (SELECT subject_id, axis, xx AS x, avg(fit) AS y FROM lw GROUP BY subject_id, axis, xx), {GRIDDED}
    SELECT subject_id, axis, e10, y + coalesce(CASE WHEN nx IS NOT NULL THEN (ny - y) / (nx - x) ELSE (y - py) / (x - px) END, 0) * (ex - x) AS density FROM g""", rounded="density", digits=3)
def _(b):
    """Irregular readings smoothed as they are, then read on the grid with wide gaps left open."""
    s = smoothing.lowess_blocks(b.v_raw_density, KEY, "ecc", "density")
    return smoothing.to_grid_varying_gap(s, KEY, "ecc", "density")


@query("lowess_plain", """
    WITH n AS (SELECT subject_id, axis, CAST(floor(count(*) * 1e-1 + 1e-10) AS INT) AS k, max(e10) - min(e10) AS spread FROM v_profile GROUP BY subject_id, axis),
    d AS (SELECT a.subject_id, a.axis, a.e10 AS x0, o.e10 AS x, o.density AS y, a.density AS y0, abs(a.e10 - o.e10) AS dist, row_number() OVER (PARTITION BY a.subject_id, a.axis, a.e10 ORDER BY abs(a.e10 - o.e10)) AS rn
      FROM v_profile a JOIN v_profile o USING (subject_id, axis)),
    r AS (SELECT subject_id, axis, x0, max(dist) AS reach FROM d JOIN n USING (subject_id, axis) WHERE rn <= k GROUP BY ALL),
    w AS (SELECT d.*, CASE WHEN dist < reach THEN power(1 - power(dist / CAST(reach AS DOUBLE), 3), 3) ELSE 0 END AS w FROM d JOIN r USING (subject_id, axis, x0)),
    s AS (SELECT subject_id, axis, x0, sum(w) AS sw, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM w GROUP BY ALL),
    f AS (SELECT w.subject_id, w.axis, w.x0, any_value(mx) AS mx, any_value(my) AS my, sum(w * (x - mx) * (x - mx)) / any_value(sw) AS sx, sum(w * (x - mx) * y) / any_value(sw) AS sxy FROM w JOIN s USING (subject_id, axis, x0) GROUP BY ALL)
    SELECT subject_id, axis, x0 AS e10, my + CASE WHEN sqrt(sx) > 1e-3 * spread THEN sxy / sx ELSE 0 END * (x0 - mx) AS density FROM f JOIN n USING (subject_id, axis)""", rounded="density", digits=3)
def _(b):
    out = smoothing.lowess(prof(b).select(*KEY, "e10", "density"), KEY, "e10", "density", rounds=0)
    return out.withColumn("e10", F.col("e10").cast("int"))


def gauss_sql(source, sigma, v="v"):
    """Mirror-ended Gaussian over places i of n, nulls ignored."""
    r = int(4 * sigma + 0.5)
    return f"""(SELECT subject_id, axis, e10, sum(w * v) / nullif(sum(CASE WHEN v IS NOT NULL THEN w END), 0) AS v FROM (
        SELECT t.subject_id, t.axis, t.e10, exp(-5e-1 * g.d * g.d / ({sigma}e0 * {sigma}e0)) AS w, o.v FROM
          (SELECT *, row_number() OVER (PARTITION BY subject_id, axis ORDER BY e10) - 1 AS i, count(*) OVER (PARTITION BY subject_id, axis) AS n FROM {source}) AS t
          CROSS JOIN range(-{r}, {r + 1}) g(d)
          JOIN (SELECT subject_id, axis, {v} AS v, row_number() OVER (PARTITION BY subject_id, axis ORDER BY e10) - 1 AS i FROM {source}) AS o
            ON o.subject_id = t.subject_id AND o.axis = t.axis AND o.i = CASE WHEN i_mod(t.i + g.d, 2 * t.n) < t.n THEN i_mod(t.i + g.d, 2 * t.n) ELSE 2 * t.n - 1 - i_mod(t.i + g.d, 2 * t.n) END) AS z
        GROUP BY subject_id, axis, e10)""".replace("i_mod(t.i + g.d, 2 * t.n)", "(((t.i + g.d) % (2 * t.n) + 2 * t.n) % (2 * t.n))")


@query("gaussian_smooth_nan", f"WITH {DENSE} SELECT subject_id, axis, e10, v FROM {gauss_sql('gl', 4)} AS t", rounded="v", digits=3)
def _(b):
    g = profiles.on_grid(prof(b).select(*KEY, "e10", F.col("density").alias("v")), KEY)
    return smoothing.gaussian(g, KEY, "e10", "v", 4)


@query("gaussian_smooth", f"WITH {DENSE} SELECT subject_id, axis, e10, v FROM {gauss_sql('dn', 2)} AS t", rounded="v", digits=3)
def _(b):
    return smoothing.gaussian(dense(b), KEY, "e10", "v", 2)


@query("moving_average", f"""WITH {DENSE}, c AS (SELECT subject_id, axis, e10, v, first_value(v) OVER w AS a, last_value(v) OVER w AS z FROM dn WINDOW w AS (PARTITION BY subject_id, axis ORDER BY e10 ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
    SELECT t.subject_id, t.axis, t.e10, avg(coalesce(o.v, CASE WHEN t.e10 + g.d < -100 THEN t.a ELSE t.z END)) AS v
    FROM c t CROSS JOIN range(-3, 4) g(d) LEFT JOIN dn o ON o.subject_id = t.subject_id AND o.axis = t.axis AND o.e10 = t.e10 + g.d GROUP BY t.subject_id, t.axis, t.e10""", rounded="v", digits=3)
def _(b):
    return smoothing.moving_average(dense(b), KEY, "e10", "v", 7)


def savgol_sql(width):
    m = smoothing.savgol_weights(width)
    h = width // 2
    rows = ", ".join(f"({p}, {q}, {float(m[p, q])!r}::DOUBLE)" for p in range(width) for q in range(width))
    return f"""WITH {DENSE}, sw(p, q, w) AS (VALUES {rows}),
      t AS (SELECT *, greatest(0, least(e10 + 100 - {h}, 201 - {width})) AS start FROM dn)
      SELECT t.subject_id, t.axis, t.e10, sum(sw.w * o.v) AS v, TRUE AS smoothed FROM t JOIN sw ON sw.p = t.e10 + 100 - t.start JOIN dn o ON o.subject_id = t.subject_id AND o.axis = t.axis AND o.e10 + 100 = t.start + sw.q
      GROUP BY t.subject_id, t.axis, t.e10"""


@query("savgol_smooth", savgol_sql(11), rounded="v", digits=3)
def _(b):
    return smoothing.savgol(dense(b), KEY, "e10", "v", 11)


@query("savgol_smooth_21", savgol_sql(21), rounded="v", digits=3)
def _(b):
    return smoothing.savgol(dense(b), KEY, "e10", "v", 21)


PEAKS = """runs AS (SELECT subject_id, layer, axis, grp, min(i) AS a, max(i) AS z, any_value(v) AS v FROM (
        SELECT *, sum(new) OVER (PARTITION BY subject_id, layer, axis ORDER BY i) AS grp FROM (
          SELECT subject_id, layer, axis, e10, thickness AS v, row_number() OVER w - 1 AS i, CASE WHEN thickness = lag(thickness) OVER w THEN 0 ELSE 1 END AS new FROM v_layer_profile
          WINDOW w AS (PARTITION BY subject_id, layer, axis ORDER BY e10)) AS x) AS y GROUP BY ALL),
    nb AS (SELECT *, lag(v) OVER w AS l, lead(v) OVER w AS r FROM runs WINDOW w AS (PARTITION BY subject_id, layer, axis ORDER BY grp)),
    places AS (SELECT subject_id, layer, axis, e10, row_number() OVER (PARTITION BY subject_id, layer, axis ORDER BY e10) - 1 AS place FROM v_layer_profile),
    pk AS (SELECT nb.subject_id, nb.layer, nb.axis, CASE WHEN v > l AND v > r THEN 1 ELSE -1 END AS kind, CAST(floor((a + z) / 2) AS INT) AS place, v AS thickness, e10
      FROM nb JOIN places p ON p.subject_id = nb.subject_id AND p.layer = nb.layer AND p.axis = nb.axis AND p.place = floor((a + z) / 2) WHERE (v > l AND v > r) OR (v < l AND v < r))"""
LKEY = ["subject_id", "layer", "axis"]


@query("find_peaks", f"WITH {PEAKS} SELECT subject_id, layer, axis, kind, place, thickness, e10 FROM pk")
def _(b):
    return peaks.find_peaks(b.v_layer_profile, LKEY, "e10", "thickness")


def scale_space(source: str, keys: str, at: str, v: str) -> str:
    """CTEs from ``source``: ``least``, the least whole sigma up to 100 whose mirrored Gaussian leaves two peaks and one valley.

    Every profile is continued by its mirror images and laid against the kernel of every sigma; places are 0-based.
    """
    q = "(((k % (2 * n)) + 2 * n) % (2 * n))"
    # a run of equal values counts once
    starts = "list_filter(range(1, n + 1), lambda i: i = 1 OR s[i] <> s[i - 1])"
    up = "list_filter(range(2, len(st)), lambda k: s[st[k]] > s[st[k - 1]] AND s[st[k]] > s[st[k + 1]])"
    down = up.replace(">", "<")
    return f"""pl AS (SELECT {keys}, list({v} ORDER BY {at}) AS v, list({at} ORDER BY {at}) AS places, CAST(count(*) AS INT) AS n FROM {source} WHERE {v} IS NOT NULL GROUP BY {keys}),
    px AS (SELECT *, row_number() OVER () AS pno, list_transform(range(-400, n + 400), lambda k: v[1 + CASE WHEN {q} < n THEN {q} ELSE 2 * n - 1 - {q} END]) AS ext FROM pl),
    kern AS (SELECT sg.s AS sigma, list_transform(range(-4 * sg.s, 4 * sg.s + 1), lambda d: exp(-5e-1 * (d / CAST(sg.s AS DOUBLE)) * (d / CAST(sg.s AS DOUBLE)))) AS w FROM range(1, 101) sg(s)),
    laid AS (SELECT pno, sigma, i.i, list_dot_product(ext[i.i + 401 - 4 * sigma:i.i + 401 + 4 * sigma], w) / list_sum(w) AS sv FROM px, kern, range(0, 201) i(i) WHERE i.i < n),
    sp AS (SELECT pno, sigma, list(sv ORDER BY i) AS s FROM laid GROUP BY pno, sigma UNION ALL SELECT pno, 0, v FROM px),
    judged AS (SELECT *, {up} AS up, len({down}) AS n_down FROM (SELECT px.*, sigma, s, {starts} AS st FROM px JOIN sp USING (pno))),
    hit AS (SELECT {keys}, sigma, places[(st[up[1]] + st[up[1] + 1] - 3) // 2 + 1] AS lower, places[(st[up[2]] + st[up[2] + 1] - 3) // 2 + 1] AS upper
      FROM judged WHERE len(up) = 2 AND n_down = 1 QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY sigma) = 1),
    least AS (SELECT {keys}, CAST(sigma AS INT) AS sigma, lower, upper FROM pl LEFT JOIN hit USING ({keys}))"""


@query("two_peaks_one_valley", f"WITH {DENSE}, {scale_space('dn', 'subject_id, axis', 'e10', 'v')} SELECT subject_id, axis, sigma, lower, upper FROM least")
def _(b):
    return peaks.two_peaks_one_valley(dense(b), KEY, "e10", "v")


@query("peak_limits", f"WITH {DENSE}, {scale_space('dn', 'subject_id, axis', 'e10', 'v')} SELECT subject_id, axis, lower, upper FROM least WHERE lower IS NOT NULL")
def _(b):
    return peaks.two_peaks_one_valley(dense(b), KEY, "e10", "v").filter("lower IS NOT NULL").select(*KEY, "lower", "upper")


@query("pit_width")
def _(b):
    return peaks.pit_width(b.v_layer_profile, LKEY, "e10", "thickness")


@query("pit_minimum", """WITH r AS (SELECT subject_id, layer, axis, CAST(e10 AS DOUBLE) / 10 AS x, thickness AS y, row_number() OVER (PARTITION BY subject_id, layer, axis ORDER BY thickness, e10) AS k FROM v_layer_profile),
    m AS (SELECT subject_id, layer, axis, avg(x) AS mx, avg(y) AS my FROM r WHERE k <= 10 GROUP BY ALL),
    c AS (SELECT r.subject_id, r.layer, r.axis, mx, my, x - mx AS u, y - my AS w FROM r JOIN m USING (subject_id, layer, axis) WHERE k <= 10),
    s AS (SELECT subject_id, layer, axis, any_value(my) AS my, avg(u * u) AS u2, avg(u * u * u) AS u3, avg(u * u * u * u) AS u4, avg(u * w) AS uw, avg(u * u * w) AS uuw FROM c GROUP BY ALL),
    f AS (SELECT *, (uuw * u2 - uw * u3) / (u2 * (u4 - u2 * u2) - u3 * u3) AS a FROM s), g AS (SELECT *, (uw - a * u3) / u2 AS b FROM f)
    SELECT subject_id, layer, axis, CASE WHEN abs(a) > 1e-3 THEN my - a * u2 - b * b / (4 * a) END AS minimum FROM g""", rounded="minimum", digits=3)
def _(b):
    t = b.v_layer_profile.withColumn("x", F.col("e10") / 10.0)
    return peaks.pit_minimum(t, LKEY, "x", "thickness", flat=1e-3).drop("a")


@query("peak_width_at", """
    WITH r AS (SELECT subject_id, axis, CAST(e10 AS DOUBLE) AS x, density AS y, row_number() OVER w AS i, lead(CAST(e10 AS DOUBLE)) OVER w AS nx, lead(density) OVER w AS ny, lag(CAST(e10 AS DOUBLE)) OVER w AS px, lag(density) OVER w AS py
        FROM v_profile WINDOW w AS (PARTITION BY subject_id, axis ORDER BY e10)),
    m AS (SELECT subject_id, axis, max(y) * 5e-1 AS thr, max(y) AS top FROM r GROUP BY ALL),
    k AS (SELECT r.subject_id, r.axis, any_value(thr) AS thr, min(i) FILTER (y = top) AS t FROM r JOIN m USING (subject_id, axis) GROUP BY r.subject_id, r.axis),
    lr AS (SELECT k.subject_id, k.axis, any_value(thr) AS thr, any_value(t) AS t, coalesce(max(i) FILTER (y <= thr AND i < t), 1) AS li, coalesce(min(i) FILTER (y <= thr AND i >= t), max(i)) AS ri FROM k JOIN r USING (subject_id, axis) GROUP BY k.subject_id, k.axis)
    SELECT lr.subject_id, lr.axis, abs(CASE WHEN ri > t THEN CASE WHEN b.y = b.py THEN b.px ELSE b.px + (thr - b.py) * (b.x - b.px) / (b.y - b.py) END ELSE b.x END
      - CASE WHEN li < t - 1 THEN CASE WHEN a.ny = a.y THEN a.x ELSE a.x + (thr - a.y) * (a.nx - a.x) / (a.ny - a.y) END ELSE a.x END) AS width
    FROM lr JOIN r a ON a.subject_id = lr.subject_id AND a.axis = lr.axis AND a.i = li JOIN r b ON b.subject_id = lr.subject_id AND b.axis = lr.axis AND b.i = ri""", rounded="width")
def _(b):
    return peaks.width_at(prof(b), KEY, "e10", "density", 50)


PARAM = "mp AS (SELECT subject_id, 94e-1 + (subject_id % 8) / 16e0 AS a, 17e-2 + (subject_id % 5) / 64e0 AS b, 86e-2 AS d, 3e-1 + (subject_id % 4) / 32e0 AS e FROM v_baseline)"
SL = "exp(a - b * {x} + d / ({x} + e)) * (b + d / (({x} + e) * ({x} + e)))"


@query("slope_width", f"""WITH {PARAM}, g AS (SELECT mp.*, k.k, {SL.format(x='(k.k / 1e2)')} AS s FROM mp, range(50, 601) k(k)),
    f AS (SELECT subject_id, min(k) FILTER (s <= 8000) AS k FROM g GROUP BY subject_id),
    wd AS (SELECT f.subject_id, CASE WHEN f.k <= 50 THEN f.k / 1e2 ELSE (f.k / 1e2 - 1e-2) + 1e-2 * (p.s - 8000) / (p.s - q.s) END AS width FROM f LEFT JOIN g q ON q.subject_id = f.subject_id AND q.k = f.k LEFT JOIN g p ON p.subject_id = f.subject_id AND p.k = f.k - 1),
    mx AS (SELECT subject_id, max({SL.format(x='(1e-3 + k.k * (2999e-3 / 999))')}) AS max_slope FROM mp, range(0, 1000) k(k) GROUP BY subject_id)
    SELECT subject_id, width, max_slope FROM wd JOIN mx USING (subject_id)""", rounded="width max_slope", digits=3)
def _(b):
    s = F.col("subject_id")
    p = b.v_baseline.select("subject_id", (9.4 + (s % 8) / 16.0).alias("a"), (0.17 + (s % 5) / 64.0).alias("b"), F.lit(0.86).alias("d"), (0.3 + (s % 4) / 32.0).alias("e"))
    return peaks.model_slopes(p, 1).select("subject_id", "width", "max_slope")


GR = "CASE WHEN lag({v}) OVER w IS NULL THEN (lead({v}) OVER w - {v}) / 1e-1 WHEN lead({v}) OVER w IS NULL THEN ({v} - lag({v}) OVER w) / 1e-1 ELSE (lead({v}) OVER w - lag({v}) OVER w) / 2e-1 END"


@query("inflection_point", f"""WITH {DENSE}, sm AS {gauss_sql('dn', 2)}, a AS (SELECT *, {GR.format(v='v')} AS d1 FROM sm WINDOW w AS (PARTITION BY subject_id, axis ORDER BY e10)),
    b AS (SELECT *, {GR.format(v='d1')} AS d2 FROM a WINDOW w AS (PARTITION BY subject_id, axis ORDER BY e10)),
    c AS (SELECT *, {GR.format(v='d2')} AS d3, sign(d2) <> sign(lead(d2) OVER w) AS turn FROM b WINDOW w AS (PARTITION BY subject_id, axis ORDER BY e10))
    SELECT subject_id, axis, arg_min(e10, d1) / 1e1 AS x, min(d1) AS slope FROM c WHERE turn AND d3 > 0 GROUP BY subject_id, axis""", rounded="slope x", digits=2)
def _(b):
    s = smoothing.gaussian(dense(b), KEY, "e10", "v", 2).withColumn("x", F.col("e10") / 10.0)
    return peaks.inflection(s, KEY, "x", "v")


HIST = """lh AS (SELECT label, CAST(floor(v / 4) AS INT) AS bin, count(*) AS n FROM v_tile GROUP BY ALL)"""


@query("otsu_threshold", f"""WITH {HIST}, c AS (SELECT a.label, a.bin, sum(o.n) FILTER (o.bin <= a.bin) AS w1, sum(o.n) FILTER (o.bin > a.bin) AS w2, sum(o.n * (o.bin + 5e-1)) FILTER (o.bin <= a.bin) AS m1, sum(o.n * (o.bin + 5e-1)) FILTER (o.bin > a.bin) AS m2
      FROM lh a JOIN lh o USING (label) GROUP BY a.label, a.bin),
    v AS (SELECT label, bin, w1 * w2 * power(m1 / w1 - m2 / w2, 2) AS v FROM c WHERE w2 > 0)
    SELECT label, arg_max(bin, v) + 5e-1 AS threshold FROM v GROUP BY label""")
def _(b):
    h = b.v_tile.groupBy("label", F.floor(F.col("v") / 4).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return peaks.otsu(h, ["label"])


@query("above_below_threshold", """WITH n AS (SELECT image_id, CAST(floor(x / 185) AS INT) AS px, CAST(floor(y / 185) AS INT) AS py, count(*) AS n FROM v_points GROUP BY ALL),
    c AS (SELECT a.image_id, a.n AS bin, a.c FROM (SELECT image_id, n, count(*) AS c FROM n GROUP BY image_id, n) a),
    s AS (SELECT a.image_id, a.bin, sum(o.c) FILTER (o.bin <= a.bin) AS w1, sum(o.c) FILTER (o.bin > a.bin) AS w2, sum(o.c * (o.bin + 5e-1)) FILTER (o.bin <= a.bin) AS m1, sum(o.c * (o.bin + 5e-1)) FILTER (o.bin > a.bin) AS m2 FROM c a JOIN c o USING (image_id) GROUP BY a.image_id, a.bin),
    t AS (SELECT image_id, arg_max(bin, struct_pack(v := (m1 * w2 - m2 * w1) * (m1 * w2 - m2 * w1) / (CAST(w1 AS DOUBLE) * CAST(w2 AS DOUBLE)), least := -bin)) + 5e-1 AS threshold FROM s WHERE w2 > 0 GROUP BY image_id)
    SELECT image_id, px, py, n, threshold, CASE WHEN n > threshold THEN 'above' ELSE 'below' END AS side FROM n JOIN t USING (image_id)""")
def _(b):
    n = b.v_points.groupBy("image_id", F.floor(F.col("x") / 185).cast("int").alias("px"), F.floor(F.col("y") / 185).cast("int").alias("py")).agg(F.count("*").alias("n"))
    t = peaks.otsu(n.groupBy("image_id", F.col("n").alias("bin")).agg(F.count("*").alias("c")), ["image_id"], "bin", "c")
    return n.join(t, "image_id").withColumn("side", F.when(F.col("n") > F.col("threshold"), "above").otherwise("below"))


@query("normalized_cdf", """WITH h AS (SELECT tile_id, CAST(floor(v) AS INT) AS level, count(*) AS n FROM v_tile GROUP BY ALL)
    SELECT tile_id, level, n, CAST(sum(n) OVER (PARTITION BY tile_id ORDER BY level) AS DOUBLE) / sum(n) OVER (PARTITION BY tile_id) AS cdf FROM h""")
def _(b):
    return images.normalized_cdf(images.level_histogram(b.v_tile, ["tile_id"]), ["tile_id"])


VALLEY = f"""{HIST}, hv AS (SELECT label, list(CAST(coalesce(n, 0) AS DOUBLE) ORDER BY b.bin) AS v FROM (SELECT label, unnest(range(0, 64)) AS bin FROM (SELECT DISTINCT label FROM lh)) AS b LEFT JOIN lh USING (label, bin) GROUP BY label),
    hs AS (SELECT label, 64 AS n, list_transform(range(0, 64), lambda i: list_sum(list_transform(range(-8, 9), lambda d: exp(-5e-1 * d * d / 4e0) * v[1 + CASE WHEN i + d < 0 THEN -1 - i - d WHEN i + d > 63 THEN 127 - i - d ELSE i + d END]))
      / list_sum(list_transform(range(-8, 9), lambda d: exp(-5e-1 * d * d / 4e0)))) AS s FROM hv),
    ht AS (SELECT *, list_filter(range(1, 65), lambda i: i = 1 OR s[i] <> s[i - 1]) AS st FROM hs),
    hp AS (SELECT label, (st[k] + st[k + 1] - 3) // 2 AS place, s[st[k]] AS top FROM (SELECT *, unnest(list_filter(range(2, len(st)), lambda k: s[st[k]] > s[st[k - 1]] AND s[st[k]] > s[st[k + 1]])) AS k FROM ht) AS u),
    hm AS (SELECT label, coalesce(arg_max(place, struct_pack(a := top, b := -place)) FILTER (place > 315e-1 - sqrt(4095 / 12e0)), min(place)) AS peak FROM hp GROUP BY label),
    hc AS (SELECT label, i, (s[i + 3] - s[i + 2]) - (s[i + 2] - s[i + 1]) AS d FROM hs JOIN hm USING (label), range(0, 62) r(i) WHERE i + 1 < peak - 3 AND i >= 25e-2 * peak AND i <= 75e-2 * peak),
    hb AS (SELECT label, arg_max(i, struct_pack(a := d, b := -i)) AS i FROM hc GROUP BY label)"""


@query("histogram_valley_threshold", f"WITH {VALLEY} SELECT label, CAST(coalesce(hb.i, 32) AS INT) AS threshold FROM hs LEFT JOIN hb USING (label)")
def _(b):
    h = b.v_tile.groupBy("label", F.floor(F.col("v") / 4).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    keys = h.select("label").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(63))))
    full = keys.join(h, ["label", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("double"))
    smooth = smoothing.gaussian(full, ["label"], "bin", "n", 2)
    return peaks.valley_threshold(smooth, ["label"], "bin", "n", 64)


@query("cumulative_integral", f"""WITH {DENSE}, a AS (SELECT *, coalesce((v + lag(v) OVER w) / 2 * 291e-4, 0) AS s FROM dn WINDOW w AS (PARTITION BY subject_id, axis ORDER BY e10))
    SELECT subject_id, axis, e10, sum(s) OVER (PARTITION BY subject_id, axis ORDER BY e10) AS cumulative FROM a""", rounded="cumulative", digits=3)
def _(b):
    d = dense(b).withColumn("x", F.col("e10") * 0.0291)
    return profiles.running_trapezoid(d, KEY, "x", "v").select(*KEY, "e10", "cumulative")


@query("sequence_number_chains", "SELECT element_id, mosaic_id, row_number() OVER (PARTITION BY mosaic_id ORDER BY abs(x), abs(y), element_id) AS place FROM v_elements")
def _(b):
    e = b.v_elements.select("element_id", "mosaic_id", F.abs("x").alias("ax"), F.abs("y").alias("ay"))
    return ordered.row_numbers(e, ["mosaic_id"], ["ax", "ay", "element_id"], "place").select("element_id", "mosaic_id", "place")


@query("gap_ranges", """WITH t AS (SELECT subject_id, layer, axis, e10, lead(e10) OVER (PARTITION BY subject_id, layer, axis ORDER BY e10) AS ne FROM v_layer_profile)
    SELECT subject_id, layer, axis, ne - 1 AS e10, ne - e10 - 1 AS length FROM t WHERE ne - e10 - 1 > 2
    UNION ALL SELECT subject_id, layer, axis, min(e10), 0 FROM t GROUP BY ALL UNION ALL SELECT subject_id, layer, axis, max(e10), 0 FROM t GROUP BY ALL""")
def _(b):
    return profiles.gap_ranges(b.v_layer_profile, LKEY)


@query("nth_observation_curves", """WITH n AS (SELECT axis, e10, count(*) AS n FROM v_obs GROUP BY ALL), m AS (SELECT axis, min(n) AS m FROM n GROUP BY axis),
    r AS (SELECT axis, e10, subject_id, obs_id, thickness, row_number() OVER (PARTITION BY axis, e10 ORDER BY subject_id, obs_id, thickness) AS curve FROM v_obs)
    SELECT axis, e10, curve, thickness FROM r JOIN m USING (axis) WHERE curve <= m""")
def _(b):
    return profiles.nth_curves(b.v_obs, ["axis"], ["subject_id", "obs_id", "thickness"]).select("axis", "e10", "curve", "thickness")


# --- integrals ---------------------------------------------------------------------------------------

@query("interp_at", f"""WITH {DENSE}, q AS (SELECT subject_id, axis, ecc, greatest(-100e0, least(100e0, ecc * 10)) AS pt FROM v_raw_density), k AS (SELECT *, least(CAST(floor(pt) AS INT), 99) AS lo FROM q)
    SELECT k.subject_id, k.axis, k.ecc, a.v + (b.v - a.v) * (pt - lo) AS v FROM k JOIN dn a ON a.subject_id = k.subject_id AND a.axis = k.axis AND a.e10 = lo
      JOIN dn b ON b.subject_id = k.subject_id AND b.axis = k.axis AND b.e10 = lo + 1""", rounded="v", digits=3)
def _(b):
    return I.interp_at(dense(b), b.v_raw_density.select(*KEY, "ecc"), KEY, "v", "ecc")


@query("disk_cell_count", f"""WITH {DENSE}, sm AS (SELECT subject_id, axis, e10, v FROM {gauss_sql('dn', 4)} AS t), tp AS (SELECT subject_id, axis, greatest(-98, least(98, arg_max(e10, (v, -e10)))) AS c FROM sm GROUP BY ALL),
    q5 AS (SELECT tp.subject_id, tp.axis, tp.c, sum(CASE abs(e10 - c) WHEN 2 THEN 2 WHEN 1 THEN -1 ELSE -2 END * v) / 14e0 AS a, sum((e10 - c) * v) / 10e0 AS b FROM tp JOIN sm USING (subject_id, axis) WHERE abs(e10 - c) <= 2 GROUP BY ALL),
    vx AS (SELECT subject_id, axis, c + CASE WHEN a <> 0 THEN -b / (2 * a) ELSE 0 END AS peak FROM q5),
    ray AS (SELECT subject_id, axis, k.k, 1e-4 + k.k * ((333e-2 - 1e-4) / 499) AS r, greatest(-100e0, least(100e0, peak + s.s * (1e-4 + k.k * ((333e-2 - 1e-4) / 499)) * 10)) AS pt FROM vx, range(0, 500) k(k), (VALUES (1), (-1)) s(s)),
    rv AS (SELECT ray.subject_id, ray.k, ray.r, a.v + (b.v - a.v) * (pt - a.e10) AS v FROM ray JOIN sm a ON a.subject_id = ray.subject_id AND a.axis = ray.axis AND a.e10 = least(CAST(floor(pt) AS INT), 99)
      JOIN sm b ON b.subject_id = ray.subject_id AND b.axis = ray.axis AND b.e10 = a.e10 + 1),
    m AS (SELECT subject_id, k, r, avg(v) AS v, count(*) AS c FROM rv GROUP BY ALL)
    SELECT subject_id, sum(CASE WHEN k = 0 OR k = 499 THEN 5e-1 ELSE 1 END * v * r) * ((333e-2 - 1e-4) / 499) * 291e-3 * 291e-3 * 2 * pi() AS cells FROM m WHERE c = 4 GROUP BY subject_id""", rounded="cells", digits=2)
def _(b):
    # smoothed with sigma 4, as the counts are published
    return I.disk_cell_count(smoothing.gaussian(dense(b), KEY, "e10", "v", 4), ["subject_id"], "v", 3.33)


SW = "(CASE WHEN k >= 399 THEN 0 WHEN k = 0 OR k = 398 THEN 1 / 3e0 WHEN k % 2 = 1 THEN 4 / 3e0 ELSE 2 / 3e0 END + CASE k WHEN 399 THEN 5 / 12e0 WHEN 398 THEN 8 / 12e0 WHEN 397 THEN -1 / 12e0 ELSE 0 END)"


def polar_sql(radius, hole=0.0):
    return f"""(SELECT subject_id, sum({SW} * v * r) * pi() * ({radius}e0 - {hole}e0) / 399 AS total, max(v) FILTER (axis = 'X') AS max_x, max(v) FILTER (axis = 'Y') AS max_y FROM (
        SELECT g.subject_id, g.axis, g.k, g.r, a.v + (b.v - a.v) * (g.r / 291e-3 * 10 - a.e10) AS v FROM
          (SELECT subject_id, axis, k.k, {hole}e0 + k.k * (({radius}e0 - {hole}e0) / 399) AS r FROM (SELECT DISTINCT subject_id, axis FROM dn), range(0, 400) k(k)) AS g
          JOIN dn a ON a.subject_id = g.subject_id AND a.axis = g.axis AND a.e10 = least(CAST(floor(g.r / 291e-3 * 10) AS INT), 99)
          JOIN dn b ON b.subject_id = g.subject_id AND b.axis = g.axis AND b.e10 = a.e10 + 1) AS rr GROUP BY subject_id HAVING count(DISTINCT axis) = 2)"""


@query("polar_integral", f"WITH {DENSE} SELECT p.subject_id, p.total, h.total AS without_centre, p.max_x, p.max_y FROM {polar_sql(1.0)} p JOIN {polar_sql(1.0, 0.3)} h USING (subject_id)",
       rounded="total without_centre max_x max_y", digits=2)
def _(b):
    return I.polar_integrals(dense(b), ["subject_id"], "v", {"total": (1.0, 0.0), "without_centre": (1.0, 0.3)}, maxima=1.0)


@query("strip_integral", f"""WITH {DENSE}, m AS (SELECT subject_id, axis, e10, v, row_number() OVER (PARTITION BY subject_id, axis ORDER BY e10) - 1 AS i, count(*) OVER (PARTITION BY subject_id, axis) AS n FROM dn WHERE abs(e10 * 291e-4) < 1e0)
    SELECT subject_id, axis, sum(CASE WHEN i = 0 OR i = n - 1 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * v) * 291e-4 / 3 AS integral FROM m GROUP BY subject_id, axis""", rounded="integral", digits=3)
def _(b):
    d = dense(b).withColumn("x", F.col("e10") * 0.0291)
    return I.strip_integral(d, KEY, "x", "v", 1.0)


@query("strip_integral_hole", f"""WITH {DENSE}, m AS (SELECT subject_id, axis, e10 * 291e-4 AS x, v, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY subject_id, axis) AS n,
        e10 * 291e-4 - lag(e10 * 291e-4) OVER w AS h0, lead(e10 * 291e-4) OVER w - e10 * 291e-4 AS h1, lag(v) OVER w AS f0, lead(v) OVER w AS f2
      FROM dn WHERE abs(e10 * 291e-4) < 1e0 AND abs(e10 * 291e-4) > 3e-1 WINDOW w AS (PARTITION BY subject_id, axis ORDER BY e10))
    SELECT subject_id, axis, coalesce(sum((h0 + h1) / 6 * ((2 - h1 / h0) * f0 + power(h0 + h1, 2) / (h0 * h1) * v + (2 - h0 / h1) * f2)) FILTER (i % 2 = 1 AND i <= n - 2), 0)
      + coalesce(sum(f2 * (2 * h1 * h1 + 3 * h0 * h1) / (6 * (h0 + h1)) + v * (h1 * h1 + 3 * h0 * h1) / (6 * h0) - f0 * power(h1, 3) / (6 * h0 * (h0 + h1))) FILTER (n % 2 = 0 AND i = n - 2), 0) AS integral
    FROM m GROUP BY subject_id, axis""", rounded="integral", digits=3)
def _(b):
    d = dense(b).withColumn("x", F.col("e10") * 0.0291)
    return I.strip_integral(d, KEY, "x", "v", 1.0, hole=0.3)


@query("region_cell_counts", f"WITH {DENSE} SELECT a.subject_id, a.total AS central, b.total AS inner_ring, c.total AS outer_ring FROM {polar_sql(0.5)} a JOIN {polar_sql(1.5)} b USING (subject_id) JOIN {polar_sql(3.0)} c USING (subject_id)",
       rounded="central inner_ring outer_ring", digits=2)
def _(b):
    return I.polar_integrals(dense(b), ["subject_id"], "v", {"central": (0.5, 0.0), "inner_ring": (1.5, 0.0), "outer_ring": (3.0, 0.0)})


PIT = """pit AS (SELECT subject_id, (subject_id % 7) / 64e0 AS A00, (subject_id % 5 - 2) / 128e0 AS A10, (subject_id % 3 - 1) / 128e0 AS A01, (subject_id % 4) / 256e0 AS A20, (subject_id % 6) / 256e0 AS A02, (subject_id % 9 - 4) / 512e0 AS A11,
    8 / 64e0 + (subject_id % 8) / 128e0 AS depth, (subject_id % 11 - 5) / 64e0 AS center_x, 3e-1 + (subject_id % 8) / 32e0 AS width_x, (subject_id % 13 - 6) / 64e0 AS center_y, 3e-1 + (subject_id % 16) / 64e0 AS width_y FROM v_baseline)"""


def pit(b):
    import re
    body = re.search(r"SELECT (.*) FROM v_baseline", PIT, re.S).group(1)
    return b.v_baseline.selectExpr(*[p.strip() for p in re.split(r",\s*(?![^()]*\))", body)])


def height(x, y):
    return (f"(A00 + A10 * ({x}) + A01 * ({y}) - A20 * ({x}) * ({x}) - A02 * ({y}) * ({y}) + A11 * ({x}) * ({y}) - depth * exp(-(power(({x}) - center_x, 2) / (2 * width_x * width_x) + power(({y}) - center_y, 2) / (2 * width_y * width_y))))")


@query("pit_surface_height", f"WITH {PIT} SELECT p.subject_id, axis, e10, {height('e10 / 1e1', 'density / 1e5')} AS height FROM pit p JOIN v_profile f ON f.subject_id = p.subject_id", rounded="height")
def _(b):
    t = b.v_profile.join(pit(b), "subject_id")
    return t.select("subject_id", "axis", "e10", I.pit_height(F.col("e10") / 10.0, F.col("density") / 1e5).alias("height"))


GL = ", ".join(f"({0.75 + 0.75 * float(u)!r}::DOUBLE, {0.75 * float(w)!r}::DOUBLE)" for u, w in zip(*np.polynomial.legendre.leggauss(24)))


@query("pit_volume", f"""WITH {PIT} SELECT subject_id, sum(g.w * g.r * {height('g.r * cos(k.k * 2 * pi() / 64) + center_x', 'g.r * sin(k.k * 2 * pi() / 64) + center_y')}) * 2 * pi() / 64 AS volume
    FROM pit, (VALUES {GL}) g(r, w), range(0, 64) k(k) GROUP BY subject_id""", rounded="volume")
def _(b):
    return I.pit_volume(pit(b), ["subject_id"], 1.5)


@query("gaussian_pit_volume", f"WITH {PIT} SELECT subject_id, 2 * pi() * depth * width_x * width_y AS volume FROM pit", rounded="volume")
def _(b):
    return pit(b).select("subject_id", (2 * np.pi * F.col("depth") * F.col("width_x") * F.col("width_y")).alias("volume"))


@query("directional_slopes", f"""WITH {PIT} SELECT subject_id, ({height('center_x - 1e-1', 'center_y')} - {height('center_x', 'center_y')}) / 1e-1 AS temporal_slope, ({height('center_x + 1e-1', 'center_y')} - {height('center_x', 'center_y')}) / 1e-1 AS nasal_slope,
    ({height('center_x', 'center_y - 1e-1')} - {height('center_x', 'center_y')}) / 1e-1 AS superior_slope, ({height('center_x', 'center_y + 1e-1')} - {height('center_x', 'center_y')}) / 1e-1 AS inferior_slope FROM pit""",
       rounded="temporal_slope nasal_slope superior_slope inferior_slope")
def _(b):
    return pit(b).select("subject_id", *I.directional_slopes())


@query("surface_max_slope", f"""WITH {PIT}, g AS (SELECT pit.*, i.i * (2 * sqrt(14e0) / 40) - sqrt(14e0) AS u, j.j * (2 * sqrt(14e0) / 40) - sqrt(14e0) AS v FROM pit, range(0, 41) i(i), range(0, 41) j(j)),
    h AS (SELECT *, center_x + u * width_x AS x, center_y + v * width_y AS y, depth * exp(-(u * u + v * v) / 2) AS bump FROM g WHERE u * u / 2 + v * v / 2 <= 7)
    SELECT subject_id, max(sqrt(power(A10 - 2 * A20 * x + A11 * y + bump * u / width_x, 2) + power(A01 - 2 * A02 * y + A11 * x + bump * v / width_y, 2))) AS max_slope FROM h GROUP BY subject_id""", rounded="max_slope")
def _(b):
    return I.max_slope(pit(b), ["subject_id"])


@query("surface_flatness", """
    WITH kn AS (SELECT i, CASE WHEN q < 8 THEN q ELSE 15 - q END AS j, sum(w) / (SELECT sum(exp(-5e-1 * d * d / 4e0)) FROM range(-8, 9) t(d)) AS w
      FROM (SELECT i, exp(-5e-1 * d * d / 4e0) AS w, ((i + d) % 16 + 16) % 16 AS q FROM range(0, 8) a(i), range(-8, 9) b(d)) AS k GROUP BY ALL),
    v AS (SELECT tile_id, CAST(floor(pos / 8) AS INT) AS r, pos % 8 AS c, v FROM v_tile), s AS (SELECT t.tile_id, a.i AS r, b.i AS c, sum(a.w * b.w * t.v) AS v FROM v t JOIN kn a ON a.j = t.r JOIN kn b ON b.j = t.c GROUP BY t.tile_id, a.i, b.i),
    rest AS (SELECT tile_id, r, c, v.v - s.v AS v FROM v JOIN s USING (tile_id, r, c)), r2 AS (SELECT t.tile_id, a.i AS r, b.i AS c, sum(a.w * b.w * t.v) AS v FROM rest t JOIN kn a ON a.j = t.r JOIN kn b ON b.j = t.c GROUP BY t.tile_id, a.i, b.i),
    z AS (SELECT tile_id, r, c, s.v + r2.v AS z FROM s JOIN r2 USING (tile_id, r, c)),
    g AS (SELECT *, (coalesce(lead(z) OVER x, z) - coalesce(lag(z) OVER x, z)) / CASE WHEN r IN (0, 7) THEN 1 ELSE 2 END AS gx, (coalesce(lead(z) OVER y, z) - coalesce(lag(z) OVER y, z)) / CASE WHEN c IN (0, 7) THEN 1 ELSE 2 END AS gy
      FROM z WINDOW x AS (PARTITION BY tile_id, c ORDER BY r), y AS (PARTITION BY tile_id, r ORDER BY c))
    SELECT tile_id, 1 / quantile_cont(sqrt(gx * gx + gy * gy), 4e-1) AS flatness FROM g WHERE (r - 35e-1) * (r - 35e-1) + (c - 35e-1) * (c - 35e-1) <= 9 GROUP BY tile_id""", rounded="flatness", digits=4)
def _(b):
    t = b.v_tile.select("tile_id", F.floor(F.col("pos") / 8).cast("int").alias("r"), (F.col("pos") % 8).alias("c"), "v")
    inside = (F.col("_x") - 3.5) * (F.col("_x") - 3.5) + (F.col("_y") - 3.5) * (F.col("_y") - 3.5) <= 9
    return I.flatness(t, ["tile_id"], "r", "c", "v", inside, 1.0, 1.0)


@query("surface_sample", """WITH p AS (SELECT image_id, x, y, CASE WHEN image_id % 7 = 0 AND x >= 80 OR image_id % 3 = 1 AND x >= 400 THEN NULL ELSE quality END AS v FROM v_points),
    n AS (SELECT image_id, CAST(count(v) AS DOUBLE) AS size FROM p GROUP BY image_id HAVING count(v) >= 100),
    d AS (SELECT p.*, size, greatest(sqrt(power((x - 360) / 120e0, 2) + power((y - 360) / 120e0, 2)) - CASE WHEN size > 400 THEN 158853363e-8 - ln(103617677e-8 * size / 400 - 1) / 162750008e-8 END, 0) / 9e-1 AS beyond,
        CAST('0x' || substr(md5(image_id || '|' || x || '|' || y), 1, 10) AS BIGINT) / 1099511627776e0 AS draw FROM p JOIN n USING (image_id) WHERE v IS NOT NULL)
    SELECT image_id, x, y, v FROM d WHERE size <= 400 OR draw < exp(-beyond * beyond)""")
def _(b):
    """Images of 600 points thinned to about 400; some have fewer known points, some too few."""
    v = F.when(((F.col("image_id") % 7 == 0) & (F.col("x") >= 80)) | ((F.col("image_id") % 3 == 1) & (F.col("x") >= 400)), None).otherwise(F.col("quality"))
    d = F.sqrt(F.pow((F.col("x") - 360) / 120.0, F.lit(2.0)) + F.pow((F.col("y") - 360) / 120.0, F.lit(2.0)))
    return I.thin_surface(b.v_points.select("image_id", "x", "y", v.alias("v")), ["image_id"], d, "v", ["image_id", "x", "y"], target=400, least=100)


@query("blend_sources", """
    WITH n AS (SELECT subject_id, axis, e10, avg(density) AS d FROM v_obs WHERE source = 'near' GROUP BY ALL), f AS (SELECT subject_id, axis, e10, avg(density) AS d FROM v_obs WHERE source = 'far' GROUP BY ALL),
    fs AS (SELECT *, lead(e10) OVER w AS ne, lead(d) OVER w AS nd FROM f WINDOW w AS (PARTITION BY subject_id, axis ORDER BY e10)),
    j AS (SELECT n.subject_id, n.axis, n.e10, n.d AS near, CASE WHEN fs.e10 = n.e10 THEN fs.d ELSE fs.d + (fs.nd - fs.d) * (n.e10 - fs.e10) / (fs.ne - fs.e10) END AS far, (abs(n.e10) / 1e1 - 2) / 2e0 AS x
      FROM n LEFT JOIN fs ON fs.subject_id = n.subject_id AND fs.axis = n.axis AND n.e10 >= fs.e10 AND (n.e10 < fs.ne OR (fs.ne IS NULL AND n.e10 = fs.e10))),
    w AS (SELECT *, CASE WHEN x >= 95e-2 THEN 1e0 WHEN x > 5e-2 THEN 1 / (1 + exp((1 - 2 * x) / (x - x * x))) ELSE 0e0 END AS w FROM j),
    s AS (SELECT subject_id, axis, min(e10) AS lo, max(e10) AS hi FROM n GROUP BY ALL)
    SELECT subject_id, axis, e10, (1 - w) * near + w * coalesce(far, 0) AS density FROM w
    UNION ALL SELECT f.subject_id, f.axis, f.e10, f.d FROM f JOIN s USING (subject_id, axis) WHERE f.e10 < lo OR f.e10 > hi""", rounded="density", digits=3)
def _(b):
    o = b.v_obs
    near = o.filter("source = 'near'").groupBy(*KEY, "e10").agg(F.avg("density").alias("density"))
    far = o.filter("source = 'far'").groupBy(*KEY, "e10").agg(F.avg("density").alias("density"))
    return I.blend_sources(far, near, KEY, "density", near_limit=4.0, far_limit=2.0)
