"""Projections, filters and data-quality checks over the bound views."""

from pyspark.sql import Window as W, functions as F

from eccentra import constants as K
from eccentra.functions import geometry as G, naming as N
from eccentra.operators import cells, files as FL, grid, montage, ordered
from eccentra.plans.registry import query

P1 = r"(.*)Subject(-?\d+)_Session(-?\d+)_([a-zA-Z]+)_\((-?\d+),(-?\d+)\)_(-?\d+\.?\d*)x(-?\d+\.?\d*)_(-?\d+)_([a-zA-Z0-9]+)(.*)\.([a-zA-Z]+)$"
P2 = r"^(.*)Subject(-?\d+)_Session(-?\d+)_([a-zA-Z]+)_\((-?\d+\.?\d*),(-?\d+\.?\d*)\)_(-?\d+\.?\d*)x(-?\d+\.?\d*)_(-?\d+)_([a-zA-Z]+)(.*)\.([a-zA-Z]+)$"
_F = [("prefix", "VARCHAR"), ("subject_id", "BIGINT"), ("session_id", "BIGINT"), ("eye", "VARCHAR"),
      ("x_position", "DOUBLE"), ("y_position", "DOUBLE"), ("x_size", "DOUBLE"), ("y_size", "DOUBLE"),
      ("image_id", "BIGINT"), ("modality", "VARCHAR"), ("postfix", "VARCHAR"), ("extension", "VARCHAR")]


def _group(pattern: str, i: int) -> str:
    """SQL for capture ``i``; the checking engine counts at most nine groups."""
    if i <= 9:
        return f"regexp_extract(file_name, '{pattern}', {i})"
    head, tail = pattern, ""
    for _ in range(3):
        k = head.rindex("(")
        head, tail = head[:k], head[k:] + tail
    literal = head.replace(r"\(", "\0").replace("(", "(?:").replace("\0", r"\(")
    return f"regexp_extract(file_name, '{literal}{tail}', {i - 9})"


PARSED = ("parsed AS (SELECT file_no, file_name, dir_subject_id, dir_session_id, " + ", ".join(
    f"TRY_CAST(CASE WHEN regexp_matches(file_name, '{P1}') THEN {_group(P1, i)} "
    f"ELSE {_group(P2, i)} END AS {t}) AS {c}" for i, (c, t) in enumerate(_F, 1))
    + f" FROM v_files WHERE regexp_matches(file_name, '{P1}') OR regexp_matches(file_name, '{P2}'))")
FAM = ", ".join(FL.FAMILY)


def parsed(b):
    return N.parse_file_name(b.v_files)


@query("parse_file_name", f"WITH {PARSED} SELECT file_no, {', '.join(c for c, _ in _F)} FROM parsed")
def _(b):
    return parsed(b).select("file_no", *[c for c, _ in _F])


@query("parse_crop_prefix", f"WITH {PARSED}" + r"""
    SELECT file_no, CAST(regexp_extract(file_name, 'CROP_(-?\d+)_x(-?\d+)y(-?\d+)_', 1) AS BIGINT) AS crop_id,
           CAST(regexp_extract(file_name, 'CROP_(-?\d+)_x(-?\d+)y(-?\d+)_', 2) AS BIGINT) AS crop_x_position,
           CAST(regexp_extract(file_name, 'CROP_(-?\d+)_x(-?\d+)y(-?\d+)_', 3) AS BIGINT) AS crop_y_position
    FROM parsed WHERE prefix <> ''""")
def _(b):
    return parsed(b).select("file_no", *N.crop_fields()).filter("crop_id IS NOT NULL")


@query("render_file_name", f"WITH {PARSED} SELECT file_no, file_name AS rendered FROM parsed")
def _(b):
    return (parsed(b).select("*", *N.crop_fields())
            .select("file_no", N.render_file_name().alias("rendered")))


@query("squared_eccentricity_order", f"""
    WITH {PARSED} SELECT file_no, x_position * x_position + y_position * y_position AS squared_eccentricity,
        row_number() OVER (ORDER BY x_position * x_position + y_position * y_position, x_position, y_position, file_no) AS place
    FROM parsed""")
def _(b):
    f = parsed(b).select("file_no", "x_position", "y_position", (
        F.col("x_position") * F.col("x_position") + F.col("y_position") * F.col("y_position")).alias("squared_eccentricity"))
    out = ordered.row_numbers(f, [], ["squared_eccentricity", "x_position", "y_position", "file_no"], "place")
    return out.select("file_no", "squared_eccentricity", "place")


@query("same_except_modality", f"""
    WITH {PARSED} SELECT subject_id, session_id, image_id, count(*) AS n_files,
        count(DISTINCT modality) AS n_modalities, string_agg(DISTINCT modality, ',' ORDER BY modality) AS modalities
    FROM parsed GROUP BY {FAM}""")
def _(b):
    return FL.modality_families(parsed(b)).select(
        "subject_id", "session_id", "image_id", "n_files", "n_modalities",
        F.array_join("modalities", ",").alias("modalities"))


@query("same_except_modality_pairs", f"""
    WITH {PARSED} SELECT a.file_no, o.file_no AS other_file_no FROM parsed a JOIN parsed o
      USING ({FAM}) WHERE a.modality = 'Confocal' AND o.modality = 'CalculatedSplit'""")
def _(b):
    p = parsed(b)
    return FL.same_except_modality(p.filter("modality = 'Confocal'"), p.filter("modality = 'CalculatedSplit'")).select(
        "file_no", "other_file_no")


@query("consistent_with", f"""
    WITH {PARSED} SELECT file_no, subject_id, eye, nullif(prefix, '') AS prefix FROM parsed
    WHERE eye = 'OD' AND (nullif(prefix, '') IS NULL OR prefix = 'CROP_0_x0y1_')""")
def _(b):
    p = parsed(b).withColumn("prefix", F.expr("nullif(prefix, '')"))
    return p.filter(N.consistent_with(eye="OD", prefix="CROP_0_x0y1_")).select("file_no", "subject_id", "eye", "prefix")


@query("filter_modality", "SELECT file_no, file_name FROM v_files WHERE contains(file_name, 'Confocal') OR contains(file_name, 'DarkField')")
def _(b):
    return FL.filter_modality(b.v_files, ["Confocal", "DarkField"]).select("file_no", "file_name")


@query("modality_counterparts", f"""
    WITH {PARSED} SELECT a.file_no, a.file_name, w.m AS wanted_modality,
      EXISTS (SELECT 1 FROM parsed o WHERE o.modality = w.m AND o.image_id = a.image_id AND o.subject_id = a.subject_id
              AND o.session_id = a.session_id AND o.eye = a.eye AND o.x_position = a.x_position AND o.y_position = a.y_position
              AND o.prefix = a.prefix AND o.postfix = a.postfix) AS present
    FROM parsed a, (VALUES ('CalculatedSplit'), ('DarkField')) AS w(m) WHERE a.modality = 'Confocal'""")
def _(b):
    return FL.modality_counterparts(parsed(b), "Confocal", ["CalculatedSplit", "DarkField"])


@query("modality_completeness", f"""
    WITH {PARSED}, c AS (SELECT dir_subject_id, dir_session_id, count(*) FILTER (modality = 'Confocal') AS n_c,
        count(*) FILTER (modality = 'CalculatedSplit') AS n_s, count(*) FILTER (modality = 'DarkField') AS n_d
      FROM parsed GROUP BY ALL)
    SELECT dir_subject_id, dir_session_id, n_c AS n_Confocal, n_s AS n_CalculatedSplit, n_d AS n_DarkField,
      CASE WHEN n_c < n_s OR n_c < n_d THEN
             CASE WHEN n_s > n_d THEN 'CalculatedSplit' WHEN n_d > n_s THEN 'DarkField' ELSE 'DarkField,CalculatedSplit' END
           ELSE 'Confocal' || CASE WHEN n_c > n_s THEN '' ELSE ',CalculatedSplit' END
                           || CASE WHEN n_c > n_d THEN '' ELSE ',DarkField' END END AS modalities FROM c""")
def _(b):
    return FL.modality_completeness(parsed(b), ["dir_subject_id", "dir_session_id"])


@query("name_integrity", f"""
    WITH {PARSED} SELECT file_no, subject_id, session_id, dir_subject_id, dir_session_id FROM parsed
    WHERE subject_id IS DISTINCT FROM dir_subject_id OR session_id IS DISTINCT FROM dir_session_id""")
def _(b):
    return FL.name_violations(parsed(b)).select("file_no", "subject_id", "session_id", "dir_subject_id", "dir_session_id")


DONE_SQL = """SELECT s.subject_id, l.layer, EXISTS (SELECT 1 FROM v_layer_profile p WHERE p.subject_id = s.subject_id AND p.layer = l.layer) AS done
    FROM v_baseline s, (SELECT DISTINCT layer FROM v_layer_profile) l"""


@query("steps_done_todo", DONE_SQL)
def _(b):
    steps = b.v_layer_profile.select("layer").distinct().groupBy().agg(F.collect_set("layer").alias("steps"))  # the pipeline's few steps, one row
    keyed = b.v_baseline.select("subject_id", F.lit(1).alias("_one")).join(steps.withColumn("_one", F.lit(1)), "_one")
    wanted = keyed.select("subject_id", F.explode("steps").alias("layer"))
    return FL.steps_done_todo(wanted, b.v_layer_profile, ["subject_id", "layer"])


@query("rename_layers", """
    SELECT obs_id, CASE raw_layer WHEN 'GCL_IPL' THEN 'GCL+IPL' WHEN 'INL_OPL' THEN 'INL+OPL'
      WHEN 'PR_RPE' THEN 'PhotoR+RPE' WHEN 'CC_CS' THEN 'Choroid' ELSE raw_layer END AS layer_name FROM v_obs""")
def _(b):
    return b.v_obs.select("obs_id", grid.canonical_layer(F.col("raw_layer")).alias("layer_name"))


@query("layer_allow_deny", """SELECT subject_id, layer, count(*) AS n FROM v_obs
    WHERE layer IN ('RNFL', 'GCL+IPL', 'INL+OPL', 'Choroid') AND layer NOT IN ('GCL+IPL') GROUP BY ALL""")
def _(b):
    kept = grid.allow_deny(b.v_obs, "layer", allow=["RNFL", "GCL+IPL", "INL+OPL", "Choroid"], deny=["GCL+IPL"])
    return kept.groupBy("subject_id", "layer").agg(F.count("*").alias("n"))


@query("subject_exclusion", """SELECT subject_id, axis, e10, density FROM v_profile
    WHERE subject_id NOT IN (3, 7, 12, 28, 31)""")
def _(b):
    return grid.exclude_subjects(b.v_profile, [3, 7, 12, 28, 31]).select("subject_id", "axis", "e10", "density")


@query("signed_eccentricity", """
    SELECT image_id, x, y, a.axis, CASE WHEN a.axis = 'X' THEN (CASE WHEN x - 360 >= 0 THEN 1e0 ELSE -1e0 END) * (CASE WHEN image_id % 2 = 0 THEN -1e0 ELSE 1e0 END)
        ELSE (CASE WHEN y - 360 >= 0 THEN 1e0 ELSE -1e0 END) END
        * sqrt((x - 360) * (x - 360) + (y - 360) * (y - 360)) / 480e0 AS ecc
    FROM v_points, (VALUES ('X'), ('Y')) AS a(axis)""", rounded="ecc")
def _(b):
    p = b.v_points.withColumn("axis", F.explode(F.array(F.lit("X"), F.lit("Y"))))
    return p.select("image_id", "x", "y", "axis", G.signed_eccentricity(
        F.col("x") - 360, F.col("y") - 360, F.col("axis"), F.col("image_id") % 2 == 0).alias("ecc"))


@query("axis_from_name", """
    SELECT file_no, n AS column_name, CASE WHEN upper(n) LIKE 'X%' OR upper(n) LIKE '%X' OR upper(n) LIKE '%\\_X%' ESCAPE '\\' THEN 'X'
      WHEN upper(n) LIKE 'Y%' OR upper(n) LIKE '%Y' OR upper(n) LIKE '%\\_Y%' ESCAPE '\\' THEN 'Y' END AS axis
    FROM (SELECT file_no, CASE file_no % 6 WHEN 0 THEN 'densities_X' WHEN 1 THEN 'Choroid_Y' WHEN 2 THEN 'dens_X_fit'
      WHEN 3 THEN 'location' WHEN 4 THEN 'y_mean' ELSE 'dens_y_fit' END AS n FROM v_files) AS t""")
def _(b):
    names = ["densities_X", "Choroid_Y", "dens_X_fit", "location", "y_mean", "dens_y_fit"]
    n = F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("file_no") % 6 + 1).cast("int"))
    return b.v_files.select("file_no", n.alias("column_name")).withColumn("axis", grid.axis_of_name(F.col("column_name")))


@query("round_to_grid", """
    SELECT image_id, x, y, CAST(round_even((x - 360) / 480e0 * 10, 0) AS INT) AS step,
      (CAST(round_even((x - 360) / 480e0 * 10, 0) AS INT) / 10e0 - 5e-2) * 480 AS lower_px,
      (CAST(round_even((x - 360) / 480e0 * 10, 0) AS INT) / 10e0 + 5e-2) * 480 AS upper_px FROM v_points""", rounded="lower_px upper_px")
def _(b):
    step = G.pixel_steps((F.col("x") - 360).cast("double"))
    lo, hi = G.step_interval_px(F.col("step"))
    return b.v_points.select("image_id", "x", "y", step.alias("step")).select("*", lo.alias("lower_px"), hi.alias("upper_px"))


@query("sector_filter", """
    SELECT image_id, x, y, a.axis FROM v_points, (VALUES ('X'), ('Y')) AS a(axis)
    WHERE CASE WHEN a.axis = 'X' THEN abs(y - 360) < 2e-1 * abs(x - 360) + 200 ELSE abs(x - 360) < 2e-1 * abs(y - 360) + 200 END""")
def _(b):
    p = b.v_points.withColumn("axis", F.explode(F.array(F.lit("X"), F.lit("Y"))))
    return p.filter(G.in_thickness_sector(F.col("axis"), F.col("x") - 360, F.col("y") - 360)).select("image_id", "x", "y", "axis")


@query("sector_filter_counts", """
    SELECT image_id, x, y, a.axis FROM (SELECT *, abs(round_even((x - 360) / 480e0 * 10, 0)) / 10e0 AS ax,
         abs(round_even((y - 360) / 480e0 * 10, 0)) / 10e0 AS ay FROM v_points) AS p, (VALUES ('X'), ('Y')) AS a(axis)
    WHERE CASE WHEN a.axis = 'X' THEN ay <= 2e-1 * ax + 200 / 480e0 ELSE ax <= 2e-1 * ay + 200 / 480e0 END""")
def _(b):
    p = b.v_points.withColumn("axis", F.explode(F.array(F.lit("X"), F.lit("Y"))))
    return p.filter(G.in_count_sector(F.col("axis"), G.pixel_steps((F.col("x") - 360).cast("double")),
                                      G.pixel_steps((F.col("y") - 360).cast("double")))).select("image_id", "x", "y", "axis")


@query("scan_to_degrees", """
    SELECT image_id, x, y, dx_px, dy_px, sqrt(dx_px * dx_px + dy_px * dy_px) / 480e0 AS distance_deg
    FROM (SELECT image_id, x, y, round_even((x - 360) * 117e-4 / 291e-3 * 480, 0) AS dx_px,
                 round_even((y - 360) * 625e-4 / 291e-3 * 480, 0) AS dy_px FROM v_points) AS s""", rounded="distance_deg")
def _(b):
    return grid.scan_to_degrees(b.v_points, F.col("y") - 360, F.col("x") - 360, 0.0625, 0.0117).select(
        "image_id", "x", "y", "dx_px", "dy_px", "distance_deg")


@query("mirror_scan", """
    SELECT tile_id, row_no, col_no, 7 - row_no AS slice_no, CASE WHEN tile_id % 2 = 0 THEN col_no ELSE 7 - col_no END AS sample_no, v
    FROM (SELECT tile_id, CAST(floor(pos / 8) AS INT) AS row_no, pos % 8 AS col_no, v FROM v_tile) AS t""")
def _(b):
    t = b.v_tile.select("tile_id", F.floor(F.col("pos") / 8).cast("int").alias("row_no"), (F.col("pos") % 8).alias("col_no"), "v")
    return grid.mirror_scan(t, "row_no", "col_no", F.lit(7), F.lit(7), F.col("tile_id") % 2 == 0)


VEC = """vec AS (SELECT tile_id, label, pos, CASE WHEN pos < tile_id % 7 OR pos >= 64 - tile_id % 11 OR pos % 13 = tile_id % 13 THEN NULL ELSE v END AS v
      FROM v_tile)"""


def vec(b):
    hole = (F.col("pos") < F.col("tile_id") % 7) | (F.col("pos") >= 64 - F.col("tile_id") % 11) | (
        F.col("pos") % 13 == F.col("tile_id") % 13)
    return b.v_tile.select("tile_id", "label", "pos", F.when(~hole, F.col("v")).alias("v"))


@query("centre_pad_vectors", f"""
    WITH {VEC}, len AS (SELECT tile_id, label, max(pos) + 1 AS n FROM vec GROUP BY ALL),
    wide AS (SELECT label, max(n) AS widest FROM len GROUP BY label)
    SELECT tile_id, pos, CAST(pos + floor((widest - n) / 2) AS INT) AS padded_pos, v
    FROM vec JOIN len USING (tile_id) JOIN wide ON wide.label = len.label""")
def _(b):
    return grid.centre_pad(vec(b), ["tile_id"], ["label"], "pos").select("tile_id", "pos", "padded_pos", "v")


@query("trim_null_edges", f"""
    WITH {VEC}, e AS (SELECT tile_id, max(pos) + 1 AS n, min(pos) FILTER (v IS NOT NULL) AS s, max(pos) - max(pos) FILTER (v IS NOT NULL) AS e
        FROM vec GROUP BY tile_id),
    f AS (SELECT *, n - e - s AS inner_len, CASE WHEN n - e - 52 > 0 THEN least(s, n - e - 52) ELSE s END AS ns,
             CASE WHEN n - s - 52 > 0 THEN least(e, n - s - 52) ELSE e END AS ne FROM e),
    g AS (SELECT tile_id, n,
       CASE WHEN inner_len < 108e-2 * 52 THEN s WHEN (n - ne - ns) / 52e0 > 92e-2 AND (n - ne - ns) / 52e0 < 108e-2 THEN ns
            ELSE CAST(floor((n - 52) / 2) AS INT) END AS a,
       CASE WHEN inner_len < 108e-2 * 52 THEN e WHEN (n - ne - ns) / 52e0 > 92e-2 AND (n - ne - ns) / 52e0 < 108e-2 THEN ne
            ELSE n - CAST(floor((n - 52) / 2) AS INT) - 52 END AS z FROM f)
    SELECT tile_id, CAST(pos - a AS INT) AS pos, coalesce(v, 0) AS v FROM vec JOIN g USING (tile_id) WHERE pos >= a AND pos < n - z""")
def _(b):
    return grid.trim_null_edges(vec(b), ["tile_id"], "pos", "v", goal=52)


@query("resample_vector", f"""
    WITH {VEC}, z AS (SELECT tile_id, pos, coalesce(v, 0) AS v, max(pos) OVER (PARTITION BY tile_id) + 1 AS n FROM vec),
    t AS (SELECT DISTINCT tile_id, n, j, j * (n - 1) / 49e0 AS pt FROM z, range(50) r(j)),
    u AS (SELECT t.tile_id, CAST(j AS INT) AS pos, lo.v + (coalesce(hi.v, lo.v) - lo.v) * (pt - floor(pt)) AS v
      FROM t JOIN z lo ON lo.tile_id = t.tile_id AND lo.pos = floor(pt) LEFT JOIN z hi ON hi.tile_id = t.tile_id AND hi.pos = floor(pt) + 1)
    SELECT tile_id, pos, nullif(v, 0) AS v FROM u""", rounded="v")
def _(b):
    return grid.resample(vec(b), ["tile_id"], "pos", "v", 50)


@query("fill_zero_gaps_linear", f"""
    WITH {VEC}, z AS (SELECT tile_id, pos, v, nullif(v, 0) AS w FROM vec),
    g AS (SELECT *, max(CASE WHEN w IS NOT NULL THEN pos END) OVER (PARTITION BY tile_id ORDER BY pos) AS pl,
                 min(CASE WHEN w IS NOT NULL THEN pos END) OVER (PARTITION BY tile_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS pr FROM z)
    SELECT g.tile_id, g.pos, CASE WHEN g.w IS NOT NULL THEN g.w WHEN pl IS NULL THEN r.w WHEN pr IS NULL THEN l.w
       ELSE round_even(l.w + (g.pos - pl) * ((r.w - l.w) / (pr - pl)), 0) END AS v
    FROM g LEFT JOIN z l ON l.tile_id = g.tile_id AND l.pos = pl LEFT JOIN z r ON r.tile_id = g.tile_id AND r.pos = pr""")
def _(b):
    return grid.fill_zero_gaps(vec(b), ["tile_id"], "pos", "v")


@query("border_trim", f"""
    WITH {VEC}, e AS (SELECT tile_id, max(pos) AS top, min(pos) FILTER (v IS NOT NULL) AS lo, max(pos) FILTER (v IS NOT NULL) AS hi FROM vec GROUP BY tile_id)
    SELECT tile_id, label, pos, v FROM vec JOIN e USING (tile_id) WHERE CASE WHEN hi < top THEN pos <= hi ELSE pos >= lo END""")
def _(b):
    return grid.border_trim(vec(b), ["tile_id"], "pos", "v")


@query("clean_density", "SELECT subject_id, axis, e10, density FROM v_obs WHERE density <> 0 AND density <= 5e4")
def _(b):
    return cells.clean_density(b.v_obs, "density", 5e4).select("subject_id", "axis", "e10", "density")


@query("obvious_low_filter", """SELECT subject_id, axis, e10, density FROM v_profile
    WHERE abs(e10) BETWEEN 10 AND 100 AND density > 20000 / (1 + power(abs(e10) / 10e0, 14e-1))""")
def _(b):
    return cells.obvious_low_filter(b.v_profile, "density").select("subject_id", "axis", "e10", "density")


@query("robust_estimate_pick", """
    WITH t AS (SELECT subject_id, axis, e10, density AS d1, thickness * 400 AS d2, density + thickness * 100 AS d3 FROM v_profile WHERE thickness IS NOT NULL),
    m AS (SELECT *, greatest(d1, d2, d3) AS hi, d1 + d2 + d3 - greatest(d1, d2, d3) - least(d1, d2, d3) AS md FROM t)
    SELECT subject_id, axis, e10, CASE WHEN md < 5000 + 45000 * exp(-abs(e10 / 10e0)) THEN hi ELSE md END AS density FROM m""", rounded="density")
def _(b):
    d = F.array(F.col("density"), F.col("thickness") * 400, F.col("density") + F.col("thickness") * 100)
    return b.v_profile.filter("thickness IS NOT NULL").select(
        "subject_id", "axis", "e10", G.robust_estimate(d, G.degrees_of(F.col("e10"))).alias("density"))


@query("ring_radius_to_density", """SELECT subject_id, axis, e10, sqrt(3e0) / 2 * power(n_obs / 300e0 * 480 / 291e-3, 2) AS density FROM v_profile""", rounded="density")
def _(b):
    return b.v_profile.select("subject_id", "axis", "e10", G.ring_density(F.col("n_obs"), F.lit(300.0)).alias("density"))


@query("density_to_spacing", "SELECT subject_id, axis, e10, sqrt(2 / density / sqrt(3e0)) / 291e-3 * 60 AS spacing FROM v_profile", rounded="spacing")
def _(b):
    return b.v_profile.select("subject_id", "axis", "e10", G.density_spacing(F.col("density")).alias("spacing"))


@query("count_to_density", """SELECT subject_id, axis, e10, CASE WHEN density > 4819 THEN power(480 / 291e-3, 2) * n_obs / density ELSE 0 END AS out
    FROM v_profile""", rounded="out")
def _(b):
    return b.v_profile.select("subject_id", "axis", "e10", G.count_density(F.col("n_obs"), F.col("density")).alias("out"))


@query("inverse_axis", "SELECT subject_id, axis, -e10 AS e10, density FROM v_profile WHERE axis = 'X'")
def _(b):
    return b.v_profile.filter("axis = 'X'").select("subject_id", "axis", (-F.col("e10")).alias("e10"), "density")


@query("age_years", "SELECT subject_id, (visit_date - birth_date) / 365e0 AS age FROM v_baseline")
def _(b):
    return b.v_baseline.select("subject_id", G.age_years(F.col("birth_date"), F.col("visit_date")).alias("age"))


@query("eye_side_select", """SELECT subject_id, CASE WHEN laterality = 'OD' THEN axial_right ELSE axial_left END AS axial_length,
    CASE WHEN laterality = 'OD' THEN sphere_right ELSE sphere_left END AS sphere FROM v_baseline""")
def _(b):
    from eccentra.operators.cohort import with_subject_values
    return with_subject_values(b.v_baseline).select("subject_id", "axial_length", "sphere")


CODES = """CASE o_orderkey % 14 WHEN 0 THEN 'TL' WHEN 1 THEN 'C' WHEN 2 THEN 'br' WHEN 3 THEN concat('T', CAST(o_custkey % 9 AS VARCHAR(9)), 'S', CAST(o_custkey % 7 AS VARCHAR(9)))
    WHEN 4 THEN concat('n', CAST(o_custkey % 12 AS VARCHAR(9))) WHEN 5 THEN concat('I', CAST(o_custkey % 5 AS VARCHAR(9)), '.5') WHEN 6 THEN concat(CAST(o_custkey % 8 AS VARCHAR(9)), 'T', CAST(o_custkey % 6 AS VARCHAR(9)), 'I')
    WHEN 7 THEN concat(CAST(o_custkey % 11 AS VARCHAR(9)), 'N') WHEN 8 THEN '12' WHEN 9 THEN 'T' WHEN 10 THEN concat('S', CAST(o_custkey % 4 AS VARCHAR(9)), 'N', CAST(o_custkey % 3 AS VARCHAR(9))) WHEN 11 THEN 'ML'
    WHEN 12 THEN 'T1S2N3' ELSE 'MR' END"""


@query("parse_location_shorthand", rf"""
    WITH c AS (SELECT o_orderkey, upper({CODES}) AS code, CASE WHEN o_custkey % 2 = 0 THEN -1e0 ELSE 1e0 END AS flip FROM orders),
    s AS (SELECT *, CASE WHEN code IN ('TL', 'ML', 'BL') THEN 1e0 WHEN code IN ('TM', 'C', 'BM') THEN 0e0 WHEN code IN ('TR', 'MR', 'BR') THEN -1e0 END AS cx,
         CASE WHEN code IN ('TL', 'TM', 'TR') THEN 1e0 WHEN code IN ('ML', 'C', 'MR') THEN 0e0 WHEN code IN ('BL', 'BM', 'BR') THEN -1e0 END AS cy,
         regexp_matches(code, '^([A-Z][0-9.]+)([A-Z][0-9.]+)?$') AS lead, regexp_matches(code, '^([0-9.]+[A-Z])([0-9.]+[A-Z])?$') AS trail FROM c)
    SELECT o_orderkey, code, CASE WHEN cx IS NOT NULL THEN cx WHEN lead THEN coalesce(flip * TRY_CAST(regexp_extract(code, 'T([0-9.]+)', 1) AS DOUBLE), -flip * TRY_CAST(regexp_extract(code, 'N([0-9.]+)', 1) AS DOUBLE), 0)
        WHEN trail THEN coalesce(flip * TRY_CAST(regexp_extract(code, '([0-9.]+)T', 1) AS DOUBLE), -flip * TRY_CAST(regexp_extract(code, '([0-9.]+)N', 1) AS DOUBLE), 0) END AS x,
      CASE WHEN cy IS NOT NULL THEN cy WHEN lead THEN coalesce(TRY_CAST(regexp_extract(code, 'S([0-9.]+)', 1) AS DOUBLE), -TRY_CAST(regexp_extract(code, 'I([0-9.]+)', 1) AS DOUBLE), 0)
        WHEN trail THEN coalesce(TRY_CAST(regexp_extract(code, '([0-9.]+)S', 1) AS DOUBLE), -TRY_CAST(regexp_extract(code, '([0-9.]+)I', 1) AS DOUBLE), 0) END AS y FROM s""")
def _(b):
    o = b.orders.select("o_orderkey", F.expr(CODES).alias("raw"), F.when(F.col("o_custkey") % 2 == 0, "OD").otherwise("OS").alias("eye"))
    x, y = N.shorthand_location(F.col("raw"), F.col("eye"))
    return o.select("o_orderkey", F.upper("raw").alias("code"), x.alias("x"), y.alias("y"))


@query("significance_marker", """SELECT file_no, CASE WHEN p < 1e-3 THEN '***' WHEN p < 1e-2 THEN '**' WHEN p < 5e-2 THEN '*' ELSE '' END AS marker
    FROM (SELECT file_no, (file_no % 1024) / 8192e0 AS p FROM v_files) AS t""")
def _(b):
    p = (F.col("file_no") % 1024) / 8192.0
    return b.v_files.select("file_no", G.significance_marker(p).alias("marker"))


@query("significance_alpha", """SELECT file_no, CASE WHEN p > 5e-2 THEN 0e0 ELSE least(1e0, 15e-2 + 85e-2 * power(1 - p, 4)) END AS alpha
    FROM (SELECT file_no, (file_no % 1024) / 8192e0 AS p FROM v_files) AS t""", rounded="alpha")
def _(b):
    p = (F.col("file_no") % 1024) / 8192.0
    return b.v_files.select("file_no", G.significance_alpha(p).alias("alpha"))


SIZE = "CAST(floor(least(300e0, 160 * sqrt(1 + (x * x + y * y) / 20e0))) AS INT)"


@query("adaptive_crop_size", f"SELECT element_id, {SIZE} AS crop_size FROM v_elements")
def _(b):
    d = F.sqrt((F.col("x") * F.col("x") + F.col("y") * F.col("y")).cast("double"))
    return b.v_elements.select("element_id", G.crop_size(d).alias("crop_size"))


@query("crop_grid", f"""
    WITH s AS (SELECT element_id, {SIZE} AS size FROM v_elements),
    n AS (SELECT *, ceil(1 + (720e0 / size - 1) / (1 - 1e0 / 3)) AS n FROM s),
    o AS (SELECT element_id, size, CAST(greatest(floor(size * (720e0 / size - 1) / (n - 1)), 1) AS INT) AS step0,
             CAST(floor(size * (1 - (1 - (720e0 / size - 1) / (n - 1)))) AS INT) AS step FROM n)
    SELECT element_id, size AS crop_size, CAST(x.i * step AS INT) AS crop_x, CAST(y.i * step AS INT) AS crop_y
    FROM o, range(0, 20) x(i), range(0, 20) y(i) WHERE x.i * step <= 720 - size AND y.i * step <= 720 - size""")
def _(b):
    d = F.sqrt((F.col("x") * F.col("x") + F.col("y") * F.col("y")).cast("double"))
    s = b.v_elements.select("element_id", G.crop_size(d).alias("crop_size"))
    at = G.crop_origins(F.col("crop_size"))
    return (s.withColumn("_at", at).withColumn("crop_x", F.explode("_at"))
            .select("element_id", "crop_size", "crop_x", F.explode("_at").alias("crop_y")))


@query("patch_grid", """
    WITH s AS (SELECT element_id, CAST(600 + element_id % 200 AS INT) AS w, CAST(150 + element_id % 90 AS INT) AS h FROM v_elements),
    n AS (SELECT *, CASE WHEN w <= 185 THEN 1 ELSE greatest(2, CAST(ceil((w - 185) / 171e0) AS INT) + 1) END AS nx,
                    CASE WHEN h <= 185 THEN 1 ELSE greatest(2, CAST(ceil((h - 185) / 171e0) AS INT) + 1) END AS ny FROM s)
    SELECT element_id, CAST(i.i * ny + j.j + 1 AS BIGINT) AS patch_no,
      CASE WHEN nx = 1 THEN 0 ELSE CAST(floor(i.i * (w - 185) / CAST(nx - 1 AS DOUBLE)) AS INT) END AS patch_x,
      CASE WHEN ny = 1 THEN 0 ELSE CAST(floor(j.j * (h - 185) / CAST(ny - 1 AS DOUBLE)) AS INT) END AS patch_y
    FROM n, range(0, 12) i(i), range(0, 12) j(j) WHERE i.i < nx AND j.j < ny""")
def _(b):
    s = b.v_elements.select("element_id", (600 + F.col("element_id") % 200).cast("int").alias("w"), (150 + F.col("element_id") % 90).cast("int").alias("h"))
    return montage.patch_grid(s, "w", "h", 185).select("element_id", "patch_no", "patch_x", "patch_y")


@query("drop_mostly_dark", """
    WITH t AS (SELECT image_id, CAST(floor(x / 4) AS INT) AS tx, CAST(floor(y / 4) AS INT) AS ty, sum(CASE WHEN v > 50 THEN 1 ELSE 0 END) AS bright, count(*) AS n
      FROM v_crop_pixels GROUP BY ALL) SELECT image_id, tx, ty, CAST(bright AS BIGINT) AS bright, n FROM t WHERE bright >= 8e-1 * 4 * 4""")
def _(b):
    return cells.drop_mostly_dark(b.v_crop_pixels, ["image_id"], 4, F.col("v") > 50, 0.8)


@query("affine_apply", "SELECT element_id, (a11 * 100 + a12 * 50 + a13) * 5e-1 AS px, (a21 * 100 + a22 * 50 + a23) * 5e-1 AS py FROM v_elements")
def _(b):
    x, y = G.affine(F.lit(100.0), F.lit(50.0), scale=0.5)
    return b.v_elements.select("element_id", x.alias("px"), y.alias("py"))


@query("affine_translate_origin", """
    WITH c AS (SELECT mosaic_id, floor(min(least(a13, a12 * 720 + a13, a11 * 720 + a13, (a11 + a12) * 720 + a13))) AS mx,
        floor(min(least(a23, a22 * 720 + a23, a21 * 720 + a23, (a21 + a22) * 720 + a23))) AS my FROM v_elements GROUP BY mosaic_id)
    SELECT element_id, a13 - mx AS a13, a23 - my AS a23 FROM v_elements JOIN c USING (mosaic_id)""")
def _(b):
    return montage.translate_to_origin(b.v_elements, "mosaic_id").select("element_id", "a13", "a23")


@query("right_below_relation", """
    SELECT a.element_id, n.element_id AS other_id, n.a13 > a.a13 AS is_right, n.a23 > a.a23 AS is_below
    FROM v_elements a JOIN v_elements n USING (mosaic_id) WHERE abs(a.x - n.x) + abs(a.y - n.y) = 1""")
def _(b):
    return montage.neighbours(b.v_elements).select(
        "element_id", "other_id", (F.col("o_a13") > F.col("a13")).alias("is_right"), (F.col("o_a23") > F.col("a23")).alias("is_below"))


@query("interval_widen", """
    SELECT element_id, CASE WHEN e2 - s2 > e1 - s1 THEN s2 ELSE s1 END AS start1, CASE WHEN e2 - s2 > e1 - s1 THEN e2 ELSE e1 END AS end1,
      CASE WHEN e1 - s1 > e2 - s2 THEN s1 ELSE s2 END AS start2, CASE WHEN e1 - s1 > e2 - s2 THEN e1 ELSE e2 END AS end2
    FROM (SELECT element_id, x AS s1, x + element_id % 5 AS e1, y AS s2, y + mosaic_id % 7 AS e2 FROM v_elements) AS t""")
def _(b):
    t = b.v_elements.select("element_id", F.col("x").alias("s1"), (F.col("x") + F.col("element_id") % 5).alias("e1"),
                            F.col("y").alias("s2"), (F.col("y") + F.col("mosaic_id") % 7).alias("e2"))
    w = G.widen_intervals(*[F.col(c) for c in ("s1", "e1", "s2", "e2")])
    return t.select("element_id", *[c.alias(n) for c, n in zip(w, ("start1", "end1", "start2", "end2"))])


@query("fix_modality_names", "SELECT file_no, replace(replace(file_name, '_850nm', '_OA850nm'), '_790nm', '_OA790nm') AS file_name FROM v_files")
def _(b):
    return b.v_files.select("file_no", N.fix_modality_names("file_name").alias("file_name"))


@query("affine_compose", """
    SELECT a.element_id, n.element_id AS other_id, a.a11 * n.a11 + a.a12 * n.a21 AS a11, a.a11 * n.a12 + a.a12 * n.a22 AS a12,
      a.a11 * n.a13 + a.a12 * n.a23 + a.a13 AS a13, a.a21 * n.a11 + a.a22 * n.a21 AS a21, a.a21 * n.a12 + a.a22 * n.a22 AS a22,
      a.a21 * n.a13 + a.a22 * n.a23 + a.a23 AS a23
    FROM v_elements a JOIN v_elements n USING (mosaic_id) WHERE abs(a.x - n.x) + abs(a.y - n.y) = 1""")
def _(b):
    return montage.neighbours(b.v_elements).select("element_id", "other_id", *G.affine_product("", "o_"))
