import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from eccentra.operators import averages, cells, cohort, fits, graph, images, integrals as I, joins, ordered, peaks, points as P, profiles, smoothing, stats


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_positions_and_quantiles_match_numpy(spark):
    rng = random.Random(3)
    data = [(g, float(rng.randrange(40))) for g in "ab" for _ in range(300 if g == "a" else 7)]
    df = spark.createDataFrame(data, "g string, v double")
    q = {r.g: r for r in ordered.quantiles(df, ["g"], "v", {"m": 0.5, "l": 0.15}).collect()}
    pos = {(r.g, r.v): r for r in ordered.positions(df, ["g"], "v").collect()}
    for g in "ab":
        v = np.array([x for k, x in data if k == g])
        assert q[g].m == pytest.approx(np.quantile(v, 0.5)) and q[g].l == pytest.approx(np.quantile(v, 0.15))
        for x in set(v):
            assert pos[(g, x)].tied_before == (v < x).sum() and pos[(g, x)].avg_rank == (v < x).sum() + ((v == x).sum() + 1) / 2


def test_kendall_against_pairs(spark):
    rng = random.Random(5)
    data = [(float(rng.randrange(9)), float(rng.randrange(7))) for _ in range(60)]
    c = d = 0
    for i in range(60):
        for j in range(i):
            s = (data[i][0] - data[j][0]) * (data[i][1] - data[j][1])
            c, d = c + (s > 0), d + (s < 0)
    r = stats.kendall(spark.createDataFrame([("k", *t) for t in data], "k string, x double, y double"), ["k"], "x", "y").first()
    tx = sum(a[0] == b[0] for i, a in enumerate(data) for b in data[:i])
    ty = sum(a[1] == b[1] for i, a in enumerate(data) for b in data[:i])
    tot = 60 * 59 / 2
    assert r.tau == pytest.approx((c - d) / math.sqrt((tot - tx) * (tot - ty)))


def test_spearman_is_invariant_to_monotone_maps(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([("k", rng.random(), rng.random()) for _ in range(50)], "k string, x double, y double")
    a = stats.spearman(df, ["k"], "x", "y").first()
    b = stats.spearman(df.withColumn("x", F.exp("x")).withColumn("y", F.col("y") * 3 + 1), ["k"], "x", "y", bounded=True).first()
    assert a.rho == pytest.approx(b.rho) and a.p == pytest.approx(b.p) and 0 < a.p < 1


def test_residuals_are_orthogonal(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([("k", rng.random(), rng.random(), rng.random()) for _ in range(40)], "k string, a double, b double, y double")
    r = stats.residualise(df, ["k"], "y", ["a", "b"])
    s = r.agg(F.sum("residual"), F.sum(F.col("residual") * F.col("a")), F.sum(F.col("residual") * F.col("b"))).first()
    assert all(abs(v) < 1e-10 for v in s)


def test_bins_and_strata_edges(spark):
    df = spark.createDataFrame([(20.0,), (35.0,), (65.0,), (65.5,)], "a double")
    got = [r.s for r in df.select(cohort.half_open_bins(F.col("a"), [20, 35, 50, 65]).alias("s")).collect()]
    assert got == ["20-35", "35-50", "50-65", None]


def test_percentile_band_is_null_for_null_majority(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 1.0), ("b", 3.0), ("b", None)], "k string, v double")
    got = {r.k: r.median for r in cohort.percentile_band(df, ["k"], "v").collect()}
    assert got == {"a": None, "b": 2.0}


def test_gap_of_exactly_four_steps_is_filled(spark):
    df = spark.createDataFrame([("k", e, float(e)) for e in (0, 4, 9)], "k string, e10 int, v double")
    assert [e for e, in rows(profiles.fill_small_gaps(df, ["k"], "v"), "e10")] == [0, 1, 2, 3, 4, 9]


def test_gap_ranges_have_sentinels(spark):
    df = spark.createDataFrame([("k", e) for e in (0, 3, 7, 8)], "k string, e10 int")
    assert rows(profiles.gap_ranges(df, ["k"]), "e10", "length") == [(0, 0), (6, 3), (8, 0)]


def test_plateau_peak_counts_once(spark):
    df = spark.createDataFrame([("k", i, float(v)) for i, v in enumerate([0, 2, 2, 2, 1, 3, 0])], "k string, i int, v double")
    assert rows(peaks.find_peaks(df, ["k"], "i", "v"), "kind", "place") == [(-1, 4), (1, 2), (1, 5)]


def test_orphan_counts_move_toward_zero(spark):
    data = [("k", -3, 5, None), ("k", -2, 2, None), ("k", -1, 1, 10), ("k", 2, 7, None), ("k", 3, 4, 10)]
    df = spark.createDataFrame(data, "k string, e10 int, n long, area long")
    assert rows(cells.relocate_orphans(df, ["k"], "n", "area"), "e10", "n") == [(-1, 8), (3, 4)]


def test_gaussian_keeps_constants_and_skips_nulls(spark):
    df = spark.createDataFrame([("k", i, None if i == 4 else 2.5) for i in range(12)], "k string, i int, v double")
    assert all(r.v == pytest.approx(2.5) for r in smoothing.gaussian(df, ["k"], "i", "v", 3).collect())


def test_savgol_reproduces_a_parabola(spark):
    df = spark.createDataFrame([("k", i, float(i * i - 3 * i)) for i in range(25)], "k string, i int, v double")
    assert all(r.v == pytest.approx(r.i ** 2 - 3 * r.i) for r in smoothing.savgol(df, ["k"], "i", "v", 11).collect())


def test_lowess_reproduces_a_line(spark):
    df = spark.createDataFrame([("k", i, 2.0 * i + 1) for i in range(60)], "k string, i int, v double")
    assert all(r.v == pytest.approx(2 * r.i + 1) for r in smoothing.lowess(df, ["k"], "i", "v").collect())


def flat(spark, d=100.0):
    return spark.createDataFrame([(1, a, e, d) for a in "XY" for e in range(-100, 101)], "s int, axis string, e10 int, v double")


def test_polar_integral_of_a_constant(spark):
    r = I.polar_integrals(flat(spark), ["s"], "v", {"t": (1.0, 0.0), "ring": (1.0, 0.3)}, maxima=1.0).first()
    assert r.t == pytest.approx(100 * math.pi, rel=1e-6) and r.max_x == 100
    assert r.ring == pytest.approx(100 * math.pi * (1 - 0.09), rel=1e-6)


def test_disk_count_against_direct_sampling(spark):
    rng = np.random.default_rng(4)
    prof = {a: 50 + rng.random(201) * 20 for a in "XY"}
    prof["X"][195], prof["Y"][88] = 500.0, 400.0          # one peak near the edge of the grid
    df = spark.createDataFrame([(1, a, e, float(prof[a][e + 100])) for a in "XY" for e in range(-100, 101)], "s int, axis string, e10 int, v double")
    got = I.disk_cell_count(df, ["s"], "v", 3.33).first().cells
    r = np.linspace(0.0001, 3.33, 500)
    at = np.arange(-100, 101) / 10
    total = np.zeros(500)
    for a in "XY":
        c = min(max(int(np.argmax(prof[a])), 2), 198)
        q = np.polyfit(np.arange(-2, 3), prof[a][c - 2:c + 3], 2)
        peak = (c - 100 - q[1] / (2 * q[0])) / 10
        total += np.interp(peak + r, at, prof[a]) + np.interp(peak - r, at, prof[a])
    f = total / 4 * r
    want = 0.291 ** 2 * 2 * math.pi * np.sum((f[1:] + f[:-1]) / 2 * np.diff(r))
    assert got == pytest.approx(want, rel=1e-9)


def test_components_against_union_find(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)]
    parent = list(range(80))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    nodes = spark.createDataFrame([("k", i) for i in range(80)], "k string, id long")
    e = spark.createDataFrame([("k", a, b) for a, b in edges], "k string, a long, b long")
    got = {r.id: r.component for r in graph.components(nodes, e, ["k"], "id", "a", "b").collect()}
    assert got == {i: find(i) for i in range(80)}


def scatter_points(spark, n=120, size=60, seed=11):
    rng = random.Random(seed)
    pts = [("i", rng.randrange(size), rng.randrange(size), rng.random()) for _ in range(n)]
    return pts, spark.createDataFrame(pts, "image_id string, x int, y int, q double")


def test_nearest_distance_against_all_pairs(spark):
    pts, df = scatter_points(spark, 60, 400)
    got = {(r.x, r.y): r.distance for r in joins.nearest_distance(df, ["image_id"]).collect()}
    for _, x, y, _ in pts:
        want = min(math.dist((x, y), (a, b)) for k, (_, a, b, _) in enumerate(pts) if pts[k] is not None and (a, b) != (x, y))
        assert got[(x, y)] in (0.0, pytest.approx(want))


def test_suppression_equals_one_by_one(spark):
    pts, df = scatter_points(spark)
    best = {}
    for _, x, y, q in pts:
        best[(x, y)] = max(q, best.get((x, y), 0))
    kept = []
    for p in sorted(best, key=best.get, reverse=True):
        if all(math.dist(p, k) > 6 for k in kept):
            kept.append(p)
    assert rows(P.suppress_close(df, ["image_id"], 6, "q"), "x", "y") == sorted(kept)


def test_greedy_merge_equals_one_by_one(spark):
    pts, df = scatter_points(spark)
    n = {}
    for _, x, y, _ in pts:
        n[(x, y)] = n.get((x, y), 0) + 1
    order = sorted(n)
    label = {}
    for p in order:
        if p not in label:
            for o in order:
                if math.dist(p, o) <= 6:
                    label[o] = p
    groups = {}
    for p, k in label.items():
        groups.setdefault(k, []).append(p)
    want = sorted((round(sum(x * n[(x, y)] for x, y in g) / (t := sum(n[p] for p in g))), round(sum(y * n[(x, y)] for x, y in g) / t), t) for g in groups.values())
    assert rows(P.merge_greedy(df, ["image_id"], 6), "x", "y", "n_points") == want


def test_random_intercept_recovers_the_slope(spark):
    rng = np.random.default_rng(0)
    data = []
    for s in range(40):
        u = rng.normal(0, 2)
        for _ in range(12):
            x = rng.normal()
            data.append(("k", s, float(x), float(1 + 0.7 * x + u + rng.normal(0, 0.5))))
    r = stats.random_intercept(spark.createDataFrame(data, "k string, s int, x double, y double"), ["k"], "s", "x", "y").first()
    assert abs(r.slope - 0.7) < 0.08 and r.p < 1e-6 and 4 < r.ratio < 60


def test_exponential_fit_recovers_parameters(spark):
    x = np.arange(10, 101) / 10
    df = spark.createDataFrame([("k", float(v), float(6000 + 90000 * math.exp(-0.5 * v))) for v in x], "k string, x double, y double")
    r = fits.exponential(df, ["k"], "x", "y").first()
    assert abs(r.p2 - 0.5) < 0.02 and abs(r.p0 - 6000) < 300


def test_exponential_average_resets_at_null(spark):
    v = [1.0, 2.0, None, 4.0, 8.0]
    df = spark.createDataFrame([("k", i, x) for i, x in enumerate(v)], "k string, i int, v double")
    assert averages.exponential_average(df, ["k"], ["i"], "v", 0.25).first().average == pytest.approx(0.25 * 8 + 0.75 * 4)


def test_lookup_takes_the_first_reference_level(spark):
    src = spark.createDataFrame([(0, 1, 0.3), (0, 2, 1.0)], "t long, level int, cdf double")
    ref = spark.createDataFrame([(0, 5, 0.2), (0, 6, 0.3), (0, 9, 1.0)], "t long, level int, cdf double")
    assert rows(joins.first_at_least(src, ref, ["t"], "cdf", "level"), "level", "lookup") == [(1.0, 6.0), (2.0, 9.0)]


def test_clip_rejects_unknown_modes(spark):
    with pytest.raises(ValueError):
        images.clip_outliers(flat(spark), ["s"], "v", replace="mean")


def test_slope_median_with_ties_equals_all_pairs(spark):
    rng = random.Random(6)
    pts = [(float(rng.randrange(30)), float(rng.randrange(30))) for _ in range(40)]
    df = spark.createDataFrame([("a", *p) for p in pts], "g string, x double, y double")
    slopes = sorted((q[1] - p[1]) / (q[0] - p[0]) for i, p in enumerate(pts) for q in pts[:i] if p[0] != q[0])
    m = len(slopes)
    got = fits.theil_sen(df, ["g"], "x", "y").first()
    assert got.slope == pytest.approx((slopes[(m - 1) // 2] + slopes[m // 2]) / 2, abs=1e-12)
    assert got.lower in slopes and got.upper in slopes and got.lower < got.slope < got.upper


def test_layer_collection_reads_all_three_documents(spark, tmp_path):
    import json

    from eccentra.sources import readers as R

    thick = {"study": {"s": {"0": {"PR_RPE": {"vector": [1.0] * 5}, "RNFL": {"vector": [2.0] * 4}}, "1": {"PR_RPE": {"vector": [3.0] * 3}}, "2": {"RNFL": {"vector": [7.0] * 4}}}},
             "spacing": {"x": 1.0, "y": 2.0, "z": 3.0}}
    osd = {"study": {"s": {"0": {"vector": [2.0, None, 4.0]}}}}
    cvi = {"study": {"s": {"0": {"vector": [None, 0.5, None, 0.25, 0.75, None]}, "1": {"vector": [float(i) for i in range(1, 11)]}}}}
    for name, doc in (("t", thick), ("c", cvi), ("o", osd)):
        at = tmp_path / name / "Subject=4" / "Session=1"
        at.mkdir(parents=True)
        (at / "doc.json").write_text(json.dumps(doc))
    out = {}
    for r in R.layer_collection(spark, *(str(tmp_path / n) for n in "tco")).collect():
        assert (r.subject_id, r.session_id, r.study, r.spacing.y) == (4, 1, "s", 2.0)
        out.setdefault((r.layer, r.slice), {})[r.pos] = r.thickness
    vec = {k: [v[i] for i in range(len(v))] for k, v in out.items()}
    stretched = np.interp(np.linspace(0, 2, 5), np.arange(3), [2, 0, 4])
    assert vec[("OS", 0)] == [x if x else None for x in stretched] and vec[("OS", 1)] == [None] * 3 and ("OS", 2) not in vec
    assert vec[("CVI", 0)] == [0.5, 0.0, 0.25, 0.75]  # goal: mean of 5, 4, 3, 4
    assert vec[("CVI", 1)] == [4.0, 5.0, 6.0, 7.0]  # cropped about the centre
    assert vec[("RNFL", 2)] == [7.0] * 4 and vec[("PhotoR+RPE", 1)] == [3.0] * 3
