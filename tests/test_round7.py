"""Tests of the seventh round's findings."""

import io
import math
import random
from collections import Counter
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from eccentra.operators import closeness, fits, graph, grid, joins, montage, points as P
from eccentra.plans import q_join
from eccentra.sources import readers as R

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_parts_have_their_p(spark):
    """The p of a part was computed and dropped."""
    rows = entry.queries()["spearman_parts"](spark, SF).collect()
    assert {r["p"] is None for r in rows if r["n"] > 2 and r["rho"] is not None} == {False}
    assert all(0 <= r["p"] <= 1 and (r["p"] < 1e-6) == (abs(r["rho"]) == 1) for r in rows if r["p"] is not None and r["n"] < 5)
    assert all(r["p"] is None for r in rows if r["n"] <= 2 or r["rho"] is None)


def elements(seed: int, mosaics: int, reach: int):
    """Elements on grids wider than a tile, some places empty and some taken twice; (rows, DataFrame schema)."""
    rng = random.Random(seed)
    rows = []
    for m in range(mosaics):
        for x in range(-reach, reach + 1):
            for y in (-9, -8, 0, 7, 8):
                for _ in range(rng.choice((0, 1, 1, 1, 2))):
                    at = [None if rng.random() < 0.02 else c * 512.0 + rng.randint(-30, 30) for c in (x, y)]
                    rows.append((7 * len(rows) + m, m, x, y, *at))
    return rows


def patches_of(e):
    w, h = 400 + e % 300, 300 + e % 90
    nx, ny = (max(2, math.ceil((s - 185) / 171) + 1) for s in (w, h))
    return [(i * ny + j + 1, math.floor(i * (w - 185) / (nx - 1)), math.floor(j * (h - 185) / (ny - 1)), (e * 7 + i * 13 + j * 29) % 97) for i in range(nx) for j in range(ny)]


class Given:
    """Bindings of one view."""

    def __init__(self, df):
        self.v_elements = df


def test_patches_of_neighbours_equal_trying_all(spark):
    rows = elements(3, 3, 11)
    df = spark.createDataFrame(rows, "element_id bigint, mosaic_id bigint, x int, y int, a13 double, a23 double").repartition(3)
    best, near = {}, {}
    for e, m, x, y, ax, ay in rows:
        for o, om, ox, oy, bx, by in rows:
            if m != om or abs(x - ox) > 1 or abs(y - oy) > 1:
                continue
            known = None not in (ax, ay, bx, by)
            for no, px, py, _ in patches_of(e):
                for k, qx, qy, n in patches_of(o):
                    flat = math.hypot(qx - px, qy - py)
                    if known and 0 < (d := math.sqrt((qx - px + bx - ax) ** 2 + (qy - py + by - ay) ** 2)) < 480:
                        near.setdefault((e, no), []).append(d)
                    if abs(x - ox) + abs(y - oy) > 1 or (e, no) == (o, k) or (e != o and (x, y) == (ox, oy)):
                        continue
                    if e != o and (px == qx or py == qy):
                        if not known:
                            continue
                        flat = math.hypot(ax - bx, ay - by) - abs(py - qy if px == qx else px - qx)
                    if (score := n * (1 - flat / 1000)) > 0:
                        best.setdefault((e, no), []).append((-round(score, 6), o, k))
    results = [("element_id", "bigint"), ("patch_no", "bigint"), ("n_others", "bigint"), ("nearest", "double"), ("total", "double")]
    got = {tuple(r)[:2]: tuple(r)[2:] for r in q_join._compare(Given(df), montage.EIGHT + [(0, 0)], lambda i, p: q_join.near_rows(i, p), results).collect()}
    assert len({e for e, *_ in rows}) == len(rows) and set(got) == set(near)
    assert all(got[k][0] == len(v) and got[k][1] == pytest.approx(min(v)) and got[k][2] == pytest.approx(sum(v)) for k, v in near.items())
    results = [*[(n, "bigint") for n in ("element_id", "patch_no", "other_id", "other_no")], ("score", "double")]
    got = {tuple(r)[:2]: (-round(r[4], 6), r[2], r[3]) for r in q_join._compare(Given(df), montage.FOUR + [(0, 0)], lambda i, p: q_join.best_rows(i, p), results).collect()}
    assert got == {k: min(v) for k, v in best.items()}


@pytest.mark.parametrize("name", ["best_reference_patch", "same_vs_cross_count", "cross_patch_radius_join"])
def test_pairs_of_patches_are_no_rows(spark, name):
    """Before, both images' patches were exploded and elements joined once per neighbour."""
    text = plan(entry.queries()[name](spark, SF))
    assert "posexplode" not in text and "Join" not in text and text.count("Exchange") == 1


def scattered(seed: int):
    """Sparse, dense and repeated positions on several images, one of them wider than a tile, and one point without a place."""
    rng = random.Random(seed)
    rows = [(i, rng.randrange(s), rng.randrange(s), float(rng.randrange(9))) for i, (n, s) in enumerate([(1, 5), (300, 400), (400, 40), (200, 60), (900, 30)]) for _ in range(n)]
    return rows + [(7, rng.randrange(3) * 900 + rng.randrange(30), rng.randrange(30) - 5, float(rng.randrange(9))) for _ in range(150)] + [(8, None, 3, 1.0), (8, 4, 3, None), (8, 6, 3, 1.0)]


def one_by_one(spots, order, d):
    label = {}
    for p in order:
        if p not in label:
            label.update({o: p for o in spots if o[0] == p[0] and None not in (*o, *p) and (o[1] - p[1]) ** 2 + (o[2] - p[2]) ** 2 <= d * d} or {p: p})
    return label


def middles(label, count):
    groups = {}
    for p, to in label.items():
        groups.setdefault(to, []).append(p)
    out = []
    for to, held in groups.items():
        n = sum(count[p] for p in held)
        out.append((to[0], *[None if to[i] is None else round(sum(p[i] * count[p] for p in held) / n) for i in (1, 2)], n))
    return sorted(out, key=str)


@pytest.mark.parametrize("dense", [0, 24, 10**9])
def test_close_points_equal_one_by_one(spark, monkeypatch, dense):
    monkeypatch.setattr(closeness, "DENSE", dense)
    monkeypatch.setattr(closeness, "STEP", 100)
    rows = [r for r in scattered(5) if dense == 24 or r[0] < 7]  # the wide image once, its rounds are slow
    df = spark.createDataFrame(rows, "image_id int, x int, y int, quality double").repartition(5)
    count = Counter(r[:3] for r in rows)
    order = sorted(count, key=lambda p: (p[0], p[1] is None, p[1] or 0, p[2]))
    assert sorted(map(tuple, P.merge_greedy(df, ["image_id"], 12).collect()), key=str) == middles(one_by_one(count, order, 12), count)
    best = {}
    for *p, q in rows:
        best[tuple(p)] = max(best.get(tuple(p), -1.0), -1.0 if q is None else q)
    label = one_by_one(best, sorted(order, key=lambda p: -best[p]), 9)
    got = sorted(((r["image_id"], r["x"], r["y"]) for r in P.suppress_close(df, ["image_id"], 9, "quality").collect()), key=str)
    assert got == sorted((p for p, to in label.items() if p == to), key=str)
    root = {p: p for p in count}
    for _ in count:
        new = {p: min([root[o] for o in count if o[0] == p[0] and None not in (*o, *p) and (o[1] - p[1]) ** 2 + (o[2] - p[2]) ** 2 <= 81] or [p]) for p in count}
        if new == root:
            break
        root = new
    assert sorted(map(tuple, P.merge_close(df, ["image_id"], 9).collect()), key=str) == middles(root, count)


@pytest.mark.parametrize("name", ["merge_close_points_dbscan", "merge_close_points_greedy", "suppress_close_low_quality"])
def test_images_of_one_tile_need_no_rounds(spark, name, monkeypatch):
    """Before, pairs and the labels of every round were written to the checkpoint folder."""
    def none(df):
        raise AssertionError("checkpoint")

    for m in (P, graph, joins):
        monkeypatch.setattr(m, "cut", none)
    text = plan(entry.queries()[name](spark, SF))
    assert "Join" not in text and text.count("Exchange") <= 2


def test_vectors_as_arrays_equal_rows(spark):
    rng = random.Random(2)
    rows = [(i, rng.randint(1, 14), [None if rng.random() < 0.4 else float(rng.randint(-2, 2)) for _ in range(rng.randint(1, 25))]) for i in range(150)]
    df = spark.createDataFrame(rows, "k int, goal int, v array<double>").repartition(3)
    long = df.select("k", "goal", F.posexplode("v").alias("pos", "v"))
    for by_rows, by_array in ((grid.resample, grid.resample_array), (grid.trim_null_edges, grid.trim_array)):
        want = by_rows(long, ["k"], "pos", "v", "goal")
        got = df.select("k", F.posexplode(by_array(F.col("v"), F.col("goal"))).alias("pos", "v"))
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str) and want.count()


def test_a_studys_documents_meet_once(spark, tmp_path):
    """Before, the documents of thicknesses were parsed five times and joined by their samples."""
    doc = '{"study": {"s": {"3": {"vector": [1.0, 2.0]}}}}'
    thick = '{"study": {"s": {"3": {"PR_RPE": {"vector": [1.0, 0.0, 3.0]}}, "4": {"PR_RPE": {"vector": [5.0]}}}}, "spacing": {"x": 1.0, "y": 2.0, "z": 3.0}}'
    for name, text in (("t", thick), ("c", doc), ("o", doc)):
        spark.createDataFrame([(1, 2, text), (None, 2, text)], "Subject int, Session int, value string").write.parquet(f"{tmp_path}/{name}")
    df = R.layer_collection(spark, *[f"{tmp_path}/{n}" for n in "tco"], packed=True)
    text = plan(df)
    assert text.count("from_json") == 3 and "Join" not in text and text.count("Exchange") == 1
    got = sorted(((r["subject_id"], r["slice"], r["layer"], r["pos"], r["thickness"]) for r in df.collect()), key=str)
    own = [(3, 0, 1.0), (3, 1, None), (3, 2, 3.0), (4, 0, 5.0)]
    want = [(k, s, "PhotoR+RPE", p, v) for k in (1, None) for s, p, v in own]
    want += [(1, 3, "OS", 0, 1.0), (1, 3, "OS", 1, 1.5), (1, 3, "OS", 2, 2.0), (1, 4, "OS", 0, None), (1, 3, "CVI", 0, 1.0), (1, 3, "CVI", 1, 2.0)]
    assert got == sorted(want, key=str)


def test_both_passes_of_a_fit_see_a_subject_in_one_task(spark):
    """As two fits with the peaks joined between them; before, profiles were made, shuffled and sorted twice."""
    rng = random.Random(4)
    rows = []
    for s in range(7):
        for axis in ("X", "Y", "Z")[: 1 + s % 3]:
            for e10 in sorted(rng.sample(range(-100, 101), 4 if (s, axis) == (4, "Y") else 90)):
                rows.append((s, axis, e10 / 10, rng.randint(100, 8000) + 1.5e6 * (1 + s % 4) / (10 + abs(e10)), rng.randint(1, 3)))
    rows += [(8, "Y", 0.1 * k, 10.0, 1) for k in range(12)] + [(None, "X", 0.1 * k, 1e5, 1) for k in range(12)]
    df = spark.createDataFrame(rows, "s int, axis string, x double, d double, n int").repartition(5)
    got = fits.bilateral_both_axes(df, ["s"], "x", "d", "n")
    text = plan(got)
    assert "Join" not in text and text.count("MapInArrow") == 1
    first = fits.bilateral(df, ["s", "axis"], "x", "d", "n")
    x, y = (F.max(F.when(F.col("axis") == a, F.struct("loss", F.exp("log_peak").alias("peak")))).alias(a) for a in "XY")
    common = (F.col("Y.loss") * F.col("X.peak") + F.col("X.loss") * F.col("Y.peak")) / (F.col("X.loss") + F.col("Y.loss"))
    target = first.groupBy("s").agg(x, y).select("s", F.coalesce(common, "X.peak", "Y.peak").alias("target"))
    want = fits.bilateral(df.join(target, ["s"]), ["s", "axis"], "x", "d", "n", target="target")
    got, want = ({(r["s"], r["axis"]): r for r in t.collect()} for t in (got, want))
    assert set(got) == set(want) and len(got) == 14 and sum(r["loss"] is not None for r in got.values()) >= 8
    for k, r in want.items():
        assert got[k]["reason"] == r["reason"] and [got[k][f] for f in fits.BILATERAL_FIELDS] == pytest.approx([r[f] for f in fits.BILATERAL_FIELDS], abs=1e-8), k
