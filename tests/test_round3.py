"""Waiting for complete files, folded averages, smoothing of raw readings, bands with nulls, ranges, peak parts."""

import math
import os
import random
import time
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from eccentra.operators import cohort, joins, ordered, peaks, smoothing, stats
from eccentra.streaming import acquisition as A, folder


# ---- files of a folder

def test_a_growing_file_is_held_back():
    """Listings as offsets: released at the second agreeing listing, oldest first, and anew when rewritten."""
    off = {"files": {}}
    steps = [({"a": (5, 100), "b": (9, 50)}, []), ({"a": (7, 120), "b": (9, 50)}, ["b"]), ({"a": (7, 120), "b": (9, 50), "c": (1, 60)}, ["a"]),
             ({"a": (7, 120), "c": (1, 60)}, ["c"]), ({"a": (8, 300), "c": (1, 60)}, []), ({"a": (8, 300), "c": (1, 60)}, ["a"])]
    for turn, (now, want) in enumerate(steps):
        new = folder.advanced(off, now, clock=turn * 10, settle=5)
        assert [n for n, _, _ in folder.released(off, new)] == want
        off = new
    late = folder.advanced({"files": {}}, {"a": (1, 1), "b": (1, 0)}, 0, 50)
    assert folder.released(late, folder.advanced(late, {"a": (1, 1), "b": (1, 0)}, 49, 50)) == []
    assert [n for n, _, _ in folder.released(late, folder.advanced(late, {"a": (1, 1), "b": (1, 0)}, 50, 50))] == ["b", "a"]


def test_folder_stream_waits_and_archives(spark, tmp_path):
    room, old = tmp_path / "room", tmp_path / "old"
    room.mkdir()
    (room / "one.txt").write_text("a\nb")
    (room / "two.txt").write_text("c\n")
    (room / ".hidden").write_text("x")
    lines = folder.lines_of(folder.complete_files(spark, str(room), settle=0, archive=str(old)), 2)

    def run():
        got = A.drain(lines, "lines", str(tmp_path / "state"))
        return sorted((os.path.basename(r["path"]), r["line"]) for r in got.collect())

    assert run() == []
    with open(room / "two.txt", "a") as f:  # still growing
        f.write("d\n")
    assert run() == [("one.txt", "a"), ("one.txt", "b")]
    assert run() == [("one.txt", "a"), ("one.txt", "b"), ("two.txt", "c"), ("two.txt", "d")]
    run()
    assert sorted(os.listdir(old)) == ["one.txt", "two.txt"]


# ---- averages

def plain_average(values, alpha, v=None):
    for x in values:
        v = None if x is None else x if v is None else alpha * x + (1 - alpha) * v
    return v


def test_folds_of_stretches_compose(spark):
    r = random.Random(1)
    for _ in range(20):
        values = [None if r.random() < 0.15 else r.random() for _ in range(30)]
        cuts = sorted(r.sample(range(1, 30), 3))
        parts = [values[a:b] for a, b in zip([0, *cuts], [*cuts, 30])]
        rows = spark.createDataFrame([(i, [{"v": x} for x in p]) for i, p in enumerate(parts)], "i int, r array<struct<v double>>")
        v = None
        for row in rows.select("i", A.fold_of(F.col("r"), 0.3).alias("f")).orderBy("i").collect():
            v = A.applied(row["f"], v)
        want = plain_average(values, 0.3)
        assert (v is None) == (want is None) and (v is None or math.isclose(v, want))


def test_average_state_expires_and_order_does_not_matter(spark, tmp_path):
    """Two deliveries: a key that falls silent starts anew, one that goes on keeps its average."""
    A.stateful(spark)
    t0, schema = datetime(2024, 1, 1), "k string, ts timestamp, id long, v double"
    first = [("a", t0 + timedelta(minutes=i), i, float(i)) for i in range(90)] + [("b", t0 + timedelta(minutes=i), i, 1.0) for i in range(5)]
    middle = [("a", t0 + timedelta(hours=20, minutes=i), 100 + i, 5.0) for i in range(70)]
    last = [("a", t0 + timedelta(hours=40), 300, 7.0), ("b", t0 + timedelta(hours=40), 300, 9.0), ("c", t0 + timedelta(hours=60), 1, 0.0)]
    path = str(tmp_path / "in")
    stream = A.exponential_average(spark.readStream.schema(schema).parquet(path) if os.path.isdir(path) else _stream(spark, path, schema), "k", ["ts", "id"], "v", 0.5,
                                   slot="1 hour", delay="10 minutes", live=timedelta(hours=24))
    out = None
    for rows in (first, middle, last):
        random.Random(3).shuffle(rows)
        spark.createDataFrame(rows, schema).repartition(3).write.mode("append").parquet(path)
        out = A.drain(stream, "avg", str(tmp_path / "state"))
    got = {r["k"]: r["average"] for r in out.groupBy("k").agg(F.max_by("average", "last_ts").alias("average")).collect()}
    own = [v for k, _, _, v in sorted(first + middle + last, key=lambda r: (r[1], r[2])) if k == "a"]
    assert math.isclose(got["a"], plain_average(own, 0.5))
    assert got["b"] == 9.0  # the state of b had ended


def _stream(spark, path, schema):
    os.makedirs(path)
    return spark.readStream.schema(schema).parquet(path)


# ---- smoothing

def plain_lowess(x, y, share, rounds, at):
    """Point by point, as the textbook has it; x sorted."""
    n = len(x)
    k = int(share * n + 1e-10)

    def line(x0, robust):
        d = np.abs(x - x0)
        reach = max(np.partition(d, k - 1)[k - 1], 1e-12)
        w = (1 - np.minimum(d / reach, 1) ** 3) ** 3 * robust
        w = w / w.sum()
        mx, my = (w * x).sum(), (w * y).sum()
        sx = (w * (x - mx) ** 2).sum()
        return my + (((w * (x - mx) * y).sum() / sx) * (x0 - mx) if math.sqrt(sx) > 0.001 * (x.max() - x.min()) else 0)

    robust = np.ones(n)
    for _ in range(rounds):
        r = np.abs(y - np.array([line(a, robust) for a in x]))
        robust = (1 - np.minimum(r / (6 * np.median(r)), 1) ** 2) ** 2
    return np.array([line(a, robust) for a in at])


def test_raw_readings_over_blocks_equal_plain_python(spark):
    """Small blocks, repeated readings and a second group; the fit is that of the whole group."""
    rng = np.random.default_rng(4)
    x = np.round(np.sort(rng.uniform(-10, 10, 900)), 2)
    y = np.round(np.sin(x) * 50 + rng.normal(0, 5, 900) + (rng.random(900) < 0.03) * 300, 1)
    rows = [(1, float(a), float(c)) for a, c in zip(x, y)] + [(1, float(x[5]), float(y[5]))] * 3 + [(2, 1.0, 2.0), (2, 2.0, 5.0)]
    df = spark.createDataFrame(rows, "k int, x double, y double").repartition(5)
    got = {(r["k"], r["x"], r["y0"]): r["y"] for r in smoothing.lowess_blocks(df, ["k"], "x", "y", least=64).join(
        df.select("k", "x", F.col("y").alias("y0")).distinct(), ["k", "x"]).collect()}
    mine = sorted((a, c) for k, a, c in rows if k == 1)
    xs, ys = np.array([a for a, _ in mine]), np.array([c for _, c in mine])
    want = plain_lowess(xs, ys, 0.1, 3, xs)
    for a, c, f in zip(xs, ys, want):
        assert math.isclose(got[1, a, c], f, rel_tol=1e-6, abs_tol=1e-6)
    assert got[2, 1.0, 2.0] == 2.0


def test_many_raw_readings_in_one_group(spark):
    """200,000 readings of one group; a sample of the first pass against plain Python."""
    n = 200_000
    df = spark.range(n).select(F.lit(1).alias("k"), (F.pmod(F.col("id") * 7919, n) / n * 20 - 10 + F.col("id") * 1e-9).alias("x"))
    df = df.withColumn("y", F.sin("x") * 10 + F.pmod(F.xxhash64("x"), F.lit(1000)) / 500.0)
    pdf = df.toPandas().sort_values("x")
    x, y = pdf["x"].to_numpy(), pdf["y"].to_numpy()
    sample = x[:: n // 7]
    got = {r["x"]: r["y"] for r in smoothing.lowess_blocks(df, ["k"], "x", "y", share=0.01, rounds=0).filter(F.col("x").isin([float(a) for a in sample])).collect()}
    for a, f in zip(sample, plain_lowess(x, y, 0.01, 0, sample)):
        assert math.isclose(got[a], f, rel_tol=1e-6)


def test_lowess_is_read_off_at_null_places(spark):
    rows = [(1, float(i), None if i % 5 == 2 else float(i % 7)) for i in range(60)]
    out = {r["x"]: r["y"] for r in smoothing.lowess(spark.createDataFrame(rows, "k int, x double, y double"), ["k"], "x", "y", share=0.2, everywhere=True).collect()}
    known = [(a, c) for _, a, c in rows if c is not None]
    xs, ys = np.array([a for a, _ in known]), np.array([c for _, c in known])
    want = plain_lowess(xs, ys, 0.2, 3, np.arange(60.0))
    assert all(math.isclose(out[float(i)], want[i], rel_tol=1e-6, abs_tol=1e-9) for i in range(60))


def test_profiles_shorter_than_the_window_are_flagged(spark):
    rows = [(1, i, float(i * i)) for i in range(15)] + [(2, i, float(i % 3)) for i in range(7)]
    out = smoothing.savgol(spark.createDataFrame(rows, "k int, i int, v double"), ["k"], "i", "v", 11).collect()
    assert {(r["k"], r["smoothed"]) for r in out} == {(1, True), (2, False)}
    assert all(r["v"] == r["i"] % 3 for r in out if r["k"] == 2)


# ---- bands, ranges, parts

def test_bands_of_all_others_with_nulls(spark):
    r = random.Random(6)
    rows = [(g, s, None if r.random() < (0.1, 0.45, 0.6, 1.0)[g] else float(r.randrange(9))) for g in range(4) for s in range(21)] + [(9, 0, 1.0)]
    out = cohort.leave_one_out_bands(spark.createDataFrame(rows, "g int, s int, v double"), ["g"], "v").collect()
    assert len(out) == len(rows)
    for x in out:
        others = [v for g, s, v in rows if g == x["g"] and s != x["s"]]
        some = [v for v in others if v is not None]
        most = sum(v is None for v in others) < 0.5 * len(others)
        for name, q in (("median", 50), ("lower", 15), ("upper", 85)):
            want = float(np.percentile(some, q)) if most and some else None
            assert (x[name] is None) == (want is None) and (want is None or math.isclose(x[name], want)), x


def test_range_moments_are_sums_over_the_range(spark):
    r = random.Random(7)
    rows = [(k, s, e, r.random(), r.random() if r.random() < 0.9 else None) for k in range(2) for s in range(5) for e in range(-100, 101, 3 + s)]
    df = spark.createDataFrame(rows, "k int, s int, e int, x double, y double")
    ranges = [("all", -100, 100), ("mid", -7, 12), ("edge", 90, 100), ("empty", -99, -99)]
    out = stats.range_moments(df, ["k"], "s", "e", "x", "y", ranges, -100, 100).collect()
    want = {}
    for name, a, z in ranges:
        for k, s, e, x, y in rows:
            if y is not None and a <= e <= z:
                m = want.setdefault((k, name, s), np.zeros(6))
                m += (1, x, y, x * x, x * y, y * y)
    assert {(x["k"], x["range"], x["s"]) for x in out} == set(want)
    for x in out:
        assert np.allclose([x[m] for m in stats.MOMENTS], want[x["k"], x["range"], x["s"]])


def test_singular_mixed_model_has_null_rows(spark):
    rows = [(1, s, 1.0, float(s)) for s in range(6)] + [(2, 1, 1.0, 2.0), (2, 2, 2.0, 1.0)] + [(3, s, float(i), 2.0 * i + s) for s in range(3) for i in range(4)]
    out = {r["k"]: r for r in stats.random_intercept(spark.createDataFrame(rows, "k int, s int, x double, y double"), ["k"], "s", "x", "y").collect()}
    assert set(out) == {1, 2, 3} and out[1]["slope"] is None and out[2]["p"] is None and math.isclose(out[3]["slope"], 2.0, rel_tol=1e-6)


def test_parts_follow_the_peaks_of_a_profile(spark):
    """Two hills and a dip: their own places are the limits; a straight line has left and right only."""
    hills = [(1, e, math.exp(-((e - 40) / 15) ** 2) + math.exp(-((e + 30) / 15) ** 2)) for e in range(-100, 101, 5)]
    line = [(2, e, float(e)) for e in range(-100, 101, 5)]
    df = spark.createDataFrame(hills + line, "k int, e10 int, v double")
    limits = peaks.two_peaks_one_valley(df, ["k"], "e10", "v")
    found = {r["k"]: (r["lower"], r["upper"]) for r in limits.collect()}
    assert found == {1: (-30, 40), 2: (None, None)}
    parts = peaks.split_parts(df, limits, ["k"]).groupBy("k", "part").agg(F.count("*").alias("n")).collect()
    assert {(r["k"], r["part"]): r["n"] for r in parts} == {(1, "first"): 15, (1, "second"): 6, (1, "third"): 8, (1, "fourth"): 13, (2, "left"): 20, (2, "right"): 20}


def test_nearest_point_of_lone_points_beside_a_dense_patch(spark, monkeypatch):
    """Equal to brute force, and a lone point meets few cells of a patch of 40,000 positions."""
    patch = [(1, a, c) for a in range(1000, 1200) for c in range(300, 500)]
    lone = [(1, 0, 0), (1, -700, 900), (1, 3000, 420), (2, -5, -5), (2, 900, 4), (3, 1, 1), (4, 7, 7), (4, 7, 7), (1, 5000, 5000)]
    most = []
    plain = joins.cut

    def counted(df):
        out = plain(df)
        if "_near" in out.columns:
            most.append(out.groupBy("image", "x", "y").count().agg(F.max("count")).first()[0])
        return out

    monkeypatch.setattr(joins, "cut", counted)
    out = joins.nearest_distance(spark.createDataFrame(patch + lone, "image int, x int, y int"), ["image"])
    got = {(r["image"], r["x"], r["y"]): r["distance"] for r in out.filter("image > 1 OR x < 1000 OR x >= 1200 OR (x + y) % 97 = 0").collect()}
    assert out.count() == len(patch) + len(lone) - 1
    for k in lone:
        rest = [(b, c) for a, b, c in patch + lone if a == k[0] and (b, c) != k[1:]]
        want = 0.0 if k[0] == 4 else min((math.dist(k[1:], q) for q in rest), default=None)
        assert got[k] == want if want is None else math.isclose(got[k], want)
    assert all(d == 1.0 for (i, a, _), d in got.items() if i == 1 and 1000 <= a < 1200)
    assert most and max(most) < 200


def test_weighted_quantiles(spark):
    rows = [(1, 1.0, 3), (1, 5.0, 1), (1, 7.0, 4)]
    out = ordered.quantiles_weighted(spark.createDataFrame(rows, "k int, v double, m long"), ["k"], "v", F.col("m"), {"q": 0.4, "m": 0.5}).first()
    full = [1.0] * 3 + [5.0] + [7.0] * 4
    assert math.isclose(out["q"], np.percentile(full, 40)) and out["m"] == np.median(full)
