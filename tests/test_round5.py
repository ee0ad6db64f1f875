"""Tests of the fifth round's findings: whole profiles are worked on many at a time."""

import io
import math
import random
from contextlib import redirect_stdout

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from eccentra.operators import batches, fits, peaks, smoothing, stats

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


@pytest.mark.parametrize("name", ["compare_to_band", "profile_fit_bilateral", "spearman_parts", "layer_analysis", "smooth_raw_readings",
                                  "two_peaks_one_valley", "pit_width", "peak_limits"])
def test_no_python_call_per_profile(spark, name):
    assert "FlatMapGroupsIn" not in plan(entry.queries()[name](spark, SF))


@pytest.mark.parametrize("name", ["find_peaks", "spearman_simple", "significant_correlations", "significant_ratio"])
def test_profiles_are_sorted_once(spark, name):
    """Beside the merge join's two sorts, one for all that is done to a profile."""
    text = plan(entry.queries()[name](spark, SF))
    assert sum("- Sort [" in line for line in text.splitlines()) <= 3
    assert sum("- Window [" in line for line in text.splitlines()) == 1


def profiles(seed: int, count: int, most: int = 40) -> list[tuple[int, int, float | None]]:
    rng = random.Random(seed)
    out = []
    for k in range(count):
        kind, n = k % 4, rng.randint(1, most)
        for i in range(n):
            v = {0: float(rng.randint(0, 5)), 1: rng.random(), 2: 3.0, 3: math.cos(i / 3) + rng.randint(0, 2)}[kind]
            out.append((k, 2 * i - n, None if rng.random() < 0.1 else v))
    return out


def by_key(rows) -> dict:
    out = {}
    for k, x, v in sorted(rows, key=lambda r: r[:2]):
        out.setdefault(k, []).append((x, v))
    return out


def test_least_sigma_equals_trying_one_after_another(spark):
    """Flat, short, tied and smooth profiles."""
    rows = profiles(1, 60)
    want = {}
    for k, p in by_key(rows).items():
        known = [(x, v) for x, v in p if v is not None]
        if not known:
            continue
        v = np.array([v for _, v in known])
        want[k] = (None, None, None)
        for sigma in range(101):
            s = peaks._mirror_smooth(v, sigma)
            up = peaks._maxima(s)
            if len(up) == 2 and len(peaks._maxima(-s)) == 1:
                want[k] = (sigma, known[up[0]][0], known[up[1]][0])
                break
    df = spark.createDataFrame(rows, "k int, x int, v double")
    got = {r["k"]: (r["sigma"], r["lower"], r["upper"]) for r in peaks.two_peaks_one_valley(df, ["k"], "x", "v").collect()}
    assert got == want and sum(w[0] is not None for w in want.values()) > 5


def test_peaks_with_missing_and_infinite_values(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, i, v) for i, v in enumerate([1.0, 2.0, 2.0, 1.0, None, 3.0, 1.0, 4.0, 0.0])]
    rows += [(2, i, v) for i, v in enumerate([1.0, nan, inf, nan, nan, 0.0, 5.0])] + [(3, 0, 1.0)]
    got = sorted(tuple(r) for r in peaks.find_peaks(spark.createDataFrame(rows, "k int, x int, v double"), ["k"], "x", "v").select("k", "place", "kind", "x").collect())
    assert got == [(1, 1, 1, 1), (1, 6, -1, 6), (1, 7, 1, 7), (2, 1, 1, 1), (2, 2, -1, 2), (2, 3, 1, 3), (2, 5, -1, 5)]


def test_bounded_ranks_equal_distributed_ones(spark):
    rng = random.Random(3)
    rows = [(k % 7, float(rng.randint(0, 6)), None if rng.random() < 0.1 else float(rng.randint(0, 4))) for k in range(400)] + [(9, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "k int, x double, y double")
    one = {r["k"]: r for r in stats.spearman(df, ["k"], "x", "y", bounded=True).collect()}
    two = {r["k"]: r for r in stats.spearman(df, ["k"], "x", "y").collect()}
    assert one.keys() == two.keys() and one[9]["rho"] is None
    for k, r in two.items():
        assert r["n"] == one[k]["n"] and one[k]["rho"] == (r["rho"] if r["rho"] is None else pytest.approx(r["rho"], abs=1e-12))


def test_columns_smoothed_together_as_alone(spark):
    """Two curves over the same steps, each with gaps of its own; a single profile is smoothed as it is among others."""
    rng = random.Random(4)
    rows = [(k, float(i), None if rng.random() < 0.2 else rng.random(), None if k == 2 else rng.random()) for k in range(5) for i in range(rng.randint(1, 90))]
    df = spark.createDataFrame(rows, "k int, x double, u double, v double")
    both = {(r["k"], r["x"]): (r["u"], r["v"]) for r in smoothing.lowess(df, ["k"], "x", ["u", "v"], share=0.2, everywhere=True).collect()}
    assert len(both) == len(rows)
    for c, at in (("u", 0), ("v", 1)):
        for k in range(5):
            alone = smoothing.lowess(df.filter(F.col("k") == k), ["k"], "x", c, share=0.2, everywhere=True)
            for r in alone.collect():
                assert both[k, r["x"]][at] == (None if r[c] is None else pytest.approx(r[c], abs=1e-12))


def test_small_groups_of_readings_equal_blocks(spark):
    rng = random.Random(5)
    rows = [(k, rng.randint(0, 60) / 4, float(rng.randint(0, 9))) for k, n in ((1, 300), (2, 90), (3, 1)) for _ in range(n)]
    df = spark.createDataFrame(rows, "k int, x double, y double").repartition(3)
    whole = {(r["k"], r["x"]): r["y"] for r in smoothing.lowess_blocks(df, ["k"], "x", "y").groupBy("k", "x").agg(F.avg("y").alias("y")).collect()}
    for least in (16, 100):  # all in blocks; one in blocks and one whole
        parted = smoothing.lowess_blocks(df, ["k"], "x", "y", least=least)
        assert parted.count() == len(set(rows))
        assert {(r["k"], r["x"]): r["y"] for r in parted.groupBy("k", "x").agg(F.avg("y").alias("y")).collect()} == pytest.approx(whole, abs=1e-9)


def test_two_sided_fit_finds_known_parameters(spark):
    """Profiles of unlike length drawn from the model itself, and ones without a fit."""
    mm = fits.MM_PER_DEGREE
    known = {1: (0.05, 0.4, 0.25, 12.2, 0.2, 0.8, 0.1, 0.6, 100), 2: (0.0, 0.4, 0.4, 12.2, 0.1, 0.9, 0.2, 0.7, 80), 3: (-0.1, 0.6, 0.4, 12.5, 0.3, 0.55, 0.05, 0.95, 61)}
    rows = []
    for k, (c, el, er, top, bl, dl, br, dr, reach) in known.items():
        for e10 in range(-reach, reach + 1):
            x = e10 / 10 * mm
            far, e, b, d = abs(x - c), *((el, bl, dl) if x < c else (er, br, dr))
            rows.append((k, e10 / 10, math.exp(top - b * far + d * (1 / (far + e) - 1 / e)), None))
    rows += [(4, i / 10, 1000.0, None) for i in range(5)] + [(5, i / 10, 150_000.0, 10.0) for i in range(-9, 9)]
    got = {r["k"]: r for r in fits.bilateral(spark.createDataFrame(rows, "k int, x double, y double, t double"), ["k"], "x", "y", target="t").collect()}
    assert (got[4]["reason"], got[5]["reason"]) == ("too few points", "no room for the peak") and got[4]["loss"] is None
    for k, (c, el, er, top, bl, dl, br, dr, _) in known.items():
        r = got[k]
        assert [r[f] for f in fits.BILATERAL_FIELDS] == pytest.approx([0, c, el, er, top, bl, dl, br, dr], abs=1e-6), k


def test_nearly_singular_systems_have_the_shortest_solution():
    m, v, free = np.array([[[2.0, 2.0], [2.0, 2.0]], [[3.0, 1.0], [1.0, 2.0]]]), np.array([[4.0, 4.0], [5.0, 5.0]]), np.ones((2, 2), bool)
    assert fits._normal_solve(m, v, free) == pytest.approx(np.array([[1.0, 1.0], [1.0, 2.0]]))


def test_profiles_longer_than_a_lot(spark):
    """Lots end at a profile's end, whatever the lot's size."""
    df = spark.range(1000).selectExpr("cast(id % 3 as int) AS k", "cast(id as double) AS v")
    out = batches.map_profiles(df, ["k"], ["v"], ["v"], lambda values, starts: (starts, {"s": np.add.reduceat(values["v"], starts)}), [("s", "double")], rows=7)
    assert {r["k"]: r["s"] for r in out.collect()} == {k: float(sum(range(k, 1000, 3))) for k in range(3)}


def test_slopes_are_not_looked_up_one_by_one(spark, monkeypatch):
    """Every search is for the few edges, in sorted slopes; tied slopes and places, and slopes equal to an edge."""
    calls, plain = [], np.searchsorted

    def counted(a, v, **how):
        calls.append(np.size(v))
        return plain(a, v, **how)

    monkeypatch.setattr(fits.np, "searchsorted", counted)
    rng = random.Random(6)
    pts = [(float(rng.randint(0, 30)), float(rng.randint(0, 5))) for _ in range(300)]
    a = np.array(pts)
    s = np.sort(fits._slopes(a, a, np.triu(np.ones((300, 300), bool), 1)))
    edges = np.unique(np.quantile(s, np.linspace(0, 1, 40)[1:-1]))
    work = fits._block_work(["g"], ["g", "_bin", "_n"], False)
    pdf = pd.DataFrame({"_b": [0] * 300, "_x": a[:, 0], "_y": a[:, 1], "_e": None, "_bins": None})
    pdf.loc[300] = [None, None, None, edges, None]
    got = work((1, 0, 0), pdf)
    assert max(calls) <= len(edges)
    assert dict(zip(got["_bin"], got["_n"])) == {k: n for k, n in enumerate(np.bincount(plain(edges, s, side="right"))) if n}


def test_pairs_of_blocks_of_one_group_are_many_tasks(spark, monkeypatch):
    """One group: its block pairs are spread, and the answer is that of all pairs."""
    monkeypatch.setattr(fits, "PAIR_BLOCK", 50)
    rng = random.Random(7)
    pts = [(1, rng.random(), float(rng.randint(0, 9))) for _ in range(400)]
    seen, plain = [], fits._by_blocks

    def watched(*args):
        out = plain(*args)
        seen.append(len({r[0] for r in out.select(F.spark_partition_id()).collect()}))
        return out

    monkeypatch.setattr(fits, "_by_blocks", watched)
    got = fits.theil_sen(spark.createDataFrame(pts, "g int, x double, y double"), ["g"], "x", "y").first()
    a = np.array([p[1:] for p in pts])
    assert got["slope"] == pytest.approx(np.median(fits._slopes(a, a, np.triu(np.ones((400, 400), bool), 1))))
    assert min(seen) > 4
