"""Tests of the fourth round's findings."""

import io
import os
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["cross_image_distance", "cross_patch_radius_join", "best_reference_patch", "manhattan_candidate_join", "same_vs_cross_count"])
def test_patch_pairs_are_not_broadcast(spark, name):
    out = io.StringIO()
    with redirect_stdout(out):
        entry.queries()[name](spark, SF).explain("formatted")
    assert "Broadcast" not in out.getvalue()


PACKED = ["scan_fovea_params", "scan_layer_json", "write_tile_counts", "scan_density_raw", "scan_layer_thickness", "scan_density_csv",
          "scan_subject_results", "scan_component_locations", "scan_cohort_results", "write_density_profile"]


@pytest.mark.parametrize("name", PACKED)
def test_number_of_files_does_not_follow_the_cohort(spark, name, tmp_path, monkeypatch):
    """Folders written by a query: none per subject, image or montage."""
    from eccentra.plans import q_source

    monkeypatch.setattr(q_source, "scratch_path", lambda spark, label: f"{tmp_path}/{label}")
    assert entry.queries()[name](spark, SF).count() > 0
    folders = [d for d, _, _ in os.walk(tmp_path)]
    assert len(folders) <= 5 and not any("=" in os.path.basename(d) for d in folders)


def test_packed_results_hold_the_lines_of_the_files(spark, tmp_path):
    from eccentra.sources import readers as R, writers as Wr

    wide = spark.createDataFrame([(s, v, e / 10, float(e) if e % 2 else None, None) for s in (1, 2) for v in (1, 2) for e in (-1, 0, 1)],
                                 "subject_id int, session_id int, location double, densities_X double, densities_Y double")
    Wr.write_results(wide, f"{tmp_path}/tree")
    Wr.write_results(wide, f"{tmp_path}/packed", packed=True)
    lines = [r["value"] for r in spark.read.parquet(f"{tmp_path}/packed").filter("Subject = 2 AND Session = 1").collect()]
    assert lines == ["sep=,", "location,densities_X,densities_Y", "-0.1,-1.0,", "0.0,,", "0.1,1.0,"]
    one, two = R.cohort_results(spark, f"{tmp_path}/tree", []), R.cohort_results(spark, f"{tmp_path}/packed", [], packed=True)
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect())) and one.schema == two.schema


def test_threshold_is_the_least_of_equal_ones(spark):
    """Three bins of one tile each: both cuts part the tiles equally well, in exact numbers."""
    from eccentra.operators import peaks

    rows = [(g, b * step, n) for g, (step, n) in enumerate([(1, 1), (3, 1), (7, 3), (5, 7), (11, 9)]) for b in range(3)]
    rows += [(9, 0, 9), (9, 25, 1), (9, 50, 9)]
    h = spark.createDataFrame(rows, "image_id int, bin long, n long")
    got = {r["image_id"]: r["threshold"] for r in peaks.otsu(h, ["image_id"]).collect()}
    assert got == {0: 0.5, 1: 0.5, 2: 0.5, 3: 0.5, 4: 0.5, 9: 0.5}


def test_tail_in_sql_of_millions_of_pairs():
    import math

    import duckdb

    from eccentra.plans import q_stats

    for n in (5, 40, 4000, 8_000_000):
        for z in (0.1, 1.3, 3.0):
            r = z / math.sqrt(n - 2 + z * z)
            (new,), = duckdb.sql("SELECT " + q_stats.r_tail(f"CAST({r!r} AS DOUBLE)", f"CAST({n} AS BIGINT)", narrow=True)).fetchall()
            if n > 4000:
                assert abs(new - math.erfc(z / math.sqrt(2))) < 1e-6
            else:
                (old,), = duckdb.sql("SELECT " + q_stats.r_tail(f"CAST({r!r} AS DOUBLE)", f"CAST({n} AS BIGINT)")).fetchall()
                assert abs(new - old) < 1e-7


def test_significant_correlations_are_listed_in_the_ratio(spark):
    rows = entry.queries()["significant_ratio"](spark, "/root/testdata/sf0.01").collect()
    assert sum(r["n_significant"] for r in rows) > 0
    assert all(len(r["rhos"] or []) == r["n_significant"] and (r["rhos"] is None or list(r["rhos"]) == sorted(r["rhos"])) for r in rows)


def test_streamed_average_takes_the_last_slot(spark):
    """The stream ends with the same averages as the batch."""
    stream, batch = ({r["user_id"]: r["average"] for r in entry.queries()[n](spark, SF).collect()} for n in ("exponential_average_stream", "exponential_average_state"))
    assert stream == batch and None not in stream


@pytest.mark.parametrize("n, width", [(1, 50), (40, 2000), (700, 60), (3000, 900), (3000, 5000)])
def test_nearest_in_tiles_is_brute_force(n, width):
    import numpy as np

    from eccentra.operators import joins

    rng = np.random.default_rng(n + width)
    at = np.unique(rng.integers(-width, width, (n, 2)), axis=0)
    x, y = at[:, 0], at[:, 1]
    mine = rng.random(len(x)) < 0.7
    d = (x[:, None] - x) ** 2 + (y[:, None] - y) ** 2
    np.fill_diagonal(d, 1 << 40)
    want = d.min(axis=1)[mine]
    assert joins._nearest_squared(x, y, mine, 64).tolist() == np.where(want <= 64 * 64, want, -1).tolist()


def test_nearest_distance_writes_little(spark, monkeypatch):
    """A sparse image is answered by the tiles: no pyramid, and no position meets nine cells."""
    from eccentra.operators import joins

    monkeypatch.setattr(joins, "_descended", lambda *a: pytest.fail("descended"))
    rows = [(1, 40 * i + j % 7, 40 * j + i % 5) for i in range(30) for j in range(30)] + [(2, 3, 4), (3, 500, 9), (3, 530, 9), (3, 530, 9)]
    df = spark.createDataFrame(rows, "image_id int, x int, y int")
    out = {(r["image_id"], r["x"], r["y"]): r["distance"] for r in joins.nearest_distance(df, ["image_id"]).collect()}
    for (i, x, y), got in out.items():
        others = [(x - b) ** 2 + (y - c) ** 2 for a, b, c in rows if a == i and (b, c) != (x, y)]
        want = 0.0 if rows.count((i, x, y)) > 1 else min(others) ** 0.5 if others else None
        assert got == want
    assert len(out) == 903


def test_greedy_groups_hold_many_components(spark, monkeypatch):
    """Components of an image share groups, whatever these are; results do not depend on it."""
    from eccentra.operators import points as P

    rows = [(1, 37 * i % 400 + k * 5, 53 * i % 380) for i in range(120) for k in range(i % 4 + 1)]
    df = spark.createDataFrame(rows, "image_id int, x int, y int")
    one = sorted(map(tuple, P.merge_greedy(df, ["image_id"], 12).collect()))
    monkeypatch.setattr(P, "HELD", 10)
    assert sorted(map(tuple, P.merge_greedy(df, ["image_id"], 12).collect())) == one and sum(r[-1] for r in one) == len(rows)
