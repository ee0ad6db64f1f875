import io
from contextlib import redirect_stdout

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "stratum" and df.count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["neighbor_equijoin", "manhattan_candidate_join", "region_range_join", "cross_patch_radius_join"])
def test_distance_joins_are_not_cartesian(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_scan_reads_only_needed_columns(spark):
    text = plan(entry.queries()["mean_thickness_by_ecc"](spark, SF))
    assert "l_extendedprice" not in text and "PushedFilters" in text


def test_readers_prune_visits(spark, tmp_path):
    from eccentra.sources import readers as R

    rows = spark.createDataFrame([(s, v, 0.1, 5.0) for s in (1, 2, 3) for v in (1, 2)], "Subject int, Session int, ecc double, density double")
    for axis in "XY":
        rows.write.partitionBy("Subject", "Session").option("header", "true").option("sep", ";").csv(f"{tmp_path}/{axis}")
    df = R.raw_densities(spark, f"{tmp_path}/X", f"{tmp_path}/Y").filter("subject_id = 2 AND session_id = 1")
    assert sorted((r["subject_id"], r["session_id"], r["axis"]) for r in df.collect()) == [(2, 1, "X"), (2, 1, "Y")]
    text = plan(df)
    assert text.count("PartitionFilters: [isnotnull(Subject") == 2 and "isnotnull(Session" in text
    old = R.raw_densities(spark, f"{tmp_path}/X", f"{tmp_path}/Y", named=False).filter("subject_id = 2 AND session_id = 1")
    assert sorted(map(tuple, old.collect())) == sorted(map(tuple, df.collect()))
