"""Cases beyond former limits: far pairs, large ids, long chains, large groups."""


import numpy as np
import pytest
from pyspark.sql import functions as F

from eccentra import session
from eccentra.operators import fits, joins, points as P, stats


def test_nearest_distance_has_no_limit(spark):
    df = spark.createDataFrame([("i", 0, 0), ("i", 3_000_000, 0), ("j", 5, 5)], "image string, x int, y int")
    got = {(r["image"], r["x"]): r["distance"] for r in joins.nearest_distance(df, ["image"]).collect()}
    assert got == {("i", 0): 3e6, ("i", 3_000_000): 3e6, ("j", 5): None}


def test_large_coordinates_stay_apart(spark):
    df = spark.createDataFrame([("i", 0, 1048576), ("i", 1, 0), ("i", 2, 1)], "image string, x int, y int")
    got = sorted((r["x"], r["y"], r["n_points"]) for r in P.merge_close(df, ["image"], 3).collect())
    assert got == [(0, 1048576, 1), (2, 0, 2)]


def test_points_beyond_the_border_are_flagged(spark):
    df = spark.createDataFrame([(700, 0), (720, 0), (721, 5)], "x int, y int").withColumns({"ox": F.lit(0), "oy": F.lit(0)})
    got = sorted((r["image_x"], r["inside"]) for r in P.to_image(df, "x", "y", "ox", "oy", size=720).collect())
    assert got == [(700, True), (719, True), (721, False)]


def test_suppression_settles_on_a_long_chain(spark):
    n = 260
    df = spark.createDataFrame([("i", 5 * k, 0, float(n - k)) for k in range(n)], "image string, x int, y int, quality double")
    near = [(5 * k) for k in range(0, n, 2)]
    got = sorted(r["x"] for r in P.suppress_close(df.repartition(2), ["image"], 6, "quality").collect())
    assert got == near


@pytest.mark.parametrize("n", [3, 60, 2500])
def test_slope_median_is_exact_at_any_size(spark, n, monkeypatch):
    monkeypatch.setattr(fits, "PAIR_BLOCK", 600)
    r = np.random.default_rng(n)
    x, y = np.round(r.normal(0, 1, n), 2 if n > 100 else 6), r.normal(0, 1, n)
    df = spark.createDataFrame([("g", float(a), float(b)) for a, b in zip(x, y)], "g string, x double, y double")
    got = fits.theil_sen(df, ["g"], "x", "y").first()
    i, j = np.triu_indices(n, 1)
    keep = x[i] != x[j]
    slopes = np.sort((y[j] - y[i])[keep] / (x[j] - x[i])[keep])
    t = np.unique(x, return_counts=True)[1].astype(float)
    sigma = np.sqrt((n * (n - 1) * (2 * n + 5) - (t * (t - 1) * (2 * t + 5)).sum()) / 18)
    up, low = min(round((len(slopes) + 1.959963984540054 * sigma) / 2), len(slopes) - 1), max(round((len(slopes) - 1.959963984540054 * sigma) / 2) - 1, 0)
    assert np.allclose([got["slope"], got["lower"], got["upper"], got["n"]], [np.median(slopes), slopes[low], slopes[up], n], rtol=1e-9)


def test_profiles_without_a_fit_say_why(spark):
    df = spark.createDataFrame([("a", 0.1 * k, 1e5) for k in range(3)] + [("b", 0.1 * k, 10.0) for k in range(12)], "s string, x double, d double")
    got = {r["s"]: (r["loss"], r["reason"]) for r in fits.bilateral(df, ["s"], "x", "d").collect()}
    assert got["a"] == (None, "too few points") and set(got) == {"a", "b"}


def test_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="shared|share"):
        session.shared_dir(Session())


def test_correlation_by_argument(spark):
    r = np.random.default_rng(4)
    x = r.normal(0, 1, 50)
    y = x + r.normal(0, 1, 50)
    df = spark.createDataFrame([("g", float(a), float(b)) for a, b in zip(x, y)], "g string, x double, y double")
    rank = lambda v: np.argsort(np.argsort(v)).astype(float)
    i, j = np.triu_indices(50, 1)
    want = {"pearson": np.corrcoef(x, y)[0, 1], "spearman": np.corrcoef(rank(x), rank(y))[0, 1], "kendall": np.sign((x[i] - x[j]) * (y[i] - y[j])).mean()}
    for method, value in want.items():
        got = stats.correlation(df, ["g"], "x", "y", method).first()
        assert got["r"] == pytest.approx(value, abs=1e-9) and got["n"] == 50 and 0 <= got["p"] < 0.01
    with pytest.raises(ValueError):
        stats.correlation(df, ["g"], "x", "y", "other")


def test_open_regions_end_with_the_grid(spark):
    df = spark.createDataFrame([(-100,), (0,), (100,)], "e10 int")
    regions = spark.createDataFrame([("all", float("-inf"), float("inf")), ("outer", 5.0, float("inf"))], "region string, start double, stop double")
    got = sorted((r["region"], r["e10"]) for r in joins.join_regions(df, regions).collect())
    assert got == [("all", -100), ("all", 0), ("all", 100), ("outer", 100)]
