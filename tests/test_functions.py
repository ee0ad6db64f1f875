import math

import numpy as np
from pyspark.sql import functions as F

from eccentra.functions import geometry as G, naming as N
from eccentra.functions.pvalues import regularised_beta


def test_student_tail_table_values():
    # two-sided 5 % points of Student's t
    for df, t in ((1, 12.7062), (5, 2.5706), (30, 2.0423), (1000, 1.9623)):
        p = regularised_beta(df / 2, 0.5, df / (df + t * t))
        assert abs(float(p) - 0.05) < 2e-5


def test_fair_binomial_tail():
    n, k = 20, 14
    exact = sum(math.comb(n, i) for i in range(k, n + 1)) / 2 ** n
    assert abs(float(regularised_beta(k, n - k + 1, 0.5)) - exact) < 1e-12
    assert np.isnan(regularised_beta(np.nan, 1.0, 0.5))


def test_names_round_trip_and_rejects(spark):
    names = ["Subject34_Session274_OS_(-10,0)_1.5x1.5_4506_CalculatedSplit_extract_reg_avg.tif",
             "CROP_1_x430y210_Subject34_Session274_OS_(-1,-1)_1.5x1.5_4530_OA850nm_extract.tif",
             "Subject7_Session3_OD_(0.5,-2.5)_1.5x1.5_12_Confocal_a.tif", "notes.txt", "Subject_Session1_OD.tif"]
    df = spark.createDataFrame([(n,) for n in names], "file_name string")
    p = N.parse_file_name(df).select("*", *N.crop_fields()).withColumn("again", N.render_file_name())
    rows = {r.file_name: r for r in p.collect()}
    assert set(rows) == set(names[:3])
    assert all(r.again == n for n, r in rows.items())
    assert rows[names[1]].crop_x_position == 430 and rows[names[2]].x_position == 0.5


def test_half_even_grid_and_sectors(spark):
    r = spark.range(1).select(G.steps_of(F.lit(0.25)).alias("a"), G.steps_of(F.lit(0.35)).alias("b"),
                              G.in_thickness_sector(F.lit("X"), F.lit(0.0), F.lit(200.0)).alias("open"),
                              G.in_count_sector(F.lit("X"), F.lit(0), F.lit(4)).alias("closed")).first()
    assert (r.a, r.b) == (2, 4) and not r.open and r.closed


def test_location_codes(spark):
    df = spark.createDataFrame([("tl", "OD"), ("T2S1", "OD"), ("T2S1", "OS"), ("3N", "OD"), ("1.5I", "OS"), ("12", "OD"), ("T1S2N3", "OD")], "c string, e string")
    x, y = N.shorthand_location(F.col("c"), F.col("e"))
    got = [(r.x, r.y) for r in df.select(x.alias("x"), y.alias("y")).collect()]
    assert got == [(1, 1), (-2, 1), (2, 1), (3, 0), (0, -1.5), (None, None), (None, None)]


def test_significance(spark):
    df = spark.createDataFrame([(0.0005,), (0.01,), (0.05,)], "p double")
    assert [r.m for r in df.select(G.significance_marker(F.col("p")).alias("m")).collect()] == ["***", "*", ""]
