"""Cohort tables: baseline values, strata, medians, bands.

Groups here run across subjects and have no size bound, so order statistics go
through :mod:`eccentra.operators.ordered`; moments are ordinary aggregates.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from eccentra.functions import geometry as G
from eccentra.operators import ordered


def with_subject_values(baseline: DataFrame) -> DataFrame:
    """Age in years and the eye-side values of each subject."""
    right = F.col("laterality") == "OD"
    return (baseline.withColumn("age", G.age_years(F.col("birth_date"), F.col("visit_date")))
            .withColumn("axial_length", F.when(right, F.col("axial_right")).otherwise(F.col("axial_left")))
            .withColumn("sphere", F.when(right, F.col("sphere_right")).otherwise(F.col("sphere_left"))))


def join_baseline(profiles: DataFrame, baseline: DataFrame) -> DataFrame:
    """Profiles with their subject's values; subjects without a row drop out.

    Spark broadcasts the baseline while its size is below the session's limit
    and falls back to a shuffle join beyond it.
    """
    return profiles.join(with_subject_values(baseline), "subject_id")


def half_open_bins(value: Column, edges: Sequence[float], last_closed: bool = True) -> Column:
    """Label ``lo-hi`` of the bin [lo, hi); the last one may be closed."""
    out = F.lit(None).cast("string")
    for i in range(len(edges) - 2, -1, -1):
        lo, hi = edges[i], edges[i + 1]
        upper = value <= hi if last_closed and i == len(edges) - 2 else value < hi
        out = F.when((value >= lo) & upper, F.lit(f"{lo:g}-{hi:g}")).otherwise(out)
    return out


def closed_intervals(value: Column, intervals: Sequence[tuple[float, float]]) -> Column:
    out = F.lit(None).cast("string")
    for lo, hi in reversed(list(intervals)):
        out = F.when((value >= lo) & (value <= hi), F.lit(f"{lo:g}..{hi:g}")).otherwise(out)
    return out


def visit_period(visit: Column) -> Column:
    return (F.when(visit < F.lit("2021-07-01").cast("date"), "before 2021-07")
            .when(visit <= F.lit("2022-01-01").cast("date"), "2021-07 to 2022-01").otherwise("after 2022-01"))


def median_std(df: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Median, sample deviation and count of each feature, in long form."""
    keys = list(keys)
    long = df.unpivot(keys, [F.col(f).cast("double").alias(f) for f in features], "feature", "value").filter(
        F.col("value").isNotNull())
    med = ordered.quantiles(long, keys + ["feature"], "value", {"median": 0.5})
    std = long.groupBy(*keys, "feature").agg(F.stddev_samp("value").alias("std"), F.count("*").alias("n"))
    return med.join(std, keys + ["feature"])


def stratified(df: DataFrame, stratum: Column, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Median and deviation per stratum; rows outside every stratum drop out."""
    s = df.withColumn("stratum", stratum).filter(F.col("stratum").isNotNull())
    return median_std(s, ["stratum", *keys], features)


def stratum_sizes(df: DataFrame, stratum: Column) -> DataFrame:
    s = df.withColumn("stratum", stratum).filter(F.col("stratum").isNotNull())
    return s.select("stratum", "subject_id").distinct().groupBy("stratum").agg(F.count("*").alias("n_subjects"))


def percentile_band(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Median with 15 and 85 % limits; null where half of the group is null."""
    keys = list(keys)
    share = df.groupBy(*keys).agg(F.avg(F.when(F.col(value).isNull(), 1.0).otherwise(0.0)).alias("_null_share"))
    q = ordered.quantiles(df, keys, value, {"median": 0.5, "lower": 0.15, "upper": 0.85})
    ok = F.col("_null_share") < 0.5
    return share.join(q, keys, "left").select(*keys, *[F.when(ok, F.col(c)).alias(c) for c in ("median", "lower", "upper")])


def leave_one_out_bands(df: DataFrame, keys: Sequence[str], value: str,
                        probs: Mapping[str, float] | None = None) -> DataFrame:
    """Every row against the band of all *other* rows of its group; null where half of these or more are null.

    Without a row at place i, the k-th smallest of the rest is the k-th of all
    where k < i and the (k+1)-th otherwise; without a null row nothing changes.
    Six picks per quantile therefore serve every row at once, instead of one
    cohort per subject, and the share of nulls among the others follows from two counts.
    """
    probs = dict(probs or {"median": 0.5, "lower": 0.15, "upper": 0.85})
    keys = list(keys)
    pos = ordered.positions(df, keys, value)
    n = F.col("tied_total")
    picks = []
    for name, p in probs.items():
        rest, every = F.lit(float(p)) * (n - 2), F.lit(float(p)) * (n - 1)
        for tag, k in (("lo", F.floor(rest)), ("lo1", F.floor(rest) + 1), ("hi", F.ceil(rest)), ("hi1", F.ceil(rest) + 1),
                       ("all_lo", F.floor(every)), ("all_hi", F.ceil(every))):
            inside = (F.col("tied_before") <= k) & (k < F.col("tied_before") + F.col("tied"))
            picks.append(F.max(F.when(inside, F.col(value))).alias(f"_{name}_{tag}"))
    found = pos.groupBy(*keys).agg(F.max("tied_total").alias("_n"), *picks)
    counts = df.groupBy(*keys).agg(F.count("*").alias("_rows"), F.count_if(F.col(value).isNull()).alias("_nulls"))
    here = df.join(pos.select(*keys, value, F.col("tied_before").alias("_place")), keys + [value], "left").join(counts, keys).join(found, keys, "left")
    missing = F.col(value).isNull()
    most = F.col("_nulls") - missing.cast("long") < 0.5 * (F.col("_rows") - 1)
    outs = []
    for name, p in probs.items():
        rest, every = F.lit(float(p)) * (F.col("_n") - 2), F.lit(float(p)) * (F.col("_n") - 1)
        lo = F.when(F.floor(rest) < F.col("_place"), F.col(f"_{name}_lo")).otherwise(F.col(f"_{name}_lo1"))
        hi = F.when(F.ceil(rest) < F.col("_place"), F.col(f"_{name}_hi")).otherwise(F.col(f"_{name}_hi1"))
        a, z = F.col(f"_{name}_all_lo"), F.col(f"_{name}_all_hi")
        band = F.when(missing, a + (z - a) * (every - F.floor(every))).when(F.col("_n") > 1, lo + (hi - lo) * (rest - F.floor(rest)))
        outs.append(F.when(most, band).alias(name))
    return here.select(*df.columns, *outs)


def median_std_text(median: Column, std: Column) -> Column:
    """``median (std)`` with six significant digits."""
    return F.format_string("%.6g (%.6g)", median, std)


def best_resolution(datasets: DataFrame, keys: Sequence[str], dataset: str, rows: str, total: Column) -> DataFrame:
    """Dataset with most rows, then the largest product of its shape; the
    smallest id among equals, with the number of equals."""
    t = datasets.withColumn("total", total)
    best = t.groupBy(*keys).agg(F.max(F.struct(rows, "total")).alias("_b"))
    same = t.join(best, list(keys)).filter((F.col(rows) == F.col(f"_b.{rows}")) & (F.col("total") == F.col("_b.total")))
    return same.groupBy(*keys, rows, "total").agg(F.min(dataset).alias(dataset), F.count("*").alias("n_best"))


def study_validity(datasets: DataFrame, study: Sequence[str], laterality: str) -> DataFrame:
    """A study needs a cube and both line scans of the wanted eye."""
    def has(v):
        return F.count_if((F.col("variant") == v) & (F.col("laterality") == laterality)) > 0
    return datasets.groupBy(*study).agg((has("CUBE") & has("LINE_0") & has("LINE_90")).alias("valid"),
                                        F.count("*").alias("n_datasets"))
