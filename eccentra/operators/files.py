"""Checks and groupings over parsed image files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

# Every identifying field except modality and crop prefix.
FAMILY = ["subject_id", "session_id", "eye", "x_position", "y_position", "x_size", "y_size",
          "image_id", "postfix", "extension"]


def same_except_modality(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of files equal in everything but modality and crop prefix."""
    r = right.select(*[F.col(c).alias(f"_r_{c}") for c in FAMILY], F.col("file_no").alias("other_file_no"),
                     F.col("modality").alias("other_modality"))
    on = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in FAMILY]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return left.join(r, cond).drop(*[f"_r_{c}" for c in FAMILY])


def modality_families(files: DataFrame) -> DataFrame:
    """Members per acquisition: one row per family, never its pairs."""
    return files.groupBy(*FAMILY).agg(
        F.count("*").alias("n_files"), F.countDistinct("modality").alias("n_modalities"),
        F.array_sort(F.collect_set("modality")).alias("modalities"))


def filter_modality(files: DataFrame, modalities: Sequence[str], name: str = "file_name") -> DataFrame:
    cond = F.lit(False)
    for m in modalities:
        cond = cond | F.col(name).contains(m)
    return files.filter(cond)


def modality_counterparts(files: DataFrame, base: str, others: Sequence[str]) -> DataFrame:
    """For each file of modality ``base`` whether each other modality exists.

    One pass over families: the presence flags travel with the family key, so
    no file is paired with another one.
    """
    flags = files.groupBy(*FAMILY, F.coalesce("prefix", F.lit("")).alias("_prefix")).agg(
        *[F.max(F.when(F.col("modality") == m, 1).otherwise(0)).alias(f"has_{m}") for m in others])
    mine = files.filter(F.col("modality") == base).withColumn("_prefix", F.coalesce("prefix", F.lit("")))
    wanted = F.explode(F.array(*[F.struct(F.lit(m).alias("modality"), (F.col(f"has_{m}") == 1).alias("present"))
                                 for m in others]))
    return (mine.join(flags, FAMILY + ["_prefix"]).select("file_no", "file_name", wanted.alias("w"))
            .select("file_no", "file_name", F.col("w.modality").alias("wanted_modality"), "w.present"))


def modality_completeness(files: DataFrame, folder: Sequence[str]) -> DataFrame:
    """Usable modalities of each folder from its file counts."""
    def n(m):
        return F.count(F.when(F.col("modality") == m, 1)).alias(f"n_{m}")
    counts = files.groupBy(*folder).agg(n("Confocal"), n("CalculatedSplit"), n("DarkField"))
    c, s, d = F.col("n_Confocal"), F.col("n_CalculatedSplit"), F.col("n_DarkField")
    lacking = (c < s) | (c < d)
    without = (F.when(s > d, F.array(F.lit("CalculatedSplit")))
               .when(d > s, F.array(F.lit("DarkField")))
               .otherwise(F.array(F.lit("DarkField"), F.lit("CalculatedSplit"))))
    with_ = F.concat(F.array(F.lit("Confocal")),
                     F.when(c > s, F.array().cast("array<string>")).otherwise(F.array(F.lit("CalculatedSplit"))),
                     F.when(c > d, F.array().cast("array<string>")).otherwise(F.array(F.lit("DarkField"))))
    return counts.withColumn("modalities", F.array_join(F.when(lacking, without).otherwise(with_), ","))


def name_violations(files: DataFrame) -> DataFrame:
    """Files whose own ids differ from the ids of their folder."""
    return files.filter(~(F.col("subject_id").eqNullSafe(F.col("dir_subject_id"))
                          & F.col("session_id").eqNullSafe(F.col("dir_session_id"))))


def steps_done_todo(subjects: DataFrame, outputs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every subject with ``done`` from the presence of an output row."""
    present = outputs.select(*keys).distinct().withColumn("_done", F.lit(True))
    return subjects.join(present, list(keys), "left").withColumn(
        "done", F.coalesce("_done", F.lit(False))).drop("_done")
