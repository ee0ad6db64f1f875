"""A training corpus in five stages: quality, near copies, repeated strings, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept;
all but the last return the columns of ``documents``. ``run`` writes each
stage's result as Parquet in the shared folder and reads it back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from eccentra.llm import op1_decontamination, op3_quality, op6_packing, op7_near_dedup, op9_suffix_dedup
from eccentra.llm.common import keep, table

STAGES = [
    ("quality", op3_quality.stage),
    ("near_dedup", op7_near_dedup.stage),
    ("suffix_dedup", op9_suffix_dedup.stage),
    ("decontamination", op1_decontamination.stage),
    ("packing", op6_packing.stage),
]

#: Trained votes, subword tokens and packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
