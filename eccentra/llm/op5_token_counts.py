"""Token counts through a digest cache.

A cache table holds (digest, version, n_tokens). Texts are joined to it by the
digest of their normalised content and by the tokenizer's version digest; only
distinct texts that are missing are encoded, and their counts are appended.

Null text counts as empty. Repeated texts are encoded once: a task keeps one
copy per digest before the shuffle, so copies of one text, however many, are
never brought together. An empty table gives an empty result, an empty or
absent cache makes every distinct text a miss. Texts are taken whole.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from eccentra.llm import tokens
from eccentra.llm.common import by_value, fresh, keep, table

by_value(__name__)

CACHE = "digest binary, version string, n_tokens long"


def version_of(name: str) -> str:
    """Digest of the tokenizer's file and of how it is called."""
    with open(tokens.tokenizer_file(name), "rb") as f:
        return hashlib.sha256(f.read() + b"|no added tokens|whole text|as is").hexdigest()


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, digest); normalised content is the text itself, null as empty, as any change might change its tokens."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), text.alias("text"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))


def read_cache(spark, path: str) -> DataFrame:
    """The cache table; an empty one if nothing has been written yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.read.schema(CACHE).parquet(path)
    return spark.createDataFrame([], CACHE)


def fill_cache(docs: DataFrame, cache: str, tokenizer: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode the distinct texts that the cache lacks and append their counts."""
    version = version_of(tokenizer)
    known = read_cache(docs.sparkSession, cache).filter(F.col("version") == version).select("digest").distinct()
    one = digests(docs, id_col, text_col).groupBy("digest").agg(F.first("text").alias("text"))
    misses = one.join(known, "digest", "left_anti")

    def encode(batches):
        enc = tokens.Encoder(tokenizer)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                counts = [len(enc.ids(t)) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("digest"), pa.array([version] * len(counts)), pa.array(counts, pa.int64())], ["digest", "version", "n_tokens"])

    misses.mapInArrow(encode, CACHE).write.mode("append").parquet(cache)


def token_counts(docs: DataFrame, cache: str, tokenizer: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) for every row, through the cache at path ``cache``.

    Two jobs that append the same digest at once leave equal rows; they are read as one.
    """
    fill_cache(docs, cache, tokenizer, id_col, text_col)
    # written once more, so that a hot digest meets it in a join that Spark may split
    stored = keep(read_cache(docs.sparkSession, cache).filter(F.col("version") == version_of(tokenizer))
                  .groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "counts")
    own = digests(docs, id_col, text_col).select("id", "digest", F.octet_length("text").cast("long").alias("n_bytes"))
    return own.join(stored, "digest").select(F.col("id").alias(id_col), "n_bytes", "n_tokens")


def query(spark, sf_dir: str) -> DataFrame:
    out = token_counts(table(spark, sf_dir, "documents"), fresh(spark, "token-cache"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))
