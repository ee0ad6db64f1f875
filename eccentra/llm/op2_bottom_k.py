"""Document fingerprints: bottom-k sketches of shingle hashes, made of SQL functions only.

A sketch is the ascending array of the ``k`` least distinct 64-bit hashes of a
text's shingles of five words (a text with fewer words has its whole sequence as
one shingle, a text without words none). Sketches of parts merge into the sketch
of the whole; two sketches estimate resemblance, containment and, alone, the
number of distinct shingles. Sets of fewer than ``k`` shingles are held whole,
so estimates on them are exact.

Words are lower-cased runs without white space. Null text counts as empty: an
empty sketch; two empty sketches have resemblance 1, an empty and another 0.
Equal texts have equal sketches. Repeated rows and null ids are rows like
others: neighbours are ordered by id, nulls last, then by text. Texts are taken
whole. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from eccentra.llm.common import table

K, WIDTH = 256, 5
SPACES = r"[\x20\x09-\x0D]+"


def let(value: Column, use) -> Column:
    """``use`` applied to ``value``, which is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def shingle_hashes(text: Column, width: int = WIDTH) -> Column:
    """Distinct 64-bit hashes of the shingles of a text."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACES), lambda w: w != "")

    def shingles(h: Column) -> Column:
        n = F.size(h)
        many = F.transform(F.sequence(F.lit(1), F.greatest(n - width + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(h, i, width)))
        return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.array_distinct(many))

    return let(F.transform(words, lambda w: F.xxhash64(w)), shingles)


def sketch(text: Column, k: int = K, width: int = WIDTH) -> Column:
    return F.slice(F.sort_array(shingle_hashes(text, width)), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Share of the union's sketch that is in both: estimates |A and B| / |A or B|."""
    both = F.size(F.array_intersect(a, b))
    # no hash in both can be missing from the union's k least unless it lies beyond them
    est = let(merged(a, b, k), lambda u: F.size(F.array_intersect(u, F.array_intersect(a, b))) / F.size(u))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when(both == 0, F.lit(0.0)).otherwise(est)


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below ``k``, else (k - 1) / the k-th least hash as a share of all."""
    share = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of A's shingles that are in B; of the empty set: 1."""
    j = resemblance(a, b, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), j * distinct_count(merged(a, b, k), k) / distinct_count(a, k)))


def merge_groups(sketches: DataFrame, key: str, column: str, k: int = K) -> DataFrame:
    """One sketch per key: the ``k`` least of all its hashes.

    Hashes are distinct before they are ranked, and a task sends the ``k``
    least of a key only, so a hot key is no large group.
    """
    rows = sketches.select(key, F.explode(column).alias("_h")).distinct()
    place = F.row_number().over(W.partitionBy(key).orderBy("_h"))
    least = rows.withColumn("_place", place).filter(F.col("_place") <= k)
    return least.groupBy(key).agg(F.sort_array(F.collect_list("_h")).alias(column))


def as_text(a: Column) -> Column:
    """Base 64 of the hashes' bytes."""
    return F.base64(F.unhex(F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")))


def not_above(value: Column, cuts: list[int]) -> Column:
    """How many of the sorted ``cuts`` are at most ``value``, by binary search."""
    n, held = len(cuts), F.from_json(F.lit(f"[{','.join(map(str, cuts))}]"), "array<bigint>")
    steps = [1 << k for k in range(n.bit_length() - 1, -1, -1)]
    if not steps:
        return F.lit(0)
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda at, s: F.when((at + s <= n) & (F.get(held, at + s - 1) <= value), at + s).otherwise(at))


def with_next(docs: DataFrame, blocks: int) -> DataFrame:
    """(id, text, fp, next_text, next_fp): every document beside the next one by descending id, after the last the first.

    Rows are dealt into ``blocks`` ranges of about equal size at approximate
    quantiles of the ids, and ordered within each. The head of a block is also
    put at the end of the block before it.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    # one pass over the ids: at most ``blocks`` numbers for the driver
    cuts = sorted(set(own.agg(F.percentile_approx("id", [i / blocks for i in range(1, blocks)], 20 * blocks)).first()[0] or [])) if blocks > 1 else []
    # block 0 has the largest ids; nulls come after all others
    block = F.when(F.col("id").isNull(), F.lit(len(cuts) + 1)).otherwise(F.lit(len(cuts)) - not_above(F.col("id"), cuts))
    dealt = own.withColumn("block", block.cast("int")).withColumn("ghost", F.lit(False))
    order = [F.col("id").desc_nulls_last(), F.col("text")]
    tops = {r["block"]: r["id"] for r in dealt.groupBy("block").agg(F.max("id").alias("id")).collect()}  # a row per block
    if not tops:
        return own.select("id", "text", F.array().cast("array<bigint>").alias("fp"), F.col("text").alias("next_text"), F.array().cast("array<bigint>").alias("next_fp"))
    present = sorted(tops)
    before = F.create_map(*[F.lit(x).cast("int") for i, b in enumerate(present) for x in (b, present[i - 1])])
    # of repeated ids the least text heads the block
    heads = (dealt.filter(F.col("id").isin([v for v in tops.values() if v is not None]) | F.col("id").isNull())
             .groupBy("block", "id").agg(F.min("text").alias("text"))
             .select("id", "text", F.element_at(before, F.col("block")).alias("block"), F.lit(True).alias("ghost")))
    rows = dealt.select("id", "text", "block", "ghost").unionByName(heads)
    w = W.partitionBy("block").orderBy(F.col("ghost"), *order)
    beside = rows.withColumn("next_text", F.lead("text").over(w)).withColumn("fp", sketch(F.col("text")))
    beside = beside.withColumn("next_fp", F.lead("fp").over(w))
    return beside.filter(~F.col("ghost")).select("id", "text", "fp", "next_text", "next_fp")


def query(spark, sf_dir: str) -> DataFrame:
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = with_next(table(spark, sf_dir, "documents"), blocks)
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substr(F.col("text"), F.lit(1), n - cut), F.substr(F.col("next_text"), F.lit(1), cut))
    rows = rows.withColumn("edited", edited).withColumn("edited_fp", sketch(F.col("edited")))
    return rows.select(F.col("id").alias("doc_id"), n.cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                       as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("edited_fp")).alias("edited_fingerprint"),
                       resemblance(F.col("fp"), F.col("edited_fp")).alias("near_edited"), resemblance(F.col("fp"), F.col("next_fp")).alias("near_next"))
