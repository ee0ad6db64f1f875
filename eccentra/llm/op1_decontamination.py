"""Benchmark decontamination by spaced seeds, made of SQL functions only.

Words of tests and training texts are hashed. A mask is a fixed set of places
in a short stretch of words; the words at its places are hashed together and
the others ignored, so that a changed word breaks few seeds. Seeds of the tests
are joined to those of the training texts, and around every hit the two texts
are laid side by side on the hit's diagonal: they overlap if some stretch of
``SPAN`` words there (the whole test if shorter) has ``SHARE`` equal words or more.

The tests' seeds mark the bits of a filter of fixed size, which is a literal of
the plan. Training seeds are tested against it where they are made, so only
likely hits become rows; if tests fill the filter, more rows reach the join and
the result is the same. Texts with hits are read again, by a filter over their
keys, and compared once per distinct text, so copies cost nothing more.

Tests of ten words or fewer have masks of their own (``short_masks``), one set per
length: they leave out as many parts of the test as words may differ, so that
every allowed change leaves a seed whole. Up to four words none may differ, and the mask is
the whole test. Such masks are only used for the lengths that occur.

Words are maximal runs of letters and digits, lower-cased; in scripts written
without spaces (``UNSPACED``) every character is a word. Null texts have no
words. Tests without words match nothing. Null ids are ids like others, repeated rows all get
their text's result. Texts are taken whole. Extra columns are ignored; with an
empty table of tests every document is clean.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from eccentra.llm.common import keep, table

#: Places of the words that a seed takes.
MASKS = ((0, 1, 2, 4, 5), (0, 1, 3, 5, 6), (0, 1, 4, 5, 7))
SPAN, SHARE = 12, 0.8
BITS = 1 << 20
#: Tests of so many words have masks of their own: the general ones miss changes in them.
SHORT = 10
#: Scripts without spaces between words.
UNSPACED = "".join(r"\p{Is%s}" % s for s in ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar"))


def short_masks(words: int, share: float = SHARE) -> list[tuple[int, ...]]:
    """Places in a test of so many words: it is cut into parts, two more than words may differ, and every mask leaves out as many parts as may differ."""
    change = words - ceil(words * share - 1e-9)
    parts = min(words, change + 2) if change else 1
    part = [i * parts // words for i in range(words)]
    return [tuple(i for i in range(words) if part[i] not in gone) for gone in combinations(range(parts), change)]


def let(value: Column, use) -> Column:
    """``use`` applied to ``value``, which is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def word_keys(text: Column) -> Column:
    def whole(w: Column) -> Column:  # a separator at either end leaves an empty word there
        first, last = (F.get(w, F.lit(0)) == "").cast("int"), (F.element_at(w, -1) == "").cast("int")
        return F.slice(w, first + 1, F.greatest(F.size(w) - first - last, F.lit(0)))

    own, gap = F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"
    beside = rf"{gap}|(?<=[\p{{L}}\p{{N}}])(?=[{UNSPACED}])|(?<=[{UNSPACED}])(?=[\p{{L}}\p{{N}}])"
    # texts of single bytes have none of these scripts
    words = let(F.when(F.octet_length(own) == F.char_length(own), F.split(own, gap)).otherwise(F.split(own, beside)), whole)
    return F.transform(words, lambda w: F.xxhash64(w))


def pair(words: Column, i: Column) -> Column:
    """A cheap hash of the first two places of every mask."""
    return F.get(words, i).bitwiseXOR(F.shiftleft(F.get(words, i + 1), 1))


def seeds_at(words: Column, i: Column, masks=MASKS) -> list[Column]:
    """One hash per mask for the start ``i`` (from 0); null where a mask leaves the text."""
    return [F.when(i + mask[-1] < F.size(words), F.xxhash64(F.lit(m), *[F.get(words, i + p) for p in mask])) for m, mask in enumerate(masks)]


def short_seeds(words: Column, i: Column, length: int, share: float = SHARE) -> list[Column]:
    """One hash per mask of the tests of so many words, for the start ``i``."""
    return [F.xxhash64(F.lit(100 * length + m), *[F.get(words, i + p) for p in mask]) for m, mask in enumerate(short_masks(length, share))]


def starts(words: Column, masks=MASKS) -> Column:
    """All places where the shortest mask can start."""
    n = F.size(words) - min(m[-1] for m in masks)
    return F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def bits_of(hashes: DataFrame, column: str, bits: int = BITS) -> Column:
    """A foldable array of longs with two bits set per hash. Driver and plan hold ``bits / 8`` bytes."""
    both = F.array(F.pmod(column, F.lit(bits)), F.pmod(F.xxhash64(column), F.lit(bits)))
    rows = (hashes.select(F.explode(both).alias("p")).groupBy(F.expr("p div 64").alias("w"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(p, 64) as int))")).alias("v")).toArrow())
    words = np.zeros(bits // 64, dtype=np.int64)
    words[rows.column("w").to_numpy()] = rows.column("v").to_numpy()
    return F.from_json(F.lit("[" + ",".join(map(str, words.tolist())) + "]"), "array<bigint>")


def bit(filled: Column, x: Column, bits: int = BITS) -> Column:
    p = F.pmod(x, F.lit(bits))
    word = F.get(filled, F.call_function("shiftright", p, F.lit(6)).cast("int"))
    return F.call_function("shiftright", word, p.bitwiseAND(F.lit(63).cast("long")).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1


def may_hold(filled: Column, h: Column, bits: int = BITS) -> Column:
    return bit(filled, h, bits) & bit(filled, F.xxhash64(h), bits)


def keys(text: Column) -> list[Column]:
    own = F.coalesce(text, F.lit(""))
    return [F.xxhash64(own).alias("k1"), F.xxhash64(own, F.lit(1)).alias("k2")]


def overlaps(docs: DataFrame, tests: DataFrame, masks=MASKS, span: int = SPAN, share: float = SHARE) -> DataFrame:
    """(k1, k2, item_id, equal): distinct texts with the tests they overlap, and the most equal words of a stretch."""
    items = keep(tests.select("item_id", word_keys(F.col("text")).alias("words")), "items")
    size = F.size("words")
    lengths = sorted(r["n"] for r in items.select(size.alias("n")).filter(size.between(1, SHORT)).distinct().collect())  # SHORT numbers at most
    own = items.filter(size > SHORT).select("item_id", "words", F.explode(starts(F.col("words"), masks)).alias("j"))
    seeds = own.select("item_id", "j", pair(F.col("words"), F.col("j")).alias("pair"), F.explode(F.array(*seeds_at(F.col("words"), F.col("j"), masks))).alias("h"))
    for n in lengths:
        seeds = seeds.unionByName(items.filter(size == n).select("item_id", F.lit(0).alias("j"), F.lit(None).cast("long").alias("pair"),
                                                                 F.explode(F.array(*short_seeds(F.col("words"), F.lit(0), n, share))).alias("h")))
    probes = keep(seeds.filter("h is not null"), "probes")
    if probes.isEmpty():
        return items.sparkSession.createDataFrame([], f"k1 long, k2 long, item_id {tests.schema['item_id'].dataType.simpleString()}, equal int")
    filled, pairs_filled = bits_of(probes.select("h").distinct(), "h"), bits_of(probes.filter("pair is not null").select("pair").distinct(), "pair")

    def held(hashes: list[Column], i: Column) -> Column:
        return F.array(*[F.struct(i.alias("i"), h.alias("h")) for h in hashes])

    def short_at(words: Column, n: int):
        return lambda i: held(short_seeds(words, i, n, share), i)

    def hits(words: Column) -> Column:
        # places whose first two words are together in some test, then their seeds
        likely = F.filter(starts(words, masks), lambda i: bit(pairs_filled, pair(words, i)))
        flat = [F.flatten(F.transform(likely, lambda i: held(seeds_at(words, i, masks), i)))]
        for n in lengths:
            places = F.when(F.size(words) >= n, F.sequence(F.lit(0), F.greatest(F.size(words) - n, F.lit(0)))).otherwise(F.array().cast("array<int>"))
            flat.append(F.flatten(F.transform(places, short_at(words, n))))
        return F.concat(*[F.filter(x, lambda x: x["h"].isNotNull() & may_hold(filled, x["h"])) for x in flat])

    marked = docs.select(*keys(F.col("text")), F.explode(let(word_keys(F.col("text")), hits)).alias("x"))
    found = (marked.select("k1", "k2", F.col("x.i").alias("i"), F.col("x.h").alias("h")).join(probes.drop("pair"), "h")
             .select("k1", "k2", "item_id", (F.col("i") - F.col("j")).alias("diagonal")).distinct())
    found = keep(found, "hits")

    # the texts with hits, once each, laid beside the tests
    again = bits_of(found.select("k1").distinct(), "k1")
    texts = docs.select("text", *keys(F.col("text"))).filter(may_hold(again, F.col("k1"))).groupBy("k1", "k2").agg(F.first("text").alias("text"))
    texts = texts.select("k1", "k2", word_keys(F.col("text")).alias("words"))
    pairs = found.join(texts, ["k1", "k2"]).join(items.select("item_id", F.col("words").alias("test")), "item_id")
    low = F.greatest(F.lit(0), F.col("diagonal"))
    high = F.least(F.size("words"), F.size("test") + F.col("diagonal")) - 1
    same = F.transform(F.sequence(low, high), lambda k: F.when(F.get("words", k) == F.get("test", k - F.col("diagonal")), 1).otherwise(0))
    wide = F.least(F.lit(span), F.size("test"))

    def best(eq: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(eq) - wide + 1, F.lit(1)))
        return F.array_max(F.transform(starts, lambda s: F.aggregate(F.slice(eq, s, wide), F.lit(0), lambda a, x: a + x)))

    judged = pairs.select("k1", "k2", "item_id", let(same, best).alias("equal"), wide.alias("wide"))
    return judged.filter(F.col("equal") >= F.ceil(F.col("wide") * share)).groupBy("k1", "k2", "item_id").agg(F.max("equal").alias("equal"))


def contaminated(docs: DataFrame, tests: DataFrame, **how) -> DataFrame:
    """(k1, k2, items, equal) per distinct text that overlaps a test: the number of tests and the most equal words."""
    return overlaps(docs, tests, **how).groupBy("k1", "k2").agg(F.count("*").alias("items"), F.min("item_id").alias("first_item"), F.max("equal").alias("equal"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contaminated(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return docs.select("doc_id", *keys(F.col("text"))).join(found, ["k1", "k2"], "left").select(
        "doc_id", F.col("items").isNotNull().alias("contaminated"), F.coalesce("items", F.lit(0)).cast("long").alias("n_items"), F.col("first_item"), F.coalesce("equal", F.lit(0)).alias("equal_words"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    found = keep(contaminated(docs.select("text"), table(spark, sf_dir, "benchmark").select("item_id", "text")).select("k1", "k2"), "contaminated")
    if found.isEmpty():
        return docs
    # rows that surely are clean pass beside the join
    filled = bits_of(found.select("k1"), "k1")
    marked = docs.select(F.struct("*").alias("row"), *keys(F.col("text")))
    suspect = may_hold(filled, F.col("k1"))
    return marked.filter(~suspect).select("row.*").unionByName(marked.filter(suspect).join(found, ["k1", "k2"], "left_anti").select("row.*"))
