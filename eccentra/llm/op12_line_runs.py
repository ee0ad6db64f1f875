"""Line dedup by levelled sorted runs of line hashes, made of SQL functions only.

A *run* is a table of line hashes, dealt into buckets and sorted within, with the
number of documents that hold the line; lines found in ``limit`` documents lie in
a part of it by themselves, they are *settled*. Runs lie on levels. A batch of documents
is counted by itself, merge-anti-joined with the settled lines of all runs
(nothing more need be known of them), and what is left is added to level 0 as a
run of its own. Two runs of a level are compacted: merged line by line, counts
added, they form one run of the next level. A line is written once per level, so
adding a batch costs in proportion to the batch, not to what is stored. All runs
have the same buckets, so they are merged as they lie, without an exchange.

``LineRuns.add`` returns the batch's lines that were not settled before: with
``limit=1`` those never seen, for a corpus that arrives day by day. ``frequent``
compacts all levels and returns the settled lines; ``dropped`` takes them out of
the documents.

A line's key is the line without white space at either end, A-Z lower-cased;
lines whose key is shorter than ``least`` stay. Two 64-bit hashes stand for a
key. A document (row) counts once for a line, however often it repeats it;
repeated rows and null ids count like others. Null text counts as one empty line
and, in the stage's columns, stays null. A line in all documents is one row per task once
counted. Lines that may be settled, by a filter of fixed size that is a literal of
the plan, meet the settled lines; texts that surely lose none pass beside the join
by another such filter; when filters fill up, more rows are joined and
results are the same. Extra columns are ignored by the
query and kept by ``dropped``; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from eccentra.llm.common import discard, keep, table
from eccentra.llm.op1_decontamination import bits_of, keys, let, may_hold
from eccentra.session import scratch_path

LIMIT, LEAST = 10, 1
#: Batches that a whole table is dealt into.
BATCHES = 4
BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    """A line without blanks at its ends, A-Z lower-cased; text of single bytes goes the short way."""
    bare = F.trim(line, F.lit(BLANK))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def hashed(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("h"), F.xxhash64(key, F.lit(1)).alias("g"))


def line_hashes(text: Column, least: int = LEAST) -> Column:
    """(h, g) of every line, null where the key is too short."""
    return F.transform(lines(text), lambda x: let(line_key(x), lambda k: F.when(F.char_length(k) >= least, hashed(k))))


class LineRuns:
    """The runs of a corpus in the shared folder: at most one per level between two calls."""

    def __init__(self, spark: SparkSession, limit: int = LIMIT, buckets: int | None = None):
        self.spark, self.limit = spark, limit
        self.buckets = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
        self.levels: list[DataFrame | None] = []

    def _write(self, rows: DataFrame) -> DataFrame:
        """A sorted run of (h, g, n), its settled lines apart; ``rows`` are dealt by h and g already."""
        name, path = f"lines_{uuid.uuid4().hex}", scratch_path(self.spark, "run")
        (rows.withColumn("settled", F.col("n") >= self.limit).write.format("parquet").partitionBy("settled").bucketBy(self.buckets, "h", "g").sortBy("h", "g")
         .option("compression", "zstd").option("path", path).saveAsTable(name))
        out = self.spark.table(name)
        out._kept, out._name = path, name
        return out

    def _delete(self, *runs: DataFrame) -> None:
        for r in runs:
            self.spark.sql(f"drop table if exists {r._name}")
        discard(*runs)

    def _merged(self, one: DataFrame, two: DataFrame) -> DataFrame:
        a, b = one.select("h", "g", F.col("n").alias("a")), two.select("h", "g", F.col("n").alias("b"))
        zero = F.lit(0).cast("long")
        both = a.join(b.hint("merge"), ["h", "g"], "full_outer")
        out = self._write(both.select("h", "g", (F.coalesce("a", zero) + F.coalesce("b", zero)).alias("n")))
        self._delete(one, two)
        return out

    def add(self, batch: DataFrame) -> DataFrame:
        """Add (h, g, n), one row per line; returns those not settled before, written."""
        new = batch.select("h", "g", "n").repartition(self.buckets, "h", "g")
        for run in [r for r in self.levels if r is not None]:
            new = new.join(run.filter("settled").select("h", "g").hint("merge"), ["h", "g"], "left_anti")
        fresh = keep(new, "new-lines")
        run, at = self._write(fresh.repartition(self.buckets, "h", "g")), 0
        while at < len(self.levels) and self.levels[at] is not None:
            run, self.levels[at] = self._merged(self.levels[at], run), None
            at += 1
        self.levels += [None] * (at + 1 - len(self.levels))
        self.levels[at] = run
        return fresh

    def frequent(self) -> DataFrame:
        """(h, g): all settled lines, once each, written. One run is left."""
        runs = [r for r in self.levels if r is not None]
        if not runs:
            return keep(self.spark.createDataFrame([], "h long, g long"), "frequent")
        whole = runs[0]
        for r in runs[1:]:
            whole = self._merged(r, whole)
        self.levels = [None] * (len(self.levels) - 1) + [whole]
        return keep(whole.filter("settled").select("h", "g"), "frequent")

    def close(self) -> None:
        self._delete(*[r for r in self.levels if r is not None])
        self.levels = []


def frequent_lines(docs: DataFrame, limit: int = LIMIT, least: int = LEAST, batches: int = BATCHES, text_col: str = "text") -> DataFrame:
    """(h, g): lines found in ``limit`` documents or more; the documents are dealt into batches by their text's hash.

    Texts are read once: lines are counted per batch in one pass.
    """
    spark, text = docs.sparkSession, F.col(text_col)
    own = docs.select(F.pmod(F.xxhash64(text), F.lit(batches)).cast("int").alias("batch"), F.explode(F.array_distinct(F.filter(line_hashes(text, least), lambda x: x.isNotNull()))).alias("x"))
    counted = keep(own.select("batch", "x.h", "x.g").groupBy("batch", "h", "g").agg(F.count("*").alias("n")), "lines")
    runs = LineRuns(spark, limit)
    for b in range(batches):
        discard(runs.add(counted.filter(F.col("batch") == b)))
    out = runs.frequent()
    runs.close()
    discard(counted)
    return out


ADDED = ("_lines", "_dropped", "_text")


def dropped(docs: DataFrame, limit: int = LIMIT, least: int = LEAST, batches: int = BATCHES, text_col: str = "text") -> DataFrame:
    """``docs`` with ``_lines`` (before), ``_dropped`` (lines taken out) and ``_text`` (what is left); columns so named are replaced."""
    docs = docs.drop(*ADDED)
    settled = frequent_lines(docs, limit, least, batches, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    filled = bits_of(settled.select("h"), "h")
    marked = docs.select(F.struct("*").alias("row"), text.alias("text"), *keys(text))

    # places of lines that may be settled, per distinct text
    likely = F.filter(F.transform(line_hashes(text, least), lambda x, i: F.struct(i.alias("at"), x["h"].alias("h"), x["g"].alias("g"))), lambda x: x["h"].isNotNull() & may_hold(filled, x["h"]))
    places = docs.select(*keys(text), F.explode(likely).alias("x")).select("k1", "k2", "x.*").distinct().join(settled, ["h", "g"])
    found = keep(places.groupBy("k1", "k2").agg(F.collect_set("at").alias("gone")), "places")

    # texts that surely lose no line pass beside the join
    again = bits_of(found.select("k1"), "k1")
    suspect, n = may_hold(again, F.col("k1")), F.size(lines(F.col("text"))).cast("long")
    rest = marked.filter(~suspect).select("row", n.alias("_lines"), F.lit(0).cast("long").alias("_dropped"), F.col("text").alias("_text"))
    left = F.filter(lines(F.col("text")), lambda x, i: ~F.array_contains("gone", i))
    hit = marked.filter(suspect).join(found, ["k1", "k2"], "left")
    stays = F.col("gone").isNull()
    hit = hit.select("row", n.alias("_lines"), F.when(stays, F.lit(0)).otherwise(F.size("gone")).cast("long").alias("_dropped"),
                     F.when(stays, F.col("text")).otherwise(F.array_join(left, "\n")).alias("_text"))
    return hit.unionByName(rest).select("row.*", *ADDED)  # apart, as columns of the row may have any name


def query(spark, sf_dir: str) -> DataFrame:
    out = dropped(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_dropped").alias("n_dropped"), F.sha2(F.col("_text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = rf"""with split as (select doc_id, row_number() over () as r, string_split(coalesce(text, ''), chr(10)) as parts from documents),
lines as (select r, doc_id, unnest(parts) as line, unnest(range(len(parts))) as pos from split),
keyed as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') as k from lines),
often as (select k from keyed where length(k) >= {LEAST} group by k having count(distinct r) >= {LIMIT})
select doc_id, count(*) as n_lines, count(often.k) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where often.k is null), '')) as kept_sha256
from keyed left join often using (k) group by r, doc_id"""
