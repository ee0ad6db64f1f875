"""Best-two-fit packing of token sequences.

Bins are filled greedily, longest first; then the smallest document of a bin is
replaced by two unpacked ones if they fill its expanded gap more tightly. As
lengths are whole numbers up to the capacity, the filling depends only on how
many pieces have each length. The counts, at most ``capacity`` numbers, are
packed on the driver as bin patterns with multiplicities; a pattern is repeated
as long as its lengths last, which gives the same bins as filling them one by
one. Every piece then finds its place by its number among the pieces of its
length, which is counted per task and offset by the tasks before. So the packing
is global, nothing is grouped into one task, and the plan that is broadcast has
a bounded size.

Null text counts as empty: it has the end token only. Repeated rows and rows
without id are packed one by one. Extra columns are ignored, an empty table
gives no sequences. Ties are settled by nothing but the task and the place in it.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from eccentra.llm import tokens
from eccentra.llm.common import by_value, keep, table

by_value(__name__)

CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, block int, rank long"


def cut_points(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens; only the first may be shorter than the capacity."""
    first = n if n <= capacity else (n % capacity or capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0,
           id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of every document with ``block`` and ``rank``: the piece's number among those of its length in its task."""
    schema = PIECES + (", ids array<int>" if with_ids else "")

    def run(batches):
        enc, seen, block = tokens.Encoder(tokenizer), {}, TaskContext.get().partitionId()
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                rows = []
                for key, text in zip(part.column("k").to_pylist(), part.column("t").to_pylist()):
                    ids = np.array(enc.ids(text) + [end_id], dtype="<u4")
                    for p, (start, length) in enumerate(cut_points(len(ids), capacity)):
                        rank = seen.get(length, 0)
                        seen[length] = rank + 1
                        own = ids[start: start + length]
                        rows.append((key, p, start, length, zlib.crc32(own.tobytes()), block, rank) + ((own.astype(np.int32).tolist(),) if with_ids else ()))
                cols = list(zip(*rows))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()] + [pa.list_(pa.int32())] * with_ids
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "block", "rank"] + ["ids"] * with_ids
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    return docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t")).mapInArrow(run, schema)


def fill(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Bin patterns (lengths in placing order) and how often each is used.

    A pattern is what the greedy filling and the exchange for two make of the
    lengths that are left. It stays the same until one of its lengths runs out,
    so it is used that many times at once.
    """
    left = np.zeros(capacity + 1, dtype=np.int64)
    for n, c in counts.items():
        left[n] = c
    out = []
    while left.any():
        have = left.copy()
        lower = np.maximum.accumulate(np.where(have > 0, np.arange(capacity + 1), 0))  # the longest length up to each
        gap, bin_ = capacity, []
        while gap:
            n = int(lower[gap])
            while n and have[n] == 0:  # ``lower`` was made before this bin took some
                n = int(lower[n - 1])
            if n == 0:
                break
            bin_.append(n)
            have[n] -= 1
            gap -= n
        if gap:
            smallest = bin_[-1]
            room = gap + smallest
            some = np.flatnonzero(have[: room + 1])
            if len(some):
                kept = np.where(have > 0, np.arange(capacity + 1), 0)
                upto = np.maximum.accumulate(kept)
                other = upto[room - some]
                alone = (other == some) & (have[some] < 2)  # the partner must be another document
                other = np.where(alone, upto[np.maximum(some - 1, 0)], other)
                total = np.where(other > 0, some + other, 0)
                best = int(total.argmax())
                if total[best] > smallest:
                    bin_[-1:] = sorted((int(some[best]), int(other[best])), reverse=True)
        need = np.bincount(bin_, minlength=capacity + 1)
        used = np.flatnonzero(need)
        times = int((left[used] // need[used]).min())
        left -= need * times
        out.append((tuple(bin_), times))
    return out


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[np.ndarray]:
    """Per slot: length, first rank, first sequence, number of sequences, offset; sorted by length and rank."""
    used: dict[int, int] = {}
    rows, first = [], 0
    for lengths, times in patterns:
        offset = 0
        for n in lengths:
            rank = used.get(n, 0)
            rows.append((n, rank, first, times, offset))
            used[n] = rank + times
            offset += n
        first += times
    return [np.array(c, dtype=np.int64) for c in zip(*sorted(rows))] if rows else [np.zeros(0, dtype=np.int64)] * 5


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces that have length, block and rank.

    ``parts`` must be a written table: its ranks are used twice.
    """
    per_block = parts.groupBy("length", "block").agg(F.count("*").alias("n"))
    before = W.partitionBy("length").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    offsets = per_block.select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # one row per length
    plan = parts.sparkSession.sparkContext.broadcast(slots(fill(counts, capacity)))
    numbered = (parts.join(offsets, ["length", "block"]).withColumn("rank", F.col("rank") + F.col("first")).drop("first", "block"))
    names = [c for c in parts.columns if c not in ("block", "rank")]
    schema = ", ".join([f"{c} {numbered.schema[c].dataType.simpleString()}" for c in names] + ["sequence_id long", "offset long"])

    def place(batches):
        length, rank, first, _, offset = plan.value
        base = np.concatenate([[0], rank])[1:]
        width = np.int64(1) << 40
        keys = length * width + base
        for batch in batches:
            n = batch.column("length").to_numpy().astype(np.int64)
            r = batch.column("rank").to_numpy().astype(np.int64)
            at = np.searchsorted(keys, n * width + r, side="right") - 1
            more = [pa.array(first[at] + r - rank[at]), pa.array(offset[at])]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + more, names + ["sequence_id", "offset"])

    return numbered.mapInArrow(place, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """Token arrays of the sequences, from pieces packed with their ids: at most the capacity per group."""
    return packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p")).select(
        "sequence_id", F.flatten(F.col("p.ids")).alias("ids"))


def query(spark, sf_dir: str) -> DataFrame:
    return pack(keep(pieces(table(spark, sf_dir, "documents")), "pieces"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences."""
    return pack(keep(pieces(docs), "pieces"))
