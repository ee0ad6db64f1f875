"""Removal of repeated byte strings by sorted suffix buckets with cover-sample ranks.

Every byte covered by a string of ``LENGTH`` bytes that starts twice goes. The
suffixes in question are the windows of ``LENGTH`` bytes. As in difference-cover
construction,

* a *cover sample* of positions is ranked beforehand. The cover is content
  aligned (the least hashed gram of ``GRAM`` bytes of each window), so equal
  windows have their sample position at the same place; a cover by residues
  would hold six times as many positions. The windows that share a sample
  position form a run; the run's rank stands for all its bytes.
* suffixes fall into *buckets* by the gram at their sample position. Buckets
  are range-partitioned and sorted, by rank within and by place within a rank, and
  worked on one after the other as the sorted rows go by: a row is only ever set
  against the one before it. A bucket, or a rank of it, may span any number of
  tasks; what meets at the borders of tasks, two rows each, is settled in a small table.
* *long ties* are resolved by the ranks: neighbours of equal rank are equal in all
  their windows and no byte of them is compared again. A bucket with one rank
  is done, a bucket seen once drops out.
* what is left, windows of different ranks in one bucket, is sorted likewise, first by
  the hash of a block of ``BLOCK`` bytes on a grid that hangs on the sample
  position, then, where neighbouring blocks tie, by the hash of the whole window.

The order is that of hashes and not of letters: only equal strings need to lie
side by side. Ranks and ties are 64-bit hashes within 64-bit buckets. Texts are keyed by
their content (two 64-bit hashes), so repeated rows, equal texts and null ids
need no care; null text counts as empty, texts shorter than ``LENGTH`` never
match. A text that occurs twice repeats as a whole: its copies are counted, one
copy per task is looked at, and equal rows beside each other count once.
Long texts are worked on in segments. Extra columns are ignored by the query and kept by ``trimmed``;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from eccentra.llm.common import SEGMENT, U64, Rolling, by_value, content_filter, discard, keep, mix, table, text_chunks

by_value(__name__)

LENGTH, GRAM, BLOCK = 200, 32, 160
STEP = LENGTH - BLOCK
MASK = U64((1 << 24) - 1)


def least_positions(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    n = len(keys)
    pad = -n % width
    full = np.concatenate([keys, np.full(pad, np.iinfo(np.uint64).max, dtype=np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    back = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1: n])


def runs_of(data: np.ndarray, offsets: np.ndarray, gram: Rolling, whole: Rolling):
    """(text, first window, windows, sample offset in the first window, bucket, rank) of the runs of several texts."""
    size = np.diff(offsets)
    out = [[np.zeros(0, dtype=np.int64)] * 4 + [np.zeros(0, dtype=np.uint64)] * 2]
    for lo in range(0, len(data), SEGMENT):
        part = data[lo: lo + SEGMENT + LENGTH - 1]
        if len(part) < LENGTH:
            continue
        prefix = gram.prefix(part)
        grams = mix((prefix[GRAM:] - prefix[:-GRAM]) * gram.inv[: len(part) - GRAM + 1])
        at = (least_positions((grams & ~MASK) | np.arange(len(grams), dtype=np.uint64), LENGTH - GRAM + 1) & MASK).astype(np.int64)
        # windows that lie within one text
        first = offsets[:-1][size >= LENGTH] - lo
        stop = offsets[1:][size >= LENGTH] - lo - LENGTH + 1
        mark = np.zeros(len(at) + 1, dtype=np.int64)
        np.add.at(mark, np.clip(first, 0, len(at)), 1)
        np.add.at(mark, np.clip(stop, 0, len(at)), -1)
        inside = np.cumsum(mark[:-1]) > 0
        new = inside.copy()
        new[1:] &= ~inside[:-1] | (at[1:] != at[:-1])
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | (at[1:] != at[:-1])
        start, end = np.flatnonzero(new), np.flatnonzero(ends)
        context = whole.prefix(part)
        rank = mix(whole.of(context, start, end + LENGTH) ^ (end - start).astype(np.uint64))
        text = np.searchsorted(offsets, start + lo, side="right") - 1
        out.append([text, start + lo - offsets[text], end - start + 1, at[start] - start, grams[at[start]], rank])
    return [np.concatenate(c) for c in zip(*out)]


RUN = "k1 long, k2 long, i long, n int, d int, bucket long, rank long"


def keyed(docs: DataFrame, text_col: str = "text") -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(text.alias("text"), F.xxhash64(text).alias("k1"), F.xxhash64(text, F.lit(1)).alias("k2"))


def in_filter(values: np.ndarray, second: np.ndarray, words: np.ndarray) -> np.ndarray:
    good = np.ones(len(values), dtype=bool)
    for h in (values, second):
        p = np.mod(h, np.int64(len(words) * 64)).astype(np.uint64)
        good &= ((words[(p >> U64(6)).astype(np.int64)] >> (p & U64(63))) & U64(1)) == 1
    return good


def unseen(batch: pa.RecordBatch, seen: set[int], among: np.ndarray | None = None) -> np.ndarray:
    """Rows ``among`` the batch's whose text the task did not meet before (beyond so many texts it forgets, and copies are only more work)."""
    k1, k2 = (batch.column(c).to_numpy() for c in ("k1", "k2"))
    good = np.ones(len(k1), dtype=bool) if among is None else among.copy()
    for r in np.flatnonzero(good):
        k = int(k1[r]) << 64 | (int(k2[r]) & 0xFFFFFFFFFFFFFFFF)
        if k in seen:
            good[r] = False
        elif len(seen) < 500_000:
            seen.add(k)
    return good


def runs(texts: DataFrame, filled: np.ndarray | None = None) -> DataFrame:
    """Runs of all texts, of copies in a task one; with a filter of buckets only those that may be in it.

    The filter's two places are those of the bucket itself and of its mixed value.
    """
    sent = None if filled is None else texts.sparkSession.sparkContext.broadcast(filled)

    def run(batches):
        gram, whole, seen = Rolling(41), Rolling(42), set()
        for batch in batches:
            batch = batch.filter(pa.array(unseen(batch, seen)))
            k1, k2 = (batch.column(c).to_numpy() for c in ("k1", "k2"))
            for lo, _, data, offsets in text_chunks(batch, limit=SEGMENT):
                text, i, n, d, bucket, rank = runs_of(data, offsets, gram, whole)
                if sent is not None and len(text):
                    good = in_filter(bucket.view(np.int64), mix(bucket).view(np.int64), sent.value)
                    text, i, n, d, bucket, rank = (x[good] for x in (text, i, n, d, bucket, rank))
                if len(text):
                    yield pa.RecordBatch.from_arrays([pa.array(k1[text + lo]), pa.array(k2[text + lo]), pa.array(i), pa.array(n.astype(np.int32)), pa.array(d.astype(np.int32)),
                                                      pa.array(bucket.view(np.int64)), pa.array(rank.view(np.int64))], ["k1", "k2", "i", "n", "d", "bucket", "rank"])

    return texts.select("text", "k1", "k2").mapInArrow(run, RUN)


def bucket_filter(buckets: DataFrame) -> np.ndarray:
    def both(batches):
        for batch in batches:
            b = batch.column("bucket").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([b, mix(b.view(np.uint64)).view(np.int64)]))], ["bucket"])

    return content_filter(buckets.select("bucket").mapInArrow(both, "bucket long"), "bucket", second=False)


def text_filter(keys: DataFrame) -> np.ndarray:
    return content_filter(keys.select("k1").union(keys.select(F.col("k2").alias("k1"))), "k1", second=False)


def some_texts(texts: DataFrame, filled: np.ndarray, inside: bool = True, once: bool = False) -> DataFrame:
    """Rows whose text may be in the filter (or surely is not); with ``once``, a task gives each text once."""
    sent = texts.sparkSession.sparkContext.broadcast(filled)

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            k1, k2 = (batch.column(c).to_numpy() for c in ("k1", "k2"))
            good = in_filter(k1, k2, sent.value) == inside
            if once:
                good = unseen(batch, seen, good)
            if good.any():
                yield batch.filter(pa.array(good))

    return texts.mapInArrow(run, texts.schema)


def hashed_parts(rows: DataFrame, windows: bool) -> DataFrame:
    """Blocks (or windows) of the runs listed with their text.

    ``rows`` has k1, k2, text and ``runs``, an array of structs of i, n, d,
    bucket and c, with ``windows`` also ``j``: the block whose windows are asked.
    """
    schema = "bucket long, hash long, k1 long, k2 long, i long, n int, d int, c long, j int"

    def run(batches):
        whole = Rolling(42)
        for batch in batches:
            k1, k2 = (batch.column(c).to_numpy() for c in ("k1", "k2"))
            lists = batch.column("runs")
            for lo, hi, data, offsets in text_chunks(batch, limit=SEGMENT):
                part = lists.slice(lo, hi - lo)
                counts = np.diff(part.offsets.to_numpy())
                flat = part.flatten()
                text = np.repeat(np.arange(hi - lo), counts)
                col = {c: flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ["i", "n", "d", "bucket", "c"] + ["j"] * windows}
                # blocks j = 0, 1, ..: those of the windows whose sample offset is in [STEP j, STEP (j + 1))
                low, high = (col["d"] - col["n"] + 1) // STEP, col["d"] // STEP
                if windows:
                    top = np.minimum(col["d"], (col["j"] + 1) * STEP - 1)
                    bottom = np.maximum(col["d"] - col["n"] + 1, col["j"] * STEP)
                    times = top - bottom + 1
                else:
                    times = high - low + 1
                row = np.repeat(np.arange(len(text)), times)
                step = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                if windows:
                    offset = top[row] - step
                    start = offsets[text[row]] + col["i"][row] + col["d"][row] - offset
                    length, j = LENGTH, col["j"][row]
                else:
                    j = low[row] + step
                    start = offsets[text[row]] + col["i"][row] + col["d"][row] - j * STEP
                    length = BLOCK
                hashes = np.empty(len(row), dtype=np.uint64)
                for seg in range(0, len(data), SEGMENT):
                    own = np.flatnonzero((start >= seg) & (start < seg + SEGMENT))
                    if len(own):
                        prefix = whole.prefix(data[seg: seg + SEGMENT + LENGTH])
                        at = start[own] - seg
                        hashes[own] = whole.of(prefix, at, at + length)
                hashes = mix(hashes ^ (offset if windows else j).astype(np.uint64))
                first = start - offsets[text[row]] if windows else col["i"][row]
                if len(row):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(col["bucket"][row]), pa.array(hashes.view(np.int64)), pa.array(k1[text[row] + lo]), pa.array(k2[text[row] + lo]), pa.array(first),
                         pa.array((np.ones(len(row)) if windows else col["n"][row]).astype(np.int32)), pa.array(col["d"][row].astype(np.int32)), pa.array(col["c"][row]), pa.array(j.astype(np.int32))],
                        ["bucket", "hash", "k1", "k2", "i", "n", "d", "c", "j"])

    return rows.select("k1", "k2", "text", "runs").mapInArrow(run, schema)


def changes(rows: pa.Table, columns: list[str]) -> np.ndarray:
    """Whether each row differs from the one before it in any of the columns; true for the first."""
    out = np.zeros(rows.num_rows, dtype=bool)
    out[:1] = True
    for c in columns:
        values = rows.column(c).to_numpy()
        out[1:] |= values[1:] != values[:-1]
    return out


def beside(rows: DataFrame, bucket: str, tie: str, place: list[str], keep_columns: list[str]) -> DataFrame:
    """Rows sorted by (bucket, tie, place) with what their neighbours say; equal rows count once.

    ``again``: a neighbour has the same bucket and tie. ``pick``: the row stands for its tie in a bucket of several ties.
    ``border``: the first or the last row of a task, which may have neighbours in the task beside; it is picked in any case.
    """
    order = [bucket, tie, *place]
    laid = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in keep_columns) + ", again boolean, pick boolean, border boolean"

    def run(batches):
        held, same, led, first = None, False, False, True  # the last row, and whether its tie had one before it in the task, and in the bucket

        def out(t, again, pick, border):
            return pa.Table.from_arrays([t.column(c) for c in keep_columns] + [pa.array(x) for x in (again, pick, border)], names=[*keep_columns, "again", "pick", "border"]).combine_chunks().to_batches()

        for batch in batches:
            t = pa.Table.from_batches([batch])
            if held is not None:
                t = pa.concat_tables([held, t])
            t = t.filter(pa.array(changes(t, order)))  # equal rows
            n = t.num_rows
            if not n:
                continue
            new_tie, new_bucket = changes(t, [bucket, tie]), changes(t, [bucket])
            start = np.flatnonzero(new_tie)
            # whether the tie of a row follows another one of its bucket
            after = ~new_bucket[start]
            if held is not None:
                new_tie[0], after[0] = not same, led
            after = np.repeat(after, np.diff(np.append(start, n)))
            again, pick = ~new_tie, new_tie & after
            again[:-1] |= ~new_tie[1:]
            pick[:-1] |= new_tie[1:] & ~new_bucket[1:] & ~after[:-1]
            border = np.zeros(n, dtype=bool)
            border[0] = first
            pick |= border
            if n > 1:
                yield from out(t.slice(0, n - 1), again[:-1], pick[:-1], border[:-1])
                first = False
            held, same, led = t.slice(n - 1), bool(not new_tie[-1]), bool(after[-1])
        if held is not None:
            yield from out(held, np.array([same]), np.array([True]), np.array([True]))

    return laid.mapInArrow(run, schema)


def settled(marked: DataFrame, bucket: str, tie: str, place: list[str]) -> DataFrame:
    """Rows of ``beside`` that have a neighbour of the same bucket and tie in their own task or across a border."""
    border = marked.filter("border")  # two rows per task
    met = border.groupBy(bucket, tie).agg(F.countDistinct(*place).alias("_m")).filter("_m > 1").select(bucket, tie)
    return marked.filter("again").unionByName(border.filter("not again").join(met, [bucket, tie], "left_semi").select(*marked.columns))


def repeated(texts: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(k1, k2, i, n) and the tables behind them: runs of windows that start more than once, per distinct text; texts as ``keyed``."""
    buckets = keep(runs(texts).groupBy("bucket").agg(F.count("*").alias("seen")).filter("seen > 1").select("bucket"), "buckets")
    shared = keep(runs(texts, bucket_filter(buckets)), "shared")
    where = ["k1", "k2", "i"]
    ranked = keep(beside(shared, "bucket", "rank", where, ["bucket", "rank", *where, "n", "d"]).filter("again or pick"), "ranked")
    discard(buckets, shared)
    copies = texts.groupBy("k1", "k2").agg(F.count("*").alias("seen"), F.max(F.octet_length("text")).alias("size")).filter(f"seen > 1 and size >= {LENGTH}")
    spans = (settled(ranked, "bucket", "rank", where).select(*where, "n")
             .unionByName(copies.select("k1", "k2", F.lit(0).cast("long").alias("i"), (F.col("size") - LENGTH + 1).cast("int").alias("n"))))

    # windows of different ranks in a bucket, by blocks first
    c = F.when(F.col("again"), F.lit(2)).otherwise(F.lit(1)).cast("long").alias("c")
    listed = ranked.filter("pick").groupBy("k1", "k2").agg(F.collect_list(F.struct("i", "n", "d", "bucket", c)).alias("runs"))
    own = some_texts(texts, text_filter(ranked.filter("pick")), once=True).groupBy("k1", "k2").agg(F.first("text").alias("text"))
    base = keep(own.join(listed, ["k1", "k2"]), "texts")
    blocks = keep(hashed_parts(base, windows=False), "blocks")
    tied = keep(beside(blocks, "bucket", "hash", [*where, "j"], ["bucket", "hash", *where, "n", "d", "c", "j"]).filter("again or border"), "tied")
    discard(blocks)
    asked = settled(tied, "bucket", "hash", [*where, "j"]).groupBy("k1", "k2").agg(F.collect_list(F.struct("i", "n", "d", "bucket", "c", "j")).alias("runs"))
    windows = keep(hashed_parts(base.drop("runs").join(asked, ["k1", "k2"]), windows=True).select("bucket", "hash", *where, "n", "c"), "windows")
    discard(base, tied)
    same = keep(beside(windows, "bucket", "hash", where, ["bucket", "hash", *where, "n", "c"]).filter("again or border"), "same")
    discard(windows)
    # a run whose rank is repeated is listed as a whole already
    found = spans.unionByName(settled(same, "bucket", "hash", where).filter("c = 1").select(*where, "n"))
    return found, [ranked, same]


def spans_by_text(texts: DataFrame) -> DataFrame:
    """(k1, k2, spans): an array of (i, n) per distinct text that has repeated windows."""
    found, behind = repeated(texts)
    out = keep(found.groupBy("k1", "k2").agg(F.collect_list(F.struct("i", "n")).alias("spans")), "spans")
    discard(*behind)
    return out


def covered(spans: np.ndarray) -> np.ndarray:
    """Disjoint byte ranges (start, end) covered by windows i .. i + n - 1, from rows (i, n)."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    start, end = spans[:, 0], np.maximum.accumulate(spans[:, 0] + spans[:, 1] - 1 + LENGTH)
    new = np.ones(len(start), dtype=bool)
    new[1:] = start[1:] > end[:-1]
    first = np.flatnonzero(new)
    return np.stack([start[first], end[np.append(first[1:] - 1, len(start) - 1)]], axis=1)


def kept_bytes(data: bytes, ranges: np.ndarray) -> bytes:
    out, at = [], 0
    for a, b in ranges.tolist():
        out.append(data[at:a])
        at = b
    out.append(data[at:])
    return b"".join(out)


def kept_text(data: bytes, ranges: np.ndarray) -> str:
    """As ``kept_bytes``, but a character is removed only if all its bytes are."""
    out, at = [], 0
    for a, b in ranges.tolist():
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        out.append(data[at:a])
        at = b
    out.append(data[at:])
    return b"".join(out).decode("utf-8", "replace")


ADDED = ("_bytes", "_removed", "_spans", "_kept", "_text")


def trimmed(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``_bytes``, ``_removed``, ``_spans``, ``_kept`` (remaining bytes) and ``_text`` (whole characters
    kept); columns so named are replaced."""
    docs = docs.drop(*ADDED)
    spans = spans_by_text(keyed(docs, text_col))
    text = F.coalesce(F.col(text_col), F.lit(""))
    marked = docs.select(F.struct("*").alias("row"), F.xxhash64(text).alias("k1"), F.xxhash64(text, F.lit(1)).alias("k2"))
    # texts that surely have no repeated string pass beside the join
    filled = text_filter(spans)
    rest, hit = some_texts(marked, filled, inside=False), some_texts(marked, filled)
    zero, own = F.lit(0).cast("long"), F.coalesce(F.col("row")[text_col], F.lit(""))
    rest = rest.select("row", F.octet_length(own).cast("long").alias("_bytes"), zero.alias("_removed"), zero.alias("_spans"), own.cast("binary").alias("_kept"), own.alias("_text"))
    joined = hit.join(spans, ["k1", "k2"], "left").select("row", "spans")

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows = []
                lists = part.column("spans")
                for r, t in enumerate(pc.struct_field(part.column("row"), text_col).to_pylist()):
                    data = (t or "").encode()
                    own = lists[r].values if lists[r].is_valid else None
                    if own is None:
                        rows.append((len(data), 0, 0, data, t or ""))
                        continue
                    ranges = covered(np.stack([own.field("i").to_numpy(), own.field("n").to_numpy().astype(np.int64)], axis=1))
                    rows.append((len(data), int((ranges[:, 1] - ranges[:, 0]).sum()), len(ranges), kept_bytes(data, ranges), kept_text(data, ranges)))
                kinds = [pa.int64()] * 3 + [pa.binary(), pa.string()]
                yield pa.RecordBatch.from_arrays([part.column("row")] + [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["row", *ADDED])

    return joined.mapInArrow(run, rest.schema).unionByName(rest).select("row.*", *ADDED)


def query(spark, sf_dir: str) -> DataFrame:
    out = trimmed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_bytes").alias("n_bytes"), F.col("_removed").alias("n_removed"), F.col("_spans").alias("n_spans"), F.sha2("_kept", 256).alias("kept_sha256"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated strings; null texts stay null, texts that repeat as a whole become empty. ``n_chars`` follows."""
    own = docs.select("doc_id", "text", "lang", "source")
    out = trimmed(own)
    text = F.when(F.col("text").isNotNull(), F.col("_text"))
    return out.select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))
