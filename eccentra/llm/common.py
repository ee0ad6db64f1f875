"""Helpers shared by the operators of this subpackage.

Texts reach Python as Arrow batches. They are handled as bytes in chunks of
about a megabyte, so that memory depends on the longest single text only. Work with some twenty
arrays of eight bytes per byte (rolling hashes) is done in smaller segments.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

from eccentra.session import scratch_path


def by_value(module: str) -> None:
    """Functions of ``module`` travel to the executors by value."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


by_value(__name__)

SEGMENT, CHUNK = 1 << 17, 1 << 20
U64 = np.uint64


#: Bytes that go to Python at once: Spark's default, and what takes its place. A step's last rows are written by whoever
#: asked for them, so this stays set in the session; a session that names a limit of its own keeps it.
BYTES_CONF, BYTES_DEFAULT, BYTES_MOST = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "2m"


def small_batches(spark: SparkSession) -> None:
    if spark.conf.get(BYTES_CONF) == BYTES_DEFAULT:
        spark.conf.set(BYTES_CONF, BYTES_MOST)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of texts that go to Python at once, unless the session asks for fewer.
BATCH_CONF, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: the lineage ends here.

    Batches for Python are small meanwhile, as rows may hold whole texts.
    """
    spark = df.sparkSession
    small_batches(spark)
    path, rows = scratch_path(spark, label), int(spark.conf.get(BATCH_CONF))
    spark.conf.set(BATCH_CONF, str(min(rows, BATCH_ROWS) if rows > 0 else BATCH_ROWS))
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(BATCH_CONF, str(rows))
    out = spark.read.schema(df.schema).parquet(path)
    out._kept = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete kept tables whose readers have all been written themselves."""
    for t in tables:
        at = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._kept)
        at.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def fresh(spark: SparkSession, label: str) -> str:
    return scratch_path(spark, f"{label}-{uuid.uuid4().hex[:8]}")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (three xor-shift-multiply rounds)."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def randoms(n: int, seed: int) -> np.ndarray:
    return mix(mix(np.arange(1, n + 1, dtype=np.uint64) + U64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)))


def byte_values(seed: int, lower: bool) -> np.ndarray:
    """A random odd 64-bit number per byte value, A-Z folded on request."""
    t = randoms(256, seed) | U64(1)
    if lower:
        t[65:91] = t[97:123]
    return t


class Rolling:
    """Polynomial hashes of any substring of a byte array, modulo 2**64."""

    def __init__(self, seed: int, lower: bool = False):
        self.values = byte_values(seed, lower)
        self.base = int(randoms(1, seed + 101)[0]) | 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.power = np.ones(1, dtype=np.uint64)
        self.inv = np.ones(1, dtype=np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.power) <= n:
            size = max(n + 1, 2 * len(self.power))
            step = np.full(size, self.base, dtype=np.uint64)
            step[0] = 1
            self.power = np.multiply.accumulate(step)
            step = np.full(size, self.inverse, dtype=np.uint64)
            step[0] = 1
            self.inv = np.multiply.accumulate(step)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self._grow(len(data))
        out = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.values[data] * self.power[: len(data)], out=out[1:])
        return out

    def of(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (prefix[end] - prefix[start]) * self.inv[start]


SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_WORDS: list[Rolling] = []


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of several texts, A-Z lower-cased.

    ``data`` holds the texts' bytes one after the other, ``offsets`` their
    borders. Returns the hashes and the borders of the texts among them. A
    word is a maximal run of bytes other than 0x20 and 0x09-0x0D.
    """
    if not _WORDS:
        _WORDS.append(Rolling(11, lower=True))
    hasher, n = _WORDS[0], len(data)
    inside = ~SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    border = offsets[offsets < n]
    first[border] = inside[border]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    back = offsets[(offsets > 0)] - 1
    last[back] = inside[back]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    out, i = [], 0
    while i < len(start):
        # one segment of whole words at a time; a longer single word is its own segment
        j = max(int(np.searchsorted(end, start[i] + SEGMENT, side="right")), i + 1)
        lo, hi = int(start[i]), int(end[j - 1])
        prefix = hasher.prefix(data[lo:hi])
        out.append(mix(hasher.of(prefix, start[i:j] - lo, end[i:j] - lo) ^ (end[i:j] - start[i:j]).astype(np.uint64)))
        i = j
    hashes = np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)
    return hashes, np.searchsorted(start, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text and the borders among them.

    A text with fewer words than ``width`` but one at least has its whole
    sequence as the one shingle; a text without words has none.
    """
    words, at = word_hashes(data, offsets)
    count = np.diff(at)
    k = randoms(width + 1, 5) | U64(1)
    doc = np.repeat(np.arange(len(count)), count)
    if len(words) >= width:
        sh = np.zeros(len(words) - width + 1, dtype=np.uint64)
        for i in range(width):
            sh += words[i: len(words) - width + 1 + i] * k[i]
        whole = doc[: len(sh)] == doc[width - 1:]
        sh, owner = sh[whole], doc[: len(sh)][whole]
    else:
        sh, owner = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        extra = np.array([np.append(words[at[d]: at[d + 1]] * k[: count[d]], k[width: width + 1] * U64(count[d])).sum() for d in short], dtype=np.uint64)
        sh, owner = np.concatenate([sh, extra]), np.concatenate([owner, short])
    sh = mix(sh)
    order = np.lexsort((sh, owner))
    sh, owner = sh[order], owner[order]
    if len(sh):
        new = np.ones(len(sh), dtype=bool)
        new[1:] = (sh[1:] != sh[:-1]) | (owner[1:] != owner[:-1])
        sh, owner = sh[new], owner[new]
    return sh, np.searchsorted(owner, np.arange(len(count) + 1))


def text_chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, borders) of pieces of a batch with about ``limit`` bytes; null: empty."""
    col = batch.column(column)
    n = len(col)
    if not n:
        return
    if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type):
        kind = np.int64
    else:
        kind = np.int32
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    _, offs, values = col.buffers()
    offsets = np.frombuffer(offs, dtype=kind, count=n + 1 + col.offset)[col.offset:].astype(np.int64)
    data = np.frombuffer(values, dtype=np.uint8) if values is not None and values.size else np.zeros(0, dtype=np.uint8)
    i = 0
    while i < n:
        j = max(int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1, i + 1)
        j = min(j, n)
        yield i, j, data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i]
        i = j


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``links``: the least node it is connected with.

    Rounds of "each node and its neighbours move to the least label around",
    then pointer jumping, until nothing changes; written after each round.
    """
    edges = keep(links.select(F.col(a).alias("u"), F.col(b).alias("v"))
                 .union(links.select(F.col(b).alias("u"), F.col(a).alias("v"))).distinct(), "edges")
    labels = keep(edges.groupBy(F.col("u").alias("node")).agg(F.least(F.col("node"), F.min("v")).alias("root")), "labels")
    while True:
        around = edges.join(labels, edges.v == labels.node).groupBy("u").agg(F.min("root").alias("seen"))
        moved = (labels.join(around, labels.node == around.u)
                 .select("node", "root", F.least("root", "seen").alias("next")))
        # a root that sees a smaller label takes its whole tree along
        hooks = moved.filter("next < root").groupBy(F.col("root").alias("old")).agg(F.min("next").alias("hook"))
        tree = moved.join(hooks, moved.root == hooks.old, "left").select(
            "node", "root", F.coalesce(F.least("next", "hook"), F.col("next")).alias("next"))
        up = tree.select(F.col("node").alias("p"), F.col("next").alias("above"))
        jumped = keep(tree.join(up, tree.next == up.p, "left").select(
            "node", F.least("next", F.coalesce("above", "next")).alias("root"), F.col("root").alias("was")), "labels")
        if jumped.filter("root < was").isEmpty():
            discard(edges, labels)
            return jumped.select("node", "root")
        discard(labels)
        labels = jumped


def content_filter(keys: DataFrame, key: str, bits: int = 1 << 26, second: bool = True) -> np.ndarray:
    """A membership filter of fixed size over the longs in ``keys``, as an array of words.

    Two positions per key are set, or without ``second`` its own only. The filter is built by an aggregation and
    holds ``bits / 8`` bytes whatever the input; when it fills up it lets more
    rows pass and the join behind it does the rest.
    """
    words = bits // 64
    h = F.col(key)
    pos = F.array(F.pmod(h, F.lit(bits)), *[F.pmod(F.xxhash64(h), F.lit(bits))] * second)
    rows = (keys.select(F.explode(pos).alias("p"))
            .groupBy(F.expr("p div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(p, 64) as int))")).alias("v"))
            .toArrow())
    out = np.zeros(words, dtype=np.int64)
    out[rows.column("w").to_numpy()] = rows.column("v").to_numpy()
    return out.view(np.uint64)


def passes(df: DataFrame, key: str, filled: np.ndarray) -> DataFrame:
    """Rows of ``df`` whose long ``key`` may be in the filter, each task's repeats of a key included once only.

    Needs column ``key`` and a column ``_second`` equal to ``xxhash64(key)``.
    """
    sent = df.sparkSession.sparkContext.broadcast(filled)
    bits = U64(len(filled) * 64)

    def run(batches):
        words = sent.value
        seen: set[int] = set()
        for batch in batches:
            one = batch.column(key).to_numpy(zero_copy_only=False)
            two = batch.column("_second").to_numpy(zero_copy_only=False)
            good = np.ones(len(one), dtype=bool)
            for h in (one, two):
                p = np.mod(h.astype(np.int64), np.int64(bits)).astype(np.uint64)
                good &= ((words[(p >> U64(6)).astype(np.int64)] >> (p & U64(63))) & U64(1)) == 1
            for i in np.flatnonzero(good):
                k = int(one[i])
                if k in seen:
                    good[i] = False
                elif len(seen) < 1_000_000:
                    seen.add(k)
            if good.any():
                yield batch.filter(pa.array(good))

    return df.mapInArrow(run, df.schema)
