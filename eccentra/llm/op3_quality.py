"""Quality by nearest-neighbour voting among latent-semantic vectors.

Terms of a document are hashed words, shapes of words (length, case, kinds of
characters) and signs of repetition (a word like the one, two or three before
it, words and lines seen before in the text). Their relative frequencies, square
rooted and weighted by inverse document frequency, make a term vector; a
truncated singular value decomposition of the labelled sample's vectors
projects it to ``RANK`` latent dimensions. The sample is at most ``SAMPLE``
labelled rows, drawn by hash of their id: its vectors are the only thing that is
broadcast, a few megabytes whatever the input. Every document is compared with
all of them by exact cosine products, block by block, and the ``NEIGHBOURS``
nearest vote with weight similarity ** ``SHARPNESS``.

Terms are counted over whole texts. A row labelled more than once counts by its
mean label. Labels without a document, null labels and ids are left out. Null
and empty texts have no terms: their score is the sample's share of label 1, as
is that of a text whose vector is zero. Without labels every score is 0.5.
Repeated rows have equal scores; ties among neighbours at the edge go to the
lesser hash of id. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from eccentra.llm.common import SEGMENT, SPACE, U64, by_value, table, text_chunks, word_hashes

by_value(__name__)

#: Bounds and settings of the classifier.
SAMPLE, RANK, NEIGHBOURS, SHARPNESS = 4096, 48, 25, 8.0
WORDS, SHAPES = 256, 256
SIGNS = 12
TERMS = WORDS + SHAPES + SIGNS

KINDS = np.full(256, 5, dtype=np.int64)  # 0 upper, 1 lower, 2 digit, 3 punctuation, 4 other ASCII signs, 5 beyond ASCII
KINDS[:128] = 4
KINDS[65:91], KINDS[97:123], KINDS[48:58] = 0, 1, 2
for _c in ".,;:!?'\"()-":
    KINDS[ord(_c)] = 3


def repeats_before(values: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Whether an equal value with an equal owner comes earlier."""
    order = np.lexsort((np.arange(len(values)), values, owner))
    v, o = values[order], owner[order]
    again = np.zeros(len(values), dtype=bool)
    again[order[1:]] = (v[1:] == v[:-1]) & (o[1:] == o[:-1])
    return again


def term_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Relative term frequencies of several texts, one row each."""
    n = len(offsets) - 1
    out = np.zeros((n, TERMS), dtype=np.float32)
    words, at = word_hashes(data, offsets)
    if not len(words):
        return out
    doc = np.repeat(np.arange(n), np.diff(at))
    # borders of the words again, for the kinds of their characters
    inside = ~SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    border = offsets[offsets < len(data)]
    first[border] = inside[border]
    back = offsets[offsets > 0] - 1
    last[back] = inside[back]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    kind = KINDS[data]
    some = np.zeros((len(start), 6), dtype=np.int64)
    for k in range(6):
        c = np.concatenate([[0], np.cumsum(kind == k)])
        some[:, k] = c[end] - c[start]
    length = end - start
    size = np.minimum(np.searchsorted([2, 4, 7, 11, 16, 30], length, side="left"), 6)
    shape = size + 8 * ((some[:, 0] > 0) + (some[:, 0] > 1)) + 24 * (some[:, 2] > 0) + 48 * np.minimum(some[:, 4], 2) + 144 * (some[:, 3] > 1)
    shape = np.minimum(shape, SHAPES - 1)

    def add(rows, cols, weight=None):
        flat = np.bincount(rows * TERMS + cols, weights=weight, minlength=n * TERMS)
        out.ravel()[:] += flat.astype(np.float32)

    add(doc, (words >> U64(40)).astype(np.int64) % WORDS)
    add(doc, WORDS + shape)
    base = WORDS + SHAPES
    for k in (1, 2, 3):
        same = np.flatnonzero((words[k:] == words[:-k]) & (doc[k:] == doc[:-k]))
        add(doc[same + k], np.full(len(same), base + k - 1))
    again = np.flatnonzero(repeats_before(words, doc))
    add(doc[again], np.full(len(again), base + 3))
    # runs of equal shape and single signs standing as words
    alone = np.flatnonzero((some[:, 1] == 0) & (some[:, 0] == 0) & (some[:, 5] == 0))
    add(doc[alone], np.full(len(alone), base + 4))
    upper = np.flatnonzero((some[:, 0] > 1) & (some[:, 1] == 0))
    add(doc[upper], np.full(len(upper), base + 5))
    signs = np.flatnonzero(some[:, 4] > 0)
    add(doc[signs], np.full(len(signs), base + 6))
    # lines seen before, counted by their words
    breaks = np.concatenate([[0], np.cumsum(data == 10)])[start] + doc
    edge = np.ones(len(start), dtype=bool)
    edge[1:] = (breaks[1:] != breaks[:-1]) | (doc[1:] != doc[:-1])
    head = np.flatnonzero(edge)
    line = np.add.reduceat(words * (np.arange(len(words), dtype=np.uint64) - np.repeat(head, np.diff(np.append(head, len(words)))).astype(np.uint64) + U64(1)), head)
    rep = repeats_before(line, doc[head])
    long = np.diff(np.append(head, len(words)))
    add(doc[head[rep]], np.full(int(rep.sum()), base + 7), long[rep].astype(np.float64))
    count = np.maximum(np.diff(at), 1)[:, None]
    out /= count
    return np.sqrt(out)


class Model:
    """Weights, projection and the sample's latent vectors with their labels."""

    def __init__(self, vectors: np.ndarray, labels: np.ndarray, rank: int = RANK):
        seen = (vectors > 0).sum(axis=0)
        self.weight = np.log((1 + len(vectors)) / (1 + seen)).astype(np.float32) + 1
        self.weight[WORDS + SHAPES:] *= 2  # signs of repetition are few among many words
        x = self._unit(vectors * self.weight)
        gram = x.T.astype(np.float64) @ x.astype(np.float64)
        values, axes = np.linalg.eigh(gram)  # right singular vectors, largest last
        keep_ = axes[:, ::-1][:, :rank]
        self.axes = np.ascontiguousarray(keep_).astype(np.float32)
        self.points = self._unit(x @ self.axes)
        self.labels = labels.astype(np.float32)
        self.prior = float(labels.mean()) if len(labels) else 0.5

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return (x / np.where(norm > 0, norm, 1)).astype(np.float32)

    def score(self, vectors: np.ndarray, neighbours: int = NEIGHBOURS, sharpness: float = SHARPNESS, block: int = 512) -> np.ndarray:
        out = np.full(len(vectors), self.prior)
        if not len(self.labels):
            return out
        k = min(neighbours, len(self.labels))
        for lo in range(0, len(vectors), block):
            x = self._unit(self._unit(vectors[lo: lo + block] * self.weight) @ self.axes)
            cos = x @ self.points.T
            near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
            w = np.maximum(np.take_along_axis(cos, near, axis=1), 0.0).astype(np.float64) ** sharpness
            total = w.sum(axis=1)
            vote = (w * self.labels[near]).sum(axis=1)
            out[lo: lo + block] = np.where(total > 0, vote / np.where(total > 0, total, 1), self.prior)
        return out


def is_held_out(id_col: str = "doc_id"):
    """The rows from which no label is learned; rows without id are none of them, and have no label either."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from documents (doc_id, text) and labels (doc_id, label)."""
    known = labels.filter("doc_id is not null and label is not null").groupBy("doc_id").agg(F.avg("label").alias("label"))
    drawn = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # the sample's bound: so many rows at most

    def vectors(batches):
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch):
                part = batch.slice(lo, hi - lo)
                x = [v.tobytes() for v in term_counts(data, offsets)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array(x)], ["doc_id", "label", "x"])

    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(drawn), "doc_id").select("doc_id", "label", "text")
            .mapInArrow(vectors, "doc_id long, label double, x binary").groupBy("doc_id").agg(F.first("label").alias("label"), F.min("x").alias("x")))
    got = rows.orderBy(F.xxhash64("doc_id"), "doc_id").toArrow()
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), dtype=np.float32).reshape(-1, TERMS)
    return Model(x, np.round(got.column("label").to_numpy()))


def scored(docs: DataFrame, model: Model, text_col: str = "text", name: str = "_score") -> DataFrame:
    """``docs`` with the score in a further column, which takes the place of one so named."""
    docs = docs.drop(name)
    sent = docs.sparkSession.sparkContext.broadcast(vars(model))  # plain arrays: the class itself travels with the function
    names = docs.columns

    def run(batches):
        own = Model.__new__(Model)
        own.__dict__.update(sent.value)
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch, text_col, SEGMENT):
                score = own.score(term_counts(data, offsets))
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, pa.array(score)], [*names, name])

    from pyspark.sql.types import DoubleType, StructType

    return docs.mapInArrow(run, StructType(list(docs.schema.fields)).add(name, DoubleType()))


def trained(spark, sf_dir: str, docs: DataFrame) -> Model:
    labels = table(spark, sf_dir, "labels").filter(~is_held_out()).select("doc_id", F.col("quality").alias("label"))
    return fit(docs, labels)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, trained(spark, sf_dir, docs))
    return out.select("doc_id", is_held_out().alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return scored(docs, trained(spark, sf_dir, docs)).filter("_score >= 0.5").drop("_score")
