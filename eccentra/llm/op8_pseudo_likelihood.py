"""Masked pseudo-likelihood by a bidirectional window network.

Every token is predicted from ``SIDE`` tokens before and after it: their
embeddings are summed per place, squashed and mapped to a softmax in two levels: over
groups of ``GROUP`` classes of the vocabulary, and over the classes of the token's group, so
that a token costs no exponentials of other groups. The summed log-probabilities of a document's tokens, each given
both its sides, are its score; the mean makes lengths comparable.

The vocabulary is made of word hashes counted over all documents. All of them and
their counts are a Spark table, which grows with the corpus. The most frequent have
a class of their own: ``OWN`` for every doubling of the number of tokens,
``FREQUENT`` at least. All others share ``HASHED`` classes by hash, and a token of
such a class adds the logarithm of its word's share of the class:
(count - 1/2) / (count of the class). A word never seen is taken as one seen
once; the half counts held back are the share of as many unseen words as the class
has kinds. The counts of the most frequent words, ``LISTED`` at most, are sent to the tasks,
the others are joined.

The network is trained in numpy where the documents
are: in each round every task runs over its documents' training places (one in
``EVERY`` of every document, other ones in each round, so that the rounds together
take every token of the corpus once) from the same weights, and the weights are averaged by
their number of places. Counts and weights are summed by Spark; the driver holds
the listed words and one set of weights only.

Null and empty texts have no tokens: sum 0 and null mean. The ends of a text are
padded. Copies are scored alike and train as often as they occur. Null ids are
ids like others. An empty table gives an empty result, and a corpus without words
a network as it was drawn. Texts are taken whole, long ones in pieces that know
their neighbours. Extra columns are ignored.
"""

from __future__ import annotations

from math import isfinite
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from eccentra.llm.common import U64, by_value, keep, mix, table, text_chunks, word_hashes

by_value(__name__)

FREQUENT, HASHED, SIDE, WIDTH, HIDDEN = 320, 64, 2, 12, 16
OWN, LISTED = 16, 1 << 16
ROUNDS, RATE, BATCH = 2, 0.5, 256
#: Classes of a group, and places scored at once.
GROUP, SCORED = 128, 4096
EVERY = ROUNDS
#: Exponentials are tried as they are first.
BEYOND = {"over": "ignore", "divide": "ignore", "invalid": "ignore"}
CLASSES = FREQUENT + HASHED


class Vocabulary(NamedTuple):
    """``words`` is sorted, ``order`` has their classes. ``listed`` is sorted, ``halved`` has their counts less 1/2; ``totals`` are the
    counts of the shared classes. ``own`` is the number of own classes, ``counted`` the table (word, n) of all words."""

    words: np.ndarray
    order: np.ndarray
    listed: np.ndarray
    halved: np.ndarray
    totals: np.ndarray
    own: int
    counted: DataFrame | None


def own_classes(tokens: int) -> int:
    """Number of words with a class of their own among so many tokens."""
    return max(FREQUENT, int(OWN * np.log2(max(tokens, 1))))


def start_weights(seed: int = 7, classes: int = CLASSES) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    return {"embed": rng.normal(0, 0.1, (classes + 1, WIDTH)).astype(np.float32),
            "inner": rng.normal(0, 0.3, (2 * SIDE * WIDTH, HIDDEN)).astype(np.float32), "bias": np.zeros(HIDDEN, dtype=np.float32),
            "outer": rng.normal(0, 0.1, (HIDDEN, classes)).astype(np.float32), "base": np.zeros(classes, dtype=np.float32),
            "top": rng.normal(0, 0.1, (HIDDEN, -(-classes // GROUP))).astype(np.float32), "head": np.zeros(-(-classes // GROUP), dtype=np.float32)}


def flat(weights: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([weights[k].ravel() for k in sorted(weights)])


def shaped(values: np.ndarray, classes: int = CLASSES) -> dict[str, np.ndarray]:
    out, at, like = {}, 0, start_weights(classes=classes)
    for k in sorted(like):
        out[k] = values[at: at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def hashed_class(words: np.ndarray) -> np.ndarray:
    """Shared class of every word hash, from 0."""
    return (mix(words ^ U64(3)) % U64(HASHED)).astype(np.int64)


def found(words: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in the sorted ``among``, whether it is there) for every word hash."""
    if not len(among):
        return np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=bool)
    at = np.minimum(np.searchsorted(among, words), len(among) - 1)
    return at, among[at] == words


def classes_of(words: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """Class of every word hash: first the own classes, then the shared ones."""
    out = vocabulary.own + hashed_class(words)
    at, known = found(words, vocabulary.words)
    out[known] = vocabulary.order[at[known]]
    return out


def laid_out(tokens: np.ndarray, borders: np.ndarray, pad: int = CLASSES) -> tuple[np.ndarray, np.ndarray]:
    """The texts' classes with ``SIDE`` times ``pad`` between them, and every token's place there."""
    at = np.arange(len(tokens)) + np.repeat(np.arange(1, len(borders)) * SIDE, np.diff(borders))
    laid = np.full(len(tokens) + SIDE * len(borders), pad, dtype=np.int64)
    laid[at] = tokens
    return laid, at


def near_of(laid: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The ``2 * SIDE`` neighbours of the tokens at these places of the layout."""
    return laid[at[:, None] + np.array([s for s in range(-SIDE, SIDE + 1) if s])]


def hidden(w: dict, around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(inputs, hidden values)."""
    x = w["embed"].take(around, axis=0).reshape(len(around), around.shape[1] * WIDTH)
    h = x @ w["inner"]
    h += w["bias"]
    return x, np.tanh(h, out=h)


def normed(z: np.ndarray) -> np.ndarray:
    """Log-softmax of every row, in place."""
    z -= z.max(axis=1, keepdims=True)
    z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
    return z


def forward(w: dict, around: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(inputs, hidden, log-probabilities of all classes)."""
    x, h = hidden(w, around)
    groups = normed(h @ w["top"] + w["head"])
    z = h @ w["outer"] + w["base"]
    for g in range(groups.shape[1]):
        z[:, g * GROUP: (g + 1) * GROUP] = normed(z[:, g * GROUP: (g + 1) * GROUP]) + groups[:, g: g + 1]
    return x, h, z


def exponentials(z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | float]:
    """(exponentials of every row, their sum, its reciprocal, what was taken off the row before): the greatest value where plain
    exponentials leave the range of numbers, and nothing elsewhere."""
    ones = np.ones(z.shape[1], dtype=z.dtype)
    e = np.exp(z)
    total = e @ ones
    inverse = 1 / total
    if isfinite(total @ total + inverse @ inverse):
        return e, total, inverse, 0.0
    top = z.max(axis=1)
    e = np.exp(z - top[:, None])
    total = e @ ones
    return e, total, 1 / total, top


def by_group(target: np.ndarray, batch: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[int]]]:
    """Order of the targets by batch and group, their groups and places in a matrix of their group's classes in that order, and
    the groups' borders within each batch."""
    batches, groups = -(-len(target) // batch), int(target.max()) // GROUP + 1
    key = np.arange(len(target)) // batch * groups + target // GROUP
    order = np.argsort(key.astype(np.int16) if batches * groups < 1 << 15 else key, kind="stable")  # so few bits are sorted by counting
    counts = np.bincount(key, minlength=batches * groups)
    key = key[order]
    before = np.cumsum(counts) - counts
    places = (np.arange(len(target)) - before[key]) * GROUP + target[order] % GROUP
    ends = counts.reshape(batches, groups).cumsum(axis=1)
    return order, key % groups, places, [[0, *row] for row in ends.tolist()]


def own_logits(w: dict, h: np.ndarray, g: int) -> np.ndarray:
    """Logits of the classes of a group."""
    z = h @ w["outer"][:, g * GROUP: (g + 1) * GROUP]
    z += w["base"][g * GROUP: (g + 1) * GROUP]
    return z


def at_places(z: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Places of a matrix ``GROUP`` wide in one that may be narrower, as it is of the last group."""
    return places if z.shape[1] == GROUP else places // GROUP * z.shape[1] + places % GROUP


def chosen(w: dict, around: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log-probability of every target: that of its group, and its own among the group's classes alone."""
    if not len(target):
        return np.empty(0, dtype=w["top"].dtype)
    order, group, places, (borders,) = by_group(target, len(target))
    _, h = hidden(w, around.take(order, axis=0))
    z, out = h @ w["top"] + w["head"], np.empty(len(target), dtype=h.dtype)
    with np.errstate(**BEYOND):
        _, total, _, off = exponentials(z)
        logs = z[np.arange(len(z)), group] - off - np.log(total)
        for g, (a, b) in enumerate(zip(borders, borders[1:])):
            if a < b:
                z = own_logits(w, h[a:b], g)
                _, total, _, off = exponentials(z)
                logs[a:b] += z.ravel()[at_places(z, places[a:b])] - off - np.log(total)
    out[order] = logs
    return out


def steps(w: dict, around: np.ndarray, target: np.ndarray, rate: float, batch: int) -> None:
    """One gradient step on every batch of so many places, in place; what does not need the weights is done for all batches at once."""
    order, group, places, borders = by_group(target, batch)
    around, kinds = around.take(order, axis=0), w["top"].shape[1]
    group = np.arange(len(group)) % batch * kinds + group
    cells = np.arange(w["embed"].size).reshape(w["embed"].shape)
    with np.errstate(**BEYOND):
        for k, ends in enumerate(borders):
            lo = k * batch
            near, n = around[lo: lo + batch], ends[-1]
            x, h = hidden(w, near)
            # exponentials less their sum at the target are the gradients by the logits, but for a factor by row; it goes to the smaller side
            e, total, inverse, _ = exponentials(h @ w["top"] + w["head"])
            inverse *= rate / n
            e.reshape(-1)[group[lo: lo + n]] -= total
            e *= inverse[:, None]
            back = e @ w["top"].T
            w["top"] -= h.T @ e
            w["head"] -= e.sum(axis=0)
            for g, (a, b) in enumerate(zip(ends, ends[1:])):
                if a < b:
                    own, mine = w["outer"][:, g * GROUP: (g + 1) * GROUP], h[a:b]
                    e, total, inverse, _ = exponentials(own_logits(w, mine, g))
                    inverse *= rate / n
                    e.reshape(-1)[at_places(e, places[lo + a: lo + b])] -= total
                    part = e @ own.T
                    part *= inverse[:, None]
                    back[a:b] += part
                    own -= (mine * inverse[:, None]).T @ e
                    w["base"][g * GROUP: (g + 1) * GROUP] -= inverse @ e
            h *= h
            back -= back * h
            inputs = back @ w["inner"].T
            w["inner"] -= x.T @ back
            w["bias"] -= back.sum(axis=0)
            w["embed"] -= np.bincount(cells.take(near.ravel(), axis=0).ravel(), inputs.ravel(), cells.size).reshape(cells.shape)


def step(w: dict, around: np.ndarray, target: np.ndarray, rate: float) -> None:
    """One gradient step on a batch, in place."""
    steps(w, around, target, rate, len(target))


def own_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def vocabulary_of(docs: DataFrame) -> Vocabulary:
    """All words of all documents, counted; the most frequent ones at hand."""
    def run(batches):
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch):
                words, _ = word_hashes(data, offsets)
                word, n = np.unique(words, return_counts=True)
                if len(word):
                    yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(hashed_class(word)), pa.array(n)], ["word", "shared", "n"])

    counted = keep(docs.select("text").mapInArrow(run, "word long, shared long, n long").groupBy("word", "shared").agg(F.sum("n").alias("n")), "counted")
    # kinds and tokens by shared class and by eighths of a doubling of the count
    step_ = F.floor(8 * F.log2("n")).alias("step")
    sizes = counted.groupBy("shared", step_).agg(F.count("*").alias("kinds"), F.sum("n").alias("n")).collect()
    totals, kinds = np.zeros(HASHED), {}
    for r in sizes:
        totals[r["shared"]] += r["n"]
        kinds[r["step"]] = kinds.get(r["step"], 0) + r["kinds"]
    own = own_classes(int(totals.sum()))
    top = counted.orderBy(F.desc("n"), "word").limit(own).collect()  # so many rows at most
    words = np.array([r["word"] for r in top], dtype=np.int64).view(np.uint64)
    for r in top:
        totals[r["shared"]] -= r["n"]
    least, room = np.inf, LISTED
    for k in sorted(kinds, reverse=True):
        room -= kinds[k]
        if room < 0:
            break
        least = k
    listed, halved = np.zeros(0, dtype=np.uint64), np.zeros(0)
    if least < np.inf:
        rows = counted.filter(F.floor(8 * F.log2("n")) >= F.lit(int(least))).select("word", "n").toArrow()  # LISTED rows at most
        listed, halved = rows.column("word").to_numpy().view(np.uint64), rows.column("n").to_numpy() - 0.5
    order, by = np.argsort(words), np.argsort(listed)
    return Vocabulary(words[order], order, listed[by], halved[by], totals, own, counted.select("word", F.col("n").alias("count")))


def training_places(words: np.ndarray, borders: np.ndarray, turn: int) -> np.ndarray:
    """Places trained in a round: one in ``EVERY`` of each document from a phase that moves on by round, so that ``EVERY`` rounds take each place once."""
    lengths = np.diff(borders)
    start = np.repeat(borders[:-1], lengths)
    phase = (mix(words[start]) + U64(turn)) % U64(EVERY)
    return np.flatnonzero((np.arange(len(words)) - start) % EVERY == phase.astype(np.int64))


def train(docs: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """Weights after so many rounds of local steps and averaging."""
    spark = docs.sparkSession
    classes = vocabulary.own + HASHED
    weights = flat(start_weights(classes=classes))
    for turn in range(rounds):
        sent = spark.sparkContext.broadcast((weights, (*vocabulary[:-1], None)))

        def run(batches):
            values, voc = sent.value[0], Vocabulary(*sent.value[1])
            w, seen, held = shaped(values, classes), 0, []

            def learn(least: int):
                nonlocal held, seen
                if not held or sum(len(t) for _, t in held) < least:
                    return
                near, target = np.concatenate([a for a, _ in held]), np.concatenate([t for _, t in held])
                steps(w, near, target, RATE, BATCH)
                seen, held = seen + len(target), []

            for batch in batches:
                for _, _, data, offsets in text_chunks(batch):
                    words, borders = word_hashes(data, offsets)
                    tokens = classes_of(words, voc)
                    places = training_places(words, borders, turn)
                    if len(places):
                        laid, at = laid_out(tokens, borders, classes)
                        held.append((near_of(laid, at[places]), tokens[places]))
                    learn(8 * BATCH)
            learn(1)
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values) + 1, dtype=np.int32)), pa.array(np.append(flat(w).astype(np.float64) * seen, float(seen)))], ["i", "v"])

        summed = docs.select("text").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()  # a row per weight
        if not summed.num_rows:  # no places in this round
            continue
        total = np.zeros(len(weights) + 1)
        total[summed.column("i").to_numpy()] = summed.column("v").to_numpy()
        weights = (total[:-1] / total[-1]).astype(np.float32)
    return shaped(weights, classes)


def scores(docs: DataFrame, weights: dict[str, np.ndarray], vocabulary: Vocabulary, block: int = SCORED) -> DataFrame:
    """(doc_id, n_tokens, log_probability, mean_log_probability)."""
    sent = docs.sparkSession.sparkContext.broadcast((weights, (*vocabulary[:-1], None)))

    def run(batches):
        w, voc = sent.value[0], Vocabulary(*sent.value[1])
        pad, share = voc.own + HASHED, np.log(np.maximum(voc.totals, 1))
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch):
                words, borders = word_hashes(data, offsets)
                tokens = classes_of(words, voc)
                each = np.empty(len(tokens))
                laid, at = laid_out(tokens, borders, pad)
                for a in range(0, len(tokens), block):
                    each[a: a + block] = chosen(w, near_of(laid, at[a: a + block]), tokens[a: a + block])
                # the word within its class: here if it is listed, or else as a row for the join
                inner = np.flatnonzero(tokens >= voc.own)
                at, known = found(words[inner], voc.listed)
                each[inner] -= share[tokens[inner] - voc.own]
                each[inner[known]] += np.log(voc.halved[at[known]])
                rare = inner[~known]
                doc = np.searchsorted(borders, rare, side="right") - 1
                by = np.lexsort((words[rare], doc))
                word, doc = words[rare][by], doc[by]
                new = np.flatnonzero(np.append(True, (word[1:] != word[:-1]) | (doc[1:] != doc[:-1]))[: len(word)])
                total = np.diff(np.concatenate([[0.0], np.cumsum(each)])[borders])
                rows = row + np.arange(hi - lo)
                row += hi - lo
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows), pa.array(mix(rows.astype(np.uint64)).view(np.int64)), pa.nulls(hi - lo, pa.int64()), batch.slice(lo, hi - lo).column("doc_id"),
                     pa.array(np.diff(borders).astype(np.int64)), pa.array(total)], names)
                if len(new):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rows[doc[new]]), pa.array(word[new].view(np.int64)), pa.array(np.diff(np.append(new, len(word)))), pa.nulls(len(new), pa.int64()),
                         pa.nulls(len(new), pa.int64()), pa.nulls(len(new), pa.float64())], names)

    names = ["row", "word", "n", "doc_id", "n_tokens", "sum"]
    # a row per document, dealt by its number, and one per document and word that is not listed
    parts = docs.mapInArrow(run, "row long, word long, n long, doc_id long, n_tokens long, sum double").join(vocabulary.counted, "word", "left")
    total = F.sum(F.coalesce("sum", F.col("n") * F.log(F.coalesce("count", F.lit(1)) - 0.5)))
    return (parts.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), total.alias("log_probability"))
            .select("doc_id", "n_tokens", "log_probability", F.when(F.col("n_tokens") > 0, F.col("log_probability") / F.col("n_tokens")).alias("mean_log_probability")))


def query(spark, sf_dir: str) -> DataFrame:
    docs = own_texts(table(spark, sf_dir, "documents"))
    vocabulary = vocabulary_of(docs)
    return scores(docs, train(docs, vocabulary), vocabulary)
