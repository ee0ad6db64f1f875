"""Phrase collocations from count streams kept in prefix and suffix order.

Phrases of one to ``LONGEST`` words are counted order by order: a phrase can only
occur ``LEAST`` times if both phrases one word shorter do, so texts give rows for
those phrases alone whose parts may be frequent (by a filter of fixed size; when it fills up,
more rows are shuffled and counts are the same). What is frequent of all orders
together is one *count stream*. A key is the language's hash and the words'
hashes one after the other, so that in the order of keys a phrase comes right
after all its prefixes. The stream is kept in two orders:

* *suffix order* (words reversed): a scan holds the last phrase of every order
  and so meets a phrase together with the counts of all its suffixes; it
  also carries the last word's spelling along, and every phrase tells the one
  without its first word how frequent this extension is;
* *prefix order*: the same for the prefixes, whose carried last words spell the phrase.

Both are lockstep merges of the orders' streams, range-partitioned and sorted;
nothing is looked up by hash. Ranges are cut at keys of a fixed sample (it balances
tasks only); the phrases that a cut's key extends, three per
cut, are sent on to the task behind the cut as well. So the phrases of a
frequent first word may span any number of tasks, and a task holds a batch.

Words are runs without blank or tab inside pieces cut at ``[.,;:!?]`` and 0x0A-0x0D,
A-Z lower-cased, and are told apart by 64-bit hashes; spellings of frequent words
are counted as such. Null texts are empty, a null language is ``und``. Repeated
rows count as often as they occur, null ids play no part. Texts are taken whole.
Extra columns are ignored; without frequent phrases the result is empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from eccentra.llm.common import SEGMENT, U64, Rolling, by_value, content_filter, discard, keep, mix, randoms, table, text_chunks
from eccentra.llm.op9_suffix_dedup import in_filter

by_value(__name__)

LEAST, LONGEST, TOP = 30, 4, 2000
#: Share of a phrase's occurrences inside one longer phrase, in hundredths, from which it is dropped.
INSIDE = 80
#: Bytes of text taken at once, phrases counted before they are passed on, and rows passed on at once.
CHUNK, HELD, SENT = 1 << 20, 1 << 18, 1 << 16
#: Keys drawn per range when ranges are cut.
DRAWN = 32
#: Parts of a language that are ranked by themselves first.
SALT = 64

_WORD: list[Rolling] = []
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
PIECE = np.zeros(256, dtype=bool)
PIECE[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
BREAK = PIECE.copy()
BREAK[[0x20, 9]] = True


def words_of(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, text, whether the next word follows in the same piece) of the words of several texts."""
    if not _WORD:
        _WORD.append(Rolling(71, lower=True))
    hasher, inside = _WORD[0], ~BREAK[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    heads = borders[borders < len(data)]
    first[heads] = inside[heads]
    tails = borders[borders > 0] - 1
    last[tails] = inside[tails]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    text = np.searchsorted(borders, start, side="right") - 1
    cuts = np.zeros(len(data) + 1, dtype=np.int32)
    np.cumsum(PIECE[data], out=cuts[1:])
    follows = np.zeros(len(start), dtype=bool)
    follows[:-1] = (cuts[start[1:]] == cuts[start[:-1]]) & (text[1:] == text[:-1])
    hashes, i = np.empty(len(start), dtype=np.uint64), 0
    while i < len(start):
        j = max(int(np.searchsorted(end, start[i] + SEGMENT, side="right")), i + 1)
        lo, hi = int(start[i]), int(end[j - 1])
        prefix = hasher.prefix(data[lo:hi])
        hashes[i:j] = mix(hasher.of(prefix, start[i:j] - lo, end[i:j] - lo) ^ (end[i:j] - start[i:j]).astype(np.uint64))
        i = j
    return hashes, start, end, text, follows


def joined(keys: np.ndarray, words: np.ndarray, place: int) -> np.ndarray:
    """Hash of phrases from those of their first words and one word more."""
    return mix(keys * (randoms(LONGEST + 1, 72)[place] | U64(1)) + words)


def spelled(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The lower-cased words at these places."""
    size = end - start
    to = np.zeros(len(size) + 1, dtype=np.int32)
    np.cumsum(size, out=to[1:])
    at = np.repeat(start - to[:-1], size) + np.arange(to[-1])
    return pa.Array.from_buffers(pa.string(), len(size), [None, pa.py_buffer(to), pa.py_buffer(FOLD[data[at]])])


def texts_of(docs: DataFrame) -> DataFrame:
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    return docs.select("text", lang.alias("lang"), F.xxhash64(lang).alias("tongue"))


def counted_words(texts: DataFrame) -> DataFrame:
    """(lang, word, tongue, hash, c): all words with their counts, and per language a row without a word: the number of all."""

    def run(batches):
        for batch in batches:
            tongues = batch.column("tongue").to_numpy().view(np.uint64)
            for lo, _, data, borders in text_chunks(batch, limit=CHUNK):
                hashes, start, end, text, _ = words_of(data, borders)
                if not len(hashes):
                    continue
                key = mix(tongues[text + lo] * U64(3) + hashes)
                _, at, n = np.unique(key, return_index=True, return_counts=True)
                langs = batch.column("lang").take(pa.array(text[at] + lo))
                yield pa.RecordBatch.from_arrays([langs, spelled(data, start[at], end[at]), pa.array(tongues[text[at] + lo].view(np.int64)), pa.array(hashes[at].view(np.int64)), pa.array(n)], names)
                per, head, rows = np.unique(tongues[text + lo], return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([batch.column("lang").take(pa.array(text[head] + lo)), pa.nulls(len(per), pa.string()), pa.array(per.view(np.int64)), pa.nulls(len(per), pa.int64()), pa.array(rows)], names)

    names = ["lang", "word", "tongue", "hash", "c"]
    rows = texts.mapInArrow(run, "lang string, word string, tongue long, hash long, c long")
    return rows.groupBy("lang", "word").agg(F.max("tongue").alias("tongue"), F.max("hash").alias("hash"), F.sum("c").alias("c"))


def packed(parts: np.ndarray) -> pa.Array:
    """One binary key per row of longs, in their order as unsigned numbers."""
    n, width = parts.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, 8 * width * (n + 1), 8 * width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(parts, dtype=np.uint64).astype(">u8"))])


def counted_phrases(texts: DataFrame, order: int, shorter: np.ndarray) -> DataFrame:
    """(key, c): phrases of ``order`` words whose two phrases one word shorter may be in the filter ``shorter``."""
    sent = texts.sparkSession.sparkContext.broadcast(shorter)

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out():
            key, parts = np.concatenate([h for h, _ in held]), np.concatenate([p for _, p in held])
            held.clear()
            by = np.argsort(key)
            parts = parts[by]
            new = np.append(True, (parts[1:] != parts[:-1]).any(axis=1))
            at = np.flatnonzero(new)
            n = np.diff(np.append(at, len(parts)))
            for lo in range(0, len(at), SENT):
                yield pa.RecordBatch.from_arrays([packed(parts[at[lo: lo + SENT]]), pa.array(n[lo: lo + SENT])], ["key", "c"])

        for batch in batches:
            tongues = batch.column("tongue").to_numpy().view(np.uint64)
            for lo, _, data, borders in text_chunks(batch, limit=CHUNK):
                words, _, _, text, follows = words_of(data, borders)
                n = len(words) - order + 1
                if n <= 0:
                    continue
                tongue = tongues[text + lo]
                key = joined(tongue, words, 0)
                for k in range(1, order - 1):
                    key = joined(key[:-1], words[k:], k)
                # key: phrases of order - 1 words from every place
                good = in_filter(key.view(np.int64), mix(key).view(np.int64), sent.value)
                whole = good[:n] & good[1:n + 1]
                for k in range(order - 1):
                    whole &= follows[k: n + k]
                at = np.flatnonzero(whole)
                if len(at):
                    held.append((joined(key[at], words[at + order - 1], order - 1), np.stack([tongue[at]] + [words[at + k] for k in range(order)], axis=1)))
                if sum(len(h) for h, _ in held) >= HELD:
                    yield from out()
        if held:
            yield from out()

    return texts.mapInArrow(run, "key binary, c long").groupBy("key").agg(F.sum("c").alias("c"))


def parts_of(keys: pa.Array, width: int = LONGEST + 1) -> np.ndarray:
    """Binary keys as rows of longs, zeros behind shorter ones."""
    keys = keys.cast(pa.binary())
    n = len(keys)
    _, offs, values = keys.buffers()
    offsets = np.frombuffer(offs, dtype=np.int32, count=n + 1 + keys.offset)[keys.offset:]
    flat = np.frombuffer(values, dtype=np.uint8)[offsets[0]: offsets[-1]].view(">u8").astype(np.uint64) if n else np.zeros(0, dtype=np.uint64)
    size = np.diff(offsets) // 8
    out = np.zeros((n, width), dtype=np.uint64)
    row = np.repeat(np.arange(n), size)
    out[row, np.arange(len(flat)) - np.repeat((offsets[:-1] - offsets[0]) // 8, size)] = flat
    return out


def phrase_filter(frequent: DataFrame) -> np.ndarray:
    """A filter over the phrases (key) by the hash that ``counted_phrases`` gives them."""

    def run(batches):
        for batch in batches:
            parts, n = parts_of(batch.column("key")), (pc.binary_length(batch.column("key")).to_numpy() // 8)
            h = parts[:, 0]
            for k in range(LONGEST):
                h = np.where(n > k + 1, joined(h, parts[:, k + 1], k), h)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([h, mix(h)]).view(np.int64))], ["h"])

    return content_filter(frequent.select("key").mapInArrow(run, "h long"), "h", second=False)


def turned(parts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The words of every key in the opposite order."""
    out = parts.copy()
    for order in range(2, LONGEST + 1):
        rows = np.flatnonzero(n == order)
        out[rows, 1: order + 1] = parts[rows, order:0:-1]
    return out


def packed_each(parts: np.ndarray, n: np.ndarray) -> pa.Array:
    """Keys of n words each."""
    offsets = np.zeros(len(n) + 1, dtype=np.int32)
    np.cumsum(8 * (n + 1), out=offsets[1:])
    inside = np.arange(parts.shape[1])[None, :] <= n[:, None]
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(parts[inside].astype(">u8"))])


def ranges(stream: DataFrame, ways: int) -> list[bytes]:
    """At most ``ways`` - 1 keys that cut the stream into about equal ranges: quantiles of the ``DRAWN * ways`` keys of least hash."""
    drawn = sorted(bytes(r["key"]) for r in stream.select("key").orderBy(F.xxhash64("key"), "key").limit(DRAWN * ways).collect())
    return sorted(set(drawn[DRAWN::DRAWN]))


def in_order(stream: DataFrame, ways: int) -> DataFrame:
    """The stream dealt by ranges of keys and sorted, with ``ghost`` copies of the phrases that a range's first key extends."""
    cuts = ranges(stream, ways)
    sent_on: dict[bytes, list[int]] = {}
    for part, key in enumerate(cuts, 1):
        for size in range(16, len(key), 8):
            sent_on.setdefault(key[:size], []).append(part)
    wide = 8 * (LONGEST + 1)
    edges, shared = np.array(cuts, dtype=f"S{wide}"), np.array(sorted(sent_on), dtype=f"S{wide}")

    def run(batches):
        for batch in batches:
            keys = batch.column("key").to_pylist()
            padded = np.array(keys, dtype=f"S{wide}")
            part = np.searchsorted(edges, padded, side="right") if len(edges) else np.zeros(len(keys), dtype=np.int64)
            yield batch.append_column("part", pa.array(part.astype(np.int32))).append_column("ghost", pa.array(np.zeros(len(keys), dtype=bool)))
            rows, to = [], []
            for r in np.flatnonzero(np.isin(padded, shared)).tolist():
                for p in sent_on.get(keys[r], ()):
                    rows.append(r)
                    to.append(p)
            if rows:
                yield batch.take(pa.array(rows)).append_column("part", pa.array(to, pa.int32())).append_column("ghost", pa.array([True] * len(rows)))

    laid = stream.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stream.schema) + ", part int, ghost boolean")
    return laid.repartition(ways, "part").sortWithinPartitions("part", "key")


def merged(batches, use):
    """Lockstep over sorted batches: ``use(table, parts, n, before)`` for each batch with the phrases still open before it.

    ``before[m]`` is, for every row, the row of its first m words, or -1 where the phrase is not longer.
    """
    open_rows = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if open_rows is not None:
            rows = pa.concat_tables([open_rows, rows])
        rows = rows.combine_chunks()
        key = rows.column("key").combine_chunks()
        parts, n = parts_of(key), rows.column("n").to_numpy().astype(np.int64)
        here, before = np.arange(len(n)), {}
        for m in range(1, LONGEST):
            at = np.maximum.accumulate(np.where(n == m, here, -1))
            same = (parts[at, : m + 1] == parts[:, : m + 1]).all(axis=1)
            before[m] = np.where((n > m) & (at >= 0) & same, at, -1)
        yield from use(rows, parts, n, before)
        # the last row and what it extends stay open
        left = [int(before[m][-1]) for m in range(1, LONGEST) if before[m][-1] >= 0] + [len(n) - 1]
        open_rows = rows.take(pa.array(left))
        at = open_rows.schema.get_field_index("ghost")
        open_rows = open_rows.set_column(at, "ghost", pa.array([True] * len(left)))


def best_extension(c: np.ndarray, n: np.ndarray, before: dict[int, np.ndarray]) -> np.ndarray:
    """For every row the largest count among the rows one word longer that it is the beginning of, 0 without."""
    out = np.zeros(len(c), dtype=np.int64)
    for m in range(1, LONGEST):
        longer = np.flatnonzero((n == m + 1) & (before[m] >= 0))
        np.maximum.at(out, before[m][longer], c[longer])
    return out


STREAM = "key binary, n int, c long, lang string, last string"
TURNED = STREAM + ", s1 long, s2 long, s3 long, ext long"
SPELLED = "key binary, n int, c long, lang string, phrase string, p1 long, p2 long, p3 long, s1 long, s2 long, s3 long, ext long"


def counts_before(c: np.ndarray, before: dict[int, np.ndarray]) -> list[pa.Array]:
    return [pa.array(c[before[m]], mask=before[m] < 0) for m in range(1, LONGEST)]


def with_suffixes(stream: DataFrame, ways: int) -> DataFrame:
    """``stream`` (words reversed) turned into prefix order, with the counts of all suffixes, the last word and the best extension to the left.

    Rows without a count hold a part of an extension's maximum only.
    """

    def use(rows, parts, n, before):
        c = rows.column("c").to_numpy()
        ext, ghost = best_extension(c, n, before), rows.column("ghost").to_numpy(zero_copy_only=False)
        root = np.where(before[1] >= 0, before[1], np.arange(len(n)))  # the row of the last word alone
        keys = packed_each(turned(parts, n), n)
        columns = [keys, rows.column("n"), pa.array(c, mask=ghost), rows.column("lang").take(pa.array(root)), rows.column("last").take(pa.array(root)), *counts_before(c, before), pa.array(ext)]
        out = pa.table(columns, names=[f.split()[0] for f in TURNED.split(", ")])
        yield from out.filter(pa.array(~ghost | (ext > 0))).combine_chunks().to_batches()

    return in_order(stream, ways).mapInArrow(lambda batches: merged(batches, use), TURNED)


def with_prefixes(stream: DataFrame, ways: int) -> DataFrame:
    """``stream`` with the counts of all prefixes, the phrase and the best extension to either side; words alone are left out."""
    names = [f.split()[0] for f in SPELLED.split(", ")]

    def use(rows, parts, n, before):
        c = rows.column("c").to_numpy()
        ext = np.maximum(best_extension(c, n, before), rows.column("ext").to_numpy())
        ghost = rows.column("ghost").to_numpy(zero_copy_only=False)
        last = rows.column("last").combine_chunks()
        phrase = last
        for m in range(LONGEST - 1, 0, -1):
            head = last.take(pa.array(before[m], mask=before[m] < 0))
            phrase = pc.if_else(pc.is_valid(head), pc.binary_join_element_wise(head, phrase, " "), phrase)
        columns = [rows.column("key"), rows.column("n"), pa.array(c, mask=ghost), rows.column("lang"), phrase, *counts_before(c, before), *[rows.column(f"s{m}") for m in range(1, LONGEST)], pa.array(ext)]
        out = pa.table(columns, names=names)
        yield from out.filter(pa.array((n > 1) & (~ghost | (ext > 0)))).combine_chunks().to_batches()

    return in_order(stream, ways).mapInArrow(lambda batches: merged(batches, use), SPELLED)


def collocations(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, a, l, r, score, ext) of every phrase of 2 to ``LONGEST`` words with ``least`` occurrences, and (lang, n).

    ``ext`` is the count of the most frequent phrase one word longer that holds the phrase.
    """
    spark = docs.sparkSession
    ways = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    texts = texts_of(docs)
    words = keep(counted_words(texts).filter((F.col("c") >= least) | F.col("word").isNull()), "words")

    def big(column: str):
        return F.unhex(F.lpad(F.hex(column), 16, "0"))

    none = F.lit(None).cast("string")
    orders = [keep(words.filter(F.col("word").isNotNull()).select(F.concat(big("tongue"), big("hash")).alias("key"), F.lit(1).alias("n"), "c", "lang", F.col("word").alias("last")), "order-1")]
    for order in range(2, LONGEST + 1):
        found = counted_phrases(texts, order, phrase_filter(orders[-1])).filter(F.col("c") >= least)
        orders.append(keep(found.select("key", F.lit(order).alias("n"), "c", none.alias("lang"), none.alias("last")), f"order-{order}"))
        if orders[-1].isEmpty():
            break

    def reversed_keys(batches):
        for batch in batches:
            n = batch.column("n").to_numpy().astype(np.int64)
            yield pa.RecordBatch.from_arrays([packed_each(turned(parts_of(batch.column("key")), n), n)] + batch.columns[1:], batch.schema.names)

    stream = orders[0]
    for more in orders[1:]:
        stream = stream.unionByName(more)
    backward = keep(stream.mapInArrow(reversed_keys, STREAM), "suffix-order")
    turned_ = keep(with_suffixes(backward, ways), "prefix-order")
    # rows without a count hold parts of maxima: those of the open phrases at cuts and between batches
    held = turned_.filter(F.col("c").isNotNull())
    both = keep(with_prefixes(held, ways), "spelled")
    longer = (both.select("key", "ext").unionByName(turned_.filter(F.col("c").isNull() & (F.col("n") > 1)).select("key", "ext"))
              .groupBy("key").agg(F.max("ext").alias("ext")))

    def cut(left: str, right: str):
        twice = F.expr(f"cast(2000000 as decimal(10,0)) * cast(c as decimal(19,0)) div (cast({left} as decimal(19,0)) + cast({right} as decimal(19,0)))")
        return lambda k: F.struct(twice.alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r"))

    cuts = F.array(cut("p1", "s1")(1))
    for n in range(3, LONGEST + 1):
        cuts = F.when(F.col("n") == n, F.array(*[cut(f"p{k}", f"s{n - k}")(k) for k in range(1, n)])).otherwise(cuts)
    out = (both.filter(F.col("c").isNotNull()).withColumn("cut", F.array_min(cuts)).drop("ext").join(longer.hint("merge"), "key")
           .select("lang", "phrase", F.col("n").alias("words"), F.col("c").alias("a"), "cut.l", "cut.r", "cut.score", "ext"))
    discard(*orders, backward)
    return out, words.filter(F.col("word").isNull()).select("lang", F.col("c").alias("n"))


def best(found: DataFrame, totals: DataFrame, top: int = TOP) -> DataFrame:
    """Each language's first ``top`` phrases that are not mostly part of a longer one.

    Ranked in parts first, so that no task sees more than ``SALT * top`` rows of a language.
    """
    own = found.filter(F.expr(f"100 * cast(ext as decimal(19,0)) < {INSIDE} * cast(a as decimal(19,0))"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(SALT))
    some = own.withColumn("part", part).withColumn("rank", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = some.drop("part").withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return best(*collocations(table(spark, sf_dir, "documents").select("text", "lang")))


ORACLE = rf"""with pieces as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
worded as (select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') as w from pieces),
grams as (select lang, m.m, unnest([array_to_string(w[i + 1:i + m.m], ' ') for i in range(len(w) - m.m + 1)]) as phrase from worded, (values (1), (2), (3), (4)) m(m) where len(w) >= m.m),
f as materialized (select lang, m, phrase, count(*) as a from grams group by all having count(*) >= {LEAST}),
total as (select lang, count(*) as n from grams where m = 1 group by lang),
c as (select *, string_split(phrase, ' ') as w from f where m > 1),
cut as (select c.lang, c.phrase, c.m, c.a, k.k, array_to_string(w[1:k.k], ' ') as x, array_to_string(w[k.k + 1:c.m], ' ') as y from c, (values (1), (2), (3)) k(k) where k.k < c.m),
scored as (select cut.lang, cut.phrase, cut.m, cut.a, k, p.a as l, s.a as r, cast(2000000 * cast(cut.a as hugeint) // (p.a + s.a) as bigint) as score
  from cut join f p on p.lang = cut.lang and p.phrase = x join f s on s.lang = cut.lang and s.phrase = y),
low as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
parts as (select c.lang, c.a, array_to_string(w[i:i + n - 1], ' ') as sub from c, (values (1), (2), (3)) i(i), (values (2), (3)) n(n) where i + n - 1 <= m and n < m),
inside as (select distinct f.lang, f.phrase from parts join f on f.lang = parts.lang and f.phrase = sub where 100 * parts.a >= {INSIDE} * f.a)
select low.lang, row_number() over (partition by low.lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
from low join total using (lang) where not exists (select 1 from inside i where i.lang = low.lang and i.phrase = low.phrase) qualify rank <= {TOP}"""
