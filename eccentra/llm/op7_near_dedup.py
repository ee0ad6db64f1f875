"""Near-duplicate groups by a chosen-path set similarity join.

Documents with equal shingle sets form one class; classes are joined. In every
tree a class walks down by minwise tokens: the node it reaches names the path of
tokens chosen so far. The first ``BASE`` levels are taken at once. A node with
more than ``SMALL`` classes is branched again: its members go on along one or
two further minwise tokens, 1/threshold on average, so that a pair at the
threshold is expected to stay together; after ``DEPTH`` levels a node is left as
it is. ``TREES`` independent trees make it all but certain (1 - 2e-5 for a pair
at the threshold that meets no large node) that a pair shares a node.

In the nodes, pairs are compared on their full sets, as far as they can change
the groups: first every member with the node's least member, then, where a node
still holds several groups, the members outside its largest group with all
members, in blocks, until their groups are linked. Pairs inside one group
are never compared, so a large group of copies costs rows in proportion to its
size, and no link that could join two groups is left out. Pairs whose minwise
tokens agree far too seldom are not compared on full sets (the estimate must be
0.2 below the threshold, over four deviations).

Copies are not expanded: a class is one row whatever its number of documents.
Null ids are rows like others and are never the least id unless all are null;
null texts and texts without words have no set and are linked with nothing.
Repeated rows are copies. Texts are taken whole. Extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from eccentra.llm.common import (SEGMENT, U64, by_value, components, content_filter, discard, keep, mix, passes, randoms, shingle_sets, table, text_chunks)
from eccentra.llm.op9_suffix_dedup import some_texts, text_filter

by_value(__name__)

TREES, BASE, DEPTH, SMALL, ALIKE = 16, 3, 9, 24, 0.6
EXTRA = 32
COORDS = TREES * BASE + EXTRA
MARGIN, BLOCK, CHUNK = 0.2, 256, 512


def signatures(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Minwise tokens (32 bits each) of non-empty sets: one row of ``COORDS`` per set."""
    out = np.empty((len(at) - 1, COORDS), dtype=np.uint32)
    a, b = randoms(COORDS, 21) | U64(1), randoms(COORDS, 22)
    for i in range(COORDS):
        v = ((sets * a[i] + b[i]) >> U64(32)).astype(np.uint32)
        out[:, i] = np.minimum.reduceat(v, at[:-1])
    return out


def sketch(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, n_shingles, cid, sig): class and signature of every document; both null without a set."""
    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch, limit=SEGMENT):
                sets, at = shingle_sets(data, offsets, width)
                n = np.diff(at)
                some = np.flatnonzero(n)
                starts = at[:-1][some]
                cid, sig = [None] * len(n), [None] * len(n)
                if len(some):
                    one, two = np.add.reduceat(sets, starts), np.add.reduceat(mix(sets ^ U64(0x5555)), starts)
                    signs = signatures(sets, np.append(starts, len(sets)))
                    for j, d in enumerate(some):
                        cid[d] = one[j].tobytes() + two[j].tobytes()
                        sig[d] = signs[j].tobytes()
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("key"), pa.array(n.astype(np.int64)), pa.array(cid, pa.binary()), pa.array(sig, pa.binary())],
                                                 ["id", "key", "n_shingles", "cid", "sig"])

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("key"))
    return own.mapInArrow(run, "id long, key long, n_shingles long, cid binary, sig binary")


def base_nodes(classes: DataFrame) -> DataFrame:
    """(node, cid, tree): the node of every class after the first levels, in every tree."""
    def run(batches):
        salt = randoms(TREES, 31)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), dtype=np.uint32).reshape(n, COORDS).astype(np.uint64)
            nodes = np.empty((n, TREES), dtype=np.uint64)
            for t in range(TREES):
                v = np.full(n, salt[t])
                for level in range(BASE):
                    v = mix(v ^ mix(sig[:, t * BASE + level] + U64(level << 40)))
                nodes[:, t] = v
            yield pa.RecordBatch.from_arrays([pa.array(nodes.view(np.int64).ravel()), batch.column("cid").take(pa.array(np.repeat(np.arange(n), TREES))),
                                                  pa.array(np.tile(np.arange(TREES, dtype=np.int32), n))], ["node", "cid", "tree"])

    return classes.select("cid", "sig").mapInArrow(run, "node long, cid binary, tree int")


def branch(members: DataFrame, level: int) -> DataFrame:
    """(parent, first, node, cid, tree): members (node, cid, tree, sig) of large nodes one level further down, along two tokens each."""
    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), dtype=np.uint32).reshape(n, COORDS)
            node = batch.column("node").to_numpy().view(np.uint64)
            seed = mix(node + U64(level))
            one = (seed % U64(EXTRA)).astype(np.int64)
            two = (one + 1 + (mix(seed) % U64(EXTRA - 1)).astype(np.int64)) % EXTRA
            for first, coord in ((True, TREES * BASE + one), (False, TREES * BASE + two)):
                token = sig[np.arange(n), coord].astype(np.uint64)
                down = mix(node ^ mix(token + (coord.astype(np.uint64) << U64(40)) + (U64(level) << U64(50))))
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(np.full(n, first)), pa.array(down.view(np.int64)), batch.column("cid"), batch.column("tree")], ["parent", "first", "node", "cid", "tree"])

    return members.mapInArrow(run, "parent long, first boolean, node long, cid binary, tree int")


def leaves(classes: DataFrame) -> DataFrame:
    """(node, cid, tree, size, base) of all nodes with two members at least that are not branched further; ``base``: nor were before."""
    found, current = [], keep(base_nodes(classes), "nodes")
    for level in range(BASE, DEPTH + 1):
        sizes = current.groupBy("node").agg(F.count("*").alias("size")).filter("size > 1")
        counted = keep(current.join(sizes, "node").withColumn("base", F.lit(level == BASE)), "nodes")
        large = counted.filter(F.col("size") > SMALL)
        if level == DEPTH or large.isEmpty():
            found.append(counted)
            break
        down = keep(branch(large.join(classes.select("cid", "sig"), "cid").select("node", "cid", "tree", "sig"), level), "nodes")
        # of a node that is alike, most go the same way
        ways = down.filter("first").groupBy("parent", "node").agg(F.count("*").alias("n"))
        alike = keep(ways.groupBy("parent").agg((F.max("n") / F.sum("n")).alias("share")).filter(F.col("share") >= ALIKE).select("parent"), "alike")
        found.append(counted.filter(F.col("size") <= SMALL).unionByName(large.join(alike, large.node == alike.parent, "left_semi")))
        current = down.join(alike, "parent", "left_anti").select("node", "cid", "tree")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return keep(out, "leaves")


def likely(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose minwise tokens agree often enough to be compared."""
    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if n:
                one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint32).reshape(n, COORDS) for c in ("sig_a", "sig_b"))
                good = (one == two).mean(axis=1) >= threshold - MARGIN
                if good.any():
                    yield batch.select(["a", "b"]).filter(pa.array(good))

    sig_a, sig_b = (classes.select(F.col("cid").alias(x), F.col("sig").alias(f"sig_{x}")) for x in "ab")
    return pairs.join(sig_a, "a").join(sig_b, "b").select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a binary, b binary")


def confirm(pairs: DataFrame, texts: DataFrame, threshold: float, width: int) -> DataFrame:
    """Pairs (a, b) whose full shingle sets have 100 * intersection >= 100 * threshold * union."""
    percent = round(threshold * 100)

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                names = {}
                for side in "ab":
                    for i, c in enumerate(part.column(side).to_pylist()):
                        names.setdefault(c, (side, i))
                sets = {}
                for side in "ab":
                    own = [(c, i) for c, (s, i) in names.items() if s == side]
                    if own:
                        some = pa.RecordBatch.from_arrays([part.column(f"text_{side}").take(pa.array([i for _, i in own]))], ["text"])
                        for first, last, data, offsets in text_chunks(some):
                            sh, at = shingle_sets(data, offsets, width)
                            for j in range(first, last):
                                sets[own[j][0]] = sh[at[j - first]: at[j - first + 1]]
                good = []
                for a, b in zip(part.column("a").to_pylist(), part.column("b").to_pylist()):
                    x, y = sets[a], sets[b]
                    if len(x) > len(y):
                        x, y = y, x
                    common = 0
                    if 100 * len(x) >= percent * len(y):
                        at = np.searchsorted(y, x)
                        common = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                    good.append(100 * common >= percent * (len(x) + len(y) - common))
                if any(good):
                    yield part.select(["a", "b"]).filter(pa.array(good))

    one, two = (texts.select(F.col("cid").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
    return pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary")


def outside_links(mixed: DataFrame, trees: DataFrame, classes: DataFrame, texts: DataFrame, threshold: float, width: int) -> DataFrame:
    """Links (a, b) across groups in nodes with several, from rows (node, cid, tree, root) and (cid, trees).

    The members outside a node's largest group are set against all its members,
    ``BLOCK`` of them against ``CHUNK`` members at a time: a group of rows holds
    no more than about both, whatever the size of the node. Likely pairs are
    compared on full sets where they meet, best first, until the two groups are
    known to be linked; only links leave the task. A pair that shares a node in
    several trees is left to the first: ``trees`` has the bits of the trees whose
    node of a class was not branched, so that all its members meet there.
    """
    percent = round(threshold * 100)
    counts = mixed.groupBy("node", "root").agg(F.count("*").alias("n"))
    main = counts.groupBy("node").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("members"), (F.sum("n") - F.max("n")).alias("outside"))
    told = (mixed.select("node", "cid", "tree", "root").join(main, "node")
            .withColumn("blocks", F.ceil(F.col("outside") / BLOCK).cast("int")).withColumn("chunks", F.ceil(F.col("members") / CHUNK).cast("int")))
    own = F.xxhash64("cid")
    block, chunk = F.pmod(own, F.col("blocks")).cast("int"), F.pmod(F.xxhash64(own), F.col("chunks")).cast("int")
    asked = told.filter("root <> main").select("node", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("side"), "cid", "tree", "root")
    given = told.select("node", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), chunk.alias("chunk"), F.lit(1).alias("side"), "cid", "tree", "root")
    laid = asked.unionByName(given).join(classes.select("cid", "sig"), "cid").join(trees, "cid").join(texts, "cid")

    def sets_of(rows, known):
        new = [r for r in rows if r[1] not in known]
        if new:
            batch = pa.RecordBatch.from_arrays([pa.array([r[3] for r in new], pa.string())], ["text"])
            for lo, hi, data, offsets in text_chunks(batch):
                sh, at = shingle_sets(data, offsets, width)
                for j in range(lo, hi):
                    known[new[j][1]] = sh[at[j - lo]: at[j - lo + 1]]

    def compare(one, other, tree):
        # rows (root, cid, sig, text, trees) of the asked and of the given
        s1, s2 = (np.frombuffer(b"".join(r[2] for r in rows), dtype=np.uint32).reshape(len(rows), COORDS) for rows in (one, other))
        agree = np.zeros((len(one), len(other)), dtype=np.int16)
        before = np.zeros(agree.shape, dtype=bool)
        whole = np.array([row[4] for row in one])
        for i in range(COORDS):
            eq = s1[:, i][:, None] == s2[:, i][None, :]
            agree += eq
            if i < tree * BASE:
                path = eq if i % BASE == 0 else path & eq
                if i % BASE == BASE - 1:
                    before |= path & ((whole >> (i // BASE) & 1) == 1)[:, None]
        names = {r: k for k, r in enumerate(sorted({r[0] for r in one} | {r[0] for r in other}))}
        g1, g2 = (np.array([names[r[0]] for r in rows]) for rows in (one, other))
        i, j = np.nonzero((agree >= (threshold - MARGIN) * COORDS) & (g1[:, None] != g2[None, :]) & ~before)
        if not len(i):
            return []
        order = np.argsort(-agree[i, j], kind="stable")
        known: dict = {}
        sets_of([one[k] for k in np.unique(i)], known)
        sets_of([other[k] for k in np.unique(j)], known)
        top = list(range(len(names)))

        def find(x):
            while top[x] != x:
                top[x] = top[top[x]]
                x = top[x]
            return x

        found = []
        for k in order:
            a, b = find(g1[i[k]]), find(g2[j[k]])
            if a != b:
                x, y = known[one[i[k]][1]], known[other[j[k]][1]]
                if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * common >= percent * (len(x) + len(y) - common):
                        top[a] = b
                        found.append(tuple(sorted((one[i[k]][1], other[j[k]][1]))))
        return found

    def run(batches):
        at, one, other = None, [], []

        def out():
            if one and other and (pairs := compare(one, other, at[3])):
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.binary()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            pieces = (batch.slice(lo, 128) for lo in range(0, batch.num_rows, 128))
            names = ("node", "block", "chunk", "tree", "side", "root", "cid", "sig", "text", "trees")
            for node, blk, chk, tree, side, *row in (r for p in pieces for r in zip(*[p.column(c).to_pylist() for c in names])):
                if (node, blk, chk, tree) != at:
                    yield from out()
                    at, one, other = (node, blk, chk, tree), [], []
                (other if side else one).append(row)
                if len(other) == CHUNK:  # the asked come first
                    yield from out()
                    other = []
        yield from out()

    laid = laid.repartition("node", "block", "chunk").sortWithinPartitions("node", "block", "chunk", "side")
    return laid.mapInArrow(run, "a binary, b binary")


def groups(docs: DataFrame, threshold: float = 0.8, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Documents (id, key, n_shingles, cid) and the groups (cid, root) of linked classes.

    ``root`` is the least class of the group; classes without links are not listed.
    """
    drawn = keep(sketch(docs, width, id_col, text_col), "sketch")
    classes = keep(drawn.filter("cid is not null").groupBy("cid").agg(F.min("key").alias("key"), F.first("sig").alias("sig")), "classes")
    leaf = leaves(classes)

    # the texts of classes that share a node, one document each
    needed = keep(classes.join(leaf.select("cid").distinct(), "cid").select("cid", "key"), "needed")
    own = docs.select(F.col(text_col).alias("text"), F.xxhash64(text_col).alias("key")).withColumn("_second", F.xxhash64("key"))
    some = passes(own, "key", content_filter(needed, "key")).join(needed, "key").select("cid", "text")
    texts = keep(some.groupBy("cid").agg(F.first("text").alias("text")), "texts")

    least = leaf.groupBy("node").agg(F.min("cid").alias("a"))
    pairs = keep(leaf.join(least, "node").filter("cid <> a").select("a", F.col("cid").alias("b")).distinct(), "pairs")
    links = keep(confirm(keep(likely(pairs, classes, threshold), "likely"), texts, threshold, width), "links")
    labels = components(links)
    of = leaf.join(labels, leaf.cid == labels.node, "left").select(leaf.node, "cid", "tree", F.coalesce("root", "cid").alias("root"))
    mixed = of.groupBy("node").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("node")
    open_ = keep(of.join(mixed, "node"), "open")
    trees = leaf.groupBy("cid").agg(F.bit_or(F.when(F.col("base"), F.expr("shiftleft(1, tree)")).otherwise(0)).alias("trees"))
    across = keep(outside_links(open_, trees, classes, texts, threshold, width).distinct(), "across")
    if not across.isEmpty():
        labels = components(links.unionByName(across))
    discard(classes, leaf, needed, texts, pairs, links, open_, across)
    return drawn, labels


def near_duplicates(docs: DataFrame, threshold: float = 0.8, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, id, n_shingles, component_id): ``component_id`` is the least id of the group. Hashed ``key`` is the text's."""
    drawn, labels = groups(docs, threshold, width, id_col, text_col)
    own = drawn.filter("cid is not null").groupBy("cid").agg(F.min("id").alias("least"))
    rooted = own.join(labels, own.cid == labels.node, "left").select("cid", "least", F.coalesce("root", "cid").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("least").alias("component"))
    named = rooted.join(lowest, "root").select("cid", "component")
    return drawn.join(named, "cid", "left").select("key", "id", "n_shingles", F.coalesce("component", "id").alias("component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    """Contract of the query: sets of four words."""
    out = near_duplicates(table(spark, sf_dir, "documents"), 0.8, 4)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that with the least id (nulls last), of several texts with that id the one of
    least hash, and of rows equal in both one. Texts decide, not ids: two unrelated texts of one id are two groups,
    and both stay. Documents without a set stay.
    """
    drawn, labels = groups(docs, 0.8, 5)
    of = drawn.filter("cid is not null").join(labels, drawn.cid == labels.node, "left").select("id", "key", F.coalesce("root", "cid").alias("root"))
    of = keep(of, "groups")
    first = of.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("first"))
    judged = keep(of.join(first, "root").select("id", "key", (F.col("id").eqNullSafe(F.col("first.id")) & (F.col("key") == F.col("first.key"))).alias("stays"))
                  .groupBy("id", "key", "stays").agg(F.count("*").alias("n")), "judged")
    discard(of)
    # rows of neither kind surely stay and pass beside the joins
    pair = [F.xxhash64("id", "key").alias("k1"), F.xxhash64("key", "id").alias("k2")]
    lost, several = judged.filter("not stays").select("id", "key"), judged.filter("stays and n > 1").select("id", "key")
    filled = text_filter(judged.filter("not stays or n > 1").select(*pair))
    marked = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("key")).select("*", *pair)
    rest = some_texts(marked, filled, inside=False)

    def match(rows: DataFrame, those: DataFrame, how: str) -> DataFrame:
        those = those.select(F.col("id").alias("_id"), F.col("key").alias("_key"))
        return rows.join(those, F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), how)

    doubt = match(some_texts(marked, filled), lost, "left_anti")
    if several.isEmpty():
        return rest.unionByName(doubt).select("row.*")
    once = match(doubt, several, "left_semi").dropDuplicates(["id", "key"])
    return rest.unionByName(match(doubt, several, "left_anti")).unionByName(once).select("row.*")


ORACLE = r"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS MATERIALIZED (SELECT doc_id, unnest(list_distinct(CASE WHEN len(words) = 0 THEN []::VARCHAR[] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
  ELSE list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) END)) AS sh FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
i AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY 1, 2),
link AS MATERIALIZED (SELECT a, b FROM i JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, r.c AS component_id, d.doc_id = r.c AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS c FROM reach GROUP BY 1) r ON r.a = d.doc_id
"""
