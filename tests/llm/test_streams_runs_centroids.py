"""Collocations, line runs and centroid clustering against plain Python, and as SQL on a hostile table."""

import base64
import hashlib
import math
import random
import re
import struct
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from eccentra.llm import op2_bottom_k as op2, op11_collocations as op11, op12_line_runs as op12, op13_centroids as op13
from eccentra.llm.common import fresh

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def write(spark, df, name="documents"):
    path = fresh(spark, "fixture")
    df.write.parquet(f"{path}/{name}.parquet")
    return path


def sql(path, name, text):
    con = duckdb.connect()
    con.execute(f"create view {name} as select * from '{path.removeprefix('file:')}/{name}.parquet/*.parquet'")
    return con.execute(text).fetchall()


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(3)
    words = ["The", "of", "Größe", "x y", "İs", "end", "naïve", "w1", "w2", "w3"]

    def prose(n):
        return "".join(r.choice(words) + r.choice([" ", " ", " ", "  ", "\t", ", ", ". ", "\n", "\x0b", "; "]) for _ in range(n))

    shared = ["  Same Line\t", "same line", "Licence: all rights reserved.", "x", "É", "é"]
    rows = [(i, "\n".join([prose(r.randint(0, 30)), r.choice(shared), prose(5), r.choice(shared)]), r.choice(["en", "de", None]), "s", 1) for i in range(120)]
    rows += [(5, rows[5][1], "en", "s", 1), (None, rows[6][1], "en", None, None), (None, None, None, None, None), (200, "", "en", "s", 0), (201, " \n\t\n\n", "en", "s", 4),
             (202, "of the end " * 4000, "en", "s", 1), (203, "..,,;;", "xx", "s", 1), (204, "one", "xx", "s", 1), (205, " ".join(["a b"] * 40), "xx", "s", 1)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def folder(spark, docs):
    return write(spark, docs)


# ---- collocations

def phrases(rows, least, top):
    """As the contract says, by plain counting."""
    f, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", lower(text)):
            w = [x for x in re.split(r"[ \t]+", piece) if x]
            total[lang] += len(w)
            for n in range(1, 5):
                f[lang].update(tuple(w[i:i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if a >= least and len(p) > 1}
        gone = {p[i:j] for p, a in cand.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and 100 * a >= 80 * counts[p[i:j]]}
        rows_ = []
        for p, a in cand.items():
            if p in gone:
                continue
            cuts = [(math.floor(Fraction(2000000 * a, counts[p[:k]] + counts[p[k:]])), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            rows_.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(rows_)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -score))
    return out


def found(df, least=30, top=2000):
    out = op11.best(*op11.collocations(df.select("text", "lang"), least), top)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return [tuple(r) for r in out.collect()]


@pytest.mark.parametrize("least,top", [(30, 2000), (2, 2000), (3, 7)])
def test_collocations_equal_plain_counting(docs, least, top):
    rows = [(r["lang"], r["text"]) for r in docs.collect()]
    assert Counter(found(docs, least, top)) == Counter(phrases(rows, least, top))


def test_collocations_with_many_small_ranges(spark, docs, monkeypatch):
    """Ranges cut within the phrases of one first word, and batches of three rows."""
    rows = [(r["lang"], r["text"]) for r in docs.collect()]
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "23")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
        assert Counter(found(docs, 4, 50)) == Counter(phrases(rows, 4, 50))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before[1])


def test_collocations_as_sql(spark, folder):
    assert Counter(tuple(r) for r in op11.query(spark, folder).collect()) == Counter(sql(folder, "documents", op11.ORACLE))


def test_collocations_of_nothing(spark, docs):
    assert found(docs.filter("false")) == []
    assert found(spark.createDataFrame([(None, "en"), ("", None), ("a b c", "en")], "text string, lang string")) == []


def test_scores_beyond_64_bits(spark):
    """2,000,000 times a count of 10**13 does not fit a long."""
    a, left, right = 10**13, 3 * 10**13, 4 * 10**13 + 1
    both = spark.createDataFrame([(a, left, right)], "c long, p1 long, s1 long")
    got = both.select(F.expr("cast(2000000 as decimal(10,0)) * cast(c as decimal(19,0)) div (cast(p1 as decimal(19,0)) + cast(s1 as decimal(19,0)))").alias("s")).first()["s"]
    assert got == 2000000 * a // (left + right)


def test_best_extension_and_merge_hold_over_borders():
    c, n = np.array([9, 5, 4, 3]), np.array([1, 2, 2, 3])
    before = {1: np.array([-1, 0, 0, 0]), 2: np.array([-1, -1, -1, 2]), 3: np.full(4, -1)}
    assert op11.best_extension(c, n, before).tolist() == [5, 0, 3, 0]


# ---- line runs

def plain_lines(rows, limit, least):
    split = [(d, (t or "").split("\n")) for d, t in rows]
    def key(x):
        return lower(x.strip(" \t\n\x0b\x0c\r"))

    often = Counter(k for _, ls in split for k in {key(x) for x in ls} if len(k) >= least)
    out = []
    for d, ls in split:
        left = [x for x in ls if not (len(key(x)) >= least and often[key(x)] >= limit)]
        out.append((d, len(ls), len(ls) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return out


def test_lines_equal_plain_counting(spark, docs, folder):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = [tuple(r) for r in op12.query(spark, folder).collect()]
    assert Counter(got) == Counter(plain_lines(rows, 10, 1))
    assert any(r[2] for r in got)


def test_lines_as_sql(spark, folder):
    assert Counter(tuple(r) for r in op12.query(spark, folder).collect()) == Counter(sql(folder, "documents", op12.ORACLE))


@pytest.mark.parametrize("batches", [1, 3, 7])
def test_lines_do_not_depend_on_batches(docs, batches):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    extra = docs.selectExpr("*", "1 as h", "2 as g", "3 as k1", "4 as hashes", "5 as gone", "6 as row", "7 as _text")
    out = op12.dropped(extra, limit=3, least=4, batches=batches)
    assert {"h", "g", "k1", "hashes", "gone", "row"} <= set(out.columns)
    got = [(r["doc_id"], r["_lines"], r["_dropped"], hashlib.sha256(r["_text"].encode()).hexdigest()) for r in out.collect()]
    assert Counter(got) == Counter(plain_lines(rows, 3, 4))


def test_lines_of_nothing(docs):
    assert op12.dropped(docs.filter("false")).count() == 0
    only = op12.dropped(docs.filter("text is null")).collect()
    assert [(r["_lines"], r["_dropped"], r["_text"], r["text"]) for r in only] == [(1, 0, "", None)]


def test_runs_take_batches_and_return_what_is_new(spark):
    """limit 1: every batch gives back the lines not seen before; levels hold one run each."""
    runs, seen = op12.LineRuns(spark, limit=1, buckets=3), set()
    r = random.Random(1)
    for turn in range(5):
        batch = {r.randrange(60) for _ in range(25)}
        new = runs.add(spark.createDataFrame([(h, h + 1, 1) for h in batch], "h long, g long, n long"))
        assert {x["h"] for x in new.collect()} == batch - seen
        seen |= batch
        assert [x is not None for x in runs.levels] == [bool((turn + 1) >> b & 1) for b in range((turn + 1).bit_length())]
    assert {(x["h"], x["g"]) for x in runs.frequent().collect()} == {(h, h + 1) for h in seen}
    runs.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("lines_")]


def test_runs_add_counts_over_levels(spark):
    runs = op12.LineRuns(spark, limit=10, buckets=2)
    for _ in range(5):
        runs.add(spark.createDataFrame([(1, 1, 2), (2, 2, 1), (1, 9, 1)], "h long, g long, n long"))
    assert sorted(tuple(x) for x in runs.frequent().collect()) == [(1, 1)]
    runs.close()


def test_runs_are_merged_without_exchange(spark):
    runs = op12.LineRuns(spark, limit=2, buckets=4)
    rows = spark.createDataFrame([(i, i, 1) for i in range(50)], "h long, g long, n long")
    one, two = (runs._write(rows.repartition(4, "h", "g")) for _ in range(2))
    plan = one.select("h", "g", "n").join(two.select("h", "g").hint("merge"), ["h", "g"], "full_outer")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    runs._delete(one, two)


def test_lines_plan_has_no_python(spark, folder):
    plan = op12.query(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# ---- centroids

def plain_clusters(rows, k, rounds, dim):
    kept = [(v, [math.floor(Fraction(float(x)) * 64) for x in e]) for v, e in rows if e is not None and len(e) == dim and all(x is not None and math.isfinite(x) for x in e)]
    cent = [e for _, e in sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(e, c)), j) for j, c in enumerate(cent)) for _, e in kept]

    for _ in range(rounds):
        own = defaultdict(list)
        for (_, e), (_, j) in zip(kept, assign()):
            own[j].append(e)
        cent = [[sum(col) // len(own[j]) for col in zip(*own[j])] if j in own else c for j, c in enumerate(cent)]
    at = assign()
    return [(v, j, d) for (v, _), (d, j) in zip(kept, at)], cent


def vectors(dim=64):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(0, 1, dim) + 3 * (i % 5)).tolist()) for i in range(300)]
    rows += [(7, rows[7][1]), (None, rows[8][1]), (None, rows[9][1]), (400, rows[3][1][:-1]), (401, None), (402, []), (403, rows[1][1][:-1] + [None]),
             (404, rows[1][1][:-1] + [float("nan")]), (405, rows[1][1][:-1] + [float("inf")]), (406, [0.0] * dim), (407, [-1e-9] * dim)]
    return rows + [(500 + i, rows[3][1]) for i in range(90)]


def test_clusters_equal_plain_search(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4).selectExpr("*", "1 as x", "2 as lead", "3 as cluster")
    out, cent = op13.clustered(df)
    want, centroids = plain_clusters(rows, 16, 3, 64)
    assert cent == centroids
    assert Counter(tuple(r) for r in out.collect()) == Counter(want)


def test_clusters_of_very_long_vectors(spark):
    """Components beyond 64 bits: exact sums, and null for a distance that does not fit a long."""
    r = random.Random(4)
    rows = [(i, [r.choice([1e30, -3e25, 5.5, -0.3, 2.0**70, 1.7e308 * (i % 7 == 0)]) for _ in range(3)]) for i in range(40)] + [(50 + i, [float(i), 0.5, -7.0]) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    out, cent = op13.clustered(df, k=5, rounds=2, dim=3, lead=2)
    want, centroids = plain_clusters(rows, 5, 2, 3)
    assert cent == centroids
    assert Counter(tuple(x) for x in out.collect()) == Counter((v, j, d if d < 1 << 63 else None) for v, j, d in want)


def test_clusters_as_sql(spark):
    path = write(spark, spark.createDataFrame([v for v in vectors() if v[0] != 7 or v is None], "vec_id long, embedding array<float>").filter("vec_id is not null"), "embeddings")
    assert Counter(tuple(r) for r in op13.query(spark, path).collect()) == Counter(sql(path, "embeddings", op13.ORACLE))


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = vectors()[:3]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out, cent = op13.clustered(df)
    assert len(cent) == 3 and sorted(r["distance"] for r in out.collect()) == [0, 0, 0]
    path = write(spark, df.filter("false"), "embeddings")
    got = op13.query(spark, path)
    assert got.count() == 0 and got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_bound_never_loses_the_nearest_and_spares_work():
    """Vectors with little spread beside their main axes, centroids among them, and nearly no rest at all."""
    rng = np.random.default_rng(9)
    for scale in (1.0, 1e-3, 1e4):
        ints = np.floor((rng.normal(0, 1, (500, 12)) @ rng.normal(0, 1, (12, 64)) * 40 + rng.normal(0, 1, (500, 64))) * scale).astype(np.int64)
        cent = ints[rng.choice(500, 16, replace=False)]
        mean = ints.mean(axis=0)
        basis = np.linalg.eigh(np.cov((ints - mean).T))[1][:, ::-1][:, :12]
        lead, rest = op13.sketches(ints, mean, basis)
        who, d, measured = op13.nearest(ints, lead, rest, cent, (mean, basis))
        full = ((ints[:, None, :] - cent[None]) ** 2).sum(axis=2)
        assert (who == full.argmin(axis=1)).all() and (d == full.min(axis=1)).all()
        if scale >= 1:
            assert measured < 0.5 * full.size


# ---- fingerprints, against a plain bottom-k

def plain_sketch(text, k=256, width=5):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if w]
    hashes = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in words]
    out = set()
    for i in range(max(len(hashes) - width + 1, 1) if hashes else 0):
        h = 42
        for x in hashes[i: i + width]:
            h = xxhash.xxh64_intdigest(struct.pack("<Q", x), seed=h)
        out.add(h - 2**64 if h >= 2**63 else h)
    return sorted(out)[:k]


def plain_likeness(a, b, k=256):
    if not a and not b:
        return 1.0
    union = sorted(set(a) | set(b))[:k]
    return len(set(union) & set(a) & set(b)) / len(union)


def test_fingerprints_equal_a_plain_bottom_k(spark):
    """Every column of the query: sketch, edited text, likeness to it and to the next document."""
    r = random.Random(5)
    base = " ".join("w%d" % r.randrange(900) for _ in range(700))
    texts = [base, base, base[:2000] + " other " + base[2100:], "", None, "one two", "one two three four five six", "\u00c9t\u00e9 A\tB\nc " * 80] + [
        " ".join("v%d" % r.randrange(300) for _ in range(r.randrange(400))) for _ in range(20)]
    rows = list(enumerate(texts))
    path = write(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    got = {x["doc_id"]: x for x in op2.query(spark, path).collect()}
    down = sorted(rows, reverse=True)
    for (d, t), (_, nxt) in zip(down, down[1:] + down[:1]):
        t, nxt = t or "", nxt or ""
        cut = len(t) // 3
        edited = t[: len(t) - cut] + nxt[:cut]
        a, b, c = plain_sketch(t), plain_sketch(edited), plain_sketch(nxt)
        x = got[d]
        assert x["n_chars"] == len(t) and x["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert base64.b64decode(x["fingerprint"].replace("\r\n", "")) == b"".join(struct.pack(">q", h) for h in a)
        assert base64.b64decode(x["edited_fingerprint"].replace("\r\n", "")) == b"".join(struct.pack(">q", h) for h in b)
        assert math.isclose(x["near_edited"], plain_likeness(a, b)) and math.isclose(x["near_next"], plain_likeness(a, c))
