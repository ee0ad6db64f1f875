"""The operators on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import base64
import hashlib
import io
import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from eccentra.llm import (op1_decontamination as op1, op2_bottom_k as op2, op3_quality as op3, op4_url_reputation as op4, op5_token_counts as op5, op6_packing as op6,
                          op7_near_dedup as op7, op8_pseudo_likelihood as op8, op9_suffix_dedup as op9, op10_warc as op10, tokens)
from eccentra.llm.common import fresh, shingle_sets, word_hashes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
rng = random.Random(5)
WORDS = ["the", "of", "and", "Größe", "naïve", "x1", "mañana", "table,", "end.", "a"] + ["w%d" % i for i in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def texts():
    base, long = prose(120, 1), prose(30000, 2)
    near = base.replace("w7 ", "w8 ", 1)
    passage = prose(60, 3)
    return [base, base, near, near + " tail", "", None, " \n\t ", "one", "one two", "One Two", prose(90, 4) + "\n" + passage, passage + "\n" + prose(70, 5), long, "é" * 700,
            "A a " * 300, prose(200, 6), "<|endoftext|> is text", "tab\tsep\x0bvt", prose(130, 1), "\u0130stanbul \U0001F600 " + prose(20, 8), passage]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts())]
    rows += [(3, rows[3][1], "en", "s", 1), (None, "no id here " * 9, None, None, None), (None, base_text(), None, None, None), (-5, "one", "xx", "s", 3)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def base_text():
    return texts()[0]


@pytest.fixture(scope="module")
def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture()
def clash(docs):
    """Extra columns named like the operators' own."""
    return docs.selectExpr("*", "1 as k", "2 as id", "3 as score", "'x' as node", "'y' as cid", "4 as spans", "5 as hash", "6 as rank", "7 as block", "8 as words", "9 as h")


def write(spark, df, name="documents", **more):
    path = fresh(spark, "fixture")
    df.write.parquet(f"{path}/{name}.parquet")
    for n, d in more.items():
        d.write.parquet(f"{path}/{n}.parquet")
    return path


def same(a, b):
    assert Counter(a) == Counter(b)


# ---- words and shingles

def words_of(t):
    return re.findall(rb"[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")).encode())


def test_words_and_shingles_match_plain_python(monkeypatch):
    import eccentra.llm.common as common

    monkeypatch.setattr(common, "SEGMENT", 700)
    ts = [t or "" for t in texts()]
    data = np.frombuffer("".join(ts).encode(), dtype=np.uint8)
    offsets = np.cumsum([0] + [len(t.encode()) for t in ts])
    hashes, at = word_hashes(data, offsets)
    seen = {}
    for d, t in enumerate(ts):
        ws = words_of(t)
        assert at[d + 1] - at[d] == len(ws)
        for h, w in zip(hashes[at[d]: at[d + 1]].tolist(), ws):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    sets, at = shingle_sets(data, offsets, 4)
    for d, t in enumerate(ts):
        ws = words_of(t)
        want = {tuple(ws[i: i + 4]) for i in range(len(ws) - 3)} or ({tuple(ws)} if ws else set())
        assert at[d + 1] - at[d] == len(want)


# ---- 1

def overlap(doc, item, span=op1.SPAN, share=op1.SHARE):
    tok = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    x, y = tok(doc), tok(item)
    w, best = min(span, len(y)), 0
    for d in range(-len(y), len(x)):
        eq = [0 <= j + d < len(x) and x[j + d] == y[j] for j in range(len(y))]
        best = max([best] + [sum(eq[s: s + w]) for s in range(len(y) - w + 1)])
    return bool(y) and best >= math.ceil(share * w)


def test_spaced_seeds_find_changed_passages(spark, docs, empty):
    item = prose(40, 77)
    ws = item.split()
    changed = " ".join("zzz" if i % 8 == 3 else w for i, w in enumerate(ws))
    tests = spark.createDataFrame([(1, item), (2, prose(30, 78)), (3, None), (4, ""), (5, "too short")], "item_id long, text string")
    more = spark.createDataFrame([(100, prose(50, 9) + " " + item + " " + prose(9, 10), "en", "s", 0), (101, changed, "en", "s", 0), (102, prose(50, 12), "en", "s", 0),
                                  (103, " ".join(ws[:14]) + " other words entirely here", "en", "s", 0), (104, item.upper().replace(" ", ", "), "en", "s", 0)], SCHEMA)
    path = write(spark, docs.unionByName(more).withColumn("k1", F.lit(1)), benchmark=tests)
    out = {(r["doc_id"], r["contaminated"], r["n_items"]) for r in op1.query(spark, path).collect()}
    assert {x[0] for x in out if x[1]} == {100, 101, 103, 104}
    for r in more.collect():
        assert overlap(r["text"], item) == (r["doc_id"] != 102)
    kept = op1.stage(spark, docs.unionByName(more), path)
    same([r["doc_id"] for r in kept.collect()], [r["doc_id"] for r in docs.collect()] + [102])
    assert kept.columns == docs.columns
    path = write(spark, empty, benchmark=tests.limit(0))
    assert op1.query(spark, path).count() == 0 and op1.stage(spark, docs, path).count() == docs.count()


def test_short_tests_and_scripts_without_spaces(spark):
    """Every allowed change of a short test, and characters as words, by brute force over all pairs of documents and tests."""
    for n in range(1, 11):
        change = n - math.ceil(n * 0.8 - 1e-9)
        masks = op1.short_masks(n)
        assert all(any(not set(m) & set(c) for m in masks) for c in combinations(range(n), change))
    r = random.Random(2)
    tests = [(n, " ".join(f"t{n}x{i}" for i in range(n))) for n in range(1, 12)] + [(20, "\u5b66\u6821\u306e\u524d\u3067\u53cb\u9054\u3092\u5f85\u3063\u3066\u3044\u308b"), (21, "..."), (22, None)]
    docs = [(0, None), (1, ""), (2, "nothing here at all")]
    for n, text in tests[:11]:
        w = text.split()
        for k in range(min(n, 3) + 1):
            for places in list(combinations(range(n), k)):
                docs.append((len(docs), prose(3, n) + " " + " ".join("other" if i in places else x for i, x in enumerate(w)) + " " + prose(3, n + 1)))
    zh = tests[11][1]
    docs += [(len(docs), f"\u6628\u65e5{zh}\u3002end"), (len(docs) + 1, zh[:5] + "\u732b" + zh[6:]), (len(docs) + 2, zh[::-1]), (len(docs) + 3, zh)]

    def tok(t):
        return [w for w in re.findall(r"[\u3040-\u30ff\u4e00-\u9fff]|[^\W_\u3040-\u30ff\u4e00-\u9fff]+", (t or "").lower())]

    def meets(doc, item):
        x, y = tok(doc), tok(item)
        w, best = min(12, len(y)), 0
        for d in range(-len(y), len(x)):
            eq = [0 <= j + d < len(x) and x[j + d] == y[j] for j in range(len(y))]
            best = max([best] + [sum(eq[s: s + w]) for s in range(len(y) - w + 1)])
        return bool(y) and best >= math.ceil(0.8 * w - 1e-9)

    df, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(tests, "item_id long, text string")
    path = write(spark, df, benchmark=items)
    got = {r["doc_id"]: r["n_items"] for r in op1.query(spark, path).collect()}
    assert got == {d: sum(meets(t, item) for _, item in tests) for d, t in docs}
    assert sum(got.values()) > 100


def plan_of(df):
    from contextlib import redirect_stdout

    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_native_operators_have_no_python(spark, docs):
    tests = spark.createDataFrame([(1, prose(40, 77))], "item_id long, text string")
    path = write(spark, docs, benchmark=tests)
    for df in (op1.query(spark, path), op2.query(spark, path)):
        text = plan_of(df)
        assert "Python" not in text and "Arrow" not in text and "Pandas" not in text and "Cartesian" not in text and "NestedLoop" not in text


# ---- 2

def test_fingerprints(spark, docs, rows, clash, empty):
    out = op2.query(spark, write(spark, clash)).collect()
    assert len(out) == len(rows)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = Counter()
    for i, (d, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        cut = len(t) // 3
        want[(d, len(t), hashlib.sha256((t[: len(t) - cut] + nxt[:cut]).encode()).hexdigest())] += 1
    same([(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in out], list(want.elements()))
    by = {}
    for r in out:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        text = next(t or "" for d, t in rows if d == r["doc_id"] and len(t or "") == r["n_chars"])
        assert by.setdefault(text, r["fingerprint"]) == r["fingerprint"]
    assert op2.query(spark, write(spark, empty)).count() == 0


def test_sketches_estimate_and_merge(spark):
    a, b = prose(9000, 21), prose(6000, 22)
    both = spark.createDataFrame([(1, a, b, a + " " + b)], "g int, a string, b string, ab string")
    s = both.select("g", *[op2.sketch(F.col(c)).alias(c) for c in ("a", "b", "ab")])
    sh = lambda t: {tuple(t.split()[i: i + 5]) for i in range(len(t.split()) - 4)}
    r = s.select(op2.resemblance(F.col("a"), F.col("ab")).alias("j"), op2.distinct_count(F.col("ab")).alias("n"), op2.containment(F.col("a"), F.col("ab")).alias("c"),
                 op2.resemblance(F.col("a"), F.col("b")).alias("none")).first()
    j = len(sh(a)) / len(sh(a + " " + b))
    assert abs(r["j"] - j) < 0.12 and abs(r["n"] / len(sh(a + " " + b)) - 1) < 0.25 and r["c"] > 0.8 and r["none"] < 0.05
    parts = s.select("g", F.explode(F.array("a", "b")).alias("x"))
    assert op2.merge_groups(parts, "g", "x").first()["x"] == s.select(op2.merged(F.col("a"), F.col("b")).alias("m")).first()["m"]
    e = spark.range(1).select(op2.resemblance(op2.sketch(F.lit("")), op2.sketch(F.lit(None).cast("string"))).alias("x"), op2.resemblance(op2.sketch(F.lit("")), op2.sketch(F.lit("a"))).alias("y")).first()
    assert (e["x"], e["y"]) == (1.0, 0.0)


# ---- 3

def quality_tables(spark, n=600):
    r = random.Random(3)
    docs_, labels = [], []
    for i in range(n):
        bad = r.random() < 0.3
        t = " ".join(w + r.choice(["%%%", "$$$", "###"]) for w in prose(60, i).split()) if bad else prose(60, i)
        docs_.append((i, t, "en", "s", len(t)))
        if i % 5:
            labels.append((i, int(not bad), 0))
    labels += [(1, None, 0), (None, 1, 0), (10**6, 1, 0)]
    return spark.createDataFrame(docs_, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {d[0] for d in docs_ if "%" in d[1] or "$" in d[1]}


def test_neighbour_votes_hold_out(spark, docs, empty):
    own, labels, bad = quality_tables(spark)
    path = write(spark, own, labels=labels)
    out = op3.query(spark, path).collect()
    assert len(out) == 600
    held = [r for r in out if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out)
    assert np.mean([(r["predicted"] == 0) == (r["doc_id"] in bad) for r in held]) > 0.97
    kept = {r["doc_id"] for r in op3.stage(spark, own, path).collect()}
    assert len(kept & bad) < 0.05 * len(bad) and len(kept) > 0.95 * (600 - len(bad))
    odd = op3.query(spark, write(spark, docs.withColumn("_x", F.lit(1)), labels=labels)).collect()
    assert len(odd) == docs.count() and all(0 <= r["score"] <= 1 for r in odd)
    none = op3.query(spark, write(spark, docs, labels=labels.limit(0))).collect()
    assert {r["score"] for r in none} == {0.5} and op3.query(spark, write(spark, empty, labels=labels)).count() == 0


def test_votes_equal_plain_cosines():
    r = np.random.default_rng(0)
    x, y = r.random((300, op3.TERMS)).astype(np.float32), r.integers(0, 2, 300)
    m = op3.Model(x, y, 16)
    q = r.random((5, op3.TERMS)).astype(np.float32)
    got = m.score(q)
    for v, s in zip(q, got):
        z = m._unit(m._unit((v * m.weight)[None]) @ m.axes)[0]
        cos = m.points @ z
        near = np.argsort(-cos)[: op3.NEIGHBOURS]
        w = np.maximum(cos[near], 0).astype(np.float64) ** op3.SHARPNESS
        assert abs(s - (w * y[near]).sum() / w.sum()) < 1e-4


# ---- 4

def test_rules_and_reputation(spark):
    pages = [(1, "http://a.b.com/x"), (2, "HTTP://WWW.Example.com/en/1?q"), (3, "http://example.com/en/1"), (4, "http://sub.example.com/en/#f"), (5, "x://q.net/es/a"), (6, "x://q.net/fr/"),
             (7, "x://net/fr"), (8, None), (9, "no scheme"), (10, "x://bad.org/1"), (11, "x://good.org/1"), (12, "x://new.good.org"), (13, "x://a.com"), (14, "x://notexample.com/en/"), (15, ""), (None, "x://good.org/2"), (11, "x://good.org/1")]
    pages += [(100 + i, "x://bad.org/p%d" % i) for i in range(40)] + [(200 + i, "x://good.org/p%d" % i) for i in range(40)]
    labels = [(100 + i, 0) for i in range(40)] + [(200 + i, 1) for i in range(40)] + [(10, None), (None, 1), (200, 1)]
    out = op4.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, good int"))
    got = {}
    for r in out.collect():
        got.setdefault(r["page_id"], []).append((r["host"], r["path"], r["rule"], r["verdict"]))
    assert got[2] == [("www.example.com", "/en/1", "www.example.com/en/", "allow")]
    assert got[3][0][2:] == ("example.com/en/", "block") and got[4] == [("sub.example.com", "/en/", "example.com/en/", "block")]
    assert got[1][0][2:] == ("com/", "allow") and got[5][0][2:] == ("net/es/", "block") and got[6][0][2:] == ("net/fr/", "block") and got[7][0] [:3]== ("net", "/fr", None)
    assert got[8][0][:3] == ("", "", None) == got[9][0][:3] == got[15][0][:3] and got[13][0][:3] == ("a.com", "", None) and got[14][0][2] == "com/"
    assert got[10][0][3] == "block" and got[11] == [("good.org", "/1", None, "allow")] * 2 and len(got[None]) == 1 and len(out.columns) == 6
    none = op4.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame([], "page_id long, good int"))
    assert none.count() == len(pages) and op4.judge(spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame(labels, "page_id long, good int")).count() == 0


# ---- 5, 6

def whole_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.tokenizer_file("byte_bpe_50k.json"))


def test_fast_ids_equal_the_library():
    t, e = whole_tokenizer(), tokens.Encoder()
    plain = [c for c in map(chr, range(0x2100)) if not e.odd.search(c)]
    assert len(plain) > 600
    cases = [f"{c}{c} {c}a{c}1 {c}  {c}'s" for c in plain] + [(t or "")[:20000] for t in texts()] + ["<|endoftext|>", "a<|endoftext|>b <|endoftext|>"]
    for c in cases:
        assert e.ids(c) == t.encode(c, add_special_tokens=False).ids, repr(c[:50])


def test_token_cache(spark, docs, rows, clash, empty):
    t, cache = whole_tokenizer(), fresh(spark, "cache")
    for _ in range(2):
        out = op5.token_counts(clash, cache).collect()
        same([(r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in out], [(d, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for d, x in rows])
        assert op5.read_cache(spark, cache).count() == len({x or "" for _, x in rows})
    more = spark.createDataFrame([(7, "a new text")], "doc_id long, text string")
    assert op5.token_counts(more, cache).count() == 1
    assert op5.read_cache(spark, cache).count() == len({x or "" for _, x in rows}) + 1
    assert op5.token_counts(empty, fresh(spark, "cache")).count() == 0


def test_packing_fills_sequences(spark, docs, rows, clash, empty):
    t = whole_tokenizer()
    out = op6.query(spark, write(spark, clash)).collect()
    want = Counter()
    for d, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids + [0]
        for p, (s, n) in enumerate(op6.cut_points(len(ids), 2048)):
            want[(d, p, s, n, zlib.crc32(np.array(ids[s: s + n], dtype="<u4").tobytes()))] += 1
    same([(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out], list(want.elements()))
    bins = {}
    for r in out:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 2048
    assert len(bins) <= math.ceil(sum(k[3] * c for k, c in want.items()) / 2048) + 1
    assert op6.query(spark, write(spark, empty)).count() == 0


def test_best_two_fit_on_counts():
    # greedy takes 6 and 3, which leaves 1; 2 + 2 fill the place of 3 exactly
    assert op6.fill({6: 1, 3: 1, 2: 2}, 10)[0] == ((6, 2, 2), 1)
    assert op6.fill({5: 7}, 10) == [((5, 5), 3), ((5,), 1)]
    r = np.random.default_rng(1)
    counts = Counter(r.integers(1, 101, 5000).tolist())
    used = Counter()
    bins = 0
    for lengths, times in op6.fill(counts, 100):
        assert sum(lengths) <= 100
        bins += times
        for n in lengths:
            used[n] += times
    assert used == counts and bins <= math.ceil(sum(n * c for n, c in counts.items()) / 100) * 1.01 + 1


def test_sequences_hold_the_ids(spark):
    own = spark.createDataFrame([(1, "some words here"), (2, "others"), (3, None)], "doc_id long, text string")
    parts = op6.keep(op6.pieces(own, capacity=4, with_ids=True), "pieces")
    got = op6.sequences(op6.pack(parts, 4)).collect()
    t = whole_tokenizer()
    all_ids = [i for x in ("some words here", "others", "") for i in t.encode(x, add_special_tokens=False).ids + [0]]
    assert sorted(i for r in got for i in r["ids"]) == sorted(all_ids) and all(len(r["ids"]) <= 4 for r in got)


# ---- 7

def brute_groups(rows, width, percent=80):
    sets = []
    for d, t in rows:
        ws = words_of(t)
        sets.append({tuple(ws[i: i + width]) for i in range(len(ws) - width + 1)} or ({tuple(ws)} if ws else set()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    out = []
    for i, (d, t) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((d, len(sets[i]), (min(ids) if ids else None) if sets[i] else d))
    return out


def test_near_duplicates(spark, docs, rows, clash, empty):
    out = op7.query(spark, write(spark, clash)).collect()
    want = brute_groups(rows, 4)
    same([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in out], want)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)
    assert op7.query(spark, write(spark, empty)).count() == 0
    left = op7.stage(spark, docs, "").collect()
    five = brute_groups(rows, 5)
    roots = {(c, n > 0, None if n else i) for i, (d, n, c) in enumerate(five)}
    assert len(left) == len(roots) and all(r["doc_id"] is None or not words_of(r["text"]) or (r["doc_id"] in {c for _, _, c in five}) for r in left)


def test_near_duplicate_stage_decides_by_text(spark):
    """One id with unrelated texts: neither is lost; copies of either go."""
    a, c = prose(90, 300), prose(90, 301)
    near = c + " tail"
    rows = [(5, a), (5, c), (7, near), (8, a), (5, a), (None, a), (None, prose(90, 302)), (9, None), (9, ""), (9, "")]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], SCHEMA).selectExpr("*", "1 as id", "2 as key", "3 as row", "4 as k1")
    left = op7.stage(spark, docs, "")
    assert left.columns == docs.columns
    same([(x["doc_id"], x["text"]) for x in left.collect()], [(5, a), (5, c), (None, rows[6][1]), (9, None), (9, ""), (9, "")])


def test_large_group_of_near_copies_and_families(spark):
    r = random.Random(9)
    base = prose(80, 40).split()
    rows = []
    for i in range(260):  # edits of one text
        w = list(base)
        for _ in range(r.randrange(3)):
            w[r.randrange(80)] = "e%d" % r.randrange(10**6)
        rows.append((i, " ".join(w)))
    half = prose(60, 41)
    rows += [(1000 + i, half + " " + prose(15 + i % 30, 500 + i)) for i in range(120)]  # a family about the threshold
    out = op7.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 0.8, 4).collect()
    same([(x["id"], x["n_shingles"], x["component_id"]) for x in out], brute_groups(rows, 4))


# ---- 8

def test_pseudo_likelihood(spark, docs, rows, clash, empty):
    own = op8.own_texts(clash)
    voc = op8.vocabulary_of(own)
    out = op8.scores(own, op8.train(own, voc), voc).collect()
    same([(r["doc_id"], r["n_tokens"]) for r in out], [(d, len(words_of(t))) for d, t in rows])
    assert all((r["mean_log_probability"] is None) == (r["n_tokens"] == 0) and r["log_probability"] <= 0 for r in out)
    none = op8.own_texts(empty)
    assert op8.scores(none, op8.train(none, op8.vocabulary_of(none)), op8.vocabulary_of(none)).count() == 0


def brute_scores(texts_, w, voc, counts):
    """Log-probability of every text: class given its neighbours, word given its class."""
    out = []
    for t in texts_:
        words, _ = op8.word_hashes(np.frombuffer(t.encode(), dtype=np.uint8), np.array([0, len(t.encode())]))
        cls, total = op8.classes_of(words, voc), 0.0
        padded = np.concatenate([[voc.own + op8.HASHED] * op8.SIDE, cls, [voc.own + op8.HASHED] * op8.SIDE])
        for i, (h, c) in enumerate(zip(words.tolist(), cls)):
            around = np.delete(padded[i: i + 2 * op8.SIDE + 1], op8.SIDE)
            total += op8.forward(w, around[None, :])[2][0, c]
            if c >= voc.own:
                shared = sum(n for x, n in counts.items() if op8.classes_of(np.array([x], dtype=np.uint64), voc)[0] == c)
                total += np.log((max(counts[h], 1) - 0.5) / max(shared, 1))
        out.append(total)
    return out


@pytest.mark.parametrize("listed", [1 << 16, 500, 0])
def test_scores_are_of_words_not_of_classes(spark, monkeypatch, listed):
    """Every word counts by itself, listed or joined: gibberish falls below the corpus' own rare words of the same classes."""
    monkeypatch.setattr(op8, "LISTED", listed)
    r = random.Random(4)
    texts_ = [" ".join("v%d" % r.randrange(1500) for _ in range(60)) for _ in range(150)]
    own = op8.own_texts(spark.createDataFrame(list(enumerate(texts_)), "doc_id long, text string").repartition(3))
    voc = op8.vocabulary_of(own)
    assert len(voc.words) == voc.own and len(voc.listed) <= listed
    counts = Counter()
    for t in texts_:
        counts.update(op8.word_hashes(np.frombuffer(t.encode(), dtype=np.uint8), np.array([0, len(t.encode())]))[0].tolist())
    assert {(x["word"] % 2**64, x["count"]) for x in voc.counted.collect()} == set(counts.items())
    w = op8.start_weights(classes=voc.own + op8.HASHED)
    ask = texts_[:5] + ["zzq%d never%d seen%d" % (i, i, i) for i in range(3)]
    got = {x["doc_id"]: x["log_probability"] for x in op8.scores(op8.own_texts(spark.createDataFrame(list(enumerate(ask)), "doc_id long, text string")), w, voc).collect()}
    assert np.allclose([got[i] for i in range(len(ask))], brute_scores(ask, w, voc, counts), rtol=1e-4)
    # two words of one class, one counted often and one never
    shared = {"v%d" % i: c for i in range(1500) for h in [op8.word_hashes(np.frombuffer(b"v%d" % i, dtype=np.uint8), np.array([0, len("v%d" % i)]))[0]]
              for c in [int(op8.classes_of(h, voc)[0])] if c >= voc.own and counts[int(h[0])] > 1}
    known, cls = next(iter(shared.items()))
    other = next(g for g in ("g%d" % i for i in range(9999)) if op8.classes_of(op8.word_hashes(np.frombuffer(g.encode(), dtype=np.uint8), np.array([0, len(g)]))[0], voc)[0] == cls)
    pair = {x["doc_id"]: x["log_probability"] for x in op8.scores(op8.own_texts(spark.createDataFrame([(1, known), (2, other)], "doc_id long, text string")), w, voc).collect()}
    assert pair[1] > pair[2] + 1


def test_own_classes_grow_with_the_corpus():
    assert op8.own_classes(0) == op8.FREQUENT
    assert op8.own_classes(2**30) == op8.own_classes(2**29) + op8.OWN


def test_training_learns_order(spark):
    r = random.Random(1)
    ring = ["r%d" % i for i in range(12)]
    rows = [(i, " ".join(ring[(s + j) % 12] for j in range(200))) for i, s in enumerate(r.randrange(12) for _ in range(150))]
    own = op8.own_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(2))
    voc = op8.vocabulary_of(own)
    w = op8.train(own, voc, rounds=25)
    shuffled = [(i, " ".join(r.sample(t.split(), 200))) for i, t in rows[:20]]
    good = np.mean([x["mean_log_probability"] for x in op8.scores(own, w, voc).collect()])
    bad = np.mean([x["mean_log_probability"] for x in op8.scores(op8.own_texts(spark.createDataFrame(shuffled, "doc_id long, text string")), w, voc).collect()])
    assert good > bad + 1 and good > -2


def test_rounds_train_every_place_once():
    r = np.random.default_rng(6)
    lengths = np.array([1, 1, 0, 2, 3, 15, 16, 17, 400, 1])
    borders = np.concatenate([[0], np.cumsum(lengths)])
    words = r.integers(0, 2**63, borders[-1]).astype(np.uint64)
    taken = np.concatenate([op8.training_places(words, borders, turn) for turn in range(op8.ROUNDS)])
    assert sorted(taken.tolist()) == list(range(borders[-1]))
    assert len(op8.training_places(words[:0], np.array([0, 0]), 0)) == 0


def test_production_rounds_learn_order(spark):
    r = random.Random(1)
    ring = ["r%d" % i for i in range(12)]
    rows = [(i, " ".join(ring[(s + j) % 12] for j in range(200))) for i, s in enumerate(r.randrange(12) for _ in range(900))]
    own = op8.own_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(2))
    voc = op8.vocabulary_of(own)
    w = op8.train(own, voc)
    shuffled = [(i, " ".join(r.sample(t.split(), 200))) for i, t in rows[:20]]
    good, bad = (np.mean([x["mean_log_probability"] for x in op8.scores(d, w, voc).collect()])
                 for d in (own, op8.own_texts(spark.createDataFrame(shuffled, "doc_id long, text string"))))
    assert good > bad + 1 and good > -2


def test_gradients_match_differences():
    w = op8.start_weights(3)
    w = {k: v.astype(np.float64) for k, v in w.items()}
    r = np.random.default_rng(2)
    around, target = r.integers(0, op8.CLASSES, (6, 4)), r.integers(0, op8.CLASSES, 6)
    loss = lambda: -op8.forward(w, around)[2][np.arange(6), target].mean()
    after = {k: v.copy() for k, v in w.items()}
    op8.step(after, around, target, 1.0)
    for k, at in (("embed", (int(around[0, 1]), 3)), ("inner", (5, 2)), ("bias", (1,)), ("outer", (4, int(target[0]))), ("base", (int(target[1]),)), ("top", (2, int(target[2]) // op8.GROUP)), ("head", (0,))):
        grad, keep_, e = w[k][at] - after[k][at], w[k][at], 1e-5
        w[k][at] = keep_ + e
        up = loss()
        w[k][at] = keep_ - e
        down = loss()
        w[k][at] = keep_
        assert abs((up - down) / (2 * e) - grad) < 1e-6
    logs = op8.forward(w, around)[2]
    assert np.allclose(np.exp(logs).sum(axis=1), 1)
    assert np.allclose(op8.chosen(w, around, target), logs[np.arange(6), target])
    assert len(op8.chosen(w, around[:0], target[:0])) == 0


# ---- 9

def brute_removed(rows, length=200):
    seen = Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[i: i + length] for i in range(len(b) - length + 1))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i: i + length]] > 1:
                gone[i: i + length] = b"\x01" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def test_repeated_strings_go(spark, docs, rows, clash, empty, monkeypatch):
    short = [r for r in rows if len(r[1] or "") < 20000]
    part = clash.filter("text is null or length(text) < 20000")
    r = random.Random(4)
    p = prose(200, 50)
    more = [(500 + i, prose(5, 600 + i) + p[a: a + 150 + r.randrange(200)] + prose(4, 700 + i)) for i, a in enumerate(r.randrange(600) for _ in range(40))]
    edits = [(600 + i, p[:300] + "#" * i + p[300:420] + "%" * i + p[420:]) for i in range(12)]
    extra = spark.createDataFrame(more + edits, "doc_id long, text string")
    table_ = part.unionByName(extra, allowMissingColumns=True)
    out = op9.query(spark, write(spark, table_)).collect()
    same([tuple(x) for x in out], brute_removed(short + more + edits))
    assert op9.query(spark, write(spark, empty)).count() == 0
    odd = op9.trimmed(docs.selectExpr("*", "1 as k1", "2 as row", "3 as _text", "4 as spans"))
    assert odd.columns == [*docs.columns, "k1", "row", "spans", *op9.ADDED] and odd.count() == len(rows)
    left = op9.stage(spark, docs, "").collect()
    same([x["doc_id"] for x in left], [d for d, _ in rows])
    assert all(x["text"] is None or len(x["text"]) == x["n_chars"] for x in left)


def test_neighbours_in_sorted_buckets_over_borders(spark):
    """Rows of few buckets over many tasks and tiny batches: equal ties are found, every tie of a mixed bucket has a row that stands for it."""
    r = random.Random(8)
    rows = [(r.randrange(4), r.randrange(5) if i % 3 else 9, i % 70) for i in range(300)] + [(7, 1, i) for i in range(60)] + [(8, i, i) for i in range(60)] + [(9, 0, 0)] * 5
    df = spark.createDataFrame(rows, "bucket long, tie long, at long")
    kept = set(rows)
    ties = Counter((b, t) for b, t, _ in kept)
    old = [(k, spark.conf.get(k)) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch")]
    try:
        for parts, batch in ((1, 1), (1, 7), (13, 2), (40, 3)):
            for (k, _), v in zip(old, (parts, "false", batch)):
                spark.conf.set(k, str(v))
            marked = op9.beside(df, "bucket", "tie", ["at"], ["bucket", "tie", "at"]).persist()
            found = [(x["bucket"], x["tie"], x["at"]) for x in op9.settled(marked, "bucket", "tie", ["at"]).collect()]
            assert Counter(found) == Counter(k for k in kept if ties[k[:2]] > 1)
            picked = {(x["bucket"], x["tie"]) for x in marked.filter("pick").collect()}
            assert picked >= {(b, t) for b, t in ties if len({u for c, u in ties if c == b}) > 1}
            marked.unpersist()
    finally:
        for k, v in old:
            spark.conf.set(k, v)


def test_runs_do_not_depend_on_segments(monkeypatch):
    from eccentra.llm.common import Rolling

    t = (prose(900, 60) + prose(900, 61)).encode()
    data, offsets = np.frombuffer(t, dtype=np.uint8), np.array([0, len(t) // 2, len(t)])
    whole = op9.runs_of(data, offsets, Rolling(41), Rolling(42))
    monkeypatch.setattr(op9, "SEGMENT", 1000)
    cut = op9.runs_of(data, offsets, Rolling(41), Rolling(42))
    starts = lambda x: sorted((int(a), int(b) + k) for a, b, n in zip(x[0], x[1], x[2]) for k in range(n))
    assert starts(whole) == starts(cut) and len(starts(whole)) == len(t) - 2 * 199


# ---- 10

def test_archives_round_trip(spark, empty):
    pages = [(i, f"http://h/{i}\r\nX: y", f"<html>page {i % 7} é</html>" * (1 + i % 3)) for i in range(60)] + [(100, None, None), (101, "u", ""), (None, "u", "only here"), (None, "u", "<html>page 1 é</html>"), (59, "again", "x"), (59, "again", "x")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    out = op10.query(spark, write(spark, df.withColumn("archive", F.lit(1)), "pages")).collect()
    last = {}
    for p, _, h in pages:
        if p is not None:
            last[h or ""] = max(last.get(h or "", p), p)
    want = []
    for p, _, h in pages:
        b, to = (h or "").encode(), last.get(h or "")
        rev = to is not None and p != to
        want.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if rev else "response", to if rev else None))
    same([tuple(r) for r in out], want)
    assert op10.query(spark, write(spark, spark.createDataFrame([], "page_id long, url string, html string"), "pages")).count() == 0
    path = fresh(spark, "warc")
    manifest = op10.write_archives(op10.assign(df, least=10**6), path, archive_bytes=400, sample_bytes=100)
    records = op10.read_records(manifest).collect()
    assert {r["record_type"] for r in records} == {"response"} and manifest.count() > 3
    same([r["payload"] for r in records], [(h or "").encode() for _, _, h in pages])


def archive(n=40, dictionary=True):
    records = [op10.record(i, f"http://h/{i}", (f"<p>record {i} and words " * 9).encode(), None, op10.b32(hashlib.sha1((f"<p>record {i} and words " * 9).encode()).digest())) for i in range(n)]
    d = op10.train(records, 2048) if dictionary else b""
    press = op10.compressor(d)
    return op10.skippable(d) + b"".join(press.compress(r) for r in records), records, d


@pytest.mark.parametrize("step", [1, 7, 1 << 20])
def test_reader_needs_its_dictionary_and_keeps_frames_apart(step):
    data, records, d = archive()
    assert d and data[:4] == b"\x5d\x2a\x4d\x18"
    assert [r for _, r in op10.read_archive(io.BytesIO(data), "a", step)] == records
    plain, records, _ = archive(3, dictionary=False)
    assert [r for _, r in op10.read_archive(io.BytesIO(plain), "a")] == records
    assert list(op10.read_archive(io.BytesIO(b""), "a")) == []


def test_reader_rejects_damage():
    data, records, d = archive()
    for bad in (data[:-3], data[: len(data) // 2], data[:5], data[8 + len(d):], data[: 8 + len(d)] + b"junk" + data[8 + len(d):]):
        with pytest.raises(ValueError):
            for _, r in op10.read_archive(io.BytesIO(bad), "a"):
                op10.parse(r, "a")
    r = records[0]
    for bad in (r.replace(b"WARC/1.1", b"WARX/1.1"), r[:-1], r.replace(b"record 0", b"record 9"), r.replace(b"WARC-Date:", b"WARC-Gate:"), r.replace(b"Content-Length: ", b"Content-Length: 1", 1)):
        with pytest.raises(ValueError):
            op10.payload_of(*op10.parse(bad, "a"), "a")


# ---- pipeline

def test_pipeline_keeps_columns_and_runs(spark, docs):
    import corpus_pipeline

    own, labels, bad = quality_tables(spark, 300)
    leak = prose(40, 900)
    more = spark.createDataFrame([(5000, prose(40, 901) + " " + leak, "en", "s", 1), (5001, prose(60, 2), "en", "s", 1), (5002, prose(60, 2), "en", "s", 1)], SCHEMA)
    path = write(spark, own.unionByName(more), labels=labels, benchmark=spark.createDataFrame([(1, leak)], "item_id long, text string"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "suffix_dedup", "decontamination", "packing"]
    d = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = op6.keep(stage(spark, d, path), name)
        assert d.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = {r["doc_id"] for r in d.collect()}
    assert 5000 not in ids and len(ids & {2, 5001, 5002}) == 1 and len(ids & bad) < 5
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, path).collect()} == ids


def test_binary_search_over_cuts(spark):
    import bisect

    for n in (0, 1, 2, 5, 64, 77):
        cuts = [3 * k for k in range(n)]
        got = spark.range(-3, 3 * n + 3).select("id", op2.not_above(F.col("id"), cuts).alias("k")).collect()
        assert all(r["k"] == bisect.bisect_right(cuts, r["id"]) for r in got)
