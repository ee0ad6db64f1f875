"""Tests of the sixth round's findings: memory of Python workers, steps of the window network."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from eccentra.llm import common, op8_pseudo_likelihood as op8, op9_suffix_dedup as op9


def most_allocated(work) -> float:
    """Peak MB of numpy's and Python's allocations."""
    work()  # tables of powers are made once
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_runs_and_hashes_take_little_memory():
    """Of many short texts or of a long one: before, 59 MB for the runs and 23 MB for the hashes."""
    letters = np.random.default_rng(1).integers(97, 123, 3 << 20, dtype=np.uint8)
    letters[::6] = 32
    text = letters.tobytes().decode()
    short = pa.RecordBatch.from_pydict({"text": [text[i: i + 3000] for i in range(0, len(text), 3000)], "k1": range(-(-len(text) // 3000)), "k2": range(-(-len(text) // 3000))})
    one, two = common.Rolling(41), common.Rolling(42)

    def runs(batch):
        for _, _, data, offsets in common.text_chunks(batch, limit=op9.SEGMENT):
            op9.runs_of(data, offsets, one, two)

    whole = pa.RecordBatch.from_pydict({"text": [text[: 1 << 20]]})
    assert most_allocated(lambda: runs(short)) < 20
    assert most_allocated(lambda: runs(whole)) < 25
    data = letters[: 1 << 20]
    assert most_allocated(lambda: common.word_hashes(data, np.array([0, len(data)]))) < 16


def test_batches_of_texts_are_small(spark, tmp_path):
    """In a step's last write too, which is made by others: before, all 3,000 rows (12 MB) at once."""
    spark.range(3000).selectExpr("id as doc_id", "repeat('abcd', 1000) as text").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    got = [r["n"] for r in common.table(spark, str(tmp_path), "documents").coalesce(1).mapInArrow(sizes, "n long").collect()]
    assert sum(got) >= 12e6 and max(got) < 3e6


def plain_step(w, around, target, rate):
    """One gradient step, written out class by class."""
    n, g = len(target), op8.GROUP
    x = w["embed"][around].reshape(n, -1)
    h = np.tanh(x @ w["inner"] + w["bias"])
    own = np.exp(op8.forward(w, around)[2])
    groups = np.stack([own[:, i: i + g].sum(axis=1) for i in range(0, own.shape[1], g)], axis=1)
    top = groups.copy()
    top[np.arange(n), target // g] -= 1
    inside = (np.arange(own.shape[1]) // g)[None, :] == (target // g)[:, None]
    z = np.where(inside, own / groups[np.arange(n), target // g][:, None], 0)
    z[np.arange(n), target] -= 1
    back = (top @ w["top"].T + z @ w["outer"].T) * (1 - h**2) / n
    inputs = (back @ w["inner"].T).reshape(*around.shape, -1)
    w["top"] -= rate * h.T @ top / n
    w["head"] -= rate * top.mean(axis=0)
    w["outer"] -= rate * h.T @ z / n
    w["base"] -= rate * z.mean(axis=0)
    w["inner"] -= rate * x.T @ back
    w["bias"] -= rate * back.sum(axis=0)
    np.subtract.at(w["embed"], around, rate * inputs)


@pytest.mark.parametrize("classes", [op8.CLASSES, 450])
def test_steps_of_many_batches_are_those_of_one_after_the_other(classes):
    r = np.random.default_rng(5)
    around, target = r.integers(0, classes + 1, (700, 4)), r.integers(0, classes, 700) * (np.arange(700) % 3 > 0)
    many, one = ({k: v.astype(np.float64) for k, v in op8.start_weights(3, classes).items()} for _ in range(2))
    op8.steps(many, around, target, 0.5, 256)
    for lo in range(0, 700, 256):
        plain_step(one, around[lo: lo + 256], target[lo: lo + 256], 0.5)
    assert all(np.allclose(many[k], one[k], atol=1e-9) for k in one)


@pytest.mark.parametrize("most", [1, 60, 200, 3000])
def test_logits_beyond_the_range_of_numbers(most):
    r = np.random.default_rng(6)
    w = op8.start_weights(3, 450)
    w["base"], w["head"] = r.uniform(-most, most, 450).astype(np.float32), r.uniform(-most, most, 4).astype(np.float32)
    around, target = r.integers(0, 450, (600, 4)), r.integers(0, 450, 600)
    want = op8.forward({k: v.astype(np.float64) for k, v in w.items()}, around)[2][np.arange(600), target]
    assert np.allclose(op8.chosen(w, around, target), want, rtol=1e-4, atol=1e-4)
    op8.steps(w, around, target, 0.5, 256)
    assert all(np.isfinite(v).all() for v in w.values())
