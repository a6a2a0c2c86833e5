"""Hard negatives against brute force; the bounds; edges."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fotolith.llm import bitslice, negatives
from fotolith.llm.common import Scratch


def brute(rows, every: int, k: int = 5):
    """Rows of ``(vec_id, label, vector)`` as the operator gives them, with plain integers."""
    use = []
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        use.append((i, label, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for i, label, v in use:
        if i % every:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j, other) for j, other, w in use if j != i]
        for s, j, _ in sorted(x for x in scored if x[2] == label)[:k]:
            hard = sorted(x for x in scored if x[2] != label and 80 * -s <= 100 * -x[0] <= 100 * -s)[:k]
            out += [(i, j, r, h[1], -s, -h[0]) for r, h in enumerate(hard, 1)]
    return sorted(out)


def found(df):
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def made(spark, rows, extra=()):
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    return frame.select("*", *(F.lit(1).alias(c) for c in extra))


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(4, 24))
    rows = [(i, int(rng.integers(4)), (centres[rng.integers(4)] + 0.4 * rng.normal(size=24)).astype(np.float32).tolist()) for i in range(400)]
    rows += [(400 + i, rows[i][1], rows[20][2]) for i in range(30)]  # ties
    return rows


def test_blocks_against_brute_force(spark, clustered, monkeypatch):
    """Many blocks and steps, one label with a third and more of the rows, nulls, repeats, vectors of several lengths."""
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 64)
    monkeypatch.setattr(negatives, "BLOCK_ANCHORS", 7)
    monkeypatch.setattr(negatives, "AT_ONCE", 3)
    monkeypatch.setattr(negatives, "VERIFY", 50)
    rows = [(i, 0 if i % 2 else label, v) for i, label, v in clustered]
    odd = [(1000, None, rows[0][2]), (1010, 1, None), (None, 1, rows[0][2]), (1020, 1, [None] * 24), (1030, 1, [math.nan] * 24), (1040, 1, [math.inf] + [0.0] * 23)]
    odd += [(1050, 2, [1.0, 2.0]), (1060, 2, []), (1070, 2, [0.0] * 24), (3, 1, rows[5][2])]
    frame = made(spark, rows + odd, ("id", "v", "block", "rank", "score")).repartition(5)
    assert found(negatives.mine(frame, F.col("vec_id") % 10 == 0, Scratch(spark, "neg"))) == brute(rows + odd, 10)


def test_pruning_is_real_and_loses_nothing(clustered):
    whole = np.array([[math.floor(256 * x) for x in v] for _, _, v in clustered], np.int64)
    moments = whole.astype(float).T @ whole
    turn = np.linalg.eigh(moments)[1][:, ::-1]
    ids = np.arange(len(whole))
    rows = negatives.Rows(len(whole), 24, ids.tobytes(), (ids * 0).tobytes(), whole.tobytes(), turn)
    q = rows.take(ids[:40])
    i, j, score = negatives.search(q, rows, 5, q.ids[:, None] != rows.ids[None, :], *negatives.open_bounds(40))
    verified = len(i)
    best = negatives.best_of(i, rows.ids[j], score, 5)
    j = j[best]
    exact = q.whole @ whole.T
    np.fill_diagonal(exact, -(2**62))
    want = np.lexsort((np.broadcast_to(ids, exact.shape), -exact))[:, :5]
    assert np.array_equal(j.reshape(40, 5), want)
    assert verified < 40 * len(whole) / 4


def test_empty_few_and_negative_scores(spark):
    mine = lambda rows: found(negatives.mine(made(spark, rows), F.col("vec_id") % 10 == 0, Scratch(spark, "neg")))
    assert mine([]) == []
    assert mine([(0, 1, [1.0])]) == []
    assert mine([(0, 1, [1.0]), (1, 1, [1.0]), (2, 2, [0.9]), (3, 2, [0.5]), (4, 2, [1.5])]) == brute([(0, 1, [1.0]), (1, 1, [1.0]), (2, 2, [0.9]), (3, 2, [0.5]), (4, 2, [1.5])], 10)
    below = [(0, 1, [1.0]), (1, 1, [-1.0]), (2, 2, [-0.9])]
    assert mine(below) == brute(below, 10) == []
    zero = [(0, 1, [1.0, 0.0]), (1, 1, [0.0, 1.0]), (2, 2, [0.0, 2.0]), (3, 2, [0.0, 0.5])]
    assert mine(zero) == brute(zero, 10) != []


def test_long_vectors_are_an_error(spark):
    with pytest.raises(Exception, match="too long for 64-bit scores"):
        negatives.mine(made(spark, [(0, 1, [1e30]), (1, 1, [1.0])]), F.col("vec_id") % 10 == 0, Scratch(spark, "neg")).collect()


def test_long_vectors_are_an_error_of_the_bit_sliced_index_too(spark):
    rows = made(spark, [(0, 1, [1e30]), (1, 1, [1.0])])
    with pytest.raises(Exception, match="too long for 64-bit scores"):
        bitslice.top_k(rows, rows, 5, Scratch(spark, "test")).collect()
    # Just below, scores are exact.
    rows = made(spark, [(0, 1, [2.0**23, 0.0]), (1, 1, [2.0**23, 1.0]), (2, 1, [-(2.0**23), 1.0])])
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in bitslice.top_k(rows, rows, 5, Scratch(spark, "test")).collect()}
    assert got[0, 1] == 2**62 and got[0, 2] == -(2**62) and got[1, 2] == 2**16 - 2**62
