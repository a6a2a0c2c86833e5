"""Packing: how many of the ten best neighbours in the whole corpus a seed is offered, and that the tier's scores are BM25."""

import numpy as np
import pytest

from fotolith.llm import packing as p
from fotolith.llm.common import Scratch, table
from fotolith.llm.queries import vocabulary

PATH = vocabulary("byte_bpe_50k.json")
SEEDS, K = 200, 10


@pytest.fixture(scope="module")
def corpus(spark):
    """All documents of 10,000 as tokens; the plain scores of ``SEEDS`` of them."""
    docs = table(spark, "/root/testdata/sf0.1", "documents")
    made = Scratch(spark, "recall").write(p.tokenise(docs, PATH).where("ids is not null"), "tokens")
    rows = made.orderBy("key", "row").collect()
    own = [np.frombuffer(r["ids"], "<u2").astype(np.int64) for r in rows]
    parts = [np.unique(d, return_counts=True) for d in own]
    df = np.bincount(np.concatenate([t for t, _ in parts]), minlength=50_257)
    idf, mean = np.log(1 + (len(own) - df + 0.5) / (df + 0.5)), float(np.mean([len(d) for d in own]))
    term, doc = np.concatenate([t for t, _ in parts]), np.repeat(np.arange(len(own)), [len(t) for t, _ in parts])
    tf, size = np.concatenate([c for _, c in parts]), np.array([len(d) for d in own])[doc]
    weight = idf[term] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))
    seeds = np.random.default_rng(1).choice(len(own), SEEDS, replace=False)
    scores = np.empty((SEEDS, len(own)))
    for k, s in enumerate(seeds):
        asked = np.zeros(len(df))
        asked[parts[s][0]] = 1
        scores[k] = np.bincount(doc, weight * asked[term], len(own))
        scores[k, s] = -1
    return made, rows, own, idf, mean, seeds, scores


def test_seeds_are_offered_their_best_neighbours(corpus):
    made, rows, own, idf, mean, seeds, scores = corpus
    tier = p.make_tier(made, idf, mean)
    held = set(tier.rows.tolist())
    assert len(held) <= p.TIER_DOCS and int(tier.starts[-1]) <= p.TIER_POSTINGS
    shard = np.arange(len(rows)) // p.SHARD_DOCS
    best = np.argsort(-scores, axis=1, kind="stable")[:, :K]
    alone = np.mean([shard[b] == shard[s] for b, s in zip(best, seeds)])
    recall = np.mean([[shard[x] == shard[s] or rows[x]["row"] in held for x in b] for b, s in zip(best, seeds)])
    print(f"recall@10: {recall:.3f}, of the shard alone {alone:.3f}")
    assert recall >= 0.9


def test_the_tier_scores_by_the_formula(corpus):
    made, rows, own, idf, mean, seeds, scores = corpus
    tier = p.make_tier(made, idf, mean)
    at = {r["row"]: k for k, r in enumerate(rows)}
    columns = [at[r] for r in tier.rows.tolist()]
    got = tier.scores([own[s] for s in seeds])
    want = scores[:, columns].clip(0)
    got[np.array(seeds)[:, None] == np.array(columns)[None, :]] = 0
    np.testing.assert_allclose(got, want, rtol=1e-4, atol=1e-3)


def test_each_tier_document_goes_to_the_seed_that_scores_highest(corpus):
    made, rows, own, idf, mean, seeds, _ = corpus
    tier = p.make_tier(made, idf, mean)
    got = {r["row"]: r["seed"] for r in p.moved(made, tier).collect()}
    every = np.array([r["row"] for r in rows])
    scores = np.vstack([tier.scores(own[a : a + 500]) for a in range(0, len(own), 500)])
    scores[every[:, None] == tier.rows[None, :]] = 0
    scores[scores < np.partition(scores, scores.shape[1] - p.BEST, axis=1)[:, scores.shape[1] - p.BEST, None]] = 0
    for k, row in enumerate(tier.rows.tolist()):
        top = float(scores[:, k].max())
        assert (row in got) == (top > 0)
        if top > 0:
            assert float(scores[np.flatnonzero(every == got[row])[0], k]) >= top * (1 - 1e-4)
