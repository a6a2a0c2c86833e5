"""The classifier's vectors, features and scores against versions that go word by word."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import regex

from fotolith.llm import quality as q
from tests.llm.test_operators import prose

MASK = (1 << 64) - 1


def mix(x: int) -> int:
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def index_vector(name: int) -> np.ndarray:
    """One entry of plus or minus one in each of ``NONZERO`` shares of the dimensions, then length one."""
    out = np.zeros(q.DIMS)
    share = q.DIMS // q.NONZERO
    for k in range(q.NONZERO):
        draw = mix(name + (k + 1) * 0x9E3779B97F4A7C15 & MASK)
        out[k * share + (draw >> 8) % share] = 1 if draw & 1 else -1
    return out / math.sqrt(q.NONZERO)


def pieces(text: str) -> list[tuple[int, int]]:
    return [q.names_of(x) for x in regex.findall(public_tokenizers.PATTERN, text)]


def plain_contexts(texts):
    """Of each word and shape the sum of the index vectors, each kind among its own, of its neighbours on both sides."""
    count, total = Counter(), defaultdict(lambda: np.zeros(q.DIMS))
    for text in texts:
        found = pieces(text)
        for kind in (0, 1):
            own = [p[kind] for p in found]
            count.update(own)
            for i, name in enumerate(own):
                for j in range(max(0, i - q.CONTEXT), min(len(own), i + q.CONTEXT + 1)):
                    if j != i:
                        total[name] += index_vector(own[j])
    out = {}
    for name, n in count.items():
        if n >= q.MIN_COUNT:
            size = np.linalg.norm(total[name])
            out[name] = total[name] / (size if size > 0 else 1)
    return out


def plain_features(text, known):
    found = pieces(text)
    n = max(len(found), 1)
    pooled = np.zeros(q.DIMS)
    for pair in found:
        for name in pair:
            pooled += index_vector(name) + known.get(name, 0)
    again = sum(a == b for a, b in zip(regex.findall(public_tokenizers.PATTERN, text), regex.findall(public_tokenizers.PATTERN, text)[1:]))
    return np.array([*(pooled / n), math.log1p(len(found)), len({w for w, _ in found}) / math.sqrt(n), again / n])


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(6)
    good = [f"{prose(rng, rng.randint(5, 60)).capitalize()}. It's 12 of\n\n{prose(rng, 9)}!" for _ in range(30)]
    bad = [" ".join(rng.choice(["BUY", "now", "$$$", "!!!", "click click", "99"]) for _ in range(rng.randint(5, 60))) for _ in range(30)]
    return [*good, *bad, "", "a", "  \n "], [1] * 30 + [0] * 33


def test_contexts(corpus):
    names, vectors = q.contexts(corpus[0])
    want = plain_contexts(corpus[0])
    assert names.tolist() == sorted(want)
    np.testing.assert_allclose(vectors, np.array([want[n] for n in names.tolist()]), atol=1e-4)


def test_features_and_scores(corpus):
    texts, labels = corpus
    model = q.fit(texts, labels)
    known = plain_contexts(texts)
    want = np.array([plain_features(t, known) for t in texts])
    np.testing.assert_allclose(model.features(texts), want, atol=1e-3)
    z = (want - model.mean) / model.spread
    hidden = np.tanh(z @ model.w1 + model.b1)
    plain = 1 / (1 + np.exp(-(hidden @ model.w2 + model.b2) / model.temperature))
    np.testing.assert_allclose(model.scores(texts), plain, atol=1e-2)
    assert ((model.scores(texts) >= q.ACCEPT) == np.array(labels)).mean() > 0.95
