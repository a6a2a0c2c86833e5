"""Quality classifier over random-indexing word vectors.

Words are the pieces of the pre-tokeniser. Each piece has a word (its lower-case
form) and a shape (kind, case, length, first sign), so that unseen words still
say something. Random indexing gives every word and every shape a sparse ternary
index vector, drawn from a 64-bit hash of its own: no table, no vocabulary, no two
words in one slot. The vector of a word that the sample holds ``MIN_COUNT`` times or
more is its index vector plus the normalised sum of the index vectors around it;
other words have their index vector alone. A document is the mean of its
pieces' vectors with its length, its variety and the share of pieces that repeat the
piece before; a two-layer network gives a logit,
divided by a temperature that is fitted on rows the network has not seen.

The model is fitted in one task on a bounded sample of labelled rows
(``MAX_SAMPLE`` texts of at most ``MAX_SAMPLE_CHARS`` code points, the least by a
hash of their id); scoring is one pass over all whole texts. Nothing but the text
enters a score.

Defined results: null and empty texts are scored as texts without words; rows
without id are scored and never learnt from; null labels and held-out rows are
not learnt from; a document labelled both ways counts as good; without labels
of both kinds, or over empty tables, the model is neutral and gives the share of
good labels (0.5 without any). Repeated rows give repeated results; extra columns
are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fotolith.llm.bpe import chunks, different
from fotolith.llm.common import for_a_stage, prepare, tidied
from fotolith.llm.rules import _mix

#: Dimensions of the vectors, non-zero entries of an index vector.
DIMS, NONZERO = 48, 8
#: Features of a document: its vector, length, variety, repetition.
WIDTH = DIMS + 3
#: Pieces whose words and shapes a worker remembers.
CACHE_ENTRIES = 200_000
#: Occurrences in the sample from which on a word has a context.
MIN_COUNT = 5
#: Neighbours on either side that count as context.
CONTEXT = 2
#: Bound of the sample that the model is fitted on.
MAX_SAMPLE, MAX_SAMPLE_CHARS = 3000, 100_000
HIDDEN, EPOCHS, RATE, DECAY, SEED = 32, 400, 0.02, 1e-4, 7
#: Every so many sample rows are kept for the temperature.
CALIBRATION = 5
#: Held out are the rows whose crc32(id as text) leaves 0 modulo this.
FOLDS = 5
ACCEPT = 0.3


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS == 0, F.lit(False))


def names_of(piece: str) -> tuple[int, int]:
    """64-bit hashes of a piece's word and of its shape."""
    word = piece.strip(" ")
    if not word or word.isspace():
        shape = f"space{min(piece.count(chr(10)), 2)}"
        return xxhash.xxh64_intdigest(shape), xxhash.xxh64_intdigest(shape, 1)
    first, n = word[0], len(word)
    size = min(n.bit_length(), 4)
    if first.isalpha() or (n > 1 and first == "'"):
        case = "U" if n > 1 and word.isupper() else "T" if first.isupper() else "l" if word.islower() else "m"
        shape = f"a{case}{size}"
    elif first.isnumeric():
        shape = f"n{size}"
    else:
        shape = f"s{first}{min(n, 3)}"
    return xxhash.xxh64_intdigest(word.lower().encode("utf-8", "surrogatepass")), xxhash.xxh64_intdigest(shape.encode("utf-8", "surrogatepass"), 1)


class Names(dict):
    """piece -> its hashes, bounded: it starts anew when full."""

    def __missing__(self, piece: str) -> tuple[int, int]:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        self[piece] = found = names_of(piece)
        return found


_names = Names()
for_a_stage(_names.clear)


@dataclass
class Pieces:
    """The pieces of some texts: hashes of the different ones, the number of each in order, and how many each text has."""

    words: np.ndarray
    shapes: np.ndarray
    number: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, texts: list[str]) -> Pieces:
        found, number, counts = different(texts)
        both = np.array(list(map(_names.__getitem__, found)), np.uint64).reshape(-1, 2)
        return cls(both[:, 0].copy(), both[:, 1].copy(), number, counts)

    @property
    def text(self) -> np.ndarray:
        """The text of each piece."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


def index_vectors(names: np.ndarray) -> np.ndarray:
    """The sparse ternary index vector of each hash, of length one or so."""
    out = np.zeros((len(names), DIMS), np.float32)
    rows = np.arange(len(names))
    for k in range(NONZERO):
        # Each entry has its own share of the dimensions, so none falls on another.
        draw = _mix(names + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        share = DIMS // NONZERO
        out[rows, k * share + ((draw >> np.uint64(8)) % np.uint64(share)).astype(np.int64)] = np.where(draw & np.uint64(1), 1, -1)
    return out / np.float32(np.sqrt(NONZERO))


def contexts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, of the words and shapes that the texts hold ``MIN_COUNT`` times or more, and the normalised sums of the index vectors around them."""
    parts = [Pieces.of(part) for part in chunks(texts)]
    every = [np.zeros(0, np.uint64), *(x[p.number] for p in parts for x in (p.words, p.shapes))]
    names, counts = np.unique(np.concatenate(every), return_counts=True)
    names = names[counts >= MIN_COUNT]
    around = np.zeros((len(names), DIMS), np.float32)
    for p in parts:
        text = p.text
        for own in (p.words, p.shapes):
            place = np.searchsorted(names, own)
            known = place < len(names)
            known[known] = names[place[known]] == own[known]
            vectors = index_vectors(own)
            place, known = place[p.number], known[p.number]
            for gap in range(1, CONTEXT + 1):
                left, right = np.arange(len(text) - gap), np.arange(gap, len(text))
                for x, y in ((left, right), (right, left)):
                    at = np.flatnonzero((text[x] == text[y]) & known[x])
                    if not len(at):
                        continue
                    at = at[np.argsort(place[x[at]], kind="stable")]
                    starts = np.flatnonzero(np.diff(place[x[at]], prepend=-1))
                    around[place[x[at]][starts]] += np.add.reduceat(vectors[p.number[y[at]]], starts, axis=0)
    size = np.linalg.norm(around, axis=1, keepdims=True)
    return names, around / np.where(size > 0, size, 1)


@dataclass
class Model:
    names: np.ndarray
    contexts: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def vectors(self, names: np.ndarray) -> np.ndarray:
        """The vector of each word or shape."""
        out = index_vectors(names)
        if len(self.names):
            place = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
            known = np.flatnonzero(self.names[place] == names)
            out[known] += self.contexts[place[known]]
        return out

    def features(self, texts: list[str]) -> np.ndarray:
        out = [np.zeros((0, WIDTH), np.float32)]
        for part in chunks(texts):
            p = Pieces.of(part)
            n, total, text = len(p.counts), np.maximum(p.counts, 1).astype(np.float32), p.text
            pooled, variety, again = np.zeros((n, DIMS), np.float32), np.zeros(n), np.zeros(n)
            if len(text):
                vectors = self.vectors(p.words) + self.vectors(p.shapes)
                some = np.flatnonzero(p.counts)
                starts = (np.cumsum(p.counts) - p.counts)[some]
                pooled[some] = np.add.reduceat(vectors[p.number], starts, axis=0)
                word, _ = pd.factorize(p.words)
                seen = pd.unique(text * len(word) + word[p.number])
                variety = np.bincount(seen // len(word), minlength=n) / np.sqrt(total)
                again = np.bincount(text[1:][(p.number[1:] == p.number[:-1]) & (text[1:] == text[:-1])], minlength=n) / total
            out.append(np.column_stack([pooled / total[:, None], np.log1p(p.counts), variety, again]).astype(np.float32))
        return np.concatenate(out)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.spread @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, texts: list[str]) -> np.ndarray:
        return sigmoid(self.logits(self.features(texts)).astype(np.float64) / self.temperature)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def fit(texts: list[str], labels: list[int]) -> Model:
    """The model of labelled texts; see the module for too few labels."""
    width = WIDTH
    y = np.array(labels, np.float64)
    share = float(y.mean()) if len(y) else 0.5
    neutral = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))) if len(y) else 0.0
    model = Model(
        *contexts(texts), np.zeros(width, np.float32), np.ones(width, np.float32), np.zeros((width, HIDDEN), np.float32),
        np.zeros(HIDDEN, np.float32), np.zeros(HIDDEN, np.float32), neutral, 1.0,
    )
    test = np.arange(len(y)) % CALIBRATION == CALIBRATION - 1
    if len(set(y[~test])) < 2:
        return model
    x = model.features(texts)
    model.mean, model.spread = x.mean(axis=0), x.std(axis=0) + 1e-3
    z = ((x - model.mean) / model.spread).astype(np.float64)
    zt, yt = z[~test], y[~test]
    rng = np.random.default_rng(SEED)
    p = [rng.normal(0, 1 / np.sqrt(width), (width, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for step in range(1, EPOCHS + 1):
        h = np.tanh(zt @ p[0] + p[1])
        d = (sigmoid(h @ p[2] + p[3]) - yt) / len(yt)
        back = np.outer(d, p[2]) * (1 - h * h)
        grads = [zt.T @ back + DECAY * p[0], back.sum(axis=0), h.T @ d + DECAY * p[2], np.array([d.sum()])]
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            p[i] = p[i] - RATE * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    model.w1, model.b1, model.w2, model.b2 = p[0].astype(np.float32), p[1].astype(np.float32), p[2].astype(np.float32), float(p[3][0])
    held = test if test.any() else ~test
    logit = model.logits(x[held]).astype(np.float64)
    grid = np.exp(np.linspace(np.log(0.5), np.log(8), 60))
    loss = [-np.mean(y[held] * np.log(sigmoid(logit / t) + 1e-9) + (1 - y[held]) * np.log(1 - sigmoid(logit / t) + 1e-9)) for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    return model


def sampled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``text, quality``: at most MAX_SAMPLE texts to learn from, in a fixed order, in one partition."""
    known = labels.where("quality in (0, 1) and doc_id is not null").where(~held_out())
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = known.withColumn("place", F.xxhash64("doc_id")).orderBy("place", "doc_id").limit(MAX_SAMPLE)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")
    texts = texts.where(F.length("text") <= MAX_SAMPLE_CHARS).orderBy("place", "doc_id", "text").limit(MAX_SAMPLE)
    return texts.select("text", F.col("quality").cast("int").alias("quality"))


def sample(docs: DataFrame, labels: DataFrame) -> tuple[list[str], list[int]]:
    """The texts and labels that are learnt from."""
    rows = sampled(docs, labels).collect()
    return [r[0] for r in rows], [r[1] for r in rows]


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on the labelled rows of ``docs(doc_id, text)`` that are not held out: one task, which sends the model."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[str] = []
        marks: list[int] = []
        for batch in batches:
            texts += batch.column(0).to_pylist()
            marks += batch.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(texts, marks))], pa.binary())], names=["model"])

    found = sampled(docs, labels).mapInArrow(tidied(run), "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else fit([], [])


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """All columns of ``docs`` and ``out``, the probability of a good label; a column of that name is replaced."""
    spark = prepare(docs.sparkSession)
    docs = docs.drop(out)
    at = docs.columns.index(text_col)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shared.value.scores([t or "" for t in batch.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=[*batch.schema.names, out])

    return docs.mapInArrow(tidied(run), T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))
