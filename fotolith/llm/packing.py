"""Lexical retrieval packing of documents into fixed windows.

Texts become token ids by a ``tokenizers`` file, with a separator id at the end
of each document. Documents are dealt by a lexical key (``Dealer``), so that similar
ones lie side by side, and cut into shards, bounded runs of that order. Each shard has
an inverted index, term = token id, scored by BM25 with document frequencies and mean
length counted over the whole corpus; the frequencies are one number for each id
of the vocabulary, which bounds what is sent to the executors. A window starts with
a seed document; while it has room, the index is asked with all terms of the seed
and returns its best unused neighbours, which fill the window greedily. The
document that crosses a window's end is cut there, and its rest seeds the next
window. Where no neighbour is left, the next unused document of the shard follows.
A shard's last open window goes on into the partition's next shard. What is left
at the end of a partition is cut into sequences whose lengths are powers of two,
which need no padding; so nothing is padded.

A seed asks more than its own shard. Whole documents ask, so what scores best in the whole corpus are
its longest documents, wherever they lie; those form a tier, an index of bounded size that every
document asks before shards are cut. Of the documents that have a tier document among their
``BEST`` there, the one that scores highest gets it: it is dealt to that seed's shard, right after
the seed. Scores in a shard and in the tier are exact; how many of the best
neighbours in the whole corpus they hold is in the README.

Defined results: null and empty texts are a lone separator; a null doc_id stays
null; repeated rows are documents of their own; an empty table gives no rows;
extra columns are not read. Texts of any length are cut over as many windows as
they need.
"""

from __future__ import annotations

import json
import os
import pickle
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fotolith.llm.bpe import SPACE, chunks, classes, cut, piece_names, ship_file
from fotolith.llm.common import Scratch, for_a_stage, partitions, prepare, tidied

#: BM25's usual constants.
K1, B = 1.2, 0.75
#: A shard ends at so many documents or tokens.
SHARD_DOCS, SHARD_TOKENS = 1024, 1 << 20
#: Documents of a shard from which on a term's postings are a column; postings that are met at a time.
FREQUENT, STEP = 32, 1 << 15
#: The tier: its documents, and the postings that they may have together (six bytes each, sent to the executors); best ones of it that a seed counts.
TIER_DOCS, TIER_POSTINGS, BEST = 1024, 1 << 22, 10
#: Sample that the dealing is fitted on; means, dimensions and rounds of the fit.
SAMPLE_DOCS, SAMPLE_CHARS, CENTROIDS, DIMS, ROUNDS = 2048, 20_000, 256, 64, 10
#: Fixed value: the split pattern of byte-level files, which ``boundaries`` implements.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces that the cache holds before it starts anew.
CACHE_ENTRIES = 1_000_000
#: Pieces that the tokenizer is given at a time.
MISSES = 8192

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def byte_letters() -> dict[str, int]:
    """The letters that byte-level files write for bytes: printable Latin-1 signs stand for themselves, the rest follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def merger(path: str) -> tiktoken.Encoding | None:
    """A faster merger of the same file, if its ids stand in the order of its merges.

    Pair merging then takes the pair of least id, which is what a rank
    vocabulary does; its pieces have the ids that the file's own model gives.
    """
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, split = file.get("model", {}), file.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or file.get("normalizer"):
        return None
    letters, vocab = byte_letters(), model["vocab"]
    if not letters.keys() <= vocab.keys() or model.get("dropout") or model.get("ignore_merges"):
        return None
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    made = [vocab.get(a + b, -1) for a, b in pairs]
    if any(x >= y for x, y in zip(made, made[1:])) or (made and made[0] <= max(vocab[c] for c in letters)):
        return None
    words = [*letters, *(a + b for a, b in pairs)]
    ranks = {bytes(letters[c] for c in w): vocab[w] for w in words}
    return tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


class TokenCache:
    """Ids of texts by a ``tokenizers`` file; each different piece is encoded once.

    The file's byte-level pre-tokeniser splits exactly at ``boundaries``, so a piece
    has the same ids alone as inside its text. Pieces are known by a 64-bit hash of
    their bytes; the cache is a sorted array of hashes beside one array of ids, and
    starts anew when it is full. A text that holds one of the file's special
    tokens is encoded as a whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.size = self.tokenizer.get_vocab_size()
        self.merger = merger(path)
        line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        #: The id of a line break, if it has one of its own.
        self.newline = line[0] if len(line) == 1 else None
        self.clear()

    def clear(self) -> None:
        self.names, self.starts, self.sizes = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, self.kind)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _lines(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids, one after another, and their number for pieces without white space but a space before them: lines of one text."""
        own = sizes + 1
        ends = np.cumsum(own)
        text = raw[np.arange(ends[-1]) + np.repeat(starts - 1 - (ends - own), own)]
        text[ends - own] = ord("\n")
        text = text.tobytes().decode("utf-8", "surrogatepass")
        ids = self.merger.encode_to_numpy(text, disallowed_special=()).astype(self.kind) if self.merger else self._whole([text])[0]
        at = np.flatnonzero(ids == self.newline)
        if len(at) != len(sizes):
            return None
        return ids[ids != self.newline], np.diff(at, append=len(ids)) - 1

    def _encode(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces of ``raw``, one after another, and their number; ``plain``: not white space."""
        if self.newline is None:
            plain = np.zeros(len(plain), bool)
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        made, counts = [], []
        for k in range(0, int(plain.sum()), MISSES):
            some = order[k : min(k + MISSES, int(plain.sum()))]
            found = self._lines(raw, starts[some], sizes[some])
            if found is None:
                alone = self._whole([raw[a : a + n].tobytes().decode("utf-8", "surrogatepass") for a, n in zip(starts[some].tolist(), sizes[some].tolist())])
                found = np.concatenate(alone), np.fromiter(map(len, alone), np.int64, len(alone))
            made.append(found[0])
            counts.append(found[1])
        rest = order[int(plain.sum()) :]
        alone = self._whole([raw[a : a + n].tobytes().decode("utf-8", "surrogatepass") for a, n in zip(starts[rest].tolist(), sizes[rest].tolist())]) if len(rest) else []
        ids = np.concatenate([*made, *alone]) if made or alone else np.zeros(0, self.kind)
        size = np.concatenate([*counts, np.fromiter(map(len, alone), np.int64, len(alone))]).astype(np.int64)
        where = np.cumsum(size) - size
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return ids, np.stack([where[back], size[back]])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for part in chunks(texts):
            odd = [i for i, t in enumerate(part) if any(s in t for s in self.specials)]
            whole = self._chunk(part)
            for i, x in zip(odd, self._whole([part[i] for i in odd]) if odd else []):
                whole[i] = x
            out += whole
        return out

    def _chunk(self, part: list[str]) -> list[np.ndarray]:
        text = "".join(part)
        if not text:
            return [np.zeros(0, self.kind)] * len(part)
        data, points, cuts, at, size, counts = cut(text, part)
        last = classes()[points[np.append(cuts[1:], len(points)) - 1]]
        number, names = pd.factorize(piece_names(data, at, size))
        first = np.flatnonzero(np.diff(np.maximum.accumulate(number), prepend=-1))
        sort = np.argsort(names)
        names, first, back = names[sort], first[sort], np.empty(len(sort), np.int64)
        back[sort] = np.arange(len(sort))
        number = back[number]
        if len(self.names) > CACHE_ENTRIES:
            self.clear()
        place = np.searchsorted(self.names, names)
        new = np.ones(len(names), bool)
        inside = place < len(self.names)
        new[inside] = self.names[place[inside]] != names[inside]
        if new.any():
            raw, at, size, plain = np.frombuffer(data, np.uint8), at[first[new]], size[first[new]], last[first[new]] < SPACE
            ids, (where, many) = self._encode(raw, at, size, plain)
            self.names = np.insert(self.names, place[new], names[new])
            self.starts = np.insert(self.starts, place[new], where + len(self.ids))
            self.sizes = np.insert(self.sizes, place[new], many)
            self.ids = np.concatenate([self.ids, ids])
            place += np.cumsum(new) - new
        own = self.sizes[place][number]
        stop = np.cumsum(own)
        ids = self.ids[np.arange(int(stop[-1])) + np.repeat(self.starts[place][number] - stop + own, own)]
        ends = np.concatenate([[0], stop])[np.cumsum(counts)].tolist()
        return [ids[a:b] for a, b in zip([0, *ends[:-1]], ends)]


@cache
def token_cache(path: str) -> TokenCache:
    """One for each Python worker and stage."""
    return TokenCache(path)


for_a_stage(token_cache.cache_clear)


class Dealer:
    """Puts documents beside lexically similar ones, so that a shard holds what its seeds ask for.

    A document is the sum of fixed random signs of its different terms, weighted by
    their idf in a bounded sample; its key is the nearest of ``CENTROIDS`` means that
    were fitted on that sample, each next to its nearest, then the signs of its first 32 sums. Every document has a key; only the means are of the sample.
    """

    def __init__(self, docs: list[np.ndarray], size: int):
        df = np.zeros(size)
        for own in docs:
            df[np.unique(own)] += 1
        self.idf = np.log(1 + (len(docs) - df + 0.5) / (df + 0.5)).astype(np.float32)
        found = np.array([self.vector(np.unique(own)) for own in docs], np.float32).reshape(-1, DIMS)
        self.means = found[:CENTROIDS].copy()
        for _ in range(ROUNDS if len(found) > CENTROIDS else 0):
            near = (found @ self.means.T).argmax(axis=1)
            for k in np.unique(near).tolist():
                total = found[near == k].sum(axis=0)
                self.means[k] = total / max(float(np.linalg.norm(total)), 1e-9)
        # Each mean is followed by the nearest that is left.
        near, left, at = self.means @ self.means.T, np.ones(len(self.means), bool), 0
        order: list[int] = []
        while left.any():
            order.append(at)
            left[at] = False
            at = int(np.where(left, near[at], -np.inf).argmax())
        self.means = self.means[order]

    def vector(self, terms: np.ndarray) -> np.ndarray:
        found = self.idf[terms] @ signs(len(self.idf))[terms]
        return found / max(float(np.linalg.norm(found)), 1e-9)

    def key(self, terms: np.ndarray) -> int:
        if not len(self.means):
            return 0
        own = self.vector(terms)
        return int((self.means @ own).argmax()) << 32 | int.from_bytes(np.packbits(own[:32] > 0).tobytes(), "big")


@cache
def signs(size: int) -> np.ndarray:
    """A fixed random sign for each term and dimension."""
    return np.random.default_rng(5).choice(np.array([-1, 1], np.float32), (size, DIMS))


def fit_dealer(docs: DataFrame, name: str) -> Dealer:
    """Fitted in one task on at most ``SAMPLE_DOCS`` texts of at most ``SAMPLE_CHARS`` code points, the least by a hash of their id."""
    picked = docs.select("doc_id").where("doc_id is not null").withColumn("place", F.xxhash64("doc_id")).orderBy("place", "doc_id").limit(SAMPLE_DOCS).distinct()
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").where(F.length("text") <= SAMPLE_CHARS)
    texts = texts.orderBy("place", "doc_id", "text").limit(SAMPLE_DOCS).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = token_cache(SparkFiles.get(name))
        some = [x for batch in batches for x in tokens.encode(batch.column(0).to_pylist())]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(Dealer(some, tokens.size))], pa.binary())], names=["dealer"])

    found = texts.mapInArrow(tidied(run), "dealer binary").collect()
    return pickle.loads(found[0]["dealer"]) if found else Dealer([], 1)


def tokenise(docs: DataFrame, path: str, separator: int = 0) -> DataFrame:
    """``doc_id, row, ids, wide, key, n_terms`` and, in rows whose ``df`` is not null, each partition's document frequencies.

    ``row`` is a number of the row's own, ``n_terms`` the number of its different ids.
    ``ids``: little-endian integers of two bytes (four if ``wide``), the
    separator last. ``key``: see ``Dealer``. ``df``: unsigned 64-bit counts by id;
    ``doc_id`` is null there.
    """
    spark = prepare(docs.sparkSession)
    name = ship_file(spark, path)
    shared = spark.sparkContext.broadcast(fit_dealer(docs, name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "row", "ids", "wide", "key", "n_terms", "df"]
        row = TaskContext.get().partitionId() << 33
        tokens, dealer = token_cache(SparkFiles.get(name)), shared.value
        size = max(tokens.size, separator + 1)
        mark, df = np.zeros(size, bool), np.zeros(size, np.uint64)
        end, wide = np.array([separator], tokens.kind), tokens.kind.itemsize == 4
        for batch in batches:
            ids, keys, terms = [], [], []
            for own in tokens.encode([t or "" for t in batch.column(1).to_pylist()]):
                mark[own] = True
                at = np.flatnonzero(mark)
                mark[at] = False
                df[at] += np.uint64(1)
                df[separator] += np.uint64(separator not in own)
                ids.append(np.append(own, end).tobytes())
                keys.append(dealer.key(at))
                terms.append(len(at) + 1)
            own = [pa.array(range(row, row + len(ids)), pa.int64()), pa.array(ids, pa.binary()), pa.array([wide] * len(ids)), pa.array(keys, pa.int64()), pa.array(terms, pa.int64())]
            row += len(ids)
            yield pa.RecordBatch.from_arrays([batch.column(0), *own, pa.nulls(len(ids), pa.binary())], names=names)
        none = pa.array([None], pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, pa.array([None], pa.binary()), pa.array([wide]), none, none, pa.array([df.tobytes()], pa.binary())], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidied(run), "doc_id long, row long, ids binary, wide boolean, key long, n_terms long, df binary")


def add_frequencies(parts: DataFrame) -> DataFrame:
    """The sum of the partitions' document frequencies, as ``id, n``; one row for each id at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.uint64)
        for batch in batches:
            for x in batch.column(0):
                own = np.frombuffer(x.as_py(), np.uint64)
                if len(own) > len(total):
                    total = np.concatenate([total, np.zeros(len(own) - len(total), np.uint64)])
                total[: len(own)] += own
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at].astype(np.int64))], names=["id", "n"])

    return parts.select("df").mapInArrow(tidied(run), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def weights(term: np.ndarray, tf: np.ndarray, size: np.ndarray, idf: np.ndarray, mean: float) -> np.ndarray:
    """BM25 of each posting: a term that stands ``tf`` times in a document of ``size`` terms."""
    return (idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / max(mean, 1.0)))).astype(np.float32)


class Tier:
    """The inverted index of the longest documents, asked by every document."""

    def __init__(self, rows: np.ndarray, parts: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray, mean: float):
        """``parts``: of each row its terms, and how often each stands in it."""
        self.rows = rows
        term = np.concatenate([t for t, _ in parts]) if parts else np.zeros(0, np.int64)
        doc = np.repeat(np.arange(len(parts)), [len(t) for t, _ in parts])
        tf = np.concatenate([c for _, c in parts]).astype(np.float64) if parts else np.zeros(0)
        size = np.array([c.sum() for _, c in parts], np.float64)
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[order].astype(np.uint16), weights(term, tf, size[doc], idf, mean)[order]
        self.starts = np.searchsorted(term[order], np.arange(len(idf) + 1)).astype(np.int32)

    def scores(self, docs: list[np.ndarray]) -> np.ndarray:
        """The exact BM25 score of each tier document (column) for all terms of each document (row)."""
        if not docs or not len(self.rows):
            return np.zeros((len(docs), len(self.rows)), np.float32)
        terms = [np.unique(d) for d in docs]
        number, known = pd.factorize(np.concatenate(terms))
        asks = np.zeros((len(docs), len(known)), np.float32)
        asks[np.repeat(np.arange(len(docs)), [len(t) for t in terms]), number] = 1
        many = self.starts[known + 1] - self.starts[known]
        at = np.arange(int(many.sum())) + np.repeat(self.starts[known] - np.cumsum(many) + many, many)
        held = np.zeros((len(known), len(self.rows)), np.float32)
        held[np.repeat(np.arange(len(known)), many), self.doc[at]] = self.weight[at]
        return asks @ held

    def wanted(self, rows: np.ndarray, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tier documents that some of ``docs`` counts among its ``BEST``: their numbers, the place in ``docs`` that scores highest, and its score."""
        found = self.scores(docs)
        found[rows[:, None] == self.rows[None, :]] = 0
        if found.shape[1] > BEST:
            found[found < np.partition(found, found.shape[1] - BEST, axis=1)[:, found.shape[1] - BEST, None]] = 0
        seed = found.argmax(axis=0) if len(docs) else np.zeros(0, np.int64)
        score = found[seed, np.arange(found.shape[1])] if len(docs) else np.zeros(0, np.float32)
        some = np.flatnonzero(score > 0)
        return some, seed[some], score[some]


def make_tier(tokens: DataFrame, idf: np.ndarray, mean: float) -> Tier:
    """Of the longest ``TIER_DOCS`` documents as many as ``TIER_POSTINGS`` allow; their different terms reach the driver."""
    longest = tokens.select("row", "n_terms", (F.octet_length("ids") / F.when(F.col("wide"), 4).otherwise(2)).alias("size")).orderBy(F.desc("size"), "row").limit(TIER_DOCS).collect()
    rows = [r["row"] for r, upto in zip(longest, np.cumsum([r["n_terms"] for r in longest]).tolist()) if upto <= TIER_POSTINGS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [np.unique(np.frombuffer(x, "<u4" if w else "<u2"), return_counts=True) for x, w in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[k].astype("<u4").tobytes() for x in made], pa.binary()) for k in (0, 1))], names=["row", "terms", "counts"])

    own = tokens.select("row", "ids", "wide").where(F.col("row").isin(rows)) if rows else tokens.select("row", "ids", "wide").limit(0)
    found = {r["row"]: (np.frombuffer(r["terms"], "<u4").astype(np.int64), np.frombuffer(r["counts"], "<u4")) for r in own.mapInArrow(tidied(run), "row long, terms binary, counts binary").collect()}
    return Tier(np.array(rows, np.int64), [found[r] for r in rows], idf, mean)


def moved(tokens: DataFrame, tier: Tier) -> DataFrame:
    """``row, new_key, seed``: tier documents and the document that gets each; a row a tier document at most."""
    shared = tokens.sparkSession.sparkContext.broadcast(tier)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            docs = [np.frombuffer(x, "<u4" if w else "<u2") for x, w in zip(batch.column("ids").to_pylist(), batch.column("wide").to_pylist())]
            rows, keys = batch.column("row").to_numpy(), batch.column("key").to_numpy()
            some, seed, score = own.wanted(rows, docs)
            yield pa.RecordBatch.from_arrays([pa.array(own.rows[some]), pa.array(keys[seed]), pa.array(rows[seed]), pa.array(score.astype(np.float64))], names=["row", "new_key", "seed", "score"])

    asked = tokens.select("row", "ids", "wide", "key").mapInArrow(tidied(run), "row long, new_key long, seed long, score double")
    best = asked.groupBy("row").agg(F.max_by(F.struct("new_key", "seed"), F.struct("score", -F.col("seed"))).alias("best"))
    return best.select("row", "best.new_key", "best.seed")


class Shard:
    """The inverted index of a block of documents, asked with every term of every one of them.

    Postings of frequent terms are columns of a matrix, which is multiplied at
    once; the lists of the others are met list by list.
    """

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        n, slot = len(docs), np.zeros(len(idf), np.int64)
        mark = np.zeros(len(idf), bool)
        terms, counts = [], []
        for own in docs:
            mark[own] = True
            at = np.flatnonzero(mark)
            mark[at] = False
            slot[at] = np.arange(len(at))
            terms.append(at)
            counts.append(np.bincount(slot[own], minlength=len(at)))
        sizes = np.fromiter(map(len, docs), np.float64, n)
        doc = np.repeat(np.arange(n), [len(t) for t in terms])
        term, tf = np.concatenate(terms), np.concatenate(counts).astype(np.float64)
        weight = weights(term, tf, sizes[doc], idf, mean)
        df = np.bincount(term, minlength=len(idf))
        #: The BM25 score of each document (column) for the terms of each (row).
        self.scores = self.frequent(n, doc, term, weight, df) + self.rare(n, doc, term, weight, df)
        self.unused = np.ones(n, bool)

    @staticmethod
    def frequent(n: int, doc: np.ndarray, term: np.ndarray, weight: np.ndarray, df: np.ndarray) -> np.ndarray:
        many = df >= FREQUENT
        column = np.cumsum(many) - 1
        at = np.flatnonzero(many[term])
        index = np.zeros((n, int(many.sum())), np.float32)
        index[doc[at], column[term[at]]] = weight[at]
        return (index > 0).astype(np.float32) @ index.T

    @staticmethod
    def rare(n: int, doc: np.ndarray, term: np.ndarray, weight: np.ndarray, df: np.ndarray) -> np.ndarray:
        at = np.flatnonzero((df[term] < FREQUENT) & (df[term] > 1))
        at = at[np.argsort(term[at], kind="stable")]
        doc, weight, size = doc[at], weight[at], df[term[at]]
        first = np.searchsorted(term[at], term[at])
        out = np.zeros(n * n)
        met = np.cumsum(size)
        for a in range(0, len(at), STEP):
            b = min(a + STEP, len(at))
            left = np.repeat(np.arange(a, b), size[a:b])
            right = first[left] + np.arange(len(left)) - (met[left] - size[left] - (met[a] - size[a]))
            out += np.bincount(doc[left] * n + doc[right], weights=weight[right], minlength=n * n)
        return out.reshape(n, n).astype(np.float32)

    def neighbours(self, seed: int) -> Iterator[int]:
        """Unused documents that share a term with the seed, the best first; ties to the earlier."""
        left = np.where(self.unused, self.scores[seed], 0)
        while left[best := int(left.argmax())] > 0:
            left[best] = 0
            yield best


class Packer:
    """Fills windows; keeps the open window from shard to shard."""

    def __init__(self, window: int, first_id: int):
        self.window, self.next_id = window, first_id
        self.open: list[tuple] = []
        self.filled = 0
        self.done: list[tuple] = []

    def close(self) -> None:
        self.done += [(d, s, ids, n, self.next_id, o) for d, s, ids, n, o in self.open]
        self.next_id += 1
        self.open, self.filled = [], 0

    def put(self, doc_id: int | None, ids: np.ndarray) -> bool:
        """Place a document from the open window on; True if it crossed the window's end."""
        at, n, crossed = 0, len(ids), False
        while at < n:
            take = min(n - at, self.window - self.filled)
            self.open.append((doc_id, at, ids[at : at + take], n, self.filled))
            self.filled += take
            at += take
            if self.filled == self.window:
                self.close()
                crossed = True
        return crossed

    def shard(self, doc_ids: list[int | None], docs: list[np.ndarray], idf: np.ndarray, mean: float) -> None:
        index = Shard(docs, idf, mean)
        for first in range(len(docs)):
            if not index.unused[first]:
                continue
            seed: int | None = first
            index.unused[first] = False
            self.put(doc_ids[first], docs[first])
            # While the window is open, its seed's neighbours fill it; the one that crosses its end is the next seed.
            while seed is not None and self.filled:
                asked, seed = seed, None
                for other in index.neighbours(asked):
                    index.unused[other] = False
                    if self.put(doc_ids[other], docs[other]):
                        seed = other
                        break

    def finish(self) -> None:
        """Cut the open window into sequences whose lengths are powers of two."""
        left = [(d, s, ids, n) for d, s, ids, n, _ in self.open]
        total, self.open, self.filled = self.filled, [], 0
        for bit in reversed(range(total.bit_length())):
            if not total >> bit & 1:
                continue
            room, whole = 1 << bit, 1 << bit
            while room:
                d, s, ids, n = left.pop(0)
                take = min(room, len(ids))
                self.open.append((d, s, ids[:take], n, whole - room))
                if take < len(ids):
                    left.insert(0, (d, s + take, ids[take:], n))
                room -= take
            self.close()


def pack(docs: DataFrame, path: str, scratch: Scratch, window: int = 1024, separator: int = 0) -> DataFrame:
    """Pieces of all documents as ``PIECES``: the ids of each piece are little-endian unsigned 32-bit integers.

    ``start``: the document's ids before the piece; ``offset``: its place in
    the sequence. Sequences are ``window`` long or a power of two.
    """
    spark = prepare(docs.sparkSession)
    table = scratch.write(tokenise(docs, path, separator), "tokens")
    tokens = table.where("ids is not null")
    frequency = add_frequencies(table.where("df is not null")).collect()
    n_docs, mean = tokens.agg(F.count(F.lit(1)), F.avg(F.octet_length("ids") / F.when(F.col("wide"), 4).otherwise(2))).first()
    mean = mean or 0.0
    size = max((r["id"] for r in frequency), default=separator) + 1
    df = np.zeros(size)
    df[[r["id"] for r in frequency]] = [r["n"] for r in frequency]
    idf = np.log(1 + (n_docs - df + 0.5) / (df + 0.5))
    shared = spark.sparkContext.broadcast(idf)
    gone = scratch.write(moved(tokens, make_tier(tokens, idf, mean)), "moved")
    names = PIECES.replace(",", "").split()[::2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(window, TaskContext.get().partitionId() << 32)
        doc_ids: list[int | None] = []
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            out, packer.done = packer.done, []
            d, s, ids, n, q, o = zip(*out) if out else [()] * 6
            length = [len(x) for x in ids]
            raw = [x.astype("<u4").tobytes() for x in ids]
            long = pa.int64()
            return pa.RecordBatch.from_arrays([pa.array(d, long), pa.array(s, long), pa.array(length, long), pa.array(raw, pa.binary()), pa.array(n, long), pa.array(q, long), pa.array(o, long)], names=names)

        for batch in batches:
            for doc_id, ids, wide in zip(*(c.to_pylist() for c in batch.columns)):
                doc_ids.append(doc_id)
                held.append(np.frombuffer(ids, "<u4" if wide else "<u2"))
                size += len(held[-1])
                if len(held) >= SHARD_DOCS or size >= SHARD_TOKENS:
                    packer.shard(doc_ids, held, shared.value, mean)
                    yield flush()
                    doc_ids, held, size = [], [], 0
        if held:
            packer.shard(doc_ids, held, shared.value, mean)
        packer.finish()
        if packer.done:
            yield flush()

    # Ranges of keys, and of rows where very many documents have one key; a shard is a run of neighbours. At most TIER_DOCS rows are broadcast.
    placed = tokens.join(F.broadcast(gone), "row", "left").select(
        "doc_id", "ids", "wide", F.coalesce("new_key", "key").alias("key"), F.coalesce("seed", "row").alias("place"), F.col("seed").isNotNull().alias("follows"), "row"
    )
    dealt = placed.repartitionByRange(partitions(spark), "key", F.xxhash64("place")).sortWithinPartitions("key", "place", "follows", "row")
    return dealt.select("doc_id", "ids", "wide").mapInArrow(tidied(run), PIECES)
