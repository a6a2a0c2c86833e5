"""Alignment of two tokenizers over the same texts.

Tokenizer A is a byte-level ``tokenizers`` file, B a ``sentencepiece`` model; both read a
space and the text. Over the bytes of many documents the ends of each side's tokens are
packed bitsets, 64 bytes of text a word. Their AND holds the cuts that both sides
share; a cut's rank (bits up to it, by popcounts of words and of one masked word) in a side's bitset is the number
of that side's tokens up to it, so consecutive cuts are ranges of tokens, a group. A
cut expands to its link: the A and the B token that end there.

Each different piece of text is encoded once: A's pieces are those of its pre-tokeniser, B's
start at a run of spaces or at a line break, where no entry of its vocabulary reaches across
(checked for the model; otherwise texts are encoded whole).

How often a pair of ids is linked is counted over the whole corpus: tasks add up their own
documents' pairs first, the counts meet by pair, and every document's pairs (each different one
once, with its number) are joined with the counts. The counts are broadcast while they are few (checked), else joined by
a shuffle.

Defined results: null and empty texts, and texts that a side does not give back byte by byte,
have no tokens: zeros and no groups. Null and repeated ids are rows like any other. An
empty table gives no rows. Only id and text are read.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fotolith.llm.bpe import chunks, piece_names, ship_file
from fotolith.llm.common import Scratch, for_a_stage, prepare, sided, tidied
from fotolith.llm.packing import TokenCache, byte_letters

#: The sign that pieces of B have for a space.
SPACE_SIGN = "▁"
#: Pieces of B that a worker keeps.
CACHE_ENTRIES = 1_000_000
#: Different pairs that a task holds before it gives its counts away.
HELD_PAIRS = 1 << 20

ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, groups string, pairs binary, times binary"


class ByteTokens(TokenCache):
    """Ids by a byte-level file, special tokens' strings as plain text; ``words`` holds each id's bytes."""

    def __init__(self, path: str):
        super().__init__(path)
        self.tokenizer.encode_special_tokens = True
        self.specials = []
        letters = byte_letters()
        self.words = [b""] * (1 + max(self.tokenizer.get_vocab().values()))
        for word, i in self.tokenizer.get_vocab().items():
            self.words[i] = bytes(letters[c] for c in word) if all(c in letters for c in word) else word.encode()


class PieceTokens:
    """Ids by a ``sentencepiece`` model, each different piece encoded once; ``words`` holds each id's bytes."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        self.words = [bytes([int(p[3:-1], 16)]) if self.model.is_byte(i) else p.replace(SPACE_SIGN, " ").encode() for i, p in enumerate(pieces)]
        plain = [p for i, p in enumerate(pieces) if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i))]
        start = self.model.encode("\n")
        #: No entry reaches from another sign to a space or across a line break, and " \n" begins with the space's own id.
        self.apart = all(SPACE_SIGN not in p.lstrip(SPACE_SIGN) and "\n" not in p for p in plain) and bool(start) and self.words[start[0]] == b" "
        self.space = start[0] if start else 0
        self.clear()

    def clear(self) -> None:
        self.names, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.starts, self.sizes, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _alone(self, pieces: list[str]) -> list[list[int]]:
        """Ids of pieces that begin with a space or are a line break and what follows; the model puts a space before what it reads."""
        asked = [p if p[0] == "\n" else p[1:] for p in pieces]
        return [[self.space] if p == " " else ids[1:] if p[0] == "\n" else ids for p, ids in zip(pieces, self.model.encode(asked, num_threads=1))]

    def encode(self, data: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that lie one after another in ``data``, ``sizes`` bytes each beginning with a space; and the ids of each."""
        if not self.apart:
            ends = np.cumsum(sizes).tolist()
            own = self.model.encode([data[b - n + 1 : b].decode() for b, n in zip(ends, sizes.tolist())], num_threads=1)
            return np.concatenate([np.array(x, np.int32) for x in own]), np.fromiter(map(len, own), np.int64, len(own))
        raw = np.frombuffer(data, np.uint8)
        first = np.cumsum(sizes) - sizes
        opens = raw == 0x20
        opens[1:] &= raw[:-1] != 0x20
        opens |= raw == 0x0A
        opens[first] = True
        at = np.flatnonzero(opens)
        long = np.diff(at, append=len(raw))
        number, names = pd.factorize(piece_names(data, at, long))
        example = np.flatnonzero(np.diff(np.maximum.accumulate(number), prepend=-1))
        if len(self.names) > CACHE_ENTRIES:
            self.clear()
        known = np.searchsorted(self.names, names)
        new = np.ones(len(names), bool)
        inside = known < len(self.names)
        new[inside] = self.names[known[inside]] != names[inside]
        if new.any():
            own = self._alone([data[a : a + n].decode() for a, n in zip(at[example[new]].tolist(), long[example[new]].tolist())])
            many = np.fromiter(map(len, own), np.int64, len(own))
            order = np.argsort(names[new])
            spots = np.searchsorted(self.names, names[new][order])
            self.names = np.insert(self.names, spots, names[new][order])
            self.starts = np.insert(self.starts, spots, (np.cumsum(many) - many + len(self.ids))[order])
            self.sizes = np.insert(self.sizes, spots, many[order])
            self.ids = np.concatenate([self.ids, *(np.array(x, np.int32) for x in own)])
            known = np.searchsorted(self.names, names)
        own = self.sizes[known][number]
        stop = np.cumsum(own)
        ids = self.ids[np.arange(int(stop[-1])) + np.repeat(self.starts[known][number] - stop + own, own)]
        counts = np.concatenate([[0], stop])
        return ids, counts[np.searchsorted(at, first + sizes)] - counts[np.searchsorted(at, first)]


@cache
def sides(path_a: str, path_b: str) -> tuple[ByteTokens, PieceTokens, dict]:
    """Both tokenizers, and the decimal ids with the sign that follows: one set for each Python worker and stage."""
    a, b = ByteTokens(path_a), PieceTokens(path_b)
    signs = {side: [f"{i}{sign}" for i in range(len(own.words)) for sign in ",|;"] for side, own in (("a", a), ("b", b))}
    return a, b, signs


for_a_stage(sides.cache_clear)


class Bits:
    """A packed bitset over byte positions, with popcounts before each word."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.cumsum(np.bitwise_count(words), dtype=np.int64) - np.bitwise_count(words)

    @classmethod
    def of(cls, places: np.ndarray, size: int) -> Bits:
        flags = np.zeros((size + 63) // 64 * 64, bool)
        flags[places] = True
        return cls(np.packbits(flags, bitorder="little").view(np.uint64))

    def rank(self, places: np.ndarray) -> np.ndarray:
        """Set bits up to and at each place."""
        word, bit = places >> 6, (places & 63).astype(np.uint64)
        mask = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(63) - bit)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def select(self) -> np.ndarray:
        """The places of all set bits."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))


class Groups:
    """Token groups of documents whose tokens lie one after another.

    ``lengths_a``, ``lengths_b``: bytes of each token; both add up to the same bytes.
    """

    def __init__(self, lengths_a: np.ndarray, lengths_b: np.ndarray):
        ends_a, ends_b = np.cumsum(lengths_a) - 1, np.cumsum(lengths_b) - 1
        size = int(ends_a[-1]) + 1 if len(ends_a) else 0
        a, b = Bits.of(ends_a, size), Bits.of(ends_b, size)
        #: Places of the bytes that end a token on both sides.
        self.cuts = Bits(a.words & b.words).select()
        #: Tokens of each side up to and in each group.
        self.upto_a, self.upto_b = a.rank(self.cuts), b.rank(self.cuts)

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the A and B tokens that end together."""
        return self.upto_a - 1, self.upto_b - 1

    def written(self, a: np.ndarray, b: np.ndarray, signs: dict) -> tuple[list[str], np.ndarray]:
        """Every id with the sign after it, groups in order; and where each group ends."""
        group_a = np.searchsorted(self.upto_a, np.arange(len(a)), side="right")
        group_b = np.searchsorted(self.upto_b, np.arange(len(b)), side="right")
        place_a = np.arange(len(a)) + np.concatenate([[0], self.upto_b])[group_a]
        place_b = np.arange(len(b)) + self.upto_a[group_b]
        code = np.empty(len(a) + len(b), np.int64)
        code[place_a], code[place_b] = 3 * a.astype(np.int64), 3 * b.astype(np.int64)
        code[place_a[self.upto_a - 1]] += 1
        code[place_b[self.upto_b - 1]] += 2
        is_a = np.zeros(len(code), bool)
        is_a[place_a] = True
        table = signs["a"] + signs["b"]
        code[~is_a] += len(signs["a"])
        return list(map(table.__getitem__, code.tolist())), self.upto_a + self.upto_b


def lengths(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(len, words), np.int64, len(words))


def back(own: list[bytes], ids: np.ndarray) -> bytes:
    return b"".join(map(own.__getitem__, ids.tolist()))


def whole_sides(texts: list[str], a: ByteTokens, b: PieceTokens) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Which texts both sides give back byte by byte, and of those each side's ids and their number a text."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    parts = a.encode(texts)
    made = [(np.concatenate(parts).astype(np.int64), np.fromiter(map(len, parts), np.int64, len(parts))), b.encode(b"".join(raw), lengths(raw))]
    good = np.ones(len(texts), bool)
    for side, (ids, many) in zip((a, b), made):
        own = back(side.words, ids)
        at = np.concatenate([[0], np.cumsum(lengths(side.words)[ids])])[np.concatenate([[0], np.cumsum(many)])].tolist()
        good &= np.array([own[x:y] == t for x, y, t in zip(at, at[1:], raw)], bool)
    return good, [(ids[np.repeat(good, many)], many[good]) for ids, many in made]


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``ALIGNED`` rows: numbers of tokens and groups, the groups as text, and the different linked pairs with their number.

    ``row`` is a number of the row's own. ``groups`` reads ``a1,a2|b1;a3|b2,b3``; ``pairs`` holds
    A ids times 2^32 plus B ids as unsigned 64-bit integers, ``times`` unsigned 32-bit integers.
    """
    spark = prepare(docs.sparkSession)
    name_a, name_b = ship_file(spark, path_a), ship_file(spark, path_b)
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, signs = sides(SparkFiles.get(name_a), SparkFiles.get(name_b))
        size_a, size_b = lengths(a.words), lengths(b.words)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            ids = batch.column(0).to_pylist()
            at = 0
            for part in chunks([f" {t}" if t else "" for t in batch.column(1).to_pylist()]):
                own = ids[at : at + len(part)]
                at += len(part)
                n = len(part)
                made = {"n_a": np.zeros(n, np.int64), "n_b": np.zeros(n, np.int64), "n_groups": np.zeros(n, np.int64)}
                groups, pairs, times = [""] * n, [b""] * n, [b""] * n
                some = np.array([i for i, t in enumerate(part) if t], np.int64)
                if len(some):
                    good, ((ids_a, many_a), (ids_b, many_b)) = whole_sides([part[i] for i in some], a, b)
                    some = some[good]
                if len(some):
                    met = Groups(size_a[ids_a], size_b[ids_b])
                    last = np.searchsorted(met.upto_a, np.cumsum(many_a)) + 1
                    made["n_a"][some], made["n_b"][some], made["n_groups"][some] = many_a, many_b, np.diff(last, prepend=0)
                    signed, ends = met.written(ids_a, ids_b, signs)
                    link_a, link_b = met.links()
                    key = ids_a[link_a].astype(np.uint64) << np.uint64(32) | ids_b[link_b].astype(np.uint64)
                    number, different = pd.factorize(key)
                    doc = np.repeat(np.arange(len(some)), np.diff(last, prepend=0))
                    code, count = np.unique(doc * len(different) + number, return_counts=True)
                    bounds = np.searchsorted(code, np.arange(len(some) + 1) * len(different)).tolist()
                    key, count = different[code % len(different)].astype("<u8"), count.astype("<u4")
                    begin = 0
                    for k, i in enumerate(some.tolist()):
                        end = int(ends[last[k] - 1])
                        groups[i] = "".join(signed[begin:end])[:-1]
                        begin = end
                        pairs[i], times[i] = key[bounds[k] : bounds[k + 1]].tobytes(), count[bounds[k] : bounds[k + 1]].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(row, row + n), pa.int64()), pa.array(own, pa.int64()), *map(pa.array, made.values()), pa.array(groups, pa.string()), pa.array(pairs, pa.binary()), pa.array(times, pa.binary())],
                    names=["row", "doc_id", *made, "groups", "pairs", "times"],
                )
                row += n

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidied(run), ALIGNED)


def link_counts(aligned: DataFrame) -> DataFrame:
    """``pair, n, best``: how often each pair is linked in all documents, and whether no pair of its B id is linked more often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            new = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u8")
            own = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u4").astype(np.int64)
            keys, place = np.unique(np.concatenate([keys, new]), return_inverse=True)
            counts = np.bincount(place, np.concatenate([counts, own]), len(keys)).astype(np.int64)
            if len(keys) > HELD_PAIRS:
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(counts)], names=["pair", "n"])
                keys, counts = keys[:0], counts[:0]
        yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(counts)], names=["pair", "n"])

    counts = aligned.select("pairs", "times").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = counts.withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)))
    top = counts.groupBy("b").agg(F.max("n").alias("top"))
    return counts.join(sided(top), "b").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def link_scores(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """``row, n_best, count_sum``: of each row with links those whose pair is its B id's best, and the counts' sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, times = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            many = np.array([len(p) // 8 for p in pairs], np.int64)
            rows = np.repeat(batch.column(0).to_numpy(), many)
            key, count = np.frombuffer(b"".join(pairs), "<i8"), np.frombuffer(b"".join(times), "<u4").astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(key), pa.array(count)], names=["row", "pair", "times"])

    each = aligned.select("row", "pairs", "times").mapInArrow(run, "row long, pair long, times long")
    joined = each.join(sided(counts), "pair")
    return joined.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))


def aligned_links(docs: DataFrame, path_a: str, path_b: str, scratch: Scratch) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row of ``docs``."""
    made = align(docs, path_a, path_b)
    digest = F.when(F.col("n_groups") == 0, "").otherwise(F.sha2("groups", 256))
    made = scratch.write(made.withColumn("groups_sha256", digest).drop("groups"), "aligned")
    counts = scratch.write(link_counts(made), "counts")
    scores = link_scores(made, counts)
    zero = F.lit(0).cast("long")
    # A cut ends one token of each side, so there is a link a group.
    return made.join(scores, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256"
    )
