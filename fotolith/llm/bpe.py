"""Byte-level BPE encoding and decoding.

Pre-tokenisation is vectorised over a whole batch of texts. The code points of
all texts lie in one array; a table gives each its class (space, other white
space, letter, number, rest). The split pattern is an automaton over those
classes. The state it keeps between code points is the kind of the run it is in
and whether a single space was carried into it, and each class acts on that
state as a constant function. Transition functions compose associatively, and
the scan of constant functions is the shift of the class array by one (by up to
three where the contraction suffixes look ahead). So every token boundary
follows from shifted class arrays, without a regular expression and without a
loop over characters.

The slices between boundaries go through a bounded two-generation cache of
pair-merge results. Token ids keep their byte lengths, so decoding gives the
text's bytes back and the offset of each token is known.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fotolith.llm.common import for_a_stage, prepare, tidied
from fotolith.llm.rules import _mix

REST, LETTER, NUMBER, SPACE, WHITE = range(5)

#: Code points with the Unicode property White_Space, without U+0020.
WHITE_SPACE = (
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x85, 0xA0, 0x1680,
    0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006, 0x2007, 0x2008, 0x2009, 0x200A,
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)
#: The suffixes that the pattern splits off after an apostrophe.
SUFFIXES = ("s", "t", "re", "ve", "m", "ll", "d")

#: Entries of one generation of the merge cache; two generations are held.
CACHE_ENTRIES = 300_000
#: Code points that are split at a time, which bounds a task's memory.
CHUNK_CHARS = 1 << 20
#: Longer pieces merge through a heap, which stays near-linear.
HEAP_FROM = 48
#: Longer pieces are merged but not kept.
CACHE_PIECE = 64


@cache
def classes() -> np.ndarray:
    """Class of every code point, as a byte."""
    table = np.zeros(sys.maxunicode + 1, np.uint8)
    for cp in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            table[cp] = LETTER
        elif kind == "N":
            table[cp] = NUMBER
    table[list(WHITE_SPACE)] = WHITE
    table[0x20] = SPACE
    return table


def boundaries(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Token starts over the code points of many texts.

    ``points``: code points of the texts one after another; ``first``: where
    each non-empty text starts. Returns the sorted token starts.
    """
    n = len(points)
    kind = classes()[points]
    run = np.minimum(kind, SPACE)
    opens = np.zeros(n + 4, bool)  # a text starts here; beyond the end too
    opens[first] = True
    opens[n:] = True
    start = opens[:n].copy()
    start[1:] |= run[1:] != run[:-1]
    out = start.copy()
    # A run of anything but white space, just after white space of the same text.
    after = np.flatnonzero(start[1:] & (run[1:] < SPACE) & (run[:-1] == SPACE) & ~opens[1:n]) + 1
    carried = kind[after - 1] == SPACE
    out[after - 1] = True
    out[after[carried]] = False
    # Contractions: an apostrophe that opens a token, then a known suffix.
    quote = np.flatnonzero(start & (points == ord("'")))
    quote = quote[opens[quote] | (kind[quote - 1] != SPACE)]
    if len(quote):
        padded = np.concatenate([points, np.zeros(3, points.dtype)])
        one, two = padded[quote + 1], padded[quote + 2]
        inside = ~opens[quote + 1]
        inside2 = inside & ~opens[quote + 2]
        length = np.zeros(len(quote), np.int64)
        for s in SUFFIXES:
            hit = inside & (one == ord(s[0])) if len(s) == 1 else inside2 & (one == ord(s[0])) & (two == ord(s[1]))
            length[hit & (length == 0)] = len(s)
        quote, length = quote[length > 0], length[length > 0]
        out[quote + 1] = False
        ends = quote + 1 + length
        out[ends[ends < n]] = True
    return np.flatnonzero(out)


def cut(whole: str, texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of joined texts, not all empty: bytes, code points, where pieces start in code points and in bytes, their bytes, and the pieces of each text."""
    points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths)
    cuts = boundaries(points, (ends - lengths)[lengths > 0])
    counts = np.searchsorted(cuts, ends) - np.searchsorted(cuts, ends - lengths)
    data, at = whole.encode("utf-8", "surrogatepass"), cuts
    if len(data) != len(points):
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        at = (np.cumsum(width) - width)[cuts]
    return data, points, cuts, at, np.diff(at, append=len(data)), counts


def pieces(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """All pieces of the texts in order, and the number of pieces of each text."""
    whole = "".join(texts)
    if not whole:
        return [], np.zeros(len(texts), np.int64)
    _, _, cuts, _, _, counts = cut(whole, texts)
    at = cuts.tolist()
    return [whole[a:b] for a, b in zip(at, at[1:] + [len(whole)])], counts


def piece_names(data: bytes, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each piece of ``data``, from its length and its bytes, eight at a time."""
    padded = data + bytes(16)
    words = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    masks = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    names = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    some, k = np.arange(len(at)), 0
    while len(some):
        names[some] = _mix(names[some] ^ (words[at[some] + k] & masks[np.minimum(size[some] - k, 8)]))
        k += 8
        some = some[size[some] > k]
        if k == 4096:
            break
    for i in some.tolist():  # very long pieces
        names[i] = xxhash.xxh64_intdigest(data[at[i] : at[i] + size[i]])
    return names


def different(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The different pieces of the texts, the number of each piece in order, and the pieces of each text."""
    whole = "".join(texts)
    if not whole:
        return [], np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    data, _, cuts, at, size, counts = cut(whole, texts)
    number, _ = pd.factorize(piece_names(data, at, size))
    first = np.flatnonzero(np.diff(np.maximum.accumulate(number), prepend=-1))
    ends = np.append(cuts[1:], len(whole))[first].tolist()
    return [whole[a:b] for a, b in zip(cuts[first].tolist(), ends)], number, counts


def chunks(texts: list[str]) -> Iterator[list[str]]:
    """The texts in runs of about ``CHUNK_CHARS`` code points; a longer text is a run of its own."""
    held, size = [], 0
    for t in texts:
        if held and size + len(t) > CHUNK_CHARS:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


def load_ranks(lines: Iterable[bytes]) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """Tokens of one piece: the adjacent pair of least rank is merged until none is left."""
    if piece in ranks:
        return [piece]
    if len(piece) > HEAP_FROM:
        return merge_long(piece, ranks)
    get, none = ranks.get, len(ranks) + 1
    parts = [piece[i : i + 1] for i in range(len(piece))]
    pairs = [piece[i : i + 2] for i in range(len(piece) - 1)]
    scores = [get(pair, none) for pair in pairs]
    while True:
        best = min(scores)
        if best == none:
            return parts
        i = scores.index(best)
        parts[i] = made = pairs[i]
        del parts[i + 1], scores[i], pairs[i]
        if i < len(scores):
            pairs[i] = pair = made + parts[i + 1]
            scores[i] = get(pair, none)
        if i:
            pairs[i - 1] = pair = parts[i - 1] + made
            scores[i - 1] = get(pair, none)
        elif not scores:
            return parts


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """As ``merge``, with a heap over a linked list: n log n for pieces of any length."""
    n = len(piece)
    parts: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, piece[i : i + 2]) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, pair = heapq.heappop(heap)
        j = after[i]
        if parts[i] is None or j >= n or parts[i] + parts[j] != pair:
            continue
        parts[i], parts[j] = pair, None
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := ranks.get(pair + parts[k])) is not None:
                heapq.heappush(heap, (r, i, pair + parts[k]))
        if (h := before[i]) >= 0 and (r := ranks.get(parts[h] + pair)) is not None:
            heapq.heappush(heap, (r, h, parts[h] + pair))
    return [p for p in parts if p is not None]


class MergeCache(dict):
    """piece -> its ids as little-endian unsigned 32-bit integers; two generations."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks, self.old = ranks, {}
        self.packed = {word: rank.to_bytes(4, "little") for word, rank in ranks.items()}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            raw = piece.encode("utf-8", "surrogatepass")
            ids = b"".join(map(self.packed.__getitem__, merge(raw, self.ranks)))
        if len(piece) <= CACHE_PIECE:
            if len(self) >= CACHE_ENTRIES:
                self.old = self.copy()
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    """Encodes and decodes batches of texts with a rank file's vocabulary."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = load_ranks(f)
        self.cache = MergeCache(ranks)
        size = max(ranks.values()) + 1
        self.words: list[bytes] = [b""] * size
        for word, rank in ranks.items():
            self.words[rank] = word
        self.lengths = np.fromiter(map(len, self.words), np.int64, size)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Of each text the ids, as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        for part in chunks(texts):
            own, counts = pieces(part)
            ids = list(map(self.cache.__getitem__, own))
            ends = np.cumsum(counts).tolist()
            out += [b"".join(ids[b - c : b]) for b, c in zip(ends, counts.tolist())]
        return out

    def offsets(self, ids: bytes) -> np.ndarray:
        """Byte offset at which each token ends."""
        return np.cumsum(self.lengths[np.frombuffer(ids, "<u4")])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.words.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@cache
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and stage."""
    return Encoder(path)


for_a_stage(encoder.cache_clear)


def ship_file(spark: SparkSession, path: str) -> str:
    """Send a vocabulary file to all executors; returns its name there."""
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def encode_column(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids and token end offsets of every text: ``id_col, ids, ends, n_tokens``.

    ``ids`` holds little-endian unsigned 32-bit integers, ``ends`` the byte
    offset at which each token ends, as little-endian unsigned 64-bit ones.
    A null text counts as empty and has no ids; a null id stays null; repeated
    rows give repeated results; other columns are not carried.
    """
    spark = prepare(docs.sparkSession)
    name = ship_file(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(SparkFiles.get(name))
        for batch in batches:
            ids = enc.encode([t or "" for t in batch.column(1).to_pylist()])
            ends = [enc.offsets(x).astype("<u8").tobytes() for x in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.binary()), pa.array(ends, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())],
                names=[id_col, "ids", "ends", "n_tokens"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(tidied(run), f"{id_col} {kind}, ids binary, ends binary, n_tokens long")


def decode_column(encoded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """The bytes of each row's ``ids``: ``id_col, decoded``; null ids give no bytes."""
    spark = prepare(encoded.sparkSession)
    name = ship_file(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(SparkFiles.get(name))
        for batch in batches:
            out = [enc.decode(x or b"") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=[id_col, "decoded"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, "ids").mapInArrow(tidied(run), f"{id_col} {kind}, decoded binary")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every document.

    The round trip runs inside one task for each batch, so that neither ids nor
    decoded bytes are shuffled or written.
    """
    spark = prepare(docs.sparkSession)
    name = ship_file(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(SparkFiles.get(name))
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            ids = enc.encode([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(map(sha, ids), pa.string()), pa.array((sha(enc.decode(x)) for x in ids), pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidied(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
