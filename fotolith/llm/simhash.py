"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of at most 23 bits. The perfect
binary Golay code (23, 12) has one nearest codeword for every 23-bit word; the
codewords nearest to a word and to its 23 one-bit neighbours have one to six
different 12-bit indices. Two words that differ in at most two bits have a word
within one bit of both, so they share an index. With at most two differing bits
in a fingerprint, one segment is equal (pigeonhole) and every other segment
shares an index. A fingerprint's keys are thus each segment exactly, joined
with the indices of the next segment: at most 18 keys that miss nothing.

Rows of equal key meet and each pair of different fingerprints is verified.
Keys with more than ``MAX_BUCKET`` fingerprints (near copies of one text) are
not paired: their fingerprints are linked exactly through the one-bit
neighbours they share, at most 65 fingerprints a neighbour.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fotolith.llm.common import Scratch, prepare, tidied
from fotolith.llm.components import components

#: The generator polynomial of the binary Golay code.
GENERATOR = 0xC75
#: Bits of the three segments, from the least significant.
SEGMENTS = (22, 21, 21)
#: Bits in which linked fingerprints may differ; the keys are complete up to 2.
MAX_BITS = 2
#: Different fingerprints of one key that are compared in pairs.
MAX_BUCKET = 32
SEED = 42


# Fingerprints


def shingle_hashes(text: bytes, size: int) -> list[int]:
    """XXH64 of each word shingle of a text; fewer words give one shingle, no word none."""
    words = text.lower().split()
    if not words:
        return []
    line = b" ".join(words)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(line, SEED)]
    starts = [0] + [e + 1 for e in ends[: len(words) - size]]
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], SEED) for a, b in zip(starts, ends[size - 1 :])]


def fingerprints_of(texts: list[str], size: int) -> np.ndarray:
    """The fingerprint of each text, as signed 64-bit integers.

    A bit is 1 if set in over half of the shingle hashes, repeats included.
    """
    out = np.zeros(len(texts), np.uint64)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for i, text in enumerate(texts):
        hashes = shingle_hashes(text.encode("utf-8", "surrogatepass"), size)
        if not hashes:
            continue
        n, ones = len(hashes), np.zeros(64, np.int64)
        raw = np.array(hashes, np.uint64).view(np.uint8).reshape(n, 8)
        for k in range(0, n, 4096):
            ones += np.unpackbits(raw[k : k + 4096], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[i] = weights[2 * ones > n].sum(dtype=np.uint64)
    return out.view(np.int64)


def fingerprints(docs: DataFrame, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, fp`` of every document; null and empty texts have fingerprint 0."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = fingerprints_of([t or "" for t in batch.column(1).to_pylist()], size)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=[id_col, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(tidied(run), f"{id_col} {kind}, fp long")


# Golay keys


@cache
def golay() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of all bytes at the three byte places of a word, and the error pattern of each syndrome."""
    one = []
    for i in range(23):
        r = 1 << i
        for k in range(22, 10, -1):
            if r >> k & 1:
                r ^= GENERATOR << (k - 11)
        one.append(r)
    places = np.zeros((3, 256), np.int64)
    for p in range(3):
        for b in range(256):
            for i in range(8):
                if b >> i & 1 and 8 * p + i < 23:
                    places[p, b] ^= one[8 * p + i]
    errors = np.zeros(2048, np.int64)
    for i in range(23):
        errors[one[i]] = 1 << i
        for j in range(i):
            errors[one[i] ^ one[j]] = 1 << i | 1 << j
            for k in range(j):
                errors[one[i] ^ one[j] ^ one[k]] = 1 << i | 1 << j | 1 << k
    return places, errors


def decode(words: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the codeword nearest to each 23-bit word."""
    places, errors = golay()
    syndrome = places[0][words & 255] ^ places[1][words >> 8 & 255] ^ places[2][words >> 16 & 255]
    return (words ^ errors[syndrome]) >> 11


def indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and the different codeword indices of each word and its one-bit neighbours."""
    around = np.concatenate([np.zeros(1, np.int64), np.int64(1) << np.arange(23, dtype=np.int64)])
    found = np.sort(decode(words[:, None] ^ around[None, :]), axis=1)
    new = np.ones(found.shape, bool)
    new[:, 1:] = found[:, 1:] != found[:, :-1]
    row, col = np.nonzero(new)
    return row, found[row, col]


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and keys of each signed fingerprint."""
    u, parts, at = fps.view(np.uint64), [], 0
    for bits in SEGMENTS:
        parts.append(((u >> np.uint64(at)) & np.uint64((1 << bits) - 1)).astype(np.int64))
        at += bits
    rows, keys = [], []
    for i in range(3):
        row, index = indices(parts[(i + 1) % 3])
        rows.append(row)
        keys.append(np.int64(i) << 40 | parts[i][row] << 12 | index)
    return np.concatenate(rows), np.concatenate(keys)


def golay_keys(nodes: DataFrame) -> DataFrame:
    """``key, fp, rep`` for all keys of ``nodes(fp, rep)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, rep = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            row, key = keys_of(fp)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row]), pa.array(rep[row])], names=["key", "fp", "rep"])

    return nodes.select("fp", "rep").mapInArrow(tidied(run), "key long, fp long, rep long")


def links(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """``a, b``: representatives that connect all fingerprints of ``nodes(fp, rep)`` within ``MAX_BITS``.

    Every pair within a bucket of at most ``MAX_BUCKET`` is verified and
    emitted; larger buckets give the stars of shared one-bit neighbours, which
    connect the same fingerprints.
    """
    keys = scratch.write(golay_keys(nodes), "keys")
    counts = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = scratch.write(keys.join(counts, "key"), "met")
    small = (
        met.where(F.col("n") <= MAX_BUCKET)
        .groupBy("key")
        .agg(F.collect_list(F.struct("fp", "rep")).alias("m"))
        .select(
            F.explode(
                F.expr(
                    "flatten(transform(m, (x, i) -> transform("
                    f"filter(slice(m, i + 2, size(m)), y -> bit_count(x.fp ^ y.fp) <= {MAX_BITS}), "
                    "y -> struct(x.rep as a, y.rep as b))))"
                )
            ).alias("e")
        )
        .select("e.a", "e.b")
    )
    near = F.expr("transform(sequence(0, 64), i -> if(i = 64, fp, fp ^ shiftleft(1L, i)))")
    large = (
        met.where(F.col("n") > MAX_BUCKET)
        .select("fp", "rep")
        .distinct()
        .select(F.explode(near).alias("z"), "rep")
        .groupBy("z")
        .agg(F.collect_list("rep").alias("m"))
        .where(F.size("m") > 1)
        .select(F.array_min("m").alias("a"), F.explode("m").alias("b"))
        .where("a <> b")
    )
    return small.unionByName(large).distinct()


def classes(docs_fp: DataFrame, scratch: Scratch) -> DataFrame:
    """``doc_id, fp, component_id`` of ``docs_fp(doc_id, fp)``.

    Documents whose fingerprints differ in at most two bits are linked;
    ``component_id`` is the least doc_id that is reachable. Copies count once:
    only different fingerprints are linked, each under its least doc_id. Rows
    with a null doc_id take part in no link and have a null component.
    """
    docs_fp = scratch.write(docs_fp, "fps")
    nodes = scratch.write(docs_fp.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    roots = components(links(nodes, scratch), scratch)
    known = nodes.join(roots, nodes.rep == roots.node, "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    out = docs_fp.join(known, "fp", "left")
    return out.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
