"""Removal of near copies: SimHash with Golay keys at five words and a similarity of 0.8.

At a Jaccard similarity of 0.8 between the sets of five-word shingles, a bit of
two SimHash fingerprints differs with probability 0.15, so 64 bits differ in about
ten. No key of one such fingerprint is both selective and complete there.
Fingerprints are therefore ``TABLES`` times two Golay segments of 23 bits: two
words share a codeword index for sure up to two differing bits, and mostly up
to four. A table's keys are the pairs of indices of its two segments.

1. *Copies.* Texts with equal shingle sets are one group; its least document stands
   for it from here on.
2. *Nearest codewords.* Each representative has one key a table. Rows of a key are
   sorted by fingerprint and each is compared with the following ``REACH``; it names
   its nearest as its candidate, and the texts decide. A large group of near copies
   is linked here, at ``TABLES`` rows a document, and one document of each linked group
   goes on.
3. *Nearby codewords.* What is left goes through all its keys in the same way.
4. *The rest.* Reach and keys bound the work of 2 and 3 and so can miss pairs. An
   exact search decides those: under one order of all shingles, the rarer
   first, two sets of the similarity share one of the first ``n - ceil(0.8 n) + 1``
   shingles of both, early enough that what follows can still make up the overlap.
   Pairs of such a shingle whose documents are in different groups are candidates. Where
   a group has more than ``MEMBERS`` documents with the shingle one of them asks
   first; groups that this does not join are then compared member by member.

Groups are therefore exactly the connected components of the pairs at 0.8 or more,
decided on the words themselves; hashes only choose what is compared. Work is linear
where 2 and 3 have linked a hot shingle's documents; documents that share one
but stay apart are compared in pairs, as nothing less is exact.

Texts are read where they lie. They move only for candidates: the ids of those are
broadcast up to ``common.BROADCAST_ROWS``, beyond that joined by a shuffle.

Defined results: null and empty texts have the empty set and are copies of each
other; texts of fewer than five words are one shingle; of repeated rows one stays; rows that
share an id with different texts are documents of their own; rows without id take no part and stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fotolith.llm.common import Scratch, fresh, partitions, prepare, sided, tidied
from fotolith.llm.components import components
from fotolith.llm.rules import _mix
from fotolith.llm.simhash import decode, indices, shingle_hashes

SIZE, SIMILARITY = 5, 0.8
#: Tables of two 23-bit segments: 184 bits.
TABLES = 4
SEGMENT = 23
#: Differing bits of all tables up to which a pair is worth its exact similarity (0.8 gives 28 ± 5).
NEAR_BITS = 40
#: Rows of a key that each is compared with; candidates that a document tries.
REACH, BEST = 48, 4

#: Bits of a shingle hash that name its counter, for the order of shingles; blobs that the counters are added in.
COUNTER_BITS, SLICES = 20, 16
#: Documents of one group that all meet another group's at once.
MEMBERS = 8
#: Rows of a shingle up to which shingles are paired many at a time.
SMALL = 64
#: Pairs of one Arrow batch; shingles of one message.
PAIRS, ELEMENTS = 1 << 16, 1 << 19
#: Shingles of a bucket (40 bytes each), and the least number of buckets for each shuffle partition.
BUCKET_SHINGLES, BUCKETS_A_PARTITION = 1 << 20, 4

#: A fingerprint as longs.
WORDS = -(-2 * TABLES * SEGMENT // 64)
BITS = [f"b{i}" for i in range(WORDS)]
_BITS = ", ".join(f"{b} long" for b in BITS)
_NODE = f"node long, name binary, {_BITS}, slice int, counts binary"
_PAIRS = "a long, b long"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(text: str | None) -> set[tuple]:
    """The set of a text's shingles, as words."""
    words = words_of(text)
    if len(words) <= SIZE:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k : len(words) - SIZE + 1 + k] for k in range(SIZE))))


def hashes_of(text: str | None) -> np.ndarray:
    """The different hashes of a text's shingles, ascending."""
    return np.unique(np.array(shingle_hashes((text or "").encode("utf-8", "surrogatepass"), SIZE), np.uint64))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The fingerprint of a set of shingle hashes, as ``WORDS`` longs."""
    ones = np.zeros((WORDS, 64), np.int64)
    for w in range(WORDS if len(hashes) else 0):
        raw = _mix(hashes + np.uint64((w + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)).view(np.uint8).reshape(-1, 8)
        for k in range(0, len(raw), 4096):
            ones[w] += np.unpackbits(raw[k : k + 4096], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = 2 * ones.ravel() > len(hashes)
    bits[2 * TABLES * SEGMENT :] = False
    return np.packbits(bits, bitorder="little").view(np.int64)


def segments(bits: np.ndarray) -> np.ndarray:
    """The 23-bit words of fingerprints, one row for each fingerprint."""
    flat = np.unpackbits(np.ascontiguousarray(bits).view(np.uint8), axis=1, bitorder="little")[:, : 2 * TABLES * SEGMENT]
    return flat.reshape(-1, 2 * TABLES, SEGMENT) @ (np.int64(1) << np.arange(SEGMENT, dtype=np.int64))


def columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [c.to_numpy(zero_copy_only=False) for c in batch.columns]


def pair_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def nodes_of(docs: DataFrame) -> DataFrame:
    """``node, name`` and fingerprint of every row of ``docs(node, text)``; equal names have equal shingle sets.

    Rows without a node hold the partition's counts of shingles by counter, in ``SLICES`` slices.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNTER_BITS, np.int64)
        for batch in batches:
            names, bits = [], []
            seen = [np.zeros(0, np.uint64)]
            for text in batch.column(1).to_pylist():
                own = hashes_of(text)
                names.append(np.array([_mix(own).sum(dtype=np.uint64), np.bitwise_xor.reduce(_mix(own + np.uint64(77))) if len(own) else 0, len(own)], np.uint64).tobytes())
                bits.append(sketch(own))
                seen.append(own)
            total += np.bincount((np.concatenate(seen) >> np.uint64(64 - COUNTER_BITS)).astype(np.int64), minlength=len(total))
            words = [pa.array(w) for w in np.array(bits, np.int64).reshape(-1, WORDS).T.copy()]
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.binary()), *words, pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=["node", "name", *BITS, "slice", "counts"])
        blobs = pa.array([x.tobytes() for x in np.split(total, SLICES)], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.nulls(SLICES, pa.int64()), pa.nulls(SLICES, pa.binary()), *([pa.nulls(SLICES, pa.int64())] * WORDS), pa.array(range(SLICES), pa.int32()), blobs], names=["node", "name", *BITS, "slice", "counts"])

    return docs.select("node", "text").mapInArrow(tidied(run), _NODE)


def add_counts(parts: DataFrame) -> np.ndarray:
    """How many documents' shingles fall to each counter: a fixed number of them, whatever the corpus."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in zip(*(c.to_pylist() for c in batch.columns)):
                total[k] = total.get(k, 0) + np.frombuffer(x, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(total, pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["slice", "counts"])

    made = parts.select("slice", "counts").repartition(SLICES, "slice").mapInArrow(tidied(add), "slice int, counts binary")
    found = {r["slice"]: np.frombuffer(r["counts"], np.int64) for r in made.collect()}
    size = 1 << COUNTER_BITS
    return np.concatenate([found.get(k, np.zeros(size // SLICES, np.int64)) for k in range(SLICES)])


# Golay keys


def keys_of(nodes: DataFrame, nearby: bool) -> DataFrame:
    """``key, node`` and the fingerprint: one key a table, or with ``nearby`` those of all nearby codewords."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, *bits = columns(batch)
            words = segments(np.column_stack(bits))
            for t in range(TABLES):
                if nearby:
                    (ra, a), (rb, b) = indices(words[:, 2 * t]), indices(words[:, 2 * t + 1])
                    nb = np.bincount(rb, minlength=len(node))
                    starts, reps = np.cumsum(nb) - nb, nb[ra]
                    row = np.repeat(ra, reps)
                    within = np.arange(len(row)) - np.repeat(np.cumsum(reps) - reps, reps)
                    key = np.repeat(a, reps) << 12 | b[starts[row] + within]
                else:
                    row = np.arange(len(node))
                    key = decode(words[:, 2 * t]) << 12 | decode(words[:, 2 * t + 1])
                key = np.int64(t) << 24 | key
                yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), pa.array(node[row]), *(pa.array(x[row]) for x in bits)], names=["key", "node", *BITS])

    return nodes.select("node", *BITS).mapInArrow(tidied(run), f"key int, node long, {_BITS}")


def candidates(keys: DataFrame) -> DataFrame:
    """``a, b, d``: the nearest row of an equal key within ``NEAR_BITS``, for each row that has one."""

    def pairs(key: np.ndarray, node: np.ndarray, bits: np.ndarray) -> pa.RecordBatch:
        n = len(key)
        best = np.full(n, NEAR_BITS + 1)
        mate = np.full(n, -1)
        words = bits.view(np.uint64)  # bits of signed numbers are counted without their sign
        for lag in range(1, REACH + 1):
            at = np.flatnonzero(key[lag:] == key[:-lag])
            if not len(at):
                break
            d = np.bitwise_count(words[at] ^ words[at + lag]).sum(axis=1, dtype=np.int64)
            near = d <= NEAR_BITS
            at, d = at[near], d[near]
            for i, j in ((at, at + lag), (at + lag, at)):
                closer = d < best[i]
                best[i[closer]], mate[i[closer]] = d[closer], j[closer]
        i = np.flatnonzero(mate >= 0)
        # A document is told once of each neighbour, whatever the number of keys that they share here.
        told = np.unique(np.column_stack([node[i], node[mate[i]], best[i]]), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(told[:, 0]), pa.array(told[:, 1]), pa.array(told[:, 2].astype(np.int32))], names=["a", "b", "d"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for batch in batches:
            one, two, *bits = columns(batch)
            now = (one, two, np.column_stack(bits))
            if held is not None:
                now = tuple(np.concatenate([x, y]) for x, y in zip(held, now))
            key = now[0]
            if len(key) < 1 << 16:
                held = now
                continue
            yield pairs(*(np.ascontiguousarray(x) for x in now))
            # The last key may go on in the next batch: keep what its rows can still reach.
            cut = int(np.searchsorted(key, key[-1], side="left"))
            held = tuple(x[max(cut, len(key) - REACH) :].copy() for x in now)
        if held is not None and len(held[0]):
            yield pairs(*(np.ascontiguousarray(x) for x in held))

    # Ranges, not hashes: a key that very many fingerprints share is cut where they differ.
    dealt = keys.repartitionByRange(partitions(keys.sparkSession), "key", BITS[0], "node").sortWithinPartitions("key", *BITS, "node")
    return dealt.mapInArrow(tidied(run), "a long, b long, d int")


# Texts of candidates


class Texts:
    """The texts of nodes, wherever they lie."""

    def __init__(self, docs: DataFrame, scratch: Scratch):
        self.docs, self.scratch = docs, scratch

    def of(self, wanted: DataFrame) -> DataFrame:
        """``node, text`` of the different nodes ``wanted(node)``."""
        return self.docs.select("node", "text").join(sided(wanted), "node", "left_semi")

    def similar(self, edges: DataFrame, name: str) -> DataFrame:
        """The different ``a, b`` of ``edges`` whose shingle sets have the similarity."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last, own = None, set()
            for batch in batches:
                good = []
                a, b, x, y = (c.to_pylist() for c in batch.columns)
                for hub, left, right in zip(b, x, y):
                    if hub != last:  # rows of one hub follow each other
                        last, own = hub, shingles(right)
                    other = shingles(left)
                    both = len(own & other)
                    good.append(both >= SIMILARITY * (len(own) + len(other) - both))
                yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(good, pa.bool_())) for k in (0, 1)], names=["a", "b"])

        edges = self.scratch.write(edges.distinct(), f"{name}-asked")
        wanted = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
        texts = self.scratch.write(self.of(wanted), f"{name}-texts")
        left = edges.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")).hint("merge"), "a")
        both = left.join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")).hint("merge"), "b")
        found = self.scratch.write(both.select("a", "b", "x", "y").mapInArrow(tidied(run), _PAIRS), name)
        self.scratch.drop(f"{name}-texts")
        return found


# What the keys miss


def firsts(rooted: DataFrame, counts: np.ndarray, buckets: int) -> DataFrame:
    """``bucket, rows``: the first shingles of the sets of ``rooted(node, root, text)``, the rarer first.

    A message holds many shingles of one bucket, sorted, column by column and
    compressed: name, node, root, set size and how many follow in the set, itself included.
    """
    shared = rooted.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            # Documents become places in the message's own list; the list comes with each bucket's rows that need it.
            reps = np.array([len(x[3]) for x in held], np.int64)
            name = np.concatenate([x[3] for x in held])
            left = np.concatenate([x[2] - np.arange(len(x[3])) for x in held])
            who = np.repeat(np.arange(len(held)), reps)
            bucket = (name % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((name, bucket))
            name, left, who, bucket = name[order], left[order], who[order], bucket[order]
            node, root, total = (np.array([x[k] for x in held], np.int64) for k in (0, 1, 2))
            at = np.flatnonzero(np.diff(bucket, prepend=-1))
            ends = np.append(at[1:], len(bucket))
            rows = []
            for a, b in zip(at.tolist(), ends.tolist()):
                w = who[a:b]
                cols = [np.diff(name[a:b], prepend=np.uint64(0)), node[w], root[w] - node[w], total[w], left[a:b]]
                # Bytes of equal weight together: most are zero or alike.
                flat = b"".join(np.ascontiguousarray(c.astype(np.int64 if c.dtype != np.uint64 else np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes() for c in cols)
                rows.append(press.compress(flat))
            return pa.RecordBatch.from_arrays([pa.array(bucket[at]), pa.array(rows, pa.binary())], names=["bucket", "rows"])

        for batch in batches:
            for node, root, text in zip(*(c.to_pylist() for c in batch.columns)):
                own = hashes_of(text)
                n = len(own)
                if not n:
                    continue
                k = n - int(np.ceil(SIMILARITY * n - 1e-6)) + 1
                order = np.lexsort((own, shared.value[own >> np.uint64(64 - COUNTER_BITS)]))
                held.append((node, root, n, own[order[:k]]))
                size += k
                if size >= ELEMENTS:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return rooted.select("node", "root", "text").mapInArrow(tidied(run), "bucket long, rows binary")


def unpack(blob: bytes) -> list[np.ndarray]:
    """Name, node, root, size and rest of a message's shingles."""
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    n = len(flat) // 40
    cols = [np.ascontiguousarray(x.reshape(8, n).T).view(np.int64).ravel() for x in np.split(flat, 5)]
    name, node, root, size, left = cols
    return [np.cumsum(name.view(np.uint64), dtype=np.uint64), node, root + node, size, left]


def fits(rows: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether two rows of a shingle are of different groups and can have the similarity."""
    _, _, root, n, left = rows
    share = SIMILARITY / (1 + SIMILARITY)
    return (root[i] != root[j]) & (np.minimum(left[i], left[j]) >= share * (n[i] + n[j]) - 1e-6)


def all_pairs(rows: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of whole shingles that fit; rows are sorted by name, then group."""
    key = rows[0]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.append(starts, len(key)))
    small = np.repeat(sizes <= SMALL, sizes)
    for lag in range(1, min(SMALL, len(key))):
        i = np.flatnonzero((key[lag:] == key[:-lag]) & small[lag:])
        if not len(i):
            break
        i = i[fits(rows, i, i + lag)]
        yield i, i + lag
    for s, m in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
        root = rows[2][s : s + m]
        ends = s + np.append(np.flatnonzero(root[1:] != root[:-1]) + 1, m)
        end = ends[np.searchsorted(ends, np.arange(s, s + m), side="right")]
        for x, e in zip(range(s, s + m), end.tolist()):
            others = np.arange(e, s + m)
            me = np.full(len(others), x)
            good = fits(rows, me, others)
            yield me[good], others[good]


def open_pairs(messages: DataFrame, buckets: int, whole: bool) -> DataFrame:
    """``a, b, more``: pairs of a shingle whose groups differ and that can have the similarity.

    Unless ``whole``, of more than ``MEMBERS`` documents of a group with a shingle
    one is paired; rows with ``more`` then name documents of the groups that met there.
    """

    def pairs(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((rows[1], rows[2], rows[0]))
        rows = [x[order] for x in rows]

        def starts_of(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
            key, _, root, _, _ = rows
            keyed = np.concatenate([[True], key[1:] != key[:-1]])
            return keyed, keyed | np.concatenate([[True], root[1:] != root[:-1]])

        # Shingles of one group are settled.
        keyed, run = starts_of(rows)
        group = np.cumsum(keyed) - 1
        rows = [x[(np.bincount(group, weights=run) > 1)[group]] for x in rows]
        if not len(rows[0]):
            return
        flagged: list[np.ndarray] = []
        if not whole:
            keyed, run = starts_of(rows)
            number, group = np.cumsum(run) - 1, np.cumsum(keyed) - 1
            large = np.bincount(number) > MEMBERS
            if large.any():
                heads = np.flatnonzero(run)
                met = np.isin(group[heads], group[heads[large]])
                at = heads[met]
                star = at[np.searchsorted(group[at], group[at], side="left")]
                flagged = [rows[1][star[at != star]], rows[1][at[at != star]]]
                stay = ~large[number] | run
                rows = [x[stay] for x in rows]
        node, made, n = rows[1], [], 0

        def flush() -> pa.RecordBatch:
            a, b = (np.concatenate(x) for x in zip(*made))
            both = np.unique(np.column_stack([np.minimum(a, b), np.maximum(a, b)]), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(np.zeros(len(both), bool))], names=["a", "b", "more"])

        for i, j in all_pairs(rows):
            if len(i):
                made.append((node[i], node[j]))
                n += len(i)
            if n >= PAIRS:
                yield flush()
                made, n = [], 0
        if made:
            yield flush()
        if flagged and len(flagged[0]):
            both = np.unique(np.column_stack(flagged), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(np.ones(len(both), bool))], names=["a", "b", "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        for batch in batches:
            for bucket, blob in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != last and held:
                    yield from pairs([np.concatenate(x) for x in zip(*held)])
                    held = []
                last = bucket
                held.append(unpack(blob))
        if held:
            yield from pairs([np.concatenate(x) for x in zip(*held)])

    parts = partitions(messages.sparkSession)
    dealt = messages.repartitionById(parts, F.col("bucket").cast("int")).sortWithinPartitions("bucket")
    return dealt.mapInArrow(tidied(run), "a long, b long, more boolean").distinct()


class Groups:
    """The groups of near copies among ``docs(node, text)``, built step by step."""

    def __init__(self, docs: DataFrame, scratch: Scratch):
        self.docs, self.scratch, self.texts = docs, scratch, Texts(docs, scratch)
        spark = docs.sparkSession
        made = scratch.write(nodes_of(docs), "nodes")
        nodes = made.where("node is not null")
        self.counts = add_counts(made.where("slice is not null"))
        # A fifth of all shingles, the first of each set, go to buckets.
        self.buckets = max(BUCKETS_A_PARTITION * partitions(spark), int((1 - SIMILARITY) * self.counts.sum()) // BUCKET_SHINGLES)
        # Of rows that share a set one, combined on the map side.
        least = nodes.groupBy("name").agg(F.min_by(F.struct("node", *BITS), "node").alias("n"), F.count(F.lit(1)).alias("k"))
        self.one = scratch.write(least.select("name", "n.*", "k"), "one")
        shared = self.one.where("k > 1").select("name", F.col("node").alias("first"))
        #: Nodes whose set an earlier one has.
        self.copies = scratch.write(nodes.select("name", "node").join(shared.hint("merge"), "name").where("node <> first").select("node"), "copies")
        #: ``node, root`` of linked nodes that are not the least of their group.
        self.roots = spark.createDataFrame([], "node long, root long")
        self.step = 0

    def add(self, edges: DataFrame) -> bool:
        """Link those of the edges that have the similarity; False if none has."""
        self.step += 1
        found = self.texts.similar(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), f"links{self.step}")
        if found.isEmpty():
            return False
        # A root for each linked node says what all earlier links did.
        known = self.roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
        self.roots = self.scratch.write(components(known.unionByName(found), Scratch(self.scratch.spark, "groups")), f"roots{self.step}")
        return True

    def by_keys(self, nearby: bool) -> None:
        """Link near rows of equal keys, among the least documents of the groups so far."""
        active = self.one.select("node", *BITS).join(sided(self.roots.select("node")), "node", "left_anti")
        found = candidates(keys_of(active, nearby)).groupBy("a", "b").agg(F.min("d").alias("d"))
        best = found.groupBy("a").agg(F.slice(F.sort_array(F.collect_list(F.struct("d", "b"))), 1, BEST).alias("m"))
        self.add(best.select("a", F.explode("m").alias("e")).select("a", F.col("e.b").alias("b")))

    def rooted(self, docs: DataFrame) -> DataFrame:
        """``node, root, text`` of the documents that stand for a set."""
        known = self.copies.select("node", F.lit(None).cast("long").alias("root"), F.lit(True).alias("copy"))
        known = known.unionByName(self.roots.select("node", "root", F.lit(False).alias("copy")))
        met = docs.select("node", "text").join(sided(known), "node", "left").where("not coalesce(copy, false)")
        return met.select("node", F.coalesce("root", "node").alias("root"), "text")

    def by_shingles(self) -> None:
        """Link what the keys have missed."""
        found = self.scratch.write(open_pairs(firsts(self.rooted(self.docs), self.counts, self.buckets), self.buckets, False), "open")
        self.add(found.where("not more").select("a", "b"))
        met = found.where("more").select("a", "b")
        for end in ("a", "b"):
            met = met.join(self.roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")), end, "left")
            met = met.withColumn(f"root_{end}", F.coalesce(f"root_{end}", end))
        apart = self.scratch.write(met.where("root_a <> root_b").select(F.explode(F.array("root_a", "root_b")).alias("root")).distinct(), "apart")
        if apart.isEmpty():
            return
        members = self.roots.join(apart, "root", "left_semi").select("node").unionByName(apart.select(F.col("root").alias("node")))
        rest = self.scratch.write(self.texts.of(members.distinct()), "apart-texts")
        self.add(open_pairs(firsts(self.rooted(rest), self.counts, self.buckets), self.buckets, True).select("a", "b"))

    def gone(self) -> DataFrame:
        """``node`` of all documents but the least of each group."""
        return self.copies.unionByName(self.roots.select("node"))


def groups(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``node``: of ``docs(node, text)``, whose nodes differ, all but the least of each group of near copies."""
    found = Groups(docs, scratch)
    found.by_keys(nearby=False)
    found.by_keys(nearby=True)
    found.by_shingles()
    return found.gone()


def keep_one(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The documents without near copies: of each group the least doc_id stays, once; same columns."""
    prepare(docs.sparkSession)
    node = fresh(docs, "node")
    known = docs.where("doc_id is not null")
    if known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").isEmpty():
        known = known.withColumn(node, F.col("doc_id").cast("long"))
    else:
        # Rows that share an id are numbered in order of the ids.
        dealt = known.withColumn(node, F.xxhash64("text")).repartitionByRange(partitions(docs.sparkSession), "doc_id", node).sortWithinPartitions("doc_id", node)
        known = scratch.write(dealt.withColumn(node, F.monotonically_increasing_id()), "numbered")
    gone = scratch.write(groups(known.select(F.col(node).alias("node"), "text"), scratch), "gone")
    kept = known.join(sided(gone.withColumnRenamed("node", node)), node, "left_anti").select(docs.columns)
    return kept.unionByName(docs.where("doc_id is null"))
