"""Removal of repeated byte strings by difference-cover suffix sorting.

A byte goes if it is covered by a ``WIDTH``-byte string that also starts in a
document with a smaller id. Matches never cross documents; overlaps count.

``COVER`` is a difference cover of the residues modulo ``PERIOD``: for any two
positions there is a shift of at most 30 bytes after which both are sampled, and a
triple of ``TRIPLE`` bytes that starts there still lies inside the ``WIDTH`` bytes.

1. *Sort sampled triples.* Triples (three symbols of seven, six and six bytes) that
   occur once are discarded first: a fingerprint of each goes to the bucket of its
   value, and those that no second one equals stay at home. The others are dealt by
   ranges of their text, sorted there, and named by bucket and rank, so names have
   the order of the text.
2. *Recurse on names.* The suffix of a sampled position is the name of its triple,
   the twelve bytes up to the next sample of its residue class, and that one's
   name: ``WIDTH`` bytes in all, the depth that is compared. These triples are sorted
   in the bucket of their first name and named by rank in turn. Pairs of such names
   that follow each other, sorted alike, tell where all starts between two sampled
   positions stand in an earlier document.
3. *Merge remaining suffixes.* A start that lies in no covered run, and has an
   anchor (a sampled triple within the shift) whose name an earlier document holds, asks
   for the anchor's context; blocks with a context that a later document asks for
   answer with the starts around it, but for those that an earlier document has for
   sure, which answers in their place. Both are dealt by ranges of their text and sorted.
4. *Compare adjacent prefixes.* In either order, equal strings stand together by
   document; all but the first block's are covered.

Results do not rest on hashes: fingerprints of triples and contexts only decide what
is sorted, and equal strings have equal fingerprints.

Documents are dealt by ranges of their id to blocks, so the number of a block
says which of two documents is smaller, and a block sends each different string
once: a passage that a third of the documents share costs one string a block.
The text is shuffled once; blocks lie compressed in a bucketed table of the shared
folder, which later steps read without a shuffle. Buckets grow in number with the text; their ranges are cut by
whole strings, so a beginning that many strings share is cut like any other. Of very large
corpora blocks and buckets grow too (``grown``), and so does what a task holds.

Defined results: null texts are empty; rows without id keep their text and take
no part; rows that share an id are no smaller than each other (they stay in one
block); shorter documents than ``WIDTH`` keep everything; an empty table gives no
rows. ``carry`` names further columns that come back unchanged, none of them named like a result.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fotolith.llm.common import Scratch, partitions, prepare, release, tidied
from fotolith.llm.rules import _mix

WIDTH = 50
#: A perfect difference set; every residue is a difference of two of them.
PERIOD, COVER = 31, (0, 4, 10, 23, 24, 26)
#: Bytes of a triple; it lies inside a string after any shift below the period.
TRIPLE = WIDTH - PERIOD
#: Bytes between a triple and the next of its residue class.
GAP = PERIOD - TRIPLE
#: Bytes of an anchor's context, and the shifts that one serves beyond its own.
CONTEXT, SLACK = 40, WIDTH - 40
#: A block ends at this many bytes, at a change of the document id.
BLOCK_BYTES = 2 << 20
#: Bytes of text for each bucket of strings.
BUCKET_BYTES = 16 << 20
#: Text from which on blocks and buckets are larger.
STEADY_BYTES = 32 << 30
#: Bits of a fingerprint beyond those that number the bytes of the corpus.
SPARE_BITS = 6
#: Bits of the marks by which a block knows its repeated fingerprints again.
MARK_BITS = 24
#: Samples of a block that tell where ranges of text are cut, and the most that are looked at.
PROBES, MAX_PROBES = 32, 1 << 17

#: Carried columns keep nulls and microseconds.
JSON_OPTIONS = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}

Found = list | None


# Arrays


def pack(columns: list[np.ndarray]) -> bytes:
    """Columns of numbers, compressed; bytes of equal weight lie together, most of them alike."""
    flat = b"".join(np.ascontiguousarray(c.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns)
    return zstandard.ZstdCompressor(level=1).compress(flat)


def unpack(blob: bytes, n: int) -> list[np.ndarray]:
    """The ``n`` columns of ``pack``."""
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return [np.ascontiguousarray(x.reshape(8, -1).T).view("<u8").ravel() for x in np.split(flat, n)]


def steps(sorted_values: np.ndarray) -> np.ndarray:
    return np.diff(sorted_values, prepend=sorted_values.dtype.type(0))


def changes(columns: list[np.ndarray]) -> np.ndarray:
    """Where a sorted row differs from the one before."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = False
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return new


def folded(columns: list[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of each row."""
    total = np.zeros(len(columns[0]), np.uint64)
    for k, c in enumerate(columns):
        total += c * np.uint64((2 * k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    return _mix(total)


@dataclass
class Distinct:
    """The different rows of some columns, sorted: each item's place among them, the first item of each, and which repeat."""

    place: np.ndarray
    item: np.ndarray
    many: np.ndarray

    @classmethod
    def of(cls, columns: list[np.ndarray], whole: bool = True) -> Distinct:
        """Sorted by all columns, or only by the first unless ``whole``."""
        # Equal rows are brought together by a hash, which is checked, and only different ones are sorted.
        name = folded(columns) if len(columns) > 1 else columns[0]
        order = np.argsort(name)
        new = changes([name[order]])
        if len(columns) > 1 and not np.array_equal(new, changes([c[order] for c in columns])):
            order = np.lexsort(columns[::-1])  # two rows have one hash
            new = changes([c[order] for c in columns])
        starts = np.flatnonzero(new)
        item = np.minimum.reduceat(order, starts) if len(starts) else order
        many = np.diff(starts, append=len(order)) > 1
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        if len(columns) == 1:
            return cls(group, item, many)
        sort = np.lexsort([c[item] for c in columns[::-1]]) if whole else np.argsort(columns[0][item])
        place = np.empty(len(sort), np.int64)
        place[sort] = np.arange(len(sort))
        return cls(place[group], item[sort], many[sort])


def ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Half-open intervals, sorted by start, joined where they touch or overlap: rows of start and stop."""
    stay = low < high
    low, high = low[stay], high[stay]
    if not len(low):
        return np.zeros((0, 2), np.int64)
    sort = np.argsort(low, kind="stable")
    low, reach = low[sort], np.maximum.accumulate(high[sort])
    at = np.flatnonzero(np.concatenate([[True], low[1:] > reach[:-1]]))
    return np.column_stack([low[at], reach[np.append(at[1:] - 1, len(reach) - 1)]])


def members(spans: np.ndarray) -> np.ndarray:
    """All numbers of disjoint intervals."""
    size = spans[:, 1] - spans[:, 0]
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - size, size) + np.repeat(spans[:, 0], size)


def inside(values: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Whether each value lies in one of some disjoint sorted intervals."""
    at = np.searchsorted(spans[:, 0], values, side="right") - 1
    return (at >= 0) & (values < spans[np.maximum(at, 0), 1]) if len(spans) else np.zeros(len(values), bool)


# Blocks


@dataclass
class Block:
    """The bytes of some documents in order of their ids."""

    ids: np.ndarray
    lengths: np.ndarray
    data: bytes

    def __post_init__(self) -> None:
        self.n = len(self.data)
        self.ends = np.cumsum(self.lengths)
        padded = self.data + bytes(64)
        #: The eight bytes from each position on, as one number in the order of the text.
        self.words = np.ndarray((len(padded) - 7,), ">u8", padded, strides=(1,))
        self.order = np.cumsum(np.concatenate([[0], self.ids[1:] != self.ids[:-1]])) if len(self.ids) else self.ids

    @classmethod
    def read(cls, ids: bytes, lengths: bytes, data: bytes) -> Block:
        return cls(np.frombuffer(ids, np.int64), np.frombuffer(lengths, np.int64), zstandard.ZstdDecompressor().decompress(data))

    def documents(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, at, side="right")

    def ranks(self, at: np.ndarray) -> np.ndarray:
        """The order of the documents that positions lie in; equal ids rank alike."""
        return self.order[self.documents(at)]

    def word(self, at: np.ndarray, size: int = 8) -> np.ndarray:
        """The next bytes of each position, eight or fewer, as a number."""
        return self.words[at].astype(np.uint64) >> np.uint64(64 - 8 * size)

    def samples(self) -> np.ndarray:
        """The sampled positions, counted from their document's start, whose triple lies in the document."""
        periods = -(-self.lengths // PERIOD)
        first = np.repeat(np.cumsum(periods) - periods, periods)
        base = np.repeat(self.ends - self.lengths, periods) + PERIOD * (np.arange(len(first)) - first)
        at = (base[:, None] + np.array(COVER)).ravel()
        return at[np.repeat(self.ends, len(COVER) * periods) - at >= TRIPLE]

    def triples(self, at: np.ndarray) -> list[np.ndarray]:
        return [self.word(at), self.word(at + 8), self.word(at + 16, TRIPLE - 16)]

    def strings(self, at: np.ndarray) -> list[np.ndarray]:
        return [*(self.word(at + k) for k in range(0, 48, 8)), self.word(at + 48, WIDTH - 48)]

    def starts(self, anchors: np.ndarray) -> np.ndarray:
        """The intervals of whole strings that have one of the positions within the shift."""
        doc = self.documents(anchors)
        low = np.maximum(anchors - PERIOD + 1, (self.ends - self.lengths)[doc])
        return ranges(low, np.minimum(anchors, self.ends[doc] - WIDTH) + 1)


def earlier_of(block: Block, at: np.ndarray, found: Distinct, elsewhere: np.ndarray) -> np.ndarray:
    """Whether an equal row stands in an earlier document: ``elsewhere`` tells it of other blocks."""
    rank = block.ranks(at)
    return (elsewhere | np.zeros(len(found.item), bool))[found.place] | (rank > rank[found.item][found.place])


def by_bucket(bucket: np.ndarray, payload: Callable[[slice], bytes]) -> list[tuple[int, bytes]]:
    """A message for each bucket; items are sorted by bucket."""
    at = np.flatnonzero(np.diff(bucket, prepend=-1))
    return [(int(bucket[a]), payload(slice(a, b))) for a, b in zip(at.tolist(), [*at[1:].tolist(), len(bucket)])]


def flags(found: Found, sizes: np.ndarray) -> np.ndarray:
    """The bits of the answers, bucket by bucket; ``sizes``: items of each bucket that has some."""
    bits = [np.unpackbits(np.frombuffer(x["reply"], np.uint8), count=int(k)) for x, k in zip(found or [], sizes)]
    return np.concatenate(bits).astype(bool) if bits else np.zeros(0, bool)


def runs_of(bucket: np.ndarray) -> np.ndarray:
    """How many items each bucket that occurs has."""
    return np.diff(np.flatnonzero(np.diff(bucket, prepend=-1)), append=len(bucket))


@dataclass
class Plan:
    """What all blocks share: number of buckets, bits of a fingerprint, and where ranges of text are cut."""

    buckets: int
    bits: int
    cuts: list[np.ndarray]

    def bucket_of(self, columns: list[np.ndarray]) -> np.ndarray:
        """The range of text of each string, or of each triple, by all of its bytes."""
        cuts = self.cuts if len(columns) > 3 else [*self.cuts[:2], self.cuts[2] >> np.uint64(64 - 8 * (TRIPLE - 16))]
        found, high = (np.searchsorted(cuts[0], columns[0], side=side) for side in ("left", "right"))
        # Where cuts begin with the same eight bytes, the rest tells them apart, by halving.
        tied = np.flatnonzero(found < high)
        low, high, own = found[tied], high[tied], [c[tied] for c in columns]
        while (open_ := low < high).any():
            middle = np.minimum((low + high) // 2, len(cuts[0]) - 1)
            upto, same = np.zeros(len(tied), bool), np.ones(len(tied), bool)
            for cut, c in zip(cuts, own):
                upto |= same & (cut[middle] < c)
                same &= cut[middle] == c
            upto |= same
            low, high = np.where(open_ & upto, middle + 1, low), np.where(open_ & ~upto, middle, high)
        found[tied] = low
        return found

    def fingerprints(self, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Bucket (one of a power of two) and value of each row's fingerprint."""
        low = (self.buckets - 1).bit_length()
        value = folded(columns) >> np.uint64(64 - self.bits)
        return value & np.uint64((1 << low) - 1), value >> np.uint64(low)


# 1. Sampled triples


def send_fingerprints(block: Block, plan: Plan) -> list[tuple[int, bytes]]:
    """The different fingerprints of the sampled triples, and whether the block has one twice."""
    bucket, rest = plan.fingerprints(block.triples(block.samples()))
    key = np.sort(bucket << np.uint64(40) | rest)
    starts = np.flatnonzero(changes([key]))
    twice = np.diff(starts, append=len(key)) > 1
    key = key[starts]
    rest = key & np.uint64((1 << 40) - 1)
    return by_bucket((key >> np.uint64(40)).astype(np.int64), lambda s: pack([steps(rest[s]) << np.uint64(1) | twice[s]]))


def meet_fingerprints(payloads: list[bytes]) -> list[bytes]:
    """Of each block the values that occur again, in it or in another one."""
    parts = [unpack(p, 1)[0] for p in payloads]
    values = [np.cumsum(p >> np.uint64(1)) for p in parts]
    flat = np.concatenate(values)
    order = np.argsort(flat)
    new = changes([flat[order]])
    twice = ~new
    twice[:-1] |= ~new[1:]
    hit = (np.concatenate(parts) & np.uint64(1)).astype(bool)
    hit[order] |= twice
    ends = np.cumsum([len(v) for v in values]).tolist()
    return [pack([steps(flat[a:b][hit[a:b]])]) for a, b in zip([0, *ends[:-1]], ends)]


def repeated(block: Block, plan: Plan, found: Found) -> np.ndarray:
    """The sampled positions whose fingerprint occurs again, and few others whose fingerprint has the same last bits."""
    at = block.samples()
    bucket, rest = plan.fingerprints(block.triples(at))
    low = np.uint64((plan.buckets - 1).bit_length())
    known = np.zeros(1 << MARK_BITS, bool)
    mask = np.uint64(len(known) - 1)
    for x in found or []:
        known[(np.cumsum(unpack(x["reply"], 1)[0]) << low | np.uint64(x["bucket"])) & mask] = True
    return at[known[(rest << low | bucket) & mask]]


def split_bits(hit: np.ndarray, parts: list[np.ndarray]) -> list[bytes]:
    ends = np.cumsum([len(p) for p in parts]).tolist()
    return [np.packbits(hit[a:b]).tobytes() for a, b in zip([0, *ends[:-1]], ends)]


def triple_groups(block: Block, plan: Plan, at: np.ndarray) -> tuple[Distinct, list[np.ndarray], np.ndarray]:
    triples = block.triples(at)
    found = Distinct.of(triples)
    own = [t[found.item] for t in triples]
    return found, own, plan.bucket_of(own)


def send_triples(block: Block, plan: Plan, at: np.ndarray) -> list[tuple[int, bytes]]:
    _, own, bucket = triple_groups(block, plan, at)
    return by_bucket(bucket, lambda s: pack([steps(own[0][s]), own[1][s], own[2][s]]))


def sort_rows(parts: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of all parts, equal ones by part, and where the sorted rows change."""
    columns = [np.concatenate(c) for c in zip(*parts)]
    order = np.lexsort(columns[::-1])
    return order, changes([c[order] for c in columns])


def meet_triples(payloads: list[bytes]) -> list[bytes]:
    """The rank of each triple among the bucket's, whether an earlier block has it, and whether a later one."""
    parts = [(lambda c: [np.cumsum(c[0]), *c[1:]])(unpack(p, 3)) for p in payloads]
    order, new = sort_rows(parts)
    rank, bits = np.empty(len(order), np.uint64), np.empty(len(order), np.uint64)
    rank[order], bits[order] = np.cumsum(new) - 1, 2 * ~np.append(new[1:], True) + ~new
    out, a = [], 0
    for p in parts:
        b = a + len(p[0])
        out.append(pack([steps(rank[a:b]) << np.uint64(2) | bits[a:b]]))
        a = b
    return out


@dataclass
class Named:
    """Sampled positions whose triple occurs again, the triples' names, and whether an earlier and a later document have them."""

    at: np.ndarray
    name: np.ndarray
    earlier: np.ndarray
    later: np.ndarray

    def state(self) -> bytes:
        return pack([steps(self.at), self.name, 2 * self.later.astype(np.uint64) + self.earlier])

    @classmethod
    def load(cls, state: bytes) -> Named:
        at, name, bits = unpack(state, 3)
        return cls(np.cumsum(at).astype(np.int64), name, (bits & np.uint64(1)).astype(bool), bits >= 2)

    def of(self, some: np.ndarray) -> Named:
        return Named(self.at[some], self.name[some], self.earlier[some], self.later[some])


def named(block: Block, plan: Plan, at: np.ndarray, found: Found) -> Named:
    if not len(at):
        return Named(at, np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, bool))
    own, _, bucket = triple_groups(block, plan, at)
    codes = [unpack(x["reply"], 1)[0] for x in found]
    rank = np.concatenate([np.cumsum(c >> np.uint64(2)) for c in codes])
    name = bucket.astype(np.uint64) << np.uint64(32) | rank
    earlier, later = both_ways(block, at, own, np.concatenate(codes))
    return Named(at, name[own.place], earlier, later).of(earlier | later)


def both_ways(block: Block, at: np.ndarray, found: Distinct, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether an equal row stands in an earlier and in a later document; the last bits of ``code`` tell it of other blocks."""
    earlier = earlier_of(block, at, found, (code & np.uint64(1)).astype(bool))
    last = np.empty(len(found.item), np.int64)
    last[found.place] = np.arange(len(at))  # of repeated places the last one holds
    rank = block.ranks(at)
    return earlier, (code & np.uint64(2)).astype(bool)[found.place] | (rank < rank[last][found.place])


# 2. Names


def tuples(block: Block, own: Named) -> tuple[np.ndarray, Distinct, list[np.ndarray]]:
    """Positions whose whole string has names, the different strings' positions, and these as name, gap and name."""
    where = np.full(block.n + PERIOD + 1, -1)
    where[own.at] = np.arange(len(own.at))
    after = where[own.at + PERIOD]
    good = np.flatnonzero((after >= 0) & (block.ends[block.documents(own.at)] - own.at >= WIDTH)) if len(own.at) else np.zeros(0, np.int64)
    at = own.at[good]
    rows = [own.name[good], block.word(at + TRIPLE), block.word(at + TRIPLE + 8, GAP - 8), own.name[after[good]]]
    found = Distinct.of(rows, whole=False)
    return at, found, [r[found.item] for r in rows]


def buckets_of(names: np.ndarray) -> np.ndarray:
    return (names >> np.uint64(32)).astype(np.int64)


def send_tuples(block: Block, own: Named) -> list[tuple[int, bytes]]:
    _, _, rows = tuples(block, own)
    return by_bucket(buckets_of(rows[0]), lambda s: pack([steps(rows[0][s]), *(r[s] for r in rows[1:])]))


def meet_rows(width: int) -> Callable[[list[bytes]], list[bytes]]:
    """Bits: an equal row, whose first column is sent as steps, stands in an earlier block."""

    def meet(payloads: list[bytes]) -> list[bytes]:
        parts = [(lambda c: [np.cumsum(c[0]), *c[1:]])(unpack(p, width)) for p in payloads]
        order, new = sort_rows(parts)
        hit = np.empty(len(order), bool)
        hit[order] = ~new
        return split_bits(hit, [p[0] for p in parts])

    return meet


def meet_tuples(payloads: list[bytes]) -> list[bytes]:
    """The rank of each string among the bucket's, whether an earlier block has it, and whether a later one."""
    parts = [(lambda c: [np.cumsum(c[0]), *c[1:]])(unpack(p, 4)) for p in payloads]
    order, new = sort_rows(parts)
    code = np.empty(len(order), np.uint64)
    code[order] = (np.cumsum(new) - 1) * 4 + 2 * ~np.append(new[1:], True) + ~new
    ends = np.cumsum([len(p[0]) for p in parts]).tolist()
    return [pack([code[a:b]]) for a, b in zip([0, *ends[:-1]], ends)]


def strings(block: Block, own: Named, found: Found) -> tuple[np.ndarray, Named]:
    """The byte ranges of sampled strings that an earlier document has, and the strings that others have, with names."""
    at, different, rows = tuples(block, own)
    if not len(at):
        return np.zeros((0, 2), np.int64), own
    code = np.concatenate([unpack(x["reply"], 1)[0] for x in found])
    name = buckets_of(rows[0]).astype(np.uint64) << np.uint64(32) | code >> np.uint64(2)
    earlier, later = both_ways(block, at, different, code)
    gone = at[earlier]
    return ranges(gone, gone + WIDTH), Named(at, name[different.place], earlier, later).of(earlier | later)


def pairs(own: Named) -> tuple[np.ndarray, Distinct, list[np.ndarray]]:
    """Positions of named strings that another one of the class follows, and the different pairs of names."""
    after = np.searchsorted(own.at, own.at + PERIOD)
    good = np.flatnonzero(np.append(own.at, -1)[after] == own.at + PERIOD)
    rows = [own.name[good], own.name[after[good]]]
    found = Distinct.of(rows, whole=False)
    return own.at[good], found, [r[found.item] for r in rows]


def send_pairs(own: Named) -> list[tuple[int, bytes]]:
    _, _, rows = pairs(own)
    return by_bucket(buckets_of(rows[0]), lambda s: pack([steps(rows[0][s]), rows[1][s]]))


def known_starts(block: Block, own: Named, found: Found) -> np.ndarray:
    """The intervals of starts between two sampled strings that an earlier document has in the same way."""
    at, different, rows = pairs(own)
    if not len(at):
        return np.zeros((0, 2), np.int64)
    same = at[earlier_of(block, at, different, flags(found, runs_of(buckets_of(rows[0]))))]
    return ranges(same, same + PERIOD + 1)


# 3. Remaining suffixes


def claims(block: Block, own: Named, covered: np.ndarray) -> np.ndarray:
    """The starts that an earlier document may have and that lie in no covered run."""
    starts = members(block.starts(own.at[own.earlier]))
    whole = covered - np.array([0, WIDTH - 1])
    return starts[~inside(starts, whole[whole[:, 0] < whole[:, 1]])]


@dataclass
class Contexts:
    """The contexts of a block's anchors, and the starts (first and last) that each one serves.

    A string that has its anchor after ``a`` to ``a + SLACK`` bytes holds the ``CONTEXT``
    bytes from ``a`` before the anchor on; three of them serve all shifts.
    """

    low: np.ndarray
    high: np.ndarray
    found: Distinct
    bucket: np.ndarray
    rest: np.ndarray

    @classmethod
    def of(cls, block: Block, own: Named, plan: Plan) -> Contexts:
        doc = block.documents(own.at)
        first, last = (block.ends - block.lengths)[doc], block.ends[doc] - WIDTH
        low, high, buckets, rests = [], [], [], []
        for a in range(0, PERIOD - 1, SLACK):
            x, y = np.maximum(own.at - a - SLACK, first), np.minimum(own.at - a, last)
            good = x <= y
            at = own.at[good] - a
            bucket, rest = plan.fingerprints([np.full(len(at), a, np.uint64), *(block.word(at + k) for k in range(0, CONTEXT, 8))])
            for held, one in zip((low, high, buckets, rests), (x[good], y[good], bucket, rest)):
                held.append(one)
        bucket, rest = np.concatenate(buckets), np.concatenate(rests)
        found = Distinct.of([bucket << np.uint64(40) | rest])
        return cls(np.concatenate(low), np.concatenate(high), found, bucket[found.item].astype(np.int64), rest[found.item])

    def asked(self, starts: np.ndarray) -> np.ndarray:
        """Of each different context, whether one of the sorted ``starts`` is among those that it serves."""
        near = np.searchsorted(starts, self.low)
        out = np.zeros(len(self.found.item), bool)
        out[self.found.place[np.append(starts, np.iinfo(np.int64).max)[near] <= self.high]] = True
        return out

    def served(self, wanted: np.ndarray) -> np.ndarray:
        """The intervals of starts that the wanted ones of the different contexts serve."""
        rows = wanted[self.found.place]
        return ranges(self.low[rows], self.high[rows] + 1)


def concerned(own: Named, starts: np.ndarray, known: np.ndarray) -> Named:
    """The anchors that are near one of the sorted ``starts`` and that an earlier document has, or that a later one has.

    Of the latter not those whose starts are all ``known``: an earlier document answers in their place.
    """
    near = np.append(starts, np.iinfo(np.int64).max)[np.searchsorted(starts, own.at - PERIOD + 1)] <= own.at
    whole = known - np.array([0, PERIOD - 1])
    sure = inside(own.at - PERIOD + 1, whole[whole[:, 0] < whole[:, 1]])
    return own.of((own.later & ~sure) | (own.earlier & near))


def send_claims(block: Block, plan: Plan, own: Named, starts: np.ndarray, known: np.ndarray) -> list[tuple[int, bytes]]:
    """Every different context of the block, and whether the block asks for it."""
    near = Contexts.of(block, concerned(own, starts, known), plan)
    wants = near.asked(starts)
    return by_bucket(near.bucket, lambda s: pack([steps(near.rest[s]) << np.uint64(1) | wants[s]]))


def meet_claims(payloads: list[bytes]) -> list[bytes]:
    """Two bits of each context: an earlier block has it, a later block asks for it."""
    parts = [unpack(p, 1)[0] for p in payloads]
    rest = np.concatenate([np.cumsum(p >> np.uint64(1)) for p in parts])
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    wants = (np.concatenate(parts) & np.uint64(1)).astype(bool)
    order = np.argsort(rest, kind="stable")  # equal ones by block
    new = changes([rest[order]])
    last = np.maximum.reduceat(np.where(wants, owner, -1)[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    earlier, later = np.empty(len(rest), bool), np.empty(len(rest), bool)
    earlier[order], later[order] = ~new, last > owner[order]
    return [x + y for x, y in zip(split_bits(earlier, parts), split_bits(later, parts))]


def remaining(block: Block, plan: Plan, own: Named, starts: np.ndarray, known: np.ndarray, found: Found) -> np.ndarray:
    """The starts to sort: claims whose context stands in an earlier document, and what others ask for.

    ``known``: starts that an earlier document has too, which answers in their place.
    """
    own = concerned(own, starts, known)
    if not len(own.at):
        return starts
    near = Contexts.of(block, own, plan)
    halves = [(x["reply"][: len(x["reply"]) // 2], x["reply"][len(x["reply"]) // 2 :]) for x in found or []]
    earlier, later = (flags([{"reply": x[k]} for x in halves], runs_of(near.bucket)) for k in (0, 1))
    wants = near.asked(starts)
    mine = near.served(wants & (earlier | near.found.many))
    others = members(near.served(later | (wants & near.found.many)))
    return np.union1d(starts[inside(starts, mine)], others[~inside(others, known)])


def string_groups(block: Block, plan: Plan, at: np.ndarray) -> tuple[Distinct, list[np.ndarray], np.ndarray]:
    strings = block.strings(at)
    found = Distinct.of(strings, whole=False)
    bucket = plan.bucket_of([s[found.item] for s in strings])
    # Sorted by the first eight bytes only, strings of several buckets may be mixed where they share those.
    order = np.argsort(bucket, kind="stable")
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    found = Distinct(back[found.place], found.item[order], found.many[order])
    return found, [s[found.item] for s in strings], bucket[order]


def send_strings(block: Block, plan: Plan, at: np.ndarray) -> list[tuple[int, bytes]]:
    _, own, bucket = string_groups(block, plan, at)
    return by_bucket(bucket, lambda s: pack([steps(own[0][s]), *(c[s] for c in own[1:])]))


def covered_starts(block: Block, plan: Plan, at: np.ndarray, found: Found) -> np.ndarray:
    if not len(at):
        return at
    different, _, bucket = string_groups(block, plan, at)
    return at[earlier_of(block, at, different, flags(found, runs_of(bucket)))]


# Spark


_BLOCKS = "block long, n long, ids binary, lengths binary, data binary, carried binary, probes binary"
_SENT = "block long, bucket long, payload binary"
_TEXT = ["ids", "lengths", "data"]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(schema), schema.types)], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def _out_arrow(as_text: bool) -> pa.Schema:
    spans = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    return pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("kept", pa.string() if as_text else pa.binary()), ("spans", spans), ("carried", pa.string())])


_OUT = "doc_id long, n_bytes long, kept binary, spans array<struct<start:long,stop:long>>, carried string"


def grown(total: int) -> float:
    """How much larger blocks and buckets of a corpus are than those of a small one.

    A block sends a message to each bucket, so messages are as many as the product of both numbers. From ``STEADY_BYTES`` on both sizes grow with
    the root of the text: a message then holds as much as before, and messages grow with the text, not with its square.
    """
    return max(1.0, (total / STEADY_BYTES) ** 0.5)


def make_blocks(docs: DataFrame, total: int) -> DataFrame:
    """``docs(doc_id, text, carried)``, ``total`` bytes of text, as blocks, numbered in order of the ids."""
    most = int(BLOCK_BYTES * grown(total))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        ids: list[int] = []
        texts: list[bytes] = []
        extra: list[str | None] = []
        size = 0
        press = zstandard.ZstdCompressor(level=1)

        def flush() -> pa.RecordBatch:
            lengths = np.fromiter(map(len, texts), np.int64, len(texts))
            block = Block(np.array(ids, np.int64), lengths, b"".join(texts))
            at = block.samples()
            probes = np.array(block.strings(at[:: max(1, len(at) // PROBES)][:PROBES]), np.uint64).T
            row = (number, block.n, block.ids.tobytes(), lengths.tobytes(), press.compress(block.data), press.compress(json.dumps(extra).encode()), probes.tobytes())
            return _batch([row], _arrow(_BLOCKS))

        for batch in batches:
            for i, text, more in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= most and i != ids[-1]:
                    yield flush()
                    number, ids, texts, extra, size = number + 1, [], [], [], 0
                ids.append(i)
                texts.append((text or "").encode("utf-8", "surrogatepass"))
                extra.append(more)
                size += len(texts[-1])
        if ids:
            yield flush()

    return docs.select("doc_id", "text", "carried").mapInArrow(tidied(run), _BLOCKS)


def make_plan(blocks: DataFrame) -> Plan:
    """Numbers of buckets and bits from the size of the text; cuts from a bounded sample, which only balances the buckets."""
    made, total = blocks.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    buckets = max(-(-partitions(blocks.sparkSession) // 2), int(total / (BUCKET_BYTES * grown(total))) + 1)
    every = max(1, -(-made * PROBES // MAX_PROBES))
    probes = [np.frombuffer(r["probes"], np.uint64).reshape(-1, 7) for r in blocks.where(F.pmod(F.xxhash64("block"), F.lit(every)) == 0).select("probes").collect()]
    flat = np.concatenate([np.zeros((0, 7), np.uint64), *probes])
    flat = flat[np.lexsort(flat.T[::-1])]
    flat = flat[np.linspace(0, len(flat), buckets, endpoint=False).astype(np.int64)[1:]] if len(flat) else flat
    cuts = [np.ascontiguousarray(c) for c in flat.T]
    return Plan(buckets, min(64, max(int(total).bit_length(), 24) + SPARE_BITS), cuts)


class Blocks:
    """Tables with rows of blocks, bucketed by the block, so that they join without a shuffle."""

    def __init__(self, scratch: Scratch):
        self.spark, self.scratch, self.parts = scratch.spark, scratch, partitions(scratch.spark)

    def write(self, rows: DataFrame, name: str) -> DataFrame:
        table = f"fotolith_{uuid.uuid4().hex}"
        rows.write.option("path", f"{self.scratch.root}/{name}").option("compression", "uncompressed").bucketBy(self.parts, "block").format("parquet").saveAsTable(table)
        made = self.spark.table(table)
        self.spark.sql(f"DROP TABLE {table}")  # the frame is resolved; the files are the scratch folder's
        return made

    def exchange(self, sent: DataFrame, meet: Callable[[list[bytes]], list[bytes]], name: str) -> DataFrame:
        """``block`` and, as ``name``, the answers to its messages, by bucket.

        ``meet`` gets a bucket's messages in order of the blocks; there is at most one of a block.
        """
        kind = "block long, bucket long, reply binary"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def close(bucket: int, held: list[tuple[int, bytes]]) -> pa.RecordBatch:
                replies = meet([p for _, p in held])
                return _batch([(b, bucket, r) for (b, _), r in zip(held, replies)], _arrow(kind))

            last, held = None, []
            for batch in batches:
                for block, bucket, payload in zip(*(c.to_pylist() for c in batch.columns)):
                    if bucket != last and held:
                        yield close(last, held)
                        held = []
                    last = bucket
                    held.append((block, payload))
            if held:
                yield close(last, held)

        # By number, so that no two buckets meet in a task before every task has one.
        dealt = sent.repartitionById(self.parts, F.col("bucket").cast("int")).sortWithinPartitions("bucket", "block")
        answers = dealt.mapInArrow(tidied(run), kind).groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "reply"))).alias(name))
        made = self.write(answers, name)
        release(self.spark)
        return made


def dedup(docs: DataFrame, scratch: Scratch, carry: list[str] | None = None, as_text: bool = False) -> DataFrame:
    """``doc_id, n_bytes, kept, spans`` and the columns of ``carry`` for every document of ``docs(doc_id, text)``.

    ``kept``: the remaining bytes; ``spans``: the removed byte ranges, in order.
    With ``as_text`` the kept bytes are a string, without the halves of
    characters that a range cuts in two.
    """
    spark = prepare(docs.sparkSession)
    carry = carry or []
    if taken := {"doc_id", "n_bytes", "kept", "spans"} & {c.lower() for c in carry}:
        raise ValueError(f"dedup: carried columns have names of results: {sorted(taken)}")
    shape = T.StructType([T.StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(carry)])
    packed = F.to_json(F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry))), JSON_OPTIONS) if carry else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), packed.alias("carried"))

    tables = Blocks(scratch)
    ordered = rows.where("doc_id is not null").repartitionByRange(tables.parts, "doc_id").sortWithinPartitions("doc_id")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = tables.write(make_blocks(ordered, total), "blocks")
    release(spark)
    shared = spark.sparkContext.broadcast(make_plan(blocks))

    def over(known: list[DataFrame], columns: list[str], work: Callable[..., list[tuple]], kind: str) -> DataFrame:
        """``work(block, plan, *columns)`` of every block gives rows of ``kind`` without their first column, the block's number."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for number, ids, lengths, data, *more in zip(*(c.to_pylist() for c in batch.columns)):
                    made = work(Block.read(ids, lengths, data), shared.value, *more)
                    yield _batch([(number, *row) for row in made], _arrow(kind))

        frame = blocks
        for table in known:
            frame = frame.join(table, "block", "left")
        return frame.select("block", *_TEXT, *columns).mapInArrow(tidied(run), kind)

    positions = lambda blob: np.cumsum(unpack(blob, 1)[0]).astype(np.int64)
    spans = lambda blob: np.frombuffer(blob, np.int64).reshape(-1, 2)

    # 1. Sampled triples: discard those that occur once, sort and name the others.
    again = tables.exchange(over([], [], send_fingerprints, _SENT), meet_fingerprints, "again")
    kept = tables.write(over([again], ["again"], lambda block, plan, found: [(pack([steps(repeated(block, plan, found))]),)], "block long, kept binary"), "kept")
    ranks = tables.exchange(over([kept], ["kept"], lambda block, plan, at: send_triples(block, plan, positions(at)), _SENT), meet_triples, "ranks")

    # 2. Names: sort the strings of sampled positions as name, gap and name.
    known = tables.write(over([kept, ranks], ["kept", "ranks"], lambda block, plan, at, found: [(named(block, plan, positions(at), found).state(),)], "block long, named binary"), "named")
    equal = tables.exchange(over([known], ["named"], lambda block, plan, own: send_tuples(block, Named.load(own)), _SENT), meet_tuples, "equal")

    def name_strings(block: Block, plan: Plan, own: bytes, found: Found) -> list[tuple]:
        gone, made = strings(block, Named.load(own), found)
        return [(gone.tobytes(), made.state())]

    covered = tables.write(over([known, equal], ["named", "equal"], name_strings, "block long, covered binary, strings binary"), "covered")

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, own in zip(*(c.to_pylist() for c in batch.columns)):
                yield _batch([(number, *row) for row in send_pairs(Named.load(own))], _arrow(_SENT))

    twice = tables.exchange(covered.select("block", "strings").mapInArrow(tidied(pair), _SENT), meet_rows(2), "twice")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, ids, lengths, own, found in zip(*(c.to_pylist() for c in batch.columns)):
                block = Block(np.frombuffer(ids, np.int64), np.frombuffer(lengths, np.int64), b"")
                yield _batch([(number, known_starts(block, Named.load(own), found).tobytes())], _arrow("block long, known binary"))

    frame = blocks.select("block", "ids", "lengths").join(covered.select("block", "strings"), "block").join(twice, "block", "left")
    sure = tables.write(frame.mapInArrow(tidied(settle), "block long, known binary"), "known")
    covered = covered.drop("strings")

    # 3. Remaining suffixes: ask for the contexts of their anchors, then sort them.
    def ask(block: Block, plan: Plan, own: bytes, gone: bytes, same: bytes) -> list[tuple]:
        own = Named.load(own)
        return send_claims(block, plan, own, claims(block, own, spans(gone)), spans(same))

    wanted = tables.exchange(over([known, covered, sure], ["named", "covered", "known"], ask, _SENT), meet_claims, "wanted")

    def choose(block: Block, plan: Plan, own: bytes, gone: bytes, same: bytes, found: Found) -> list[tuple]:
        own = Named.load(own)
        return [(pack([steps(remaining(block, plan, own, claims(block, own, spans(gone)), spans(same), found))]),)]

    rest = tables.write(over([known, covered, sure, wanted], ["named", "covered", "known", "wanted"], choose, "block long, rest binary"), "rest")
    last = tables.exchange(over([rest], ["rest"], lambda block, plan, at: send_strings(block, plan, positions(at)), _SENT), meet_rows(7), "last")

    # 4. What stands behind an equal string of an earlier document goes.
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, lengths, data, carried, runs, at, found in zip(*(c.to_pylist() for c in batch.columns)):
                block, runs = Block.read(ids, lengths, data), spans(runs)
                gone = covered_starts(block, shared.value, positions(at), found)
                both = ranges(np.concatenate([runs[:, 0], gone]), np.concatenate([runs[:, 1], gone + WIDTH]))
                yield from remove(block, both, json.loads(zstandard.ZstdDecompressor().decompress(carried)), as_text)

    out = blocks.join(covered, "block").join(rest, "block").join(last, "block", "left").select(*_TEXT, "carried", "covered", "rest", "last")
    done = out.mapInArrow(tidied(cut), _OUT.replace("kept binary", "kept string") if as_text else _OUT)
    alone = rows.where("doc_id is null").select("doc_id", F.coalesce("text", F.lit("")).cast("string" if as_text else "binary").alias("kept"), "carried")
    alone = alone.select("doc_id", F.octet_length("kept").cast("long").alias("n_bytes"), "kept", F.expr("cast(array() as array<struct<start:long,stop:long>>)").alias("spans"), "carried")
    out = done.unionByName(alone)
    if not carry:
        return out.drop("carried")
    return out.withColumn("carried", F.from_json("carried", shape, JSON_OPTIONS)).select("doc_id", "n_bytes", "kept", "spans", *(F.col(f"carried.c{i}").alias(c) for i, c in enumerate(carry)))


def remove(block: Block, gone: np.ndarray, extra: list, as_text: bool) -> Iterator[pa.RecordBatch]:
    """The documents of a block without the byte ranges ``gone``, some at a time."""
    # A covered string lies in one document, but ranges of neighbours may touch: cut them at document ends.
    starts = block.ends - block.lengths
    rows: list[tuple] = []
    size = 0
    for i, (a, b) in enumerate(zip(starts.tolist(), block.ends.tolist())):
        lo, hi = np.searchsorted(gone[:, 1], a, side="right"), np.searchsorted(gone[:, 0], b, side="left")
        spans = [(max(x, a), min(y, b)) for x, y in gone[lo:hi].tolist() if max(x, a) < min(y, b)]
        kept, at = [], a
        for x, y in spans:
            kept.append(block.data[at:x])
            at = y
        kept.append(block.data[at:b])
        whole = b"".join(kept)
        rows.append((int(block.ids[i]), b - a, whole.decode("utf-8", "ignore") if as_text else whole, [{"start": x - a, "stop": y - a} for x, y in spans], extra[i]))
        size += b - a
        if size >= BLOCK_BYTES:
            yield _batch(rows, _out_arrow(as_text))
            rows, size = [], 0
    if rows:
        yield _batch(rows, _out_arrow(as_text))
