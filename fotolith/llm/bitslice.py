"""Exact top-k inner products over a bit-sliced index.

Every vector becomes integers ``floor(256 * x)``. A block of rows keeps, for each
attribute, the bit planes (one bit a row) of the attribute's high part, its low
bits cut so that at most ``PLANES`` remain, next to the exact integers.

A query adds the attributes' planes, weighted by its own integers, with bitmap
arithmetic: each set bit of a coefficient puts the attribute's planes (inverted
for a negative one) into the columns of their weights, and full adders reduce
three planes of a column to a sum and a carry until each row's total is one
binary number across planes. Rows are then selected from the most significant
plane downward. The low bits that were cut change a score by at most a proven
bound, so every row within twice that bound of the k-th total is a boundary row;
those are resolved by the exact integers, ties to the smaller id.

Blocks of rows stay where they were read; blocks of queries are sent to every
block of rows (queries are a stated set), and the k best of each block meet in a
ranking that keeps k rows on the map side first.

Defined results: vectors that are null or hold a null or non-finite component
take no part, as query or row; so do rows without id. Shorter vectors count as
padded with zeros to their block's longest. Rows that share the query's id are
its own. Repeated rows are candidates of their own. Fewer than k candidates are
all returned; an empty table gives no rows; extra columns are not read. A vector whose
integers are longer than 2^31.5, so that scores might leave 64 bits, is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fotolith.llm.common import Scratch, prepare

SCALE = 256
#: Bit planes of an attribute's high part.
PLANES = 6
#: Rows of an index block, queries of a query block.
BLOCK_ROWS, BLOCK_QUERIES = 16384, 512

#: Groups that one row is spread to in one step.
SPREAD = 1024

BLOCK = "block long, n long, dims long, ids binary, vectors binary"


def to_block(ids: list[int], vectors: list[np.ndarray]) -> tuple[int, int, bytes, bytes]:
    dims = max(map(len, vectors), default=0)
    out = np.zeros((len(ids), dims), np.int64)
    for row, v in zip(out, vectors):
        row[: len(v)] = v
    return len(ids), dims, np.array(ids, np.int64).tobytes(), out.tobytes()


def blocks_of(rows: DataFrame, size: int, id_col: str, vec_col: str) -> DataFrame:
    """Blocks of at most ``size`` usable rows of each partition, as ``BLOCK``."""
    prepare(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        ids: list[int] = []
        vectors: list[np.ndarray] = []
        made = 0

        def flush() -> pa.RecordBatch:
            nonlocal made
            row = (part << 32 | made, *to_block(ids, vectors))
            made += 1
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=["block", "n", "dims", "ids", "vectors"])

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                if i is None or not v.is_valid or v.values.null_count:
                    continue
                x = np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64)
                if not np.isfinite(x).all():
                    continue
                whole = np.floor(SCALE * x)
                if float(whole @ whole) >= 2.0**63 * (1 - 1e-9):
                    raise ValueError(f"bitslice: the vector of id {i} is too long for 64-bit scores")
                ids.append(i)
                vectors.append(whole.astype(np.int64))
                if len(ids) == size:
                    yield flush()
                    ids, vectors = [], []
        if ids:
            yield flush()

    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).mapInArrow(run, BLOCK)


class Index:
    """The bit-sliced index of one block of rows."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        n, dims = rows.shape
        self.base = rows.min() if rows.size else 0
        high = int(rows.max() - self.base) if rows.size else 0
        self.cut = max(0, high.bit_length() - PLANES)
        coarse = (rows - self.base) >> self.cut
        self.bits = max(1, (high >> self.cut).bit_length())
        self.words = (n + 63) // 64
        low = (rows - self.base) - (coarse << self.cut) - ((1 << self.cut) - 1) / 2
        #: The greatest length of what the planes leave out, over the rows.
        self.rest = float(np.sqrt((low * low).sum(axis=1).max())) if rows.size else 0.0
        planes = np.zeros((dims, self.bits, self.words * 64), bool)
        for b in range(self.bits):
            planes[:, b, :n] = (coarse.T >> b) & 1
        self.valid = self.pack(np.arange(self.words * 64) < n)
        plain = np.packbits(planes.reshape(-1, self.words * 64), axis=1, bitorder="little").view(np.uint64)
        plain = plain.reshape(dims, self.bits, self.words)
        self.planes = np.stack([plain, ~plain & self.valid])

    def pack(self, flags: np.ndarray) -> np.ndarray:
        return np.packbits(flags, bitorder="little").view(np.uint64)

    def totals(self, query: np.ndarray) -> list[np.ndarray]:
        """Planes of each row's weighted sum, the least significant first."""
        size = np.abs(query)
        columns: list[np.ndarray] = []
        at = np.flatnonzero(size)
        most = int(size.max()).bit_length() if len(at) else 0
        for k in range(most + self.bits - 1):
            picked = [self.planes[(query[d] < 0).astype(int), d, b] for b in range(self.bits) if 0 <= k - b < most and len(d := at[size[at] >> (k - b) & 1 == 1])]
            columns.append(np.concatenate(picked) if picked else np.zeros((0, self.words), np.uint64))
        out, k = [], 0
        while k < len(columns):
            here = columns[k]
            while len(here) > 1:
                if len(here) == 2:
                    total, carry = (here[0] ^ here[1])[None], (here[0] & here[1])[None]
                    left = here[:0]
                else:
                    m = len(here) // 3
                    a, b, c = here[:m], here[m : 2 * m], here[2 * m : 3 * m]
                    ab = a ^ b
                    total, carry, left = ab ^ c, (a & b) | (c & ab), here[3 * m :]
                if k + 1 == len(columns):
                    columns.append(np.zeros((0, self.words), np.uint64))
                columns[k + 1] = np.concatenate([columns[k + 1], carry])
                here = np.concatenate([total, left])
            out.append(here[0] if len(here) else np.zeros(self.words, np.uint64))
            k += 1
        return out

    def select(self, planes: list[np.ndarray], among: np.ndarray, k: int) -> int:
        """The k-th greatest total of the rows in ``among`` (or the least, if fewer)."""
        count = lambda x: int(np.bitwise_count(x).sum())
        k = min(k, count(among))
        level = 0
        for b in range(len(planes) - 1, -1, -1):
            ones = among & planes[b]
            if (c := count(ones)) >= k:
                among, level = ones, level | 1 << b
            else:
                among, k = among & ~planes[b], k - c
        return level

    def at_least(self, planes: list[np.ndarray], among: np.ndarray, level: int) -> np.ndarray:
        """Rows in ``among`` whose total is ``level`` or more."""
        if level <= 0:
            return among
        if level >> len(planes):
            return np.zeros_like(among)
        above = np.zeros_like(among)
        for b in range(len(planes) - 1, -1, -1):
            if level >> b & 1:
                among = among & planes[b]
            else:
                above |= among & planes[b]
                among = among & ~planes[b]
        return above | among

    def top(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of the k best rows whose id is not ``own``."""
        dims = self.rows.shape[1]
        query = query[:dims] if len(query) >= dims else np.concatenate([query, np.zeros(dims - len(query), np.int64)])
        among = self.valid
        mine = self.ids == own
        if mine.any():
            among = among & ~self.pack(np.concatenate([mine, np.zeros(self.words * 64 - len(mine), bool)]))
        planes = self.totals(query)
        if self.cut:
            bound = float(np.sqrt((query.astype(np.float64) ** 2).sum())) * self.rest
            slack = int(np.ceil(2 * bound / (1 << self.cut))) + 2
        else:
            slack = 0
        picked = self.at_least(planes, among, self.select(planes, among, k) - slack)
        rows = np.flatnonzero(np.unpackbits(picked.view(np.uint8), bitorder="little"))
        exact = self.rows[rows] @ query
        if len(rows) > k:
            floor = np.partition(exact, len(exact) - k)[len(exact) - k]
            stay = exact >= floor
            rows, exact = rows[stay], exact[stay]
        best = np.lexsort((self.ids[rows], -exact))[:k]
        return self.ids[rows[best]], exact[best]


def top_k(rows: DataFrame, queries: DataFrame, k: int, scratch: Scratch, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best rows of each query.

    ``rows`` and ``queries`` hold ``id_col`` (integer) and ``vec_col`` (array of
    floats); a query with no other row gives none.
    """
    index = scratch.write(blocks_of(rows, BLOCK_ROWS, id_col, vec_col), "index")
    asked = scratch.write(blocks_of(queries, BLOCK_QUERIES, id_col, vec_col), "queries")
    asked = asked.select(F.col("n").alias("qn"), F.col("dims").alias("qdims"), F.col("ids").alias("qids"), F.col("vectors").alias("qvectors"))
    # Each block of queries goes to every group of index blocks (about one block each), in two steps of bounded arrays.
    groups = max(1, index.count())
    high = F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"), F.lit(SPREAD).cast("long"))
    group = F.sequence("high", F.least(F.col("high") + SPREAD - 1, F.lit(groups - 1)))
    sent = asked.withColumn("high", F.explode(high)).withColumn("group", F.explode(group)).drop("high")
    grouped = index.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups)))
    met = sent.join(grouped.hint("merge"), "group").select("n", "dims", "ids", "vectors", *asked.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, built = None, None
        for batch in batches:
            for n, dims, ids, vectors, qn, qdims, qids, qvectors in zip(*(c.to_pylist() for c in batch.columns)):
                if last != (ids, len(vectors)):
                    last = (ids, len(vectors))
                    built = Index(np.frombuffer(ids, np.int64), np.frombuffer(vectors, np.int64).reshape(n, dims))
                out: list[tuple[int, np.ndarray, np.ndarray]] = []
                for own, q in zip(np.frombuffer(qids, np.int64).tolist(), np.frombuffer(qvectors, np.int64).reshape(qn, qdims)):
                    out.append((own, *built.top(own, q, k)))
                own = np.repeat([x[0] for x in out], [len(x[1]) for x in out]).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own), pa.array(np.concatenate([x[1] for x in out])), pa.array(np.concatenate([x[2] for x in out]))], names=["query_id", "vec_id", "score"]
                )

    found = met.mapInArrow(run, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
