"""Hard negatives by inner product, behind an orthogonal rotation.

Every vector becomes integers ``floor(256 * x)``. The eigenvectors of the rows' second
moments, which are sums over all rows, give an orthogonal rotation that moves most of
an inner product into the leading components. A block of rows meets a block of anchors
in steps: the product of the leading components is known, and the rest is at most
the product of the lengths of what remains, plus a slack for rounding. Of each anchor a pair goes
as soon as its upper bound is under the k-th best lower bound, or its interval
is outside the wanted range; what survives all steps is verified by integer products,
ties to the smaller id.

Two passes: the k best rows of an anchor's label are its positives; then, for each
anchor and positive, the k best rows of other labels within a range of the
positive's score. Rows stay in their blocks, blocks of anchors (a stated set) go to
each of them, and the k best of each block meet in a ranking that keeps k rows on the map side first. No
step groups by label, so a label may hold any share of the rows.

Defined results: rows with a null id, label or vector, or a null or non-finite
component take no part. Shorter vectors count as padded with zeros. Rows that
share the anchor's id are its own; repeated rows are candidates of their own, and an anchor that
is repeated gives its rows as often. A vector whose integers are longer than
2^31.5, so that scores might leave 64 bits, is an error. Without positives or
negatives there are no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fotolith.llm.common import Scratch, prepare
from fotolith.session import positions

SCALE = 256
#: Rows of a block, anchors of a block, anchors that are compared at a time.
BLOCK_ROWS, BLOCK_ANCHORS, AT_ONCE = 8192, 256, 32
#: Leading components at the ends of the steps before integer products.
STEPS = (8, 16, 32)
#: Pairs are a list when fewer than one in so many is left.
FEW = 32
#: Pairs whose integer products are taken at a time.
VERIFY = 1 << 15
#: Blocks that one block is sent to in one step.
SPREAD = 1024
#: Rounding of rotated products, in units of the lengths' product, for each component (a generous multiple of the unit roundoff).
ROUNDING = 64 * 2.0**-53

BLOCK = "block long, n long, dims long, ids binary, labels binary, vectors binary"


def usable(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray]]:
    """``id, label, integers`` of the rows that take part; batches of ``id, label, v``."""
    for batch in batches:
        for i, label, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            if i is None or label is None or not v.is_valid or v.values.null_count:
                continue
            x = np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64)
            if not np.isfinite(x).all():
                continue
            whole = np.floor(SCALE * x)
            if float(whole @ whole) >= 2.0**63 * (1 - 1e-9):
                raise ValueError(f"negatives: the vector of id {i} is too long for 64-bit scores")
            yield i, label, whole.astype(np.int64)


def selected(rows: DataFrame, id_col: str, label_col: str, vec_col: str) -> DataFrame:
    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).alias("v"))


def rotation(rows: DataFrame) -> np.ndarray:
    """Eigenvectors of the second moments of all rows, those of most weight first: dims x dims numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], np.zeros((0, 0))

        def add() -> None:
            nonlocal total
            d = max(len(total), *map(len, held))
            x = np.zeros((len(held), d))
            for row, v in zip(x, held):
                row[: len(v)] = v
            own = x.T @ x
            own[: len(total), : len(total)] += total
            total = own
            held.clear()

        for _, _, v in usable(batches):
            held.append(v)
            if len(held) == BLOCK_ROWS:
                add()
        if held:
            add()
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel().astype(np.int64)), pa.array(j.ravel().astype(np.int64)), pa.array(total.ravel())], names=["i", "j", "x"])

    made = rows.mapInArrow(run, "i long, j long, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).collect()
    d = 1 + max((r["i"] for r in made), default=-1)
    moments = np.zeros((d, d))
    for r in made:
        moments[r["i"], r["j"]] = r["x"]
    scale = np.abs(moments).max(initial=0.0) or 1.0
    return np.linalg.eigh((moments + moments.T) / (2 * scale))[1][:, ::-1].copy() if d else np.zeros((0, 0))


def blocks_of(rows: DataFrame, size: int, dims: int) -> DataFrame:
    """Blocks of at most ``size`` usable rows of each partition, as ``BLOCK``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, held = TaskContext.get().partitionId(), 0, []

        def flush() -> pa.RecordBatch:
            nonlocal made
            x = np.zeros((len(held), dims), np.int64)
            for row, (_, _, v) in zip(x, held):
                row[: len(v)] = v
            row = (part << 32 | made, len(held), dims, *(np.array([h[k] for h in held], np.int64).tobytes() for k in (0, 1)), x.tobytes())
            made += 1
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=["block", "n", "dims", "ids", "labels", "vectors"])

        for own in usable(batches):
            held.append(own)
            if len(held) == size:
                yield flush()
        if held:
            yield flush()

    return rows.mapInArrow(run, BLOCK)


class Rows:
    """A block's rows, rotated; ``rest`` is the length of what follows each step's components."""

    def __init__(self, n: int, dims: int, ids: bytes, labels: bytes, vectors: bytes, turn: np.ndarray):
        self.ids, self.labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
        self.whole = np.frombuffer(vectors, np.int64).reshape(n, dims)
        self.turned = self.whole.astype(np.float64) @ turn
        self.length = np.sqrt((self.turned**2).sum(axis=1))
        self.steps = [s for s in STEPS if s < dims] + [dims]
        tail = np.cumsum((self.turned**2)[:, ::-1], axis=1)[:, ::-1]
        self.rest = {s: np.sqrt(tail[:, s]) if s < dims else np.zeros(n) for s in self.steps}

    def take(self, at: np.ndarray) -> Rows:
        part = object.__new__(Rows)
        part.ids, part.labels, part.whole, part.turned, part.length, part.steps = self.ids[at], self.labels[at], self.whole[at], self.turned[at], self.length[at], self.steps
        part.rest = {s: r[at] for s, r in self.rest.items()}
        return part


def kth_best(query: np.ndarray, value: np.ndarray, n: int, k: int) -> np.ndarray:
    """Of each query number the k-th greatest value, minus infinity where there are fewer."""
    order = np.lexsort((-value, query))
    q, v = query[order], value[order]
    start = np.searchsorted(q, np.arange(n))
    count = np.searchsorted(q, np.arange(n), side="right") - start
    out = np.full(n, -np.inf)
    enough = count >= k
    out[enough] = v[start[enough] + k - 1]
    return out


class Pairs:
    """Pairs of queries and rows that are still alive, with their partial products; dense while many are, a list when few are left."""

    def __init__(self, asked: Rows, rows: Rows, allowed: np.ndarray):
        self.asked, self.rows, self.slack = asked, rows, ROUNDING * (rows.whole.shape[1] + 16)
        self.alive, self.columns = allowed, np.arange(len(rows.ids))
        self.part: np.ndarray | None = np.zeros(allowed.shape)
        self.i = self.j = None

    def advance(self, start: int, stop: int) -> np.ndarray:
        """Add components ``start`` to ``stop``; the greatest possible remainder of each pair."""
        q, r = self.asked, self.rows
        if self.i is None:
            at = self.columns
            self.part = self.part + q.turned[:, start:stop] @ r.turned[at, start:stop].T
            return q.rest[stop][:, None] * r.rest[stop][None, at] + (self.slack * q.length)[:, None] * r.length[None, at] + 1e-6
        for a in range(0, len(self.i), VERIFY):
            x, y = self.i[a : a + VERIFY], self.j[a : a + VERIFY]
            self.part[a : a + VERIFY] += np.einsum("ij,ij->i", q.turned[x, start:stop], r.turned[y, start:stop])
        return q.rest[stop][self.i] * r.rest[stop][self.j] + self.slack * q.length[self.i] * r.length[self.j] + 1e-6

    def discard(self, rest: np.ndarray, k: int, low: np.ndarray, high: np.ndarray, cap: np.ndarray) -> None:
        """Keep what may still be among the k best from ``low`` to ``cap`` or above them, up to ``high``."""
        least, most = self.part - rest, self.part + rest
        if self.i is None:
            best = np.full(len(least), -np.inf)
            if least.shape[1] >= k:
                sure = self.alive & (least >= low[:, None]) & (most <= cap[:, None])
                best = np.partition(np.where(sure, least, -np.inf), least.shape[1] - k, axis=1)[:, least.shape[1] - k]
            self.alive = self.alive & (most >= np.maximum(best, low)[:, None]) & (least <= high[:, None])
            left = int(self.alive.sum())
            if left * FEW < self.alive.size:
                i, j = np.nonzero(self.alive)
                self.i, self.j, self.part = i, self.columns[j], self.part[i, j]
            elif not (used := self.alive.any(axis=0)).all():
                self.alive, self.part, self.columns = self.alive[:, used], self.part[:, used], self.columns[used]
            return
        i = self.i
        sure = (least >= low[i]) & (most <= cap[i])
        best = kth_best(i[sure], least[sure], len(self.asked.ids), k)
        stay = (most >= np.maximum(best, low)[i]) & (least <= high[i])
        self.i, self.j, self.part = i[stay], self.j[stay], self.part[stay]

    def verified(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query and row numbers and integer products of what is left."""
        if self.i is None:
            i, j = np.nonzero(self.alive)
            self.i, self.j = i, self.columns[j]
        exact = np.empty(len(self.i), np.int64)
        for a in range(0, len(exact), VERIFY):
            exact[a : a + VERIFY] = np.einsum("ij,ij->i", self.asked.whole[self.i[a : a + VERIFY]], self.rows.whole[self.j[a : a + VERIFY]])
        return self.i, self.j, exact


def search(asked: Rows, rows: Rows, k: int, allowed: np.ndarray, low: np.ndarray, high: np.ndarray, cap: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query and row numbers and scores that hold each query's k best allowed rows from ``low`` to ``high``.

    With ``cap`` they hold the k best up to every bound between ``cap`` and ``high``. ``allowed`` has a row a query; bounds may be infinite.
    """
    left, before = Pairs(asked, rows, allowed), 0
    for step in rows.steps:
        left.discard(left.advance(before, step), k, low, high, high if cap is None else cap)
        before = step
    return left.verified()


def best_of(i: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k best, by score and then id."""
    order = np.lexsort((ids, -score, i))
    place = np.arange(len(i)) - np.searchsorted(i[order], i[order])
    return order[place < k]


def meet(asked: DataFrame, index: DataFrame, groups: int) -> DataFrame:
    """Each block of anchors beside each block of rows, in two steps of bounded arrays."""
    high = F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"), F.lit(SPREAD).cast("long"))
    group = F.sequence("high", F.least(F.col("high") + SPREAD - 1, F.lit(groups - 1)))
    named = asked.select(*(F.col(c).alias(f"q_{c}") for c in asked.columns))
    sent = named.withColumn("high", F.explode(high)).withColumn("place", F.explode(group)).drop("high")
    return sent.join(index.hint("merge"), "place").drop("place", "block")


def over_blocks(met: DataFrame, turn: np.ndarray, find, schema: str) -> DataFrame:
    """``find(row, asked, rows)`` of every pair of blocks; it yields record batches."""
    names = met.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rows = None, None
        for batch in batches:
            for values in zip(*(c.to_pylist() for c in batch.columns)):
                row = dict(zip(names, values))
                if last != (row["ids"], row["vectors"]):
                    last = (row["ids"], row["vectors"])
                    rows = Rows(row["n"], row["dims"], row["ids"], row["labels"], row["vectors"], turn)
                yield from find(row, Rows(row["q_n"], row["q_dims"], row["q_ids"], row["q_labels"], row["q_vectors"], turn), rows)

    return met.mapInArrow(run, schema)


def open_bounds(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.full(n, -np.inf), np.full(n, np.inf)


def arrays(*columns: np.ndarray, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=names)


def ranked(found: DataFrame, key: list[str], k: int) -> DataFrame:
    best = Window.partitionBy(*key).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def mine(
    rows: DataFrame, anchors: Column, scratch: Scratch, positives: int = 5, negatives: int = 5, least: tuple[int, int] = (4, 5),
    id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding",
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``anchors`` says which rows ask. A negative's score is at most the positive's
    and at least ``least[0] / least[1]`` of it.
    """
    prepare(rows.sparkSession)
    turn = rotation(selected(rows, id_col, label_col, vec_col))
    dims = len(turn)
    index = scratch.write(blocks_of(selected(rows, id_col, label_col, vec_col), BLOCK_ROWS, dims), "index")
    asked = scratch.write(blocks_of(selected(rows.where(anchors), id_col, label_col, vec_col), BLOCK_ANCHORS, dims), "anchors")
    place = scratch.write(positions(index.select("block"), ["block"], "place"), "places")
    groups = max(1, place.count())
    index = index.join(F.broadcast(place) if groups <= 1 << 20 else place, "block")

    def same(row: dict, asked: Rows, rows: Rows) -> Iterator[pa.RecordBatch]:
        for label in np.unique(asked.labels).tolist():
            own = rows.take(np.flatnonzero(rows.labels == label))
            whose = np.flatnonzero(asked.labels == label)
            for a in range(0, len(whose), AT_ONCE):
                at = whose[a : a + AT_ONCE]
                q = asked.take(at)
                i, j, score = search(q, own, positives, q.ids[:, None] != own.ids[None, :], *open_bounds(len(at)))
                best = best_of(i, own.ids[j], score, positives)
                i, j, score = i[best], j[best], score[best]
                yield arrays(np.full(len(i), row["q_block"]), at[i], q.ids[i], own.ids[j], score, names=["block", "at", "anchor_id", "id", "score"])

    shape = "block long, at long, anchor_id long, id long, score long"
    best = ranked(over_blocks(meet(asked, index, groups), turn, same, shape), ["block", "at"], positives)
    best = scratch.write(best, "positives")
    wanted = best.groupBy("block").agg(F.collect_list(F.struct("at", "rank", "id", "score")).alias("wanted"))  # k an anchor of the block

    def other(row: dict, asked: Rows, rows: Rows) -> Iterator[pa.RecordBatch]:
        # An anchor's ranges overlap, so it is searched once for all of them; a range below zero is empty.
        tops: dict[int, set[int]] = {}
        for w in row["q_wanted"]:
            if w["score"] >= 0:
                tops.setdefault(w["at"], set()).add(w["score"])
        anchors_here = sorted(tops)
        bottom = lambda top: -(-least[0] * top // least[1])
        for a in range(0, len(anchors_here), AT_ONCE):
            at = np.array(anchors_here[a : a + AT_ONCE], np.int64)
            q = asked.take(at)
            cap, high = (np.array([f(tops[x]) for x in at.tolist()], np.int64) for f in (min, max))
            low = np.array([bottom(min(tops[x])) for x in at.tolist()], np.int64)
            i, j, score = search(q, rows, negatives, q.labels[:, None] != rows.labels[None, :], low, high, cap)
            starts = np.searchsorted(i, np.arange(len(at) + 1)).tolist()
            for n, x in enumerate(at.tolist()):
                own, ids = score[starts[n] : starts[n + 1]], rows.ids[j[starts[n] : starts[n + 1]]]
                for top in sorted(tops[x]):
                    some = np.flatnonzero((own >= bottom(top)) & (own <= top))
                    some = some[best_of(np.zeros(len(some), np.int64), ids[some], own[some], negatives)]
                    if len(some):
                        full = lambda v: np.full(len(some), v)  # noqa: B023, E731
                        yield arrays(full(row["q_block"]), full(x), full(top), ids[some], own[some], names=["block", "at", "top", "id", "score"])

    found = over_blocks(meet(asked.join(wanted, "block"), index, groups), turn, other, "block long, at long, top long, id long, score long")
    hard = ranked(found, ["block", "at", "top"], negatives)
    heads = best.select("block", "at", "anchor_id", F.col("rank").alias("positive_rank"), F.col("id").alias("positive_id"), F.col("score").alias("top"))
    return heads.join(hard, ["block", "at", "top"]).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), F.col("top").alias("positive_score"), F.col("score").alias("negative_score"), "positive_rank"
    )
