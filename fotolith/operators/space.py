"""Balanced blocks of points, and the pairs of blocks that can matter.

A tree of median cuts over a bounded sample, in all dimensions, gives cells of about equal numbers; a cell that
still holds more rows than a block (many equal rows, a sample's error) is dealt to several
blocks by id. A block is one row of binary arrays with its bounding box. Two blocks are a pair if their boxes are near enough; the tree names the
cells around a box, so pairs are found by an equi-join on the cell and never by comparing all blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fotolith.session import stored

#: Rows of a sample from which the tree is made, at least and at most (of a cell, where there are many), and cells that it may have.
SAMPLE, MAX_SAMPLE, OF_A_CELL, MAX_CELLS = 1 << 15, 1 << 18, 8, 1 << 15
#: Pairs of blocks that a task compares, tasks at most, and blocks that are sent to all executors.
PAIRS_A_TASK, MAX_TASKS, FEW = 16, 4096, 512
#: A bound is taken a little further, for what doubles round off.
ROUNDING = 1 + 1e-9


@dataclass
class Tree:
    """Cuts in an array: node k has the children 2k + 1 and 2k + 2; leaves are cells."""

    dims: np.ndarray
    cuts: np.ndarray
    depth: int

    @classmethod
    def build(cls, points: np.ndarray, cells: int) -> Tree:
        depth = max(0, int(np.ceil(np.log2(max(1, min(cells, MAX_CELLS))))))
        dims, cuts = np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, np.inf)
        parts = [points]
        for level in range(depth):
            below = []
            for k, own in enumerate(parts):
                node = (1 << level) - 1 + k
                if len(own) > 1:
                    spread = own.max(axis=0) - own.min(axis=0)
                    dims[node] = d = int(spread.argmax())
                    cut = np.median(own[:, d])
                    # The greatest value is no cut: nothing would lie beyond it.
                    cuts[node] = np.inf if spread[d] == 0 else cut if cut < own[:, d].max() else own[own[:, d] < cut, d].max()
                left = own[:, dims[node]] <= cuts[node] if len(own) else np.zeros(0, bool)
                below += [own[left], own[~left]]
            parts = below
        return cls(dims, cuts, depth)

    def cells(self, points: np.ndarray) -> np.ndarray:
        """The cell of each point."""
        at = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            at = 2 * at + 1 + (points[np.arange(len(points)), self.dims[at]] > self.cuts[at])
        return at - ((1 << self.depth) - 1)

    def around(self, low: np.ndarray, high: np.ndarray, reach: float) -> list[int]:
        """Cells with a point at most ``reach`` away from a box in each dimension."""
        todo, found = [0], []
        first = (1 << self.depth) - 1
        while todo:
            at = todo.pop()
            if at >= first:
                found.append(at - first)
                continue
            d, cut = self.dims[at], self.cuts[at]
            if low[d] - reach * ROUNDING <= cut:
                todo.append(2 * at + 1)
            if high[d] + reach * ROUNDING > cut:
                todo.append(2 * at + 2)
        return found


def plant(points: DataFrame, size: int) -> Tree:
    """A tree for ``points(id, v)`` with cells of about ``size`` rows; at most ``MAX_SAMPLE`` rows reach the driver."""
    n = points.count()
    cells = -(-n // size)
    most = min(max(SAMPLE, OF_A_CELL * cells), MAX_SAMPLE)
    share = -(-n // most)
    some = points.where(F.pmod(F.xxhash64("id"), F.lit(share)) == 0) if share > 1 else points
    rows = some.select("v").limit(most).toArrow().column("v").combine_chunks()
    dims = len(rows[0]) if len(rows) else 1
    return Tree.build(np.asarray(rows.flatten(), float).reshape(-1, dims), cells)


def blocks(rows: DataFrame, tree: Tree, size: int, extra: dict[str, str]) -> DataFrame:
    """``block, cell, n, ids, v, low, high`` and the columns of ``extra`` (name: numpy type), each an array of the block's rows in bytes; stored.

    ``rows`` holds ``id``, ``v`` and ``extra``, which are numbers or lists of equal length.
    """
    columns = ["id", "v", *extra]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = np.asarray(batch.column("v").flatten(), float).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tree.cells(v))], names=[*batch.schema.names, "cell"])

    celled = stored(rows.select(*columns).mapInArrow(place, rows.select(*columns).schema.add("cell", "long")), "cells")
    sizes = celled.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / size).alias("parts"))  # one row a cell of the tree
    dealt = celled.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))

    def gather(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        v = np.asarray(table.column("v").combine_chunks().flatten(), float).reshape(table.num_rows, -1)
        made = {
            "block": [table.column("part")[0].as_py() << 32 | table.column("cell")[0].as_py()], "cell": [table.column("cell")[0].as_py()], "n": [table.num_rows],
            "ids": [table.column("id").to_numpy().astype(np.int64).tobytes()], "v": [v.tobytes()], "low": [v.min(axis=0).tolist()], "high": [v.max(axis=0).tolist()],
        }
        flat = lambda c: c.combine_chunks().flatten() if pa.types.is_list(c.type) else c
        made |= {c: [flat(table.column(c)).to_numpy().astype(kind).tobytes()] for c, kind in extra.items()}
        return pa.table(made)

    shape = "block long, cell long, n long, ids binary, v binary, low array<double>, high array<double>" + "".join(f", {c} binary" for c in extra)
    return stored(dealt.groupBy("cell", "part").applyInArrow(gather, shape), "blocks")


def apart(low: str, high: str, other_low: str, other_high: str) -> Column:
    """Squared distance of two boxes."""
    gap = F.zip_with(F.zip_with(low, other_high, lambda a, b: a - b), F.zip_with(other_low, high, lambda a, b: a - b), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    return F.aggregate(gap, F.lit(0.0), lambda s, x: s + x * x)


def gap_of(near: str, far: str, other_near: str, other_far: str) -> Column:
    """What rows of two blocks are apart at least, by their distances to common pivots."""
    gap = F.zip_with(F.zip_with(near, other_far, lambda a, b: a - b), F.zip_with(other_near, far, lambda a, b: a - b), lambda x, y: F.greatest(x, y))
    return F.aggregate(gap, F.lit(0.0), lambda s, x: F.greatest(s, x))


def pairs(made: DataFrame, tree: Tree, reach: float | str, pivots: bool = False) -> DataFrame:
    """``a, b`` (a at most b): blocks whose boxes are at most ``reach`` apart, or a block's own column of that name; stored.

    With ``pivots`` the blocks' columns ``near`` and ``far`` (least and greatest distance to each pivot) rule out further pairs.
    """
    own = isinstance(reach, str)
    none = F.array().cast("array<double>")
    boxes = made.select("block", "cell", "low", "high", (F.col(reach) if own else F.lit(float(reach))).alias("reach"), *((F.col(c) if pivots else none).alias(c) for c in ("near", "far")))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            cells = [tree.around(np.array(r["low"]), np.array(r["high"]), r["reach"]) for r in rows]
            at = np.repeat(np.arange(len(rows)), [len(c) for c in cells])
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows]).take(pa.array(at)) for c in ("block", "low", "high", "reach", "near", "far")] + [pa.array([x for c in cells for x in c], pa.int64())], names=["a", "alow", "ahigh", "areach", "anear", "afar", "cell"])

    near = boxes.mapInArrow(name, "a long, alow array<double>, ahigh array<double>, areach double, anear array<double>, afar array<double>, cell long")
    met = near.join(boxes.select(F.col("block").alias("b"), "cell", "low", "high", "near", "far"), "cell")
    # Either side may reach the other; each pair counts once.
    met = met.where(apart("alow", "ahigh", "low", "high") <= F.col("areach") * F.col("areach") * F.lit(ROUNDING))
    met = met.where(gap_of("anear", "afar", "near", "far") <= F.col("areach") * F.lit(ROUNDING))
    return stored(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")


def over_pairs(found: DataFrame, made: DataFrame, columns: list[str], run, shape: str) -> DataFrame:
    """``run(row)`` of each pair, a dict with ``columns`` of block a (as they are) and b (with ``other_`` before them); it yields record batches.

    A pair is a few bytes and much work, so pairs are dealt to tasks by their number, not by the size of their file.
    """
    tasks = max(1, min(MAX_TASKS, -(-found.count() // PAIRS_A_TASK)))
    few = made.count() <= FEW
    one = made.select(F.col("block").alias("a"), *columns)
    two = made.select(F.col("block").alias("b"), *(F.col(c).alias(f"other_{c}") for c in columns))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from run(row)

    if few:
        return found.repartition(tasks).join(F.broadcast(one), "a").join(F.broadcast(two), "b").mapInArrow(each, shape)
    return found.join(one, "a").join(two, "b").repartition(tasks).mapInArrow(each, shape)
