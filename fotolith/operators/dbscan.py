"""Batch DBSCAN over normalised features.

Rows lie in balanced blocks of space, and only blocks within ``eps`` of each other are
compared; the pairs of blocks are found once and used twice. A first pass counts
neighbours, a second links core rows (a forest of links for each pair of blocks) and
names the core components around each border row, which joins the least of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fotolith.operators import space
from fotolith.operators.stats import normalised
from fotolith.schema import DIMENSIONS, GroupConfig
from fotolith.session import positions, send_package, stored

#: Rows of a block; links that one task joins.
BLOCK, ONE_TASK = 1024, 1 << 18
MAX_ROUNDS = 100
#: Rows of a block that are compared with another at a time.
TILE = 16


def _matrix(row: dict) -> np.ndarray:
    """Which rows of two blocks are within reach of each other."""
    x, y = (np.frombuffer(row[c], float).reshape(row[n], -1) for c, n in (("v", "n"), ("other_v", "other_n")))
    out, columns = np.empty((len(x), len(y)), bool), [np.ascontiguousarray(y[:, d]) for d in range(y.shape[1])]
    for i in range(0, len(x), TILE):  # few rows at a time stay in a core's cache
        square = 0.0
        for d, column in enumerate(columns):
            apart = x[i : i + TILE, d, None] - column
            square = square + apart * apart
        out[i : i + TILE] = square <= row["reach"] ** 2
    return out


def _counts(eps: float):
    """Of each block of a pair, how many rows of the other each of its rows has around it."""

    def run(row: dict) -> Iterator[pa.RecordBatch]:
        within = _matrix(row | {"reach": eps})
        sides = [(row["a"], within.sum(axis=1))] + ([(row["b"], within.sum(axis=0))] if row["a"] != row["b"] else [])
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in sides], pa.int64()), pa.array([n.astype(np.int32).tobytes() for _, n in sides])], names=["block", "counts"])

    return run


def _core(least: int):
    """Core rows of a block, from its counts over all pairs."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for counts in batch.column("counts").to_pylist():
                own = np.frombuffer(counts, np.int32).astype(np.int64)
                total = own if total is None else total + own
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([(total >= least).tobytes()])], names=["block", "core"])

    return run


def _meetings(eps: float):
    """Links among core rows, and the core rows (one of each component of the pair) that a border row has around it."""

    def run(row: dict) -> Iterator[pa.RecordBatch]:
        within = _matrix(row | {"reach": eps})
        ids, others = (np.frombuffer(row[c], np.int64) for c in ("ids", "other_ids"))
        core, other_core = (np.frombuffer(row[c], bool) for c in ("core", "other_core"))
        links, left, right = forest(ids, others, within & core[:, None] & other_core[None, :])
        out = [("link", links)]
        for own, mine, roots, near in ((ids, core, right, within & other_core[None, :]), (others, other_core, left, (within & core[:, None]).T)):
            i, j = np.nonzero(near & ~mine[:, None])
            out.append(("border", np.unique(np.column_stack([own[i], roots[j]]), axis=0)))
            if row["a"] == row["b"]:
                break
        for kind, made in out:
            if len(made):
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(made)), pa.array(made[:, 0]), pa.array(made[:, 1])], names=["kind", "a", "b"])

    return run


def forest(a: np.ndarray, b: np.ndarray, both: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A forest over the rows ``a`` and ``b`` of a matrix of links: each linked to the least of its component; and that least of every row.

    The least id spreads over the matrix, rows to columns and back, until it stays.
    """
    top = np.iinfo(np.int64).max
    left, right = a.copy(), b.copy()
    while True:
        near = np.minimum(right, np.where(both, left[:, None], top).min(axis=0, initial=top))
        back = np.minimum(left, np.where(both, near[None, :], top).min(axis=1, initial=top))
        if np.array_equal(near, right) and np.array_equal(back, left):
            break
        left, right = back, near
    links = np.unique(np.concatenate([np.column_stack([a, left])[both.any(axis=1)], np.column_stack([b, right])[both.any(axis=0)]]), axis=0)
    return links[links[:, 0] != links[:, 1]], left, right


def _joined(edges: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least node that each node reaches, of all edges in one task."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = up.setdefault(y, y)
            x = up[x]
        return x

    for batch in edges:
        for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            x, y = root(x), root(y)
            if x != y:
                up[max(x, y)] = min(x, y)
    if up:
        yield pa.RecordBatch.from_arrays([pa.array(list(up), pa.int64()), pa.array([root(x) for x in up], pa.int64())], names=["id", "label"])


def least_reachable(edges: DataFrame) -> DataFrame:
    """``id, label``: the least id that each node of ``edges(a, b)`` reaches.

    Edges that fit one task (checked) are joined there. Else every round takes the least label around, then the label's own label, so
    long chains shrink fast; each round is stored in the shared folder.
    """
    if edges.limit(ONE_TASK + 1).count() <= ONE_TASK:
        return edges.select("a", "b").coalesce(1).mapInArrow(_joined, "id long, label long")
    both = stored(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("label")), "labels")
    for _ in range(MAX_ROUNDS):
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("m"))
        step = labels.join(near, "id").select("id", "label", F.least("label", "m").alias("now"))
        jump = step.select(F.col("id").alias("now"), F.col("now").alias("then"))
        after = stored(step.join(jump, "now", "left").select("id", F.least("now", F.coalesce("then", "now")).alias("now"), "label"), "labels")
        labels = after.select("id", F.col("now").alias("label"))
        if not after.where("now <> label").take(1):
            return labels
    raise RuntimeError("least_reachable: not settled")


def _in_one(rows: DataFrame, config: GroupConfig) -> DataFrame:
    """``id, cluster`` of rows that fit one block, in one task: the same steps over one matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts).combine_chunks()
        ids = table.column("id").to_numpy().astype(np.int64)
        v = np.asarray(table.column("v").combine_chunks().flatten(), float).reshape(len(ids), -1)
        within = ((v[:, None, :] - v[None, :, :]) ** 2).sum(axis=2) <= config.eps**2
        core = within.sum(axis=1) >= config.min_samples
        _, label, _ = forest(ids, ids, within & core[:, None] & core[None, :])
        top = np.iinfo(np.int64).max
        label = np.where(core, label, np.where(within & core[None, :], label[None, :], top).min(axis=1))
        known = np.unique(label[label < top])
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.where(label < top, np.searchsorted(known, label) + 1, 0))], names=["id", "cluster"])

    return rows.select("id", "v").coalesce(1).mapInArrow(run, "id long, cluster long")


def dbscan(features: DataFrame, config: GroupConfig, one_task: bool = True) -> DataFrame:
    """``id, cluster``: 0 for noise, else 1, 2 and so on in order of the clusters' least core row.

    Plain distance over the five z-scores; a row counts among its own
    ``min_samples`` neighbours; a border row between clusters joins the one that
    comes first. Ids are unique longs. Rows that fit one block are worked on in one task, unless ``one_task`` is false.
    """
    send_package(features.sparkSession)
    rows = normalised(features).select("id", F.array(*DIMENSIONS).alias("v"))
    if one_task and features.limit(BLOCK + 1).count() <= BLOCK:
        return _in_one(rows, config)
    rows = stored(rows, "points")
    tree = space.plant(rows, BLOCK)
    made = space.blocks(rows, tree, BLOCK, {})
    found = space.pairs(made, tree, config.eps)
    counts = space.over_pairs(found, made, ["n", "v"], _counts(config.eps), "block long, counts binary")
    core = counts.groupBy("block").applyInArrow(_core(config.min_samples), "block long, core binary")
    flagged = stored(made.select("block", "n", "ids", "v").join(core, "block"), "core")
    met = stored(space.over_pairs(found, flagged, ["n", "ids", "v", "core"], _meetings(config.eps), "kind string, a long, b long"), "met")
    reached = stored(least_reachable(met.where("kind = 'link'").select("a", "b")), "reached")
    each = flagged.select("ids", "core").mapInArrow(_rows, "id long, core boolean")
    root = reached.select(F.col("id").alias("b"), "label")
    border = met.where("kind = 'border'").join(root, "b", "left").groupBy(F.col("a").alias("id")).agg(F.min(F.coalesce("label", "b")).alias("border"))
    whole = each.join(reached, "id", "left").join(border, "id", "left").select("id", F.when(F.col("core"), F.coalesce("label", "id")).otherwise(F.col("border")).alias("label"))
    whole = stored(whole, "whole")
    number = positions(whole.where("label is not null").select("label").distinct(), ["label"], "place").select("label", (F.col("place") + 1).alias("cluster"))
    return whole.join(number, "label", "left").select("id", F.coalesce("cluster", F.lit(0)).cast("long").alias("cluster"))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, core in zip(batch.column("ids").to_pylist(), batch.column("core").to_pylist()):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(ids, np.int64)), pa.array(np.frombuffer(core, bool))], names=["id", "core"])
