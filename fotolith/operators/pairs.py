"""Distances between all rows, in blocks.

Rows are dealt to blocks of bounded size in order of their cluster, as binary arrays; every two blocks meet
once, each meeting is a group of its own, and a numpy kernel adds up their distances for the rows
of both sides: one vector for each cluster of the other side. Pairs of rows are never emitted as rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fotolith.functions.distance import Features, tiles
from fotolith.schema import DIMENSIONS, GroupConfig
from fotolith.session import positions, send_package, stored

#: Least and greatest number of rows of a block, and blocks that small inputs are cut into.
BLOCK, MOST, BLOCKS = 1024, 8192, 32
#: Tasks of the meetings at most; bytes of vectors that a meeting hands on at a time.
TASKS, CHUNK_BYTES = 4096, 1 << 24


def blocks(rows: DataFrame, n: int) -> tuple[DataFrame, int]:
    """Rows in blocks of equal size, ordered by cluster, and the number of blocks; stored."""
    size = max(BLOCK, min(n // BLOCKS, MOST))
    many = F.when(F.col("dominant_colors").isNull(), 0).otherwise(F.size("dominant_colors"))
    width = 3 * max(1, rows.agg(F.max(many)).first()[0] or 0)
    flat = F.concat(F.coalesce(F.flatten("dominant_colors"), F.array().cast("array<double>")), F.array_repeat(F.lit(0.0), width))
    hashed = F.col("phash_bits").isNotNull()
    plain = rows.select("id", "cluster", F.array(*DIMENSIONS).alias("v"), F.coalesce("phash_bits", F.lit(0)).cast("long").alias("hash"), hashed.alias("hashed"), many.cast("long").alias("size"), F.slice(flat, 1, width).alias("palette"))
    dealt = positions(plain, ["cluster", "id"], "place").withColumn("block", F.floor(F.col("place") / size).cast("long"))

    def gather(table: pa.Table) -> pa.Table:
        table = table.sort_by([("cluster", "ascending"), ("id", "ascending")]).combine_chunks()
        if table.column("cluster").null_count:
            raise ValueError("silhouette: a row without a cluster")
        made = {"block": [table.column("block")[0].as_py()], "n": [table.num_rows]}
        for name, kind in (("id", "int64"), ("cluster", "int64"), ("v", "float64"), ("hash", "int64"), ("hashed", "bool"), ("size", "int64"), ("palette", "float64")):
            column = table.column(name).combine_chunks()
            column = column.flatten() if pa.types.is_list(column.type) else column
            made[name] = [column.to_numpy(zero_copy_only=False).astype(kind).tobytes()]
        return pa.table(made)

    shape = "block long, n long, id binary, cluster binary, v binary, hash binary, hashed binary, size binary, palette binary"
    return stored(dealt.groupBy("block").applyInArrow(gather, shape), "blocks"), -(-n // size)


def unpack(row: dict) -> tuple[np.ndarray, Features]:
    """Clusters and features of a block."""
    n, own = row["n"], object.__new__(Features)
    own.vectors, own.palettes = np.frombuffer(row["v"], float).reshape(n, -1), np.frombuffer(row["palette"], float).reshape(n, -1, 3)
    own.hashes, own.has_hash = np.frombuffer(row["hash"], np.int64).view(np.uint64), np.frombuffer(row["hashed"], bool)
    own.sizes = np.frombuffer(row["size"], np.int64)
    return np.frombuffer(row["cluster"], np.int64), own


def cluster_sums(features: DataFrame, config: GroupConfig) -> DataFrame:
    """``id, own, cluster, total``: the distances of each row to all rows of each cluster, added; ``features`` hold ``cluster`` and z-scores."""
    send_package(features.sparkSession)
    made, count = blocks(features, features.count())
    other, own = F.col("other"), F.col("block")
    sent = made.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(count - 1, 0)).cast("long"))))
    sent = sent.withColumn("pair", F.least(own, other) * count + F.greatest(own, other)).drop("other")
    met = sent.repartition(max(1, min(TASKS, count * (count + 1) // 2)), "pair")

    def meet(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: r["block"])
        (mine, x), (others, y) = unpack(rows[0]), unpack(rows[-1])
        (my_names, my_starts), (names, starts) = np.unique(mine, return_index=True), np.unique(others, return_index=True)
        there = np.zeros((len(names), len(mine)))
        back = np.zeros((len(my_names), len(others))) if len(rows) > 1 else None
        for at, d, turned in tiles(x, y, config):
            if back is None:
                d[np.arange(len(d)), np.arange(at.start, at.start + len(d))] = 0.0
            there[:, at] = np.add.reduceat(d, starts, axis=1).T
            if back is not None:
                known, first = np.unique(mine[at], return_index=True)
                back[np.searchsorted(my_names, known)] += np.add.reduceat(turned, first, axis=0)
        for row, found, total in ((rows[0], names, there), (rows[-1], my_names, back)):
            if total is not None:
                step = max(1, CHUNK_BYTES // max(1, total.shape[1] * 8))
                for i in range(0, len(found), step):
                    some = found[i : i + step]
                    yield pa.RecordBatch.from_arrays([pa.array([row["block"]] * len(some), pa.int64()), pa.array(some), pa.array([t.tobytes() for t in total[i : i + step]], pa.binary())], names=["block", "cluster", "total"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(np.frombuffer(x, float) for b in batches for x in b.column("total").to_pylist())
        yield pa.RecordBatch.from_arrays([*(pa.array([k.as_py()], pa.int64()) for k in key), pa.array([total.tobytes()], pa.binary())], names=["block", "cluster", "total"])

    shape = "block long, cluster long, total binary"
    added = met.groupBy("pair").applyInArrow(meet, shape).groupBy("block", "cluster").applyInArrow(add, shape)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, mine, total = (np.frombuffer(r[c], kind) for c, kind in (("id", np.int64), ("own", np.int64), ("total", float)))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(mine), pa.array(np.full(len(ids), r["cluster"])), pa.array(total)], names=["id", "own", "cluster", "total"])

    held = made.select("block", "id", F.col("cluster").alias("own"))
    return added.join(held, "block").select("id", "own", "cluster", "total").mapInArrow(spread, "id long, own long, cluster long, total double")
