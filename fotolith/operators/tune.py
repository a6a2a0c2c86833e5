"""Epsilon from the elbow of the k-distance curve."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fotolith.functions.distance import Features, kernel
from fotolith.operators import space
from fotolith.operators.stats import normalised
from fotolith.schema import DIMENSIONS, GroupConfig
from fotolith.session import positions, send_package, stored

#: Rows of a block; pivots.
BLOCK, PIVOTS = 256, 4
#: Tasks at most; records of visiting rows in a batch; pairs of rows that are compared at a time.
TASKS, VISITS, PAIRS = 1024, 256, 1 << 15


def held(features: DataFrame) -> DataFrame:
    """What distances need of ``features``, stored: it is read several times, and what makes it (joins, say) runs once."""
    return stored(features.select("id", *DIMENSIONS, "phash_bits", "dominant_colors"), "features")


def row_blocks(features: DataFrame, config: GroupConfig) -> tuple[DataFrame, space.Tree, bool]:
    """Blocks of the rows (see ``space``) that are ``held``, by their weighted vectors, the tree, and whether the distance is a metric (palettes of one size; hashes everywhere or nowhere)."""
    send_package(features.sparkSession)
    scaled = normalised(features)
    # The roots of the weights are in the vectors.
    v = F.array(*(F.col(d) * F.lit(float(np.sqrt(w))) for d, w in zip(DIMENSIONS, config.weights)))
    size = F.when(F.col("dominant_colors").isNull(), 0).otherwise(F.size("dominant_colors"))
    facts = features.agg(F.max(size).alias("most"), F.min(size).alias("least"), F.count("phash_bits").alias("hashed"), F.count(F.lit(1)).alias("n")).first()
    metric = facts["most"] == facts["least"] and facts["hashed"] in (0, facts["n"])
    width = 3 * (facts["most"] or 0)
    padded = F.slice(F.concat(F.coalesce(F.flatten("dominant_colors"), F.array().cast("array<double>")), F.array_repeat(F.lit(float("nan")), max(1, width))), 1, max(1, width))
    rows = scaled.select("id", v.alias("v"), F.coalesce("phash_bits", F.lit(0)).alias("hash"), F.col("phash_bits").isNotNull().alias("hashed"), size.alias("size"), padded.alias("palette"))
    tree = space.plant(rows, BLOCK)
    return space.blocks(rows, tree, BLOCK, {"hash": "int64", "hashed": "bool", "size": "int64", "palette": "float64"}), tree, metric


def near_blocks(features: DataFrame, config: GroupConfig) -> tuple[DataFrame, DataFrame]:
    """Blocks of rows (see ``space``), and the pairs of them that may hold one of a row's nearest.

    The distance is at least its weighted Euclidean part, so boxes bound it; where it is
    a metric, so do the distances to pivots. A row's ``k``-th
    nearest in its own block bounds what it is looking for.
    """
    made, tree, metric = row_blocks(held(features), config)
    k = max(1, config.min_samples)
    pivots = [unpack(r.asDict()) for r in made.orderBy("block").limit(PIVOTS).collect()] if metric else []

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = unpack(row)
                d = apart(own, own, config)
                np.fill_diagonal(d, np.inf)
                radius = float(np.partition(d, k - 1, axis=1)[:, k - 1].max()) if len(own) > k else np.inf
                # A pivot is the first row of a block.
                to = [apart(own, first(p), config)[:, 0] for p in pivots]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["block"]]), pa.array([radius]), *(pa.array([[float(f(x)) for x in to]], pa.list_(pa.float64())) for f in (np.min, np.max))], names=["block", "radius", "near", "far"]
                )

    bounds = made.mapInArrow(bound, "block long, radius double, near array<double>, far array<double>")
    made = stored(made.join(bounds, "block"), "bounded")
    return made, space.pairs(made, tree, "radius", pivots=True)


def unpack(row: dict, prefix: str = "") -> Features:
    """A block's rows; the weights are in the vectors."""
    n = row[f"{prefix}n"]
    own = object.__new__(Features)
    own.vectors = np.frombuffer(row[f"{prefix}v"], float).reshape(n, -1)
    own.hashes, own.has_hash = np.frombuffer(row[f"{prefix}hash"], np.int64).view(np.uint64), np.frombuffer(row[f"{prefix}hashed"], bool)
    own.sizes = np.frombuffer(row[f"{prefix}size"], np.int64)
    flat = np.frombuffer(row[f"{prefix}palette"], float).reshape(n, -1)
    own.palettes = flat.reshape(n, -1, 3) if flat.shape[1] >= 3 else np.full((n, 1, 3), np.nan)
    return own


def first(rows: Features) -> Features:
    one = object.__new__(Features)
    one.vectors, one.hashes, one.has_hash, one.sizes, one.palettes = rows.vectors[:1], rows.hashes[:1], rows.has_hash[:1], rows.sizes[:1], rows.palettes[:1]
    return one


def apart(x: Features, y: Features, config: GroupConfig) -> np.ndarray:
    return kernel(x, y, config, weighted=True)


def k_distances(features: DataFrame, config: GroupConfig) -> DataFrame:
    """``id, k_distance``: the distance to the ``min_samples``-th nearest other row; rows with fewer others are left out."""
    return _k_distances(held(features), config)


def _k_distances(features: DataFrame, config: GroupConfig) -> DataFrame:
    """``k_distances`` of features that are ``held``.

    A row's ``k``-th nearest in its own block bounds what it is looking for. It is sent to the blocks whose cell is within that bound, each alone and
    not its whole block, so the rows that it meets stay about as many when the input grows.
    """
    k = max(1, config.min_samples)
    made = row_blocks(features, config)[0]
    dims = range(len(DIMENSIONS))
    boxes = made.groupBy("cell").agg(F.max(F.shiftright("block", 32)).alias("part"), F.count(F.lit(1)).alias("blocks"), *(F.min(F.col("low")[d]).alias(f"low{d}") for d in dims), *(F.max(F.col("high")[d]).alias(f"high{d}") for d in dims)).collect()  # one row a cell of the tree
    cells, parts = np.array([r["cell"] for r in boxes], np.int64), np.array([r["part"] + 1 for r in boxes], np.int64)
    low, high = (np.array([[r[f"{side}{d}"] for d in dims] for r in boxes], float).reshape(-1, len(dims)) for side in ("low", "high"))
    columns = ["ids", "v", "hash", "hashed", "size", "palette"]
    shape = "block long, visits int, n long, " + ", ".join(f"{c} binary" for c in columns) + ", bound binary"
    names = ["block", "visits", "n", *columns, "bound"]

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own, n = unpack(row), row["n"]
                d = apart(own, own, config)
                np.fill_diagonal(d, np.inf)
                bound = np.partition(d, k - 1, axis=1)[:, k - 1] if n > k else np.full(n, np.inf)
                bound = np.where(np.isnan(bound), np.inf, bound)
                arrays = [np.frombuffer(row[c], kind).reshape(n, -1) for c, kind in zip(columns, (np.int64, float, np.int64, bool, np.int64, float))] + [bound]
                reach = (bound * space.ROUNDING) ** 2
                near = np.flatnonzero(_gap(low, own.vectors.max(axis=0), own.vectors.min(axis=0), high) <= reach.max() * space.ROUNDING)
                out: list[list] = []
                for c in near.tolist():
                    at = np.flatnonzero(_gap(low[c], own.vectors, own.vectors, high[c]) <= reach)
                    for part in range(int(parts[c]) if len(at) else 0):
                        block = part << 32 | int(cells[c])
                        # What has its k nearest at no distance looks no further.
                        some = at if block == row["block"] else at[bound[at] > 0]
                        if len(some):
                            out.append([block, 1, len(some), *(x[some].tobytes() for x in arrays)])
                        if len(out) == VISITS:
                            yield _records(out, names)
                            out = []
                if out:
                    yield _records(out, names)

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict | None = None
        for batch in batches:
            for row in batch.to_pylist():
                if not row["visits"]:
                    held, two, ids = row, unpack(row), np.frombuffer(row["ids"], np.int64)
                elif held is not None and held["block"] == row["block"]:  # else a part that no row was dealt to
                    one, who, bound = unpack(row), np.frombuffer(row["ids"], np.int64), np.frombuffer(row["bound"], float)
                    i, d = _within(one, two, bound, who, ids, config)
                    order = np.lexsort((d, i))
                    i, d = i[order], d[order]
                    stay = np.arange(len(i)) - np.searchsorted(i, i) < k
                    yield pa.RecordBatch.from_arrays([pa.array(who[i[stay]]), pa.array(d[stay])], names=["id", "d"])

    own = made.select("block", F.lit(0).alias("visits"), "n", *columns, F.lit(None).cast("binary").alias("bound"))
    tasks = max(1, min(TASKS, sum(r["blocks"] for r in boxes) // 2))
    # Blocks are work, not bytes: they are dealt to tasks by their number.
    sent = made.select("block", "n", *columns).repartition(tasks).mapInArrow(visit, shape)
    met = own.unionByName(sent).repartition(tasks, "block").sortWithinPartitions("block", "visits")
    near = met.mapInArrow(least, "id long, d double")
    place = F.row_number().over(Window.partitionBy("id").orderBy("d"))
    return near.withColumn("r", place).where(F.col("r") == k).select("id", F.col("d").alias("k_distance"))


def _gap(low: np.ndarray, top: np.ndarray, bottom: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of the boxes from ``low`` to ``high`` to those from ``bottom`` to ``top``."""
    return (np.maximum(np.maximum(low - top, bottom - high), 0.0) ** 2).sum(axis=1)


def _records(rows: list[list], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int64()] + [pa.binary()] * (len(names) - 3)
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)], names=names)


def _within(x: Features, y: Features, bound: np.ndarray, who: np.ndarray, ids: np.ndarray, config: GroupConfig) -> tuple[np.ndarray, np.ndarray]:
    """The distances from rows of ``x`` to other rows of ``y`` that are within the row's bound: rows of ``x``, distances.

    The Euclidean part comes first, then palettes and hashes of what it leaves.
    """
    places, found = [np.zeros(0, np.int64)], [np.zeros(0)]
    step = max(1, PAIRS // max(1, len(ids)))
    for a in range(0, len(who), step):
        at = slice(a, a + step)
        square = sum((x.vectors[at, d, None] - y.vectors[None, :, d]) ** 2 for d in range(x.vectors.shape[1]))
        i, j = np.nonzero((square <= (bound[at, None] * space.ROUNDING) ** 2) & (who[at, None] != ids[None, :]))
        d = np.sqrt(square[i, j])
        i += a
        d += np.where(x.has_hash[i] & y.has_hash[j], np.bitwise_count(x.hashes[i] ^ y.hashes[j]) / 64.0, 0.0) * config.phash_weight
        some = d <= bound[i] * space.ROUNDING
        i, j, d = i[some], j[some], d[some]
        colours = np.nan_to_num(np.sqrt(((x.palettes[i] - y.palettes[j]) ** 2).sum(axis=2))).sum(axis=1) / (np.maximum(x.sizes[i], 1) * 100.0)
        d += np.where((x.sizes[i] == 0) | (y.sizes[j] == 0), 1.0, colours) * config.palette_weight
        some = (d <= bound[i] * space.ROUNDING) & np.isfinite(d)
        places.append(i[some])
        found.append(d[some])
    return np.concatenate(places), np.concatenate(found)


def elbow(distances: DataFrame) -> DataFrame:
    """``optimal_eps``: the distance farthest from the chord of the sorted curve; 0.1 for fewer than three.

    Positions on the curve come from a sort by ranges.
    """
    distances = stored(distances.select("k_distance"), "curve")
    curve = positions(distances, ["k_distance"], "i")
    ends = distances.agg(F.min("k_distance").alias("y1"), F.max("k_distance").alias("y2"), (F.count(F.lit(1)) - 1).alias("x2"))
    y0, x0, y1, y2, x2 = (F.col(c) for c in ("k_distance", "i", "y1", "y2", "x2"))
    away = F.abs((y2 - y1) * x0 - x2 * y0 + x2 * y1) / F.sqrt(F.pow(y2 - y1, F.lit(2.0)) + F.pow(x2, F.lit(2.0)))
    best = curve.join(F.broadcast(ends)).agg(F.max_by("k_distance", F.struct(away, -F.col("i"))).alias("e"), F.count(F.lit(1)).alias("n"))
    return best.select(F.when(F.col("n") < 3, 0.1).otherwise(F.col("e")).alias("optimal_eps"))


def auto_tune(features: DataFrame, config: GroupConfig) -> DataFrame:
    """``optimal_eps``; an error for no more rows than ``min_samples``."""
    features = held(features)
    if features.count() < config.min_samples + 1:
        raise ValueError("auto_tune: not enough images")
    return elbow(_k_distances(features, config))
