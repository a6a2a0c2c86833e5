"""Online leader clustering in an explicit order.

The machine takes one row at a time: statistics are updated, the row goes to the
nearest cluster if that is within ``eps``, else it opens one; after a join the
first other cluster within 1.2 ``eps`` is folded in. Cluster ids are stable:
every event names the cluster it went to, and folded clusters resolve to their
survivor through a merge map. State holds sums and representatives, never
members, so it grows with the clusters of a key only.

The machine is sequential by definition; keys (folders) run in parallel, one task
a key.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fotolith.functions.distance import Features, kernel
from fotolith.functions.labels import cluster_label
from fotolith.schema import DIMENSIONS, GroupConfig
from fotolith.session import send_package, stored

MERGE_FACTOR = 1.2


class Welford:
    """Running mean and squared deviations of the five dimensions."""

    def __init__(self, n: int = 0, mean: list | None = None, m2: list | None = None):
        self.n = n
        self.mean = np.zeros(5) if mean is None else np.array(mean, float)
        self.m2 = np.zeros(5) if m2 is None else np.array(m2, float)

    def add(self, v: np.ndarray) -> None:
        self.n += 1
        gap = v - self.mean
        self.mean = self.mean + gap / self.n
        self.m2 = self.m2 + gap * (v - self.mean)

    def std(self, floor: float) -> np.ndarray:
        return np.ones(5) if self.n < 2 else np.maximum(np.sqrt(self.m2 / self.n), max(floor, 1e-9))


class Machine:
    """The state of one key; ``ingest`` returns the stable id of the row's cluster.

    Clusters lie in arrays in list order, which is the order of their ids, so that a row is
    compared with all of them at once. The arrays grow by doubling.
    """

    def __init__(self, config: GroupConfig, stats: Welford | None = None, next_id: int = 1, clusters: list[tuple] = ()):
        """``clusters``: ``(id, count, sums, phash, palette)`` in order of id."""
        self.config, self.stats, self.next_id = config, stats or Welford(), next_id
        self.n = 0
        self.ids, self.counts, self.sums = np.zeros(16, np.int64), np.zeros(16), np.zeros((16, 5))
        self.known = Features(np.zeros((16, 5)), [None] * 16, [[]] * 16)
        self.into: dict[int, int] = {}
        for cluster, count, sums, phash, palette in clusters:
            self._open(cluster, count, sums, phash, palette)

    def _open(self, cluster: int, count: float, sums: np.ndarray, phash: int | None, palette: list) -> None:
        if self.n == len(self.ids):
            double = lambda x: np.concatenate([x, np.zeros_like(x)])
            self.ids, self.counts, self.sums = double(self.ids), double(self.counts), double(self.sums)
            for name in ("hashes", "has_hash", "sizes", "palettes"):
                setattr(self.known, name, double(getattr(self.known, name)))
        k, one = self.n, Features(np.zeros((1, 5)), [phash], [palette])
        if (more := one.palettes.shape[1] - self.known.palettes.shape[1]) > 0:
            self.known.palettes = np.pad(self.known.palettes, ((0, 0), (0, more), (0, 0)), constant_values=np.nan)
        self.ids[k], self.counts[k], self.sums[k] = cluster, count, sums
        self.known.hashes[k], self.known.has_hash[k], self.known.sizes[k] = one.hashes[0], one.has_hash[0], one.sizes[0]
        self.known.palettes[k] = np.nan
        self.known.palettes[k, : one.palettes.shape[1]] = one.palettes[0]
        self.n += 1

    def _close(self, at: int) -> None:
        own = self.known
        for x in (self.ids, self.counts, self.sums, own.hashes, own.has_hash, own.sizes, own.palettes):
            x[at : self.n - 1] = x[at + 1 : self.n]
        self.n -= 1

    def clusters(self) -> dict[int, tuple]:
        """``(count, sums)`` of each cluster."""
        return {int(i): (float(c), s) for i, c, s in zip(self.ids[: self.n], self.counts, self.sums)}

    def _distances(self, v: np.ndarray, row: Features) -> np.ndarray:
        """From a row of raw values ``v`` to all clusters."""
        std, n, own = self.stats.std(self.config.std_floor), self.n, self.known
        row.vectors = ((v - self.stats.mean) / std)[None, :]
        all_of = object.__new__(Features)
        all_of.vectors = (self.sums[:n] / self.counts[:n, None] - self.stats.mean) / std
        all_of.hashes, all_of.has_hash, all_of.sizes, all_of.palettes = own.hashes[:n], own.has_hash[:n], own.sizes[:n], own.palettes[:n]
        return kernel(row, all_of, self.config)[0]

    def ingest(self, v: np.ndarray, phash: int | None, palette: list) -> int:
        self.stats.add(v)
        if self.n:
            d = self._distances(v, Features(np.zeros((1, 5)), [phash], [palette]))
            best = int(np.argmin(d))
            if d[best] <= self.config.eps:
                self.sums[best] += v
                self.counts[best] += 1
                home = int(self.ids[best])
                self._merge(best)
                return home
        self._open(self.next_id, 1.0, v, phash, palette)
        self.next_id += 1
        return self.next_id - 1

    def _merge(self, at: int) -> None:
        if self.n < 2:
            return
        own, one = self.known, object.__new__(Features)
        one.hashes, one.has_hash, one.sizes, one.palettes = (x[at : at + 1] for x in (own.hashes, own.has_hash, own.sizes, own.palettes))
        d = self._distances(self.sums[at] / self.counts[at], one)
        d[at] = math.inf
        near = np.flatnonzero(d <= self.config.eps * MERGE_FACTOR)
        if not len(near):
            return
        gone = int(near[0])
        self.sums[at] += self.sums[gone]
        self.counts[at] += self.counts[gone]
        self.into[int(self.ids[gone])] = int(self.ids[at])
        self._close(gone)

    def resolve(self, cluster: int) -> int:
        while cluster in self.into:
            cluster = self.into[cluster]
        return cluster


def hash_as_text(features: DataFrame) -> DataFrame:
    """Hashes as text: pandas would turn longs with nulls into doubles."""
    return features.withColumn("phash_bits", F.col("phash_bits").cast("string"))


def rows_of(pdf: pd.DataFrame) -> Iterator[tuple[np.ndarray, int | None, list]]:
    for v, h, p in zip(pdf[list(DIMENSIONS)].to_numpy(float), pdf["phash_bits"], pdf["dominant_colors"]):
        yield v, None if h is None else int(h), [] if p is None else [list(map(float, c)) for c in p]


def sequenced(features: DataFrame, key: str, order: list[str], champions: bool) -> DataFrame:
    """``features`` with ``seq``, the order of ingestion within a key.

    With champions the first, last and upper median row by ``order`` come first,
    in that sequence, each once.
    """
    # A folder is one task's work here in any case, since the machine is sequential; so a window is no further limit.
    by = [F.asc_nulls_first(c) for c in order]
    place = F.row_number().over(Window.partitionBy(key).orderBy(*by))
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    ranked = features.withColumn("_r", place).withColumn("_n", n)
    if not champions:
        return ranked.withColumn("seq", F.col("_r").cast("long")).drop("_r", "_n")
    early = F.when(F.col("_r") == 1, -3).when(F.col("_r") == F.col("_n"), -2).when(F.col("_r") == F.expr("_n div 2 + 1"), -1).otherwise(F.col("_r"))
    return ranked.withColumn("seq", early.cast("long")).drop("_r", "_n")


def leader(features: DataFrame, config: GroupConfig, key: str) -> DataFrame:
    """``key, id, seq, cluster`` of ``features`` with ``seq``: clusters after all merges, from 1 within a key.

    Rows stream through a task in order of key and ``seq``; of a key it holds the
    machine's state and, until the key ends and merges are known, three numbers a row.
    """
    send_package(features.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine, current, held = None, None, []

        def close() -> Iterator[pd.DataFrame]:
            for ids, seqs, found in held:
                yield pd.DataFrame({key: [current] * len(ids), "id": ids, "seq": seqs, "cluster": np.fromiter(map(machine.resolve, found.tolist()), np.int64, len(found))})

        for pdf in batches:
            names = [None if x != x else x for x in pdf[key].tolist()]
            starts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1])] if names else []
            for a, b in zip(starts, [*starts[1:], len(names)]):
                if machine is None or names[a] != current:
                    if machine is not None:
                        yield from close()
                    machine, current, held = Machine(config), names[a], []
                part = pdf.iloc[a:b]
                found = np.fromiter((machine.ingest(*row) for row in rows_of(part)), np.int64, b - a)
                held.append((part["id"].to_numpy(), part["seq"].to_numpy(), found))
        if machine is not None:
            yield from close()

    kind = features.schema[key].dataType.simpleString()
    rows = hash_as_text(features.select(key, "id", "seq", *DIMENSIONS, "phash_bits", "dominant_colors"))
    return rows.repartition(key).sortWithinPartitions(key, "seq").mapInPandas(run, f"{key} {kind}, id long, seq long, cluster long")


def naive(features: DataFrame, config: GroupConfig, key: str, order: list[str]) -> DataFrame:
    """Leader clustering in the given order, deviations without a floor."""
    return leader(sequenced(features, key, order, champions=False), config, key)


def champion(features: DataFrame, config: GroupConfig, key: str, order: list[str]) -> DataFrame:
    """Leader clustering seeded by the oldest, newest and median row, deviations of at least 0.1."""
    floored = GroupConfig(config.weight_time, config.weight_color, config.weight_name, config.eps, config.min_samples, 0.1)
    return leader(sequenced(features, key, order, champions=True), floored, key)


def summaries(features: DataFrame, assigned: DataFrame, key: str) -> DataFrame:
    """``key, cluster, n, label, span_minutes`` and the raw centroid: the final clusters, in plain aggregation."""
    joined = features.join(assigned.select(key, "id", "cluster"), [key, "id"])
    agg = joined.groupBy(key, "cluster").agg(F.count(F.lit(1)).alias("n"), *(F.avg(d).alias(d) for d in DIMENSIONS), ((F.max("time") - F.min("time")) / 60).alias("span_minutes"))
    label = cluster_label(F.col("span_minutes"), F.col("aspect_ratio"), F.col("l"), F.col("a"), F.col("b"))
    return agg.withColumn("label", label)


def snapshot(assigned: DataFrame, key: str) -> DataFrame:
    """``key, cluster, n, label``: the running view, labelled by size."""
    sizes = assigned.groupBy(key, "cluster").agg(F.count(F.lit(1)).alias("n"))
    return sizes.withColumn("label", F.concat(F.col("n").cast("string"), F.lit(" images")))


def benchmark_algorithms() -> dict:
    """``(features, config) -> id, cluster`` of the three algorithms, by name."""
    from fotolith.operators.dbscan import dbscan

    one = lambda f: stored(f.withColumn("dataset", F.lit(0)), "bench")
    return {
        "Batch DBSCAN": dbscan,
        "Naive Streaming Leader": lambda f, c: naive(one(f), GroupConfig(c.weight_time, c.weight_color, c.weight_name, c.eps, c.min_samples, 0.0), "dataset", ["id"]).select("id", "cluster"),
        "Champion-Initialized Streaming": lambda f, c: champion(one(f), c, "dataset", ["id"]).select("id", "cluster"),
    }
