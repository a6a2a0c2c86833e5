"""Rows to their nearest centroid, in batch.

Centroids are few: while they fit a broadcast (their number is checked) every batch of rows is
compared with all of them at once. More centroids lie in blocks; batches of rows meet every block by an
equi-join on its number, and the nearest of each block compete. Ties go to the least cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fotolith.functions.distance import Features, kernel
from fotolith.operators.leader import hash_as_text, rows_of
from fotolith.operators.stats import dimension_stats
from fotolith.schema import DIMENSIONS, GroupConfig
from fotolith.session import send_package, stored

#: Centroids that may be broadcast (of some 300 bytes each), centroids of a block beyond that, rows that are compared at a time.
BROADCAST_CENTROIDS, BLOCK, AT_ONCE = 1 << 15, 4096, 512


def features_of(pdf: pd.DataFrame) -> Features:
    rows = list(rows_of(pdf))
    return Features(np.array([v for v, _, _ in rows], float).reshape(len(rows), len(DIMENSIONS)), [h for _, h, _ in rows], [p for _, _, p in rows])


def nearest(rows: Features, centroids: Features, config: GroupConfig) -> tuple[np.ndarray, np.ndarray]:
    """Place of, and distance to, the first nearest centroid of each row."""
    d = kernel(rows, centroids, config)
    best = d.argmin(axis=1)
    return best, d[np.arange(len(best)), best]


def assign(features: DataFrame, centroids: DataFrame, config: GroupConfig) -> DataFrame:
    """``id, cluster, distance``; no rows without centroids.

    ``centroids`` holds ``cluster`` (a long, once each) and raw ``DIMENSIONS``, ``phash_bits``, ``dominant_colors``;
    both sides are normalised with the deviations of ``features``.
    """
    spark = send_package(features.sparkSession)
    stats = dimension_stats(features, config.std_floor)
    scaled = lambda df: hash_as_text(df.withColumns({d: (F.col(d) - F.lit(m)) / F.lit(s) for d, (m, s) in stats.items()}))
    columns = [*DIMENSIONS, "phash_bits", "dominant_colors"]
    rows, known = scaled(features).select("id", *columns), stored(scaled(centroids).select("cluster", *columns), "centroids")
    found = "id long, cluster long, distance double"

    def compare(pdf: pd.DataFrame, names: np.ndarray, place: Features) -> Iterator[pd.DataFrame]:
        for a in range(0, len(pdf), AT_ONCE):
            part = pdf.iloc[a : a + AT_ONCE]
            at, distance = nearest(features_of(part), place, config)
            yield pd.DataFrame({"id": part["id"].to_numpy(), "cluster": names[at], "distance": distance})

    some = known.orderBy("cluster").limit(BROADCAST_CENTROIDS + 1).toPandas()
    if len(some) <= BROADCAST_CENTROIDS:
        sent = spark.sparkContext.broadcast((some["cluster"].to_numpy(np.int64), features_of(some)))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names, place = sent.value
            for pdf in batches if len(names) else ():
                yield from compare(pdf, names, place)

        return rows.mapInPandas(run, found)

    # By blocks: both sides are dealt by hash, and a block of rows goes to every block of centroids.
    side = lambda df, key, size, name: stored(
        df.withColumn("block", F.pmod(F.xxhash64(key), F.lit(max(1, -(-df.count() // size))))).groupBy("block").agg(F.collect_list(F.struct(key, *columns)).alias(name)), name
    )
    held, asked = side(known, "cluster", BLOCK, "held"), side(rows, "id", BLOCK, "asked")
    top = held.agg(F.max("block")).first()[0]
    sent_rows = asked.select("asked", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(int(top)).cast("long"))).alias("block"))

    def run_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for own, others in zip(pdf["asked"], pdf["held"]):
                one, two = (pd.DataFrame([r if isinstance(r, dict) else r.asDict() for r in x]) for x in (own, others))
                two = two.sort_values("cluster")
                yield from compare(one, two["cluster"].to_numpy(np.int64), features_of(two))

    near = sent_rows.join(held.hint("merge"), "block").select("asked", "held").mapInPandas(run_blocks, found)
    return near.groupBy("id").agg(F.min(F.struct("distance", "cluster")).alias("best")).select("id", "best.cluster", "best.distance")


def centroids_of(features: DataFrame, cluster: str) -> DataFrame:
    """Mean of each cluster's dimensions; hash and palette of its row of least id."""
    mean = features.groupBy(F.col(cluster).cast("long").alias("cluster")).agg(
        *(F.avg(d).alias(d) for d in DIMENSIONS), F.min_by(F.struct("phash_bits", "dominant_colors"), "id").alias("first")
    )
    return mean.select("cluster", *DIMENSIONS, "first.phash_bits", "first.dominant_colors")
