"""Clustering as a table function of SQL.

    SELECT * FROM cluster_rows(TABLE(features), eps => 0.6, weight_time => 0.1)

The function takes any table that has the columns of a feature row and ``id``, asks Spark to
partition it by ``folder`` and order it by ``time`` and ``path``, and gives its rows' keys with their clusters. An algorithm is a class with ``add`` and
``finish``; ``ALGORITHMS`` names those that a query may ask for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.types import LongType, Row, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from fotolith.operators.leader import Machine
from fotolith.schema import DIMENSIONS, GroupConfig
from fotolith.session import send_package

SETTINGS = ("weight_time", "weight_color", "weight_name", "eps", "std_floor")
NEEDED = ("folder", "id", *DIMENSIONS, "path", "phash_bits", "dominant_colors")


class Leader:
    """Online leader clustering, in the order of arrival."""

    def __init__(self, config: GroupConfig):
        self.machine, self.homes = Machine(config), []

    def add(self, row: Row) -> None:
        palette = [[float(x) for x in c] for c in row["dominant_colors"] or ()]
        self.homes.append(self.machine.ingest(np.array([row[d] for d in DIMENSIONS], float), row["phash_bits"], palette))

    def finish(self) -> list[int]:
        return [self.machine.resolve(c) for c in self.homes]


class Hashes:
    """Rows of one perceptual hash are a cluster, named by order of appearance; rows without hash are 0."""

    def __init__(self, config: GroupConfig):
        self.known: dict[int, int] = {}
        self.homes: list[int] = []

    def add(self, row: Row) -> None:
        h = row["phash_bits"]
        self.homes.append(0 if h is None else self.known.setdefault(h, len(self.known) + 1))

    def finish(self) -> list[int]:
        return self.homes


ALGORITHMS = {"leader": Leader, "hash": Hashes}


class ClusterRows:
    @staticmethod
    def analyze(table: AnalyzeArgument, algorithm: AnalyzeArgument | None = None, **settings: AnalyzeArgument) -> AnalyzeResult:
        if not table.isTable or (missing := [c for c in NEEDED if c not in table.dataType.names]):
            raise ValueError(f"cluster_rows: a table with the columns {', '.join(NEEDED)} is needed" + (f"; {', '.join(missing)} not there" if table.isTable else ""))
        if algorithm is not None and algorithm.value not in ALGORITHMS:
            raise ValueError(f"cluster_rows: no algorithm {algorithm.value}; there are {', '.join(ALGORITHMS)}")
        if unknown := [k for k in settings if k not in SETTINGS]:
            raise ValueError(f"cluster_rows: no setting {', '.join(unknown)}")
        own = {f.name: f for f in table.dataType.fields}
        made = StructType([own["folder"], own["id"]]).add("cluster", LongType())
        return AnalyzeResult(made, partitionBy=[PartitioningColumn("folder")], orderBy=[OrderingColumn("time"), OrderingColumn("path")])

    def __init__(self):
        self.run = None
        self.keys: list[tuple] = []

    def eval(self, table: Row, algorithm: str = "leader", **settings: float) -> None:
        if self.run is None:
            self.run = ALGORITHMS[algorithm](GroupConfig(**{k: float(v) for k, v in settings.items()}))
        self.keys.append((table["folder"], table["id"]))
        self.run.add(table)

    def terminate(self) -> Iterator[tuple]:
        if self.run is not None:
            for key, cluster in zip(self.keys, self.run.finish()):
                yield *key, cluster


def register(spark: SparkSession) -> SparkSession:
    """Make ``cluster_rows`` known to the session's SQL."""
    from pyspark.sql.functions import udtf

    send_package(spark)
    spark.udtf.register("cluster_rows", udtf(ClusterRows))
    return spark
