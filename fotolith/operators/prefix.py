"""Prefix scans in two levels: statistics of every prefix of a group, whatever share of the rows a group holds.

Rows are dealt by ranges of group and order, so that a large group lies in many
partitions. Each partition scans its own rows; what it holds of a group is one
summary (number, mean, squared deviations). The summaries of the partitions before, merged, are the
offset of a partition's rows. No task sees more than its range, and the second
level has a row for each group and partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fotolith.session import send_package, stored

#: Rows of summaries that may be broadcast.
BROADCAST_ROWS = 1 << 20


def merged(n1, mean1, m1, n2, mean2, m2):
    """Number, mean and squared deviations of two sets together; works on numbers, arrays and columns alike."""
    n = n1 + n2
    gap = mean2 - mean1
    return n, mean1 + gap * n2 / n, m1 + m2 + gap * gap * n1 * n2 / n


def scan_runs(names: list, values: np.ndarray, carried: tuple | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple]:
    """Running number, mean and squared deviations of sorted rows by group, going on from ``carried`` (group, n, mean, m2)."""
    n, mean, m2 = np.empty(len(values), np.int64), np.empty(len(values)), np.empty(len(values))
    starts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1])]
    for a, b in zip(starts, [*starts[1:], len(names)]):
        x = values[a:b]
        k = np.arange(1, b - a + 1)
        total = np.cumsum(x - x[0])
        square = np.cumsum((x - x[0]) ** 2)
        own = k, x[0] + total / k, np.maximum(square - total * total / k, 0.0)
        if carried is not None and carried[0] == names[a]:
            own = merged(carried[1], carried[2], carried[3], *own)
        n[a:b], mean[a:b], m2[a:b] = own
        carried = names[a], int(n[b - 1]), float(mean[b - 1]), float(m2[b - 1])
    return n, mean, m2, carried


def _scanned(rows: DataFrame, group: str, order: list[str], value: str | None) -> DataFrame:
    """``rows`` dealt by ranges, with ``_part``, ``_n``, ``_mean``, ``_m2`` of the prefix inside the partition; stored."""
    spark = send_package(rows.sparkSession)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = [F.asc_nulls_first(c) for c in (group, *order)]
    dealt = rows.withColumn("_value", F.lit(0.0) if value is None else F.col(value).cast("double")).repartitionByRange(parts, *by).sortWithinPartitions(*by)
    dealt = dealt.withColumn("_part", F.spark_partition_id())
    at, of = dealt.columns.index(group), dealt.columns.index("_value")
    schema = dealt.drop("_value").schema.add("_n", "long").add("_mean", "double").add("_m2", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = None
        for batch in batches:
            if not batch.num_rows:
                continue
            *own, carried = scan_runs(batch.column(at).to_pylist(), batch.column(of).to_numpy(zero_copy_only=False).astype(float), carried)
            kept = [c for i, c in enumerate(batch.columns) if i != of]
            yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, own)], names=schema.names)

    return stored(dealt.mapInArrow(run, schema), "scanned")


def _offsets(scanned: DataFrame, group: str) -> DataFrame:
    """``group, _part`` and what the partitions before hold of the group: ``_n0, _mean0, _m0``; groups in one partition have no row."""
    ends = scanned.groupBy(group, "_part").agg(F.max_by(F.struct("_n", "_mean", "_m2"), "_n").alias("_s"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # Moments about a common point of the group add up; the point is a mean of the group's own, so nothing is lost in size.
    first = F.first("_s._mean").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    moved = ends.withColumn("_point", first).withColumn("_gap", F.col("_s._mean") - F.col("_point"))
    n = F.sum("_s._n").over(before)
    one = F.sum(F.col("_s._n") * F.col("_gap")).over(before)
    two = F.sum(F.col("_s._m2") + F.col("_s._n") * F.col("_gap") * F.col("_gap")).over(before)
    return moved.select(group, "_part", n.alias("_n0"), (F.col("_point") + one / n).alias("_mean0"), (two - one * one / n).alias("_m0")).where("_n0 is not null")


def scan(rows: DataFrame, group: str, order: list[str], value: str | None = None) -> DataFrame:
    """``rows`` with ``_n``, ``_mean`` and ``_m2`` of the group's prefix that ends with each row.

    Rows of equal group and order stand in any order; a null value makes the statistics from there on NaN.
    """
    made = _scanned(rows, group, order, value)
    offsets = _offsets(made, group)
    few = offsets.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    offsets = offsets.withColumnsRenamed({group: "_group0", "_part": "_part0"})
    joined = made.join(F.broadcast(offsets) if few else offsets, F.col(group).eqNullSafe(F.col("_group0")) & (F.col("_part") == F.col("_part0")), "left")
    n, mean, m2 = merged(F.col("_n0"), F.col("_mean0"), F.col("_m0"), F.col("_n"), F.col("_mean"), F.col("_m2"))
    none = F.col("_n0").isNull()
    whole: list[Column] = [F.when(none, F.col(c)).otherwise(x).alias(c) for c, x in (("_n", n), ("_mean", mean), ("_m2", m2))]
    return joined.select(*rows.columns, *whole)


def places(rows: DataFrame, group: str, order: list[str], name: str = "place") -> DataFrame:
    """``rows`` with each row's place in its group, from 1; nulls first."""
    return scan(rows, group, order).withColumnRenamed("_n", name).drop("_mean", "_m2")


def running_sums(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """``rows`` with ``sum``, the integer sum of each prefix (exact below 2^48)."""
    made = scan(rows, group, [order], value)
    return made.withColumn("sum", F.round(F.col("_mean") * F.col("_n")).cast("long")).drop("_n", "_mean", "_m2")
