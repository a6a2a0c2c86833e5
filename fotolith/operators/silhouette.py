"""Silhouette of an assignment under the combined distance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fotolith.operators.pairs import cluster_sums
from fotolith.operators.stats import normalised
from fotolith.schema import GroupConfig


def silhouette(features: DataFrame, config: GroupConfig, cluster: str = "cluster") -> DataFrame:
    """``n, silhouette`` in one row.

    a is a row's mean distance within its cluster (0 if alone), b the least mean
    to another cluster (0 if none); cluster 0 counts as a cluster; fewer than
    two rows give 0.
    """
    rows = normalised(features).withColumn("cluster", F.col(cluster).cast("long"))
    counts = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    means = cluster_sums(rows, config).join(counts, "cluster").withColumn("n", F.col("n") - (F.col("own") == F.col("cluster")).cast("int")).where("n > 0")
    mean, inside = F.col("total") / F.col("n"), F.col("own") == F.col("cluster")
    each = means.groupBy("id").agg(F.coalesce(F.max(F.when(inside, mean)), F.lit(0.0)).alias("a"), F.coalesce(F.min(F.when(~inside, mean)), F.lit(0.0)).alias("b"))
    top = F.greatest("a", "b")
    s = F.when(top > 0, (F.col("b") - F.col("a")) / top).otherwise(0.0)
    return each.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(s), F.lit(0.0)).alias("silhouette"))
