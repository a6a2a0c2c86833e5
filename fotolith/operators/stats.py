"""Means, deviations and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fotolith.operators import prefix
from fotolith.schema import DIMENSIONS


def floored_std(n: Column, std: Column, floor: float) -> Column:
    """Population deviation: 1 for fewer than two rows, else at least the floor (and 1e-9)."""
    return F.when(n < 2, 1.0).otherwise(F.greatest(std, F.lit(max(floor, 1e-9))))


def dimension_stats(features: DataFrame, floor: float = 0.0) -> dict[str, tuple[float, float]]:
    """Mean and floored deviation of each dimension: one aggregation, one row to the driver."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for d in DIMENSIONS:
        aggs += [F.avg(d).alias(f"m_{d}"), F.stddev_pop(d).alias(f"s_{d}")]
    row = features.agg(*aggs).first()
    out = {}
    for d in DIMENSIONS:
        std = 1.0 if row["n"] < 2 or row[f"s_{d}"] is None else max(row[f"s_{d}"], floor, 1e-9)
        out[d] = (row[f"m_{d}"] or 0.0, std)
    return out


def normalised(features: DataFrame, floor: float = 0.0) -> DataFrame:
    """``features`` with z-scores in place of the five dimensions."""
    stats = dimension_stats(features, floor)
    return features.withColumns({d: (F.col(d) - F.lit(m)) / F.lit(s) for d, (m, s) in stats.items()})


def running(rows: DataFrame, group: str, order: str, value: str, floor: float = 0.0) -> DataFrame:
    """``group, order, n, mean, std``: statistics of each prefix of a group, by a scan in two levels."""
    made = prefix.scan(rows.select(group, order, value), group, [order], value)
    n = F.col("_n")
    return made.select(group, order, n.alias("n"), F.col("_mean").alias("mean"), floored_std(n, F.sqrt(F.col("_m2") / n), floor).alias("std"))


def heterogeneity_rate() -> Column:
    """Deviations of a group scaled to comparable ranges and added; 0 for no rows."""
    scale = {"time": 0.1 / 86400, "l": 1 / 100, "a": 1 / 128, "b": 1 / 128, "aspect_ratio": 1 / 2}
    n = F.count(F.lit(1))
    total = sum((floored_std(n, F.stddev_pop(d), 0.0) * F.lit(k) for d, k in scale.items()), F.lit(0.0))
    return F.when(n == 0, 0.0).otherwise(total)


def heterogeneity(features: DataFrame) -> DataFrame:
    """One row ``heterogeneity``."""
    return features.agg(heterogeneity_rate().alias("heterogeneity"))


def variance_forces(features: DataFrame, weights: tuple[float, float, float]) -> DataFrame:
    """``time, color, palette``: shares of the weighted deviations in percent (an extension; the reference reports its weights)."""
    n = F.count(F.lit(1))
    std = {d: F.stddev_pop(d) for d in DIMENSIONS}
    raw = [F.lit(weights[0]) * std["time"] / 86400, F.lit(weights[1]) * (std["l"] + std["a"] + std["b"]) / 300, F.lit(weights[2]) * std["aspect_ratio"]]
    total = raw[0] + raw[1] + raw[2]
    return features.agg(*(F.when((n == 0) | (total <= 1e-9), 33.3).otherwise(r / total * 100).alias(k) for k, r in zip(("time", "color", "palette"), raw)))
