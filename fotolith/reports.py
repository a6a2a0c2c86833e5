"""The benchmark report: records, and their CSV, JSON and Markdown forms."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fotolith import datagen
from fotolith.operators.leader import benchmark_algorithms, champion, naive
from fotolith.operators.silhouette import silhouette
from fotolith.operators.stats import heterogeneity, heterogeneity_rate
from fotolith.schema import BENCHMARK, REPORT, GroupConfig
from fotolith.session import stored


def peak_mb(algorithm: str, n: int, clusters: int) -> float:
    """The published memory formula; it is no measurement."""
    return (40 * n + 8 * n * n if algorithm == "Batch DBSCAN" else 128 * clusters) / (1 << 20)


def benchmark(spark: SparkSession, config: GroupConfig = BENCHMARK, names: tuple[str, ...] = tuple(datagen.DATASETS), algorithms: tuple[str, ...] | None = None) -> DataFrame:
    """A ``REPORT`` row for each data set and algorithm (all, unless some are named)."""
    out = []
    for name in names:
        data = stored(datagen.dataset(spark, name), "dataset")
        n, spread = data.count(), heterogeneity(data).first()[0]
        for algorithm, run in benchmark_algorithms().items():
            if algorithms is not None and algorithm not in algorithms:
                continue
            began = time.time()
            assigned = stored(run(data, config), "assigned")
            ms = int((time.time() - began) * 1000)
            clusters = assigned.where("cluster > 0").select("cluster").distinct().count()
            score = silhouette(data.join(assigned, "id"), config).first()["silhouette"]
            out.append((name, n, float(spread), algorithm, ms, peak_mb(algorithm, n, clusters), clusters, float(score)))
    return spark.createDataFrame(out, REPORT)


def folder_study(features: DataFrame, config: GroupConfig, key: str, order: list[str]) -> DataFrame:
    """A row for each folder and streaming algorithm, all folders at once: ``REPORT`` without time and silhouette."""
    n = F.count(F.lit(1))
    facts = features.groupBy(key).agg(n.alias("n"), heterogeneity_rate().alias("spread"))
    out = None
    for name, run in (("Naive Streaming Leader", naive), ("Champion-Initialized Streaming", champion)):
        found = run(features, config, key, order).groupBy(key).agg(F.count_distinct("cluster").alias("clusters"))
        one = facts.join(found, key).select(
            F.col(key).alias("Dataset Name"), F.col("n").alias("Image Count"), F.col("spread").alias("Heterogeneity Rate"), F.lit(name).alias("Algorithm"),
            (F.lit(128) * F.col("clusters") / (1 << 20)).alias("Peak Mem (MB)"), F.col("clusters").alias("Cluster Count"),
        )
        out = one if out is None else out.unionByName(one)
    return out


def as_lines(report: DataFrame) -> DataFrame:
    """``csv, json, markdown``: each row in the report's three forms, made where the rows are."""
    form = {"Heterogeneity Rate": 4, "Peak Mem (MB)": 3, "Silhouette Score": 4}
    numbers = F.struct(*(F.round(F.col(f"`{c}`"), form[c]).alias(c) if c in form else F.col(f"`{c}`") for c in report.columns))
    texts = [F.format_string(f"%.{form[c]}f", F.col(f"`{c}`")) if c in form else F.col(f"`{c}`").cast("string") for c in report.columns]
    return report.select(
        F.to_csv(F.struct(*(t.alias(f"c{i}") for i, t in enumerate(texts)))).alias("csv"), F.to_json(numbers).alias("json"), F.concat(F.lit("| "), F.concat_ws(" | ", *texts), F.lit(" |")).alias("markdown")
    )


def as_strings(report: DataFrame) -> DataFrame:
    """The columns of the CSV form: four decimals, three for the memory."""
    form = {"Heterogeneity Rate": "%.4f", "Peak Mem (MB)": "%.3f", "Silhouette Score": "%.4f"}
    return report.select(*(F.format_string(form[c], F.col(f"`{c}`")).alias(c) if c in form else F.col(f"`{c}`").cast("string").alias(c) for c in report.columns))


def write_csv(report: DataFrame, path: str) -> None:
    as_strings(report).coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def as_json(report: DataFrame) -> str:
    """An array of records; memory to three places, silhouette to four."""
    records = [r.asDict() for r in report.collect()]
    for r in records:
        r["Peak Mem (MB)"] = round(r["Peak Mem (MB)"], 3)
        r["Silhouette Score"] = round(r["Silhouette Score"], 4)
    return json.dumps(records, indent=2)


def as_markdown(report: DataFrame) -> str:
    rows = as_strings(report).collect()
    lines = [f"| {' | '.join(report.columns)} |", "|" + " --- |" * len(report.columns)]
    return "\n".join(lines + [f"| {' | '.join(r)} |" for r in rows]) + "\n"


def study(report: DataFrame) -> DataFrame:
    """The five columns of a study's CSV, from the algorithm on."""
    return as_strings(report).select(*[f"`{c}`" for c in report.columns[3:]])
