"""A table of micro-batches that may be written again without harm, and the latest row of each key in it.

Every batch is a folder of its own number, written whole or again in place of itself; so a
batch that is run again after a loss leaves the same table. What a reader sees
of a key is its row of the highest batch: the live result, replaced as the stream goes on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType


class BatchTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def writer(self, *by: str) -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch``: a batch's rows into its folder, below it by the values of ``by``."""

        def write(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").partitionBy(*by).parquet(f"{self.path}/batch={number}")

        return write

    def rows(self, schema: StructType) -> DataFrame:
        """All rows with the ``batch`` that wrote them."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/batch=*")
        whole = StructType([*schema.fields]).add("batch", LongType())
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path):
            return self.spark.createDataFrame([], whole)
        return self.spark.read.schema(whole).parquet(self.path)


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key the row of the highest ``batch``; a batch holds a key once."""
    others = [c for c in rows.columns if c not in (*keys, "batch")]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("last"))
    return last.select(*keys, "last.*")
