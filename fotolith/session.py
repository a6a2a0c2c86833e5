"""Session helpers of the catalogue engine: code for the executors, shared folder, tables."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_sent: set[str] = set()


def send_package(spark: SparkSession) -> SparkSession:
    """Give the executors this package, for operators that run Python there.

    It travels once for each application, as a zip through ``addPyFile``, which
    works alike on one machine and on a cluster whose nodes share no code folder.
    """
    app = spark.sparkContext.applicationId
    if app not in _sent:
        root = Path(__file__).resolve().parent
        target = os.path.join(tempfile.mkdtemp(), f"{root.name}.zip")
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        spark.sparkContext.addPyFile(target)
        _sent.add(app)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder is set where that is unset, on one machine only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is not set: the executors and the driver share no folder")
        folder = "file://" + tempfile.mkdtemp(prefix="fotolith-")
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder through the Hadoop file system, if it is there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


_to_delete: list[tuple[SparkSession, str]] = []


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Remove a folder when the program ends: frames that were returned may read it until then."""
    _to_delete.append((spark, path))


@atexit.register
def _cleanup() -> None:
    for spark, path in _to_delete:
        try:
            delete_path(spark, path)
        except Exception:  # the session has ended: the folder's owner clears it
            return


def own_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder; it goes when the program ends."""
    folder = f"{shared_folder(spark)}/fotolith-{spark.sparkContext.applicationId}"
    if (spark, folder) not in _to_delete:
        delete_at_exit(spark, folder)
    return folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame, written to the shared folder and read again: lineage ends here."""
    path = f"{own_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def positions(df: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """``df`` with each row's place, from 0, in the whole order; no single-task sort.

    Rows are dealt by ranges and numbered inside their range; the ranges' sizes,
    one row for each partition, give the offsets.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    numbered = stored(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_inside", inside), "positions")
    sizes = numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return numbered.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_inside") + F.col("_offset")).drop("_part", "_inside", "_offset")
