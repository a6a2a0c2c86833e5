"""Session helpers shared by the operators: code shipping, shared folder, tables."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fotolith.session import delete_at_exit, delete_path, send_package, shared_folder

#: Rows of one Arrow batch; texts may be long, so batches stay small.
BATCH_ROWS = 512
#: Bytes of one Arrow batch.
BATCH_BYTES = 16 << 20
#: Rows of a few numbers that may be broadcast: 16 to 64 MB of them.
BROADCAST_ROWS = 1 << 20

def prepare(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches and give the executors this package."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return send_package(spark)


class Scratch:
    """Tables written to the shared folder to cut lineage.

    A lost executor costs only the stage that reads such a table, never the
    stages that made it. ``drop`` removes a table that no later step reads; the
    rest go when the program ends, since the returned frame may still read them.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        delete_at_exit(spark, self.root)

    def write(self, df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", compression).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        delete_path(self.spark, f"{self.root}/{name}")


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of frames that nothing refers to any more.

    They go when the driver collects garbage, which on a long job may be much
    later; until then they fill the executors' disks.
    """
    gc.collect()
    spark._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sided(ids: DataFrame) -> DataFrame:
    """A frame of few narrow columns, to be broadcast if its number of rows allows it."""
    few = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return F.broadcast(ids) if few else ids.hint("merge")


_kept: list[Callable[[], None]] = []
_stage: list[int] = [-1]


def for_a_stage(forget: Callable[[], None]) -> None:
    """Call ``forget`` in a worker when a task of another stage begins: what one stage keeps is not the next one's load."""
    _kept.append(forget)


def _begin() -> None:
    context = TaskContext.get()
    stage = context.stageId() if context else -1
    if stage != _stage[0]:
        _stage[0] = stage
        for forget in _kept:
            forget()


def tidy(batches: Iterator) -> Iterator:
    """The batches; at their end memory goes back to the system.

    Python workers are used again by later stages, so what a task leaves behind
    would count against the next operator. What a worker holds from its start on, modules
    above all, is not looked through again.
    """
    if not gc.get_freeze_count():
        gc.freeze()
    _begin()
    yield from batches
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU C library has it
        ctypes.CDLL(None).malloc_trim(0)


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    return lambda batches: tidy(run(batches))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
