"""Windows of event time over a stream of events, late and repeated rows left out.

A row is late if its time is not after the watermark, which is the greatest time
of all earlier batches less an allowance. A row is known by its id as long as a copy of it
would not be late. Windows close, and leave the state, when the watermark passes their end.

For windows of several kinds, one stream leaves late and repeated rows out (``start_timely``) and a second one opens all
windows over what it kept (``start_windows``): ids, which grow with the events, are held and shuffled once for all kinds.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class Windows:
    """``kind``: tumbling (``size``), sliding (``size`` and ``step``) or session (``size`` is the gap that ends it)."""

    kind: str
    size: str
    step: str | None = None

    def column(self, time: str) -> Column:
        return F.session_window(time, self.size) if self.kind == "session" else F.window(time, self.size, self.step or self.size)


#: Ids are many and do not stay in memory. The batch without rows that ends a start is needed: late is what the batch before knew to be late.
TIMELY_CONF = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
#: A key's rows are merged into sessions where they are read, and go to the one task of the key as sessions.
WINDOWS_CONF = {"spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true"}


def timely(events: DataFrame, allowance: str, id_col: str = "event_id", time: str = "ts") -> DataFrame:
    """Rows that are not late, one for each id."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, allowance).dropDuplicatesWithinWatermark([id_col])


def counted(rows: DataFrame, windows: Windows, key: str = "event_type", time: str = "ts", value: str = "value") -> DataFrame:
    """``kind, window_start, window_end, key, n, total`` of each window of a key; ``rows`` have a watermark."""
    grouped = rows.groupBy(windows.column(time).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return grouped.select(F.lit(windows.kind).alias("kind"), F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), key, "n", "total")


def windowed(events: DataFrame, windows: Windows, allowance: str, key: str = "event_type", id_col: str = "event_id", time: str = "ts", value: str = "value") -> DataFrame:
    """``kind, window_start, window_end, key, n, total`` of each window of a key."""
    return counted(timely(events, allowance, id_col, time), windows, key, time, value)


def start(spark: SparkSession, folder: str, schema: StructType, windows: Windows, allowance: str, out: str, checkpoint: str) -> StreamingQuery:
    """Append the windows that close over all files that are there to the table ``out``; state and watermark go on from the checkpoint."""
    rows = spark.readStream.schema(schema).parquet(folder)
    return _append(windowed(rows, windows, allowance), out, checkpoint, WINDOWS_CONF)


def start_timely(spark: SparkSession, folder: str, schema: StructType, allowance: str, out: str, checkpoint: str) -> StreamingQuery:
    """Append the rows of all files that are there, without late and repeated ones, to the table ``out``."""
    return _append(timely(spark.readStream.schema(schema).parquet(folder), allowance), out, checkpoint, TIMELY_CONF)


def start_windows(spark: SparkSession, folder: str, schema: StructType, windows: Sequence[Windows], allowance: str, out: str, checkpoint: str, partitions: int | None = None) -> StreamingQuery:
    """Append the windows that close over the table ``folder`` of ``start_timely`` to the table ``out``, all kinds by one query.

    The greatest time of a batch is never late and never a repeated row's alone, so the watermark over what was kept is that over
    what arrived. ``partitions``: tasks that hold open windows, which are few where keys are.
    """
    rows = spark.readStream.schema(schema).parquet(folder).withWatermark("ts", allowance)
    found = reduce(DataFrame.unionByName, (counted(rows, w) for w in windows))
    return _append(found, out, checkpoint, WINDOWS_CONF | ({"spark.sql.shuffle.partitions": str(partitions)} if partitions else {}))


def _append(rows: DataFrame, out: str, checkpoint: str, conf: dict[str, str]) -> StreamingQuery:
    with _settings(rows.sparkSession, conf):
        return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


@contextmanager
def _settings(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    """A query that starts meanwhile keeps these settings."""
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
