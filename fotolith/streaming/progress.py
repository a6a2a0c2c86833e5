"""Reports of streams as a table, by a listener.

The engine keeps the last reports of a query in memory; the listener writes every one of
them into a file of its query and batch, so totals stay right over any number of batches
and over restarts, and a batch that is run again replaces its report.
"""

from __future__ import annotations

import json
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from fotolith.operators.prefix import running_sums

REPORT = "query string, run string, batch long, rows long, late long, state_rows long, watermark string, seconds double"


class ProgressLog(StreamingQueryListener):
    """Appends the reports of the session's queries to ``root``; use it in a ``with`` block."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.ended: set[str] = set()
        self.change = threading.Condition()

    def __enter__(self) -> ProgressLog:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_) -> None:
        self.spark.streams.removeListener(self)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        row = {
            "query": str(p.id), "run": str(p.runId), "batch": p.batchId, "rows": p.numInputRows, "late": sum(s.numRowsDroppedByWatermark for s in p.stateOperators),
            "state_rows": sum(s.numRowsTotal for s in p.stateOperators), "watermark": (p.eventTime or {}).get("watermark"), "seconds": p.durationMs.get("triggerExecution", 0) / 1000,
        }
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{p.id}-{p.batchId}.json")
        out = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(path, True)
        out.write(json.dumps(row).encode())
        out.close()

    def onQueryTerminated(self, event) -> None:
        with self.change:
            self.ended.add(str(event.runId))
            self.change.notify_all()

    def wait(self, query: StreamingQuery, seconds: float = 120) -> None:
        """Wait for the query's end, then until its last report is written: reports come on a thread of their own."""
        query.awaitTermination()
        with self.change:
            if not self.change.wait_for(lambda: str(query.runId) in self.ended, seconds):
                raise TimeoutError("the listener heard nothing of the query's end")

    def read(self) -> DataFrame:
        """``REPORT`` rows, one a batch."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], REPORT)
        return self.spark.read.schema(REPORT).json(self.root)


def progress(reports: DataFrame) -> DataFrame:
    """``batch, extracted, done, total, percent`` of one query: the rows of each batch that had some, and of all up to it."""
    rows = reports.where("rows > 0").select("batch", F.col("rows").alias("extracted"))
    done = running_sums(rows.withColumn("_all", F.lit(0)), "_all", "batch", "extracted").drop("_all")
    total = rows.agg(F.sum("extracted").alias("total"))
    return done.join(F.broadcast(total)).select("batch", "extracted", F.col("sum").alias("done"), "total", F.round(100 * F.col("sum") / F.col("total"), 4).alias("percent"))
