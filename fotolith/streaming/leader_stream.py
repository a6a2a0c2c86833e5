"""Leader clustering as a stream, with a live view of its clusters.

Files of feature rows arrive in a folder; every micro-batch is ingested in an
explicit order by the same machine as the batch operator. Its state is typed: of each folder one value
(running statistics, next id) and a map of its clusters, of which a batch writes only those that
changed. The stream gives joins, merges and, after every so many rows of a folder or when its
last row has come, the clusters that changed since; they replace what was shown before.

All three kinds go to one table of micro-batches in one write, so a batch that is run
again after a loss changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

import fotolith
from fotolith.operators.leader import Machine, Welford, hash_as_text, rows_of
from fotolith.schema import GroupConfig
from fotolith.session import send_package, stored
from fotolith.streaming.sink import BatchTable, latest

#: ``kind``: join (id, seq, cluster), merge (cluster, merged_into) or cluster (cluster, n; none left if it was merged away).
EVENTS = "folder string, id long, seq long, cluster long, merged_into long, n long, kind string"
FOLDER_STATE = "n long, mean array<double>, m2 array<double>, next_id long, shown long"
CLUSTER_STATE = "count double, sums array<double>, phash string, palette array<array<double>>, changed boolean"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MAX_ROUNDS = 64


class LeaderProcessor(StatefulProcessor):
    """``every``: rows of a folder between two views; ``ttl_ms``: how long a folder that gets no rows is known."""

    def __init__(self, config: GroupConfig, every: int = 4, ttl_ms: int | None = None):
        self.config, self.every, self.ttl_ms = config, every, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.folder = handle.getValueState("folder", FOLDER_STATE, self.ttl_ms)
        self.clusters = handle.getMapState("clusters", "cluster long", CLUSTER_STATE, self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = {k[0]: tuple(v) for k, v in self.clusters.iterator()}
        n, mean, m2, next_id, shown = self.folder.get() if self.folder.exists() else (0, None, None, 1, 0)
        live = [(i, c, list(sums), None if h is None else int(h), [list(p) for p in palette]) for i, (c, sums, h, palette, _) in sorted(known.items()) if c]
        machine = Machine(self.config, Welford(n, mean, m2), next_id, live)
        batch = pd.concat(list(rows)).sort_values("seq")
        look = {}
        out = []
        for i, s, row in zip(batch["id"], batch["seq"], rows_of(batch)):
            before = machine.next_id
            home = machine.ingest(*row)
            if home == before:
                look[home] = None if row[1] is None else str(row[1]), row[2]
            out.append((key[0], int(i), int(s), home, None, None, "join"))
        out += [(key[0], None, None, old, new, None, "merge") for old, new in machine.into.items()]
        changed = {r[3] for r in out} | {new for new in machine.into.values()}
        state = machine.clusters()
        total = batch["total"].max() if "total" in batch else None
        show = machine.stats.n - shown >= self.every or machine.stats.n == total
        for c in changed | {c for c, v in known.items() if v[4]}:
            count, sums = state.get(c, (0.0, [0.0] * 5))
            if show and (count or c in known):
                out.append((key[0], None, None, c, None, int(count), "cluster"))
            if show and not count:
                if c in known:
                    self.clusters.removeKey((c,))
            elif count or c in known:  # a cluster that came and went unseen leaves nothing
                phash, palette = look[c] if c in look else known[c][2:4]
                self.clusters.updateValue((c,), (count, [float(x) for x in sums], phash, [[float(x) for x in p] for p in palette], not show))
        done = machine.stats
        self.folder.update((done.n, done.mean.tolist(), done.m2.tolist(), machine.next_id, done.n if show else shown))
        made = pd.DataFrame(out, columns=["folder", "id", "seq", "cluster", "merged_into", "n", "kind"])
        yield made.astype(dict.fromkeys(["id", "seq", "cluster", "merged_into", "n"], "Int64"))

    def close(self) -> None:
        pass


def leader_events(features: DataFrame, config: GroupConfig, every: int = 4, ttl_ms: int | None = None) -> DataFrame:
    """``EVENTS`` of the stream ``features(folder, id, seq, ...)``; a column ``total`` says how many rows a folder will have."""
    send_package(features.sparkSession)
    mode = "None" if ttl_ms is None else "ProcessingTime"
    # The worker that asks a processor for its state's schema runs beside the driver and knows no files that were added: the code travels in the plan.
    cloudpickle.register_pickle_by_value(fotolith)
    try:
        return hash_as_text(features).groupBy("folder").transformWithStateInPandas(LeaderProcessor(config, every, ttl_ms), EVENTS, "update", mode)
    finally:
        cloudpickle.unregister_pickle_by_value(fotolith)


def start(spark: SparkSession, folder: str, schema: StructType, config: GroupConfig, out: str, checkpoint: str, files_per_batch: int = 1, every: int = 4, ttl_ms: int | None = None) -> StreamingQuery:
    """Ingest the files of a folder, some in each micro-batch, into the table ``out``; the query ends when all that is there is done.

    With ``ttl_ms`` it goes on until it is stopped: state that expires by the clock makes batches without rows.
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    try:
        sink = BatchTable(spark, out).writer("kind")
        out_rows = leader_events(rows, config, every, ttl_ms).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).outputMode("update")
        return (out_rows.trigger(availableNow=True) if ttl_ms is None else out_rows.trigger(processingTime="1 second")).start()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def events(spark: SparkSession, out: str) -> DataFrame:
    """All rows of the table, with their ``batch``."""
    return BatchTable(spark, out).rows(StructType.fromDDL(EVENTS))


def live_view(spark: SparkSession, out: str) -> DataFrame:
    """``folder, cluster, n, label``: the clusters as last shown."""
    shown = latest(events(spark, out).where("kind = 'cluster'").select("folder", "cluster", "n", "batch"), ["folder", "cluster"])
    return shown.where("n > 0").withColumn("label", F.concat(F.col("n").cast("string"), F.lit(" images")))


def resolved(log: DataFrame) -> DataFrame:
    """``folder, id, cluster`` after all merges, from the event log.

    Merges form a forest. In each round every cluster takes over what its own target
    was merged into, so a chain of n merges is done in log n rounds; each round is stored.
    """
    merges = log.where("kind = 'merge'").select("folder", F.col("cluster").alias("old"), F.col("merged_into").alias("new"))
    for _ in range(MAX_ROUNDS):
        jump = merges.select("folder", F.col("old").alias("new"), F.col("new").alias("then"))
        step = stored(merges.join(jump, ["folder", "new"], "left").select("folder", "old", F.coalesce("then", "new").alias("new"), F.col("then").isNotNull().alias("moved")), "merges")
        merges = step.drop("moved")
        if not step.where("moved").take(1):
            break
    else:
        raise RuntimeError("resolved: merges run in a circle")
    rows = log.where("kind = 'join'").select("folder", "id", "cluster")
    return rows.join(merges.withColumnRenamed("old", "cluster"), ["folder", "cluster"], "left").select("folder", "id", F.coalesce("new", "cluster").alias("cluster"))
