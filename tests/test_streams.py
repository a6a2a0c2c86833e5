"""Streams: leader state over restarts, live views, tables of batches, reports, event time; and the prefix scan."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.types import StructType

from fotolith import catalogue_queries
from fotolith.operators import leader, prefix
from fotolith.schema import GroupConfig
from fotolith.streaming import leader_stream, windows
from fotolith.streaming.progress import ProgressLog, progress
from fotolith.streaming.sink import BatchTable, latest
from tests.test_catalogue import FEATURE, plain_features

CONFIG = GroupConfig(weight_time=1, weight_color=1, weight_name=0, eps=1.0)


@pytest.fixture(scope="module")
def folders(spark):
    """Rows of two folders, one of them without hashes and palettes here and there, and what a batch run makes of them."""
    made = [(*r[:-2], None if r[0] % 7 == 0 else r[-2], None if r[0] % 11 == 0 else r[-1]) for r in plain_features(60, 5)]
    df = spark.createDataFrame(made, FEATURE).withColumn("folder", F.concat(F.lit("f"), (F.col("id") % 2).cast("string")))
    rows = leader.sequenced(df, "folder", ["id"], champions=False).drop("label").withColumn("total", F.lit(30).cast("long")).persist()
    assigned = leader.leader(rows, CONFIG, "folder").persist()
    return rows, assigned


def stream(spark, rows, root, cuts, every):
    """One start for each cut of ``seq``."""
    for a, b in zip([0, *cuts], [*cuts, 10**9]):
        rows.where((F.col("seq") > a) & (F.col("seq") <= b)).coalesce(1).write.mode("append").parquet(f"{root}/in")
        leader_stream.start(spark, f"{root}/in", rows.schema, CONFIG, f"{root}/out", f"{root}/checkpoint", every=every).awaitTermination()


@pytest.mark.parametrize("cuts, every", [((10, 20), 1), ((1, 2, 29), 7)])
def test_stream_equals_batch_over_restarts(spark, folders, tmp_path, cuts, every):
    rows, assigned = folders
    stream(spark, rows, tmp_path, cuts, every)
    made = leader_stream.resolved(leader_stream.events(spark, f"{tmp_path}/out")).collect()
    assert {(r["folder"], r["id"]): r["cluster"] for r in made} == {(r["folder"], r["id"]): r["cluster"] for r in assigned.collect()}
    shown = {tuple(r) for r in leader_stream.live_view(spark, f"{tmp_path}/out").collect()}
    assert shown == {tuple(r) for r in leader.snapshot(assigned, "folder").collect()}


def test_views_come_by_number_of_rows_and_at_the_end(spark, folders, tmp_path):
    rows, _ = folders
    stream(spark, rows, tmp_path, (3, 6, 9), every=5)
    seen = leader_stream.events(spark, f"{tmp_path}/out").where("kind = 'cluster'").select("folder", "batch").distinct().collect()
    # Three rows are too few, six are enough, three more are not, and the last row shows what there is.
    assert sorted(tuple(r) for r in seen) == [("f0", 1), ("f0", 3), ("f1", 1), ("f1", 3)]


def test_a_batch_that_is_run_again_changes_nothing(spark, tmp_path):
    table = BatchTable(spark, f"{tmp_path}/table")
    kind = StructType.fromDDL("k string, v long, gone boolean")
    assert latest(table.rows(kind), ["k"]).collect() == []
    frame = lambda rows: spark.createDataFrame(rows, kind)
    write = table.writer("gone")
    write(frame([("a", 1, False), ("b", 1, False)]), 0)
    write(frame([("a", 2, False), ("c", 1, False)]), 1)
    write(frame([("b", 9, True)]), 2)
    write(frame([("a", 2, False), ("c", 1, False)]), 1)
    assert table.rows(kind).count() == 5
    assert sorted(tuple(r) for r in latest(table.rows(kind), ["k"]).select("k", "v", "gone").collect()) == [("a", 2, False), ("b", 9, True), ("c", 1, False)]


def test_a_chain_of_merges_is_resolved_in_few_rounds(spark, monkeypatch):
    monkeypatch.setattr(leader_stream, "MAX_ROUNDS", 9)
    chain = [("x", None, None, k, k + 1, None, "merge") for k in range(1, 201)] + [("y", None, None, 5, 7, None, "merge")]
    joins = [("x", k, k, k, None, None, "join") for k in range(1, 202)] + [("y", 1, 1, 5, None, None, "join"), ("y", 2, 2, 6, None, None, "join")]
    log = spark.createDataFrame(chain + joins, leader_stream.EVENTS)
    made = {(r["folder"], r["id"]): r["cluster"] for r in leader_stream.resolved(log).collect()}
    assert made == {("x", k): 201 for k in range(1, 202)} | {("y", 1): 7, ("y", 2): 6}
    circle = spark.createDataFrame([("x", None, None, 1, 2, None, "merge"), ("x", None, None, 2, 3, None, "merge"), ("x", None, None, 3, 1, None, "merge")], leader_stream.EVENTS)
    with pytest.raises(RuntimeError, match="circle"):
        leader_stream.resolved(circle).collect()


def test_reports_of_many_batches(spark, tmp_path):
    """More batches than the engine remembers, in two runs."""
    spark.range(150).select(F.col("id")).repartition(150).write.parquet(f"{tmp_path}/in")
    with ProgressLog(spark, f"{tmp_path}/reports") as log:
        for limit in (2, 1):
            rows = spark.readStream.schema("id long").option("maxFilesPerTrigger", limit).parquet(f"{tmp_path}/in")
            log.wait(rows.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/cp{limit}").trigger(availableNow=True).start(), 300)
    queries = {}
    for r in log.read().collect():
        queries.setdefault(r["query"], []).append(r["rows"])
    assert sorted(sum(v) for v in queries.values()) == [150, 150]
    longest = max(queries, key=lambda q: len(queries[q]))
    n = len(queries[longest])
    assert n > 100
    done = progress(log.read().where(F.col("query") == longest)).orderBy("batch").collect()
    assert done[-1]["done"] == done[0]["total"] == 150 and done[-1]["percent"] == 100
    assert [r["done"] for r in done] == np.cumsum([r["extracted"] for r in done]).tolist()


def test_late_and_repeated_events(spark, tmp_path):
    """Ten seconds are allowed: what is not after the watermark is left out, a copy counts once, open windows are not given."""
    batches = [[(1, 1000), (2, 1050)], [(3, 1100), (4, 1040), (5, 1041)], [(6, 1060), (7, 1090), (8, 1091), (3, 1100)], [(9, 1300)]]
    kind = StructType.fromDDL("event_id long, s long")
    with ProgressLog(spark, f"{tmp_path}/reports") as log:
        for rows in batches:
            timed = spark.createDataFrame(rows, kind).select("event_id", F.timestamp_seconds("s").alias("ts"), F.lit("t").alias("event_type"), F.lit(1.5).alias("value"))
            timed.write.mode("append").parquet(f"{tmp_path}/in")
            log.wait(windows.start(spark, f"{tmp_path}/in", timed.schema, windows.Windows("tumbling", "20 seconds"), "10 seconds", f"{tmp_path}/out", f"{tmp_path}/cp"))
    got = spark.read.parquet(f"{tmp_path}/out").select(F.unix_timestamp("window_start").alias("s"), "n", "total").collect()
    assert sorted(tuple(r) for r in got) == [(1000, 1, 1.5), (1040, 2, 3.0), (1080, 1, 1.5), (1100, 1, 1.5)]
    late = {r["batch"]: r["late"] for r in log.read().where("rows > 0").collect()}
    assert [late[b] for b in sorted(late)] == [0, 1, 2, 0]


def test_windows_of_several_kinds_over_timely_rows(spark, tmp_path):
    """The rows of the test above, left out by one stream and put into windows of two kinds by another."""
    batches = [[(1, 1000), (2, 1050)], [(3, 1100), (4, 1040), (5, 1041)], [(6, 1060), (7, 1090), (8, 1091), (3, 1100)], [(9, 1300)]]
    kinds = (windows.Windows("tumbling", "20 seconds"), windows.Windows("session", "15 seconds"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for rows in batches:
        timed = spark.createDataFrame(rows, "event_id long, s long").select("event_id", F.timestamp_seconds("s").alias("ts"), F.lit("t").alias("event_type"), F.lit(1.5).alias("value"))
        timed.write.mode("append").parquet(f"{tmp_path}/in")
        windows.start_timely(spark, f"{tmp_path}/in", timed.schema, "10 seconds", f"{tmp_path}/kept", f"{tmp_path}/cp-kept").awaitTermination()
        windows.start_windows(spark, f"{tmp_path}/kept", timed.schema, kinds, "10 seconds", f"{tmp_path}/out", f"{tmp_path}/cp-out", 2).awaitTermination()
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    assert sorted(r[0] for r in spark.read.parquet(f"{tmp_path}/kept").select("event_id").collect()) == [1, 2, 3, 5, 8, 9]
    got = spark.read.parquet(f"{tmp_path}/out").select("kind", F.unix_timestamp("window_start").alias("s"), F.unix_timestamp("window_end").alias("e"), "n", "total").collect()
    flat = [("tumbling", 1000, 1020, 1, 1.5), ("tumbling", 1040, 1060, 2, 3.0), ("tumbling", 1080, 1100, 1, 1.5), ("tumbling", 1100, 1120, 1, 1.5)]
    assert sorted(tuple(r) for r in got) == [("session", 1000, 1015, 1, 1.5), ("session", 1041, 1065, 2, 3.0), ("session", 1091, 1115, 2, 3.0), *flat]


def test_ids_are_held_once_for_all_kinds(spark, sf, tmp_path):
    """However many kinds of windows there are, an id's row enters the state once; before, once a kind."""
    held, ended = [], []

    class Listener(StreamingQueryListener):
        def onQueryStarted(self, event):
            pass

        def onQueryProgress(self, event):
            held.extend(s.numRowsUpdated for s in event.progress.stateOperators if s.operatorName == "dedupeWithinWatermark")

        def onQueryTerminated(self, event):
            ended.append(event.runId)

    listener = Listener()
    spark.streams.addListener(listener)
    try:
        catalogue_queries.stream_event_windows(spark, sf).collect()
        until = time.time() + 60
        while len(ended) < 2 * catalogue_queries.SPANS and time.time() < until:  # reports come on a thread of their own
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert 0 < sum(held) <= spark.read.parquet(f"{sf}/events.parquet").count()


@pytest.mark.parametrize("parts", [1, 8])
def test_prefix_scan_against_plain(spark, parts):
    """One key holds most rows, so that it lies in many partitions."""
    rng = random.Random(3)
    rows = [(None if rng.random() < 0.05 else "hot" if rng.random() < 0.8 else f"k{rng.randrange(40)}", i, 1e6 + rng.gauss(0, 3)) for i in range(3000)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        made = prefix.scan(spark.createDataFrame(rows, "g string, i long, v double").withColumn("_x", F.lit(1)), "g", ["i"], "v").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(made) == len(rows) and made[0].asDict().keys() == {"g", "i", "v", "_x", "_n", "_mean", "_m2"}
    got = {r["i"]: r for r in made}
    held: dict = {}
    for g, i, v in rows:
        own = held.setdefault(g, [])
        own.append(v)
        assert got[i]["_n"] == len(own)
        assert got[i]["_mean"] == pytest.approx(np.mean(own), rel=1e-12)
        assert got[i]["_m2"] == pytest.approx(np.var(own) * len(own), rel=1e-6, abs=1e-3)


def test_prefix_scan_of_an_empty_table(spark):
    assert prefix.scan(spark.createDataFrame([], "g string, i long, v double"), "g", ["i"], "v").collect() == []


def test_idle_folders_are_forgotten(spark, folders, tmp_path):
    """A folder that gets no rows for longer than its time to live starts anew."""
    rows, _ = folders
    out = f"{tmp_path}/out"
    query = None

    def wait_for(n: int) -> None:
        until = time.time() + 90
        while leader_stream.events(spark, out).where("kind = 'join'").count() < n:
            assert time.time() < until and query.isActive
            time.sleep(0.5)

    rows.limit(0).write.parquet(f"{tmp_path}/in")
    query = leader_stream.start(spark, f"{tmp_path}/in", rows.schema, CONFIG, out, f"{tmp_path}/checkpoint", every=1, ttl_ms=1)
    try:
        for k in (1, 2):
            rows.where(F.col("seq") == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            wait_for(2 * k)
    finally:
        query.stop()
    found = leader_stream.events(spark, out).where("kind = 'join'").select("folder", "seq", "cluster").collect()
    assert sorted(tuple(r) for r in found) == [(f, k, 1) for f in ("f0", "f1") for k in (1, 2)]
