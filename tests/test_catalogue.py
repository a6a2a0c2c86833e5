"""The catalogue engine: functions, operators, plans, streams, images, reports."""

import json
import math
import random
import struct
import zlib
from types import SimpleNamespace

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from fotolith import catalogue_queries, datagen, feature_queries, reports, session
from fotolith.functions import distance, hashes, labels, names
from fotolith.operators import assign, catalog, dbscan, features, leader, silhouette, space, stats, tune
from fotolith.plans import moves
from fotolith.schema import BENCHMARK, DIMENSIONS, GroupConfig
from fotolith.session import positions
from fotolith.sources import adapters, config, listing, store

FEATURE = "id long, label int, path string, time double, l double, a double, b double, aspect_ratio double, phash_bits long, dominant_colors array<array<double>>"


def column(spark, values, kind, expr):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").orderBy("i").select(expr).collect()]


def plain(x):
    return round(x, 9) if isinstance(x, float) else x.replace(tzinfo=None) if hasattr(x, "tzinfo") else x


SQL = catalogue_queries.ORACLE | feature_queries.ORACLE


@pytest.mark.parametrize("name", SQL)
def test_query_matches_its_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "events", "orders", "lineitem", "part", "benchmark", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found = con.execute(SQL[name])
    names_ = [d[0] for d in found.description]
    want = sorted((tuple(plain(v) for _, v in sorted(zip(names_, r))) for r in found.fetchall()), key=str)
    df = (catalogue_queries.QUERIES | feature_queries.QUERIES)[name](spark, sf)
    got = sorted((tuple(plain(v) for _, v in sorted(r.asDict().items())) for r in df.collect()), key=str)
    assert sorted(df.columns) == sorted(names_) and got == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_extensions(spark):
    given = ["A.JPG", "a.tiff", ".jpg", "noext", "a.tar.png", "a.txt", "", "a.", None]
    assert column(spark, given, "string", names.is_supported(F.col("v"))) == [True, True, False, False, True, False, False, False, False]
    assert column(spark, given, "string", names.extension(F.col("v"))) == ["JPG", "tiff", None, None, "png", "txt", None, "", None]


@pytest.mark.parametrize(
    ("name", "existing", "want"),
    [
        ("photo.jpg", [], "photo_v1.jpg"), ("photo.jpg", ["photo_v1.jpg"], "photo_v2.jpg"), ("photo_v1.jpg", ["photo_v1.jpg"], "photo_v2.jpg"),
        ("photo_1.jpg", ["photo_v1.jpg"], "photo_2.jpg"), ("photo (1).jpg", ["photo_v1.jpg"], "photo (2).jpg"), ("a_v1.jpg", ["a_v2.jpg", "a_v3.jpg", "a_v5.jpg"], "a_v4.jpg"),
        ("_v3.png", [], "__4.png"), ("noext", ["noext_v1"], "noext_v2"), ("a_v", [], "a_v_v1"), ("a_v07.jpg", ["a_v08.jpg"], "a_v8.jpg"),
    ],
)
def test_next_version(spark, name, existing, want):
    if name == "_v3.png":
        want = "_v3_v1.png"  # nothing stands before either mark
    made = names.next_versions(spark.createDataFrame([("d", name), (None, name)], "folder string, name string"), spark.createDataFrame([("d", e) for e in existing], "folder string, name string"))
    assert {r["folder"]: r["next_name"] for r in made.collect()}["d"] == want


def test_unique_and_common_names(spark):
    wanted = spark.createDataFrame([("a",), ("b",), ("c",)], "base string")
    existing = spark.createDataFrame([("a",), ("a (2)",), ("b (2)",), ("c",), ("c (3)",)], "name string")
    assert {r[0]: r[1] for r in names.unique_folders(wanted, existing).collect()} == {"a": "a (3)", "b": "b", "c": "c (2)"}
    rows = [(1, "trip_001.jpg"), (1, "trip_002.jpg"), (2, "ab1.jpg"), (2, "ab2.jpg"), (3, "été-a.png"), (3, "été-b.png"), (4, "x.png"), (4, "y.png"), (5, "same.png")]
    made = names.common_names(spark.createDataFrame(rows, "g int, name string"), "g").collect()
    assert {r[0]: r[1] for r in made} == {1: "trip_00", 2: "Collection", 3: "été", 4: "Collection", 5: "same"}


def test_hash_bits(spark):
    import base64

    raw = [bytes(8), b"\xff" * 8, b"\x80" + bytes(7), b"12345678tail"]
    given = [base64.b64encode(x).decode() for x in raw] + [base64.b64encode(raw[1]).decode().rstrip("="), base64.b64encode(b"1234567").decode(), "", None]
    want = [int.from_bytes(x[:8], "big", signed=True) for x in raw] + [-1, None, None, None]
    assert column(spark, given, "string", hashes.hash_bits(F.col("v"))) == want


def test_hamming_and_palettes(spark):
    rows = [(0, 0), (0, -1), (-(2**63), 0), (5, None)]
    df = spark.createDataFrame(rows, "x long, y long").select(distance.hamming(F.col("x"), F.col("y")))
    assert [r[0] for r in df.collect()] == [0.0, 1.0, 1 / 64, None]
    kind = "p array<array<double>>, q array<array<double>>"
    pairs = [([], [[1.0, 2.0, 3.0]]), ([[0.0, 0.0, 0.0]], [[0.0, 3.0, 4.0]]), ([[0.0, 0.0, 0.0]] * 2, [[0.0, 3.0, 4.0]]), ([[1.0, 1.0, 1.0]], [[1.0, 1.0, 1.0]])]
    got = [r[0] for r in spark.createDataFrame(pairs, kind).select(distance.palette_distance(F.col("p"), F.col("q"))).collect()]
    assert got == pytest.approx([1.0, 0.05, 0.025, 0.0])
    for (p, q), d in zip(pairs, got):
        one, two = (distance.Features(np.zeros((1, 5)), [None], [x]) for x in (p, q))
        assert distance.kernel(one, two, GroupConfig())[0, 0] == pytest.approx(d * GroupConfig().palette_weight)


def test_labels(spark):
    rows = [(9.9, 1.0, 50.0, 0.0, 0.0), (10.0, 1.0, 50.0, 0.0, 0.0), (120.0, 0.8, 50.0, 6.0, 6.0), (120.0, 1.3, 50.0, -6.0, 0.0), (120.0, 1.0, 81.0, 0.0, 0.0), (120.0, 1.0, 19.0, 0.0, 0.0), (120.0, 1.0, 50.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "s double, r double, l double, a double, b double")
    got = [r[0] for r in df.select(labels.cluster_label(*(F.col(c) for c in "srlab"))).collect()]
    assert got == ["Burst / Moment", "Event", "Portraits", "Landscapes", "Bright Scenes", "Dark Scenes", "Visual Harmony"]
    assert labels.config_forces(BENCHMARK, 0) == (33.3, 33.3, 33.3)
    assert sum(labels.config_forces(GroupConfig(), 5)) == pytest.approx(100)


def test_champions(spark):
    rows = [("two", 1, 5), ("two", 2, 3), ("one", 3, 1), ("four", 4, None), ("four", 5, 1), ("four", 6, 1), ("four", 7, 9)]
    made = catalog.champions(spark.createDataFrame(rows, "folder string, file_id long, modified long"), "folder", ["modified", "file_id"]).collect()
    assert {(r[0], r[1]): r[2] for r in made} == {("two", "oldest"): 2, ("two", "newest"): 1, ("two", "median"): 1, ("one", "oldest"): 3, ("one", "newest"): 3, ("one", "median"): 3, ("four", "oldest"): 4, ("four", "newest"): 7, ("four", "median"): 6}


def test_upsert_keeps_the_first_id(spark):
    rows = [(1, "a", 10, 1, "x"), (2, "b", 20, 2, None), (3, "a", 30, 3, "")]
    made = catalog.upsert_latest(spark.createDataFrame(rows, "id long, path string, size long, seq long, phash string"), "path", "seq", "id").collect()
    assert sorted((r["id"], r["path"], r["size"], r["phash"]) for r in made) == [(1, "a", 30, ""), (2, "b", 20, None)]


def test_positions_order_everything(spark):
    values = [random.Random(1).randint(0, 10**6) for _ in range(500)]
    made = positions(spark.createDataFrame([(v,) for v in values], "v long").repartition(7), ["v"]).collect()
    assert [r["v"] for r in sorted(made, key=lambda r: r["position"])] == sorted(values)
    assert sorted(r["position"] for r in made) == list(range(500))


# Statistics, tuning, clustering against plain versions


def plain_features(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        c = rng.choice([0, 3, 9])
        lab = [50 + 4 * c + rng.gauss(0, 1), c + rng.gauss(0, 1), -c + rng.gauss(0, 1)]
        out.append((i, c, f"d/img_{i}.jpg", 1000.0 * c + rng.gauss(0, 50), *lab, 1 + c / 10, rng.choice([None, rng.getrandbits(62)]), [lab, [1.0, 2.0, 3.0]][: rng.randint(0, 2)]))
    return out


def plain_distance(x, y, z, cfg):
    zx, zy = z[x[0]], z[y[0]]
    d = math.sqrt(sum(w * (p - q) ** 2 for w, p, q in zip(cfg.weights, zx, zy)))
    if x[8] is not None and y[8] is not None:
        d += (x[8] ^ y[8]).bit_count() / 64 * cfg.phash_weight
    pal = 1.0 if not x[9] or not y[9] else sum(math.dist(p, q) for p, q in zip(x[9], y[9])) / len(x[9]) / 100
    return d + pal * cfg.palette_weight


def scores(rows):
    v = np.array([r[3:8] for r in rows])
    std = np.maximum(v.std(axis=0), 1e-9) if len(v) > 1 else np.ones(5)
    return {r[0]: z for r, z in zip(rows, ((v - v.mean(axis=0)) / std).tolist())}


def test_silhouette_and_tuning(spark, monkeypatch):
    from fotolith.operators import pairs

    monkeypatch.setattr(pairs, "BLOCK", 16)
    monkeypatch.setattr(tune, "BLOCK", 8)
    rows, cfg = plain_features(60, 2), GroupConfig(eps=0.6, min_samples=4)
    z, df = scores(rows), spark.createDataFrame(rows, FEATURE)
    kd, total = [], 0.0
    for x in rows:
        kd.append(sorted(plain_distance(x, y, z, cfg) for y in rows if y is not x)[3])
        by = {}
        for y in rows:
            if y is not x:
                by.setdefault(y[1], []).append(plain_distance(x, y, z, cfg))
        a = sum(by.get(x[1], [0])) / len(by.get(x[1], [0]))
        b = min((sum(v) / len(v) for c, v in by.items() if c != x[1]), default=0)
        total += (b - a) / max(a, b) if max(a, b) else 0
    got = silhouette.silhouette(df, cfg, "label").first()
    assert got["n"] == 60 and got["silhouette"] == pytest.approx(total / 60)
    made = {r["id"]: r["k_distance"] for r in tune.k_distances(df, cfg).collect()}
    assert [made[r[0]] for r in rows] == pytest.approx(kd)
    curve = sorted(kd)
    chord = [abs((curve[-1] - curve[0]) * i - (len(curve) - 1) * (y - curve[0])) for i, y in enumerate(curve)]
    assert tune.auto_tune(df, cfg).first()[0] == pytest.approx(curve[int(np.argmax(chord))])
    with pytest.raises(ValueError):
        tune.auto_tune(df.limit(4), cfg)


def test_silhouette_of_few_rows(spark):
    rows = plain_features(3, 1)
    df = spark.createDataFrame(rows, FEATURE)
    assert silhouette.silhouette(df.withColumn("c", F.lit(1)), BENCHMARK, "c").first()["silhouette"] == -1.0
    assert silhouette.silhouette(df.limit(1).withColumn("c", F.lit(1)), BENCHMARK, "c").first()["silhouette"] == 0.0


def plain_dbscan(rows, cfg):
    z = scores(rows)
    near = {r[0]: [q[0] for q in rows if math.dist(z[r[0]], z[q[0]]) <= cfg.eps] for r in rows}
    core = {i for i, n in near.items() if len(n) >= cfg.min_samples}
    label = {}
    for i in sorted(core):
        if i in label:
            continue
        todo = [i]
        while todo:
            j = todo.pop()
            if label.setdefault(j, i) == i:
                todo += [k for k in near[j] if k in core and k not in label]
    for i in near:
        if i not in core and (own := [label[k] for k in near[i] if k in core]):
            label[i] = min(own)
    order = {r: k + 1 for k, r in enumerate(sorted(set(label.values())))}
    return {i: order[label[i]] if i in label else 0 for i in near}


@pytest.mark.parametrize(("eps", "block", "one"), [(0.3, 16, True), (0.8, 16, True), (9.0, 16, True), (0.3, 1024, True), (0.8, 1024, False), (0.8, 16, False)])
def test_dbscan(spark, monkeypatch, eps, block, one):
    monkeypatch.setattr(dbscan, "BLOCK", block)
    if not one:  # links that do not fit one task go by rounds
        monkeypatch.setattr(dbscan, "ONE_TASK", 2)
    rows, cfg = plain_features(80, 3), GroupConfig(eps=eps, min_samples=4)
    made = dbscan.dbscan(spark.createDataFrame(rows, FEATURE), cfg, one_task=one).collect()
    assert {r["id"]: r["cluster"] for r in made} == plain_dbscan(rows, cfg)


def test_links_of_two_blocks_span_their_components():
    rng = random.Random(4)
    for _ in range(200):
        n, m = rng.randint(1, 12), rng.randint(1, 12)
        rows, others = rng.sample(range(100), n), rng.sample(range(100, 200), m)
        within = np.array([[rng.random() < 0.2 for _ in others] for _ in rows])
        edges = {(a, b) for i, a in enumerate(rows) for j, b in enumerate(others) if within[i, j]}
        made, left, right = dbscan.forest(np.array(rows), np.array(others), within)
        links = set(map(tuple, made.tolist()))

        def parts(pairs):
            group = {x: {x} for x in range(200)}
            for a, b in pairs:
                joined = group[a] | group[b]
                for x in joined:
                    group[x] = joined
            return {frozenset(g) for g in group.values()}

        assert parts(links) == parts(edges)
        least = {x: min(g) for g in parts(edges) for x in g}
        assert [*left, *right] == [least[x] for x in [*rows, *others]]


def test_balanced_blocks_and_their_pairs(spark):
    """Cells are about equal, many equal rows are dealt to several blocks, and every pair of near rows lies in a pair of blocks."""
    rng = random.Random(8)
    points = [(i, [rng.gauss(0, 1) ** 3 for _ in range(5)]) for i in range(1500)] + [(1500 + i, [0.5] * 5) for i in range(300)]
    rows = spark.createDataFrame(points, "id long, v array<double>")
    tree = space.plant(rows, 64)
    made = space.blocks(rows, tree, 64, {})
    held = {r["block"]: np.frombuffer(r["ids"], np.int64).tolist() for r in made.collect()}
    assert sorted(i for own in held.values() for i in own) == list(range(1800))
    assert max(map(len, held.values())) <= 3 * 64
    home = {i: b for b, own in held.items() for i in own}
    found = {(r["a"], r["b"]) for r in space.pairs(made, tree, 0.4).collect()}
    v = np.array([p for _, p in points])
    near = np.argwhere(((v[:, None, :] - v[None, :, :]) ** 2).sum(axis=2) <= 0.16)
    assert {tuple(sorted((home[i], home[j]))) for i, j in near.tolist()} <= found
    n = len(held)
    assert len(found) < n * (n + 1) / 2 * 0.6


def test_nearest_rows_skip_blocks_and_lose_nothing(spark, monkeypatch):
    """Also where the distance is no metric: some rows without hash, palettes of several sizes."""
    monkeypatch.setattr(tune, "BLOCK", 16)
    cfg = GroupConfig(weight_time=1, weight_color=1, weight_name=0, eps=0.6, min_samples=3)
    for odd in (False, True):
        rows = plain_features(400, 7)
        if odd:
            rows = [(*r[:8], None if r[0] % 5 == 0 else r[8], r[9][: r[0] % 3]) for r in rows]
        z = scores(rows)
        made, found = tune.near_blocks(spark.createDataFrame(rows, FEATURE), cfg)
        n = made.count()
        assert found.count() < 0.8 * n * (n + 1) / 2
        got = {r["id"]: r["k_distance"] for r in tune.k_distances(spark.createDataFrame(rows, FEATURE), cfg).collect()}
        want = [sorted(plain_distance(x, y, z, cfg) for y in rows if y is not x)[2] for x in rows]
        assert [got[r[0]] for r in rows] == pytest.approx(want)


@pytest.mark.parametrize("block", [3, 1024])
def test_dbscan_of_equal_points(spark, monkeypatch, block):
    monkeypatch.setattr(dbscan, "BLOCK", block)
    rows = [(i, 0, "p", 1.0, 0.0, 0.0, 0.0, 1.0, None, []) for i in range(10)]
    assert {r["cluster"] for r in dbscan.dbscan(spark.createDataFrame(rows, FEATURE), GroupConfig(eps=0.5, min_samples=3)).collect()} == {1}


@pytest.mark.parametrize("few", [True, False])
def test_nearest_centroids(spark, monkeypatch, few):
    """Ties go to the least cluster; beyond the broadcast the blocks give the same."""
    if not few:
        monkeypatch.setattr(assign, "BROADCAST_CENTROIDS", 3)
        monkeypatch.setattr(assign, "BLOCK", 4)
        monkeypatch.setattr(assign, "AT_ONCE", 7)
    rows, cfg = plain_features(70, 9), GroupConfig(eps=0.6)
    rows = [(*r[:8], None if r[0] % 5 == 0 else r[8], r[9]) for r in rows]
    held = [(50 - k, *r[3:]) for k, r in enumerate(rows[:9])] + [(99, *rows[3][3:])]
    centroids = spark.createDataFrame(held, "cluster long, time double, l double, a double, b double, aspect_ratio double, phash_bits long, dominant_colors array<array<double>>")
    df = spark.createDataFrame(rows, FEATURE)
    v = np.array([r[3:8] for r in rows])
    scaled = lambda x: ((np.array(x) - v.mean(axis=0)) / np.maximum(v.std(axis=0), 1e-9)).tolist()
    got = {r["id"]: (r["cluster"], r["distance"]) for r in assign.assign(df, centroids, cfg).collect()}
    for r in rows:
        z = {"r": scaled(r[3:8]), **{c[0]: scaled(c[1:6]) for c in held}}
        best = min((plain_distance(("r", *r[1:]), (c[0], 0, "", *c[1:]), z, cfg), c[0]) for c in held)
        assert got[r[0]] == (best[1], pytest.approx(best[0]))
    assert assign.assign(df, centroids.limit(0), cfg).collect() == []


def plain_leader(rows, cfg, floor):
    seen, clusters, into, out, next_id = [], [], {}, [], 1
    for r in rows:
        seen.append(r[3:8])
        v = np.array(seen)
        mean, std = v.mean(axis=0), (np.maximum(v.std(axis=0), max(floor, 1e-9)) if len(v) > 1 else np.ones(5))

        def gap(p, q):
            z = {0: ((np.array(p[0]) - mean) / std).tolist(), 1: ((np.array(q[0]) - mean) / std).tolist()}
            return plain_distance((0, *[None] * 7, p[1], p[2]), (1, *[None] * 7, q[1], q[2]), z, cfg)

        side = lambda c: (np.array(c["sum"]) / c["n"], c["h"], c["p"])
        me = (r[3:8], r[8], r[9])
        d = [gap(me, side(c)) for c in clusters]
        if d and min(d) <= cfg.eps:
            home = clusters[d.index(min(d))]
            home["sum"] = np.array(home["sum"]) + r[3:8]
            home["n"] += 1
            out.append(home["id"])
            for other in clusters:
                if other is not home and gap(side(home), side(other)) <= 1.2 * cfg.eps:
                    home["sum"], home["n"] = home["sum"] + np.array(other["sum"]), home["n"] + other["n"]
                    into[other["id"]] = home["id"]
                    clusters.remove(other)
                    break
        else:
            clusters.append({"id": next_id, "sum": np.array(r[3:8]), "n": 1, "h": r[8], "p": r[9]})
            out.append(next_id)
            next_id += 1

    def last(c):
        while c in into:
            c = into[c]
        return c

    return [last(c) for c in out]


@pytest.mark.parametrize("champions", [False, True])
def test_leader(spark, champions):
    cfg = GroupConfig(weight_time=1, weight_color=1, weight_name=0, eps=1.0, std_floor=0.0)
    rows = plain_features(70, 4)
    df = spark.createDataFrame(rows, FEATURE).withColumn("folder", F.lit("f"))
    made = (leader.champion if champions else leader.naive)(df, cfg, "folder", ["time", "id"]).collect()
    order = sorted(rows, key=lambda r: (r[3], r[0]))
    if champions:
        picks = [order[0], order[-1], order[len(order) // 2]]
        order = picks + [r for r in order if r not in picks]
    want = plain_leader(order, cfg, 0.1 if champions else 0.0)
    assert [r["cluster"] for r in sorted(made, key=lambda r: r["seq"])] == want
    sizes = leader.summaries(df.drop("label"), leader.naive(df, cfg, "folder", ["time", "id"]), "folder")
    assert sizes.agg(F.sum("n")).first()[0] == 70


def test_published_cluster_counts(spark):
    """Counts of the published benchmark: naive leader clusters and DBSCAN."""
    for name, naive, scan in (("Burst", 28, 1), ("Timeline", 52, 2)):
        data = datagen.dataset(spark, name)
        algorithms = reports.benchmark_algorithms()
        assert algorithms["Batch DBSCAN"](data, BENCHMARK).agg(F.max("cluster")).first()[0] == scan
        assert algorithms["Naive Streaming Leader"](data, BENCHMARK).select("cluster").distinct().count() == naive
    assert stats.heterogeneity(datagen.dataset(spark, "Burst")).first()[0] == pytest.approx(0.0202, abs=5e-5)
    assert stats.heterogeneity(datagen.dataset(spark, "Chaos")).first()[0] == pytest.approx(1.2757, abs=5e-5)


def test_shared_folder_is_needed_off_one_machine():
    conf = {"spark.checkpoint.dir": None}
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf[k]), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(cluster)
    conf["spark.checkpoint.dir"] = "hdfs://x/y/"
    assert session.shared_folder(cluster) == "hdfs://x/y"


def test_leader_of_null_and_many_folders(spark):
    rows = plain_features(60, 5)
    df = spark.createDataFrame(rows, FEATURE).withColumn("folder", F.when(F.col("id") % 3 > 0, F.concat(F.lit("f"), (F.col("id") % 3).cast("string"))))
    made = leader.naive(df, BENCHMARK, "folder", ["time", "id"]).collect()
    for name in (None, "f1", "f2"):
        own = leader.naive(df.where(F.col("folder").eqNullSafe(F.lit(name))).withColumn("folder", F.lit("one")), BENCHMARK, "folder", ["time", "id"]).collect()
        assert sorted((r["id"], r["seq"], r["cluster"]) for r in made if r["folder"] == name) == sorted((r["id"], r["seq"], r["cluster"]) for r in own)


# Plans, sources, images, reports


def test_plans(spark):
    rows = [("d/a.jpg", 1), ("d/b.jpg", 1), ("d/c.jpg", 1), ("d/e.jpg", 1), ("d/f.jpg", 2), ("d/g.jpg", 2), ("d/h.jpg", 2)] + [(f"z{i}.png", 0) for i in range(4)]
    made = {r["src"]: r["dest"] for r in moves.theme_moves(spark.createDataFrame(rows, "path string, cluster long")).collect()}
    assert made["d/a.jpg"] == "d/Theme_1/a.jpg" and "d/f.jpg" not in made and made["z0.png"] == "Uncategorized/z0.png"
    dropped = spark.createDataFrame([("d/a.jpg", "e"), ("d/b.jpg", "d"), ("d/", "e"), ("d/c.jpg", "e")], "path string, target string")
    assert [tuple(r) for r in moves.drops(dropped, spark.createDataFrame([("e/c.jpg",)], "path string")).collect()] == [("d/a.jpg", "e/a.jpg")]


def test_lenient_settings(spark):
    good, bad = config.dump_favorites([("x", "C:\\a")]), '{"favorites":[{"name":"y","path":"C:\\Users\\me"}]}'
    made = config.favorites(spark.createDataFrame([(good,), (bad,), ("nonsense",), (None,)], "text string")).collect()
    assert sorted(tuple(r) for r in made) == [("x", "C:\\a"), ("y", "C:\\Users\\me")]


def png(path, pixels):
    height, width = len(pixels), len(pixels[0])
    raw = b"".join(b"\0" + bytes(v for p in row for v in p) for row in pixels)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_images(spark, tmp_path):
    folder = tmp_path / "pics"
    (folder / "sub").mkdir(parents=True)
    png(folder / "white.png", [[(255, 255, 255)] * 6] * 3)
    png(folder / "dot.PNG", [[(255, 0, 0)]])
    (folder / "broken.jpg").write_bytes(b"no image")
    (folder / "note.txt").write_text("x")
    files = listing.list_files(spark, str(folder))
    assert sorted(r["name"] for r in files.collect()) == ["broken.jpg", "dot.PNG", "white.png"]
    assert listing.list_files(spark, str(tmp_path / "gone")).count() == 0
    assert [r["name"] for r in listing.list_directories(spark, str(folder)).collect()] == ["sub"]
    whole = listing.with_parent(files.unionByName(listing.list_directories(spark, str(folder))), str(folder))
    assert [r["name"] for r in listing.shown(whole).collect()] == ["..", "sub", "broken.jpg", "dot.PNG", "white.png"]
    images = listing.read_images(spark, str(folder)).where("path like '%.png' or path like '%.PNG' or path like '%.jpg'")
    made = {r["path"].rsplit("/", 1)[1]: r for r in features.extract(images).collect()}
    assert made["white.png"]["aspect_ratio"] == 2.0 and made["white.png"]["l"] == pytest.approx(100, abs=0.1)
    assert made["dot.PNG"]["l"] == pytest.approx(53.24, abs=0.1) and made["dot.PNG"]["a"] == pytest.approx(80.1, abs=0.3)
    assert made["broken.jpg"]["phash"] is None and made["broken.jpg"]["dominant_colors"] == [[0.0] * 3] * 8
    turned = {r["path"].rsplit("/", 1)[1]: (r["height"], r["width"]) for r in features.transform(images, "rotate_90").collect()}
    assert turned == {"white.png": (6, 3), "dot.PNG": (1, 1)}
    small = {r["path"].rsplit("/", 1)[1]: (r["height"], r["width"], r["size"]) for r in features.thumbnails(images, 2).collect()}
    assert small["white.png"] == (1, 2, 2)
    meta = {r["name"]: r for r in listing.metadata(files, images).collect()}
    assert meta["white.png"]["dimensions"].asDict() == {"width": 6, "height": 3} and meta["broken.jpg"]["dimensions"] is None and meta["dot.PNG"]["format"] == "PNG"
    with pytest.raises(ValueError):
        features.transform(images, "rotate_45")


def test_turns_and_palettes():
    x = np.arange(6).reshape(2, 3, 1)
    assert features.TRANSFORMS["rotate_90"](x)[:, :, 0].tolist() == [[3, 0], [4, 1], [5, 2]]
    assert features.TRANSFORMS["rotate_270"](x)[:, :, 0].tolist() == [[2, 5], [1, 4], [0, 3]]
    assert features.TRANSFORMS["flip_horizontal"](x)[:, :, 0].tolist() == [[2, 1, 0], [5, 4, 3]]
    lab = features.palette(np.repeat([[10.0, 0, 0], [90.0, 0, 0]], 50, axis=0))
    assert (np.diff(lab[:, 0]) >= 0).all() and set(lab[:, 0]) == {10.0, 90.0}
    assert features.palette(np.zeros((0, 3))).tolist() == [[0.0] * 3] * 8


def test_reports(spark, tmp_path):
    report = reports.benchmark(spark, names=("Burst",))
    assert report.count() == 3
    text = reports.as_markdown(report)
    assert text.count("\n") == 5 and "Batch DBSCAN" in text
    assert {r["Algorithm"]: r["Peak Mem (MB)"] for r in json.loads(reports.as_json(report))}["Batch DBSCAN"] == 0.313
    reports.write_csv(report, f"{tmp_path}/csv")
    assert spark.read.option("header", "true").csv(f"{tmp_path}/csv").count() == 3
    assert len(reports.study(report).columns) == 5


def test_adapters(spark, sf):
    assert adapters.image_features(spark, sf).select(*DIMENSIONS).where("time is null").count() == 0
    assert adapters.files(spark, sf).count() == 200


def test_catalogue_tables(spark):
    store.create(spark, "photos")
    store.create(spark, "photos")
    spark.createDataFrame([(1, "a.jpg", 5, 0, "{}", None), (2, "b.jpg", 5, 0, "{}", "h")], store.TABLES["images"]).write.insertInto("photos.images")
    collections = spark.createDataFrame([(7, "trip", -5)], store.TABLES["virtual_collections"])
    with pytest.raises(ValueError):
        store.store_collections(spark, "photos", collections, spark.createDataFrame([(7, "a.jpg"), (7, "z.jpg")], "collection_id long, path string"))
    assert spark.table("photos.collection_members").count() == 0
    store.store_collections(spark, "photos", collections, spark.createDataFrame([(7, "a.jpg"), (7, "b.jpg")], "collection_id long, path string"))
    assert sorted(tuple(r) for r in spark.table("photos.collection_members").collect()) == [(7, 1), (7, 2)]
    assert spark.table("photos.virtual_collections").first()["created_at"] == 0
    # A store that broke off between its two tables: not seen until it is stored again, and then once.
    broken = spark.createDataFrame([(8, 1)], store.TABLES["collection_members"])
    broken.write.insertInto("photos.collection_members")
    assert store.whole_collections(spark, "photos").where("collection_id = 8").count() == 0
    for _ in range(2):
        store.store_collections(spark, "photos", spark.createDataFrame([(8, "walk", 3)], store.TABLES["virtual_collections"]), spark.createDataFrame([(8, "a.jpg"), (8, "b.jpg")], "collection_id long, path string"))
    assert sorted(tuple(r) for r in store.whole_collections(spark, "photos").where("collection_id = 8").collect()) == [(8, "walk", 1), (8, "walk", 2)]
