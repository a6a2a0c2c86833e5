"""Distances in tiles, and what is added up from them."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from fotolith.functions import distance
from fotolith.operators import pairs, space, stats, tune
from fotolith.schema import GroupConfig


def some_features(n, seed, even):
    rng = random.Random(seed)
    sizes = [2] * n if even else [rng.randint(0, 3) for _ in range(n)]
    vectors = np.array([[rng.gauss(0, 1) for _ in range(5)] for _ in range(n)])
    vectors[1::7] = vectors[0]  # equal rows, and rows that are nearly equal
    vectors[2::7] = vectors[0] + 1e-9
    hashes = [rng.getrandbits(62) if even or rng.random() < 0.7 else None for _ in range(n)]
    return distance.Features(vectors, hashes, [[[rng.gauss(50, 30) for _ in range(3)] for _ in range(k)] for k in sizes])


@pytest.mark.parametrize("even", [True, False])
def test_tiles_are_the_kernel_both_ways(monkeypatch, even):
    monkeypatch.setattr(distance, "TILE", 200)
    x, y, cfg = some_features(60, 1, even), some_features(45, 1, even), GroupConfig()
    there, back = distance.kernel(x, y, cfg), distance.kernel(y, x, cfg).T
    seen = 0
    for at, d, turned in distance.tiles(x, y, cfg):
        assert np.allclose(d, there[at], rtol=1e-9, atol=1e-12) and np.allclose(turned, back[at], rtol=1e-9, atol=1e-12)
        seen += len(d)
    assert seen == 60


def test_sums_by_cluster_go_out_as_vectors(spark, monkeypatch):
    """Every row has its sum to every cluster, whatever the blocks; clusters lie over the ends of blocks."""
    monkeypatch.setattr(pairs, "BLOCK", 7)
    monkeypatch.setattr(pairs, "CHUNK_BYTES", 64)
    rng = random.Random(4)
    rows = [(i, rng.choice([0, 3, 9]), *(rng.gauss(0, 1) for _ in range(5)), rng.getrandbits(62), [[rng.gauss(50, 9) for _ in range(3)]]) for i in range(40)]
    frame = spark.createDataFrame(rows, "id long, cluster long, time double, l double, a double, b double, aspect_ratio double, phash_bits long, dominant_colors array<array<double>>")
    cfg = GroupConfig()
    got = {(r["id"], r["own"], r["cluster"]): r["total"] for r in pairs.cluster_sums(stats.normalised(frame), cfg).collect()}
    v = np.array([r[2:7] for r in rows])
    every = distance.Features((v - v.mean(axis=0)) / v.std(axis=0), [r[7] for r in rows], [r[8] for r in rows])
    d = distance.kernel(every, every, cfg)
    cluster = np.array([r[1] for r in rows])
    want = {(i, int(cluster[i]), c): d[i, cluster == c].sum() for i in range(40) for c in (0, 3, 9)}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


@pytest.mark.parametrize("even", [True, False])
def test_rows_within_a_bound_are_those_of_the_kernel(monkeypatch, even):
    """Rows of no other kind come after the Euclidean part, and a row never meets itself."""
    monkeypatch.setattr(tune, "PAIRS", 200)
    x, y, cfg = some_features(60, 3, even), some_features(45, 3, even), GroupConfig(weight_time=1, weight_color=1)
    plain = GroupConfig(weight_time=1, weight_color=1)
    for f in (x, y):
        f.vectors = f.vectors * np.sqrt(np.array(cfg.weights))
    d = distance.kernel(x, y, plain, weighted=True)
    bound = np.sort(d, axis=1)[:, 4]
    bound[3], who, ids = np.inf, np.arange(60), np.arange(45) + 20
    i, got = tune._within(x, y, bound, who, ids, cfg)
    want = (d <= bound[:, None]) & (who[:, None] != ids[None, :])
    for row in range(60):
        assert sorted(got[i == row]) == pytest.approx(sorted(d[row, want[row]]))


def test_equal_rows_and_rows_apart_find_their_nearest(spark, monkeypatch):
    """Blocks of equal rows, which look no further, and rows that look into other blocks; fewer rows than are asked for give none."""
    monkeypatch.setattr(tune, "BLOCK", 8)
    rng, shape = random.Random(6), "id long, time double, l double, a double, b double, aspect_ratio double, phash_bits long, dominant_colors array<array<double>>"
    rows = [(i, *([0.5] * 5 if i < 40 else [rng.gauss(0, 3) for _ in range(5)]), 7, [[1.0, 2.0, 3.0]]) for i in range(120)]
    v, cfg = np.array([r[1:6] for r in rows]), GroupConfig(min_samples=3)
    every = distance.Features((v - v.mean(axis=0)) / v.std(axis=0), [r[6] for r in rows], [r[7] for r in rows])
    d = distance.kernel(every, every, cfg)
    np.fill_diagonal(d, np.inf)
    got = {r["id"]: r["k_distance"] for r in tune.k_distances(spark.createDataFrame(rows, shape), cfg).collect()}
    assert [got[i] for i in range(120)] == pytest.approx(np.sort(d, axis=1)[:, 2].tolist(), abs=1e-9)
    assert tune.k_distances(spark.createDataFrame(rows[:3], shape), cfg).count() == 0


def test_features_are_made_once(spark):
    """What makes the features runs once, not again for each step that reads them."""
    seen, rng = spark.sparkContext.accumulator(0), random.Random(9)
    shape = "id long, time double, l double, a double, b double, aspect_ratio double, phash_bits long, dominant_colors array<array<double>>"
    rows = [(i, *(rng.gauss(0, 1) for _ in range(5)), rng.getrandbits(62), [[rng.gauss(50, 9) for _ in range(3)]]) for i in range(60)]

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    made = spark.createDataFrame(rows, shape).mapInArrow(count, shape)
    assert tune.auto_tune(made, GroupConfig(min_samples=3)).first()[0] > 0
    assert seen.value == 60
    assert tune.k_distances(made, GroupConfig(min_samples=3)).count() == 60
    assert seen.value == 120


def test_cells_grow_with_the_input(spark):
    """A cell holds about as many rows where there are more than 4096 cells; the sample that is cut stays bounded."""
    rows = spark.range(20_000).selectExpr("id", "array(rand(1), rand(2), rand(3), rand(4), rand(5)) AS v").toArrow()
    v = np.array(rows.column("v").to_pylist())
    tree = space.plant(spark.createDataFrame(rows), 2)
    assert np.bincount(tree.cells(v)).max() <= 2
    assert tree.depth == 14 and space.MAX_SAMPLE <= 1 << 18


@pytest.mark.parametrize("few", [0, 512])
def test_pairs_are_dealt_to_tasks_by_their_number(spark, monkeypatch, few):
    monkeypatch.setattr(space, "PAIRS_A_TASK", 4)
    monkeypatch.setattr(space, "FEW", few)
    made = spark.createDataFrame([(k, 1, b"x" * k) for k in range(9)], "block long, n long, v binary")
    found = spark.createDataFrame([(a, b) for a in range(9) for b in range(a, 9)], "a long, b long").coalesce(1)
    run = lambda row: iter([pa.RecordBatch.from_pydict({"a": [len(row["v"])], "b": [len(row["other_v"])]})])
    out = space.over_pairs(found, made, ["n", "v"], run, "a long, b long")
    assert out.rdd.getNumPartitions() == 12
    assert sorted(tuple(r) for r in out.collect()) == [(a, b) for a in range(9) for b in range(a, 9)]
