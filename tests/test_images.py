"""Images of many shapes at once, and the tasks that they are dealt to."""

from __future__ import annotations

import base64

import numpy as np
import pytest
from pyspark.sql import functions as F

from fotolith import feature_queries
from fotolith.operators import features


def picture(key):
    """The image that ``feature_queries.images`` makes of a part."""
    width = 4 * 2 ** (key % 3)
    made = [(key * (11 + 2 * (i % 3)) + (i // 3) * (29 + 6 * (i % 3)) + (i // 3) * key % (17 + i % 3) * 5) % 256 for i in range(8 * width * 3)]
    return np.array(made, np.uint8).reshape(8, width, 3)


def test_equal_brightness_does_not_fall():
    """Neighbours of the same brightness in colours of their own: part 6565 has such, and a fused product took one for darker."""
    for key in (6565, 7150, 18193):
        x = picture(key)
        at = [min(int((k + 0.5) * x.shape[1] / 9), x.shape[1] - 1) for k in range(9)]
        grey = [[0.299 * float(row[c][2]) + 0.587 * float(row[c][1]) + 0.114 * float(row[c][0]) for c in at] for row in x]
        bits = "".join(str(int(a > b)) for row in grey for a, b in zip(row, row[1:]))
        assert features.described(x[None])[1].tobytes() == int(bits, 2).to_bytes(8, "big")


def test_parts_are_dealt_to_tasks_by_their_number(spark, sf, monkeypatch):
    monkeypatch.setattr(feature_queries, "IMAGES_A_TASK", 64)
    made = feature_queries.images(spark, sf)
    assert made.rdd.getNumPartitions() == -(-made.count() // 64) > 1
    for r in made.limit(20).collect():
        assert bytes(r["data"]) == picture(int(r["path"][5:-4])).tobytes()


def test_images_of_many_shapes(spark, monkeypatch):
    monkeypatch.setattr(features, "CHUNK_BYTES", 3000)
    monkeypatch.setattr(features, "CHUNK_SAMPLES", 100)
    rng, rows = np.random.default_rng(1), [("none", None, None, None, None)]
    for k, shape in enumerate([(1, 1, 3), (3, 50, 3), (40, 5, 1), (9, 9, 4), (33, 64, 3)] * 3):
        rows.append((f"p{k}", *shape, rng.integers(0, 256, shape, np.uint8).tobytes()))
    frame = spark.createDataFrame(rows, "path string, height int, width int, channels int, data binary").coalesce(1)
    made = {r["path"]: r for r in features.extract(frame).collect()}
    assert len(made) == len(rows) and made["none"]["phash"] is None and made["none"]["width"] is None
    for path, h, w, c, data in rows[1:]:
        x = np.frombuffer(data, np.uint8).reshape(h, w, c)
        rgb = np.repeat(x, 3, axis=2) if c == 1 else x[:, :, 2::-1]
        lab = features.to_lab(features.nearest(rgb, 32, 32)).reshape(-1, 3)
        r = made[path]
        assert [r["l"], r["a"], r["b"]] == pytest.approx(lab.mean(axis=0).tolist(), abs=1e-9)
        assert np.allclose(r["dominant_colors"], features.palette(lab), atol=1e-9)
        assert (r["height"], r["width"], r["aspect_ratio"]) == (h, w, w / h)
        assert int.from_bytes(base64.b64decode(r["phash"]), "big", signed=True) == r["phash_bits"]
    turned = {(r["path"], r["turn"]): r for r in features.turns(frame, list(features.TRANSFORMS)).collect()}
    assert len(turned) == 5 * (len(rows) - 1)
    for path, h, w, c, data in rows[1:]:
        for name, change in features.TRANSFORMS.items():
            want, r = change(np.frombuffer(data, np.uint8).reshape(h, w, c)), turned[path, name]
            assert (r["height"], r["width"], r["channels"], bytes(r["data"])) == (*want.shape, want.tobytes())


def test_thumbnails_are_dealt_by_number(spark, sf, monkeypatch):
    """200 parts of one small file are made in four tasks of fifty each, not in one that grows with the file."""
    monkeypatch.setattr(feature_queries, "IMAGES_A_TASK", 50)
    made = feature_queries.image_thumbnails(spark, sf).groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sorted(r["count"] for r in made) == [50, 50, 50, 50]
