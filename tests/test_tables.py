"""Folders as a data source, and clustering as a table function of SQL."""

import os

import pytest
from pyspark.sql import functions as F

from fotolith.functions import table as table_function
from fotolith.operators import leader
from fotolith.schema import GroupConfig
from fotolith.sources import folders, listing
from tests.test_catalogue import FEATURE, plain_features


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("tree")
    for i in range(40):
        below = base / f"f{i}" / "deep" / "deeper"
        below.mkdir(parents=True)
        (base / f"f{i}" / "a.JPG").write_bytes(b"x" * i)
        (base / f"f{i}" / "b.txt").write_bytes(b"yy")
        (below.parent / "c.png").write_bytes(b"zzz")
        (below / "d.png").write_bytes(b"")
    (base / "top.jpg").write_bytes(b"t")
    (base / "empty").mkdir()
    return str(base)


def plain(root, depth):
    """What the operating system's own walk finds."""
    found = set()
    for folder, dirs, files in os.walk(root):
        own = os.path.relpath(folder, root).replace(".", "", 1) if folder == root else os.path.relpath(folder, root)
        if (own.count("/") + 1 if own else 0) < depth:
            found |= {(own, d, 0, True) for d in dirs} | {(own, f, os.path.getsize(f"{folder}/{f}"), False) for f in files}
    return found


def rows(df):
    return [(r["folder"], r["name"], r["size"], r["is_dir"]) for r in df.collect()]


@pytest.mark.parametrize("depth", [1, 2, 3, 9])
def test_every_entry_comes_once(spark, root, depth):
    got = rows(folders.scan(spark, root, depth))
    assert len(got) == len(set(got)) and set(got) == plain(root, depth)


def test_conditions_of_a_load(spark, root):
    whole = plain(root, 9)
    scan = lambda **conditions: set(rows(folders.scan(spark, root, 9, **conditions)))
    assert scan(kind="folders") == {r for r in whole if r[3]}
    assert scan(kind="files", ends=".jpg,.png") == {r for r in whole if not r[3] and r[1].lower().endswith((".jpg", ".png"))}
    assert scan(inside="f7") == {r for r in whole if r[0] == "f7" or r[0].startswith("f7/")}
    assert scan(inside="f7/deep", kind="files") == {("f7/deep", "c.png", 3, False), ("f7/deep/deeper", "d.png", 0, False)}
    assert scan(inside="nowhere") == set()
    # Frames with conditions of their own do not meddle with each other.
    found = folders.scan(spark, root, 9)
    both = found.where("is_dir").unionByName(found.where("not is_dir"))
    assert set(rows(both)) == whole and both.count() == len(whole)


def test_folders_that_the_condition_rules_out_are_not_opened(root):
    opened = []

    class Watched(folders.FolderReader):
        def entries(self, store, folder):
            opened.append(os.path.relpath(folder, root))
            return super().entries(store, folder)

    reader = Watched({"path": root, "depth": "9", "inside": "f7/deep", "partitions": "4"})
    found = [r for share in reader.partitions() for batch in reader.read(share) for r in batch.to_pylist()]
    assert {r["name"] for r in found} == {"c.png", "d.png", "deeper"}
    assert sorted(opened) == [".", ".", ".", ".", "f7", "f7/deep", "f7/deep/deeper"]


def test_missing_roots_and_files_are_empty(spark, root):
    assert rows(folders.scan(spark, f"{root}/not-there")) == []
    assert rows(folders.scan(spark, f"{root}/top.jpg")) == []
    assert rows(folders.scan(spark, f"{root}/empty", 3)) == []
    assert [r["name"] for r in listing.list_directories(spark, f"{root}/f1").collect()] == ["deep"]


@pytest.fixture(scope="module")
def features(spark):
    df = spark.createDataFrame(plain_features(60, 5), FEATURE)
    return df.withColumn("folder", F.concat(F.lit("f"), (F.col("id") % 3).cast("string"))).withColumn("more", F.lit(1))


def test_table_function_by_sql(spark, features):
    table_function.register(spark)
    features.createOrReplaceTempView("image_rows")
    made = spark.sql("SELECT * FROM cluster_rows(TABLE(image_rows), eps => 1.0, weight_time => 1, weight_color => 1, weight_name => 0)")
    assert made.columns == ["folder", "id", "cluster"]
    cfg = GroupConfig(weight_time=1, weight_color=1, weight_name=0, eps=1.0)
    want = leader.naive(features, cfg, "folder", ["time", "path"])
    assert {tuple(r) for r in made.collect()} == {tuple(r) for r in want.select("folder", "id", "cluster").collect()}
    hashes = spark.sql("SELECT * FROM cluster_rows(TABLE(image_rows), algorithm => 'hash')").join(features.select("id", "phash_bits"), "id").collect()
    by: dict = {}
    for r in hashes:
        assert (r["cluster"] == 0) == (r["phash_bits"] is None)
        if r["cluster"]:
            assert by.setdefault((r["folder"], r["cluster"]), r["phash_bits"]) == r["phash_bits"]
    assert spark.sql("SELECT * FROM cluster_rows(TABLE(SELECT * FROM image_rows WHERE id < 0))").collect() == []


@pytest.mark.parametrize(
    "text, message",
    [
        ("SELECT * FROM cluster_rows(TABLE(SELECT id, folder FROM image_rows))", "not there"), ("SELECT * FROM cluster_rows(TABLE(image_rows), algorithm => 'other')", "no algorithm other"),
        ("SELECT * FROM cluster_rows(TABLE(image_rows), epsilon => 1)", "no setting epsilon"),
    ],
)
def test_table_function_says_what_is_wrong(spark, features, text, message):
    table_function.register(spark)
    features.createOrReplaceTempView("image_rows")
    with pytest.raises(Exception, match=message):
        spark.sql(text).collect()
