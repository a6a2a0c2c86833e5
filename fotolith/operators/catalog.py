"""Relational operators over a catalogue of files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fotolith.functions.names import is_supported
from fotolith.operators.prefix import places
from fotolith.session import stored


def duplicates(files: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """``group_id, phash, label, n, paths``: files that share a fingerprint.

    ``group_id`` is the least file id of the group, so ids neither need a global
    order nor change as the catalogue grows. With ``current`` (paths of a scan)
    rows whose file is gone do not count. Null and empty fingerprints never match.
    """
    if current is not None:
        files = files.join(current.select("path").distinct(), "path", "left_semi")
    grouped = files.where("phash is not null and phash <> ''").groupBy("phash").agg(
        F.min("file_id").alias("group_id"), F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("path")).alias("paths")
    )
    return grouped.where("n > 1").select("group_id", "phash", F.lit("Exact Duplicates").alias("label"), "n", "paths")


def duplicate_members(files: DataFrame) -> DataFrame:
    """``group_id, file_id, path``: members of all duplicate groups, without building lists.

    For groups of any size: counts are combined on the map side and the join
    splits a fingerprint that many files share.
    """
    known = files.where("phash is not null and phash <> ''")
    groups = known.groupBy("phash").agg(F.min("file_id").alias("group_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return known.join(groups, "phash").select("group_id", "file_id", "path")


def folder_counts(files: DataFrame, folders: DataFrame) -> DataFrame:
    """``folder, n_images``: supported files of each folder; 0 for an empty one."""
    counts = files.where(~F.col("is_dir") & is_supported(F.col("name"))).groupBy("folder").agg(F.count(F.lit(1)).alias("n_images"))
    return folders.select("folder").distinct().join(counts, "folder", "left").select("folder", F.coalesce("n_images", F.lit(0)).alias("n_images"))


def listing(files: DataFrame, subfolders: DataFrame) -> DataFrame:
    """``folder, pos, name, is_dir, size``: each folder's rows as shown, the parent row first.

    Folders come first, then names without case; ties keep the order of paths.
    """
    shown = files.where(F.col("is_dir") | is_supported(F.col("name"))).select("folder", "name", "is_dir", "size", F.lit(0).alias("ord"))
    parent = files.select("folder").distinct().select("folder", F.lit("..").alias("name"), F.lit(True).alias("is_dir"), F.lit(0).cast("long").alias("size"), F.lit(-1).alias("ord"))
    dirs = subfolders.select("folder", "name", F.lit(True).alias("is_dir"), F.lit(0).cast("long").alias("size"), F.lit(0).alias("ord"))
    rows = shown.unionByName(parent).unionByName(dirs).withColumn("_file", ~F.col("is_dir")).withColumn("_low", F.lower("name"))
    return places(rows, "folder", ["ord", "_file", "_low", "name"], "pos").select("folder", F.col("pos").cast("int").alias("pos"), "name", "is_dir", "size")


def upsert_latest(log: DataFrame, key: str, seq: str, id_col: str) -> DataFrame:
    """One row for each key: the values of its last write under the id of its first.

    An aggregation with map-side combination; no sort, no window.
    """
    values = [c for c in log.columns if c not in (key, id_col)]
    last = log.groupBy(key).agg(F.max_by(F.struct(*values), F.struct(seq, id_col)).alias("v"), F.min_by(id_col, F.struct(seq, id_col)).alias(id_col))
    return last.select(id_col, key, *(F.col(f"v.{c}").alias(c) for c in values))


def table_counts(images: DataFrame, collections: DataFrame) -> DataFrame:
    """``total_images, total_collections`` in one row."""
    n = lambda df, kind: df.agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(kind))
    both = n(images, "images").unionByName(n(collections, "collections"))
    return both.agg(*(F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(f"total_{k}") for k in ("images", "collections")))


def resolve_members(members: DataFrame, images: DataFrame) -> DataFrame:
    """``collection_id, image_id``: members found in the catalogue."""
    return members.join(images.select(F.col("id").alias("image_id"), "path"), "path").select("collection_id", "image_id")


def missing_members(members: DataFrame, images: DataFrame) -> DataFrame:
    return members.join(images.select("path"), "path", "left_anti").select("collection_id", "path")


def storable_collections(collections: DataFrame, members: DataFrame, images: DataFrame) -> DataFrame:
    """Collections that can be stored whole: every member is in the catalogue (all or nothing)."""
    return collections.join(missing_members(members, images).select("collection_id").distinct(), "collection_id", "left_anti")


def lookup_hashes(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """``phash, file_id``: at most one file, the least, for each wanted fingerprint."""
    return files.join(wanted.select("phash").distinct(), "phash", "left_semi").groupBy("phash").agg(F.min("file_id").alias("file_id"))


def last_rows(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """The ``n`` latest rows, the newest first (a top-k, so no full sort)."""
    return rows.orderBy(*(F.desc(c) for c in order)).limit(n)


def page(rows: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def neighbours(files: DataFrame) -> DataFrame:
    """``folder, name, previous, next`` among the supported files of a folder, in listing order.

    Places come from a scan in two levels and meet by folder and place, so a large folder is many keys.
    """
    shown = files.where(~F.col("is_dir") & is_supported(F.col("name"))).select("folder", "name").withColumn("_low", F.lower("name"))
    placed = stored(places(shown, "folder", ["_low", "name"]).drop("_low"), "places")

    def beside(step: int, name: str) -> DataFrame:
        return placed.select(F.col("folder").alias(f"_folder{step}"), (F.col("place") + step).alias(f"_place{step}"), F.col("name").alias(name))

    out = placed
    for step, name in ((1, "previous"), (-1, "next")):
        out = out.join(beside(step, name), F.col("folder").eqNullSafe(F.col(f"_folder{step}")) & (F.col("place") == F.col(f"_place{step}")), "left")
    return out.select("folder", "name", "previous", "next")


def champions(files: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``group, pick, file_id``: the first, last and upper median row of each group; null order keys come first."""
    ranked = places(files.select(group, "file_id", *(c for c in order if c != "file_id")), group, order, "_r")
    sizes = ranked.groupBy(F.col(group).alias("_group")).agg(F.max("_r").alias("_n"))
    ranked = ranked.join(sizes, F.col(group).eqNullSafe(F.col("_group")))
    picks = F.array(*(F.struct(F.lit(pick).alias("pick"), at.alias("at")) for pick, at in (("oldest", F.lit(1).cast("long")), ("newest", F.col("_n")), ("median", F.expr("_n div 2 + 1")))))
    return ranked.select(group, "file_id", "_r", F.explode(picks).alias("p")).where("_r = p.at").select(group, "p.pick", "file_id")


def toggle(selected: DataFrame, clicked: DataFrame) -> DataFrame:
    """Selection after a control click: clicked paths change sides."""
    return selected.join(clicked, "path", "left_anti").unionByName(clicked.join(selected, "path", "left_anti")).distinct()


def select_range(listed: DataFrame, first: int, last: int) -> DataFrame:
    """Paths of an inclusive range of positions, without the parent row."""
    low, high = min(first, last), max(first, last)
    return listed.where(F.col("pos").between(low, high) & (F.col("name") != "..")).select("folder", "name")
