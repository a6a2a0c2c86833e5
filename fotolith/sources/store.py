"""The catalogue's tables, and storing collections in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fotolith import schema
from fotolith.operators.catalog import missing_members, resolve_members
from fotolith.session import stored

#: Tables of a catalogue and their columns.
TABLES = {
    "images": schema.IMAGES, "tags": schema.TAGS, "image_tags": schema.IMAGE_TAGS, "virtual_collections": schema.COLLECTIONS,
    "collection_members": schema.COLLECTION_MEMBERS,
}


def create(spark: SparkSession, database: str) -> None:
    """Make the database and its tables where they are missing; again changes nothing."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, columns in TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns.replace('id long', 'id bigint').replace(' long', ' bigint')}) USING parquet")


def store_collections(spark: SparkSession, database: str, collections: DataFrame, members: DataFrame) -> None:
    """Append ``collections(id, name, created_at)`` with their ``members(collection_id, path)``, all or nothing.

    A member that is not among the images is an error, found before anything is
    written. A collection is there once its own row is, which comes last; members
    without one are left of a store that broke off, and storing again completes it without doubling anything.
    """
    images, known, stored_members = (spark.table(f"{database}.{t}") for t in ("images", "virtual_collections", "collection_members"))
    if lost := missing_members(members, images).take(1):
        raise ValueError(f"store_collections: {lost[0]['path']} is not in the catalogue")
    pairs = resolve_members(members, images).distinct().join(stored_members, ["collection_id", "image_id"], "left_anti")
    stored(pairs.select("collection_id", "image_id"), "members").write.insertInto(f"{database}.collection_members")
    rows = collections.select("id", "name", F.greatest("created_at", F.lit(0).cast("long")).alias("created_at")).join(known.select("id"), "id", "left_anti")
    stored(rows, "collections").write.insertInto(f"{database}.virtual_collections")


def whole_collections(spark: SparkSession, database: str) -> DataFrame:
    """``collection_id, name, image_id``: members of the collections that are stored whole."""
    rows = spark.table(f"{database}.virtual_collections").select(F.col("id").alias("collection_id"), "name")
    return rows.join(spark.table(f"{database}.collection_members"), "collection_id")
