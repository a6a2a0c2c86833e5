"""Catalogue frames derived from general tables, for queries without image files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fotolith.session import read_table

#: Extensions dealt to documents by id: the nine supported ones in mixed case, and three others.
EXTENSIONS = ("jpg", "JPEG", "png", "WebP", "gif", "BMP", "tiff", "TIF", "avif", "txt", "mp4", "pdf")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``file_id, folder, name, path, size, modified, is_dir, phash``: each document as a file of its source's folder."""
    docs = read_table(spark, sf_dir, "documents")
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("doc_id") % len(EXTENSIONS) + 1).cast("int"))
    name = F.concat(F.lit("IMG_"), F.col("doc_id").cast("string"), F.lit("."), ext)
    return docs.select(
        F.col("doc_id").alias("file_id"), F.col("source").alias("folder"), name.alias("name"), F.concat("source", F.lit("/"), name).alias("path"),
        F.col("n_chars").alias("size"), (F.lit(1_700_000_000) + F.col("doc_id") * 7919 % 100_000).alias("modified"), F.lit(False).alias("is_dir"),
        F.md5("text").alias("phash"),
    )


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, path, size``: parts as catalogued images; parts of a size over 45 are not in the catalogue."""
    part = read_table(spark, sf_dir, "part").where("p_size <= 45")
    return part.select(F.col("p_partkey").alias("id"), F.concat(F.lit("part_"), F.col("p_partkey").cast("string"), F.lit(".jpg")).alias("path"), F.col("p_size").cast("long").alias("size"))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``collection_id, path``: line items as members of their order's collection."""
    item = read_table(spark, sf_dir, "lineitem")
    return item.select(F.col("l_orderkey").alias("collection_id"), F.concat(F.lit("part_"), F.col("l_partkey").cast("string"), F.lit(".jpg")).alias("path")).distinct()


def image_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, label`` and the columns of ``IMAGE_FEATURE``, from embeddings and the events of equal id."""
    e = F.col("embedding")
    at = lambda i: e[i].cast("double")
    palette = F.array_sort(F.array(*(F.array(*(F.lit(100.0) * at(4 + 3 * k + j) for j in range(3))) for k in range(8))))
    bits = F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda s, i: s.bitwiseOR(F.when(e[i] > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))))
    vec, event = read_table(spark, sf_dir, "embeddings"), read_table(spark, sf_dir, "events")
    both = vec.join(event.select("event_id", "ts"), vec.vec_id == event.event_id)
    return both.select(
        F.col("vec_id").alias("id"), "label", F.concat(F.lit("img_"), F.col("vec_id").cast("string"), F.lit(".jpg")).alias("path"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("time"), (F.lit(50.0) + F.lit(100.0) * at(0)).alias("l"),
        (F.lit(100.0) * at(1)).alias("a"), (F.lit(100.0) * at(2)).alias("b"), (F.lit(1.0) + F.lit(2.0) * at(3)).alias("aspect_ratio"),
        bits.alias("phash_bits"), palette.alias("dominant_colors"),
    )
