"""Sources over real folders: listings, metadata, decoded images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fotolith.functions.names import extension, file_name, is_supported, parent
from fotolith.schema import FILE_INFO
from fotolith.sources import folders

_LISTED = "path string, modificationTime timestamp, length long"


def list_files(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """Supported files of a folder as ``FILE_INFO``; contents are not read.

    An unreadable or missing folder has no rows.
    """
    try:
        rows = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(f"{folder}/*" if not recursive else folder)
    except Exception as error:  # the path does not exist or holds nothing
        if "PATH_NOT_FOUND" not in str(error):
            raise
        rows = spark.createDataFrame([], _LISTED)
    name = file_name(F.col("path"))
    found = rows.select("path", name.alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return found.where(is_supported(F.col("name"))).select(
        "path", "name", "size", F.lit(None).cast("struct<width:int,height:int>").alias("dimensions"), "modified", F.lit(False).alias("is_dir"), F.lit(None).cast("string").alias("phash")
    )


def list_directories(spark: SparkSession, folder: str) -> DataFrame:
    """Direct subfolders of a folder as ``FILE_INFO`` (size 0), listed by a task."""
    found = folders.scan(spark, folder, kind="folders")
    return found.select(
        "path", "name", "size", F.lit(None).cast("struct<width:int,height:int>").alias("dimensions"), "modified", "is_dir", F.lit(None).cast("string").alias("phash")
    ).orderBy("path")


def with_parent(listing: DataFrame, folder: str) -> DataFrame:
    """The listing with the row ``..`` where the folder has a parent."""
    above = folder.rstrip("/").rpartition("/")[0]
    if not above:
        return listing
    spark = listing.sparkSession
    row = spark.createDataFrame([(above, "..", 0, None, None, True, None)], FILE_INFO)
    return row.withColumn("modified", F.current_timestamp()).unionByName(listing)


def shown(listing: DataFrame) -> DataFrame:
    """Folders first (the parent before all), then by name without case; ties by path."""
    return listing.orderBy(F.col("name") != "..", F.desc("is_dir"), F.lower("name"), "path")


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """``path, height, width, channels, data`` of decodable images; null pixels where decoding fails."""
    rows = spark.read.format("image").option("dropInvalid", "false").load(folder)
    ok = F.col("image.width") > 0
    return rows.select(
        F.regexp_replace("image.origin", "^file:/+", "file:/").alias("path"), F.when(ok, F.col("image.height")).alias("height"), F.when(ok, F.col("image.width")).alias("width"),
        F.when(ok, F.col("image.nChannels")).alias("channels"), F.when(ok, F.col("image.data")).alias("data"),
    )


def metadata(files: DataFrame, images: DataFrame) -> DataFrame:
    """``IMAGE_METADATA``: files with dimensions where the image could be decoded, format by extension."""
    sizes = images.select(F.col("path"), F.struct(F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height")).alias("size_px"), "width")
    sizes = sizes.select("path", F.when(F.col("width").isNotNull(), F.col("size_px")).alias("dimensions"))
    return files.drop("dimensions").join(sizes, "path", "left").select(
        "name", "path", "dimensions", F.col("size").alias("size_bytes"), F.coalesce("modified", F.current_timestamp()).alias("modified"), F.upper(extension(F.col("name"))).alias("format")
    )


def folders_of(files: DataFrame) -> DataFrame:
    """Distinct parents of paths, in byte order."""
    return files.select(parent(F.col("path")).alias("folder")).distinct().orderBy("folder")
