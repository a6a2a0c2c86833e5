"""Name and path functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Extensions of supported images.
SUPPORTED = ("jpg", "jpeg", "png", "webp", "gif", "bmp", "tiff", "tif", "avif")


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def parent(path: Column) -> Column:
    """The part before the last slash; null if there is none."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, r"/[^/]*$", ""))


def extension(name: Column) -> Column:
    """The text after the last dot; null without one, or if the only dot leads."""
    found = F.regexp_extract(name, r"^.+\.([^.]*)$", 1)
    return F.when(F.rlike(name, F.lit(r"^.+\.[^.]*$")), found)


def stem(name: Column) -> Column:
    return F.when(F.rlike(name, F.lit(r"^.+\.[^.]*$")), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)


def is_supported(name: Column) -> Column:
    return F.coalesce(F.lower(extension(name)).isin(*SUPPORTED), F.lit(False))


def truncated(name: Column) -> Column:
    return F.when(F.length(name) > 18, F.concat(F.substring(name, 1, 15), F.lit("..."))).otherwise(name)


def size_in_kb(size: Column) -> Column:
    return F.concat(F.floor(size / 1024).cast("long").cast("string"), F.lit(" KB"))


def size_in_mb(size: Column) -> Column:
    return F.format_string("%.2f MB", size / F.lit(1024.0 * 1024.0))


def version_parts(name: Column) -> Column:
    """``struct<base, mark, number, ext>``: what the next version's name is made of.

    The stem ends in ``_v<digits>``, else ``_<digits>``, else `` (<digits>)``,
    each after at least one character; otherwise the mark is ``_v`` and the
    number 0. Numbers beyond a long count as no number.
    """
    own = stem(name)
    forms = (("_v", r"^(.+)_v([0-9]{1,18})$"), ("_", r"^(.+)_([0-9]{1,18})$"), (" (", r"^(.+) \(([0-9]{1,18})\)$"))
    out = F.struct(own.alias("base"), F.lit("_v").alias("mark"), F.lit(0).cast("long").alias("number"), extension(name).alias("ext"))
    for mark, form in reversed(forms):
        hit = F.struct(
            F.regexp_extract(own, form, 1).alias("base"), F.lit(mark).alias("mark"),
            F.regexp_extract(own, form, 2).cast("long").alias("number"), extension(name).alias("ext"),
        )
        out = F.when(F.rlike(own, F.lit(form)), hit).otherwise(out)
    return out


def version_name(base: Column, mark: Column, number: Column, ext: Column) -> Column:
    tail = F.when(mark == " (", ")").otherwise("")
    dotted = F.when(F.coalesce(ext, F.lit("")) == "", "").otherwise(F.concat(F.lit("."), ext))
    return F.concat(base, mark, number.cast("string"), tail, dotted)


def first_free(wanted: DataFrame, taken: DataFrame, keys: list[str], start: str, number: str) -> DataFrame:
    """``wanted`` with ``free``: the least number from ``start`` on that is not taken under the same keys.

    ``taken`` holds ``keys`` and ``number``. The numbers from ``start`` on are
    ranked; those that follow it without a gap are skipped. Equi-joins and a
    ranking within a key, no loop. Keys compare null-safely.
    """
    rows = wanted.withColumn("_row", F.monotonically_increasing_id())
    other = taken.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col(number).alias("_n")).distinct()
    same = F.col("_n") >= F.col(start)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    place = F.row_number().over(Window.partitionBy(*keys, start).orderBy("_n"))
    asked = rows.select(*keys, start).distinct()
    runs = asked.join(other, same).withColumn("_place", place)
    gap = runs.where(F.col("_n") == F.col(start) + F.col("_place") - 1).groupBy(*keys, start).agg(F.count(F.lit(1)).alias("_skip"))
    gap = gap.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col(start).alias("_start"), "_skip")
    on = F.col(start) == F.col("_start")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    free = (F.col(start) + F.coalesce("_skip", F.lit(0))).alias("free")
    return rows.join(gap, on, "left").select(*wanted.columns, free)


def next_versions(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """``folder, name, next_name``: the next free version of each name of ``wanted`` among ``existing`` (folder, name)."""
    parts = wanted.withColumn("p", version_parts(F.col("name"))).select("folder", "name", "p.*")
    parts = parts.withColumn("start", F.col("number") + 1)
    # Each existing name under all marks it could have been made with; only canonical numbers can collide.
    own, marks = stem(F.col("name")), []
    for mark, form in (("_v", r"^(.+)_v([1-9][0-9]{0,17})$"), ("_", r"^(.+)_([1-9][0-9]{0,17})$"), (" (", r"^(.+) \(([1-9][0-9]{0,17})\)$")):
        hit = F.struct(F.regexp_extract(own, form, 1).alias("base"), F.lit(mark).alias("mark"), F.regexp_extract(own, form, 2).cast("long").alias("number"))
        marks.append(F.when(F.rlike(own, F.lit(form)), hit))
    taken = existing.select("folder", extension(F.col("name")).alias("ext"), F.explode(F.array_compact(F.array(*marks))).alias("m")).select("folder", "ext", "m.*")
    found = first_free(parts, taken, ["folder", "base", "mark", "ext"], "start", "number")
    return found.select("folder", "name", version_name(F.col("base"), F.col("mark"), F.col("free"), F.col("ext")).alias("next_name"))


def unique_folders(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """``base, folder_name``: base if free among ``existing(name)``, else ``base (2)``, ``base (3)`` and so on."""
    form = r"^(.+) \(([1-9][0-9]{0,17})\)$"
    plain = existing.select(F.col("name").alias("base"), F.lit(1).cast("long").alias("number"))
    counted = existing.where(F.rlike("name", F.lit(form))).select(F.regexp_extract("name", form, 1).alias("base"), F.regexp_extract("name", form, 2).cast("long").alias("number"))
    taken = plain.unionByName(counted.where("number >= 2"))
    found = first_free(wanted.select("base").withColumn("start", F.lit(1).cast("long")), taken, ["base"], "start", "number")
    return found.select("base", F.when(F.col("free") == 1, F.col("base")).otherwise(F.concat("base", F.lit(" ("), F.col("free").cast("string"), F.lit(")"))).alias("folder_name"))


def common_names(names: DataFrame, group: str) -> DataFrame:
    """``group, common_name``: the longest common prefix of the stems of each group's ``name``.

    The prefix of a set of strings is that of its least and its greatest one, so a
    map-side combined aggregation suffices. Trailing characters other than
    letters and digits go; under three bytes give ``Collection``.
    """
    ends = names.groupBy(group).agg(F.min(stem(F.col("name"))).alias("x"), F.max(stem(F.col("name"))).alias("y"))
    same = F.expr("coalesce(array_position(transform(sequence(1, greatest(least(length(x), length(y)), 1)), i -> substring(x, i, 1) = substring(y, i, 1)), false), 0)")
    size = F.when(F.least(F.length("x"), F.length("y")) == 0, 0).when(same == 0, F.least(F.length("x"), F.length("y"))).otherwise(same - 1)
    prefix = F.regexp_replace(F.expr("x").substr(F.lit(1), size.cast("int")), r"[^\p{L}\p{N}]+$", "")
    return ends.select(group, F.when(F.octet_length(prefix) < 3, "Collection").otherwise(prefix).alias("common_name"))
