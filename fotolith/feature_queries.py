"""Registered queries over decoded images and generated sets, each with its SQL for DuckDB.

Images are small pixel arrays that are computed from the keys of ``part``, so that
features, turns and thumbnails can be checked to the last pixel.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fotolith import datagen, reports
from fotolith.functions import names
from fotolith.operators import features
from fotolith.schema import BENCHMARK
from fotolith.session import own_folder, read_table, send_package
from fotolith.sources import folders, listing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Rows of every image; widths are 4, 8 or 16.
HEIGHT = 8
THUMBNAIL = 4
#: Parts whose images a task makes.
IMAGES_A_TASK = 8192


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path, height, width, channels, data``: an image of each part, blue, green and red of each pixel.

    A part is a few bytes and its image many, so parts are dealt to tasks by their number, not by the size of their file.
    """
    key, width = F.col("p_partkey"), F.expr("4 * cast(pow(2, p_partkey % 3) as int)")
    part = read_table(spark, sf_dir, "part").select("p_partkey")
    sized = part.repartition(-(-part.count() // IMAGES_A_TASK) or 1).select(key, width.alias("width"))

    send_package(spark)

    def paint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, widths = (batch.column(c).fill_null(0).to_numpy() for c in ("p_partkey", "width"))
            data: list[bytes | None] = [None] * len(keys)
            for w in np.unique(widths[widths > 0]).tolist():
                at, i = np.flatnonzero(widths == w), np.arange(HEIGHT * w * 3)
                k, c, p = keys[at, None], i % 3, i // 3
                made = ((k * (11 + 2 * c) + p * (29 + 6 * c) + np.fmod(p * k, 17 + c) * 5) % 256).astype(np.uint8)
                for row, one in zip(at.tolist(), made):
                    data[row] = one.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(data, pa.binary())], names=["p_partkey", "width", "data"])

    painted = sized.mapInArrow(paint, "p_partkey long, width int, data binary")
    return painted.select(F.concat(F.lit("part_"), key.cast("string"), F.lit(".jpg")).alias("path"), F.lit(HEIGHT).alias("height"), "width", F.lit(3).alias("channels"), "data")


_IMAGES = f"""images AS (
  SELECT 'part_' || p_partkey || '.jpg' AS path, w, list_transform(range(0, {HEIGHT} * w * 3), lambda i: ((p_partkey * (11 + 2 * (i % 3)) + (i // 3) * (29 + 6 * (i % 3)) + (i // 3) * p_partkey % (17 + i % 3) * 5) % 256)::INT) AS v
  FROM (SELECT p_partkey, (4 * pow(2, p_partkey % 3))::INT AS w FROM part))"""
_LINEAR = "CASE WHEN {0} / 255.0::DOUBLE <= 0.04045 THEN {0} / 255.0::DOUBLE / 12.92 ELSE pow(({0} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END"
_F = "CASE WHEN {0} > pow(6 / 29.0::DOUBLE, 3) THEN cbrt({0}) ELSE {0} / (3 * pow(6 / 29.0::DOUBLE, 2)) + 4 / 29.0::DOUBLE END"
_LAB = f"""{_IMAGES},
pixels AS (SELECT path, w, i, v[(3 * i + 3)::INT]::DOUBLE AS r, v[(3 * i + 2)::INT]::DOUBLE AS g, v[(3 * i + 1)::INT]::DOUBLE AS b FROM images, unnest(range(0, {HEIGHT} * w)) u(i)),
linear AS (SELECT path, w, i, r, g, b, {_LINEAR.format("r")} AS lr, {_LINEAR.format("g")} AS lg, {_LINEAR.format("b")} AS lb FROM pixels),
xyz AS (SELECT *, (0.4124564 * lr + 0.3575761 * lg + 0.1804375 * lb) / 0.95047 AS x, 0.2126729 * lr + 0.7151522 * lg + 0.0721750 * lb AS y, (0.0193339 * lr + 0.1191920 * lg + 0.9503041 * lb) / 1.08883 AS z FROM linear),
cubes AS (SELECT *, {_F.format("x")} AS fx, {_F.format("y")} AS fy, {_F.format("z")} AS fz FROM xyz),
lab AS (SELECT path, w, i, r, g, b AS blue, 116 * fy - 16 AS l, 500 * (fx - fy) AS a, 200 * (fy - fz) AS b FROM cubes)"""


@query(f"""WITH {_LAB},
grey AS (SELECT path, w, list(0.299 * r + 0.587 * g + 0.114 * blue ORDER BY i) AS grey, avg(l) AS l, avg(a) AS a, avg(b) AS b FROM lab GROUP BY path, w),
bits AS (SELECT *, list_transform(range(0, 64), lambda k: (grey[((k // 8) * w + least(floor((k % 8 + 0.5) * w / 9), w - 1) + 1)::INT] > grey[((k // 8) * w + least(floor((k % 8 + 1.5) * w / 9), w - 1) + 1)::INT])::INT) AS bits FROM grey)
SELECT path, w AS width, {HEIGHT} AS height, round(l, 4) AS l, round(a, 4) AS a, round(b, 4) AS b, w / {HEIGHT}.0::DOUBLE AS aspect_ratio,
  to_base64(unhex(array_to_string(list_transform(range(0, 16), lambda q: substr('0123456789ABCDEF', 1 + 8 * bits[(4 * q + 1)::INT] + 4 * bits[(4 * q + 2)::INT] + 2 * bits[(4 * q + 3)::INT] + bits[(4 * q + 4)::INT], 1)), ''))) AS phash FROM bits""")
def image_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour, shape and hash of every image."""
    made = features.extract(images(spark, sf_dir))
    return made.select("path", "width", "height", *(F.round(c, 4).alias(c) for c in ("l", "a", "b")), "aspect_ratio", "phash")


def _palette_sql() -> str:
    """Lloyd steps over an image's pixels, one subquery a step."""
    near = "list_transform(centres, lambda c: pow(p.l - c.l, 2) + pow(p.a - c.a, 2) + pow(p.b - c.b, 2))"
    made = f"SELECT path, points, list_transform(range(0, {features.COLORS}), lambda k: points[(k * w + 1)::INT]) AS centres FROM (SELECT path, w, list({{'l': l, 'a': a, 'b': b}} ORDER BY i) AS points FROM lab GROUP BY path, w)"
    for _ in range(features.STEPS):
        homes = f"SELECT *, list_transform(points, lambda p: list_position({near}, list_min({near}))) AS homes FROM ({made})"
        mean = ", ".join(f"'{c}': list_avg(list_transform(m, lambda x: x.{c}))" for c in "lab")
        made = f"""SELECT path, points, list_transform(range(1, {features.COLORS + 1}), lambda k: list_transform([list_filter(points, lambda p, i: homes[i::INT] = k)],
          lambda m: CASE WHEN len(m) = 0 THEN centres[k::INT] ELSE {{{mean}}} END)[1]) AS centres FROM ({homes})"""
    return f"""WITH {_LAB}, made AS ({made}), colours AS (SELECT path, k, centres[k::INT] AS c FROM made, unnest(range(1, {features.COLORS + 1})) u(k))
SELECT path, row_number() OVER (PARTITION BY path ORDER BY c.l, k)::INT AS place, round(c.l, 4) AS l, round(c.a, 4) AS a, round(c.b, 4) AS b FROM colours"""


@query(_palette_sql())
def image_palettes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dominant colours of every image, the darkest first."""
    made = features.extract(images(spark, sf_dir)).select("path", F.posexplode("dominant_colors").alias("place", "c"))
    return made.select("path", (F.col("place") + 1).alias("place"), *(F.round(F.col("c")[k], 4).alias(n) for k, n in enumerate("lab")))


#: Height, width and source pixel (row, column) of each turn, in SQL.
_TURNS = {
    "rotate_90": ("w", str(HEIGHT), f"{HEIGHT} - 1 - x", "y"),
    "rotate_180": (str(HEIGHT), "w", f"{HEIGHT} - 1 - y", "w - 1 - x"),
    "rotate_270": ("w", str(HEIGHT), "x", "w - 1 - y"),
    "flip_horizontal": (str(HEIGHT), "w", "y", "w - 1 - x"),
    "flip_vertical": (str(HEIGHT), "w", f"{HEIGHT} - 1 - y", "x"),
}


def _resampled(height: str, width: str, row: str, column: str) -> str:
    """SQL of an image's bytes as decimal text, each taken from another pixel."""
    at = f"(({row}) * w + ({column}))".replace("y", f"(j // 3 // ({width}))").replace("x", f"(j // 3 % ({width}))")
    return f"md5(array_to_string(list_transform(range(0, ({height}) * ({width}) * 3), lambda j: v[(3 * {at} + j % 3 + 1)::INT]), ','))"


def _digest(made: DataFrame) -> DataFrame:
    """``pixels`` in place of the data: the digest of its bytes as decimal text."""
    send_package(made.sparkSession)
    kept = made.drop("data", "channels")
    names, spell = kept.columns, [str(k) for k in range(256)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (",".join([spell[x] for x in d]) for d in batch.column("data").to_pylist())
            own = pa.array([hashlib.md5(t.encode()).hexdigest() for t in texts], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), own], names=[*names, "pixels"])

    return made.mapInArrow(run, kept.schema.add("pixels", "string"))


@query(f"WITH {_IMAGES} " + " UNION ALL ".join(f"SELECT path, '{name}' AS turn, ({h})::INT AS height, ({w})::INT AS width, {_resampled(h, w, y, x)} AS pixels FROM images" for name, (h, w, y, x) in _TURNS.items()))
def image_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every image after each turn and flip."""
    return _digest(features.turns(images(spark, sf_dir), list(features.TRANSFORMS)))


_SCALE = f"least({THUMBNAIL} / {HEIGHT}.0::DOUBLE, {THUMBNAIL} / w::DOUBLE, 1)"
_TH, _TW = f"greatest(1, round_even({HEIGHT} * {_SCALE}, 0))::INT", f"greatest(1, round_even(w * {_SCALE}, 0))::INT"


@query(f"""WITH {_IMAGES}, sized AS (SELECT *, {_TH} AS th, {_TW} AS tw FROM images)
SELECT path, {THUMBNAIL} AS size, th AS height, tw AS width, {_resampled("th", "tw", f"least(floor((y + 0.5) * {HEIGHT} / th), {HEIGHT} - 1)", "least(floor((x + 0.5) * w / tw), w - 1)")} AS pixels FROM sized""")
def image_thumbnails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every image fitted into a small square."""
    return _digest(features.thumbnails(images(spark, sf_dir), THUMBNAIL))


def _bmp(width: int, height: int, key: int) -> bytes:
    """A bitmap of 24 bits a pixel in one colour."""
    row = bytes([key * 9 % 256, key * 5 % 256, key * 7 % 256]) * width
    rows = (row + bytes(-len(row) % 4)) * height
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + len(rows), 0, 0, 54, 40, width, height, 1, 24, 0, len(rows), 2835, 2835, 0, 0) + rows


def scanned_folder(spark: SparkSession, sf_dir: str) -> str:
    """A folder of real files, from the small table ``nation``: a bitmap, a text and a broken image each, in folders of the regions."""
    root = f"{own_folder(spark)}/scan-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    for r in read_table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey").collect():
        k, region = r["n_nationkey"], r["n_regionkey"]
        for name, data in ((f"img_{k}.bmp", _bmp(1 + k % 5, 1 + k % 7, k)), (f"note_{k}.txt", b"text"), (f"broken_{k}.JPG", b"no image" * (k + 1))):
            out = fs.create(path(f"{root}/region_{region}/{name}"))
            out.write(data)
            out.close()
    return root


@query("""WITH n AS (SELECT n_nationkey AS k, 'region_' || n_regionkey AS folder, 1 + n_nationkey % 5 AS w, 1 + n_nationkey % 7 AS h FROM nation)
SELECT folder, 'img_' || k || '.bmp' AS name, w::INT AS width, h::INT AS height, (54 + (3 * w + 3) // 4 * 4 * h)::BIGINT AS size_bytes, 'BMP' AS format FROM n
UNION ALL SELECT folder, 'broken_' || k || '.JPG', NULL, NULL, 8 * (k + 1), 'JPG' FROM n""")
def scanned_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of the images of a real folder, after a scan and decoding."""
    root = scanned_folder(spark, sf_dir)
    found = listing.list_files(spark, root, recursive=True).withColumn("path", F.regexp_replace("path", "^file:/+", "file:/"))
    made = listing.metadata(found, listing.read_images(spark, f"{root}/*"))
    return made.select(names.file_name(names.parent(F.col("path"))).alias("folder"), "name", "dimensions.width", "dimensions.height", "size_bytes", "format")


@query("""SELECT DISTINCT 'region_' || n_regionkey AS name, 0::BIGINT AS size, true AS is_dir FROM nation""")
def scanned_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subfolders of a real folder."""
    return listing.list_directories(spark, scanned_folder(spark, sf_dir)).select("name", "size", "is_dir")


def written_tree(spark: SparkSession, sf_dir: str) -> str:
    """The documents as text files in folders of sources and, below, languages: real files, written by tasks."""
    root = f"{own_folder(spark)}/tree-{uuid.uuid4().hex}"
    read_table(spark, sf_dir, "documents").select("source", "lang", F.coalesce("text", F.lit("")).alias("text")).write.partitionBy("source", "lang").text(root)
    return root


@query("""WITH f AS (SELECT 'source=' || source AS one, 'lang=' || lang AS two, strlen(coalesce(text, '')) + 1 AS n FROM documents)
SELECT '' AS folder, one AS name, true AS is_dir, 0::BIGINT AS bytes FROM f GROUP BY one
UNION ALL SELECT one, two, true, 0 FROM f GROUP BY one, two
UNION ALL SELECT one || '/' || two, 'texts', false, sum(n)::BIGINT FROM f GROUP BY one, two""")
def scanned_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders of a tree of real files, and the bytes of the texts in each, listed by tasks."""
    root = written_tree(spark, sf_dir)
    dirs = folders.scan(spark, root, depth=3, kind="folders").select("folder", "name", "is_dir", F.col("size").alias("bytes"))
    texts = folders.scan(spark, root, depth=3, kind="files", ends=".txt").groupBy("folder").agg(F.sum("size").alias("bytes"))
    return dirs.unionByName(texts.select("folder", F.lit("texts").alias("name"), F.lit(False).alias("is_dir"), "bytes"))


def _draws_sql() -> str:
    """The generator as a recursion over its state, then each set's rows from its draws."""
    state = f"((s::HUGEINT * {datagen.MULTIPLIER}::HUGEINT + {datagen.ADDEND}) % 18446744073709551616::HUGEINT)"
    draws = {"Burst": 5, "Timeline": 5, "Chaos": 6}
    start = " UNION ALL ".join(f"SELECT '{n}' AS name, {seed}::HUGEINT AS s, 0 AS k, {count * draws[n]} AS total, {draws[n]} AS a_row" for n, (count, seed) in datagen.DATASETS.items())
    unit = lambda d: f"(d[{d}] // 1099511627776)::FLOAT / 16777216::FLOAT"
    between = lambda d, low, high: f"({low}::FLOAT + {unit(d)} * ({high}::FLOAT - {low}::FLOAT))"
    hue = f"{between(1, 20, 80)} AS l, {between(2, -20, 20)} AS a, {between(3, -20, 20)} AS b"
    return f"""WITH RECURSIVE draw AS ({start} UNION ALL SELECT name, {state}, k + 1, total, a_row FROM draw WHERE k < total),
by_row AS (SELECT name, (k - 1) // a_row AS id, list(s ORDER BY k) AS d FROM draw WHERE k > 0 GROUP BY name, (k - 1) // a_row),
made AS (
  SELECT name, id, d, 1000::FLOAT + id::FLOAT * 1.5::FLOAT + {between(1, -5, 5)} AS time, 50::FLOAT + {between(2, -2, 2)} AS l, 10::FLOAT + {between(3, -1, 1)} AS a, -5::FLOAT + {between(4, -1, 1)} AS b, 1.5::FLOAT AS r FROM by_row WHERE name = 'Burst'
  UNION ALL SELECT name, id, d, id::FLOAT * 86400::FLOAT, {hue}, CASE WHEN {unit(4)} > 0.5 THEN 1.33::FLOAT ELSE 0.75::FLOAT END FROM by_row WHERE name = 'Timeline'
  UNION ALL SELECT name, id, d, {between(1, 0, 1000000)}, {between(2, 0, 100)}, {between(3, -50, 50)}, {between(4, -50, 50)}, {between(5, 0.5, 2)} FROM by_row WHERE name = 'Chaos')"""


@query(f"""{_draws_sql()} SELECT name AS dataset, id::BIGINT AS id, round(time::DOUBLE, 4) AS time, round(l::DOUBLE, 5) AS l, round(a::DOUBLE, 5) AS a, round(b::DOUBLE, 5) AS b, round(r::DOUBLE, 5) AS aspect_ratio,
(CASE WHEN d[-1] >= 9223372036854775808::HUGEINT THEN d[-1] - 18446744073709551616::HUGEINT ELSE d[-1] END)::BIGINT AS phash_bits FROM made""")
def generated_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published data sets, row by row; they read no table."""
    out = None
    for name in datagen.DATASETS:
        one = datagen.dataset(spark, name).select(F.lit(name).alias("dataset"), "id", F.round("time", 4).alias("time"), *(F.round(c, 5).alias(c) for c in ("l", "a", "b", "aspect_ratio")), "phash_bits")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""{_draws_sql()}, spread AS (SELECT name, count(*) AS n, 0.1 * stddev_pop(time::DOUBLE) / 86400 + stddev_pop(l::DOUBLE) / 100 + stddev_pop(a::DOUBLE) / 128 + stddev_pop(b::DOUBLE) / 128 + stddev_pop(r::DOUBLE) / 2 AS h FROM made GROUP BY name)
SELECT name AS "Dataset Name", n::VARCHAR AS "Image Count", format('{{:.4f}}', h) AS "Heterogeneity Rate", 'Batch DBSCAN' AS "Algorithm", format('{{:.3f}}', (40 * n + 8 * n * n) / 1048576.0::DOUBLE) AS "Peak Mem (MB)",
CASE name WHEN 'Timeline' THEN '2' ELSE '1' END AS "Cluster Count" FROM spread""")
def published_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published rows of batch DBSCAN: size, spread, memory by formula and number of clusters."""
    report = reports.as_strings(reports.benchmark(spark, BENCHMARK, algorithms=("Batch DBSCAN",)))
    return report.drop("Time (ms)", "Silhouette Score")
