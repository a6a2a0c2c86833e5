"""Registered queries of the catalogue engine, each with its SQL for DuckDB where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fotolith import reports
from fotolith.functions import distance, hashes, labels, names
from fotolith.functions import table as table_function
from fotolith.operators import assign, catalog, dbscan, leader, prefix, silhouette, stats, tune
from fotolith.plans import moves
from fotolith.schema import DIMENSIONS, FEATURE_COLUMNS, GroupConfig
from fotolith.session import own_folder, read_table, stored
from fotolith.sources import adapters, config
from fotolith.streaming import leader_stream, windows
from fotolith.streaming.progress import ProgressLog, progress

#: Settings of the queries over derived features: every weight counts.
CONFIG = GroupConfig(weight_time=0.1, weight_color=0.2, weight_name=0.1, eps=0.6, min_samples=5)
#: Files, and so micro-batches, of the streamed query.
STREAM_FILES = 3
#: DBSCAN ignores weights and uses five z-scores.
SCAN = GroupConfig(eps=0.5, min_samples=5)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Derived frames in SQL, as ``adapters`` defines them.
_EXT = "['jpg', 'JPEG', 'png', 'WebP', 'gif', 'BMP', 'tiff', 'TIF', 'avif', 'txt', 'mp4', 'pdf'][doc_id % 12 + 1]"
_FILES = f"""files AS (
  SELECT doc_id AS file_id, source AS folder, 'IMG_' || doc_id || '.' || {_EXT} AS name, source || '/IMG_' || doc_id || '.' || {_EXT} AS path,
    n_chars AS size, 1700000000 + doc_id * 7919 % 100000 AS modified, md5(text) AS phash,
    lower({_EXT}) IN ('jpg','jpeg','png','webp','gif','bmp','tiff','tif','avif') AS supported FROM documents)"""
_IMAGES = "images AS (SELECT p_partkey AS id, 'part_' || p_partkey || '.jpg' AS path, p_size::BIGINT AS size FROM part WHERE p_size <= 45)"
_MEMBERS = "members AS (SELECT DISTINCT l_orderkey AS collection_id, 'part_' || l_partkey || '.jpg' AS path FROM lineitem)"
_FEATS = """raw AS (
  SELECT e.vec_id AS id, e.label, epoch(v.ts)::DOUBLE AS time, 50 + 100 * e.embedding[1]::DOUBLE AS l, 100 * e.embedding[2]::DOUBLE AS a,
    100 * e.embedding[3]::DOUBLE AS b, 1 + 2 * e.embedding[4]::DOUBLE AS r, list_transform(e.embedding, lambda x: (x > 0)::INT) AS bits,
    list_sort(list_transform(range(0, 8), lambda k: [100 * e.embedding[(5 + 3 * k)::INT]::DOUBLE, 100 * e.embedding[(6 + 3 * k)::INT]::DOUBLE, 100 * e.embedding[(7 + 3 * k)::INT]::DOUBLE])) AS palette
  FROM embeddings e JOIN events v ON e.vec_id = v.event_id)"""
_Z = """z AS (
  SELECT id, label, bits, palette, time AS raw_time, l AS raw_l, a AS raw_a, b AS raw_b, r AS raw_r,
    (time - avg(time) OVER ()) / greatest(stddev_pop(time) OVER (), 1e-9) AS time, (l - avg(l) OVER ()) / greatest(stddev_pop(l) OVER (), 1e-9) AS l,
    (a - avg(a) OVER ()) / greatest(stddev_pop(a) OVER (), 1e-9) AS a, (b - avg(b) OVER ()) / greatest(stddev_pop(b) OVER (), 1e-9) AS b,
    (r - avg(r) OVER ()) / greatest(stddev_pop(r) OVER (), 1e-9) AS r FROM raw)"""
_HAMMING = "list_sum(list_transform(range(1, 65), lambda i: (x.bits[i::INT] <> y.bits[i::INT])::INT))"
_PALETTE = "list_sum(list_transform(range(1, 9), lambda k: sqrt(pow(x.palette[k::INT][1] - y.palette[k::INT][1], 2) + pow(x.palette[k::INT][2] - y.palette[k::INT][2], 2) + pow(x.palette[k::INT][3] - y.palette[k::INT][3], 2)))) / 8 / 100"
_D = f"""d AS (
  SELECT x.id AS i, y.id AS j, x.label AS ci, y.label AS cj,
    sqrt({CONFIG.weights[0]} * pow(x.time - y.time, 2) + {CONFIG.weights[1]} * (pow(x.l - y.l, 2) + pow(x.a - y.a, 2) + pow(x.b - y.b, 2)) + 0.2 * pow(x.r - y.r, 2))
    + {_HAMMING} / 64.0 * {CONFIG.phash_weight} + {_PALETTE} * {CONFIG.palette_weight} AS d
  FROM z x JOIN z y ON x.id <> y.id)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


# Duplicates, listings, catalogue


@query(f"""WITH {_FILES} SELECT min(file_id) AS group_id, phash, 'Exact Duplicates' AS label, count(*) AS n, array_to_string(list_sort(list(path)), '|') AS paths
FROM files GROUP BY phash HAVING count(*) > 1""")
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.duplicates(adapters.files(spark, sf_dir)).withColumn("paths", F.array_join("paths", "|"))


@query(f"""WITH {_FILES}, g AS (SELECT phash, min(file_id) AS group_id FROM files GROUP BY phash HAVING count(*) > 1)
SELECT group_id, file_id, path FROM files JOIN g USING (phash)""")
def duplicate_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.duplicate_members(adapters.files(spark, sf_dir))


@query(f"""WITH {_FILES}, live AS (SELECT * FROM files WHERE supported)
SELECT min(file_id) AS group_id, phash, count(*) AS n FROM live GROUP BY phash HAVING count(*) > 1""")
def duplicates_of_current_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = adapters.files(spark, sf_dir)
    return catalog.duplicates(files, files.where(names.is_supported(F.col("name")))).select("group_id", "phash", "n")


@query(f"WITH {_FILES} SELECT file_id, path, upper(regexp_extract(name, '([^.]*)$', 1)) AS format FROM files WHERE supported")
def supported_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = adapters.files(spark, sf_dir).where(names.is_supported(F.col("name")))
    return files.select("file_id", "path", F.upper(names.extension(F.col("name"))).alias("format"))


@query(f"""WITH {_FILES}, folders AS (SELECT DISTINCT folder FROM files UNION ALL SELECT 'empty')
SELECT folders.folder, count(files.file_id) FILTER (WHERE supported) AS n_images FROM folders LEFT JOIN files USING (folder) GROUP BY 1""")
def folder_image_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = adapters.files(spark, sf_dir)
    folders = files.select("folder").unionByName(spark.range(1).select(F.lit("empty").alias("folder")))
    return catalog.folder_counts(files, folders)


@query(f"""WITH {_FILES}, rows AS (
  SELECT folder, name, false AS is_dir, size, 0 AS ord FROM files WHERE supported
  UNION ALL SELECT DISTINCT folder, '..', true, 0, -1 FROM files
  UNION ALL SELECT DISTINCT folder, 'Sub_' || chr((97 + file_id % 3)::INT), true, 0, 0 FROM files)
SELECT folder, row_number() OVER (PARTITION BY folder ORDER BY ord, is_dir DESC, lower(name), name)::INT AS pos, name, is_dir, size FROM rows""")
def folder_listing_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = adapters.files(spark, sf_dir)
    sub = files.select("folder", F.concat(F.lit("Sub_"), F.chr((F.lit(97) + F.col("file_id") % 3).cast("int"))).alias("name")).distinct()
    return catalog.listing(files, sub)


@query(f"WITH {_FILES} SELECT DISTINCT folder FROM files")
def child_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.files(spark, sf_dir).select(names.parent(F.col("path")).alias("folder")).distinct()


_LOG = "log AS (SELECT event_id AS seq, event_id AS id, 'img_' || user_id || '.jpg' AS path, (value * 100)::BIGINT AS size FROM events)"


@query(f"""WITH {_LOG}
SELECT min(id) AS id, path, arg_max(size, seq) AS size, max(seq) AS seq FROM log GROUP BY path""")
def catalog_upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events")
    log = events.select(F.col("event_id").alias("id"), F.concat(F.lit("img_"), F.col("user_id").cast("string"), F.lit(".jpg")).alias("path"), F.bround(F.col("value") * 100, 0).cast("long").alias("size"), F.col("event_id").alias("seq"))
    return catalog.upsert_latest(log, "path", "seq", "id").select("id", "path", "size", "seq")


@query(f"WITH {_IMAGES} SELECT (SELECT count(*) FROM images) AS total_images, (SELECT count(*) FROM orders) AS total_collections")
def catalog_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.table_counts(adapters.images(spark, sf_dir), read_table(spark, sf_dir, "orders"))


@query(f"WITH {_IMAGES}, {_MEMBERS} SELECT collection_id, id AS image_id FROM members JOIN images USING (path)")
def collection_members_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.resolve_members(adapters.members(spark, sf_dir), adapters.images(spark, sf_dir))


@query(f"WITH {_IMAGES}, {_MEMBERS} SELECT collection_id, path FROM members ANTI JOIN images USING (path)")
def collection_missing_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.missing_members(adapters.members(spark, sf_dir), adapters.images(spark, sf_dir))


@query(f"""WITH {_IMAGES}, {_MEMBERS}, missing AS (SELECT DISTINCT collection_id FROM members ANTI JOIN images USING (path))
SELECT o_orderkey AS collection_id, epoch(o_orderdate)::BIGINT AS created_at FROM orders WHERE o_orderkey NOT IN (SELECT collection_id FROM missing)""")
def storable_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders")
    created = F.greatest(F.unix_seconds(F.col("o_orderdate").cast("timestamp")), F.lit(0).cast("long"))
    collections = orders.select(F.col("o_orderkey").alias("collection_id"), created.alias("created_at"))
    return catalog.storable_collections(collections, adapters.members(spark, sf_dir), adapters.images(spark, sf_dir))


@query(f"WITH {_FILES} SELECT phash, min(file_id) AS file_id FROM files WHERE phash IN (SELECT md5(text) FROM benchmark UNION ALL SELECT phash FROM files WHERE supported) GROUP BY phash")
def hash_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = adapters.files(spark, sf_dir)
    wanted = read_table(spark, sf_dir, "benchmark").select(F.md5("text").alias("phash")).unionByName(files.where(names.is_supported(F.col("name"))).select("phash"))
    return catalog.lookup_hashes(wanted, files)


@query(f"""WITH {_FILES}, n AS (SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY folder) AS c FROM files WINDOW w AS (PARTITION BY folder ORDER BY modified, file_id))
SELECT folder, 'oldest' AS pick, file_id FROM n WHERE r = 1 UNION ALL SELECT folder, 'newest', file_id FROM n WHERE r = c UNION ALL SELECT folder, 'median', file_id FROM n WHERE r = c // 2 + 1""")
def champions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.champions(adapters.files(spark, sf_dir), "folder", ["modified", "file_id"])


@query("SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 500")
def log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.last_rows(read_table(spark, sf_dir, "events").select("event_id", "ts", "event_type"), ["ts", "event_id"], 500)


@query(f"WITH {_FILES} SELECT name, path, size FROM files WHERE supported ORDER BY lower(name), path LIMIT 40 OFFSET 20")
def viewport_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = adapters.files(spark, sf_dir).where(names.is_supported(F.col("name"))).select("name", "path", "size")
    return catalog.page(files, [F.lower("name"), "path"], 20, 40)


@query(f"""WITH {_FILES} SELECT folder, name, lag(name) OVER w AS previous, lead(name) OVER w AS next FROM files WHERE supported
WINDOW w AS (PARTITION BY folder ORDER BY lower(name), name)""")
def neighbour_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.neighbours(adapters.files(spark, sf_dir))


@query(f"WITH {_FILES} SELECT path FROM files WHERE supported AND folder NOT IN ('src0', 'src1') UNION SELECT path FROM files WHERE NOT supported AND folder IN ('src0', 'src1')")
def selection_toggle(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = adapters.files(spark, sf_dir)
    return catalog.toggle(files.where(names.is_supported(F.col("name"))).select("path"), files.where("folder in ('src0', 'src1')").select("path"))


# Names


@query(f"""WITH {_FILES}, w AS (SELECT folder, 'photo' || (file_id % 7) || ['', '_v1', '_2', ' (3)', '_v9', '_vx', '_v'][file_id % 7 + 1] || '.jpg' AS name FROM files),
e AS (SELECT DISTINCT folder, 'photo' || (file_id % 7) || ['_v', '_', ' ('][file_id % 3 + 1] || (file_id % 5 + 1) || CASE WHEN file_id % 3 = 2 THEN ')' ELSE '' END || '.jpg' AS name FROM files),
p AS (SELECT DISTINCT folder, name, CASE WHEN regexp_matches(name, '^.+_v[0-9]+\\.jpg$') THEN '_v' WHEN regexp_matches(name, '^.+_[0-9]+\\.jpg$') THEN '_' WHEN regexp_matches(name, '^.+ \\([0-9]+\\)\\.jpg$') THEN ' (' ELSE '' END AS found FROM w),
q AS (SELECT folder, name, CASE found WHEN '' THEN '_v' ELSE found END AS mark, CASE found WHEN '' THEN regexp_replace(name, '\\.jpg$', '') WHEN ' (' THEN regexp_replace(name, ' \\([0-9]+\\)\\.jpg$', '')
  WHEN '_v' THEN regexp_replace(name, '_v[0-9]+\\.jpg$', '') ELSE regexp_replace(name, '_[0-9]+\\.jpg$', '') END AS base,
  CASE found WHEN '' THEN 0 ELSE regexp_extract(name, '([0-9]+)\\)?\\.jpg$', 1)::BIGINT END AS n FROM p),
c AS (SELECT folder, name, n + k AS m, base || mark || (n + k) || CASE mark WHEN ' (' THEN ')' ELSE '' END || '.jpg' AS next_name FROM q, range(1, 9) t(k))
SELECT c.folder, c.name, arg_min(c.next_name, c.m) AS next_name FROM c ANTI JOIN (SELECT folder, name AS next_name FROM e) e USING (folder, next_name) GROUP BY 1, 2""")
def next_version_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = adapters.files(spark, sf_dir).select("folder", "file_id")
    pick = lambda options, n: F.element_at(F.array(*map(F.lit, options)), (F.col("file_id") % n + 1).cast("int"))
    base = F.concat(F.lit("photo"), (F.col("file_id") % 7).cast("string"))
    wanted = files.select("folder", F.concat(base, pick(["", "_v1", "_2", " (3)", "_v9", "_vx", "_v"], 7), F.lit(".jpg")).alias("name")).distinct()
    tail = F.when(F.col("file_id") % 3 == 2, ")").otherwise("")
    existing = files.select("folder", F.concat(base, pick(["_v", "_", " ("], 3), (F.col("file_id") % 5 + 1).cast("string"), tail, F.lit(".jpg")).alias("name")).distinct()
    return names.next_versions(wanted, existing)


@query(f"""WITH {_FILES}, e AS (SELECT DISTINCT folder AS name FROM files WHERE file_id % 20 < 12 UNION SELECT DISTINCT folder || ' (2)' FROM files WHERE file_id % 20 < 6),
c AS (SELECT DISTINCT folder AS base, k, CASE k WHEN 1 THEN folder ELSE folder || ' (' || k || ')' END AS name FROM files, range(1, 6) t(k))
SELECT base, arg_min(name, k) AS folder_name FROM c ANTI JOIN e USING (name) GROUP BY base""")
def unique_folder_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = adapters.files(spark, sf_dir)
    first = files.where("file_id % 20 < 12").select(F.col("folder").alias("name"))
    second = files.where("file_id % 20 < 6").select(F.concat("folder", F.lit(" (2)")).alias("name"))
    return names.unique_folders(files.select(F.col("folder").alias("base")).distinct(), first.unionByName(second).distinct())


@query(f"""WITH {_FILES} SELECT file_id, CASE WHEN length(folder || name) > 18 THEN substr(folder || name, 1, 15) || '...' ELSE folder || name END AS shown,
(size // 1024) || ' KB' AS kb, printf('%.2f MB', size / 1048576.0) AS mb, strftime(make_timestamp(modified * 1000000), '%Y-%m-%d %H:%M:%S') AS time, strftime(make_timestamp(modified * 1000000), '%Y%m%d_%H%M%S') AS stamp, strftime(make_timestamp(modified * 1000000), '%H:%M:%S') AS clock FROM files""")
def display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.timestamp_seconds("modified")
    return adapters.files(spark, sf_dir).select(
        "file_id", names.truncated(F.concat("folder", "name")).alias("shown"), names.size_in_kb(F.col("size")).alias("kb"), names.size_in_mb(F.col("size")).alias("mb"),
        F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("time"), F.date_format(at, "yyyyMMdd_HHmmss").alias("stamp"), F.date_format(at, "HH:mm:ss").alias("clock"),
    )


@query("""WITH n AS (SELECT p_brand AS brand, p_name AS stem FROM part), e AS (SELECT brand, min(stem) AS x, max(stem) AS y FROM n GROUP BY brand),
s AS (SELECT brand, regexp_replace(substr(x, 1, (SELECT coalesce(min(i) - 1, least(length(x), length(y))) FROM range(1, 200) t(i) WHERE i <= least(length(x), length(y)) AND substr(x, i::INT, 1) <> substr(y, i::INT, 1))::INT), '[^\\p{L}\\p{N}]+$', '') AS p FROM e)
SELECT brand, CASE WHEN strlen(p) < 3 THEN 'Collection' ELSE p END AS common_name FROM s""")
def common_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read_table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.col("p_name").alias("name"))
    return names.common_names(part, "brand")


@query("SELECT CASE WHEN contains(text, 'ERROR') THEN 'ERROR' WHEN contains(text, 'WARN') THEN 'WARN' WHEN contains(text, 'DEBUG') THEN 'DEBUG' ELSE 'OTHER' END AS severity, count(*) AS n FROM (SELECT CASE event_id % 5 WHEN 0 THEN 'ERROR DEBUG ' WHEN 1 THEN 'a WARN' WHEN 2 THEN 'DEBUG' ELSE '' END || event_type AS text FROM events) GROUP BY 1")
def log_severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 5
    text = F.concat(F.when(k == 0, "ERROR DEBUG ").when(k == 1, "a WARN").when(k == 2, "DEBUG").otherwise(""), "event_type")
    return read_table(spark, sf_dir, "events").select(labels.log_severity(text).alias("severity")).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_FILES} SELECT file_id, lower(substr(phash, 1, 16)) AS bits, substr(md5(path || ':' || size), 1, 16) || '.png' AS cache_key FROM files")
def hash_codecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = adapters.files(spark, sf_dir)
    encoded = F.regexp_replace(F.base64(F.unhex(F.substring("phash", 1, 16))), "=+$", "")
    bits = F.lpad(F.lower(F.hex(hashes.hash_bits(hashes.null_if_empty(encoded)))), 16, "0")
    return files.select("file_id", bits.alias("bits"), hashes.cache_key(F.col("path"), F.col("size")).alias("cache_key"))


@query("SELECT 'user_' || user_id AS name, 'C:\\Users\\' || event_type AS path FROM events")
def favorites(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events")
    # Every other text has single backslashes, which strict JSON refuses.
    slash = F.when(F.col("event_id") % 2 == 0, F.lit("\\\\")).otherwise(F.lit("\\"))
    text = F.concat(F.lit('{"favorites":[{"name":"user_'), F.col("user_id").cast("string"), F.lit('","path":"C:'), slash, F.lit("Users"), slash, "event_type", F.lit('"}]}'))
    return config.favorites(events.select(text.alias("text")))


@query(f"""WITH {_FILES}, rows AS (
  SELECT folder, name, false AS is_dir, 0 AS ord FROM files WHERE supported UNION ALL SELECT DISTINCT folder, '..', true, -1 FROM files),
l AS (SELECT folder, name, row_number() OVER (PARTITION BY folder ORDER BY ord, is_dir DESC, lower(name), name) AS pos FROM rows)
SELECT folder, name FROM l WHERE pos BETWEEN 1 AND 12 AND name <> '..'""")
def selection_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows between two clicked places of every folder's listing."""
    files = adapters.files(spark, sf_dir)
    none = files.select("folder", "name").limit(0)
    return catalog.select_range(catalog.listing(files, none), 12, 1)


# Plans


@query(f"""WITH {_FILES}, b AS (SELECT phash FROM files GROUP BY phash HAVING count(*) >= 4)
SELECT CASE WHEN folder = 'src0' THEN 0 ELSE 1 + size % 9 END AS cluster, path AS src, folder || '/' || CASE WHEN folder = 'src0' THEN 'Uncategorized' ELSE 'Theme_' || (1 + size % 9) END || '/' || name AS dest FROM files
WHERE CASE WHEN folder = 'src0' THEN 0 ELSE 1 + size % 9 END IN (SELECT CASE WHEN folder = 'src0' THEN 0 ELSE 1 + size % 9 END FROM files GROUP BY 1 HAVING count(*) >= 4)""")
def cluster_move_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    cluster = F.when(F.col("folder") == "src0", F.lit(0).cast("long")).otherwise(1 + F.col("size") % 9)
    return moves.theme_moves(adapters.files(spark, sf_dir).select("path", cluster.alias("cluster")))


@query(f"""WITH {_FILES}, d AS (SELECT path, name, folder, 'src' || (file_id % 3) AS target FROM files)
SELECT path AS src, target || '/' || name AS dest FROM d WHERE target <> folder AND target || '/' || name NOT IN (SELECT path FROM files)""")
def drop_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = adapters.files(spark, sf_dir)
    return moves.drops(files.select("path", F.concat(F.lit("src"), (F.col("file_id") % 3).cast("string")).alias("target")), files.select("path"))


@query(f"""WITH {_FILES}, w AS (SELECT path, name, folder, CASE file_id % 3 WHEN 0 THEN '  ' WHEN 1 THEN name ELSE 'new_' || name END AS new_name FROM files)
SELECT path AS src, folder || '/' || new_name AS dest FROM w WHERE trim(new_name) <> '' AND new_name <> name""")
def rename_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("file_id") % 3
    new = F.when(k == 0, "  ").when(k == 1, F.col("name")).otherwise(F.concat(F.lit("new_"), "name"))
    return moves.renames(adapters.files(spark, sf_dir).select("path", new.alias("new_name")))


@query(f"""WITH {_FILES}, w AS (SELECT path, CASE file_id % 3 WHEN 0 THEN path WHEN 1 THEN folder || '/IMG_1.JPEG' ELSE path || '.bak' END AS dest FROM files)
SELECT path AS src, dest, CASE WHEN path = dest THEN 'same path' WHEN dest IN (SELECT path FROM files) THEN 'exists' END AS refused FROM w""")
def save_as_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, k = adapters.files(spark, sf_dir), F.col("file_id") % 3
    dest = F.when(k == 0, F.col("path")).when(k == 1, F.concat("folder", F.lit("/IMG_1.JPEG"))).otherwise(F.concat("path", F.lit(".bak")))
    return moves.save_as(files.select("path", dest.alias("dest")), files.select("path"))


@query(f"""WITH {_FILES}, w AS (SELECT path, folder, file_id % 3 = 0 AS selected, row_number() OVER (PARTITION BY folder ORDER BY file_id DESC) = 1 AS clicked FROM files)
SELECT c.folder, c.path AS clicked, coalesce(o.path, c.path) AS path FROM (SELECT * FROM w WHERE clicked) c LEFT JOIN w o ON c.selected AND o.selected AND o.folder = c.folder""")
def cut_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = adapters.files(spark, sf_dir)
    clicked = files.groupBy("folder").agg(F.max_by("path", "file_id").alias("clicked"))
    return moves.cut(clicked, files.where("file_id % 3 = 0").select("folder", "path"), "folder")


@query("""WITH m AS (SELECT o_orderkey AS id, 'd/' || o_orderkey || '.jpg' AS path, (o_custkey % 40)::BIGINT AS cluster FROM orders),
n AS (SELECT *, count(*) OVER (PARTITION BY cluster) AS n FROM m)
SELECT path AS src, row_number() OVER (ORDER BY cluster, path) AS done, count(*) OVER () AS total FROM n WHERE n >= 4""")
def move_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders")
    members = orders.select(F.concat(F.lit("d/"), F.col("o_orderkey").cast("string"), F.lit(".jpg")).alias("path"), (F.col("o_custkey") % 40).cast("long").alias("cluster"))
    return moves.progress(members)


# Statistics and distances


@query("""SELECT user_id, event_id, count(*) OVER w AS n, round(avg(value) OVER w, 9) AS mean,
round(CASE WHEN count(*) OVER w < 2 THEN 1.0 ELSE greatest(stddev_pop(value) OVER w, 0.1) END, 6) AS std FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)""")
def running_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.running(read_table(spark, sf_dir, "events"), "user_id", "event_id", "value", 0.1)
    return out.withColumns({"mean": F.round("mean", 9), "std": F.round("std", 6)})


@query(f"WITH {_FEATS}, {_Z} SELECT id, round(time, 6) AS time, round(l, 6) AS l, round(a, 6) AS a, round(b, 6) AS b, round(r, 6) AS aspect_ratio FROM z")
def zscore_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.normalised(adapters.image_features(spark, sf_dir)).select("id", *(F.round(d, 6).alias(d) for d in DIMENSIONS))


@query(f"WITH {_FEATS} SELECT round(0.1 * stddev_pop(time) / 86400 + stddev_pop(l) / 100 + stddev_pop(a) / 128 + stddev_pop(b) / 128 + stddev_pop(r) / 2, 6) AS heterogeneity FROM raw")
def heterogeneity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.heterogeneity(adapters.image_features(spark, sf_dir)).select(F.round("heterogeneity", 6).alias("heterogeneity"))


@query(f"""WITH {_FEATS}, f AS (SELECT 0.1 * stddev_pop(time) / 86400 AS t, 0.2 * (stddev_pop(l) + stddev_pop(a) + stddev_pop(b)) / 300 AS c, 0.2 * stddev_pop(r) AS p FROM raw),
g AS (SELECT t / (t + c + p) * 100 AS t, c / (t + c + p) * 100 AS c, p / (t + c + p) * 100 AS p FROM f)
SELECT 'config' AS kind, round(0.1 / 0.5 * 100, 4) AS time, round(0.2 / 0.5 * 100, 4) AS color, round(0.2 / 0.5 * 100, 4) AS palette, 'Color' AS label
UNION ALL SELECT 'variance', round(t, 4), round(c, 4), round(p, 4), CASE WHEN t >= c AND t >= p THEN 'Time' WHEN c >= p THEN 'Color' ELSE 'Palette' END FROM g""")
def cluster_forces(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = adapters.image_features(spark, sf_dir)
    shares = labels.config_forces(CONFIG, 1)
    fixed = spark.range(1).select(F.lit("config").alias("kind"), *(F.lit(v).alias(k) for k, v in zip(("time", "color", "palette"), shares)))
    varied = stats.variance_forces(features, (CONFIG.weight_time, CONFIG.weight_color, 0.2)).withColumn("kind", F.lit("variance"))
    both = fixed.unionByName(varied)
    label = labels.force_label(F.round("time", 4), F.round("color", 4), F.round("palette", 4))
    return both.select("kind", *(F.round(c, 4).alias(c) for c in ("time", "color", "palette")), label.alias("label"))


def _sides(features: DataFrame) -> DataFrame:
    """Pairs of neighbours by id: each feature with the next of its label, as structs x and y."""
    row = F.struct("id", *DIMENSIONS, "phash_bits", "dominant_colors")
    ahead = F.lead(row).over(Window.partitionBy("label").orderBy("id"))
    return features.select(row.alias("x"), ahead.alias("y")).where("y is not null")


@query(f"""WITH {_FEATS}, {_Z}, n AS (SELECT *, lead(id) OVER (PARTITION BY label ORDER BY id) AS nx FROM z)
SELECT x.id AS i, y.id AS j, round({_HAMMING} / 64.0, 6) AS hamming, round({_PALETTE}, 6) AS palette,
round(sqrt({CONFIG.weights[0]} * pow(x.time - y.time, 2) + {CONFIG.weights[1]} * (pow(x.l - y.l, 2) + pow(x.a - y.a, 2) + pow(x.b - y.b, 2)) + 0.2 * pow(x.r - y.r, 2))
 + {_HAMMING} / 64.0 * {CONFIG.phash_weight} + {_PALETTE} * {CONFIG.palette_weight}, 6) AS distance FROM n x JOIN z y ON x.nx = y.id""")
def neighbour_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _sides(stats.normalised(adapters.image_features(spark, sf_dir)))
    return pairs.select(
        F.col("x.id").alias("i"), F.col("y.id").alias("j"), F.round(distance.hamming(F.col("x.phash_bits"), F.col("y.phash_bits")), 6).alias("hamming"),
        F.round(distance.palette_distance(F.col("x.dominant_colors"), F.col("y.dominant_colors")), 6).alias("palette"),
        F.round(distance.combined("x", "y", CONFIG), 6).alias("distance"),
    )


@query(f"WITH {_FEATS}, {_Z}, {_D}, k AS (SELECT i, d, row_number() OVER (PARTITION BY i ORDER BY d) AS r FROM d) SELECT i AS id, round(d, 5) AS k_distance FROM k WHERE r = {CONFIG.min_samples}")
def knn_kdistance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tune.k_distances(adapters.image_features(spark, sf_dir), CONFIG).select("id", F.round("k_distance", 5).alias("k_distance"))


@query(f"""WITH {_FEATS}, {_Z}, {_D}, k AS (SELECT i, d, row_number() OVER (PARTITION BY i ORDER BY d) AS r FROM d),
c AS (SELECT d AS y0, row_number() OVER (ORDER BY d) - 1 AS x0, min(d) OVER () AS y1, max(d) OVER () AS y2, count(*) OVER () - 1 AS x2 FROM k WHERE r = {CONFIG.min_samples})
SELECT round(arg_max(y0, abs((y2 - y1) * x0 - x2 * y0 + x2 * y1)), 5) AS optimal_eps FROM c""")
def auto_tune_eps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tune.auto_tune(adapters.image_features(spark, sf_dir), CONFIG).select(F.round("optimal_eps", 5).alias("optimal_eps"))


@query(f"""WITH {_FEATS}, {_Z}, {_D}, m AS (SELECT i, ci, cj, avg(d) AS m FROM d GROUP BY i, ci, cj),
s AS (SELECT i, coalesce(max(m) FILTER (WHERE ci = cj), 0) AS a, coalesce(min(m) FILTER (WHERE ci <> cj), 0) AS b FROM m GROUP BY i)
SELECT count(*) AS n, round(avg(CASE WHEN greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END), 5) AS silhouette FROM s""")
def silhouette_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = silhouette.silhouette(adapters.image_features(spark, sf_dir), CONFIG, "label")
    return out.select("n", F.round("silhouette", 5).alias("silhouette"))


# Clustering


@query(f"""WITH RECURSIVE {_FEATS}, {_Z},
n AS MATERIALIZED (SELECT x.id AS i, y.id AS j FROM z x JOIN z y ON pow(x.time - y.time, 2) + pow(x.l - y.l, 2) + pow(x.a - y.a, 2) + pow(x.b - y.b, 2) + pow(x.r - y.r, 2) <= {SCAN.eps * SCAN.eps}),
core AS MATERIALIZED (SELECT i FROM n GROUP BY i HAVING count(*) >= {SCAN.min_samples}),
e AS MATERIALIZED (SELECT n.i, n.j FROM n JOIN core a ON n.i = a.i JOIN core b ON n.j = b.i),
reach(i, j) AS (SELECT i, j FROM e UNION SELECT reach.i, e.j FROM reach JOIN e ON reach.j = e.i),
root AS (SELECT i, min(j) AS root FROM reach GROUP BY i),
lab AS (SELECT z.id, coalesce(any_value(own.root), min(r.root)) AS root FROM z LEFT JOIN root own ON own.i = z.id LEFT JOIN n ON n.i = z.id LEFT JOIN root r ON r.i = n.j GROUP BY z.id)
SELECT id, CASE WHEN root IS NULL THEN 0 ELSE dense_rank() OVER (ORDER BY root NULLS LAST) END::BIGINT AS cluster FROM lab""")
def dbscan_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dbscan.dbscan(adapters.image_features(spark, sf_dir), SCAN)


@query(f"""WITH {_FEATS}, c AS (SELECT 0 AS dataset, label::BIGINT AS cluster, count(*) AS n, avg(time) AS time, avg(l) AS l, avg(a) AS a, avg(b) AS b, avg(r) AS r, (max(time) - min(time)) / 60 AS span FROM raw GROUP BY label)
SELECT cluster, n, round(l, 6) AS l, round(a, 6) AS a, round(b, 6) AS b, round(r, 6) AS aspect_ratio, round(span, 4) AS span_minutes,
CASE WHEN span < 10 THEN 'Burst / Moment' WHEN span < 120 THEN 'Event' WHEN r < 0.85 AND a > 5 AND b > 5 THEN 'Portraits' WHEN r > 1.2 AND (a < -5 OR b < -5) THEN 'Landscapes' WHEN l > 80 THEN 'Bright Scenes' WHEN l < 20 THEN 'Dark Scenes' ELSE 'Visual Harmony' END AS label,
CASE WHEN cluster = 0 THEN 'Miscellaneous' ELSE 'Theme ' || cluster || ' (' || n || ' items)' END AS title FROM c""")
def cluster_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = adapters.image_features(spark, sf_dir).withColumn("dataset", F.lit(0))
    assigned = features.select("dataset", "id", F.col("label").cast("long").alias("cluster"))
    out = leader.summaries(features.drop("label"), assigned, "dataset")
    return out.select(
        "cluster", "n", *(F.round(c, 6).alias(c) for c in ("l", "a", "b", "aspect_ratio")), F.round("span_minutes", 4).alias("span_minutes"), "label",
        labels.theme_title(F.col("cluster"), F.col("n")).alias("title"),
    )


def _foldered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features in ten folders, by label."""
    return adapters.image_features(spark, sf_dir).withColumn("folder", F.concat(F.lit("folder_"), F.col("label").cast("string")))


def _apart(v: str, bits: str, palette: str, c: str) -> str:
    """SQL of the combined distance between a row (raw values, bits, palette) and the cluster ``c``, deviations in ``std``."""
    square = " + ".join(f"{w} * pow(({v}[{k}] - {c}.sums[{k}] / {c}.n) / std[{k}], 2)" for k, w in enumerate(CONFIG.weights, 1))
    hamming = f"list_sum(list_transform(range(1, 65), lambda i: ({bits}[i::INT] <> {c}.bits[i::INT])::INT)) / 64.0"
    colour = " + ".join(f"pow({palette}[k::INT][{i}] - {c}.palette[k::INT][{i}], 2)" for i in (1, 2, 3))
    return f"(sqrt({square}) + {hamming} * {CONFIG.phash_weight} + list_sum(list_transform(range(1, 9), lambda k: sqrt({colour}))) / 800 * {CONFIG.palette_weight})"


def _machine(seq: str, floor: float, select: str) -> str:
    """SQL of leader clustering as a recursion over rows in order of ``seq``: one step a row, all folders at once.

    A step's state is the running statistics, the clusters in list order and the
    next id; its event is the cluster that the row went to and the one that was folded in.
    """
    merged = "{'id': c.id, 'bits': c.bits, 'palette': c.palette, 'sums': list_transform(range(1, 6), lambda k: c.sums[k::INT] + %s[k::INT]), 'n': c.n + %s}"
    place = "list_filter(range(1, len(d) + 1), lambda j: d[j::INT] = list_min(d))[1]::INT"
    return f"""WITH RECURSIVE {_FEATS},
placed AS (SELECT *, row_number() OVER w AS place, count(*) OVER (PARTITION BY label) AS total FROM raw WINDOW w AS (PARTITION BY label ORDER BY time, 'img_' || id || '.jpg')),
numbered AS (SELECT 'folder_' || label AS folder, id, ({seq})::BIGINT AS seq, [time, l, a, b, r] AS v, bits, palette FROM placed),
ordered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY seq) AS step FROM numbered),
run AS (
  SELECT DISTINCT folder, 0::BIGINT AS step, 0::BIGINT AS id, 0::BIGINT AS seq, 0::BIGINT AS home, 0::BIGINT AS gone, [0, 0, 0, 0, 0]::DOUBLE[] AS mean, [0, 0, 0, 0, 0]::DOUBLE[] AS m2,
    1::BIGINT AS next_id, []::STRUCT(id BIGINT, bits INT[], palette DOUBLE[][], sums DOUBLE[], n DOUBLE)[] AS clusters FROM ordered
  UNION ALL
  SELECT folder, step, id, seq, home, coalesce(moved[near].id, 0) AS gone, mean, m2, next_id,
    CASE WHEN near IS NULL THEN moved ELSE list_filter(list_transform(range(1, len(moved) + 1), lambda j: CASE WHEN j = best THEN list_transform([moved[best]], lambda c: {merged % ("moved[near].sums", "moved[near].n")})[1] WHEN j <> near THEN moved[j::INT] END), lambda c: c IS NOT NULL) END AS clusters
  FROM (
    SELECT *, CASE WHEN joined THEN list_filter(range(1, len(moved) + 1), lambda j: j <> best AND {_apart("list_transform(range(1, 6), lambda k: moved[best].sums[k::INT] / moved[best].n)", "moved[best].bits", "moved[best].palette", "moved[j::INT]")} <= {leader.MERGE_FACTOR * CONFIG.eps})[1]::INT END AS near
    FROM (
      SELECT * EXCLUDE (clusters, next_id), CASE WHEN joined THEN clusters[best].id ELSE next_id END AS home, CASE WHEN joined THEN next_id ELSE next_id + 1 END AS next_id,
        CASE WHEN joined THEN list_transform(range(1, len(clusters) + 1), lambda j: CASE WHEN j = best THEN list_transform([clusters[best]], lambda c: {merged % ("v", "1")})[1] ELSE clusters[j::INT] END)
        ELSE list_append(clusters, {{'id': next_id, 'bits': bits, 'palette': palette, 'sums': v, 'n': 1::DOUBLE}}) END AS moved
      FROM (
        SELECT *, {place} AS best, coalesce(list_min(d) <= {CONFIG.eps}, false) AS joined
        FROM (
          SELECT *, list_transform(clusters, lambda c: {_apart("v", "bits", "palette", "c")}) AS d
          FROM (
            SELECT *, list_transform(range(1, 6), lambda k: CASE WHEN step < 2 THEN 1 ELSE greatest(sqrt(m2[k::INT] / step), {max(floor, 1e-9)}) END) AS std
            FROM (
              SELECT * EXCLUDE (old, m2), list_transform(range(1, 6), lambda k: m2[k::INT] + (v[k::INT] - old[k::INT]) * (v[k::INT] - mean[k::INT])) AS m2
              FROM (
                SELECT o.*, run.next_id, run.clusters, run.m2, run.mean AS old, list_transform(range(1, 6), lambda k: run.mean[k::INT] + (o.v[k::INT] - run.mean[k::INT]) / o.step) AS mean
                FROM run JOIN ordered o ON o.folder = run.folder AND o.step = run.step + 1)))))))
),
ends AS (
  SELECT DISTINCT folder, home, home AS cluster FROM run WHERE step > 0
  UNION ALL SELECT e.folder, e.home, f.home FROM ends e JOIN run f ON f.folder = e.folder AND f.gone = e.cluster AND f.step > 0
),
found AS (SELECT r.folder, r.id, r.seq, max_by(e.cluster, e.depth) AS cluster FROM run r JOIN (SELECT e.*, (SELECT count(*) FROM run f WHERE f.folder = e.folder AND f.gone = e.cluster AND f.step > 0) = 0 AS depth FROM ends e) e USING (folder, home) WHERE r.step > 0 GROUP BY r.folder, r.id, r.seq)
{select}"""


@query(_machine("place", CONFIG.std_floor, "SELECT folder, id, seq, cluster FROM found"))
def leader_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leader.naive(_foldered(spark, sf_dir), CONFIG, "folder", ["time", "path"])


@query(_machine("CASE WHEN place = 1 THEN -3 WHEN place = total THEN -2 WHEN place = total // 2 + 1 THEN -1 ELSE place END", 0.1, "SELECT folder, id, seq, cluster FROM found"))
def champion_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leader.champion(_foldered(spark, sf_dir), CONFIG, "folder", ["time", "path"])


_COUNTS = "SELECT folder, count(DISTINCT cluster) AS k FROM found GROUP BY folder"
_STUDY = " UNION ALL ".join(
    f"SELECT '{name}' AS algorithm, * FROM ({_machine(seq, floor, _COUNTS)})"
    for name, seq, floor in (
        ("Naive Streaming Leader", "place", CONFIG.std_floor),
        ("Champion-Initialized Streaming", "CASE WHEN place = 1 THEN -3 WHEN place = total THEN -2 WHEN place = total // 2 + 1 THEN -1 ELSE place END", 0.1),
    )
)


@query(f"""WITH {_FEATS}, spread AS (SELECT 'folder_' || label AS folder, count(*) AS n, 0.1 * stddev_pop(time) / 86400 + stddev_pop(l) / 100 + stddev_pop(a) / 128 + stddev_pop(b) / 128 + stddev_pop(r) / 2 AS h FROM raw GROUP BY label),
study AS ({_STUDY}), s AS (SELECT folder, n, h, algorithm, 128.0::DOUBLE * k / 1048576 AS mem, k FROM study JOIN spread USING (folder))
SELECT folder || ',' || n || ',' || format('{{:.4f}}', h) || ',' || algorithm || ',' || format('{{:.3f}}', mem) || ',' || k AS csv,
  '{{"Dataset Name":"' || folder || '","Image Count":' || n || ',"Heterogeneity Rate":' || round(h, 4) || ',"Algorithm":"' || algorithm || '","Peak Mem (MB)":' || round(mem, 3) || ',"Cluster Count":' || k || '}}' AS json,
  '| ' || folder || ' | ' || n || ' | ' || format('{{:.4f}}', h) || ' | ' || algorithm || ' | ' || format('{{:.3f}}', mem) || ' | ' || k || ' |' AS markdown FROM s""")
def folder_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The study's report over ten folders, in its three forms."""
    return reports.as_lines(reports.folder_study(_foldered(spark, sf_dir), CONFIG, "folder", ["time", "path"]))


@query(_machine("place", CONFIG.std_floor, "SELECT folder, cluster, count(*) AS n, count(*) || ' images' AS label FROM found GROUP BY folder, cluster"))
def leader_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leader.snapshot(leader_clusters(spark, sf_dir), "folder")


@query(_machine("place", CONFIG.std_floor, "SELECT folder, id, cluster FROM found"))
def table_function_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``leader_clusters`` by SQL text: the algorithm is a table function that Spark partitions and orders for."""
    table_function.register(spark)
    settings = ", ".join(f"{k} => {getattr(CONFIG, k)}D" for k in table_function.SETTINGS if k != "std_floor")
    return spark.sql(f"SELECT * FROM cluster_rows(TABLE({{rows}}), algorithm => 'leader', {settings})", rows=_foldered(spark, sf_dir))


@query(f"""WITH {_FEATS}, s AS (SELECT avg(time) AS mt, greatest(stddev_pop(time), 1e-9) AS st, avg(l) AS ml, greatest(stddev_pop(l), 1e-9) AS sl, avg(a) AS ma, greatest(stddev_pop(a), 1e-9) AS sa,
  avg(b) AS mb, greatest(stddev_pop(b), 1e-9) AS sb, avg(r) AS mr, greatest(stddev_pop(r), 1e-9) AS sr FROM raw),
cents AS (SELECT label::BIGINT AS cluster, avg(time) AS time, avg(l) AS l, avg(a) AS a, avg(b) AS b, avg(r) AS r, min_by(bits, id) AS bits, min_by(palette, id) AS palette FROM raw GROUP BY label),
d AS (SELECT x.id, y.cluster, sqrt({CONFIG.weights[0]} * pow((x.time - y.time) / st, 2) + {CONFIG.weights[1]} * (pow((x.l - y.l) / sl, 2) + pow((x.a - y.a) / sa, 2) + pow((x.b - y.b) / sb, 2)) + 0.2 * pow((x.r - y.r) / sr, 2))
  + {_HAMMING} / 64.0 * {CONFIG.phash_weight} + {_PALETTE} * {CONFIG.palette_weight} AS d FROM raw x CROSS JOIN cents y CROSS JOIN s)
SELECT id, cluster, round(d, 6) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, cluster) = 1""")
def nearest_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every image's nearest centroid, the centroids being those of the ten labels."""
    rows = adapters.image_features(spark, sf_dir)
    found = assign.assign(rows, assign.centroids_of(rows, "label"), CONFIG)
    return found.select("id", "cluster", F.round("distance", 6).alias("distance"))


def _stream(spark: SparkSession, sf_dir: str) -> tuple[str, ProgressLog]:
    """The table and the reports of a stream over the features in several files, stopped and started again on the way."""
    rows = leader.sequenced(_foldered(spark, sf_dir), "folder", ["time", "path"], champions=False)
    sizes = rows.groupBy("folder").agg(F.count(F.lit(1)).alias("total"))
    rows = stored(rows.join(sizes, "folder").select("folder", "id", "seq", *FEATURE_COLUMNS, "total"), "stream-rows")
    root = f"{own_folder(spark)}/stream-{uuid.uuid4().hex}"
    part = F.least(F.col("seq") * STREAM_FILES / (F.col("total") + 1), F.lit(STREAM_FILES - 1)).cast("int")
    dealt = rows.withColumn("part", part)
    log = ProgressLog(spark, f"{root}/reports")
    with log:
        for k in range(STREAM_FILES):  # files arrive one after another, as they would from a scan
            dealt.where(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(f"{root}/in")
            if k != 1:  # the second start finds two files
                log.wait(leader_stream.start(spark, f"{root}/in", rows.schema, CONFIG, f"{root}/out", f"{root}/checkpoint"))
    return f"{root}/out", log


@query(_machine("place", CONFIG.std_floor, "SELECT folder, id, cluster FROM found"))
def stream_leader_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch result of ``leader_clusters``, by a stream over the same rows in several files."""
    return leader_stream.resolved(leader_stream.events(spark, _stream(spark, sf_dir)[0]))


@query(_machine("place", CONFIG.std_floor, "SELECT folder, cluster, count(*) AS n, count(*) || ' images' AS label FROM found GROUP BY folder, cluster"))
def stream_live_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stream shows in the end: the clusters of ``leader_snapshot``, each replaced whenever it changed."""
    return leader_stream.live_view(spark, _stream(spark, sf_dir)[0])


@query(f"""WITH {_FEATS}, placed AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY time, id) AS seq, count(*) OVER (PARTITION BY label) AS n FROM raw),
batches AS (SELECT least(seq * {STREAM_FILES} // (n + 1), {STREAM_FILES - 1})::BIGINT AS batch, count(*) AS extracted FROM placed GROUP BY 1)
SELECT batch, extracted, sum(extracted) OVER (ORDER BY batch)::BIGINT AS done, sum(extracted) OVER ()::BIGINT AS total, round(100.0 * sum(extracted) OVER (ORDER BY batch) / sum(extracted) OVER (), 4) AS percent FROM batches""")
def stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the stream is after each micro-batch, by what a listener wrote of it."""
    return progress(_stream(spark, sf_dir)[1].read())


#: Event time: spans of arrival, what the watermark allows for (two spans of 432,000 s), and the windows.
SPANS, SPAN_S, ALLOWANCE_S = 6, 432_000, 864_000
#: Tasks that hold open windows: some hundred windows of a few event types.
OPEN_WINDOW_TASKS = 8
EVENT_WINDOWS = (windows.Windows("tumbling", "6 hours"), windows.Windows("sliding", "2 days", "1 day"), windows.Windows("session", "20 minutes"))
#: Arrivals in SQL: a tenth of the rows one span late (in time), a tenth of the first two spans four spans late (too late), some delivered again.
_ARRIVED = f"""timed AS (SELECT event_id, event_type, value, ts, least((epoch_us(ts) - min(epoch_us(ts)) OVER ()) // {SPAN_S * 1_000_000}, {SPANS - 1}) AS span FROM events),
placed AS (SELECT *, CASE WHEN event_id % 10 = 3 THEN least(span + 1, {SPANS - 1}) WHEN event_id % 10 = 7 AND span < 2 THEN span + 4 ELSE span END AS batch FROM timed),
arrived AS (SELECT * FROM placed UNION ALL SELECT * REPLACE (batch + 1 AS batch) FROM placed WHERE event_id % 11 = 0 AND batch < {SPANS - 1}),
marks AS (SELECT batch, max(max(epoch_ms(ts))) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - {ALLOWANCE_S * 1000} AS mark FROM arrived GROUP BY batch),
marked AS (SELECT a.*, coalesce(epoch_us(ts) <= mark * 1000, false) AS late FROM arrived a JOIN marks USING (batch)),
kept AS (SELECT event_id, any_value(event_type) AS event_type, any_value(value) AS value, any_value(ts) AS ts FROM marked WHERE NOT late GROUP BY event_id),
ending AS (SELECT max(epoch_ms(ts)) - {ALLOWANCE_S * 1000} AS mark FROM arrived)"""


def _arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` with the ``batch`` in which each row arrives: most in order, some late in time, some too late, some twice."""
    rows = read_table(spark, sf_dir, "events").select("event_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"))
    first = rows.agg(F.min(F.unix_micros("ts")).alias("first"))
    span = F.least(F.floor((F.unix_micros("ts") - F.col("first")) / F.lit(SPAN_S * 1_000_000)), F.lit(SPANS - 1)).cast("int")
    timed = rows.join(F.broadcast(first)).withColumn("span", span).drop("first")
    late = F.when(F.col("event_id") % 10 == 3, F.least(F.col("span") + 1, F.lit(SPANS - 1))).when((F.col("event_id") % 10 == 7) & (F.col("span") < 2), F.col("span") + 4).otherwise(F.col("span"))
    placed = timed.withColumn("batch", late).drop("span")
    return stored(placed.unionByName(placed.where((F.col("event_id") % 11 == 0) & (F.col("batch") < SPANS - 1)).withColumn("batch", F.col("batch") + 1)), "arrivals")


def _windowed(spark: SparkSession, sf_dir: str, chosen: tuple[windows.Windows, ...]) -> tuple[str, ProgressLog]:
    """The table of the windows that closed, and the reports of the stream that sees all arrivals; every arrival is a start from the checkpoints."""
    arrived = _arrivals(spark, sf_dir)
    schema, allowance = arrived.drop("batch").schema, f"{ALLOWANCE_S} seconds"
    root = f"{own_folder(spark)}/windows-{uuid.uuid4().hex}"
    log = ProgressLog(spark, f"{root}/reports")
    for k in range(SPANS):
        arrived.where(F.col("batch") == k).drop("batch").write.mode("append").parquet(f"{root}/in")
        with log:
            log.wait(windows.start_timely(spark, f"{root}/in", schema, allowance, f"{root}/kept", f"{root}/checkpoint-kept"))
        if chosen:
            windows.start_windows(spark, f"{root}/kept", schema, chosen, allowance, f"{root}/out", f"{root}/checkpoint-out", OPEN_WINDOW_TASKS).awaitTermination()
    return f"{root}/out", log


@query(f"""WITH {_ARRIVED},
flat AS (
  SELECT 'tumbling' AS kind, event_type, value, time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS s, time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') + INTERVAL 6 HOURS AS e FROM kept
  UNION ALL SELECT 'sliding', event_type, value, date_trunc('day', ts) - to_days(k), date_trunc('day', ts) - to_days(k) + INTERVAL 2 DAYS FROM kept, (VALUES (0), (1)) AS back(k)),
opened AS (SELECT *, coalesce(ts > lag(ts) OVER w + INTERVAL 20 MINUTES, true) AS opens FROM kept WINDOW w AS (PARTITION BY event_type ORDER BY ts)),
numbered AS (SELECT *, sum(opens::INT) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM opened),
whole AS (
  SELECT kind, s, e, event_type, count(*) AS n, sum(value) AS total FROM flat GROUP BY ALL
  UNION ALL SELECT 'session', min(ts), max(ts) + INTERVAL 20 MINUTES, event_type, count(*), sum(value) FROM numbered GROUP BY event_type, session)
SELECT kind, epoch_us(s) AS start_us, epoch_us(e) AS end_us, event_type, n, round(total, 4) AS total FROM whole, ending WHERE epoch_us(e) <= mark * 1000""")
def stream_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling, sliding and session windows of event time that closed over a stream with late and repeated rows."""
    found = spark.read.parquet(_windowed(spark, sf_dir, EVENT_WINDOWS)[0])
    return found.select("kind", F.unix_micros("window_start").alias("start_us"), F.unix_micros("window_end").alias("end_us"), "event_type", "n", F.round("total", 4).alias("total"))


@query(f"""WITH {_ARRIVED}, counted AS (SELECT batch::BIGINT AS arrival, count(*) AS n_rows, count(*) FILTER (WHERE late) AS n_late FROM marked GROUP BY 1)
SELECT arrival, n_rows, n_late, sum(n_rows) OVER (ORDER BY arrival)::BIGINT AS done FROM counted""")
def stream_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each arrival, those among them that came after the watermark, and all rows so far, as the listener wrote them."""
    log = _windowed(spark, sf_dir, ())[1]
    reports = prefix.running_sums(log.read().where("rows > 0").withColumn("one", F.lit(1)), "one", "batch", "rows")
    return prefix.places(reports, "one", ["batch"], "arrival").select((F.col("arrival") - 1).alias("arrival"), F.col("rows").alias("n_rows"), F.col("late").alias("n_late"), F.col("sum").alias("done"))


@query()
def benchmark_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published benchmark over generated data; it reads no table."""
    return reports.as_strings(reports.benchmark(spark)).drop("Time (ms)")
