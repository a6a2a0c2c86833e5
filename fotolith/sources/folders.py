"""Folders as a data source: each task lists its share of a root's subfolders, the driver lists nothing.

    spark.read.format("folders").option("path", root).option("depth", 2).option("inside", "2024").option("kind", "files").load()

A root has a fixed number of partitions. A partition reads the root's names, keeps
the subfolders whose name falls to it, and lists those, down to ``depth`` levels; the first
partition also gives the root's own entries. Conditions are options of a load and are applied while listing: a folder that
they rule out is not opened. (They are no pushed filters: Spark 4.1 keeps one list of those for all uses of a frame, so
that two branches with different conditions would both read with the last one's.)
Rows are those of one folder level below another, as a file manager shows them: folders have size 0.
A folder that is missing or may not be read has no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from fotolith.session import send_package

LISTED = "folder string, path string, name string, size long, modified timestamp, is_dir boolean"
#: Partitions of a root, rows of a batch.
PARTITIONS, BATCH_ROWS = 32, 4096

@dataclass
class Share(InputPartition):
    number: int


class FolderReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.depth, self.shares = options["path"].rstrip("/"), int(options.get("depth", 1)), int(options.get("partitions", PARTITIONS))
        #: Folders at or below this one, entries of this kind (files, folders or all), names with one of these ends.
        self.inside, self.kind = options.get("inside", "").strip("/"), options.get("kind", "all")
        self.ends = tuple(x.lower() for x in options.get("ends", "").split(",") if x)

    def partitions(self) -> list[InputPartition]:
        return [Share(i) for i in range(self.shares)]

    def wanted(self, folder: str) -> bool:
        return not self.inside or folder == self.inside or folder.startswith(f"{self.inside}/")

    def leads(self, folder: str) -> bool:
        """The folder, or one below it, may be wanted."""
        return self.wanted(folder) or self.inside.startswith(f"{folder}/")

    def passes(self, name: str, is_dir: bool) -> bool:
        return self.kind in ("all", "folders" if is_dir else "files") and (is_dir or not self.ends or name.lower().endswith(self.ends))

    def entries(self, store: fs.FileSystem, folder: str) -> list[fs.FileInfo]:
        try:
            return sorted(store.get_file_info(fs.FileSelector(folder)), key=lambda e: e.base_name)
        except (FileNotFoundError, NotADirectoryError, PermissionError):
            return []

    def listed(self, store: fs.FileSystem, base: str, share: Share) -> Iterator[tuple]:
        """Rows of this share: the root's own with the first, then those of its subfolders."""
        top = self.entries(store, base)
        mine = [e.base_name for e in top if e.type == fs.FileType.Directory and zlib.crc32(e.base_name.encode()) % self.shares == share.number]
        todo = [(name, 1, None) for name in reversed(mine) if self.leads(name)] if self.depth > 1 else []
        if share.number == 0:
            todo.append(("", 0, top))
        while todo:
            folder, level, found = todo.pop()
            for e in self.entries(store, f"{base}/{folder}") if found is None else found:
                is_dir = e.type == fs.FileType.Directory
                below = f"{folder}/{e.base_name}" if folder else e.base_name
                if is_dir and 0 < level < self.depth - 1 and self.leads(below):
                    todo.append((below, level + 1, None))
                if self.wanted(folder) and self.passes(e.base_name, is_dir):
                    yield folder, f"{self.root}/{below}", e.base_name, 0 if is_dir else e.size, e.mtime, is_dir

    def read(self, share: Share) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(self.root)
        held: list[tuple] = []
        kind = pa.schema([("folder", pa.string()), ("path", pa.string()), ("name", pa.string()), ("size", pa.int64()), ("modified", pa.timestamp("us", "UTC")), ("is_dir", pa.bool_())])
        for row in self.listed(store, base, share):
            held.append(row)
            if len(held) == BATCH_ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), kind)], schema=kind)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), kind)], schema=kind)


class FolderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folders"

    def schema(self) -> str:
        return LISTED

    def reader(self, schema) -> DataSourceReader:
        return FolderReader(dict(self.options))


def scan(spark: SparkSession, root: str, depth: int = 1, **conditions: str) -> DataFrame:
    """``LISTED`` rows of a root and ``depth - 1`` levels of folders below it; ``folder`` is relative to the root.

    Conditions: ``inside`` (a folder), ``kind`` (files, folders), ``ends`` (of file names, comma-joined).
    """
    send_package(spark)
    spark.dataSource.register(FolderSource)
    return spark.read.format("folders").options(path=root, depth=depth, **conditions).load()
