"""Secret scans over an incremental ledger of blobs.

Every version of a text is known by its content: the SHA-256 of its bytes. A ledger
holds, for each blob and each pack of rules in its version, the spans that were
found, those of blobs without a finding too. A scan names the versions, asks the
ledger which pairs of blob and pack it has not seen, reads only one text for each of
those, appends what it finds as one increment, and joins the findings back to every
version that has the blob. So a copy is never scanned again, whatever path or date it
comes under, and a new version of a pack scans every blob for that pack alone.

Texts are not shuffled while the blobs to scan fit a broadcast (checked); beyond that
they move once, to the place of their blob's first version. An increment counts once
its writer has marked it whole, so a run that breaks off is scanned again.

Defined results: a null text is the empty blob; a null key is a version like any
other; repeated rows give repeated results; of an empty table nothing comes out and
the ledger gets an empty increment; only the key and the text are read, so further columns
of any name do no harm. Ends are exclusive and count code points.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fotolith.llm.common import Scratch, prepare, sided, tidied
from fotolith.session import delete_at_exit

SPANS = "array<struct<kind:string,start:long,end:long>>"
LEDGER = f"blob binary, pack string, spans {SPANS}"


@dataclass(frozen=True)
class Rule:
    """``kind`` of the spans of ``pattern`` (ASCII letters only where case is ignored) whose ``group`` has ``least`` code points."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0


@dataclass(frozen=True)
class Pack:
    """Rules that change together; another version is scanned anew."""

    name: str
    version: int
    rules: tuple[Rule, ...]

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"


#: The patterns and lengths of the contract.
BASE = Pack("base", 1, (
    Rule("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 8, 2),
    # A run that is too short holds no other match that is long enough, so the least length stands in the pattern.
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
))
#: What the method adds: keys by the public marks of those who issue them, and key blocks.
ISSUED = Pack("issued", 1, (
    Rule("hosting", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{15,}"),
    Rule("maps", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("block", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END [A-Z ]*PRIVATE KEY-----)?"),
))
PACKS = (BASE, ISSUED)


def kinds(packs: tuple[Pack, ...] = PACKS) -> list[str]:
    """All kinds, as listed."""
    return [r.kind for p in packs for r in p.rules]


def compiled(pack: Pack) -> list[tuple[Rule, re.Pattern]]:
    return [(r, re.compile(r.pattern, re.ASCII)) for r in pack.rules]


def spans(text: str, rules: list[tuple[Rule, re.Pattern]]) -> list[dict]:
    """Spans of one text, rule by rule: leftmost matches that do not overlap, without those that are too short."""
    return [
        {"kind": rule.kind, "start": m.start(), "end": m.end()}
        for rule, pattern in rules for m in pattern.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least
    ]


class Ledger:
    """Increments of ``LEDGER`` rows in a shared folder; it may be kept from scan to scan."""

    def __init__(self, spark: SparkSession, root: str, keep: bool = True):
        self.spark, self.root = spark, root.rstrip("/")
        if not keep:
            delete_at_exit(spark, self.root)

    def increments(self) -> list[str]:
        """Folders whose writers came to their end."""
        marks = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/increment-*/_SUCCESS")
        found = marks.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(marks) or ()
        return sorted(s.getPath().getParent().toString() for s in found)

    def read(self) -> DataFrame:
        found = self.increments()
        return self.spark.read.schema(LEDGER).parquet(*found) if found else self.spark.createDataFrame([], LEDGER)

    def append(self, rows: DataFrame) -> None:
        rows.write.option("compression", "zstd").parquet(f"{self.root}/increment-{uuid.uuid4().hex}")


def versions(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``key, text, blob``: each version with its content address."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return rows.select(F.col(key).alias("key"), whole.alias("text"), F.unhex(F.sha2(whole, 256)).alias("blob"))


def unseen(named: DataFrame, ledger: Ledger, packs: tuple[Pack, ...]) -> DataFrame:
    """``first, tag, mask``: a version of every blob that some pack (a bit each) has not been over."""
    bit = F.coalesce(*(F.when(F.col("pack") == p.key, F.lit(1 << i)) for i, p in enumerate(packs)), F.lit(0))
    seen = ledger.read().groupBy("blob").agg(F.bit_or(bit.cast("long")).alias("seen"))
    # The least key, so that one text stands for the blob; a null key stands where there is no other.
    blobs = named.groupBy("blob").agg(F.min("key").alias("first"))
    mask = F.lit((1 << len(packs)) - 1).cast("long").bitwiseAND(F.bitwise_not(F.coalesce("seen", F.lit(0).cast("long"))))
    return blobs.join(seen, "blob", "left").select("first", F.xxhash64("blob").alias("tag"), mask.alias("mask")).where("mask <> 0")


def search(rows: DataFrame, packs: tuple[Pack, ...]) -> DataFrame:
    """``LEDGER`` rows of ``rows(blob, text, mask)``."""
    prepare(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = [compiled(p) for p in packs]
        for batch in batches:
            blobs, names, found = [], [], []
            for blob, text, mask in zip(*(c.to_pylist() for c in batch.columns)):
                for i, p in enumerate(packs):
                    if mask >> i & 1:
                        blobs.append(blob)
                        names.append(p.key)
                        found.append(spans(text, rules[i]))
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.binary()), pa.array(names, pa.string()), pa.array(found, kind)], names=["blob", "pack", "spans"])

    return rows.select("blob", "text", "mask").mapInArrow(tidied(run), LEDGER)


def scan(rows: DataFrame, ledger: Ledger, scratch: Scratch, packs: tuple[Pack, ...] = PACKS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, blob, spans`` of every row, by start and then kind as listed; the ledger grows by what was not in it."""
    prepare(rows.sparkSession)
    named = scratch.write(versions(rows, key, text).drop("text"), "versions")
    todo = scratch.write(unseen(named, ledger, packs), "unseen")
    own = versions(rows, key, text)
    # A tag that two texts of one key share only means that both are scanned: spans go by the blob itself.
    met = own.join(sided(todo), own["key"].eqNullSafe(todo["first"]) & (F.xxhash64(own["blob"]) == todo["tag"]))
    ledger.append(search(met, packs))
    return named.join(sided(findings(ledger, packs)), "blob", "left").select("key", "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans")).withColumnRenamed("key", key)


def findings(ledger: Ledger, packs: tuple[Pack, ...]) -> DataFrame:
    """``blob, spans`` of the blobs with findings under these packs; equal rows of broken or parallel scans count once."""
    order = F.create_map(*(F.lit(x) for i, k in enumerate(kinds(packs)) for x in (k, i)))
    rows = ledger.read().where(F.col("pack").isin([p.key for p in packs]) & (F.size("spans") > 0)).dropDuplicates(["blob", "pack"])
    placed = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("place"), s["end"].alias("end"), s["kind"].alias("kind")))
    whole = rows.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list(placed))).alias("s"))  # one row a pack
    return whole.select("blob", F.transform("s", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))


def listed(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kind(spans: Column, *wanted: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*wanted))
