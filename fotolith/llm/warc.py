"""WARC archives in Zstandard, written and read back.

An archive starts with a skippable frame (magic ``0x184D2A5D``) that holds its
dictionary; each record follows in a frame of its own. The reader loads that
dictionary, walks the frames by their block headers, decodes one frame for each
record and validates version line, mandatory headers, lengths and digest; any
breach raises ``ValueError``.

Archives are rows ``(archive, records, content)``, so that they lie in any store
that Spark writes to; the reader takes such rows as well as those of
``spark.read.format("binaryFile")`` over ``*.warc.zst`` files.

Records with equal payloads of at least ``min_bytes`` are stored once: the row
with the least page_id is a ``response``, the others are ``revisit`` records that
refer to it. Rows that repeat that page_id are responses too. Null html is an
empty payload, a null url an empty one; a null page_id is kept and refers to the
least page_id of its payload. Line breaks and other control characters of a url
are percent-encoded. Extra columns are not read; an empty table gives no archive.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fotolith.llm.common import prepare, sided

#: Fixed values of the formats.
SKIPPABLE, FRAME = 0x184D2A5D, 0xFD2FB528
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NEEDED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length", "WARC-Payload-Digest")

#: An archive ends at this many bytes of records.
ARCHIVE_BYTES = 8 << 20
LEVEL = 3
#: The dictionary: its size, and the records at the archive's start that it is trained on.
DICT_BYTES, DICT_SAMPLES, SAMPLE_BYTES = 16 << 10, 48, 4 << 10
DATE = "1970-01-01T00:00:00Z"
PAGE_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")

PAGE = "page_id long, uri string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(PAGE_SPACE, f'page:{page_id}')}>"


def make_record(page_id: int | None, url: str, payload: bytes, digest: str, first: int | None, response: bool) -> bytes:
    """One WARC record; a revisit keeps the head of the HTTP message only."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    size = len(head) + len(payload) * response
    fields = [
        ("WARC-Type", "response" if response else "revisit"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", DATE),
        ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", size), ("X-Payload-Length", len(payload)), ("X-Page-ID", "" if page_id is None else page_id),
    ]
    if not response:
        fields += [("WARC-Refers-To", record_id(first)), ("WARC-Profile", PROFILE), ("X-Refers-To-Page-ID", "" if first is None else first)]
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "surrogatepass")
    return b"".join([VERSION, b"\r\n", lines, b"\r\n", head, payload if response else b"", b"\r\n\r\n"])


def train(records: list[bytes]) -> bytes:
    """A dictionary from the first records of an archive; empty where they are too few."""
    samples = [r[:SAMPLE_BYTES] for r in records[:DICT_SAMPLES]]
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b""


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


def make_archive(records: list[bytes]) -> bytes:
    raw = train(records)
    press = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(raw), write_content_size=True, write_checksum=True)
    return b"".join([struct.pack("<II", SKIPPABLE, len(raw)), raw, *map(press.compress, records)])


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame at ``at`` ends, by its block headers."""
    start = bytes(data[at : at + 18])
    checksum = zstandard.get_frame_parameters(start).has_checksum
    at += zstandard.frame_header_size(start)
    while True:
        if at + 3 > len(data):
            raise ValueError("warc: a frame is cut off")
        block = int.from_bytes(data[at : at + 3], "little")
        at += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        if block & 1:
            break
    at += 4 * checksum
    if at > len(data):
        raise ValueError("warc: a frame is cut off")
    return at


def records_of(content: bytes) -> Iterator[bytes]:
    """The records of an archive, one decoded frame at a time."""
    data = memoryview(content)
    if len(data) < 8:
        raise ValueError("warc: no leading frame")
    magic, size = struct.unpack("<II", data[:8])
    if magic != SKIPPABLE or 8 + size > len(data):
        raise ValueError("warc: the archive does not start with a whole dictionary frame")
    raw, at = bytes(data[8 : 8 + size]), 8 + size
    if raw[:4] == struct.pack("<I", FRAME):
        raw = zstandard.ZstdDecompressor().decompress(raw)
    open_frame = zstandard.ZstdDecompressor(dict_data=_dictionary(raw))
    while at < len(data):
        end = frame_end(data, at)
        yield open_frame.decompress(data[at:end])
        at = end


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def read_record(record: bytes) -> tuple:
    """A row of ``PAGE`` from one validated record."""
    cut = record.find(b"\r\n\r\n")
    lines = record[:cut].split(b"\r\n") if cut >= 0 else [b""]
    if not re.fullmatch(rb"WARC/1\.[01]", lines[0]):
        raise ValueError("warc: no version line")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.decode("utf-8", "surrogatepass").partition(":")
        if not colon or name in fields:
            raise ValueError("warc: a broken or repeated header")
        fields[name] = value.strip()
    if missing := [n for n in NEEDED if n not in fields]:
        raise ValueError(f"warc: headers are missing: {missing}")
    size = fields["Content-Length"]
    block = record[cut + 4 : -4]
    if not size.isdigit() or len(block) != int(size) or record[-4:] != b"\r\n\r\n":
        raise ValueError("warc: Content-Length does not match the record")
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    number = lambda x: int(x) if x else None
    page, uri = number(fields.get("X-Page-ID", "")), fields.get("WARC-Target-URI", "")
    head = block.find(b"\r\n\r\n")
    if head < 0:
        raise ValueError("warc: no HTTP head")
    payload = block[head + 4 :]
    if kind == "response":
        if base32_sha1(payload) != digest:
            raise ValueError("warc: the payload does not match its digest")
        if int(fields.get("X-Payload-Length", len(payload))) != len(payload):
            raise ValueError("warc: the payload does not match its length")
        return page, uri, kind, payload, len(payload), digest, None
    if kind != "revisit" or payload or "WARC-Refers-To" not in fields:
        raise ValueError("warc: an unknown or broken record type")
    return page, uri, kind, None, int(fields["X-Payload-Length"]), digest, number(fields["X-Refers-To-Page-ID"])


def write_archives(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``archive, records, content`` over ``pages(page_id, url, html)``.

    The least page_id of each payload that several pages have is found by a map-side
    combined aggregation of digests. Pages stay where they are read as long as
    those digests may be broadcast; beyond that they join by a shuffle on the digest, where
    adaptive execution splits a payload that a large share of the pages has.
    """
    spark = prepare(pages.sparkSession)
    pages = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    pages = pages.withColumn("sha1", F.unhex(F.sha1("html")))
    shared = pages.groupBy("sha1").agg(F.min("page_id").alias("least"), F.count(F.lit(1)).alias("k")).where("k > 1")
    joined = pages.join(sided(shared), "sha1", "left").withColumn("first", F.when(F.col("k").isNull(), F.col("page_id")).otherwise(F.col("least")))
    response = F.col("page_id").eqNullSafe(F.col("first")) | (F.octet_length("html") < min_bytes)
    joined = joined.select("page_id", "url", "html", "sha1", "first", response.alias("response"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held: list[bytes] = []
        size = made = 0

        def flush() -> pa.RecordBatch:
            nonlocal made
            made += 1
            name = f"pages-{part:06d}-{made:06d}.warc.zst"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(held)], pa.int64()), pa.array([make_archive(held)], pa.binary())], names=["archive", "records", "content"])

        for batch in batches:
            for page_id, url, html, sha1, first, own in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(make_record(page_id, url, html.encode("utf-8", "surrogatepass"), base64.b32encode(sha1).decode(), first, own))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return joined.mapInArrow(run, "archive string, records long, content binary")


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """The records (``PAGE``) of archives in the column ``content``.

    ``payloads=False`` validates payloads as always but leaves them out of the rows.
    """
    spark = prepare(archives.sparkSession)
    types = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64()]
    names = PAGE.replace(",", "").split()[::2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows: list[tuple] = []
                size = 0

                def flush() -> pa.RecordBatch:
                    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

                for record in records_of(content.as_py()):
                    row = read_record(record)
                    rows.append(row if payloads else (*row[:3], None, *row[4:]))
                    size += len(record)
                    if size >= ARCHIVE_BYTES // 2:
                        yield flush()
                        rows, size = [], 0
                if rows:
                    yield flush()

    # An archive is large, so few of them make one Arrow batch.
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_CONTENT))
    return archives.select("content").mapInArrow(run, PAGE)


#: Bytes of one Arrow batch of archives.
BATCH_CONTENT = 16 << 20
