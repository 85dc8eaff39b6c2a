"""Legacy archives (ARC 1 and 2) to WARC 1.1, and WARC back to rows.

A reader walks an ARC file by its version block, header lines and declared lengths. The
converter makes a WARC record of each: an identifier from a whole-number key (or from the
file and offset), a date from the 14 digits, a type from the content, block and
payload digests. Records whose payload another record has already become revisits that
refer to it and keep the headers of the message, so length and digest of the payload stay readable.

``archive`` applies this to a table of pages: the pages of a partition become an ARC file in memory
(version 1 and 2 by turns), the converter turns it into gzipped WARC files in the shared folder, and
``read_archives`` reads those. The first page of equal payloads is found by an aggregate over
digests; pages then meet it in a join whose hot partitions adaptive execution can split.

Defined results: null html is an empty payload; null url is written as ``-``; null page_id is
never chosen over another, and is read back as null; rows that repeat the page that others refer
to are responses too; an empty table gives no file and no row.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, put_file, shared_dir

FIELDS = {
    1: ("url", "ip", "date", "content_type", "length"),
    2: ("url", "ip", "date", "content_type", "status", "checksum", "location", "offset", "filename", "length"),
}
_TITLES = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_DATE = "19700101000000"
_TAG = 0x7461696E746C  # the first 48 bits of identifiers that hold a key


class ArcError(ValueError):
    """The bytes are no ARC file, or a declared length runs past its end."""


@dataclass(frozen=True)
class ArcRecord:
    version: int
    offset: int
    header: dict[str, str]
    content: bytes


def arc_url(url: str | None) -> str:
    """Without white space and controls, which an ARC header line can't hold."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "") or "-"


def write_arc(records: list[tuple[str | None, bytes]], version: int, date: str = NO_DATE, name: str = "pages.arc") -> bytes:
    """An ARC file of (url, content)."""
    title = f"{version} 0 taintlake\n{_TITLES[version]}\n\n".encode()
    rest = " 200 - - 0 " + name if version == 2 else ""
    out = [f"filedesc://{name} 0.0.0.0 {date} text/plain{rest} {len(title)}\n".encode(), title, b"\n"]
    for url, content in records:
        out += [f"{arc_url(url)} 0.0.0.0 {date} text/html{rest} {len(content)}\n".encode(), content, b"\n"]
    return b"".join(out)


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records after the version block, by declared length; header fields by version."""
    if not data.startswith(b"filedesc:"):
        raise ArcError("no version block")
    at, version = 0, 0
    while at < len(data):
        if data[at] in b"\r\n":
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ArcError(f"header line at {at} has no end")
        parts = data[at:end].decode("utf-8", "replace").rstrip("\r").split(" ")
        if not parts[-1].isdigit():
            raise ArcError(f"no length in the header line at {at}")
        start, size = end + 1, int(parts[-1])
        if start + size > len(data):
            raise ArcError(f"record at {at} declares {size} bytes; {len(data) - start} are left")
        content = data[start : start + size]
        if not version:
            version = int(content[:1]) if content[:1] in (b"1", b"2") else 0
            if not version:
                raise ArcError("unknown version")
        else:
            names = FIELDS[version]
            if len(parts) != len(names):
                raise ArcError(f"{len(parts)} header fields at {at}; version {version} has {len(names)}")
            yield ArcRecord(version, at, dict(zip(names, parts)), content)
        at = start + size


def key_id(key: int | None, otherwise: str = "") -> uuid.UUID:
    """An identifier that holds a 64-bit key; from a name if there is none."""
    if key is None:
        return uuid.uuid5(uuid.NAMESPACE_URL, otherwise)
    key &= (1 << 64) - 1
    return uuid.UUID(int=_TAG << 80 | 8 << 76 | (key >> 62) << 64 | 2 << 62 | key & (1 << 62) - 1)


def id_key(name: str) -> int | None:
    value = uuid.UUID(name.strip("<>").removeprefix("urn:uuid:")).int
    if value >> 80 != _TAG or value >> 76 & 15 != 8:
        return None
    key = (value >> 64 & 3) << 62 | value & (1 << 62) - 1
    return key - (1 << 64) if key >> 63 else key


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def warc_date(date: str) -> str:
    """Fourteen digits (or the fewer of old files) as a WARC date."""
    digits = re.sub(r"\D", "", date)[:14]
    d = digits + NO_DATE[len(digits) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def _split_http(content: bytes) -> tuple[bytes, bytes]:
    """Headers of an HTTP message with their blank line, and its body."""
    if not content.startswith(b"HTTP/"):
        return b"", content
    end = content.find(b"\r\n\r\n")
    return (content, b"") if end < 0 else (content[: end + 4], content[end + 4 :])


def to_warc(record: ArcRecord, key: int | None = None, refers_to: int | None = None, revisit: bool = False) -> bytes:
    """One WARC record, gzipped by itself."""
    head, payload = _split_http(record.content)
    kind = "revisit" if revisit else "response" if head else "resource"
    block = head if revisit else record.content
    name = key_id(key, f"{record.header.get('filename', '')}:{record.offset}:{record.header['url']}:{base32_sha1(payload)}")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{name}>",
        f"WARC-Date: {warc_date(record.header['date'])}",
        f"WARC-Target-URI: {record.header['url']}",
        f"WARC-IP-Address: {record.header['ip']}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        f"Content-Type: {'application/http; msgtype=response' if head else record.header['content_type']}",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines[2:2] = [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:uuid:{key_id(refers_to)}>"]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of a gzipped WARC file."""
    view = memoryview(data)
    at = 0
    while at < len(view):
        unpack = zlib.decompressobj(31)
        parts, step = [], 1 << 16
        while not unpack.eof:
            if at >= len(view):
                raise ValueError("the last member is cut short")
            parts.append(unpack.decompress(view[at : at + step]))
            at += step
        at = min(at, len(view)) - len(unpack.unused_data)
        whole = b"".join(parts)
        end = whole.find(b"\r\n\r\n")
        lines = whole[:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(headers["content-length"])
        yield headers, whole[end + 4 : end + 4 + size]


def http_message(payload: bytes) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload


_FILES = pa.schema([("part", pa.int64()), ("file", pa.string()), ("records", pa.int64())])
_ROWS = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())])


def archive(pages: DataFrame, min_bytes: int = 0, file_bytes: int = 16 << 20, date: str = NO_DATE) -> tuple[str, DataFrame]:
    """Writes the pages' WARC files; their folder, and a row per file."""
    spark = pages.sparkSession
    folder = shared_dir(spark, "warc")
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    slim = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", payload.alias("payload"), F.sha1(payload).alias("digest"))
    slim = slim.withColumn("size", F.octet_length("payload"))
    first = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.sha1(payload).alias("digest"), F.octet_length(payload).alias("size"))
    first = first.where(F.col("size") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    first = first.where("n > 1 and first is not null").select("digest", "first")
    role = slim.join(first, "digest", "left").select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))
    ordered = role.sortWithinPartitions("page_id", "url", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def rows() -> Iterator[tuple]:
            held: list[bytes] = []
            size = seq = turn = 0

            def close() -> tuple:
                name = f"part-{part:06d}-{seq:06d}.warc.gz"
                put_file(f"{folder}/archives", name, b"".join(held))
                return part, name, len(held)

            for batch in batches:
                for start in range(0, batch.num_rows, 64):
                    ids, urls, payloads, refers = (c.to_pylist() for c in batch.slice(start, 64).columns)
                    arc = write_arc([(u, http_message(p)) for u, p in zip(urls, payloads)], 1 + turn % 2, date)
                    turn += 1
                    for record, key, to in zip(read_arc(arc), ids, refers, strict=True):
                        held.append(to_warc(record, key, to, to is not None))
                        size += len(held[-1])
                        if size >= file_bytes:
                            yield close()
                            held, size, seq = [], 0, seq + 1
            if held:
                yield close()

        return batches_of(rows(), _FILES)

    ordered.mapInArrow(run, "part bigint, file string, records bigint").write.parquet(f"{folder}/index")
    return folder, spark.read.schema("part bigint, file string, records bigint").parquet(f"{folder}/index")


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url of every record in a folder's WARC files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for content in batch.column(0):
                    for headers, block in read_warc(content.as_py()):
                        head, payload = _split_http(block)
                        kind = headers["warc-type"]
                        if kind == "revisit":
                            size = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", head)[1])
                            digest, to = headers["warc-payload-digest"].removeprefix("sha1:"), id_key(headers["warc-refers-to"])
                        else:
                            size, digest, to = len(payload), base32_sha1(payload), None
                        yield id_key(headers["warc-record-id"]), size, digest, kind, to, headers["warc-target-uri"]

        return batches_of(rows(), _ROWS, 2048)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(f"{folder}/archives").select("content")
    return files.mapInArrow(run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string")


def pages_through_warc(pages: DataFrame, **options) -> DataFrame:
    folder, files = archive(pages, **options)
    if files.isEmpty():
        return pages.sparkSession.createDataFrame([], "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string")
    return read_archives(pages.sparkSession, folder)
