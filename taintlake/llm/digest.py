"""Quartile bucket digests of texts, and a bounded difference score between two of them.

Three of the bytes in every window of five form triplets; each triplet is hashed to one of
``buckets`` counters. A digest holds two bits for each bucket, the quartile that its count
falls in, after one byte for the length (its logarithm). The difference of two digests sums the
distances between bucket codes and a part for the lengths; the likeness is one minus its
share of the largest, from 0 to 1, so equal digests have likeness 1.

Defined results: null counts as empty text; texts without a triplet (under three bytes) have
codes 0, and shorter windows use the triplets that they hold. Equal texts have equal digests; repeated rows
are compared each by itself; very long texts are hashed a step at a time; other columns, of whatever name, are not read; a single
row is its own next one; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, map_slices, shared_dir

BUCKETS = 128
#: Positions inside a window of five that make a triplet with its first byte, and the salt of each.
_TRIPLETS = ((1, 2, 0x02), (1, 3, 0x3D), (2, 3, 0x8B), (2, 4, 0xC5), (1, 4, 0x71), (3, 4, 0xE3))
LENGTH_WEIGHT = 4
#: Bytes that one step of the hashing handles, so that no text needs many times its own size.
_STEP = 1 << 20


def counts(text: bytes, buckets: int = BUCKETS) -> np.ndarray:
    """How many triplets fall in each bucket."""
    total = np.zeros(buckets, dtype=np.int64)
    whole = np.frombuffer(text, dtype=np.uint8)
    for start in range(0, len(whole), _STEP):
        b = whole[start : start + _STEP + 4].astype(np.uint32)
        stop = min(_STEP, len(whole) - start)
        for i, j, salt in _TRIPLETS:
            n = min(stop, len(b) - j)
            if n <= 0:
                continue
            h = (b[:n] << np.uint32(16)) | (b[i : i + n] << np.uint32(8)) | b[j : j + n]
            h = (h + np.uint32(salt << 24)) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x85EBCA77)
            total += np.bincount(h >> np.uint32(32 - int(buckets).bit_length() + 1), minlength=buckets)
    return total


def digest(text: bytes, buckets: int = BUCKETS) -> bytes:
    c = counts(text, buckets)
    length = min(255, int(np.log2(len(text) + 1) * 10))
    s = np.sort(c)
    q1, q2, q3 = s[buckets // 4 - 1], s[buckets // 2 - 1], s[3 * buckets // 4 - 1]
    code = (c > q1).astype(np.uint8) + (c > q2) + (c > q3)
    packed = code[0::4] << 6 | code[1::4] << 4 | code[2::4] << 2 | code[3::4]
    return bytes([length]) + packed.astype(np.uint8).tobytes()


_PAIR = np.array([[sum(abs((a >> s & 3) - (b >> s & 3)) for s in (0, 2, 4, 6)) for b in range(256)] for a in range(256)], dtype=np.uint8)


def difference(a: bytes, b: bytes) -> int:
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    return int(_PAIR[x[1:], y[1:]].sum(dtype=np.int64)) + LENGTH_WEIGHT * min(abs(int(x[0]) - int(y[0])), 64)


def likeness(a: bytes, b: bytes) -> float:
    most = 12 * (len(a) - 1) + LENGTH_WEIGHT * 64
    return 1.0 - difference(a, b) / most


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much of the start of ``following``, or all of that."""
    n = len(text)
    return text[: n - n // 2] + following[: n // 2]


def fingerprints(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_chars, fingerprint (hex) per row; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([digest(t.encode(), buckets).hex() for t in texts], pa.string())],
                names=["doc_id", "n_chars", "fingerprint"],
            )

    return map_slices(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), run, "doc_id bigint, n_chars bigint, fingerprint string", 1)


_PAIRS = pa.schema(
    [(k, pa.int64()) for k in ("doc_id", "n_chars")]
    + [(k, pa.string()) for k in ("edited_sha256", "fingerprint", "edited_fingerprint")]
    + [("near_edited", pa.float64()), ("near_next", pa.float64()), ("part", pa.int64()), ("edge", pa.string()), ("text", pa.string())]
)
_PAIRS_DDL = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, part bigint, edge string, text string"
)


def _compare(doc_id, text: str, fp: bytes, following: str, next_fp: bytes, buckets: int) -> tuple:
    changed = edited(text, following).encode()
    fp2 = digest(changed, buckets)
    return doc_id, len(text), hashlib.sha256(changed).hexdigest(), fp.hex(), fp2.hex(), likeness(fp, fp2), likeness(fp, next_fp)


def with_next(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Each document against its edited text and against the next one by ``doc_id``.

    The rows are dealt by ranges of ``doc_id`` and sorted within them, so each is compared
    with its successor while the sorted partition streams by. Only the first and the last
    text of a partition are handed on, as rows of a table in the shared folder; the last one is
    then joined with the first of the next partition that has rows, by partition number.
    Null ``doc_id`` sorts first; rows with equal ``doc_id`` follow each other by a hash of their texts.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slim = slim.withColumn("h", F.xxhash64("text"))
    ranged = slim.repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").drop("h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def rows() -> Iterator[tuple]:
            held = None
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    fp = held[2] if held and held[1] == text else digest(text.encode(), buckets)
                    if held is None:
                        yield doc_id, None, None, fp.hex(), None, None, None, part, "first", text
                    else:
                        yield *_compare(*held, text, fp, buckets), part, None, None
                    held = (doc_id, text, fp)
            if held is not None:
                yield held[0], None, None, held[2].hex(), None, None, None, part, "last", held[1]

        return batches_of(rows(), _PAIRS, 2048)

    place = shared_dir(spark, "digest")
    map_slices(ranged, run, _PAIRS_DDL, 1).write.parquet(place)
    done = spark.read.schema(_PAIRS_DDL).parquet(place)
    parts = sorted(r[0] for r in done.where(F.col("edge") == "first").select("part").collect())
    follows = spark.createDataFrame([(a, b) for a, b in zip(parts, parts[1:] + parts[:1])], "part bigint, then bigint")
    last = done.where(F.col("edge") == "last").select("doc_id", "text", "part")
    first = done.where(F.col("edge") == "first").select(F.col("text").alias("following"), F.col("part").alias("then"))
    pairs = last.join(follows, "part").join(first, "then").select("doc_id", "text", "following")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for doc_id, text, following in zip(*(c.to_pylist() for c in batch.columns)):
                    yield *_compare(doc_id, text, digest(text.encode(), buckets), following, digest(following.encode(), buckets), buckets), None, None, None

        return batches_of(rows(), _PAIRS, 256)

    columns = [x.split()[0] for x in _PAIRS_DDL.split(", ")[:7]]
    inner = done.where(F.col("edge").isNull())
    return inner.select(columns).unionByName(pairs.mapInArrow(close, _PAIRS_DDL).select(columns))
