"""Token files: the ids of all documents in ascending ``doc_id`` order, a wavelet matrix per shard.

The rows are dealt by ranges of ``doc_id``, sorted within them, encoded and written where they
lie; a shard is closed at ``shard_tokens`` tokens, so a task holds one shard. Ranges cut through rows of
one ``doc_id``, too, where their texts differ. Files go to the
shared folder under names that depend on their place only, so a task that is run again
replaces its own files. Reading lists the folder and decodes file by file.

Defined results: null text is empty (only the end id); null ``doc_id`` sorts first; rows with
equal ``doc_id`` follow each other by a hash of their texts; repeated rows are written each by itself; a text longer than a shard
has a shard of its own; other columns, of whatever name, are not read; an empty table gives no file and no row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, map_slices, partition_starts, put_file, shared_dir
from .encoding import encoder
from .wavelet import WaveletMatrix, build

_SHARDS = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("n", pa.int64())])
_ROWS = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("doc_id", pa.int64()), ("inside", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def write_shards(docs: DataFrame, tokenizer_path: str, end_id: int, bits: int = 16, shard_tokens: int = 4 << 20, space: bool = True) -> tuple[str, DataFrame]:
    """The folder of the files, and (part, seq, n) for each of them."""
    spark = docs.sparkSession
    folder = shared_dir(spark, "tokens")
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slim = slim.withColumn("h", F.xxhash64("text"))
    ranged = slim.repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").drop("h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encode, end = TaskContext.get().partitionId(), encoder(tokenizer_path, space).encode, np.array([end_id], "<u4").tobytes()

        def rows() -> Iterator[tuple]:
            held: list[bytes] = []
            ids: list[int | None] = []
            ends: list[int] = []
            seq = 0

            def close() -> tuple:
                tokens = np.frombuffer(b"".join(held), dtype="<u4")
                put_file(f"{folder}/shards", f"part-{part:06d}-{seq:06d}.wm", build(tokens, ids, np.array(ends), bits))
                return part, seq, len(tokens)

            for batch in batches:
                for doc_id, found in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist())):
                    held += [found, end]
                    ids.append(doc_id)
                    ends.append((ends[-1] if ends else 0) + len(found) // 4 + 1)
                    if ends[-1] >= shard_tokens:
                        yield close()
                        held, ids, ends, seq = [], [], [], seq + 1
            if ids:
                yield close()

        return batches_of(rows(), _SHARDS)

    map_slices(ranged, run, "part bigint, seq bigint, n bigint", 1, needs=(tokenizer_path, space)).write.parquet(f"{folder}/index")
    return folder, spark.read.schema("part bigint, seq bigint, n bigint").parquet(f"{folder}/index")


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """part, seq, doc_id, inside (its start in the shard), n_tokens, ids_crc32 of every document in the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                    part, seq = path.rpartition("/part-")[2].removesuffix(".wm").split("-")
                    matrix = WaveletMatrix(content.as_py())
                    tokens = matrix.tokens().astype("<u4").tobytes()
                    at = 0
                    ids, ends = matrix.documents()
                    for doc_id, end in zip(ids, ends.tolist()):
                        yield int(part), int(seq), doc_id, at, end - at, zlib.crc32(tokens[4 * at : 4 * end])
                        at = end

        return batches_of(rows(), _ROWS)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wm").load(f"{folder}/shards").select("path", "content")
    return files.mapInArrow(run, "part bigint, seq bigint, doc_id bigint, inside bigint, n_tokens bigint, ids_crc32 bigint")


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int, **options) -> DataFrame:
    """Writes the files and reads them back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    folder, shards = write_shards(docs, tokenizer_path, end_id, **options)
    if shards.isEmpty():
        return spark.createDataFrame([], "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    starts = partition_starts(shards, "part", ["seq"], "n", "before").select("part", "seq", "before")
    back = read_shards(spark, folder).join(starts, ["part", "seq"])
    return back.select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
