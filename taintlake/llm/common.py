"""Helpers shared by the corpus operators: folders, columns, distributed prefix sums."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder, as in local tests.
LOCAL_FALLBACK = "/tmp/checkpoints"

#: The six ASCII white-space bytes that separate words; ``bytes.split()`` uses the same set.
SPACE_BYTES = b" \t\n\x0b\x0c\r"

#: ``bytes.translate`` table for A-Z to a-z; other bytes stay.
LOWER_ASCII = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shared_base(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a local one only where driver and executors are one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (named or LOCAL_FALLBACK).rstrip("/")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one, as a URI or path."""
    return f"{shared_base(spark)}/taintlake-{name}-{uuid.uuid4().hex}"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Lets ``checkpoint()`` work where the session names no folder; leaves a named one alone."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_base(spark))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts lineage through the shared folder, so that the loss of an executor recomputes nothing before it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def key_column(df: DataFrame, name: str, as_type: str = "bigint"):
    """``df[name]`` even where another column differs from it only by case; null if there is none."""
    return F.col(f"`{name}`").cast(as_type) if name in df.columns else F.lit(None).cast(as_type)


def utf8(column: pa.Array) -> list[bytes | None]:
    """A string column as UTF-8 bytes without a round trip over ``str``."""
    return column.cast(pa.large_binary()).to_pylist()


def pieces_of(batch: pa.RecordBatch, column: int, rows: int = 512, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of so many rows, and of so many bytes of text unless one row has more."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if i > start and (i - start >= rows or held + n > size):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(lengths):
        yield batch.slice(start)


def give_back() -> None:
    """Returns to the system what a task freed, so that reused workers don't add up what their stages needed."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


#: What a worker process keeps between tasks, by a key that names it.
HELD: dict[tuple, object] = {}


def let_go(needs: tuple | None) -> None:
    """Drops what tasks of other stages kept in this worker, so that a stage's tables don't come on top of it."""
    others = [k for k in HELD if k != needs]
    for k in others:
        del HELD[k]
    if others:
        give_back()


def map_slices(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, column: int, needs: tuple | None = None) -> DataFrame:
    """``df.mapInArrow(run, schema)`` over small slices (by ``pieces_of`` the text in ``column``) instead of whole batches.

    Of what workers keep (``HELD``), only what is under the key ``needs`` stays.
    """

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go(needs)
        try:
            yield from run(part for whole in batches for part in pieces_of(whole, column))
        finally:
            give_back()

    return df.mapInArrow(sliced, schema)


def batches_of(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Record batches of at most ``size`` rows from an iterator of tuples."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield to_batch(held, schema)
            held = []
    if held:
        yield to_batch(held, schema)


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(columns, schema)], schema=schema)


def partition_starts(totals: DataFrame, partition: str, order: list[str], value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over all rows that come before, by (partition, order).

    ``totals`` has few rows per partition (one per file or shard), so the window inside a
    partition is small; across partitions only one row each is summed, on the driver, and
    their number is the number of shuffle partitions.
    """
    from pyspark.sql import Window as W

    spark = totals.sparkSession
    sums = totals.groupBy(partition).agg(F.sum(value).alias("_v")).collect()
    base, at = [], 0
    for row in sorted(sums, key=lambda r: r[0]):
        base.append((row[0], at))
        at += row["_v"] or 0
    bases = spark.createDataFrame(base, f"_p bigint, _b bigint")
    inside = W.partitionBy(partition).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return (
        totals.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(bases, F.col(partition) == F.col("_p"))
        .withColumn(out, F.col("_in") + F.col("_b"))
        .drop("_in", "_p", "_b")
    )


def put_file(folder: str, name: str, data: bytes) -> None:
    """Writes a whole file below a shared folder: under a hidden name first, then renamed.

    Equal tasks write equal bytes, so a task that runs twice replaces the file by itself; what
    a lost one leaves has a hidden name, which Spark's readers skip.
    """
    hidden = f".{name}.{uuid.uuid4().hex}"
    place = urlparse(folder)
    if place.scheme in ("", "file"):
        path = unquote(place.path)
        os.makedirs(path, exist_ok=True)
        with open(f"{path}/{hidden}", "wb") as f:
            f.write(data)
        os.replace(f"{path}/{hidden}", f"{path}/{name}")
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    with store.open_output_stream(f"{path}/{hidden}") as f:
        f.write(data)
    store.move(f"{path}/{hidden}", f"{path}/{name}")
