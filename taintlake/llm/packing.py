"""Best-fit packing of token pieces into sequences, by hierarchical residual rounds.

Pieces are dealt at random to groups of about ``per_group``; each group packs its own, longest
first, each into the fullest sequence that still has room. A sequence that is more than half
full can take none like it, so after a round a group has at most one that is half full or
less. Groups are then merged ``FAN_IN`` at a time: their underfull sequences are items of
the next best-fit round, until one group is left. A later round of one group takes in at most
``FAN_IN - 1`` of its sequences, so a group hands on its emptiest ``FAN_IN`` for each
round to come and emits the rest as final: no sequence is lost by that, and what a
task of a round holds does not grow with the input.

Defined results: null text is empty (one piece with the end id alone); rows with equal or null
``doc_id`` are packed each by itself; a very long text has as many pieces as it needs; of bins with equal room any may take a piece;
other columns of ``docs``, of whatever name, are not read; an empty table gives no row.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, checkpointed, map_slices, shared_dir
from .encoding import encoder

FAN_IN = 16
_ITEMS = pa.schema([(k, pa.int64()) for k in ("uid", "doc_id")] + [("piece", pa.int32())] + [(k, pa.int64()) for k in ("start", "length", "ids_crc32")])
_ITEMS_DDL = "uid bigint, doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int, room: int, space: bool) -> DataFrame:
    """The pieces of every document, written to the shared folder so that later rounds don't encode again."""
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, uid = encoder(tokenizer_path, space).encode, np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId() << 40

        def rows() -> Iterator[tuple]:
            nonlocal uid
            for batch in batches:
                for doc_id, found in zip(batch.column(0).to_pylist(), encode([t or "" for t in batch.column(1).to_pylist()])):
                    ids = memoryview(found + end)
                    for piece, at in enumerate(range(0, len(ids), 4 * room)):
                        own = ids[at : at + 4 * room]
                        yield uid, doc_id, piece, at // 4, len(own) // 4, zlib.crc32(own)
                        uid += 1

        return batches_of(rows(), _ITEMS)

    place = shared_dir(spark, "pieces")
    map_slices(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), run, _ITEMS_DDL, 1, needs=(tokenizer_path, space)).write.parquet(place)
    return spark.read.schema(_ITEMS_DDL).parquet(place)


def best_fit(lengths: list[int], room: int) -> tuple[list[int], list[int], list[int]]:
    """Best fit, longest first: the bin and the offset of each item, and how full the bins are."""
    order = sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True)
    bins, offsets = [0] * len(lengths), [0] * len(lengths)
    full: list[int] = []
    by_left: dict[int, list[int]] = {}
    left_bits = 0  # bit r is set if a bin has exactly r left
    for i in order:
        size = lengths[i]
        fits = left_bits >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            own = by_left[left]
            b = own.pop()
            if not own:
                left_bits &= ~(1 << left)
        else:
            b, left = len(full), room
            full.append(0)
        bins[i], offsets[i] = b, full[b]
        full[b] += size
        left -= size
        if left:
            by_left.setdefault(left, []).append(b)
            left_bits |= 1 << left
    return bins, offsets, full


def pack(items: DataFrame, room: int, per_group: int = 4096) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with ``uid`` (distinct) and ``length`` (1 to ``room``)."""
    n = items.count()
    groups = max(1, math.ceil(n / per_group))
    rounds = math.ceil(math.log(groups, FAN_IN)) if groups > 1 else 0
    dealt = items.withColumn("node", F.pmod(F.xxhash64("uid"), F.lit(groups)).cast("bigint"))
    kept = [f for f in items.schema if f.name not in ("sequence_id", "offset")]
    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", node bigint, sequence_id bigint, offset bigint, fill bigint"

    def local(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("uid", ignore_index=True)
        bins, offsets, full = best_fit(group["length"].tolist(), room)
        bins = np.array(bins, dtype=np.int64)
        return group.assign(sequence_id=(group["node"].to_numpy() << 32) + bins, offset=np.array(offsets, dtype=np.int64), fill=np.array(full, dtype=np.int64)[bins])

    placed = dealt.groupBy("node").applyInPandas(local, out)
    place = shared_dir(items.sparkSession, "packed")
    placed.write.parquet(place)
    placed = items.sparkSession.read.schema(out).parquet(place)
    names = [f.name for f in kept]
    if not rounds:
        return placed.select(*names, "sequence_id", "offset")
    open_bins = placed.where(F.col("fill") < room).select("node", "sequence_id", "fill").distinct()
    open_bins = open_bins.groupBy("node").applyInPandas(_emptiest(FAN_IN * rounds), "node bigint, sequence_id bigint, fill bigint")
    moves = None
    for left in range(rounds - 1, -1, -1):
        step = checkpointed(open_bins.withColumn("node", F.floor(F.col("node") / FAN_IN)).groupBy("node").applyInPandas(_merge(room), "node bigint, sequence_id bigint, host bigint, shift bigint, fill bigint"))
        moved = step.where("host != sequence_id").select("sequence_id", "host", "shift")
        if moves is None:
            moves = moved
        else:
            again = moved.select(F.col("sequence_id").alias("host"), F.col("host").alias("host2"), F.col("shift").alias("shift2"))
            carried = moves.join(again, "host", "left")
            moves = carried.select("sequence_id", F.coalesce("host2", "host").alias("host"), (F.col("shift") + F.coalesce("shift2", F.lit(0))).alias("shift")).unionByName(moved)
        if left:
            open_bins = step.where("host = sequence_id and fill < " + str(room)).select("node", "sequence_id", "fill")
            open_bins = open_bins.groupBy("node").applyInPandas(_emptiest(FAN_IN * left), "node bigint, sequence_id bigint, fill bigint")
    return placed.join(moves, "sequence_id", "left").select(
        *names, F.coalesce("host", "sequence_id").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset")
    )


def _emptiest(most: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        return group.sort_values(["fill", "sequence_id"]).head(most)[["node", "sequence_id", "fill"]]

    return run


def _merge(room: int):
    """Sequences as items: the first item of a bin is its host, the others move into it."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["fill", "sequence_id"], ascending=[False, True], ignore_index=True)
        bins, offsets, full = best_fit(group["fill"].tolist(), room)
        ids, first = group["sequence_id"].tolist(), {}
        for b, i in zip(bins, ids):
            first.setdefault(b, i)
        return pd.DataFrame({"node": group["node"], "sequence_id": ids, "host": [first[b] for b in bins], "shift": offsets, "fill": [full[b] for b in bins]})

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, room: int = 4096, space: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    return pack(pieces(docs, tokenizer_path, end_id, room, space), room).drop("uid")
