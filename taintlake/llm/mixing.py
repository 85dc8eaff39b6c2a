"""Mixing sources to target weights.

The words of a source are one stream, its documents end to end in an order hashed from
``doc_id``; the stream is cut into blocks of ``block_words``. Targets share all words by weight,
none over ``most_repeats`` times its source. A source's draws follow from its target: the
output's shards get source counts from a multinomial law under the condition that all draws come out
(hypergeometric, halving the shards again and again, so any shard's counts can be had from the
seed alone). Draw k of a source is slot k of its passes: in each pass a pseudorandom permutation maps slots to
blocks, so no block comes more often than there are passes. The last draw of a source is cut to
the words that are left. Blocks are joined by index.

Only one row per source goes to the driver, at most ``max_sources``; more raise an error. Streams
are laid out by (source, hashed bucket) with buckets of some ``per_bucket`` rows, so a source
with a third of all rows is split; drawn blocks are spread by (source, block).

Defined results: null text has size 0 and is never taken; null source is a source of its own, the last;
rows with equal or null ``doc_id`` are laid out and taken each by itself, those with equal hashes by ``doc_id`` and place; a very long text
lies in as many blocks as it needs; other columns, of whatever name, come back as they are from ``mix_documents`` (but ``n_chars``, the size
of the text); an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import e, lgamma, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import map_slices, shared_dir, utf8

WEIGHTS = (5, 2, 1)


def targets(sizes: list[int], weights: list[float], share: float = 1.0, most_repeats: float = 3.0) -> list[float]:
    """Shares of all sizes by weight; what a cap leaves over is shared again until none is above."""
    want, out = share * sum(sizes), [0.0] * len(sizes)
    free = [i for i in range(len(sizes))]
    while free:
        whole = sum(weights[i] for i in free)
        over = [i for i in free if want * weights[i] > most_repeats * sizes[i] * whole]
        if not over:
            for i in free:
                out[i] = want * weights[i] / whole
            break
        for i in over:
            out[i] = most_repeats * sizes[i]
            want -= out[i]
        free = [i for i in free if i not in set(over)]
    return out


class Permutation:
    """A keyed permutation of 0..n-1: a balanced Feistel network, walked until it is back inside."""

    ROUNDS = 4

    def __init__(self, n: int, *key: int):
        self.n, self.half = n, max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        self.mask = np.uint64((1 << self.half) - 1)
        self.keys = np.random.default_rng([abs(k) for k in key]).integers(0, 1 << 63, self.ROUNDS, dtype=np.uint64)

    def _mix(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (x + key) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return (x >> np.uint64(33)) & self.mask

    def _once(self, x: np.ndarray, keys) -> np.ndarray:
        left, right = x >> np.uint64(self.half), x & self.mask
        for key in keys:
            left, right = right, left ^ self._mix(right, key)
        return right << np.uint64(self.half) | left

    def _walk(self, x, keys) -> np.ndarray:
        x = self._once(np.asarray(x, dtype=np.uint64), keys)
        while (out := x >= self.n).any():
            x[out] = self._once(x[out], keys)
        return x.astype(np.int64)

    def __call__(self, x) -> np.ndarray:
        return self._walk(x, self.keys)

    def inverse(self, y) -> np.ndarray:
        """The network's halves end exchanged, so the same walk with the keys turned around undoes it."""
        return self._walk(y, self.keys[::-1])


@dataclass(frozen=True)
class Plan:
    sources: list[str | None]
    sizes: np.ndarray
    targets: list[float]
    block_words: int
    shard_slots: int
    seed: int
    blocks: np.ndarray
    draws: np.ndarray
    last_words: np.ndarray

    @property
    def shards(self) -> int:
        return -(-int(self.draws.sum()) // self.shard_slots)

    def passes(self, source: int) -> int:
        """Passes that take the whole source."""
        n = int(self.sizes[source])
        return round(self.targets[source]) // n if n else 0

    def counts(self, shard: int) -> tuple[np.ndarray, np.ndarray]:
        """Draws of each source before the shard and in it."""
        low, high, own, before = 0, self.shards, self.draws.copy(), np.zeros_like(self.draws)
        while high - low > 1:
            middle = (low + high) // 2
            room = (middle - low) * self.shard_slots
            left = _hypergeometric(np.random.default_rng([self.seed, low, high]), own, room)
            if shard < middle:
                own, high = left, middle
            else:
                before, own, low = before + left, own - left, middle
        return before, own

    def slots(self, shard: int) -> tuple[np.ndarray, ...]:
        """source, pass, block, words of the shard's slots in order."""
        before, own = self.counts(shard)
        parts = []
        for s in np.flatnonzero(own):
            k = before[s] + np.arange(own[s])
            n = int(self.blocks[s])
            turn, block = k // n, np.empty(len(k), dtype=np.int64)
            for t in np.unique(turn):
                block[turn == t] = Permutation(n, self.seed, int(s), int(t))(k[turn == t] % n)
            words = np.where(block == n - 1, int(self.sizes[s]) - (n - 1) * self.block_words, self.block_words)
            words[k == self.draws[s] - 1] = self.last_words[s]
            parts.append((np.full(len(k), s), turn, block, words))
        joined = [np.concatenate(x) for x in zip(*parts)]
        order = np.random.default_rng([self.seed, shard]).permutation(len(joined[0]))
        return tuple(x[order] for x in joined)


def _hypergeometric(rng: np.random.Generator, colours: np.ndarray, room: int) -> np.ndarray:
    """How many of each colour a draw of ``room`` without return has."""
    out, rest = np.zeros_like(colours), int(colours.sum())
    for i, c in enumerate(colours.tolist()):
        rest -= c
        out[i] = _of_one_colour(rng, c, rest, room) if c and room else 0
        room -= int(out[i])
    return out


def _of_one_colour(rng: np.random.Generator, good: int, bad: int, room: int) -> int:
    """A hypergeometric draw of any size; the library's sampler ends at 1e9, and the same rejection from a ratio of uniforms goes on."""
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, room))
    few, most, whole = min(good, bad), max(good, bad), good + bad
    drawn = min(room, whole - room)
    if not drawn or not few:
        k = 0
    else:
        fact = lambda x: lgamma(x + 1)
        spread = sqrt((whole - drawn) * drawn / (whole - 1) * (few / whole) * (most / whole) + 0.5)
        middle, width = drawn * few / whole + 0.5, 2 * sqrt(2 / e) * spread + 3 - 2 * sqrt(3 / e)
        top = (drawn + 1) * (few + 1) // (whole + 2)
        log_law = lambda x: fact(x) + fact(few - x) + fact(drawn - x) + fact(most - drawn + x)
        least, limit = max(0, drawn - most), min(min(drawn, few) + 1, int(middle + 16 * spread))
        best = log_law(top)
        while True:
            u, v = rng.random(), rng.random()
            x = middle + width * (v - 0.5) / u if u else -1.0
            if not least <= x < limit:
                continue
            k = int(x)
            t = best - log_law(k)
            if u * (4 - u) - 3 <= t or (u * (u - t) < 1 and 2 * log(u) <= t):
                break
    if good > bad:
        k = drawn - k
    return k if drawn == room else good - k


def plan(sizes: dict[str | None, int], weights=WEIGHTS, share: float = 1.0, most_repeats: float = 3.0, block_words: int = 256, shard_slots: int = 4096, seed: int = 17) -> Plan:
    """Weights repeat over the sources by code point, null last."""
    sources = sorted(sizes, key=lambda s: (s is None, s or ""))
    n = [int(sizes[s]) for s in sources]
    want = targets(n, [weights[i % len(weights)] for i in range(len(n))], share, most_repeats)
    blocks, draws, last = [], [], []
    for s, (size, target) in enumerate(zip(n, want)):
        count = -(-size // block_words)
        turns, rest = divmod(round(target), size) if size else (0, 0)
        tail = size - (count - 1) * block_words if count else 0
        m, end = 0, 0
        if rest:
            at = int(Permutation(count, seed, s, turns).inverse([count - 1])[0])  # when the short last block comes
            words = lambda j: j * block_words if j <= at else (j - 1) * block_words + tail
            m = -(-rest // block_words)
            m += words(m) < rest
            end = rest - words(m - 1)
        elif turns:
            final = int(Permutation(count, seed, s, turns - 1)([count - 1])[0])
            end = tail if final == count - 1 else block_words
        blocks.append(count), draws.append(turns * count + m), last.append(end)
    return Plan(sources, np.array(n, dtype=np.int64), want, block_words, shard_slots, seed, *(np.array(x, dtype=np.int64) for x in (blocks, draws, last)))


def _source_rows(frame: DataFrame, max_sources: int) -> dict[str | None, int]:
    rows = frame.groupBy("source").agg(F.sum("size").alias("n")).limit(max_sources + 1).collect()
    if len(rows) > max_sources:
        raise ValueError(f"over {max_sources} sources; a mix by weights is for a bounded number of them")
    return {r["source"]: r["n"] for r in rows}


class Mix:
    """The laid-out documents, the plan and the drawn slots of a mix."""

    def __init__(self, docs: DataFrame, max_sources: int = 100_000, per_bucket: int = 20_000, carry: bool = False, **options):
        spark = docs.sparkSession
        self.spark, place = spark, shared_dir(spark, "mix")
        #: Columns of the documents go by number, so that no name of theirs can clash with one here.
        self.carried, self.columns = ([f"c{i}" for i in range(len(docs.columns))] if carry else []), docs.columns
        doc_id, source, text = (F.col(f"c{docs.columns.index(c)}") for c in ("doc_id", "source", "text"))
        given = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
        given = given.select(doc_id.cast("bigint").alias("_doc_id"), source.cast("string").alias("_source"), text.alias("_text"), *self.carried)
        ddl = "uid bigint, size bigint, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema if f.name != "_text")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            uid = TaskContext.get().partitionId() << 40
            for batch in batches:
                sizes = [len(t.split()) if t else 0 for t in utf8(batch.column(2))]
                keep = [i for i, n in enumerate(batch.schema.names) if n != "_text"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(uid, uid + len(sizes)), pa.int64()), pa.array(sizes, pa.int64()), *(batch.column(i) for i in keep)],
                    names=["uid", "size", *(batch.schema.names[i] for i in keep)],
                )
                uid += len(sizes)

        map_slices(given, run, ddl, 2).write.parquet(place)
        self.rows = spark.read.schema(ddl).parquet(place)
        slim = self.rows.select("uid", "size", F.col("_doc_id").alias("doc_id"), F.col("_source").alias("source"))
        self.plan = p = plan(_source_rows(slim, max_sources), **options)
        self.sources = spark.createDataFrame(
            [(i, s, int(n), float(t), p.passes(i)) for i, (s, n, t) in enumerate(zip(p.sources, p.sizes, p.targets))],
            "src int, source string, source_size bigint, target double, passes int",
        )
        buckets = max(1, -(-slim.count() // per_bucket))
        order = F.xxhash64(F.coalesce("doc_id", "uid"), F.lit(p.seed))
        keyed = self.sources.select("src", F.col("source").alias("named"))
        keyed = slim.join(keyed, F.col("source").eqNullSafe(F.col("named"))).select("uid", "doc_id", "size", "src", order.alias("h"), F.pmod(order, F.lit(buckets)).alias("bucket"))
        sums = keyed.groupBy("src", "bucket").agg(F.sum("size").alias("n"))
        before = W.partitionBy("src").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
        bases = sums.select("src", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
        inside = W.partitionBy("src", "bucket").orderBy("h", "doc_id", "uid").rowsBetween(W.unboundedPreceding, -1)
        laid = keyed.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(bases, ["src", "bucket"])
        self.laid = laid.select("uid", "doc_id", "size", "src", (F.col("base") + F.col("inside")).alias("start"))

    def slots(self) -> DataFrame:
        """shard, slot, src, pass, block, words of the whole output."""
        p = self.plan

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for shard in batch.column(0).to_pylist():
                    src, turn, block, words = p.slots(shard)
                    n = len(src)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, shard), pa.int64()), pa.array(np.arange(n), pa.int32()), pa.array(src, pa.int32()), pa.array(turn, pa.int32()), pa.array(block, pa.int64()), pa.array(words, pa.int32())],
                        names=["shard", "slot", "src", "pass", "block", "words"],
                    )

        return self.spark.range(p.shards).mapInArrow(run, "shard bigint, slot int, src int, pass int, block bigint, words int")

    def pieces(self) -> DataFrame:
        """Each document's part of each block: uid, doc_id, size, src, block, a and b (words of the block), at (of the document)."""
        size = F.lit(self.plan.block_words).cast("bigint")
        last = F.greatest(F.col("start"), F.col("start") + F.col("size") - 1)
        cut = self.laid.withColumn("block", F.explode(F.sequence(F.expr(f"start div {self.plan.block_words}"), F.floor(last / size))))
        a = F.greatest(F.col("start") - F.col("block") * size, F.lit(0))
        b = F.least(F.col("start") + F.col("size") - F.col("block") * size, size)
        return cut.select("uid", "doc_id", "size", "src", "block", a.alias("a"), b.alias("b"), (F.col("block") * size + a - F.col("start")).alias("at"))

    def taken(self) -> DataFrame:
        """doc_id, source, size, source_size, target, taken of each document."""
        drawn = self.slots().groupBy("src", "block", "words").agg(F.count("*").alias("n"))
        drawn = drawn.groupBy("src", "block").agg(F.collect_list(F.struct("words", "n")).alias("draws"))  # two at most: whole, and the source's last
        parts = self.pieces().join(drawn.hint("merge"), ["src", "block"], "left")  # both grow with the input
        words = F.aggregate("draws", F.lit(0).cast("bigint"), lambda acc, d: acc + d["n"] * F.greatest(F.least(F.col("b"), d["words"].cast("bigint")) - F.col("a"), F.lit(0)))
        per = parts.groupBy("uid").agg(F.first("doc_id").alias("doc_id"), F.first("size").alias("size"), F.first("src").alias("src"), F.sum(F.coalesce(words, F.lit(0))).alias("taken"))
        return per.join(self.sources, "src").select("doc_id", "source", "size", "source_size", "target", "taken")

    def rounds(self) -> DataFrame:
        """The mix as documents (needs ``carry``): a row for each pass that takes some of a document.

        A pass that takes all of it gives the row as it is; the last pass of a source, which
        takes part of its blocks, gives the words of those in order, joined by blanks.
        """
        last = self.slots().join(self.sources.select("src", "passes"), "src").where(F.col("pass") == F.col("passes")).select("src", "block", "words")
        parts = self.pieces().join(last.hint("merge"), ["src", "block"], "left")
        end = F.least(F.col("b"), F.col("words").cast("bigint"))
        piece = F.when(F.col("words").isNotNull() & (end > F.col("a")), F.struct("at", (F.col("at") + end - F.col("a")).alias("to")))
        per = parts.groupBy("uid").agg(F.first("src").alias("src"), F.array_sort(F.collect_list(piece)).alias("ranges"))
        per = per.join(self.sources.select("src", "passes"), "src").where((F.col("passes") > 0) | (F.size("ranges") > 0)).select("uid", "passes", "ranges")
        joined = self.rows.join(per.hint("merge"), "uid").select(f"c{self.columns.index('text')}", *[c for c in self.carried if c != f"c{self.columns.index('text')}"], "size", "passes", "ranges")
        names, at = self.carried, self.columns.index("text")
        schema = self.rows.select(*names).schema

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = batch.select(names)
                texts, sizes = utf8(own.column(at)), batch.column("size").to_pylist()
                rows, new = [], []
                for i, (text, size, passes, ranges) in enumerate(zip(texts, sizes, batch.column("passes").to_pylist(), batch.column("ranges").to_pylist())):
                    copies = [text] * passes
                    if ranges:
                        whole = sum(r["to"] - r["at"] for r in ranges) == size
                        copies.append(text if whole else b" ".join(w for words in [text.split()] for r in ranges for w in words[r["at"] : r["to"]]))
                    rows += [i] * len(copies)
                    new += copies
                for start in range(0, len(rows), 2000):
                    part = own.take(pa.array(rows[start : start + 2000], pa.int64()))
                    text = pa.array(new[start : start + 2000], pa.binary()).cast(part.schema.field(at).type)
                    columns = [text if i == at else c for i, c in enumerate(part.columns)]
                    yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

        out = map_slices(joined, run, schema, 0)
        if "n_chars" in self.columns:
            size = f"c{self.columns.index('n_chars')}"
            out = out.withColumn(size, F.length(f"c{at}").cast(schema[size].dataType))
        return out.toDF(*self.columns)


def mix_words(docs: DataFrame, **options) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of each document."""
    return Mix(docs, **options).taken()


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as rows with the columns of ``docs``."""
    return Mix(docs, carry=True, **options).rounds()


def block_texts(mix: Mix) -> DataFrame:
    """The mix as blocks: shard, slot, source, words and the text of each slot (needs ``carry``)."""
    parts = mix.pieces().where("b > a").join(mix.rows.select("uid", F.col(f"c{mix.columns.index('text')}").alias("text")), "uid")
    words = F.slice(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), (F.col("at") + 1).cast("int"), (F.col("b") - F.col("a")).cast("int"))
    blocks = parts.groupBy("src", "block").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("a", words.alias("w")))), lambda x: x["w"])).alias("all"))
    joined = mix.slots().join(blocks, ["src", "block"]).join(mix.sources.select("src", "source"), "src")
    return joined.select("shard", "slot", "source", "words", F.array_join(F.slice("all", 1, F.col("words")), " ").alias("text"))
