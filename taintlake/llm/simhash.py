"""SimHash near-duplicates through segment popcounts.

A 64-bit fingerprint is cut into 32 segments of two bits, and mapped to the number of ones in
each: a point on a grid. Two fingerprints that differ in d bits lie within Manhattan distance d
there, so the distance on the grid is a lower bound. The grid is joined half by half: of two
points within distance 3, one half of the 32 coordinates is within distance 1. Each point stands
in the cell of each of its halves, and on one side of the join also in the cells one step up along each coordinate,
which meets every pair within distance 1 once. Pairs from a cell must pass the Manhattan bound
over all coordinates, then the exact count of differing bits, both inside the join.

Three bits of 64 find copies with hardly an edit. ``alike_groups`` finds every two texts whose sets of
five-word shingles (64-bit hashes of them) have a Jaccard similarity of 0.8 or more, exactly. It begins with the fingerprints of
these sets: those that are equal, or meet on the grid, are candidates, whose whole sets are compared. No grid of popcounts is
selective at the distance of two ninths of all shingles, so another
way bounds the candidates that are left: under any one order of all shingles, the first n - ceil(0.8 n) + 1 of the n of such texts have
one in common, and it is among the first n / 9 + 1 of the smaller. Texts meet by those, if their sizes and the places of the common shingle allow the similarity, and
their whole sets are compared. Before that, parities of the shingles in as many cells as there are shingles, or more, bound how
many they differ in from below. The order puts last what a sample knows as common, which only saves work; so does that
all texts of a shingle are first compared with one of them (that with the fewest rare shingles, as an original has among its
copies), then, where they are not in one group yet, with one outside its group, and only then with each other (of a shingle of two texts, both have met by then). Shingles of very
many texts are salted: each salt's texts meet one of theirs, and these meet as those of one shingle.

Counts are kept in unary (00, 01, 11), so that the Manhattan distance of two points is the
number of differing bits of their codes. Copies are one point; a point has some 26 rows of three longs.

Defined results: null text and text without a word have fingerprint zero and link like any
other, those without a word only with each other in ``alike_groups``; rows with null ``doc_id`` take part, and are their component's
name never (null if it has no other rows); rows with equal ``doc_id`` are one document, so their texts are linked; repeated
rows give repeated results; a very long text is hashed in sections for fingerprints, whole for sets; other columns, of whatever name, are not read by
``near_duplicates``, and ``keep_one`` returns them as they are; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER_ASCII, checkpointed, map_slices, shared_dir, utf8

SEED = 42
#: The bound that the two halves of the grid are made for: 3 = 1 + 2.
MOST_BITS = 3
_LOW = 0x5555555555555555
#: For exact sets: words of a shingle; the least Jaccard similarity is 4 / 5.
ALIKE_WIDTH = 5
#: One text in so many is sampled for common shingles; those in COMMON_LEAST of the sample are, COMMON_MOST at most.
SAMPLE, COMMON_LEAST, COMMON_MOST = 32, 3, 100_000
#: Odd factors that mix the hashes of a shingle's words.
_ODD = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9], dtype=np.uint64)
#: Longs of parities that each set has, at least.
PARITIES = 8
#: And at most.
MOST_PARITIES = 1 << 14
#: Texts of one shingle, or compared with one text, that a task handles together.
PER_SALT = 5000
#: Rows (of two longs and two numbers) up to which what is asked for is broadcast: some 32 MB; beyond it the texts are shuffled.
FEW = 500_000
#: Names of groups without a ``doc_id`` start here.
_NAMELESS = 1 << 62


def fingerprint(text: bytes, width: int = 3) -> int:
    """Of a text in UTF-8; a bit is set if over half of the shingles' hashes have it."""
    words = text.translate(LOWER_ASCII).split()
    if not words:
        return 0
    of = xxhash.xxh64_intdigest
    ones, n = np.zeros(64, dtype=np.int64), max(1, len(words) - width + 1)
    for start in range(0, n, 1 << 15):
        part = words[start : start + (1 << 15) + width - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(width)))) if len(part) > width else [b" ".join(part)]
        h = np.fromiter((of(x, SEED) for x in shingles), dtype=np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of each row, written to the shared folder."""
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t or b"", width) for t in utf8(batch.column(1))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    place = shared_dir(spark, "simhash")
    map_slices(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), run, "doc_id bigint, fp bigint", 1).write.parquet(place)
    return spark.read.schema("doc_id bigint, fp bigint").parquet(place)


def _popcounts(fp: Column) -> Column:
    """The ones of each two bits, in unary."""
    high, low = F.shiftrightunsigned(fp, 1), F.lit(_LOW)
    return fp.bitwiseOR(high).bitwiseAND(low).bitwiseOR(F.shiftleft(fp.bitwiseAND(high).bitwiseAND(low), 1))


def near_pairs(points: DataFrame) -> DataFrame:
    """(a, b) of every two rows of ``points`` (node, fp; fp distinct) that differ in at most ``MOST_BITS`` bits.

    With a column ``hash`` (under 2**29), only rows of the same hash meet, and fp is distinct within one.
    A pair can appear once for each half and hash.
    """
    if "hash" not in points.columns:
        points = points.withColumn("hash", F.lit(0).cast("bigint"))
    halves = [(F.col("u").bitwiseAND(F.lit(0xFFFFFFFF)), 0), (F.shiftrightunsigned("u", 32), 1)]
    grid = points.withColumn("u", _popcounts(F.col("fp")))

    def key(cell: Column, half: int) -> Column:
        return cell.bitwiseOR(F.lit(half << 32)).bitwiseOR(F.shiftleft(F.col("hash").cast("bigint"), 33))

    exact = grid.select("node", "fp", F.explode(F.array(*[key(c, h) for c, h in halves])).alias("cell"))
    steps = []
    for c, h in halves:
        for i in range(16):
            one, two = F.lit(1 << 2 * i), F.lit(2 << 2 * i)
            empty, full = c.bitwiseAND(one) == 0, c.bitwiseAND(two) != 0
            steps.append(F.when(empty, key(c.bitwiseOR(one), h)).when(~full, key(c.bitwiseOR(two), h)))
    upward = grid.select("node", "fp", F.explode(F.array_compact(F.array(*steps))).alias("cell")).withColumn("up", F.lit(True))
    right = exact.withColumn("up", F.lit(False)).unionByName(upward).select(F.col("node").alias("b"), F.col("fp").alias("fb"), "cell", "up")
    left = exact.select(F.col("node").alias("a"), F.col("fp").alias("fa"), "cell")
    manhattan = F.bit_count(_popcounts(F.col("fa")).bitwiseXOR(_popcounts(F.col("fb"))))
    bits = F.bit_count(F.col("fa").bitwiseXOR(F.col("fb")))
    once = F.col("up") | (F.col("fa") < F.col("fb"))
    pairs = left.join(right, (left["cell"] == right["cell"]) & once & (manhattan <= MOST_BITS) & (bits <= MOST_BITS))
    return pairs.select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node that ``edges`` (a, b) holds.

    Alternating stars: each round links the neighbours of a node to the smallest of them, first
    those above it, then those below; lineage is cut in the shared folder after each round.
    Only a count and a sum go to the driver.
    """

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = checkpointed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    before = mark(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = checkpointed(small.unionByName(lower.select("u", F.col("m").alias("v"))).distinct())
        now = mark(e)
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def clusters(fps: DataFrame) -> DataFrame:
    """fp, component_id and group (component_id, or a name in its place) of every distinct fingerprint of ``fps`` (doc_id, fp)."""
    nameless = F.lit(_NAMELESS).bitwiseOR(F.shiftrightunsigned("fp", 2))
    groups = checkpointed(fps.groupBy("fp").agg(F.min("doc_id").alias("first")).select("fp", F.coalesce("first", nameless).alias("node")))
    #: Fingerprints of one doc_id belong together.
    named = fps.where("doc_id is not null").join(groups, "fp").select("doc_id", "node").distinct()
    several = named.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("high")).where("a != high").select("doc_id", "a")
    again = named.join(several, "doc_id").where("node != a").select("a", F.col("node").alias("b"))
    found = components(near_pairs(groups).unionByName(again))
    whole = groups.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("group"))
    return whole.select("fp", F.when(F.col("group") < _NAMELESS, F.col("group")).alias("component_id"), "group")


def near_duplicates(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of each row."""
    fps = fingerprints(docs, width)
    joined = fps.join(clusters(fps), "fp")
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_set(text: bytes, width: int = ALIKE_WIDTH) -> np.ndarray:
    """Distinct hashes of the shingles, each mixed of its words' hashes in their order, sorted; a text of fewer words is one shingle, one without a word has none."""
    words = text.translate(LOWER_ASCII).split()
    if not words:
        return np.zeros(0, dtype=np.int64)
    each = np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(SEED)), dtype=np.uint64, count=len(words))
    width = min(width, len(words))
    found = np.full(len(words) - width + 1, width, dtype=np.uint64)
    for i in range(width):
        found = (found ^ each[i : i + len(found)]) * _ODD[0]
        found = (found ^ (found >> np.uint64(32))) * _ODD[1]
        found ^= found >> np.uint64(29)
    return np.unique(found.view(np.int64))


def _majority(own: np.ndarray) -> int:
    """The fingerprint of a set: a bit is set if over half of its hashes have it."""
    ones = np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(own), bitorder="little").view("<i8")[0])


def parities(own: np.ndarray, longs: int = PARITIES) -> np.ndarray:
    """Whether each cell has an odd number of the hashes; two sets differ in no fewer hashes than parities."""
    odd = np.bincount(own & (64 * longs - 1), minlength=64 * longs) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def fine_parities(own: np.ndarray) -> np.ndarray:
    """Parities in as many cells as there are hashes, or more, by powers of two: over fewer, half are odd in any case, which bounds nothing.

    Beyond ``64 * MOST_PARITIES`` hashes the bound is weaker.
    """
    return parities(own, min(MOST_PARITIES, max(PARITIES, 1 << max(0, len(own) - 1).bit_length() >> 6)))


def folded(fine: np.ndarray) -> np.ndarray:
    """The ``PARITIES`` longs that ``parities`` gives, from those of more cells."""
    return np.bitwise_xor.reduce(fine.reshape(-1, PARITIES), axis=0)


def can_be_alike(n: Column, odd: Column, m: Column, other: Column) -> Column:
    """Whether sets of ``n`` and ``m`` with these parities can agree by 4 / 5: they differ in (n + m) / 9 hashes at most."""
    return 9 * sum((F.bit_count(odd[i].bitwiseXOR(other[i])) for i in range(PARITIES)), F.lit(0)) <= n + m


def can_be_alike_finely(n: Column, fine: Column, m: Column, other: Column) -> Column:
    """``can_be_alike`` by ``fine_parities``: sizes that can agree have as many cells, or one has twice as many, whose halves are put together."""

    def halved(x: Column) -> Column:
        half = (F.size(x) / 2).cast("int")
        return F.zip_with(F.slice(x, 1, half), F.slice(x, half + 1, half), lambda a, b: a.bitwiseXOR(b))

    x = F.when(F.size(fine) > F.size(other), halved(fine)).otherwise(fine)
    y = F.when(F.size(other) > F.size(fine), halved(other)).otherwise(other)
    differ = F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda total, k: total + k)
    return (5 * F.least(n, m) >= 4 * F.greatest(n, m)) & (9 * differ <= n + m)


def _set_id(own: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes(), SEED)).view(np.int64))


def first_shingles(own: np.ndarray, common: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, int]:
    """Those of a set that every set of similarity 0.8 shares one with: ``common`` (sorted) comes last, by ``rank``.

    Also how many of the whole set are not common.
    """
    need = len(own) - (4 * len(own) + 4) // 5 + 1
    if not len(common):
        return own[:need], len(own)
    at = np.minimum(np.searchsorted(common, own), len(common) - 1)
    known = common[at] == own
    rare = own[~known]
    if len(rare) >= need:
        return rare[:need], len(rare)
    late = at[known]
    return np.concatenate([rare, common[late[np.argsort(rank[late], kind="stable")]]])[:need], len(rare)


def _common_shingles(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles that a sample of the distinct texts often has, sorted; the rank of each by its count; its texts by estimate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, n = np.unique(np.concatenate([shingle_set(t, width) for t in utf8(batch.column(0))]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(tokens), pa.array(n.astype(np.int64))], names=["token", "n"])

    sample = docs.select("text", F.xxhash64("text").alias("h")).where(F.col("text").isNotNull() & (F.pmod("h", F.lit(SAMPLE)) == 0)).dropDuplicates(["h"])
    counts = map_slices(sample.select("text"), run, "token bigint, n bigint", 0).groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON_LEAST)
    top = counts.orderBy(F.desc("n"), "token").limit(COMMON_MOST).toArrow()
    tokens, n = top["token"].to_numpy(), top["n"].to_numpy()
    order = np.argsort(tokens)
    rank = np.empty(len(tokens), dtype=np.int64)
    rank[np.lexsort((tokens, n))] = np.arange(len(tokens))
    return tokens[order], rank[order], n[order] * SAMPLE


#: A row by which a text can be found again: its ``doc_id``, or without one the hash of its text.
_ROW = "nameless boolean, key bigint"
_FIRST = _ROW + ", node bigint, n bigint, rare bigint, first array<bigint>, salts array<int>, fp bigint, odd array<bigint>, fine array<bigint>"
_MEMBER = "token bigint, salt int, node bigint, n bigint, rare bigint, pos int, hub bigint, hub_n bigint, hub_pos int, hub_rare bigint"
_WIDE = _MEMBER + ", wide boolean"
_AGREES = "a bigint, b bigint"


def _keyed(docs: DataFrame) -> DataFrame:
    """nameless, key, text of each row."""
    doc_id = F.col("doc_id").cast("bigint")
    return docs.select(doc_id.isNull().alias("nameless"), F.coalesce(doc_id, F.xxhash64("text")).alias("key"), "text")


def _salt(node: int, salts):
    """Which of so many salts a node has."""
    return ((node * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> 40) % salts


def _marked(docs: DataFrame, width: int) -> DataFrame:
    """Each row's key, the id, size, fingerprint and parities of its set, its first shingles and their salts (a set's shingles once per slice), written down."""
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(_common_shingles(docs, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, rank, texts = known.value
        for batch in batches:
            nodes, sizes, rares, firsts, salts, fps, fines, seen = [], [], [], [], [], [], [], set()
            for text in utf8(batch.column(2)):
                own = shingle_set(text or b"", width)
                node = _set_id(own)
                first, rare = first_shingles(own, common, rank)
                if node in seen:
                    first = first[:0]
                seen.add(node)
                many = np.ones(len(first), dtype=np.int64)
                if len(common) and len(first):
                    at = np.minimum(np.searchsorted(common, first), len(common) - 1)
                    many = np.where(common[at] == first, -(-texts[at] // PER_SALT), 1)
                nodes.append(node), sizes.append(len(own)), rares.append(rare), firsts.append(first), fps.append(_majority(own)), fines.append(fine_parities(own))
                salts.append(np.where(many > 1, 1 + _salt(node, np.maximum(many, 1)), 0))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(rares, pa.int64()), pa.array(firsts, pa.list_(pa.int64())), pa.array(salts, pa.list_(pa.int32())), pa.array(fps, pa.int64()), pa.array(map(folded, fines), pa.list_(pa.int64())), pa.array(fines, pa.list_(pa.int64()))],
                names=["nameless", "key", "node", "n", "rare", "first", "salts", "fp", "odd", "fine"],
            )

    place = shared_dir(spark, "shingles")
    map_slices(_keyed(docs), run, _FIRST, 2).write.parquet(place)
    return spark.read.schema(_FIRST).parquet(place)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (token, salt, node, n, rare, pos) in this order of token, salt, rare, node: those of runs of several nodes, with the run's first.

    A run that is one of a token's salts is given out even if it is of one node. Nothing but a run's first row is held.
    """
    held: tuple | None = None  # the first row of the run at hand, if no other node has come
    hub: tuple | None = None
    last = None
    for batch in batches:
        cols = [c.to_numpy() for c in batch.columns]
        token, salt, node = cols[:3]
        n = len(token)
        if not n:
            continue
        start = np.ones(n, dtype=bool)
        start[1:] = (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])
        if hub is not None:
            start[0] = (token[0], salt[0]) != hub[:2]
        again = np.zeros(n, dtype=bool)
        again[1:] = ~start[1:] & (node[1:] == node[:-1])
        again[0] = not start[0] and node[0] == last
        last = node[-1]
        #: Row numbers of the runs' first rows; -1 for the run that goes on from the batch before.
        first = np.maximum.accumulate(np.where(start, np.arange(n), -1))
        other = ~start & ~again
        own = np.where(first >= 0, first, 0)
        several = np.zeros(n, dtype=bool)
        several[own[other & (first >= 0)]] = True
        more = (other & (first < 0)).any()
        keep = other | (start & (several | (salt > 0)))
        out = []
        if held is not None and (more or start[0]):
            if more:
                out.append([np.array([x]) for x in (*held, held[2], held[3], held[5], held[4])])
            held = None
        k = np.flatnonzero(keep)
        if len(k):
            f = first[k]
            hubs = [np.where(f >= 0, c[np.maximum(f, 0)], hub[i] if hub is not None else 0) for i, c in ((2, cols[2]), (3, cols[3]), (5, cols[5]), (4, cols[4]))]
            out.append([c[k] for c in cols] + hubs)
        if start.any():
            i = int(np.flatnonzero(start)[-1])
            hub = tuple(c[i] for c in cols)
            held = hub if not keep[i] else None
        for columns in out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64()))],
                names=[x.split()[0] for x in _MEMBER.split(", ")],
            )


def _widths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to what ``_meet`` gives whether a run is one of a token's salts or has more than two rows; of two, both have met.

    Of a batch's last run, up to two rows are held until it is known.
    """
    names = [x.split()[0] for x in _WIDE.split(", ")]
    held, wide = None, None  # rows of the last run while they are two at most; its token and salt once they are more
    for batch in batches:
        if held is not None:
            batch = pa.concat_batches([held, batch])
        if not batch.num_rows:
            continue
        token, salt = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        start = np.ones(len(token), dtype=bool)
        start[1:] = (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])
        run = np.cumsum(start) - 1
        many = np.bincount(run) > 2
        many[0] |= wide == (token[0], salt[0])
        held, wide, end = None, (token[-1], salt[-1]) if many[-1] else None, len(token)
        if not many[-1]:
            end = int(np.flatnonzero(start)[-1])
            held = batch.slice(end)
        if end:
            yield pa.RecordBatch.from_arrays([*batch.slice(0, end).columns, pa.array((many[run] | (salt > 0))[:end])], names=names)
    if held is not None:
        yield pa.RecordBatch.from_arrays([*held.columns, pa.array(held.column(1).to_numpy() > 0)], names=names)


def _few(df: DataFrame) -> DataFrame:
    """To be broadcast if it has ``FEW`` rows at most."""
    return F.broadcast(df) if df.count() <= FEW else df


def can_agree(n: Column, at: Column, m: Column, other: Column) -> Column:
    """Whether sets of ``n`` and ``m`` can agree by 4 / 5 that have their first common shingle here: so many come after it at most."""
    return (5 * F.least(n, m) >= 4 * F.greatest(n, m)) & (9 * F.least(n - at, m - other) >= 4 * (n + m))


def _asked(pairs: DataFrame) -> tuple[DataFrame, bool]:
    """node, with (its pairs' b, and how many salts that has) and many (its own salts as a b) of every node of ``pairs``; whether few enough to broadcast."""
    many = pairs.groupBy("b").agg(F.ceil(F.count("*") / PER_SALT).cast("int").alias("many"))
    mine = pairs.join(many, "b").groupBy(F.col("a").alias("node")).agg(F.collect_list(F.struct("b", "many")).alias("with"))
    asked = checkpointed(mine.join(many.withColumnRenamed("b", "node"), "node", "full"))
    rows = asked.agg(F.count("*") + F.coalesce(F.sum(F.greatest(F.size("with"), F.lit(0))), F.lit(0))).first()[0]
    return asked, rows <= FEW


def _agreeing(sent: DataFrame, agree) -> DataFrame:
    """The pairs of ``sent`` (b, salt, second, a, n, own) for which ``agree`` (n and values of both) holds.

    The values of ``b`` come, once for each salt, before those that are compared with them, so a task holds one set, and a
    text of very many pairs is dealt over many tasks.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, whole = None, 0, None
        for batch in batches:
            found = []
            sizes, own = batch.column(4).to_pylist(), batch.column(5)
            for i, (b, second, a) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                if not second:
                    if held != b:
                        held, size, whole = b, sizes[i], np.sort(own[i].values.to_numpy())
                elif held == b:
                    other = own[i].values.to_numpy()
                    both = int((whole[np.minimum(np.searchsorted(whole, other), len(whole) - 1)] == other).sum()) if len(whole) else 0
                    if agree(size, sizes[i], both):
                        found.append((a, b))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])

    n = int(sent.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sent.repartition(n, "b", "salt").sortWithinPartitions("b", "salt", "second").mapInArrow(compare, _AGREES)


def _verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame, width: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose whole sets agree by 4 / 5.

    First by their parities, which are written down; of the pairs that these leave, every text is hashed again where it lies,
    and whole sets are compared.
    """
    x, y = (sets.select(F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("fine").alias(f"fine{k}")) for k in "ab")
    likely = pairs.join(x, "a").join(y, "b").where(can_be_alike_finely(F.col("na"), F.col("finea"), F.col("nb"), F.col("fineb"))).select("a", "b")
    asked, few = _asked(checkpointed(likely.distinct()))
    small = (lambda df: F.broadcast(df)) if few else (lambda df: df)
    keyed = small(asked).join(sets, "node").select(F.col("nameless").alias("_nameless"), F.col("key").alias("_key"), "node", "with", "many")
    keyed = checkpointed(keyed)
    texts = _keyed(docs).join(small(keyed), (F.col("key") == F.col("_key")) & (F.col("nameless") == F.col("_nameless"))).select("text", "node", "with", "many")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
        for batch in batches:
            rows = []
            for text, node, wanted, many in zip(utf8(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                own = shingle_set(text or b"", width)
                if _set_id(own) != node:  # another text of the same doc_id
                    continue
                rows += [(node, salt, False, node, len(own), own) for salt in range(many or 0)]
                rows += [(x["b"], _salt(node, x["many"]), True, node, len(own), own) for x in wanted or ()]
            for i in range(0, len(rows), 256):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 256]), kinds)], names=["b", "salt", "second", "a", "n", "own"])

    sent = map_slices(texts, send, "b bigint, salt int, second boolean, a bigint, n bigint, own array<bigint>", 0)
    return _agreeing(sent, lambda n, m, both: 9 * both >= 4 * (n + m)).distinct()


def alike_groups(docs: DataFrame, width: int = ALIKE_WIDTH) -> DataFrame:
    """nameless and key of a row of every distinct set of shingles, its node (a hash), component_id and group."""
    spark = docs.sparkSession
    marked = _marked(docs, width)
    of_node = [F.first(c).alias(c) for c in ("n", "rare", "fp", "odd", "fine")]
    sets = checkpointed(marked.groupBy("node").agg(F.min(F.struct("nameless", "key")).alias("row"), *of_node).select("node", "row.*", "n", "rare", "fp", "odd", "fine"))
    #: Texts of one fingerprint meet one of theirs, and these meet on the grid.
    points = checkpointed(sets.groupBy("fp").agg(F.min_by("node", F.struct("rare", "node")).alias("head")))
    copies = sets.join(points, "fp").where("node != head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    near = copies.unionByName(near_pairs(points.select(F.col("head").alias("node"), "fp")))
    named = marked.where("not nameless").groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("high")).where("a != high").select("key", "a")
    #: Rows with equal doc_id are one document.
    again = marked.where("not nameless").join(named, "key").where("node != a").select("a", F.col("node").alias("b")).distinct()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tokens = marked.select("node", "n", "rare", F.posexplode(F.arrays_zip("first", "salts")).alias("pos", "f"))
    tokens = tokens.select(F.col("f.first").alias("token"), F.col("f.salts").alias("salt"), "node", "n", "rare", "pos")
    place = shared_dir(spark, "members")
    tokens.repartition(parts, "token", "salt").sortWithinPartitions("token", "salt", "rare", "node").mapInArrow(lambda rows: _widths(_meet(rows)), _WIDE).write.parquet(place)
    members = spark.read.schema(_WIDE).parquet(place)

    def pairs_of(met: DataFrame) -> DataFrame:
        """(a, b) of rows with x (node, n, rare, pos) and the like y, where y comes first."""
        fits = met.where((F.col("x.node") != F.col("y.node")) & can_agree(F.col("x.n"), F.col("x.pos"), F.col("y.n"), F.col("y.pos")))
        return fits.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()

    x = F.struct("node", "n", "rare", "pos").alias("x")
    y = F.struct(F.col("hub").alias("node"), F.col("hub_n").alias("n"), F.col("hub_rare").alias("rare"), F.col("hub_pos").alias("pos"))
    #: The first texts of a token's salts meet the first of them.
    heads = members.where("salt > 0 and node = hub").select("token", x)
    best = heads.groupBy("token").agg(F.min_by("x", F.struct("x.rare", "x.node")).alias("y"))
    met = members.select(x, y.alias("y")).unionByName(heads.join(best, "token").select("x", "y"))
    tried = checkpointed(pairs_of(met).unionByName(near).distinct())
    links = checkpointed(_verified(tried, docs, sets, width))

    order = F.struct("x.rare", "x.node")

    def apart(found: DataFrame) -> DataFrame:
        """token, x, part, q of the members of tokens whose texts are not all in one group; q is the group of the first, by what it has of rare shingles.

        Tokens of two texts and those that are among the first n / 9 + 1 of none of theirs are left out.
        """
        found = _few(found)
        placed = members.where("wide").select("token", x).join(found, F.col("x.node") == F.col("node"), "left")
        placed = checkpointed(placed.select("token", "x", F.coalesce("component", "x.node").alias("part")))
        mixed = placed.groupBy("token").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.min_by("part", order).alias("q"), F.min(9 * F.col("x.pos") - F.col("x.n")).alias("at")).where("low != high and at <= 0")
        return checkpointed(placed.join(_few(checkpointed(mixed.select("token", "q"))), "token"))

    def untried(met: DataFrame) -> DataFrame:
        turned = tried.select(F.col("a").alias("b"), F.col("b").alias("a"))
        return checkpointed(pairs_of(met).join(tried, ["a", "b"], "left_anti").join(turned, ["a", "b"], "left_anti"))

    #: The first text that is outside the group of the first of all meets those of other groups.
    found = components(links)
    left = apart(found)
    second = left.where("part != q").groupBy("token").agg(F.min_by(F.struct("x", "part"), order).alias("h"))
    fresh = untried(left.join(second, "token").where(F.col("part") != F.col("h.part")).select("x", F.col("h.x").alias("y")))
    if not fresh.isEmpty():
        new = checkpointed(_verified(fresh, docs, sets, width))
        links, tried = links.unionByName(new), tried.unionByName(fresh)
        if not new.isEmpty():
            found = components(links)
            left = apart(found)

    #: What is apart still: each with each of the shingle, by sizes that can agree (a step is a factor of 5 / 4), if the parities
    #: allow it; of the smaller set the shingle must be among the first n / 9 + 1.
    step = F.floor(F.log("x.n") / F.log(F.lit(1.25)))
    lower = left.drop("q").withColumn("step", step)
    lower = lower.join(sets.select("node", "odd"), F.col("x.node") == F.col("node")).drop("node")
    upper = lower.where("9 * x.pos <= x.n").select("token", F.col("x").alias("y"), F.col("part").alias("q"), F.col("odd").alias("other"), F.explode(F.array("step", F.col("step") + 1)).alias("step"))
    ordered = (F.col("x.n") > F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.node") > F.col("y.node")))
    fits = can_agree(F.col("x.n"), F.col("x.pos"), F.col("y.n"), F.col("y.pos"))
    rest = untried(lower.join(upper, ["token", "step"]).where(ordered & (F.col("part") != F.col("q")) & fits & can_be_alike(F.col("x.n"), F.col("odd"), F.col("y.n"), F.col("other"))).select("x", "y"))
    if not rest.isEmpty():
        again = again.unionByName(_verified(rest, docs, sets, width))
    again = checkpointed(again)
    if not again.isEmpty():
        found = components(links.unionByName(again))
    labelled = checkpointed(sets.join(found, "node", "left").withColumn("part", F.coalesce("component", "node")))
    names = labelled.where("not nameless").groupBy("part").agg(F.min("key").alias("component_id"))
    nameless = F.lit(_NAMELESS).bitwiseOR(F.shiftrightunsigned("part", 2))
    return labelled.join(names, "part", "left").select("nameless", "key", "node", "component_id", F.coalesce("component_id", nameless).alias("group"))


def keep_one(docs: DataFrame, width: int = ALIKE_WIDTH) -> DataFrame:
    """The documents, whole rows, but of each group of texts whose sets of shingles agree by 0.8 only that with the smallest ``doc_id``.

    Of several rows with that ``doc_id``, the one stays whose text has the least hash. Rows without ``doc_id`` stay
    only where their group has no other: one of them, that with the least hash.
    """
    groups = checkpointed(alike_groups(docs, width).groupBy("group").agg(F.min(F.struct("nameless", "key")).alias("row")).select("row.*"))
    own = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    doc_id, text = (F.col(f"c{docs.columns.index(c)}") for c in ("doc_id", "text"))
    doc_id = doc_id.cast("bigint")
    keyed = own.select(F.struct(*own.columns).alias("whole"), doc_id.isNull().alias("nameless"), F.coalesce(doc_id, F.xxhash64(text)).alias("key"), F.xxhash64(text).alias("h"))
    kept = keyed.join(groups, ["nameless", "key"], "left_semi")
    one = kept.groupBy("nameless", "key").agg(F.min_by("whole", "h").alias("whole"))
    return one.select("whole.*").toDF(*docs.columns)
