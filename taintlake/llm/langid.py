"""Language identification: known words first, then ever shorter character n-grams.

A word that the training rows hold is scored by its log frequency in each language. A word
that they do not hold falls back to its 5-grams (word ends marked), then 4-, 3-, 2- and
1-grams: the first length of which any gram is known decides. A text's scores are the sums
over its words; the best language wins, ties by name.

Fitting reads a bounded sample of the labelled rows: per language the documents whose hashed
``doc_id`` falls under ``sample_docs / count``, about ``sample_docs`` of them, and keeps at
most ``max_entries`` words or grams of each length. Both bounds are parameters, so the model
that is broadcast has a proven size. Prediction is one pass over the rows without a shuffle.

Defined results: null text, or text without a letter, is ``und`` with score 0; without any
labelled row every text is ``und``. Rows with null ``doc_id`` are never held out nor learned
from. Repeated rows give repeated results. Languages of equal score go by name. A very long text is scored in sections, a very
long word by its grams. ``lang``, ``source`` and ``doc_id`` are no inputs of a prediction; other columns, of whatever name, are
not read, and ``keep_known`` returns them as they are. An empty table gives no row.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import checkpointed, map_slices

UND = "und"
ORDERS = (5, 4, 3, 2, 1)
_WORD = re.compile(r"[^\W\d_]+").findall
#: A word with more letters than this is scored by its grams alone, so that no key is long.
LONGEST_WORD = 40
#: What can stand around a word without changing which words a chunk has.
_MARKS = ".,!?;:()[]{}\"'|%&*$#<>"
#: Scores of distinct chunks that a worker keeps before it starts anew.
CACHE = 250_000


@dataclass(frozen=True)
class Model:
    langs: list[str]
    #: tables[0] has words, tables[n] the n-grams: text -> row of ``scores[n]``
    tables: dict[int, dict[str, int]]
    scores: dict[int, np.ndarray]


def words_of(text: str) -> list[str]:
    """The runs of letters; the pattern also takes numerals such as ``\u00bd`` and ``\u2167``, which part words."""
    found = _WORD(text)
    if all(map(str.isalpha, found)):
        return found
    return ["".join(run) for word in found for letters, run in groupby(word, str.isalpha) if letters]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def grams(word: str, n: int) -> list[str]:
    padded = f"<{word}>" if n > 1 else word
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def fit(docs: DataFrame, sample_docs: int = 1500, max_entries: int = 60_000, smooth: float = 0.5) -> Model:
    """Learns from ``text`` and ``lang`` of the rows that are not held out."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "lang")
    rows = rows.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], {}, {})
    share = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, sample_docs / sizes[k])))])
    drawn = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("langid")), F.lit(1 << 20)) < share[F.col("lang")] * float(1 << 20)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows_of(found: Counter) -> pa.RecordBatch:
            keys = list(found)
            return pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.string()), pa.array([found[k] for k in keys], pa.int64())],
                names=["lang", "n", "entry", "c"],
            )

        for batch in batches:
            by_lang: dict[str, Counter] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by_lang.setdefault(lang, Counter()).update(words_of(text.lower()))
            found: Counter = Counter()
            for lang, words in by_lang.items():
                for word, c in words.items():
                    if len(word) <= LONGEST_WORD:
                        found[lang, 0, word] += c
                    for n in ORDERS:
                        for g in grams(word[:LONGEST_WORD], n):
                            found[lang, n, g] += c
            if found:
                yield rows_of(found)

    counted = map_slices(rows.where(drawn & F.col("text").isNotNull()).select("text", "lang"), count, "lang string, n int, entry string, c bigint", 0)
    counted = checkpointed(counted.groupBy("lang", "n", "entry").agg(F.sum("c").alias("c")))
    wide = counted.groupBy("n", "entry").agg(F.sum("c").alias("all"), F.map_from_entries(F.collect_list(F.struct("lang", "c"))).alias("by"))
    wide = wide.where((F.col("n") > 0) | (F.col("all") > 1))
    top = W.partitionBy("n").orderBy(F.desc("all"), "entry")
    kept = wide.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= max_entries)
    totals = {(r["lang"], r["n"]): r["c"] for r in counted.groupBy("lang", "n").agg(F.sum("c").alias("c")).collect()}
    table = kept.select("n", "entry", *[F.coalesce(F.col("by")[k], F.lit(0)).alias(f"c{i}") for i, k in enumerate(langs)]).toArrow()
    order, entry = table.column("n").to_pylist(), table.column("entry").to_pylist()
    counts = np.stack([table.column(f"c{i}").to_numpy() for i in range(len(langs))], axis=1).astype(np.float64) if len(order) else np.zeros((0, len(langs)))
    tables: dict[int, dict[str, int]] = {}
    scores: dict[int, np.ndarray] = {}
    for n in (0, *ORDERS):
        at = [i for i, x in enumerate(order) if x == n]
        own = counts[at]
        whole = np.array([totals.get((k, n), 0) for k in langs], dtype=np.float64)
        tables[n] = {entry[i]: j for j, i in enumerate(at)}
        scores[n] = np.log((own + smooth) / (whole + smooth * (len(at) + 1)))
    return Model(langs, tables, scores)


def word_scores(model: Model, word: str) -> np.ndarray:
    """Per language; grams count as one word: their mean."""
    at = model.tables[0].get(word) if len(word) <= LONGEST_WORD else None
    if at is not None:
        return model.scores[0][at]
    for n in ORDERS:
        known = [i for g in grams(word, n) if (i := model.tables[n].get(g)) is not None]
        if known:
            return model.scores[n][known].mean(axis=0)
    return np.zeros(len(model.langs))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Predictor(shared.value)
        for batch in batches:
            found = [best(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return map_slices(slim, run, "doc_id bigint, held_out boolean, lang_pred string, score double", 2)


def keep_known(docs: DataFrame, model: Model, min_score: float = 0.4) -> DataFrame:
    """The documents, whole rows, whose language is known with ``min_score`` or more."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Predictor(shared.value)
        for batch in batches:
            found = [best(t) for t in batch.column(at).to_pylist()]
            keep = [k != UND and s >= min_score for k, s in found]
            if any(keep):
                yield batch.filter(pa.array(keep))

    return map_slices(docs, run, docs.schema, at)


class _Predictor:
    """Scores texts; keeps the score vectors of distinct chunks between white space, as rows of one array.

    The first rows are the model's words, so a chunk that is one of them, with or without marks,
    needs no arithmetic.
    """

    def __init__(self, model: Model):
        self.model, self.size = model, len(model.langs)
        self.words = model.tables.get(0, {})
        self.seen: dict[str, int] = {}
        first = len(self.words)
        self.rows = np.ones((first + CACHE, self.size + 1))
        if first:
            self.rows[:first, :-1] = model.scores[0]
        self.free = first

    def _row(self, chunk: str) -> int:
        at = self.words.get(chunk.strip(_MARKS))
        if at is None:
            at, words = self.free, words_of(chunk)
            self.free += 1
            self.rows[at, :-1] = sum((word_scores(self.model, w) for w in words), np.zeros(self.size)) if len(words) != 1 else word_scores(self.model, words[0])
            self.rows[at, -1] = len(words)
        self.seen[chunk] = at
        return at

    def __call__(self, text: str | None) -> tuple[str, float]:
        if not text or not self.size:
            return UND, 0.0
        total = np.zeros(self.size + 1)
        chunks = text.lower().split()
        for start in range(0, len(chunks), 4096):
            part = chunks[start : start + 4096]
            if len(self.seen) > CACHE or self.free + len(part) > len(self.rows):
                self.seen.clear()
                self.free = len(self.words)
            get, row = self.seen.get, self._row
            total += self.rows[[i if (i := get(c)) is not None else row(c) for c in part]].sum(axis=0)
        n = total[-1]
        if not n:
            return UND, 0.0
        mean = total[:-1] / n
        best = int(np.argmax(mean))
        #: As if the text had ten words at most, so that long texts keep a graded score.
        odds = np.exp((mean - mean[best]) * min(n, 10.0))
        return self.model.langs[best], float(1.0 / odds.sum())
