"""Licence scan by ordered signatures.

Each text becomes its words, ASCII lower case, with one blank between them. A first pattern
of all keywords tells which keywords a text has; only rules with a keyword in the text are
tried. Detections are sorted by priority (then length, start, rule order); one that lies
inside another of higher standing is suppressed. The labels of the four base phrases are
counted by themselves and always stay.

One pass over the rows without a shuffle. Defined results: null counts as empty (no word,
no place, empty labels, score 0); repeated rows and rows with null ``doc_id`` give results each by itself; a very long text is scanned
whole, in time that grows as its length and detections do; detections of equal standing rank by length, start and rule; other columns, of
whatever name, are not read; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices, utf8
from .license_rules import BASE, Rule, rules

SCHEMA = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"

#: Bytes of words in lower case; all other ASCII bytes become blanks.
_FOLD = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


@cache
def _compiled():
    own = rules()
    by_word: dict[bytes, list[Rule]] = {}
    for rule in own:
        by_word.setdefault(rule.keyword, []).append(rule)
    #: Every keyword or base phrase holds one of these; most texts have none and end here.
    stems = {k for k in by_word} | {p.encode() for p, _ in BASE} | {b"licen", b"gpl", b"cc "}
    short: list[bytes] = []
    for k in sorted(stems, key=len):
        if not any(s in k for s in short):
            short.append(k)
    return by_word, short


def detections(words: bytes) -> list[tuple[int, int, Rule]]:
    """(start, end, rule) of the signatures that stand in ``words``, overlaps resolved, by start."""
    by_word, _ = _compiled()
    found = [(m.start(), m.end(), rule) for keyword, own in by_word.items() if keyword in words for rule in own for m in rule.pattern.finditer(words)]
    found.sort(key=lambda x: (-x[2].priority, x[0] - x[1], x[0], x[2].order))
    #: furthest[i]: the furthest end of what is kept and starts at one of the places that node i of a Fenwick tree covers.
    places = sorted({start for start, _, _ in found})
    number = {start: i for i, start in enumerate(places, 1)}
    furthest = [0] * (len(places) + 1)
    kept: list[tuple[int, int, Rule]] = []
    for start, end, rule in found:
        i, most = number[start], 0
        while i:
            most = max(most, furthest[i])
            i &= i - 1
        if most >= end:
            continue
        kept.append((start, end, rule))
        i = number[start]
        while i <= len(places):
            furthest[i] = max(furthest[i], end)
            i += i & -i
    return sorted(kept, key=lambda x: (x[0], x[1]))


def _places(words: bytes, phrase: bytes) -> list[int]:
    """Byte offsets of the phrase as whole words, overlaps included."""
    out, at = [], words.find(phrase)
    while at >= 0:
        end = at + len(phrase)
        if (at == 0 or words[at - 1] == 32) and (end == len(words) or words[end] == 32):
            out.append(at)
        at = words.find(phrase, at + 1)
    return out


def scan_words(words: bytes) -> tuple[int, int | None, int | None, str, str, float]:
    """n_base, first_word, last_word, base_labels, labels, score of words joined by one blank."""
    _, gate = _compiled()
    if not any(stem in words for stem in gate):
        return 0, None, None, "", "", 0.0
    places, base = [], set()
    for phrase, label in BASE:
        if own := _places(words, phrase.encode()):
            places += own
            base.add(label)
    found = detections(words)
    labels = base | {rule.label for _, _, rule in found}
    score = max([rule.priority / 100 for _, _, rule in found] + [0.5] * bool(base), default=0.0)
    if not places:
        return 0, None, None, "", ",".join(sorted(labels)), score
    first, last = words.count(b" ", 0, min(places)), words.count(b" ", 0, max(places))
    return len(places), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score


def scan(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        for batch in batches:
            out = []
            for text in utf8(batch.column(1)):
                words = (text or b"").translate(_FOLD).split(b" ")
                words = [w for w in words if w]
                out.append((len(words), *scan_words(b" ".join(words))))
            if out:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*out), kinds))], names=names)

    return map_slices(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), run, SCHEMA, 1)
