"""Line-first cleaning.

Every line of a text is judged by itself; the lines that fail are taken out, and a document
that loses too much of its text is rejected. One pass over the rows without a shuffle, so
neither a hot source nor a group of copies matters; memory holds one slice of a batch. Words and windows are
compared by 64-bit hashes within a text, so ``n_repeat_words`` is exact up to a collision there.

Defined results: null text counts as empty (no words, base failed, not kept, cleaned text
empty). Repeated rows, and rows with equal or null ``doc_id``, give results each by itself; a very long text is judged whole; a line
that breaks several rules fails once. Other columns, of whatever name, are not read by ``quality``, and ``keep_good`` returns them as
they are (but ``n_chars``, the size of the text). An empty table gives no row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import SPACE_BYTES, map_slices, utf8

SCHEMA = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
    "n_repeat_words bigint, base_failed boolean, kept boolean, lost_share double, clean_text string"
)
WINDOW = 5
SYMBOLS = b"#*$%&|<>"
_NOT_LEAD = bytes(range(0x80, 0xC0))
_CAPITALS = bytes(range(0x41, 0x5B))
_LETTERS = _CAPITALS + bytes(range(0x61, 0x7B))

_BOILERPLATE = re.compile(
    rb"all rights reserved|cookie (?:policy|settings|preferences)|accept (?:all )?cookies|privacy policy|"
    rb"terms (?:of (?:use|service)|and conditions)|enable javascript|javascript (?:is )?(?:required|disabled)|"
    rb"click here|read more|sign (?:in|up)|log ?in|subscribe (?:now|to)|share (?:this|on)|follow us|"
    rb"skip to (?:main )?content|back to top|lorem ipsum|powered by|page not found|add to cart",
    re.IGNORECASE,
)
_NAV_MARK = re.compile(rb"\s(?:\||\xc2\xbb|\xe2\x80\xba|>|/|\xc2\xb7|\xe2\x80\xa2)(?=\s|$)")
_RUN_MARK = re.compile(rb"[!?#*$%&|<>=~^_+]{2,}")
_CLOSERS = b"\"')]}\xbb\x9d\x99"
_ENDS = (b".", b"!", b"?", b":", b";", b"\xe2\x80\xa6", b"\xe3\x80\x82")


@dataclass(frozen=True)
class LineRules:
    """Thresholds of the line rules and of the verdict on the document."""

    nav_share: float = 0.15  #: separators per word from which a line is a menu
    nav_least: int = 3  #: separators that a menu has at least
    mark_share: float = 0.3  #: runs of marks per word from which a line is decoration
    upper_share: float = 0.7  #: capital letters among ASCII letters from which a line shouts
    boiler_words: int = 15  #: a boilerplate phrase condemns lines up to this many words
    open_words: int = 12  #: a line without final punctuation fails from this many words on if it also repeats
    distinct_share: float = 0.6  #: distinct words per word below which such a line repeats
    most_lost: float = 0.5  #: share of the word characters whose loss rejects the document


def line_fault(line: bytes, words: list[bytes], rules: LineRules = LineRules()) -> str | None:
    """The first rule that the line breaks: 'navigation', 'marks', 'shouting', 'boilerplate', 'open'; else None."""
    n = len(words)
    if not n:
        return None
    marks = len(_NAV_MARK.findall(b" " + line))
    if marks >= rules.nav_least and marks >= rules.nav_share * n:
        return "navigation"
    runs = len(_RUN_MARK.findall(line))
    if n >= 3 and runs >= rules.mark_share * n:
        return "marks"
    letters = len(line) - len(line.translate(None, _LETTERS))
    if n >= 5 and letters and len(line) - len(line.translate(None, _CAPITALS)) >= rules.upper_share * letters:
        return "shouting"
    if n <= rules.boiler_words and _BOILERPLATE.search(line):
        return "boilerplate"
    end = words[-1].rstrip(_CLOSERS)
    if n >= rules.open_words and not end.endswith(_ENDS) and len(set(words)) < rules.distinct_share * n:
        return "open"
    return None


def _repeat_words(hashes: list[np.ndarray]) -> np.ndarray:
    """Per document: words inside a window of five that the document has twice or more."""
    counts = np.zeros(len(hashes), dtype=np.int64)
    long = [i for i, h in enumerate(hashes) if len(h) > WINDOW]
    if not long:
        return counts
    sizes = np.array([len(hashes[i]) for i in long])
    h = np.concatenate([hashes[i] for i in long]).astype(np.uint64)
    n = len(h)
    key = np.zeros(n - WINDOW + 1, dtype=np.uint64)
    for k in range(WINDOW):
        x = h[k : n - WINDOW + 1 + k]
        key = (key ^ (x * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
        key ^= key >> np.uint64(32)
    doc = np.repeat(np.arange(len(long), dtype=np.uint64), sizes)
    first = np.cumsum(sizes) - sizes
    last = first + sizes - WINDOW  # of the windows that stay inside the document
    inside = np.zeros(n + 1, dtype=np.int64)
    np.add.at(inside, first, 1)
    np.add.at(inside, last + 1, -1)
    starts = np.flatnonzero(np.cumsum(inside[:n]))
    key = key[starts] ^ (doc[starts] * np.uint64(0xC2B2AE3D27D4EB4F))
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = s[1:] == s[:-1]
    twice = np.zeros(len(s), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    hit = starts[order[twice]]
    cover = np.zeros(n + 1, dtype=np.int64)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + WINDOW, -1)
    covered = np.cumsum(cover[:n]) > 0
    counts[long] = np.add.reduceat(covered.astype(np.int64), first)
    return counts


def _judge(texts: list[bytes], rules: LineRules, with_text: bool):
    hashes, rows = [], []
    for text in texts:
        words = text.split()
        hashes.append(np.fromiter(map(hash, words), dtype=np.int64, count=len(words)))
        chars = len(text) - len(text.translate(None, SPACE_BYTES)) if text else 0
        word_chars = len(text.translate(None, _NOT_LEAD)) - chars
        symbols = len(text) - len(text.translate(None, SYMBOLS))
        seen: set[bytes] = set()
        dup, lost, clean = 0, 0, []
        for line in text.split(b"\n"):
            own = line.split()
            if not own:
                clean.append(line)
                continue
            if line in seen:
                dup += 1
            else:
                seen.add(line)
            if line_fault(line, own, rules):
                lost += len(b"".join(own).translate(None, _NOT_LEAD))
            else:
                clean.append(line)
        rows.append((len(words), word_chars, symbols, dup, lost, b"\n".join(clean).decode() if with_text else None))
    repeats = _repeat_words(hashes)
    for (n, word_chars, symbols, dup, lost, clean), again in zip(rows, repeats.tolist()):
        failed = n < 10 or 100 * again > 20 * n
        share = lost / word_chars if word_chars else 0.0
        yield n, word_chars, symbols, dup, again, failed, not failed and share <= rules.most_lost, share, clean


def quality(docs: DataFrame, rules: LineRules = LineRules(), with_text: bool = True) -> DataFrame:
    """One row per document with the base figures, the verdict and the text that stays (``with_text``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", *(x.split()[0] for x in SCHEMA.split(", ")[1:])]
        for batch in batches:
            texts = [t or b"" for t in utf8(batch.column(1))]
            out = list(zip(*_judge(texts, rules, with_text)))
            if not out:
                continue
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, k) for c, k in zip(out, kinds))], names=names)

    return map_slices(docs.select("doc_id", "text"), run, SCHEMA, 1)


def keep_good(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """The documents that the rules keep, decided row by row; failed lines are gone from their text."""
    at = docs.columns.index("text")
    size = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in utf8(batch.column(at))]
            judged = list(_judge(texts, rules, True))
            keep = [row[6] for row in judged]
            if not any(keep):
                continue
            own = batch.filter(pa.array(keep))
            if any(row[6] and row[7] for row in judged):
                columns = list(own.columns)
                clean = [row[8] for row in judged if row[6]]
                columns[at] = pa.array(clean, own.schema.field(at).type)
                if size is not None:
                    columns[size] = pa.array([len(t) for t in clean]).cast(own.schema.field(size).type)
                own = pa.RecordBatch.from_arrays(columns, schema=own.schema)
            yield own

    return map_slices(docs, run, docs.schema, at)
