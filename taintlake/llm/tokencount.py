"""Token counts under a unigram model, with forward scores shared over a trie of pre-tokens.

A vocabulary of pieces with scores gives each text the segmentation of the highest total
score. Pieces never run from a non-blank into a blank, so pre-tokens (blanks, then non-blanks)
can be segmented by themselves. The distinct pre-tokens of a batch are inserted in a trie;
one walk over it computes the forward score of every prefix once, however many pre-tokens
share it, and stores the count of pieces where a pre-token ends.

Characters that no piece holds cost ``UNK_PENALTY`` more than the worst piece (but for those
with a score under ``BARRED``, which models use to bar a piece) and count one piece for each
UTF-8 byte (byte fallback). Ties go to the longer last piece.

One pass over the rows without a shuffle. A worker keeps counts of at most ``CACHE``
pre-tokens and builds tries of at most ``TRIE_CHARS`` characters. Defined results: null counts as empty
text (0 tokens); a pre-token of more than ``LONG`` characters is scored by itself, with the same result, holding no
more than the longest piece needs; repeated rows repeat; other columns, of whatever name, are not read; an empty table gives no row.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices

BLANK = "▁"
UNK_PENALTY = 10.0
BARRED = -1e6
CACHE = 600_000
TRIE_CHARS = 1 << 18
#: Pre-tokens of more characters share no prefix worth a trie's memory.
LONG = 1024
_PRETOKENS = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+$").findall

SCHEMA = "doc_id bigint, n_tokens bigint, n_pretokens bigint, n_chars bigint"


def read_pieces(path: str) -> dict[str, float]:
    """The normal pieces of a sentencepiece model file and their scores (field 1 of the message)."""
    data = open(path, "rb").read()
    out: dict[str, float] = {}
    for field, value in _fields(data):
        if field != 1:
            continue
        piece, score, kind = "", 0.0, 1
        for f, v in _fields(value):
            if f == 1:
                piece = v.decode()
            elif f == 2:
                score = struct.unpack("<f", v)[0]
            elif f == 3:
                kind = v
        if kind == 1:
            out[piece] = score
    return out


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """Fields of a protobuf message: number and value."""

    def varint(i: int) -> tuple[int, int]:
        n = shift = 0
        while True:
            b = data[i]
            n |= (b & 127) << shift
            i, shift = i + 1, shift + 7
            if b < 128:
                return n, i

    i = 0
    while i < len(data):
        key, i = varint(i)
        if key & 7 == 0:
            value, i = varint(i)
        else:
            size, i = varint(i) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], i)
            value, i = data[i : i + size], i + size
        yield key >> 3, value


class Unigram:
    def __init__(self, pieces: dict[str, float]):
        if any(BLANK in p.lstrip(BLANK) for p in pieces):
            raise ValueError("a piece runs from a non-blank into a blank; pre-tokens can't be split there")
        self.unknown = min((s for s in pieces.values() if s > BARRED), default=0.0) - UNK_PENALTY
        #: The pieces from their last character to the first: [next characters, score of the piece that ends here].
        self.backwards: list = [{}, None]
        self.longest = max(map(len, pieces), default=1)
        for piece, score in pieces.items():
            node = self.backwards
            for c in reversed(piece):
                node = node[0].setdefault(c, [{}, None])
            node[1] = score

    def count(self, word: str) -> int:
        """Pieces of one pre-token, by the same scores; only those of the last ``longest`` prefixes are held."""
        keep = self.longest + 1
        best, n = [0.0] * keep, [0] * keep
        for depth in range(1, len(word) + 1):
            piece, at, top, pieces_so_far = self.backwards, depth, None, 0
            while at:
                piece = piece[0].get(word[at - 1])
                if piece is None:
                    break
                at -= 1
                score = piece[1]
                if score is not None:
                    score += best[at % keep]
                    if top is None or score >= top:
                        top, pieces_so_far = score, n[at % keep] + 1
            c = word[depth - 1]
            if self.backwards[0].get(c) is None or self.backwards[0][c][1] is None:
                score = self.unknown + best[(depth - 1) % keep]
                if top is None or score > top:
                    top, pieces_so_far = score, n[(depth - 1) % keep] + len(c.encode())
            best[depth % keep], n[depth % keep] = top, pieces_so_far
        return n[len(word) % keep]

    def counts(self, words: Iterable[str]) -> dict[str, int]:
        """Pieces of each pre-token; every shared prefix is scored once."""
        root: dict = {}
        out: dict[str, int] = {}
        for word in words:
            if len(word) > LONG:
                out[word] = self.count(word)
                continue
            node = root
            for c in word:
                below = node.get(c)
                if below is None:
                    below = node[c] = {}
                node = below
            node[""] = word
        #: Depth first; path, best and n hold the prefix of the node at hand, so each is as long as the deepest word.
        path, best, n = [""], [0.0], [0]
        unknown, pieces = self.unknown, self.backwards
        stack: list[tuple[int, str, dict]] = [(0, "", root)]
        while stack:
            depth, c, node = stack.pop()
            if depth:
                del path[depth:], best[depth:], n[depth:]
                path.append(c)
                #: Pieces that end here, the shortest first; of equal scores the longest wins.
                piece, at, top, pieces_so_far = pieces, depth, None, 0
                while at:
                    piece = piece[0].get(path[at])
                    if piece is None:
                        break
                    at -= 1
                    score = piece[1]
                    if score is not None:
                        score += best[at]
                        if top is None or score >= top:
                            top, pieces_so_far = score, n[at] + 1
                if pieces[0].get(c) is None or pieces[0][c][1] is None:  # no piece for the character alone
                    score = unknown + best[depth - 1]
                    if top is None or score > top:
                        top, pieces_so_far = score, n[depth - 1] + len(c.encode())
                best.append(top)
                n.append(pieces_so_far)
            if "" in node:
                out[node[""]] = n[depth]
            for k, below in node.items():
                if k:
                    stack.append((depth + 1, k, below))
        return out


def pretokens(text: str) -> list[str]:
    return _PRETOKENS(BLANK + text.replace(" ", BLANK)) if text else []


@lru_cache(maxsize=2)
def _model(path: str) -> Unigram:
    return Unigram(read_pieces(path))


def token_counts(docs: DataFrame, model_path: str) -> DataFrame:
    """n_tokens of every whole text. ``model_path`` must be readable on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(model_path)
        known: dict[str, int] = {}
        for batch in batches:
            texts = batch.column(1).to_pylist()
            out: list[tuple[int, int, int]] = []
            group: list[list[str]] = []
            fresh: set[str] = set()
            chars = 0

            def settle() -> None:
                nonlocal chars
                if len(known) + len(fresh) > CACHE:
                    fresh.update(w for g in group for w in g)
                    known.clear()
                known.update(model.counts(fresh))
                out.extend((sum(map(known.__getitem__, g)), len(g), size) for g, size in zip(group, sizes))
                group.clear(), fresh.clear(), sizes.clear()
                chars = 0

            sizes: list[int] = []
            for text in texts:
                words = pretokens(text or "")
                group.append(words)
                sizes.append(len(text or ""))
                new = {w for w in words if w not in known}
                fresh |= new
                chars += sum(map(len, new))
                if chars > TRIE_CHARS or len(group) >= 2000:
                    settle()
            settle()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([x[i] for x in out], pa.int64()) for i in range(3))], names=["doc_id", "n_tokens", "n_pretokens", "n_chars"]
            )

    return map_slices(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), run, SCHEMA, 1)
