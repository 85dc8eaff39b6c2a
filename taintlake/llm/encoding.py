"""Token ids of whole texts by the tokenizers library, each distinct piece merged once.

Texts of ASCII and Latin letters alone, the most, are split by the tokenizers' own patterns, spelt for
these characters. Other texts are cut where white space follows another character, places
that both tokenizers never merge across, and the library's own normalizer and splitter take
the chunks apart. The library's model then merges each distinct piece; the ids of a text are
the ids of its pieces in order. The tests compare with the library on whole texts.

A string such as ``<|endoftext|>`` in a text is ordinary text, not a special id (the library's
``encode_special_tokens``), so that no text can forge the end of a document.

Defined results: empty text has no ids; a very long text is encoded in sections of ``STEP`` parts, so a worker holds a few
times that text; between texts it keeps at most ``KEEP`` pieces of at most ``LONG`` characters, twice, whatever the input.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Callable, Iterator
from itertools import islice

from .common import HELD

#: White space in any sense that a splitting pattern could have, other than the first four.
_ODD = "\x0b\x0c\x1c-\x1f\x85\xa0  -     　"
#: White space, then all up to where plain white space follows a character that is none.
_WITH_SPACE = re.compile(f"[ \t\n\r]*(?:[^ \t\n\r{_ODD}]+|[{_ODD}][ \t\n\r{_ODD}]*)+|[ \t\n\r]+$")
#: For tokenizers that drop white space.
_BETWEEN = re.compile("[^ \t\n\r]+")

#: Letters that are letters to every version of Unicode, composed, and lowered one by one (so without the dotted I).
_L = "A-Za-zÀ-ÖØ-öø-įı-ɏ"
_SIMPLE = re.compile(f"[\t\n\r -~{_L}]*").fullmatch
#: Those of them whose lower case is one, too: other texts can't be split after lowering.
_LOWERED = "".join(c for c in map(chr, range(0x80, 0x250)) if re.fullmatch(f"[{_L}]", c) and re.fullmatch(f"[{_L}]", c.lower()))
_SIMPLE_LOWERED = re.compile(f"[\t\n\r -~{_LOWERED}]*").fullmatch
_ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
_SPACED = re.compile(rf"{_ENDINGS}| ?[{_L}]+| ?[0-9]+| ?[^\s0-9{_L}]+|\s+(?!\S)|\s+")
_DROPPED = re.compile(rf"{_ENDINGS}|[{_L}]+|[0-9]|[^\s0-9{_L}]+")

#: Distinct pieces of a generation that a worker keeps; longer ones than LONG are never kept. Parts joined at once.
KEEP, LONG, STEP = 300_000, 64, 1 << 20


def _byte_letters() -> dict[int, str]:
    """The character that byte-level models use for each byte (as Latin-1), where it is another one."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(256 + i) for i, b in enumerate(others)}


_LETTERS = _byte_letters()


class _Kept(dict):
    """What ``make`` gave for each key, in two generations: when one is full, it becomes the old one, and
    keys that are asked for again come back from there."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key: str) -> bytes:
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(key) <= LONG:
            self[key] = found
        return found

    def turn(self) -> None:
        self.old = dict(self)
        self.clear()


class Encoder:
    """``space``: whether white space belongs to the tokens after it (byte-level) or is dropped (lower-case)."""

    def __init__(self, path: str, space: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.merge, self.space = self.tokenizer.model.tokenize, space
        if sys.byteorder != "little" or array("I").itemsize != 4:
            raise RuntimeError("ids are kept as this machine's unsigned ints, which must be little-endian and of 32 bits")
        self.kept = self.pieces, self.chunks, self.letters = _Kept(self._piece), _Kept(self._chunk), _Kept(self._merged)

    def _merged(self, letters: str) -> bytes:
        """Ids of what the splitter leaves whole, given as the letters of its bytes."""
        return array("I", [t.id for t in self.merge(letters)]).tobytes()

    def _piece(self, piece: str) -> bytes:
        """The same, given as it stands in the text."""
        if piece.isascii() and piece.isprintable():
            return self._merged(piece.replace(" ", "Ġ"))
        return self._merged(piece.encode().decode("latin-1").translate(_LETTERS))

    def _chunk(self, chunk: str) -> bytes:
        plain = self.tokenizer.normalizer.normalize_str(chunk) if self.tokenizer.normalizer else chunk
        return b"".join(self.letters[p] for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(plain))

    def split(self, text: str) -> tuple[_Kept, Iterator[list[str]]]:
        """What knows the ids of the text's parts, and the parts, at most ``STEP`` at once."""
        if (_SIMPLE if self.space else _SIMPLE_LOWERED)(text):
            kept, pattern, text = self.pieces, *((_SPACED, text) if self.space else (_DROPPED, text.lower()))
        else:
            kept, pattern = self.chunks, _WITH_SPACE if self.space else _BETWEEN
        if len(text) <= STEP:
            return kept, iter([pattern.findall(text)])
        found = (m[0] for m in pattern.finditer(text))
        return kept, iter(lambda: list(islice(found, STEP)), [])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        out = []
        for text in texts:
            kept, sections = self.split(text)
            out.append(b"".join([b"".join(map(kept.__getitem__, parts)) for parts in sections]))
            if sum(map(len, self.kept)) > KEEP:
                for kept in self.kept:
                    kept.turn()
        return out


def encoder(path: str, space: bool) -> Encoder:
    """One encoder per worker process, until it runs a task that needs another or none."""
    if (path, space) not in HELD:
        HELD[path, space] = Encoder(path, space)
    return HELD[path, space]
