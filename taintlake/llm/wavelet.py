"""A wavelet matrix over token ids, as the bytes of one compressed file.

File: ``MAGIC``, the length of a JSON header (4 bytes, little-endian), the header, then
sections that it lists by length, each compressed with zstd: for each level, highest bit first, the bit
plane (8 bits a byte, highest first) and the ones before each block of ``BLOCK`` bits (unsigned 32-bit);
then the documents' ids (64-bit), whether each id is null (bytes) and the documents' ends.

Defined results: no token and no document give a file that reads back as such; a null id stays null; equal ids stay each
by itself; a token id that needs more than ``bits`` bits is an error; positions beyond the tokens are the caller's error, and a token that is not there
has count 0 and no occurrence.
"""

from __future__ import annotations

import json
import struct

import numpy as np
import zstandard

MAGIC = b"TLWM0001"
BLOCK = 512
#: Tokens that are dealt at once.
PIECE = 1 << 15


def build(tokens: np.ndarray, doc_ids: list[int | None], ends: np.ndarray, bits: int) -> bytes:
    """``tokens`` below 2**bits; ``ends``: tokens up to and with each document."""
    if len(tokens) and int(tokens.max()) >> bits:
        raise ValueError(f"a token id needs more than {bits} bits")
    squeeze = zstandard.ZstdCompressor(level=1).compress
    wide = np.uint16 if bits <= 16 else np.uint32
    #: The bit at hand is kept highest, where the sign tells it.
    now = np.left_shift(tokens.astype(wide), wide(8 * wide().itemsize - bits))
    sections, zeros = [], []
    for _ in range(bits):
        bit = now.view(np.int16 if wide is np.uint16 else np.int32) < 0
        plane = np.packbits(bit)
        sections += [plane.tobytes(), _before(plane).tobytes()]
        zeros.append(int(len(now) - np.count_nonzero(bit)))
        #: Dealt a piece at a time, by index, which stays in the processor's cache.
        dealt, low, high = np.empty_like(now), 0, zeros[-1]
        for i in range(0, len(now), PIECE):
            part, own = now[i : i + PIECE], bit[i : i + PIECE]
            ones, others = np.flatnonzero(own), np.flatnonzero(~own)
            dealt[high : high + len(ones)], dealt[low : low + len(others)] = part[ones], part[others]
            low, high = low + len(others), high + len(ones)
        now = np.left_shift(dealt, wide(1), out=dealt)
    sections += [
        np.array([0 if d is None else d for d in doc_ids], dtype="<i8").tobytes(),
        np.array([d is None for d in doc_ids], dtype=np.uint8).tobytes(),
        np.asarray(ends, dtype="<i8").tobytes(),
    ]
    packed = [squeeze(s) for s in sections]
    header = json.dumps({"n": len(tokens), "bits": bits, "docs": len(doc_ids), "zeros": zeros, "sizes": [len(p) for p in packed]}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(header)), header, *packed])


def _before(plane: np.ndarray) -> np.ndarray:
    ones = np.bitwise_count(plane)
    step = BLOCK // 8
    if not len(ones):
        return np.zeros(1, dtype="<u4")
    ones = np.pad(ones, (0, -len(ones) % step)).reshape(-1, step)
    return np.concatenate([[0], np.cumsum(ones.sum(axis=1, dtype=np.uint32))]).astype("<u4")


class WaveletMatrix:
    """Reads a file's bytes; a section is unpacked when it is first needed."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a wavelet matrix file")
        size = struct.unpack("<I", data[8:12])[0]
        self.head = json.loads(data[12 : 12 + size])
        self.n, self.bits, self.zeros = self.head["n"], self.head["bits"], self.head["zeros"]
        at = 12 + size
        self._packed = []
        for s in self.head["sizes"]:
            self._packed.append(data[at : at + s])
            at += s
        self._open: dict[int, np.ndarray] = {}

    def _section(self, k: int, kind: str) -> np.ndarray:
        if k not in self._open:
            self._open[k] = np.frombuffer(zstandard.ZstdDecompressor().decompress(self._packed[k]), dtype=kind)
        return self._open[k]

    def _plane(self, level: int) -> np.ndarray:
        return self._section(2 * level, "u1")

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        ids, null, ends = self._section(2 * self.bits, "<i8"), self._section(2 * self.bits + 1, "u1"), self._section(2 * self.bits + 2, "<i8")
        return [None if x else i for i, x in zip(ids.tolist(), null.tolist())], ends

    def _rank1(self, level: int, i: np.ndarray) -> np.ndarray:
        """Ones among the first ``i`` bits of the level."""
        plane, before = self._plane(level), self._section(2 * level + 1, "<u4")
        i = np.asarray(i, dtype=np.int64)
        block = i // BLOCK
        out = before[block].astype(np.int64)
        for k in range(BLOCK // 8):
            byte = block * (BLOCK // 8) + k
            left = np.clip(i - byte * 8, 0, 8)
            if not left.any():
                break
            value = plane[np.minimum(byte, max(len(plane) - 1, 0))] if len(plane) else np.zeros_like(byte, dtype=np.uint8)
            out += np.bitwise_count((value.astype(np.uint16) >> (8 - left).astype(np.uint16)).astype(np.uint8)) * (left > 0)
        return out

    def _bit(self, level: int, i: np.ndarray) -> np.ndarray:
        return self._plane(level)[i >> 3] >> (7 - (i & 7)).astype(np.uint8) & 1

    def access(self, i) -> np.ndarray:
        """The tokens at positions ``i``."""
        i = np.atleast_1d(np.asarray(i, dtype=np.int64))
        out = np.zeros(len(i), dtype=np.int64)
        for level in range(self.bits):
            bit = self._bit(level, i).astype(bool)
            ones = self._rank1(level, i)
            i = np.where(bit, self.zeros[level] + ones, i - ones)
            out = out << 1 | bit
        return out

    def rank(self, token: int, i: int) -> int:
        """How often the token stands among the first ``i``."""
        first, last = self._range(token, i)
        return last - first

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def _range(self, token: int, i: int) -> tuple[int, int]:
        if token < 0 or token >> self.bits:
            return 0, 0
        a, b = 0, i
        for level in range(self.bits):
            ra, rb = (int(x) for x in self._rank1(level, np.array([a, b])))
            a, b = (self.zeros[level] + ra, self.zeros[level] + rb) if token >> (self.bits - 1 - level) & 1 else (a - ra, b - rb)
        return a, b

    def select(self, token: int, k: int) -> int:
        """The position of the token's occurrence number ``k``, from 0."""
        a, b = self._range(token, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        at = a + k
        for level in range(self.bits - 1, -1, -1):
            one = token >> (self.bits - 1 - level) & 1
            want = at - self.zeros[level] if one else at
            low, high = 0, self.n  # the bit at the result is the want-th of its kind
            while low < high:
                mid = (low + high) // 2
                ones = int(self._rank1(level, np.array([mid + 1]))[0])
                if (ones if one else mid + 1 - ones) > want:
                    high = mid
                else:
                    low = mid + 1
            at = low
        return at

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def tokens(self) -> np.ndarray:
        """All tokens in order: the levels are undone from the lowest."""
        value = np.zeros(self.n, dtype=np.uint16 if self.bits <= 16 else np.uint32)
        for level in range(self.bits - 1, -1, -1):
            bit = np.unpackbits(self._plane(level), count=self.n).view(bool)
            above, low, high = np.empty_like(value), 0, self.zeros[level]
            value[high:] |= value.dtype.type(1 << (self.bits - 1 - level))
            for i in range(0, self.n, PIECE):
                own, part = bit[i : i + PIECE], above[i : i + PIECE]
                ones, others = np.flatnonzero(own), np.flatnonzero(~own)
                part[ones], part[others] = value[high : high + len(ones)], value[low : low + len(others)]
                low, high = low + len(others), high + len(ones)
            value = above
        return value
