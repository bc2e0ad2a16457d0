"""Directly addressable codes: whole numbers in chunks, level by level, so that any one can be read without decoding others.

Level 0 holds the low bits of every number, and one bit that tells whether more follow. Level 1 holds the next bits of those that have more,
again with a bit each, and so on; the last level has no bits. Where a number's next chunk stands is how many of the bits before its own are set: a rank directory
holds that count for every 512 bits, so reading a number takes one look-up per level.

A code is one string of bytes: b"DAC1", levels and numbers (two 4 and 8-byte integers), then of each level its width (4), how many chunks it has (8), and the bytes
of its chunks, of its bitmap and of its directory. All is little-endian, and bits count from the lowest.
"""

from __future__ import annotations

import struct
from functools import cached_property

import numpy as np

MAGIC = b"DAC1"
#: Bits of each level's chunks; the last one is as wide as it must be.
WIDTHS = (10, 2, 4)
SPAN = 512  # bits for each entry of the rank directory


def _packed(chunks: np.ndarray, width: int) -> bytes:
    bits = np.unpackbits(chunks.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, count=width, bitorder="little")
    return np.packbits(bits, bitorder="little").tobytes()


def _unpacked(data: np.ndarray, width: int, first: int, n: int) -> np.ndarray:
    lo, hi = first * width, (first + n) * width
    bits = np.unpackbits(data[lo // 8 : -(-hi // 8)], bitorder="little")[lo % 8 : lo % 8 + n * width].reshape(n, width)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, :width] = bits
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel().astype(np.uint32)


def encoded(numbers: np.ndarray, widths: tuple[int, ...] = WIDTHS) -> bytes:
    """The code of unsigned 32-bit numbers."""
    levels, left = [], numbers.astype(np.uint32)
    for k, width in enumerate(widths):
        last = k == len(widths) - 1
        width = max(width, int(left.max()).bit_length()) if last and len(left) else width
        chunk, more = left & np.uint32((1 << width) - 1), left >> np.uint32(width) if width < 32 else np.zeros_like(left)
        on = more > 0
        bitmap = np.packbits(on, bitorder="little")
        ones = np.add.reduceat(on, np.arange(0, len(on), SPAN), dtype=np.int64) if len(on) else np.zeros(0, np.int64)
        directory = (np.cumsum(ones) - ones).astype("<u4")
        parts = [_packed(chunk, width), b"" if last else bitmap.tobytes(), b"" if last else directory.tobytes()]
        levels.append(struct.pack("<IQQQQ", width, len(left), *map(len, parts)) + b"".join(parts))
        left = more[on]
    return MAGIC + struct.pack("<IQ", len(levels), len(numbers)) + b"".join(levels)


class Level:
    """One level of a code: chunks, and behind each whether more follow."""

    def __init__(self, data: np.ndarray, at: int):
        self.width, self.n, *sizes = struct.unpack_from("<IQQQQ", data, at)
        ends = at + 36 + np.cumsum([0, *sizes])
        self.chunks, self.bitmap, self.directory = (data[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))
        self.end = int(ends[-1])

    @cached_property
    def ranks(self) -> np.ndarray:
        return self.directory.view("<u4") if self.directory.ctypes.data % 4 == 0 else np.frombuffer(self.directory.tobytes(), "<u4")

    def chunk(self, i: int) -> int:
        at = i * self.width
        return int.from_bytes(self.chunks[at // 8 : (at + self.width + 7) // 8].tobytes(), "little") >> at % 8 & (1 << self.width) - 1

    def more(self, i: int) -> bool:
        return bool(len(self.bitmap)) and bool(self.bitmap[i >> 3] >> (i & 7) & 1)

    def rank(self, i: int) -> int:
        """How many of the first i bits are set."""
        if i >= self.n:
            i, add = self.n - 1, int(self.more(self.n - 1)) if self.n else 0
        else:
            add = 0
        if i <= 0:
            return add
        start = i // SPAN
        bits = int.from_bytes(self.bitmap[start * SPAN // 8 : (i + 7) // 8].tobytes(), "little") & (1 << i - start * SPAN) - 1
        return int(self.ranks[start]) + bits.bit_count() + add


class Codes:
    """Reads a code: codes[i], or codes.slice(i, j) for a run."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a directly addressable code")
        raw, self.levels = np.frombuffer(data, np.uint8), []
        levels, self.n = struct.unpack_from("<IQ", data, 4)
        at = 16
        for _ in range(levels):
            self.levels.append(Level(raw, at))
            at = self.levels[-1].end

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = shift = 0
        for level in self.levels:
            value |= level.chunk(i) << shift
            if not level.more(i):
                break
            i, shift = level.rank(i), shift + level.width
        return value

    def slice(self, first: int, end: int) -> np.ndarray:
        """The numbers first .. end - 1; only their own chunks are read."""
        first, end = max(first, 0), min(end, self.n)
        out = np.zeros(max(end - first, 0), np.uint32)
        where, shift = np.arange(len(out)), 0
        for level in self.levels:
            if not len(where):
                break
            out[where] |= _unpacked(level.chunks, level.width, first, len(where)) << np.uint32(shift)
            if not len(level.bitmap):
                break
            on = np.unpackbits(level.bitmap[first // 8 : -(-(first + len(where)) // 8)], bitorder="little")[first % 8 : first % 8 + len(where)].astype(bool)
            first, where, shift = level.rank(first), where[on], shift + level.width
        return out
