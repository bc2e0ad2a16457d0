"""Words and word windows of whole Arrow batches as hash arrays, without a Python step per word.

A word is read eight bytes at a time, each lane mixed into the hash so far; words of more than 64 bytes take xxh3. A window's hash
comes from those of its halves, which are mixed in order, not summed. So no hash is linear in bytes or words: what cancels
in sums (the Thue-Morse words and their complements, modulo a power of two) doesn't here. Equal input gives equal hashes,
wherever it stands; whoever must be exact compares the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

CHUNKBYTES, CHUNK_DOCS = 1 << 19, 4000
#: Lanes of eight bytes that are read with array operations; longer words are hashed one by one.
LANES = 8
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LANE_MASK = np.array([0] + [(1 << 8 * i) - 1 for i in range(1, 9)], np.uint64)
_STEP, _PAIR, _WIDTH = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03), np.uint64(0x8CB92BA72F3D8DD7)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x = x * np.uint64(0xA3B195354A39B70D)
    return x ^ (x >> np.uint64(32))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes in order."""
    return mix((a ^ (a >> np.uint64(31))) * _PAIR + b)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes from each start to its end; different spans of the same length, up to 7 bytes, have different ones."""
    length = (ends - starts).astype(np.int64)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    lanes = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    first = lanes[starts] & _LANE_MASK[np.minimum(length, 8)]
    h = mix(first + np.minimum(length, 8).astype(np.uint64) * _STEP)
    for lane in range(1, LANES):
        more = np.flatnonzero(length > 8 * lane)
        if not len(more):
            return h
        left = length[more] - 8 * lane
        word = lanes[starts[more] + 8 * lane] & _LANE_MASK[np.minimum(left, 8)]
        h[more] = pair(h[more] + np.minimum(left, 8).astype(np.uint64), word)
    for i in np.flatnonzero(length > 8 * LANES).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]])
    return h


@dataclass
class Chunk:
    """Some whole texts in a row: their bytes, and where each begins."""

    row: int  # of the batch
    data: np.ndarray
    bounds: np.ndarray

    @cached_property
    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        """Where each word begins and ends."""
        n = len(self.data)
        inside = ~_SPACE[self.data]
        edge = np.zeros(n + 1, bool)
        edge[self.bounds] = True
        first = inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:n]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | edge[1:n]
        return np.flatnonzero(first), np.flatnonzero(last) + 1

    @cached_property
    def words(self) -> np.ndarray:
        """A hash of each word."""
        return span_hashes(self.data, *self.spans)

    @cached_property
    def word_bounds(self) -> np.ndarray:
        """Where each text's words begin, and the end."""
        return np.searchsorted(self.spans[0], self.bounds)

    @cached_property
    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.word_bounds))

    def doubled(self, level: int) -> np.ndarray:
        """A hash of the 2^level words from each word on, as far as there are so many."""
        found = self.__dict__.setdefault("_doubled", [self.words])
        while len(found) <= level:
            half = 1 << (len(found) - 1)
            last = found[-1]
            found.append(pair(last[:-half], last[half:]) if len(last) > half else last[:0])
        return found[level]

    def windows(self, at: np.ndarray, width: int | np.ndarray) -> np.ndarray:
        """A hash of the words at .. at + width - 1 for each at; width may differ."""
        if not np.ndim(width):
            return self._windows(at, int(width))
        out = np.zeros(len(at), np.uint64)
        for w in np.unique(width).tolist():
            here = np.flatnonzero(width == w)
            out[here] = self._windows(at[here], w)
        return out

    def _windows(self, at: np.ndarray, width: int) -> np.ndarray:
        h, done = None, 0
        for level in range(width.bit_length() - 1, -1, -1):
            if width >> level & 1:
                part = self.doubled(level)[at + done]
                h, done = part if h is None else pair(h, part), done + (1 << level)
        return mix(h + np.array([width], np.uint64) * _WIDTH) if h is not None else np.zeros(len(at), np.uint64)

    @cached_property
    def joined(self) -> tuple[bytes, np.ndarray]:
        """The words, each followed by one space, and where each begins in that (and the end)."""
        starts, ends = self.spans
        length = ends - starts + 1
        at = np.append(0, np.cumsum(length))
        inside = ~_SPACE[self.data]
        out = np.full(at[-1], 0x20, np.uint8)
        gap = np.ones(len(out), bool)
        gap[at[1:] - 1] = False
        out[gap] = self.data[inside]
        return out.tobytes(), at


def chunks(texts: pa.Array, limit: int = CHUNKBYTES) -> Iterator[Chunk]:
    """Runs of texts of about `limit` bytes; a longer text is a run of its own. Null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(texts):
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), len(texts), row + CHUNK_DOCS)
        yield Chunk(row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row])
        row = end


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
