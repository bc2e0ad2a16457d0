"""Packing documents into fixed-length sequences: first-fit decreasing with a tournament tree of bin capacities.

Tokens are counted and cut where the text is; only one small row per piece is shuffled. Documents longer than a
sequence give full pieces, which are sequences already, and a rest. Rests go to randomised groups of a few thousand, and each group is packed on
its own: pieces in decreasing length, each into the first bin with room, found in a tournament tree (an inner node
holds the largest capacity below it) in logarithmic time.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelry.llm.shared import give_back, saved, small_batches
from parcelry.llm.tokens import Chunk, chunks, span_hashes

#: Distinct parts that a worker remembers; beyond, it starts anew.
REMEMBERED = 1_000_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"

#: Bytes by kind: 0 white space, 1 letter, 2 digit, 3 other visible ASCII, 4 whatever the tokenizer must see in its word.
_KIND = np.full(256, 4, np.uint8)
_KIND[33:127] = 3
_KIND[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
_KIND[48:58] = 2
_KIND[65:91] = _KIND[97:123] = 1


class Encoder:
    """Token ids of texts, equal to encoding each whole text.

    The tokenizer lower-cases, drops white space and joins neither over it nor between letters, digits and signs. So a
    text's ids are those of its parts in a row: runs of letters (ASCII and Latin-1), digits, runs of signs. Words with
    anything else in them are parts as a whole. Parts are found by hash with array operations; ids of parts seen lately are
    remembered in a sorted table, and only new parts are encoded. Parts of equal hash are compared byte by byte, and should two differ,
    the chunk's texts are encoded whole.
    """

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end = np.array([end_id], np.uint32)
        self.forget()

    def forget(self) -> None:
        none = np.zeros(0, np.int64)
        self.hashes, self.starts, self.lengths, self.flat = np.zeros(0, np.uint64), none, none, np.zeros(0, np.uint32)
        self.text, self.text_starts, self.text_lengths = np.zeros(0, np.uint8), none, none

    def parts(self, c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes (lower case where that is sure), beginnings and ends of the parts."""
        data, n = c.data, len(c.data)
        starts, ends = c.spans
        lower = data + 32 * ((data >= 65) & (data <= 90)).astype(np.uint8)
        kind = _KIND[data]
        after_c3 = np.zeros(n, bool)  # second bytes of Latin-1 letters
        after_c3[1:] = data[:-1] == 0xC3
        latin = after_c3 & (data != 0x97) & (data != 0xB7)
        lower[latin & (data >= 0x80) & (data <= 0x9E)] += 32
        kind[latin] = 1
        kind[np.flatnonzero(latin) - 1] = 1
        special = (kind == 4) | (data == 0x27)
        special[:-1] |= (data[:-1] == 0x3C) & (data[1:] == 0x7C)
        whole = np.add.reduceat(special, starts, dtype=np.int64) > 0 if len(starts) else np.zeros(0, bool)
        edge = np.zeros(n + 1, np.int8)
        edge[starts[whole]] = 1
        edge[ends[whole]] -= 1
        in_whole = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
        begin = kind == 2
        begin[1:] |= kind[1:] != kind[:-1]
        begin &= (kind != 0) & ~in_whole
        begin[starts] = True
        at = np.flatnonzero(begin)
        stop = np.minimum(np.append(at[1:], n), ends[np.searchsorted(starts, at, side="right") - 1])
        return np.where(in_whole, data, lower), at, stop

    def places(self, hashes: np.ndarray, text: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Where in flat the ids of distinct parts begin, and how many they are; None if one isn't what its hash stands for.

        The i-th part is the `size` bytes of text from at on.
        """
        by = np.argsort(hashes)  # in order, look-ups are much faster
        place = np.empty(len(hashes), np.int64)
        place[by] = np.minimum(np.searchsorted(self.hashes, hashes[by]), max(len(self.hashes) - 1, 0))
        known = self.hashes[place] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)
        there = place[known]
        if not equal_spans(text, at[known], size[known], self.text, self.text_starts[there], self.text_lengths[there]):
            return None
        if not known.all():
            if len(self.hashes) > REMEMBERED:
                self.forget()
                return self.places(hashes, text, at, size)
            new = np.flatnonzero(~known)
            parts = [text[a : a + n].tobytes() for a, n in zip(at[new].tolist(), size[new].tolist(), strict=True)]
            ids = [e.ids for e in self.tokenizer.encode_batch_fast([x.decode() for x in parts], add_special_tokens=False)]
            many = np.fromiter(map(len, ids), np.int64, len(ids))
            start, text_start = len(self.flat) + np.cumsum(many) - many, len(self.text) + np.cumsum(size[new]) - size[new]
            self.flat = np.append(self.flat, np.fromiter(chain.from_iterable(ids), np.uint32, int(many.sum())))
            self.text = np.append(self.text, np.frombuffer(b"".join(parts), np.uint8))
            both = np.append(self.hashes, hashes[new])
            order = np.argsort(both, kind="stable")
            self.hashes = both[order]
            for name, more in (("starts", start), ("lengths", many), ("text_starts", text_start), ("text_lengths", size[new])):
                setattr(self, name, np.append(getattr(self, name), more)[order])
            place[by] = np.searchsorted(self.hashes, hashes[by])
        return self.starts[place], self.lengths[place]

    def encode(self, c: Chunk) -> Iterator[np.ndarray]:
        """The ids of each text of the chunk with the end id."""
        text, at, stop = self.parts(c)
        size = stop - at
        codes, distinct = pd.factorize(span_hashes(text, at, stop))
        first = np.empty(len(distinct), np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
        same = first[codes]
        found = self.places(distinct, text, at[first], size[first]) if equal_spans(text, at, size, text, at[same], size[same]) else None
        if found is None:
            yield from self.encode_whole(c)
            return
        start, length = found[0][codes], found[1][codes]
        upto = np.append(0, np.cumsum(length))
        ids = self.flat[np.repeat(start - upto[:-1], length) + np.arange(upto[-1])]
        bounds = upto[np.searchsorted(at, c.bounds)]
        for d in range(len(bounds) - 1):
            yield np.append(ids[bounds[d] : bounds[d + 1]], self.end)

    def encode_whole(self, c: Chunk) -> Iterator[np.ndarray]:
        for lo, hi in zip(c.bounds[:-1].tolist(), c.bounds[1:].tolist(), strict=True):
            ids = self.tokenizer.encode(c.data[lo:hi].tobytes().decode(), add_special_tokens=False).ids
            yield np.append(np.array(ids, np.uint32), self.end)


def equal_spans(a: np.ndarray, at_a: np.ndarray, size_a: np.ndarray, b: np.ndarray, at_b: np.ndarray, size_b: np.ndarray) -> bool:
    """Whether spans of equal hash are equal, each; up to eight bytes, equal hashes and lengths suffice."""
    if not np.array_equal(size_a, size_b):
        return False
    longer = np.flatnonzero((size_a > 8) & ((at_a != at_b) | (a is not b)))
    n = size_a[longer]
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.array_equal(a[np.repeat(at_a[longer], n) + step], b[np.repeat(at_b[longer], n) + step])


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, end_id: int) -> Encoder:
    """One per worker, so that what it remembers serves later tasks."""
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = Encoder(path, end_id)
    return _encoders[path, end_id]


def _pieces(path: str, end_id: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, end_id).encode
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for c in chunks(batch.column(1), 1 << 21):
                rows: list[tuple] = []
                for doc_id, ids in zip(doc_ids[c.row :], encode(c), strict=False):
                    n = len(ids)
                    rows += ((doc_id, s, min(limit, n - s), zlib.crc32(ids[s : s + limit]), n) for s in range(0, n, limit))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], [x.split()[0] for x in PIECES.split(", ")])
        give_back()

    return run


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, by first-fit over items in decreasing length (ties in the given order)."""
    n = len(lengths)
    leaves = 1 << max(0, (n - 1).bit_length())
    tree = [capacity] * (2 * leaves)  # tree[i] = max(tree[2i], tree[2i + 1]); leaves are bins, all empty at first
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for item in np.argsort(-lengths, kind="stable").tolist():
        need, at = int(lengths[item]), 1
        while at < leaves:
            at *= 2
            if tree[at] < need:
                at += 1
        bins[item], offsets[item] = at - leaves, capacity - tree[at]
        tree[at] -= need
        while at > 1:
            at //= 2
            top = max(tree[2 * at], tree[2 * at + 1])
            if tree[at] == top:
                break
            tree[at] = top
    return bins, offsets


def _packed(capacity: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "start", "length", "ids_crc32"], kind="stable", ignore_index=True)
        bins, offsets = first_fit_decreasing(group["length"].to_numpy(), capacity)
        return group.assign(sequence_id=group["part"].to_numpy() * (1 << 24) + bins, offset=offsets).drop(columns="part")

    return run


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, sequence: int = 2048, group_rows: int = 4096, seed: int = 5) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A full piece is a sequence of its own (ids below 0), so groups hold at most one rest of each document: group_rows on
    average (below 2^24 bins each), whatever the input's size and the texts' lengths. A null or empty text is the end id alone.
    Rows that repeat, or share a doc_id, are documents of their own, and are dealt to groups each for itself. An empty table gives no
    rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    small_batches(docs.sparkSession)
    groups = max(1, -(-rows.count() // group_rows))
    row = F.monotonically_increasing_id()
    pieces = saved(rows.mapInArrow(_pieces(tokenizer_path, end_id, sequence), PIECES).withColumn("row", row), "pack-pieces")
    full = pieces.filter(F.col("length") == sequence).withColumns({"sequence_id": -1 - F.col("row"), "offset": F.lit(0).cast("long")}).drop("row")
    rests = pieces.filter(F.col("length") < sequence).withColumn("part", F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(groups))).drop("row")
    return full.unionByName(rests.groupBy("part").applyInPandas(_packed(sequence), PIECES + ", sequence_id long, offset long"))
