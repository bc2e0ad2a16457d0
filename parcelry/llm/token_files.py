"""Token files: all documents' token ids in ascending order of doc_id, in directly addressable codes (see addressable.py).

A file is a folder of Parquet, as this is what Spark writes to any store. Each row is a segment: whole documents in a row, where each ends, and their ids as one code. Documents are
sorted by one range shuffle of their texts and encoded where they then are; a segment is closed once it is long enough, so a task holds
one segment and one batch of texts. A second, small table has the place of each range's first id: ranges are counted only when all are written.
Segments serve the reader that wants documents in order as well as the one that wants one id: first_id of a range and before of a segment lead to the segment, the code's
directories to the id.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parcelry.llm.addressable import Codes, encoded
from parcelry.llm.packing import Encoder
from parcelry.llm.shared import large_rows, saved, small_batches
from parcelry.llm.tokens import Chunk, chunks

SEGMENT = "range int, segment long, before long, n_tokens long, doc_ids array<long>, ends array<long>, code binary"
DOCUMENT = "range int, doc_id long, place long, n_tokens long, ids_crc32 long"

#: White space beyond ASCII, and what may begin a special token: next to these, a text's pieces depend on more than themselves.
_ODD = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80|<\|")


class ByteEncoder(Encoder):
    """Token ids of texts by a byte-level tokenizer, equal to encoding each whole text.

    Such a tokenizer cuts texts into pieces before it joins bytes: runs of letters, digits or signs, each with one space before it, and the rest of the white
    space, whose last character is by itself where a word follows without that space. Pieces are found by hash like the parts of words. Texts with other white space or
    special tokens are encoded whole.
    """

    def parts(self, c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes, beginnings and ends of the pieces."""
        _, at, stop = super().parts(c)
        data, (starts, ends) = c.data, c.spans
        digit = (data >= 48) & (data <= 57)
        first = np.ones(len(at), bool)
        first[1:] = ~(digit[at[1:]] & digit[at[1:] - 1] & (stop[:-1] == at[1:]))  # figures in a row are one piece; words meet no others
        first[np.searchsorted(at, starts)] = True
        at, stop = at[first], stop[np.append(np.flatnonzero(first)[1:] - 1, len(stop) - 1)] if len(at) else stop
        of_word = np.searchsorted(c.bounds, starts, side="right") - 1
        gap = np.maximum(np.append(0, ends[:-1])[: len(starts)], c.bounds[of_word])  # where the white space before each word begins
        spaced = (starts > gap) & (data[np.maximum(starts - 1, 0)] == 0x20)
        at[np.searchsorted(at, starts)] -= spaced
        before = starts - spaced
        alone = ~spaced & (before > gap)
        cut = before - alone  # the last character is by itself where no space joins the word
        some = np.flatnonzero(cut > gap)
        lone = np.flatnonzero(alone)
        last = np.searchsorted(starts, c.bounds[1:]) - 1  # each text's last word
        tail = np.where(last >= 0, np.maximum(ends[np.maximum(last, 0)] if len(ends) else 0, c.bounds[:-1]), c.bounds[:-1])
        rest = np.flatnonzero(tail < c.bounds[1:])
        more_at, more_stop = np.concatenate([gap[some], cut[lone], tail[rest]]), np.concatenate([cut[some], before[lone], c.bounds[1:][rest]])
        if not len(more_at):
            return data, at, stop
        at, stop = np.append(at, more_at), np.append(stop, more_stop)
        order = np.argsort(at, kind="stable")
        return data, at[order], stop[order]

    def encode(self, c: Chunk) -> Iterator[np.ndarray]:
        if not _ODD.search(c.data):
            yield from super().encode(c)
            return
        for lo, hi in zip(c.bounds[:-1].tolist(), c.bounds[1:].tolist(), strict=True):
            one = Chunk(c.row, c.data[lo:hi], np.array([0, hi - lo]))
            yield from self.encode_whole(one) if _ODD.search(one.data) else super().encode(one)


_encoders: dict[tuple[str, int], ByteEncoder] = {}


def encoder(path: str, end_id: int) -> ByteEncoder:
    """One per worker, so that what it remembers serves later tasks."""
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = ByteEncoder(path, end_id)
    return _encoders[path, end_id]


def _segments(path: str, end_id: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(path, end_id).encode, TaskContext.get().partitionId()
        held, doc_ids, size, before, segment = [], [], 0, 0, 0

        def closed() -> pa.RecordBatch:
            ends = np.cumsum([len(x) for x in held])
            cells = ([part], [segment], [before], [int(ends[-1])], [doc_ids], [ends], [encoded(np.concatenate(held))])
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], [x.split()[0] for x in SEGMENT.split(", ")])

        for batch in batches:
            ids_of = batch.column(0).to_pylist()
            for c in chunks(batch.column(1), 1 << 21):
                for doc_id, ids in zip(ids_of[c.row :], encode(c), strict=False):
                    held.append(ids)
                    doc_ids.append(doc_id)
                    size += len(ids)
                    if size >= least:
                        yield closed()
                        before, segment, held, doc_ids, size = before + size, segment + 1, [], [], 0
        if held:
            yield closed()

    return run


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the segments hold, document by document."""
    names = [x.split()[0] for x in DOCUMENT.split(", ")]
    for batch in batches:
        for s in range(batch.num_rows):
            part, before, doc_ids, ends, code = (batch.column(c)[s].as_py() for c in ("range", "before", "doc_ids", "ends", "code"))
            ids = Codes(code).slice(0, ends[-1]).astype("<u4")
            starts = [0, *ends[:-1]]
            sums = [zlib.crc32(ids[a:b]) for a, b in zip(starts, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(ends), pa.int32()), pa.array(doc_ids, pa.int64()), pa.array([before + a for a in starts]), pa.array([b - a for a, b in zip(starts, ends, strict=True)]), pa.array(sums, pa.int64())], names)


@dataclass
class TokenFiles:
    """The two tables of a token file: segments, and the ranges with first_id, the place of their first id."""

    segments: DataFrame
    ranges: DataFrame

    def documents(self) -> DataFrame:
        """doc_id, start (ids of all documents before), n_tokens, ids_crc32, as read back."""
        large_rows(self.segments.sparkSession)
        rows = self.segments.select("range", "before", "doc_ids", "ends", "code").mapInArrow(_documents, DOCUMENT)
        return rows.join(self.ranges, "range").select("doc_id", (F.col("first_id") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")

    def ids_at(self, places: DataFrame) -> DataFrame:
        """place, id: the ids at given places (place) of the whole file; null beyond its end. Segments are joined by range of places, codes read at these alone."""
        large_rows(self.segments.sparkSession)
        s = self.segments.join(self.ranges, "range").select((F.col("first_id") + F.col("before")).alias("first"), "n_tokens", "code")
        step = 1 << 16  # places meet segments in cells of so many ids, an equi-join
        cells = F.explode(F.sequence(F.floor(F.col("first") / step), F.floor((F.col("first") + F.col("n_tokens") - 1) / step))).alias("cell")
        wanted = places.select("place").distinct().withColumn("cell", F.floor(F.col("place") / step))
        met = wanted.join(s.select("first", "n_tokens", cells), "cell").filter(F.col("place").between(F.col("first"), F.col("first") + F.col("n_tokens") - 1))
        per = met.groupBy("first").agg(F.collect_list("place").alias("places"))  # places asked of one segment
        found = s.join(per, "first").select("first", "code", "places").mapInArrow(_looked_up, "place long, id long")
        return places.join(found, "place", "left")


def _looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s in range(batch.num_rows):
            first, code, places = (batch.column(c)[s].as_py() for c in ("first", "code", "places"))
            codes = Codes(code)
            yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array([codes[p - first] for p in places], pa.int64())], ["place", "id"])


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int = 0, least: int = 1 << 18) -> TokenFiles:
    """Encodes every whole text, appends end_id, and writes the ids in ascending order of doc_id in segments of `least` ids or one document more.

    A null or empty text is the end id alone. A null doc_id comes first; rows that share a doc_id follow each other by hash and text, and each is a
    document of its own. An empty table gives files without segments. Extra columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    large_rows(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("_hash"), F.monotonically_increasing_id().alias("_row"))
    keys = [F.col("doc_id").asc_nulls_first(), "_hash", "_row"]
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(keys[0], "_hash", "text").select("doc_id", "text")
    segments = saved(ordered.mapInArrow(_segments(tokenizer_path, end_id, least), SEGMENT), "token-segments")
    per = segments.groupBy("range").agg(F.sum("n_tokens").alias("n"))  # one row per range
    before = F.coalesce(F.sum("n").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return TokenFiles(segments, saved(per.select("range", before.alias("first_id")), "token-ranges"))
