"""Substring dedup over the De Bruijn graph of word windows.

Edges are windows of k words (nodes: the k - 1 words that two windows share). Windows in a row whose smallest inner
m-word hash is the same occurrence form one path of edges, a run; equal windows have the same anchor at the same place in
them, so equal windows always meet under the same anchor hash. The steps:

1. Anchors that occur once can't repeat: anchor hashes are counted, and only runs with repeated anchors go on.
2. Equal runs collapse into classes (paths of the graph) with their first source coordinate as owner and with their
   successor.
3. Where classes share an anchor but not their extent, their owners' texts are read again and their windows compared one by one:
   where each window starts first.
4. A class whose successor is always the same one, which occurs as often, compacts with it through a join of classes. Every
   occurrence of a path's first class is then one of the whole path.
5. Coordinates: a path splits where the sources of its windows aren't in a row. Occurrences of its first class give the
   spans of all its parts; a span repeats unless it is its own source.
6. Source coordinates verify: the words at each source are read and their digest (BLAKE2b of the words themselves) goes with the span; a document
   removes a span's words only if its own have the same digest.

Runs and windows are told apart by two 64-bit hashes, one of the anchor's words and one (xxh3) of the words' bytes. No step
gathers what has the same key: counts and smallest coordinates are combined before they are shuffled, and joins go between
written tables, so hot keys can be split.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from parcelry.llm.shared import discard, renewed, saved, small_batches
from parcelry.llm.tokens import Chunk, chunks, signed

LOWEST = -(1 << 63)
KEY = ["doc_id", "text_key"]
RUN = "doc_id long, text_key long, start int, n int, anchor long, run long, after long"


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def runs_of(c: Chunk, k: int, m: int) -> tuple[np.ndarray, ...]:
    """doc, first window, number of windows, anchor hash of each run in the chunk (positions count in the chunk)."""
    n = len(c.words)
    none = np.zeros(0, np.int64)
    if n < k:
        return none, none, none, np.zeros(0, np.uint64)
    grams = c.windows(np.arange(n - m + 1), m)
    # The smallest of `span` hashes in a row and the last place where it is found, by doubling.
    span = k - m + 1
    value, place, width = grams, np.arange(len(grams)), 1
    while width < span:
        step = min(width, span - width)
        left_v, right_v = value[:-step], value[step:]
        later = right_v <= left_v
        value, place = np.where(later, right_v, left_v), np.where(later, place[step:], place[:-step])
        width += step
    starts = np.arange(len(value))
    doc = c.doc_of_word[: len(value)]
    valid = starts + k <= c.word_bounds[1:][doc]
    new = valid.copy()
    new[1:] &= (place[1:] != place[:-1]) | ~valid[:-1]
    first = np.flatnonzero(new)
    # A run ends before the next one, or before the next window that isn't within a document.
    ends = np.flatnonzero(valid & np.append(new[1:] | ~valid[1:], True))
    return doc[first], first, ends - first + 1, grams[place[first]]


def _anchors(k: int, m: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(signed(runs_of(c, k, m)[3]))], ["anchor"])

    return run


def bytes_hashes(c: Chunk, first: np.ndarray, words: np.ndarray) -> np.ndarray:
    """xxh3 of the bytes of so many words from each first on, joined by one space."""
    text, at = c.joined
    spans = zip(at[first].tolist(), (at[first + words] - 1).tolist(), strict=True)
    return np.fromiter((xxh3_64_intdigest(text[a:b]) for a, b in spans), np.uint64, len(first))


def _runs(k: int, m: int):
    """All runs of doc_id, text_key, text, as RUN; after is the next run's hash, 0 at a text's end."""
    names = _names(RUN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = (batch.column(i).to_numpy() for i in (0, 1))
            for c in chunks(batch.column(2)):
                doc, first, count, anchor = runs_of(c, k, m)
                if not len(doc):
                    continue
                path = bytes_hashes(c, first, count + (k - 1))
                after = np.append(path[1:], np.uint64(0))
                after[:-1][doc[1:] != doc[:-1]] = 0
                start = (first - c.word_bounds[doc]).astype(np.int32)
                columns = (ids[c.row + doc], keys[c.row + doc], start, count.astype(np.int32), signed(anchor), signed(path), signed(after))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names)

    return run


WINDOWS = "doc_id long, text_key long, start int, anchor long, run long, windows array<long>"


def _windows(k: int):
    """The windows' hashes of the wanted runs of doc_id, text_key, text, wanted (start, n, anchor, run), one row a run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(3)
            flat, per = wanted.flatten(), wanted.value_lengths().to_numpy()
            start, n = flat.field("start").to_numpy(), flat.field("n").to_numpy()
            upto = np.append(0, np.cumsum(per))
            row = np.repeat(np.arange(len(per)), per)
            for c in chunks(batch.column(2)):
                lo, hi = upto[c.row], upto[c.row + len(c.bounds) - 1]
                s, many = start[lo:hi] + c.word_bounds[row[lo:hi] - c.row], n[lo:hi]
                at = np.repeat(s - np.cumsum(many) + many, many) + np.arange(many.sum())
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(many)).astype(np.int32)), pa.array(signed(bytes_hashes(c, at, np.full(len(at), k)))))
                here = pa.array(row[lo:hi])
                part = flat.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(here), batch.column(1).take(here), *(part.field(x) for x in ("start", "anchor", "run")), lists], _names(WINDOWS))

    return run


SOURCES = "source struct<doc_id:long,text_key:long,start:int>, n int, digest binary"


def digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def _sources(k: int):
    """The digest of the words at each wanted place (start, n windows) of doc_id, text_key, text, wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, key, text, wanted in zip(*(batch.column(i) for i in range(4)), strict=True):
                words = (text.as_py() or "").encode().split()
                places = wanted.as_py()
                at = {"doc_id": doc_id.as_py(), "text_key": key.as_py()}
                source = pa.array([at | {"start": p["start"]} for p in places], pa.struct([("doc_id", pa.int64()), ("text_key", pa.int64()), ("start", pa.int32())]))
                n = pa.array([p["n"] for p in places], pa.int32())
                digests = pa.array([digest(words[p["start"] : p["start"] + p["n"] + k - 1]) for p in places], pa.binary())
                yield pa.RecordBatch.from_arrays([source, n, digests], _names("source s, n i, digest b"))

    return run


CUT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def cut_words(text: str | None, spans: list[dict] | None, k: int) -> tuple[list[bytes], list[bytes]]:
    """The words of a text, and those that stay; spans have start, n (windows removed in a row) and the digest of their source's words."""
    words = (text or "").encode().split()
    if not spans:
        return words, words
    edge = np.zeros(len(words) + 1, np.int64)
    for s in spans:
        start, end = s["start"], s["start"] + s["n"] + k - 1
        if digest(words[start:end]) == s["digest"]:
            edge[start] += 1
            edge[end] -= 1
    gone = np.cumsum(edge[:-1]) > 0
    return words, [w for w, g in zip(words, gone.tolist(), strict=True) if not g]


def _cut(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removals, digests = [], [], []
            for text, spans in zip(batch.column(1), batch.column(2), strict=True):
                words, kept = cut_words(text.as_py(), spans.as_py(), k)
                counts.append(len(words))
                removals.append(len(words) - len(kept))
                digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(removals, pa.int64()), pa.array(digests, pa.string())], _names(CUT))

    return run


class Repeats:
    """The repeated windows of docs (doc_id, text), as tables: runs, classes, flags and spans.

    Documents are ordered by doc_id; of rows that share a doc_id, by a hash of the text. Rows equal in both count as one
    document, and each gets the result. A null doc_id comes before all others. Null and empty texts, and texts shorter
    than k words, have no windows.
    """

    def __init__(self, docs: DataFrame, k: int = 20, m: int = 8):
        self.k, self.given = k, docs
        small_batches(docs.sparkSession)
        text = F.col("text").cast("string")
        self.keys = (F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
        self.docs = docs.select(*self.keys)
        counted = self.docs.select("text").mapInArrow(_anchors(k, m), "anchor long").groupBy("anchor").count()
        repeated = saved(counted.filter("count > 1").select("anchor"), "repeat-anchors")
        self.runs = saved(self.docs.mapInArrow(_runs(k, m), RUN).join(repeated, "anchor"), "repeat-runs")
        discard(repeated)
        self.classes = saved(self._classes(), "repeat-classes")
        self.flags = saved(self._flags(), "repeat-flags")
        spans = saved(self._spans(), "repeat-spans")
        self.spans = saved(self._verified(spans), "repeat-sources")
        discard(self.runs, self.classes, self.flags, spans)

    def _classes(self) -> DataFrame:
        at = F.struct(*KEY, "start")
        return self.runs.groupBy("anchor", "run").agg(
            F.min(at).alias("owner"), F.count("*").alias("times"), F.max("n").alias("n"), F.min("after").alias("after"), F.max("after").alias("after_max")
        )

    def _wanted(self, places: DataFrame, *columns: str) -> DataFrame:
        """doc_id, text_key, text, wanted: the documents that have some of the places, each with its own."""
        per = places.groupBy(*KEY).agg(F.collect_list(F.struct(*columns)).alias("wanted"))
        return self.docs.join(saved(per, "repeat-wanted"), KEY).select(*KEY, "text", "wanted")

    def _flags(self) -> DataFrame:
        """anchor, run, owner, times, n, leads, late, for classes that repeat, whole or in part.

        late: where the owner's window i starts earlier elsewhere, by i; null if none does. leads: all occurrences have the
        same successor.
        """
        several = saved(self.classes.groupBy("anchor").agg(F.count("*").alias("c")).filter("c > 1").select("anchor"), "repeat-several")
        unclear = self.classes.join(several, "anchor").select("owner.*", "n", "anchor", "run")
        compared = saved(self._wanted(unclear, "start", "n", "anchor", "run").mapInArrow(_windows(self.k), WINDOWS), "repeat-compared")
        w = compared.select("anchor", "run", *KEY, "start", F.posexplode("windows").alias("i", "window"))
        w = w.select("anchor", "run", "i", "window", F.struct(*KEY, (F.col("start") + F.col("i")).alias("start")).alias("at"))
        firsts = saved(w.groupBy("anchor", "window").agg(F.min("at").alias("first"), F.max("at").alias("last")).filter("first < last").drop("last"), "repeat-windows")
        late = w.join(firsts, ["anchor", "window"]).filter(F.col("first") < F.col("at"))
        sources = saved(late.groupBy("anchor", "run").agg(F.map_from_entries(F.collect_set(F.struct("i", "first"))).alias("late")), "repeat-late")
        discard(compared, firsts, several)
        leads = (F.col("after") == F.col("after_max")) & (F.col("after") != 0)
        c = self.classes.select("anchor", "run", "owner", "times", "n", leads.alias("leads"))
        return c.join(sources, ["anchor", "run"], "left").filter("times > 1 or late is not null")

    def _paths(self) -> DataFrame:
        """anchor, run (of the path's first class), shift, n, source: the parts of nonbranching paths, by window.

        A class whose successor is always the same one, and which occurs as often as that, is its only predecessor: they occur side
        by side, so their owners are neighbours too, and are joined by these coordinates. A path's classes lie in a row in
        their owners' document.
        """
        c = self.flags.select("owner.*", "anchor", "run", "times", "n", "leads", "late")
        led = c.filter("leads").select(*KEY, (F.col("start") + F.col("n")).alias("start"), F.col("times").alias("led"))
        c = c.join(led, [*KEY, "start"], "left").withColumn("linked", F.coalesce(F.col("led") == F.col("times"), F.lit(False)))
        w = W.partitionBy(*KEY).orderBy("start")
        head = F.last(F.when(~F.col("linked"), F.struct(F.col("start").alias("head"), "anchor", "run")), ignorenulls=True).over(w)
        own = lambda i: F.struct(*KEY, (F.col("start") + i).alias("start"))
        one = lambda i: F.struct(i.alias("i"), F.lit(1).alias("n"), F.coalesce(F.try_element_at("late", i), own(i)).alias("source"))
        whole = F.array(F.struct(F.lit(0).alias("i"), F.col("n"), own(F.lit(0)).alias("source")))
        parts = F.when(F.col("late").isNull(), whole).otherwise(F.transform(F.sequence(F.lit(0), F.col("n") - 1), one))
        p = c.select(*KEY, "start", head.alias("h"), parts.alias("parts")).select(*KEY, "start", "h", F.explode("parts").alias("p"))
        p = p.select(*KEY, "h.*", (F.col("start") + F.col("p.i")).alias("at"), "p.n", "p.source")
        w = W.partitionBy(*KEY).orderBy("at")
        before = F.lag(F.struct("head", "source", "n")).over(w)
        next_to = [before["head"] == F.col("head"), *(before["source"][x] == F.col("source")[x] for x in KEY), before["source"]["start"] + before["n"] == F.col("source.start")]
        goes_on = F.coalesce(next_to[0] & next_to[1] & next_to[2] & next_to[3], F.lit(False))
        p = p.withColumn("part", F.sum(F.when(goes_on, 0).otherwise(1)).over(w)).groupBy(*KEY, "part", "head", "anchor", "run")
        parts = p.agg((F.min("at") - F.col("head")).alias("shift"), F.sum("n").cast("int").alias("n"), F.min_by("source", "at").alias("source"))
        return parts.select("anchor", "run", "shift", "n", "source")

    def _spans(self) -> DataFrame:
        """doc_id, text_key, start, n, source: windows in a row that start earlier elsewhere, and where they do first."""
        paths = saved(self._paths(), "repeat-paths")
        j = self.runs.select(*KEY, "start", "anchor", "run").join(paths, ["anchor", "run"])
        j = j.select(*KEY, (F.col("start") + F.col("shift")).alias("start"), "n", "source")
        return j.filter(F.struct(*KEY, "start") != F.col("source"))

    def _verified(self, spans: DataFrame) -> DataFrame:
        """The spans with the digest of their source's words."""
        places = spans.select("source.*", "n").distinct()
        words = saved(self._wanted(places, "start", "n").mapInArrow(_sources(self.k), SOURCES).dropDuplicates(["source", "n"]), "repeat-words")
        return spans.join(words, ["source", "n"]).select(*KEY, "start", "n", "digest", "source")

    def compacted(self) -> DataFrame:
        """doc_id, start, n_words, owner_doc_id, owner_start: the spans that cut() removes, in words, with their source."""
        spans = self.spans.dropDuplicates([*KEY, "start"])
        return spans.select("doc_id", "start", (F.col("n") + self.k - 1).alias("n_words"), F.col("source.doc_id").alias("owner_doc_id"), F.col("source.start").alias("owner_start"))

    def cut(self) -> DataFrame:
        """doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space) for every row of docs."""
        return self._joined(self.docs).mapInArrow(_cut(self.k), CUT).withColumn("doc_id", F.nullif("doc_id", F.lit(LOWEST)))

    def documents(self) -> DataFrame:
        """docs without the repeated words: their columns, with the kept words joined by one space as text.

        A text that loses nothing stays as it is; a row that loses all its words goes. Only texts with spans go through Python, and no
        other column does.
        """
        k = self.k

        @F.arrow_udf("string")
        def kept_words(texts: pa.Array, spans: pa.Array) -> pa.Array:
            out = []
            for text, found in zip(texts, spans, strict=True):
                kept = cut_words(text.as_py(), found.as_py(), k)[1] if found.is_valid else None
                out.append(None if kept is None else b" ".join(kept).decode())
            return pa.array(out, pa.string())

        names = self.given.columns
        joined = self._joined(self.given.select(*self.keys, F.struct(*names).alias("d")))
        out = joined.select("text", "d", kept_words(F.when(F.col("spans").isNotNull(), F.col("text")), "spans").alias("kept")).filter("kept is null or kept <> ''")
        return out.select(*(renewed(c, F.col(f"d.`{c}`"), F.coalesce("kept", "text")) for c in names))

    def _joined(self, rows: DataFrame) -> DataFrame:
        per = self.spans.groupBy(*KEY).agg(F.collect_set(F.struct("start", "n", "digest")).alias("spans"))
        more = [c for c in rows.columns if c == "d"]
        return rows.join(per, KEY, "left").select("doc_id", "text", "spans", *more)
