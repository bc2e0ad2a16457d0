"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles, banded, verified.

A document is its weighted set of five-word shingles; a shingle weighs its count times the mean (damped) inverse document
frequency of its words (words are hashed to a fixed number of buckets, so the frequency table has a fixed size; all
documents count). Improved consistent weighted sampling draws samples that two documents share with the probability of
their weighted Jaccard similarity. Samples in bands give buckets; documents of a bucket are compared exactly.

Within a bucket, comparisons go from a leader to the others rather than between all pairs; what is linked contracts to one
component, and only buckets with several components are taken up again. After two rounds, documents that still share a
bucket over components get longer sketches, whose buckets hold hardly anything but links. There the rounds go on, with more
leaders each time, until no bucket holds two components whose members haven't all been compared. Equal texts are collapsed first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelry.llm.components import components, relabelled
from parcelry.llm.shared import discard, saved, small_batches
from parcelry.llm.tokens import CHUNK_DOCS, CHUNKBYTES, Chunk, chunks, mix, signed

#: Buckets of the word frequency table; weights are fixed-point numbers, so that sums don't depend on order.
BUCKET_BITS, FIXED = 16, 1 << 16
TABLE = 1 << 16
#: Texts in a task that draws the longer sketches.
OPEN_ROWS = 512


def _gamma2() -> np.ndarray:
    """Quantiles of the Gamma(2, 1) distribution: solves 1 - (1 + x) exp(-x) = u by bisection."""
    u = (np.arange(TABLE) + 0.5) / TABLE
    low, high = np.zeros(TABLE), np.full(TABLE, 40.0)
    for _ in range(60):
        mid = (low + high) / 2
        below = 1 - (1 + mid) * np.exp(-mid) < u
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return (low + high) / 2


_R = _gamma2()
_LN_C = np.log(_R)
_MULT = np.random.default_rng(7).integers(1 << 62, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """bucket, df: the documents of these batches that have a word of the bucket."""
    df = np.zeros(1 << BUCKET_BITS, np.int64)
    for batch in batches:
        for c in chunks(batch.column(0)):
            pairs = np.unique((c.doc_of_word.astype(np.uint64) << np.uint64(BUCKET_BITS)) | (c.words >> np.uint64(64 - BUCKET_BITS)))
            df += np.bincount((pairs & np.uint64((1 << BUCKET_BITS) - 1)).astype(np.int64), minlength=len(df))
    some = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], ["bucket", "df"])


def word_weights(docs: DataFrame) -> np.ndarray:
    """Fixed-point square roots of inverse document frequencies by bucket; 2^16 numbers, whatever the corpus.

    The root keeps a rare word that an edit brings in from outweighing the words that two texts share.
    """
    n = docs.count()
    rows = docs.select("text").mapInArrow(_frequencies, "bucket long, df long").groupBy("bucket").agg(F.sum("df").alias("df")).toPandas()
    df = np.zeros(1 << BUCKET_BITS)
    df[rows["bucket"].to_numpy()] = rows["df"].to_numpy()
    return np.round(np.sqrt(np.log((n + 1) / (df + 1)) + 1) * FIXED).astype(np.int64)


def weighted_shingles(c: Chunk, idf: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc, shingle hash, weight (fixed-point) of the distinct shingles of each text, by doc and hash.

    A text with fewer words than width has one shingle of all its words; one without words has none.
    """
    starts = c.word_bounds
    counts = np.diff(starts)
    per = np.where(counts == 0, 0, np.maximum(counts - width + 1, 1))
    doc = np.repeat(np.arange(len(counts)), per)
    if not len(doc):
        return doc, np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per) + starts[doc]
    size = np.minimum(counts[doc], width)
    # 12 bits of the document within the chunk, 52 bits of the shingle.
    key = (doc.astype(np.uint64) << np.uint64(52)) | (c.windows(at, size) >> np.uint64(12))
    total = np.append(0, np.cumsum(idf[(c.words >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]))
    mean = (total[at + size] - total[at]) // size
    order = np.argsort(key)
    key, mean = key[order], mean[order]
    new = np.append(True, key[1:] != key[:-1])
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(key)))
    return (key[first] >> np.uint64(52)).astype(np.int64), key[first] & np.uint64((1 << 52) - 1), mean[first] * times


def samples(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """n consistent weighted samples for each distinct doc, in order: an array (docs, n) of sample ids.

    For sample k a shingle has r and c from Gamma(2, 1) and b from [0, 1), read from tables at places that its hash gives:
    t = floor(ln w / r + b), ln y = r (t - b), ln a = ln c - ln y - r; the shingle with the smallest a wins. An id joins a
    (fixed-point, thus with t) and the shingle's hash, so that the smallest id is the winner's, and equal
    ids are equal draws.
    """
    starts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    log_w = np.round(np.log(weight / FIXED) * (1 << 20)) / (1 << 20)
    spread = mix(shingle)
    low = spread & np.uint64(0xFFFFFFFF)
    out = np.empty((len(starts), n), np.uint64)
    for k in range(n):
        u = spread * _MULT[k]
        r = _R[u >> np.uint64(48)]
        b = ((u >> np.uint64(16)) & np.uint64(0xFFFF)) * (1.0 / TABLE)
        t = np.floor(log_w / r + b)
        a = _LN_C[(u >> np.uint64(32)) & np.uint64(0xFFFF)] - r * (t - b + 1.0)
        ids = (np.clip((a + 96.0) * (1 << 24), 0, (1 << 32) - 1).astype(np.uint64) << np.uint64(32)) | low
        out[:, k] = np.minimum.reduceat(ids, starts)
    return out


def _bands(idf, width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = []
            for c in chunks(batch.column(3)):
                doc, shingle, weight = weighted_shingles(c, idf, width)
                here: list = [[]] * (len(c.bounds) - 1)
                if len(doc):
                    s = samples(doc, shingle, weight, bands * rows).reshape(-1, bands, rows)
                    h = mix(s[:, :, 0])
                    for j in range(1, rows):
                        h = mix(h * np.uint64(31) + s[:, :, j])
                    h = signed(mix(h + np.arange(bands, dtype=np.uint64)))
                    for d, x in zip(np.unique(doc).tolist(), h, strict=True):
                        here[d] = x
                lists += here
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(lists, pa.list_(pa.int64()))], ["doc_id", "k1", "k2", "bands"])

    return run


def _shingle_rows(idf, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column(0).to_numpy()
            for c in chunks(batch.column(1)):
                doc, shingle, weight = weighted_shingles(c, idf, width)
                yield pa.RecordBatch.from_arrays([pa.array(signed(shingle)), pa.array(nodes[c.row + doc]), pa.array(weight)], ["shingle", "node", "weight"])

    return run


def _totals_and_bands(idf, width: int, bands: int, rows: int):
    sketch = _bands(idf, width, bands, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals = np.zeros(batch.num_rows, np.int64)
            for c in chunks(batch.column(1)):
                doc, _, weight = weighted_shingles(c, idf, width)
                np.add.at(totals, c.row + doc, weight)
            node = batch.column(0)
            (out,) = sketch(iter([pa.RecordBatch.from_arrays([node, node, node, batch.column(1)], ["a", "b", "c", "d"])]))
            yield pa.RecordBatch.from_arrays([node, pa.array(totals), out.column(3)], ["node", "total", "bands"])

    return run


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two (sorted distinct hashes, weights): sum of minima over sum of maxima."""
    total = int(a[1].sum()) + int(b[1].sum())
    if not total:
        return 0.0
    at = np.searchsorted(a[0], b[0])
    at[at == len(a[0])] = 0
    hit = a[0][at] == b[0] if len(a[0]) else np.zeros(len(b[0]), bool)
    both = int(np.minimum(a[1][at[hit]], b[1][hit]).sum())
    return both / (total - both)


def _slices(a: pa.Array, b: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of rows in which the texts of either array are one chunk."""
    size = np.maximum(*(pc.fill_null(pc.binary_length(x), 0).to_numpy() for x in (a, b)))
    upto = np.append(0, np.cumsum(size.astype(np.int64)))
    row = 0
    while row < len(size):
        end = min(max(int(np.searchsorted(upto, upto[row] + CHUNKBYTES, side="right")) - 1, row + 1), len(size), row + CHUNK_DOCS)
        yield row, end
        row = end


def similarities(a: pa.Array, b: pa.Array, idf, width: int) -> np.ndarray:
    """The weighted Jaccard similarity of the texts in each row."""
    out = np.zeros(len(a))
    for lo, hi in _slices(a, b):
        keys, weights, total = [], [], np.zeros(hi - lo, np.int64)
        for texts in (a, b):
            (c,) = chunks(texts.slice(lo, hi - lo), 1 << 62)
            doc, shingle, weight = weighted_shingles(c, idf, width)
            keys.append((doc.astype(np.uint64) << np.uint64(52)) | shingle)
            weights.append(weight)
            np.add.at(total, doc, weight)
        if len(keys[0]) and len(keys[1]):
            at = np.minimum(np.searchsorted(keys[0], keys[1]), len(keys[0]) - 1)
            hit = np.flatnonzero(keys[0][at] == keys[1])
            both = np.zeros(hi - lo, np.int64)
            np.add.at(both, (keys[1][hit] >> np.uint64(52)).astype(np.int64), np.minimum(weights[0][at[hit]], weights[1][hit]))
            out[lo:hi] = both / np.maximum(total - both, 1)
    return out


def _verify(idf, width: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask = pa.array(similarities(batch.column(2), batch.column(3), idf, width) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    return run


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Of rows (bucket, node, ...), those in buckets with several components, with their label; a saved table."""
    at = saved(rows.join(labels, "node"), "near-at")
    mixed = at.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high")
    found = saved(at.join(saved(mixed.select("bucket"), "near-mixed"), "bucket"), "near-open")
    discard(at)
    return found


class _Search:
    """Candidate pairs, compared once each, and the components of what is linked."""

    def __init__(self, nodes: DataFrame, bodies: DataFrame, idf, width: int, least: float):
        self.bodies, self.verify = bodies, _verify(idf, width, least)
        self.labels = saved(nodes.select("node", F.col("node").alias("label")), "near-labels")

    def compare(self, pairs: DataFrame) -> None:
        """Compares pairs (a, b) and contracts what they link."""
        withb = pairs.join(self.bodies.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
        both = withb.join(self.bodies.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").select("a", "b", "ta", "tb")
        links = saved(both.mapInArrow(self.verify, "a long, b long"), "near-links")
        at_a = links.join(self.labels.select(F.col("node").alias("a"), F.col("label").alias("la")), "a")
        at_b = at_a.join(self.labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b").filter("la <> lb")
        old, self.labels = self.labels, saved(relabelled(self.labels, components(at_b, "la", "lb")), "near-labels")
        discard(old, links)

    def rounds(self, members: DataFrame, likely: Column, spread: int, most: int | None = None) -> DataFrame:
        """Rounds over members (bucket, node, rank, bands, ...): the rows of buckets left with several components.

        In round i, members are dealt by hash to spread^i groups, and the first in rank of each group leads: it is compared with all
        of its bucket's members of other components (if likely, a condition on their columns and the leader's, which begin with
        l_), then leaves the bucket, as all its comparisons there are made. Two documents are compared in the first of the bands that they
        share, so never twice. Without `most` rounds the last bucket is worked off.
        """
        i = 0
        at = _labelled(members, self.labels)
        while (most is None or i < most) and not at.isEmpty():
            group = F.pmod(F.xxhash64("node", F.lit(i)), F.lit(spread**i))
            leaders = saved(at.groupBy("bucket", group.alias("group")).agg(F.max_by(F.struct(*[c for c in at.columns if c != "bucket"]), "rank").alias("l")), "near-leaders")
            led = leaders.select("bucket", *[F.col(f"l.{c}").alias(f"l_{c}") for c in at.columns if c != "bucket"])
            # Of two leaders in a bucket, one is compared with the other.
            both = at.join(led.select("bucket", F.col("l_node").alias("node"), F.lit(True).alias("leads")), ["bucket", "node"], "left")
            here = F.element_at(F.array_intersect("bands", "l_bands"), 1) == F.col("bucket")
            once = F.col("leads").isNull() | (F.col("l_node") < F.col("node"))
            pairs = both.join(led, "bucket").filter((F.col("label") != F.col("l_label")) & once & likely & here)
            pairs = saved(pairs.select(F.col("l_node").alias("a"), F.col("node").alias("b")), "near-pairs")
            left = both.filter("leads is null").drop("label", "leads")
            self.compare(pairs)
            left = _labelled(left, self.labels)
            discard(at, leaders, pairs)
            at, i = left, i + 1
        return at


def classified(docs: DataFrame, width: int = 5, least: float = 0.8, bands: int = 10, rows: int = 3, leader_rounds: int = 2, narrow: tuple[int, int] = (36, 8)) -> DataFrame:
    """doc_id, k1, k2 (hashes of the text), class_id, class_size, kept for every row of docs.

    class_id is the smallest doc_id of the connected component of links (weighted Jaccard similarity of at least `least`)
    that the row's text belongs to; kept marks one row of each class. A pair at similarity s shares a bucket
    with probability 1 - (1 - s^rows)^bands: 0.9992 at 0.8. narrow gives bands and rows of the last rounds (0.9987 at 0.8).

    Equal texts are one class (null counts as empty). Rows that share a doc_id are judged by their own texts. A null
    doc_id comes after all others. An empty table gives no rows.
    """
    rows_in = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    small_batches(docs.sparkSession)
    idf = word_weights(rows_in)
    keys = (F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"))
    sketched = rows_in.select("doc_id", *keys, "text").mapInArrow(_bands(idf, width, bands, rows), "doc_id long, k1 long, k2 long, bands array<long>")
    sketched = saved(sketched, "near-sketches")
    texts = saved(sketched.groupBy("k1", "k2", "bands").agg(F.min("doc_id").alias("first_id")).withColumn("node", F.monotonically_increasing_id()), "near-texts")

    buckets = texts.select("node", F.explode("bands").alias("bucket"))
    shared = saved(buckets.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1"), "near-buckets")
    sized = saved(buckets.join(shared, "bucket").select("bucket", "size", "node"), "near-sized")
    # The document of a bucket that lies in the fullest buckets is nearest to the others: it leads.
    weight = saved(sized.groupBy("node").agg(F.sum("size").alias("weight")), "near-weights")
    ranked = texts.join(weight, "node").select("node", F.struct("weight", "node").alias("rank"), "bands")
    members = saved(sized.select("bucket", "node").join(ranked, "node"), "near-members")
    discard(shared, sized)

    involved = weight.select("node").join(texts.select("node", "k1", "k2", "first_id"), "node")
    whole = rows_in.select("doc_id", "text", *keys).join(involved.select("node", "k1", "k2", F.col("first_id").alias("doc_id")), ["doc_id", "k1", "k2"])
    bodies = saved(whole.select("node", "text").dropDuplicates(["node"]), "near-bodies")

    search = _Search(weight, bodies, idf, width, least)
    left = search.rounds(members, F.lit(True), 1, leader_rounds).select("node").distinct()
    # The rest: documents that still share a bucket over components meet in narrower buckets. What of a document's
    # weight is in no other of them can't be common, which bounds a pair's similarity before it is compared.
    open_bodies = saved(bodies.join(left, "node"), "near-open-bodies")
    open_bodies = saved(open_bodies.repartition(max(1, -(-open_bodies.count() // OPEN_ROWS))), "near-open-bodies")
    shingles = open_bodies.mapInArrow(_shingle_rows(idf, width), "shingle long, node long, weight long")
    alone = shingles.groupBy("shingle").agg(F.count("*").alias("c"), F.min("node").alias("node"), F.min("weight").alias("weight")).filter("c = 1")
    alone = saved(alone.groupBy("node").agg(F.sum("weight").alias("own")), "near-own")
    sharp = open_bodies.mapInArrow(_totals_and_bands(idf, width, *narrow), "node long, total long, bands array<long>")
    sharp = sharp.join(alone, "node", "left").withColumn("common", F.col("total") - F.coalesce("own", F.lit(0))).filter(F.col("common") >= least * F.col("total"))
    narrowed = saved(sharp.select("node", "total", "common", "bands", F.explode("bands").alias("bucket")), "near-narrow")
    # The smallest partner that a bucket offers bounds the similarity of each of its documents.
    smallest = saved(narrowed.groupBy("bucket").agg(F.min("total").alias("smallest"), F.count("*").alias("size")).filter("size > 1"), "near-smallest")
    hopeful = F.col("common") >= least * (F.col("total") + F.greatest("smallest", "common") - F.col("common"))
    hoping = saved(narrowed.join(smallest, "bucket").filter(hopeful).drop("smallest"), "near-hoping")
    discard(narrowed)
    weight = saved(hoping.groupBy("node").agg(F.sum("size").alias("weight")), "near-weights")
    narrowed = saved(hoping.join(weight, "node").select("bucket", "node", F.struct("weight", "node").alias("rank"), "bands", "total", "common"), "near-narrow")
    shared = F.least("common", "l_common")
    search.rounds(narrowed, shared >= least * (F.col("total") + F.col("l_total") - shared), 16)
    labels = search.labels

    named = saved(texts.join(labels, "node", "left").select("k1", "k2", F.coalesce("label", "node").alias("label"), "first_id"), "near-names")
    ids = saved(named.groupBy("label").agg(F.min("first_id").alias("class_id")), "near-classes")
    rows_out = saved(sketched.select("doc_id", "k1", "k2").join(named.select("k1", "k2", "label"), ["k1", "k2"]).select("doc_id", "k1", "k2", "label", F.monotonically_increasing_id().alias("row")), "near-rows")
    sizes = saved(rows_out.groupBy("label").agg(F.count("*").alias("class_size"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))["row"].alias("keep_row")).join(ids, "label"), "near-sizes")
    discard(sketched, texts, members, bodies, open_bodies, narrowed, hoping, named, ids, labels)
    return rows_out.join(sizes, "label").select("doc_id", "k1", "k2", "class_id", "class_size", (F.col("row") == F.col("keep_row")).alias("kept"))


def near_duplicates(docs: DataFrame, **parameters) -> DataFrame:
    """doc_id, class_id, class_size, kept for every row of docs; see classified."""
    return classified(docs, **parameters).drop("k1", "k2")


def deduplicated(docs: DataFrame, **parameters) -> DataFrame:
    """docs with one row of each class: the one with the smallest doc_id (of equal rows, any one)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    whole = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1 << 63)).alias("id"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"), F.struct(*docs.columns).alias("d"))
    kept = classified(docs, **parameters).filter("kept").select(F.coalesce("doc_id", F.lit(-1 << 63)).alias("id"), "k1", "k2")
    return whole.join(saved(kept, "near-kept"), ["id", "k1", "k2"], "left_semi").dropDuplicates(["id", "k1", "k2"]).select("d.*")
