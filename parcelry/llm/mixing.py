"""Mixing sources to target weights, in DataFrame functions only.

Each source's words form one stream, cut into blocks of a fixed number of words. The mix is a list of slots; a source
holds as many slots as its target needs. Its slots are thrown into the output shards like balls into bins, so a shard's source counts
are a multinomial draw, under the condition that a source's counts add up to its slots, so that a source's share is met exactly. The drawn counts decide how a shard is mixed
and which of a source's slots it holds, the next so many in shard order; how often a document is taken in all depends on the permutations alone. Slot j of a source with N blocks belongs to pass j div N and takes the block that
the pass's pseudorandom permutation of 0..N-1 gives for j mod N. Blocks join by index.

Nothing depends on partitioning or on the order in which rows are read: reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parcelry.llm.shared import WORD, renewed, saved, words

#: Odd multipliers of the mixing rounds; below 2^22, so that products of 40-bit indices stay within a long.
MULTIPLIERS = (2654435, 3266489, 1103515)
CHUNK, WALKS, TOP = 4096, 64, 65536


def sized(docs: DataFrame, whole: bool) -> DataFrame:
    """row (a key of its own for every row), doc_id, source, size (words; null text has none) and text_key, as a saved table.

    whole: with the row itself as d, so that its columns can't clash.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    kept = [F.struct(*docs.columns).alias("d")] if whole else []
    return saved(docs.select("doc_id", "source", size.alias("size"), F.xxhash64("text").alias("text_key"), *kept).withColumn("row", F.monotonically_increasing_id()), "mix-sizes")


def targets(sizes: DataFrame, weights: tuple[int, ...], cap: float) -> DataFrame:
    """rank, source, source_size, weight, target: one row per source, ranked by code point, null last.

    The targets fill up like water: below a common level per weight, or at cap times the source's size. Sources are
    ordered by the level at which they are full; the level is right at the first one that isn't full.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = W.orderBy(F.col("source").asc_nulls_last())  # one row per source
    n = len(weights)
    per = per.withColumn("rank", F.row_number().over(everything).cast("long") - 1)
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % n + 1).cast("int")).cast("double"))
    per = per.withColumn("most", F.col("source_size") * float(cap)).withColumn("full_at", F.col("most") / F.col("weight"))
    before = W.orderBy("full_at", "rank").rowsBetween(W.unboundedPreceding, -1)
    after = W.orderBy("full_at", "rank").rowsBetween(0, W.unboundedFollowing)
    whole = W.partitionBy(F.lit(1))
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    per = per.withColumn("level", left / F.sum("weight").over(after))
    level = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "rank", "level"))).over(whole)["level"]
    return per.withColumn("water", level).select("rank", "source", "source_size", "weight", F.least("most", F.coalesce(F.col("water") * F.col("weight"), F.col("most"))).alias("target"))


def budget(target: DataFrame, block: int, cap: float) -> DataFrame:
    """Adds blocks (of the source), slots (that the mix takes), bits and mask of the permutations' range."""
    size = F.col("source_size")
    full = F.when(size > 0, F.floor(F.col("target") / size + F.lit(1e-9))).otherwise(F.lit(0))
    t = target.withColumn("blocks", F.ceil(size / block).cast("long")).withColumn("full", F.least(full, F.lit(int(cap))).cast("long"))
    rest = F.when(F.col("full") >= int(cap), F.lit(0)).otherwise(F.least(F.round((F.col("target") - F.col("full") * size) / block).cast("long"), F.col("blocks")))
    t = t.withColumn("slots", F.col("full") * F.col("blocks") + F.greatest(rest.cast("long"), F.lit(0)))
    bits = F.greatest(F.length(F.conv(F.greatest(F.col("blocks") - 1, F.lit(0)).cast("string"), 10, 2)), F.lit(2)).cast("int")
    return t.withColumn("bits", bits).withColumn("mask", F.expr("shiftleft(1L, bits) - 1"))


def _shuffled(x: Column, key: Column) -> Column:
    """A bijection of 0..mask: odd multiplications and keyed additions modulo 2^bits, and folds of the upper half."""
    half = F.greatest((F.col("bits") / 2).cast("int"), F.lit(1))
    for k, m in enumerate(MULTIPLIERS):
        x = (x * F.lit(m) + F.shiftright(key, 7 * k + 1).bitwiseAND(F.col("mask"))).bitwiseAND(F.col("mask"))
        x = x.bitwiseXOR(F.call_function("shiftright", x, half))
    return x


def draws(plan: DataFrame, seed: int, shard_slots: int) -> DataFrame:
    """rank, shard, first, n: how many slots each shard draws from a source, and its first one; a saved table.

    The number of shards grows with the mix, so that a shard has shard_slots slots on average. Slots are thrown in chunks, so that a
    source's slots aren't one array, and counts are summed up before they are shuffled.
    """
    total = plan.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    shards = max(1, -(-total // shard_slots))
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / CHUNK)))
    p = plan.filter("slots > 0").select("rank", "slots", chunk.alias("chunk")).repartition(max(1, min(10_000, -(-total // (8 * CHUNK)))), "rank", "chunk")
    last = F.least((F.col("chunk") + 1) * CHUNK, F.col("slots")) - 1
    balls = p.select("rank", F.explode(F.sequence(F.col("chunk") * CHUNK, last)).alias("slot"))
    drawn = balls.groupBy("rank", F.pmod(F.xxhash64(F.lit(seed + 1), "rank", "slot"), F.lit(shards)).alias("shard")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("rank").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return saved(drawn.select("rank", "shard", before.alias("first"), "n"), "mix-draws")


def slots(plan: DataFrame, drawn: DataFrame, seed: int) -> DataFrame:
    """rank, shard, pass, slot, block: every slot of the mix, as drawn.

    The permutation of 0..blocks-1 walks the cycle of a bijection of 0..2^bits-1 (at most twice as many, or four) until it is in
    range. A walk that isn't after WALKS steps raises an error; none is lost.
    """
    total = plan.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    p = drawn.join(plan.select("rank", "blocks", "bits", "mask"), "rank").repartition(max(1, min(10_000, -(-total // (8 * CHUNK)))), "rank", "shard")
    p = p.withColumn("slot", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)))
    p = p.withColumn("pass", F.floor(F.col("slot") / F.col("blocks"))).withColumn("key", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "rank", "pass"), 1))
    start = _shuffled(F.col("slot") % F.col("blocks"), F.col("key"))
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), start, lambda at, _: F.when(at < F.col("blocks"), at).otherwise(_shuffled(at, F.col("key"))))
    p = p.withColumn("walked", walk)
    block = F.when(F.col("walked") < F.col("blocks"), F.col("walked")).otherwise(F.raise_error(F.lit("a slot's walk has not ended")).cast("long"))
    return p.select("rank", "shard", "pass", "slot", block.alias("block"))


def document_blocks(sizes: DataFrame, n_docs: int, block: int) -> DataFrame:
    """source, row, doc_id, size, block, first, words: which words (from first on) of a document lie in which block.

    A source's stream runs through buckets of documents by hash of doc_id; offsets are sums over earlier buckets plus a
    running sum within the bucket, so no source is one task, nor are texts that share a doc_id. Equal rows are interchangeable.
    """
    count = max(1, min(TOP, -(-n_docs // 512)))
    d = sizes.select("row", "doc_id", "size", "source", "text_key").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(count)))
    key = ["source", "bucket"]
    per = d.groupBy(*key).agg(F.sum("size").alias("in_bucket"))
    before = F.coalesce(F.sum("in_bucket").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = saved(per.select(*key, before.alias("start")), "mix-starts")
    running = F.coalesce(F.sum("size").over(W.partitionBy(*key).orderBy("doc_id", "text_key", "row").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    d = d.withColumn("within", running)
    s = starts.select(F.col("source").alias("s_source"), F.col("bucket").alias("s_bucket"), "start")
    d = d.join(s, d["source"].eqNullSafe(s["s_source"]) & (d["bucket"] == s["s_bucket"])).drop("s_source", "s_bucket", "bucket")
    d = d.withColumn("at", F.col("start") + F.col("within")).drop("start", "within")
    spans = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block)))
    d = d.withColumn("block", F.explode_outer(spans))
    first = F.greatest(F.col("block") * block - F.col("at"), F.lit(0))
    last = F.least((F.col("block") + 1) * block - F.col("at"), F.col("size"))
    return d.select("source", "row", "doc_id", "size", "block", first.alias("first"), (last - first).alias("words"))


class Mix:
    """A mix of docs (doc_id, text, source): sizes, plan (one row per source), slots and blocks.

    Null texts and texts without words have size 0 and are never taken. A null source is a source of its own. An empty
    table gives an empty mix. Rows that share a doc_id count each.
    """

    def __init__(self, docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3, block: int = 64, shard_slots: int = 8192, seed: int = 17, whole: bool = False):
        self.columns = docs.columns
        self.sizes = sized(docs, whole)
        self.plan = saved(budget(targets(self.sizes, weights, cap), block, cap), "mix-plan")
        self.draws = draws(self.plan, seed, shard_slots)
        self.slots = slots(self.plan, self.draws, seed)
        self.blocks = document_blocks(self.sizes, self.sizes.count(), block)

    def ranked(self, blocks: DataFrame) -> DataFrame:
        p = self.plan.select(F.col("source").alias("p_source"), "rank", "source_size", "target")
        return blocks.join(p, blocks["source"].eqNullSafe(p["p_source"])).drop("p_source")

    def taken(self) -> DataFrame:
        """doc_id, source, size, source_size, target, taken, first_shard (the first output shard with words of it; null where none are taken): one row per row of docs."""
        counts = self.slots.groupBy("rank", "block").agg(F.count("*").alias("times"), F.min("shard").alias("shard"))
        b = self.ranked(self.blocks).join(counts.hint("merge"), ["rank", "block"], "left")
        per = b.groupBy("row", "doc_id", "source", "size", "source_size", "target")
        return per.agg(F.coalesce(F.sum(F.col("words") * F.col("times")), F.lit(0)).cast("long").alias("taken"), F.min("shard").alias("first_shard")).drop("row")

    def documents(self, by_shard: bool = False) -> DataFrame:
        """The mix as documents (needs whole=True): for each pass that takes words of a row, that row with the words taken, in order.

        A row taken whole keeps its text; of one taken in part the words are joined by one space. n_chars, if there, is
        counted anew. by_shard: with output_shard, and for each shard the words that it holds by the draw, so a row that several shards share comes in parts; else those parts are one.
        """
        keys = ["row", "pass", "shard"] if by_shard else ["row", "pass"]
        pieces = self.ranked(self.blocks).join(self.slots.select("rank", "pass", "shard", "block").hint("merge"), ["rank", "block"])
        spans = pieces.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("first", "words"))).alias("spans"), F.sum("words").alias("mixed"))
        out = self.sizes.select("row", "size", "d").join(spans, "row")
        part = F.array_join(F.flatten(F.transform("spans", lambda s: F.slice(F.col("w"), (s["first"] + 1).cast("int"), s["words"].cast("int")))), " ")
        out = out.withColumn("w", F.when(F.col("mixed") < F.col("size"), words(F.col("d.text"))))
        out = out.withColumn("mixed_text", F.when(F.col("mixed") < F.col("size"), part).otherwise(F.col("d.text")))
        shard = [F.col("shard").alias("output_shard")] if by_shard else []
        return out.select(*shard, *(renewed(c, F.col(f"d.`{c}`"), F.col("mixed_text")) for c in self.columns))
