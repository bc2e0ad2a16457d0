"""Label search: which field's label a fragment of a line is, for fragments read with mistakes.

Two texts are similar at 85 of 100 if few letters must go or come (Indel similarity). A label is cut into one piece more than any such fragment can have edits, so one
piece stands unchanged in it, and about where it stands in the label: an index of the pieces of all labels, a few hundred rows, joined with the parts of
each distinct fragment, loses no match. (All keys with letters deleted would do the same for short labels, but a fragment of 27 letters may have
seven of them too many: 888,030 keys.) What meets is checked by the letters both have, then exactly, by the longest common subsequence with one bit per letter
of the label: long arithmetic in the JVM, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelry.functions.constants import ASCII_DIGITS, DEVANAGARI_DIGITS, LABELS
from parcelry.functions.text import label_candidate, squeezed, word_count
from parcelry.sources.stored import new_path

CUTOFF = 85
WORDS = 4
#: Up to so many distinct fragments that are labels go to all executors (about 100 bytes each); more meet the lines in a shuffle.
FEW = 50_000
#: Labels in their order: of equally similar ones the first counts.
TERMS = [(label, field) for field, labels in LABELS.items() for label in labels]
_BITS = 61
#: What goes from a fragment's ends; digits that no label has (those of each script apart, as they tell whether a fragment is Latin).
EDGE = ".:()"
_UNLIKE = ["".join(d for d in digits if not any(d in label for label, _ in TERMS)) for digits in (ASCII_DIGITS, DEVANAGARI_DIGITS)]


def most_edits(n: int, cutoff: int = CUTOFF) -> tuple[int, int]:
    """How many letters must go or come at most between a label of n letters and a similar text, and how long such a text can be."""
    longest = n * (200 - cutoff) // cutoff
    most = 0
    for m in range(1, longest + 1):
        e = (n + m) * (100 - cutoff) // 100
        e -= (e - n - m) % 2  # each text's letters are common or not, so edits are as odd as both lengths together
        most = max(most, e) if e >= abs(n - m) else most
    return most, longest


def pieces(label: str, cutoff: int = CUTOFF) -> list[tuple[int, str]]:
    """A label in one piece more than a similar text can have edits, with where each begins; a piece has a letter at least."""
    n, many = len(label), min(len(label), most_edits(len(label), cutoff)[0] + 1)
    cuts = [i * n // many for i in range(many + 1)]
    return [(a, label[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def label_index(spark: SparkSession, terms: list[tuple[str, str]] | None = None, cutoff: int = CUTOFF) -> DataFrame:
    """One row per piece of each term: its size is that of the vocabulary, whatever the input's."""
    rows = []
    for order, (label, field) in enumerate(TERMS if terms is None else terms):
        n, bits, places = len(label), 0, {}
        for i, ch in enumerate(label):
            bits |= 1 << ord(ch) % _BITS
            places[ch] = places.get(ch, 0) | 1 << i
        rows += [(piece, at, order, field, n, most_edits(n, cutoff)[0], bits, places) for at, piece in pieces(label, cutoff)]
    return spark.createDataFrame(rows, "piece string, at int, label_order int, field_name string, n int, edits int, bits long, places map<string,long>")


def _letters(text: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(text, i, 1))


def _bits(letters: Column) -> Column:
    """The letters as a set of 61 bits; a bit may stand for several."""
    return F.aggregate(letters, F.lit(0).cast("long"), lambda s, ch: s.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.ascii(ch) % _BITS)))


def _common(letters: Column, places: Column, n: Column) -> Column:
    """Length of the longest common subsequence of letters and a label of n, bit by bit of the label."""
    every = F.call_function("shiftleft", F.lit(1).cast("long"), n) - 1
    hit = lambda open_, ch: open_.bitwiseAND(F.coalesce(F.try_element_at(places, ch), F.lit(0).cast("long")))
    left = F.aggregate(letters, every, lambda open_, ch: (open_ + hit(open_, ch)).bitwiseOR(open_ - hit(open_, ch)).bitwiseAND(every))
    return n - F.bit_count(left)


def cleaned(fragment: Column) -> Column:
    """A fragment as labels are written: lower case, no dots, colons and brackets at its ends."""
    return F.btrim(F.lower(F.trim(fragment)), F.lit(EDGE))


def label_matches(fragments: DataFrame, terms: list[tuple[str, str]] | None = None, cutoff: int = CUTOFF) -> DataFrame:
    """fragment, field_name, key_score of those fragments that are labels; fragments are cleaned and distinct."""
    spark, used = fragments.sparkSession, TERMS if terms is None else terms
    if not used:
        return fragments.select("fragment", F.lit(None).cast("string").alias("field_name"), F.lit(None).cast("double").alias("key_score")).limit(0)
    sizes = sorted({len(p) for label, _ in used for _, p in pieces(label, cutoff)})
    longest = max(most_edits(len(label), cutoff)[1] for label, _ in used)
    m = F.length("fragment")
    part = lambda k: F.transform(F.sequence(F.lit(0), m - k), lambda i: F.struct(F.substring(F.col("fragment"), i + 1, k).alias("piece"), i.alias("place")))
    parts = F.flatten(F.array(*[F.when(m >= k, part(k)).otherwise(F.array().cast("array<struct<piece:string,place:int>>")) for k in sizes]))
    fit = fragments.filter(label_candidate(F.col("fragment")) & (m <= longest))
    cut = fit.select("fragment", _bits(_letters(F.col("fragment"))).alias("own"), F.explode(parts).alias("p")).select("fragment", "own", "p.*")
    size, both = F.length("fragment"), F.length("fragment") + F.col("n")
    near = (F.abs(F.col("place") - F.col("at")) <= F.col("edits")) & (200 * F.least(size, F.col("n")) >= cutoff * both)
    met = cut.join(F.broadcast(label_index(spark, used, cutoff)), "piece").filter(near)  # the index is fixed
    at_most = F.least(size, F.col("n") - F.bit_count(F.col("bits").bitwiseAND(F.bitwise_not("own"))))
    some = met.filter(200 * at_most >= cutoff * both).select("fragment", "field_name", "label_order", (200.0 * _common(_letters(F.col("fragment")), F.col("places"), F.col("n")) / both).alias("key_score"))
    scored = some.filter(F.col("key_score") >= cutoff)
    return scored.groupBy("fragment").agg(F.max_by(F.struct("field_name", "key_score"), F.struct("key_score", -F.col("label_order"))).alias("m")).select("fragment", "m.*")


def _alike(segment: Column) -> Column:
    """A segment's words in lower case, with one digit for all that no label has: they are equally unlike any label, so fragments that differ only there are looked up as one."""
    return F.translate(F.lower(squeezed(segment)), "".join(_UNLIKE), "".join(digits[:1] * len(digits) for digits in _UNLIKE))


def _tails(text: Column, words: Column, edged: Column) -> list[Column]:
    """The last one to four words of a text with single spaces, as labels are written; null where it has fewer."""
    last = lambda n: F.substring_index(text, " ", -n)
    return [F.when(words >= n, F.when(edged, F.btrim(last(n), F.lit(EDGE))).otherwise(last(n))) for n in range(1, WORDS + 1)]


def _cut(rows: DataFrame, text: Column) -> tuple[DataFrame, list[Column]]:
    """rows with what the ends of a text are cut by, each computed once, and these ends."""
    out = rows.withColumn("_text", text)
    out = out.withColumns({"_words": word_count(F.col("_text")), "_edged": F.col("_text").rlike(f"[{EDGE}]")})
    return out, _tails(F.col("_text"), F.col("_words"), F.col("_edged"))


def _rank(i: Column, words: Column, key_score: Column) -> Column:
    """A word more counts four points at the head of a line, half a point within it; of equals the shorter label counts at the head, the longer one within."""
    return F.struct((key_score + words * F.when(i == 0, 4.0).otherwise(0.5)).alias("s"), F.when(i == 0, -words).otherwise(words).alias("w"))


def _labelled(rows: DataFrame, found: DataFrame, segment: Column, i: Column, name: str) -> DataFrame:
    """rows with struct(rank, field_name, key_score, words) of the label at the end of a segment, or null; found goes to all executors, so no row moves."""
    out, tails = _cut(rows, _alike(segment))
    out = out.select(*rows.columns, *[tail.alias(f"_{n}") for n, tail in enumerate(tails, 1)])
    for n in range(1, WORDS + 1):
        out = out.join(F.broadcast(found.select(F.col("fragment").alias(f"_{n}"), F.struct("field_name", "key_score").alias(f"_m{n}"))), f"_{n}", "left")
    hits = [(F.lit(n), F.col(f"_m{n}")) for n in range(1, WORDS + 1)]
    best = F.greatest(*[F.when(m.isNotNull(), F.struct(_rank(i, n, m["key_score"]).alias("rank"), m["field_name"].alias("field_name"), m["key_score"].alias("key_score"), n.alias("words"))) for n, m in hits])
    return out.select(*rows.columns, F.explode(F.array(best)).alias(name))  # explode: else filters repeat the whole expression


def _few(heads: DataFrame, key: list[str], found: DataFrame) -> DataFrame:
    """key, i, label and own, the words of the next segment's label, by lookups alone."""
    some = _labelled(heads, found, F.col("segment"), F.col("i"), "label").filter("label is not null").drop("segment")
    within = F.when(F.col("i") + 2 < F.size("segments"), F.get("segments", F.col("i") + 1))
    return _labelled(some, found, within, F.col("i") + 1, "next").select(*key, "i", "label", F.coalesce(F.col("next")["words"], F.lit(0)).alias("own"))


def _many(heads: DataFrame, key: list[str], found: DataFrame) -> DataFrame:
    """The same where the labels found are too many to go to all executors: they meet the lines by sort and merge."""
    cut, tails = _cut(heads, _alike(F.col("segment")))
    each = F.array(*[F.struct(F.lit(n).alias("words"), tail.alias("fragment")) for n, tail in enumerate(tails, 1)])
    hits = cut.select(*key, "i", F.explode(each).alias("t")).select(*key, "i", "t.*").join(found.hint("merge"), "fragment")
    best = hits.groupBy(*key, "i").agg(F.max_by(F.struct("i", "field_name", "key_score", "words"), _rank(F.col("i"), F.col("words"), F.col("key_score"))).alias("label"))
    labels = best.groupBy(*key).agg(F.collect_list("label").alias("labels"))  # at most the segments of a line
    own = lambda x: F.coalesce(F.get(F.filter("labels", lambda y: y["i"] == x["i"] + 1), F.lit(0))["words"], F.lit(0))
    each = labels.select(*key, F.explode(F.transform("labels", lambda x: F.struct(x["i"].alias("i"), x.alias("label"), own(x).alias("own")))).alias("p"))
    return each.select(*key, "p.*")


def label_values(lines: DataFrame) -> DataFrame:
    """document_id, line_no, conf, field_name, key_score, raw from lines (document_id, line_no, conf, segments); lines that are equal count once.

    A segment ends with the label of the next one's value: its last one to four words, the best by score and words (_rank). The ends of all segments are looked up once each, those that
    differ in digits alone as one. Only fragments that are labels come back to the lines. They are stored and counted first: a plan can't know how many rows an explode makes, and
    Spark would take the lines for the small side and broadcast them.
    """
    key, spark = ["document_id", "line_no", "conf", "segments"], lines.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # small rows, much work each: by size they would go to few tasks
    some = lines.select(*key).filter(F.size("segments") >= 2)
    heads = F.slice("segments", 1, F.size("segments") - 1)
    ends = some.select(F.explode(heads).alias("segment")).select(F.substring_index(_alike(F.col("segment")), " ", -WORDS).alias("text")).distinct()
    cut, tails = _cut(ends, F.col("text"))
    fragments = cut.select(F.explode(F.array(*tails)).alias("fragment")).distinct()
    matches, path = label_matches(fragments.repartition(tasks, "fragment")), new_path(spark, "labels")
    matches.write.parquet(path)
    found = spark.read.schema(matches.schema).parquet(path)
    each = some.repartition(tasks, "document_id", "segments").distinct().select(*key, F.posexplode(heads).alias("i", "segment"))
    labels = (_few if found.count() <= FEW else _many)(each, key, found).withColumn("after", F.get("segments", F.col("i") + 1)).withColumn("inner", squeezed(F.col("after")))
    before = F.call_function("substring_index", F.col("inner"), F.lit(" "), word_count(F.col("inner")) - F.col("own"))
    raw = F.when(F.col("i") + 2 == F.size("segments"), F.col("after")).when(F.col("own") == 0, F.col("inner")).otherwise(before)
    return labels.select("document_id", "line_no", "conf", "label.field_name", "label.key_score", raw.alias("raw"))
