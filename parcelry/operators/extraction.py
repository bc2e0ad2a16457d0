"""Extraction: lines of text become candidate fields; the best candidate of each field stays."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelry.functions.constants import (
    AUTO_ACCEPT, BLANK_INK, COLUMNS, CULTIVATOR_ROLES, DATE_VALUES, DIGIT_ONLY, EDGES, EMBEDDED_LABELS, FATHER_MARKS, FIGURE_FIELDS, FIGURE_UNIT, FILL_IN, IDENTIFYING,
    LAND_CLASSES, LATIN_WORD, LEADING_UNITS, NAME_STOPS, OWNER_ROLES, OWNERSHIP_TYPES, REREAD_GAIN, REREAD_TOP, SEALS, SEPARATOR, SHAPES, STATE_MENTIONS, STROKES,
    TITLE_NOISE, VOCABULARIES,
)
from parcelry.functions.fuzzy import best_match
from parcelry.functions.text import ascii_digits, blank_to_null, collapse, comparable, first_term, has_shape, is_gibberish, looks_like_person, once, squeezed
from parcelry.operators.labels import label_values
from parcelry.operators.sequences import argmax_per_key



def score(key_score: Column, ocr_conf: Column, valid: Column) -> Column:
    """Confidence from the label's match, the reading's confidence and the value's validity; at most 99."""
    return F.round(F.greatest(F.lit(0.0), F.least(0.35 * key_score + 0.40 * ocr_conf + 25.0 * valid, F.lit(99.0))), 1)


def validity(field: Column, value: Column) -> Column:
    """1 or 0.35 by shape; where a field has none, 0.9 for 2 to 80 characters, else 0.5."""
    return F.when(field.isin(*SHAPES) & value.isNotNull(), F.when(has_shape(field, value), 1.0).otherwise(0.35)).otherwise(F.when(F.length(value).between(2, 80), 0.9).otherwise(0.5))


def merge_score(confidence: Column, shaped: Column, digit_field: Column, value: Column) -> Column:
    """Confidence, plus 15 with a valid shape, minus 25 for a number field without a digit."""
    return confidence + F.when(shaped, 15.0).otherwise(0.0) - F.when(digit_field & ~value.rlike("[0-9०-९]"), 25.0).otherwise(0.0)


def quality_factor(confidence: Column, quality: Column, reliability: Column) -> Column:
    return F.round(confidence * (0.85 + 0.15 * quality / 100) * reliability, 1)


def learned(confidence: Column) -> Column:
    return F.least(F.lit(99.0), confidence + 10)


def needs_review(confidence: Column, agreement: Column) -> Column:
    return (confidence < AUTO_ACCEPT) | F.coalesce(agreement == "disagree", F.lit(False))


def segments(line: Column) -> Column:
    """A line cut at separators; one without any, at the last word if that begins with a figure."""
    marked = F.regexp_replace(F.trim(line), SEPARATOR, ":")  # any colon is a separator, so no other one is left; a plain split compiles its pattern for every row
    parts = F.array_remove(F.split(marked, ":"), "")
    bare = r"^(.*?[A-Za-zऀ-ॿ.]{2,})\s+([0-9०-९][0-9०-९/.\-A-Za-z]*)$"
    label, figure = F.regexp_extract(F.trim(line), bare, 1), F.regexp_extract(F.trim(line), bare, 2)
    return once(parts, lambda p: F.when((F.size(p) < 2) & (figure != ""), F.array(label, figure)).otherwise(p))


def _any(phrases: tuple[str, ...], after: str) -> str:
    """A pattern of any of the phrases after something. What a place must begin with comes first, as few places of a Latin value do."""
    heads = "".join(sorted({re.escape(p[0]) for p in phrases if not "ऀ" <= p[0] <= "ॿ"}))
    return f"(?=[ऀ-ॿ{heads}]){after}(?:{'|'.join(map(re.escape, phrases))})"


#: Latin words and figures with single spaces, which only a title phrase can shorten.
_PLAIN = r"^[0-9A-Za-z/]+(?: [0-9A-Za-z/]+)*\z"


def trimmed(value: Column) -> Column:
    """A value up to the first title phrase or embedded label, without rules of dots and edge punctuation."""
    title, label = f"(?iu:{_any(TITLE_NOISE, '(?<=.)')})", _any(EMBEDDED_LABELS, r"(?<=[^\p{L}\p{N}ऀँंः])")

    def cut(v: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(v, f"(?:{title}|{label})(?s:.*)", ""), FILL_IN, " "), SEALS, "")
        return F.when(v.rlike(_PLAIN) & ~v.rlike(title), v).otherwise(F.btrim(F.regexp_replace(bare, r"\s{2,}", " "), F.lit(EDGES)))

    return once(F.trim(value), cut)


def without_latin(value: Column) -> Column:
    """A Devanagari value without the Latin words in it, which are misreadings; one that has no other words stays."""
    kept = lambda v: squeezed(F.regexp_replace(v, LATIN_WORD, ""))
    return once(value, lambda v: F.when(v.rlike("[\\u0900-\\u097F]"), F.coalesce(blank_to_null(kept(v)), v)).otherwise(v))


def figure_of(value: Column) -> Column:
    """The first figure of a numeric value, with its unit word if it has one."""
    v = F.substring_index(value, "(", 1)
    figure = F.replace(F.regexp_extract(ascii_digits(v), r"([0-9]+(?:[.,][0-9]+)?)", 1), F.lit(","), F.lit("."))
    return F.when(figure == "", v).otherwise(F.concat_ws(" ", figure, blank_to_null(F.regexp_extract(v, FIGURE_UNIT, 1))))


def _strokes(value: Column) -> Column:
    return F.translate(ascii_digits(value), STROKES, "1" * len(STROKES))


def date_of(value: Column) -> Column:
    """The first date of a value with dots between its figures, white space dropped and strokes read as ones; the value if there is none."""
    found = F.regexp_extract(F.regexp_replace(_strokes(value), r"(?U)\s+", ""), r"([0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{2,4})", 1)
    return F.when(found == "", value).otherwise(F.translate(found, "-/", ".."))


def year_of(value: Column) -> Column:
    """The first year or pair of years of a value, strokes read as ones; the value if there is none."""
    found = F.trim(F.regexp_extract(_strokes(value), r"(?U)(\d{4}\s*[-/]?\s*(?:\d{2,4})?)", 1))
    return F.when(found == "", value).otherwise(found)


def value_of(field: Column, raw: Column) -> Column:
    """What a field's raw text says: trimmed, without misread words, and of figures, dates and years only these."""
    kind = lambda v: F.when(field.isin(*FIGURE_FIELDS), figure_of(v)).when(field.isin(*DATE_VALUES), date_of(v)).when(field == "record_year", year_of(v)).otherwise(v)
    return once(without_latin(trimmed(raw)), kind)


def candidates(lines: DataFrame) -> DataFrame:
    """(document_id, line_no, field_name, value, confidence, source) from lines (document_id, line_no, line, conf).

    A line without a confidence has 50. Equal lines of the same number count once.
    """
    cut = lines.select("document_id", "line_no", F.coalesce("conf", F.lit(50.0)).alias("conf"), F.explode(F.array(segments(F.col("line")))).alias("segments"))  # explode: as below
    pairs = label_values(cut)
    v = pairs.select("*", F.explode(F.array(value_of(F.col("field_name"), F.col("raw")))).alias("value"))  # explode: else filters repeat the whole expression
    good = v.filter((F.col("value") != "") & ~is_gibberish(F.col("field_name"), F.col("value")))
    return good.select("document_id", "line_no", "field_name", "value", score(F.col("key_score"), F.col("conf"), validity(F.col("field_name"), F.col("value"))).alias("confidence"), F.lit("rule").alias("source"))


def vocabulary_fields(texts: DataFrame) -> DataFrame:
    """Land class and ownership found anywhere in (document_id, text); to be used where no label gave them."""
    found = F.array(
        F.struct(F.lit("land_classification").alias("field_name"), first_term(F.col("text"), LAND_CLASSES).alias("value"), F.lit(62.0).alias("confidence")),
        F.struct(F.lit("ownership_type").alias("field_name"), first_term(F.col("text"), OWNERSHIP_TYPES).alias("value"), F.lit(60.0).alias("confidence")),
    )
    return texts.select("document_id", F.explode(found).alias("f")).filter("f.value is not null").select("document_id", F.lit(None).cast("int").alias("line_no"), "f.field_name", "f.value", "f.confidence", F.lit("ml").alias("source"))


def khasra_numbers(text: Column) -> Column:
    """Numbers of two to four Devanagari digits shortly before a bigha area, as ASCII, in order, once each; no years."""
    pattern = r"(?<![०-९0-9])([०-९]{2,4})(?![०-९0-9])[^०-९0-9\n]{1,10}?बीघा"
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), ascii_digits)
    return F.array_distinct(F.filter(found, lambda n: ~n.cast("int").between(1800, 2100)))


#: A word's edge, where vowel signs count as no part of a word.
_EDGE = r"(?:(?<=[\p{L}\p{N}_])(?![\p{L}\p{N}_])|(?<![\p{L}\p{N}_])(?=[\p{L}\p{N}_]))"


def _name(more: int) -> str:
    """A name of one Devanagari word and up to so many more, none of which ends names."""
    return rf"[ऀ-ॿ]+(?:\s+(?!(?:{'|'.join(NAME_STOPS)}){_EDGE})[ऀ-ॿ]+){{0,{more}}}"


def _tidy(name: Column) -> Column:
    return F.btrim(collapse(name), F.lit(" ,।-–—"))


def _is_name(name: Column) -> Column:
    return (F.length(name) >= 3) & F.coalesce(looks_like_person(name), F.lit(False))


def role_name(text: Column, roles: tuple[str, ...]) -> Column:
    """The first name of up to four words before a dash or colon and one of the roles, or null."""
    pattern = rf"(?iu)({_name(3)})\s*[-–—:]\s*(?:{'|'.join(roles)}){_EDGE}"
    return F.get(F.filter(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), _tidy), _is_name), F.lit(0))


def person_and_father(text: Column) -> Column:
    """struct(owner, father) of the first pair of names with a word for "son of" between them, or null; figures and units before the first go."""
    pattern = F.lit(rf"({_name(3)})\s+(?:{'|'.join(FATHER_MARKS)})\s+({_name(1)})")
    unit = rf"^(?:(?:{'|'.join(LEADING_UNITS)})(?:\s+|$))+"
    owner = lambda x: F.trim(F.regexp_replace(F.trim(F.element_at(F.split(_tidy(x), "[०-९0-9]+"), -1)), unit, ""))
    father = lambda x: F.trim(F.split(_tidy(x), "[|/,;।]")[0])
    pairs = F.zip_with(F.regexp_extract_all(text, pattern, F.lit(1)), F.regexp_extract_all(text, pattern, F.lit(2)), lambda a, b: F.struct(owner(a).alias("owner"), father(b).alias("father")))
    return F.get(F.filter(pairs, lambda p: _is_name(p["owner"]) & _is_name(p["father"])), F.lit(0))


def structural_fields(texts: DataFrame) -> DataFrame:
    """Fields that stand in patterns rather than after labels, from (document_id, text): names by role or relation, area, khasra list, state."""
    text = F.col("text")
    owner, both = role_name(text, OWNER_ROLES), person_and_father(text)
    bigha, biswa = (F.regexp_extract(text, r"([0-9०-९]+)\s*बीघा\s*([0-9०-९]+)?\s*(?:बिस्वा|बिस्वे)?", i) for i in (1, 2))
    area = F.when(bigha != "", F.concat_ws(" ", bigha, F.lit("बीघा"), F.when(biswa != "", F.concat(biswa, F.lit(" बिस्वा")))))
    numbers = khasra_numbers(text)
    khasra = F.when(F.size(numbers) == 1, numbers[0]).when(F.size(numbers) > 1, F.concat(numbers[0], F.lit("-"), F.element_at(numbers, -1)))
    state = F.coalesce(*[F.when(F.contains(F.upper(text), F.lit(word)) | F.contains(text, F.lit(word)), F.lit(name)) for word, name in STATE_MENTIONS])
    role = owner.isNotNull()
    kinds = (("owner_name", F.coalesce(owner, both["owner"]), F.when(role, 78.0).otherwise(82.0), F.when(role, "pattern-role").otherwise("pattern-relation")), ("possessor_name", role_name(text, CULTIVATOR_ROLES), 76.0, "pattern-role"), ("father_or_husband_name", both["father"], 78.0, "pattern-relation"))
    kinds += (("plot_area", area, 72.0, "pattern-area"), ("khasra_number", khasra, 74.0, "pattern-rowlist"), ("state", state, 90.0, "pattern-title"))
    found = F.array(*[F.struct(F.lit(n).alias("field_name"), v.alias("value"), (c if isinstance(c, Column) else F.lit(c)).alias("confidence"), (s if isinstance(s, Column) else F.lit(s)).alias("source")) for n, v, c, s in kinds])
    return texts.select("document_id", F.explode(found).alias("f")).filter("f.value is not null").select("document_id", F.lit(None).cast("int").alias("line_no"), "f.*")


def extracted(lines: DataFrame, texts: DataFrame) -> DataFrame:
    """One value per document and field: the best labelled candidate, else vocabulary, else a structural pattern."""
    labelled = argmax_per_key(candidates(lines), ["document_id", "field_name"], "confidence", ["line_no"])
    key = ["document_id", "field_name"]
    words = vocabulary_fields(texts).join(labelled, key, "left_anti")
    both = labelled.unionByName(words)
    return both.unionByName(structural_fields(texts).join(both, key, "left_anti"))


def agreement(primary: DataFrame, shadow: DataFrame) -> DataFrame:
    """document_id, field_name, state: agree, disagree, only_primary or only_shadow, by comparable values."""
    a = primary.select("document_id", "field_name", comparable(F.col("value")).alias("p"))
    b = shadow.select("document_id", "field_name", comparable(F.col("value")).alias("s"))
    state = F.when(F.col("s").isNull(), "only_primary").when(F.col("p").isNull(), "only_shadow").when(F.col("p") == F.col("s"), "agree").otherwise("disagree")
    return a.join(b, ["document_id", "field_name"], "full").select("document_id", "field_name", state.alias("state"))


def snapped(text: Column, column: str, cutoff: float = 68) -> Column:
    """The nearest legal term of a closed-vocabulary column, as struct(key, name, score)."""
    cleaned = F.trim(F.regexp_replace(F.regexp_replace(text, r"[^\wऀ-ॿ ]+", " "), r"\s+", " "))
    return best_match([(t, column) for t in VOCABULARIES[column]], cutoff)(F.when(F.length(cleaned) >= 2, cleaned))


def heading_column(text: Column) -> Column:
    """The table column that a heading names, by words first and by parts of it else."""
    terms = [(key, name) for name, keys in COLUMNS.items() for key in keys]
    t = F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[()\[\]/|.,:;]+", " "), r"\s+", " "))
    whole, part = best_match(terms, 72, "token_set_ratio"), best_match(terms, 85, "partial_ratio")
    t = F.when(F.length(t) >= 2, t)
    return F.coalesce(whole(t)["name"], part(t)["name"])


def numeric_score(column: Column, cleaned: Column) -> Column:
    """How well a cleaned figure fits its column's shape: parcel numbers, areas with decimals, other figures; 0 for none."""
    bare = F.replace(cleaned, F.lit("."), F.lit(""))
    number = F.when(cleaned.rlike(r"^\d{1,5}(/\d{1,4})*$"), 100.0).otherwise(20.0)
    area = F.when(cleaned.rlike(r"^\d+\.\d+$"), 100.0).when(bare.rlike(r"^\d+$"), 55.0).otherwise(20.0)
    other = F.when(cleaned.rlike(r"\p{Nd}"), 60.0).otherwise(10.0)
    return F.when(F.coalesce(cleaned, F.lit("")) == "", 0.0).when(column == "parcel_number", number).when(column == "area", area).otherwise(other)


def claimed_columns(found: DataFrame) -> DataFrame:
    """Greedy one-to-one assignment of (table_id, place, name, score), one name per place: the best place of each name.

    As a heading names one column at most, the greedy order by score is the argmax per name; equal scores go to the left.
    """
    return argmax_per_key(found.filter("name is not null"), ["table_id", "name"], "score", ["place"])


def synthesised_parcels(texts: DataFrame) -> DataFrame:
    """Parcels of (document_id, text) without a table: two or more numbers at the heads of rows give one parcel each, at 65."""
    numbers = texts.select("document_id", khasra_numbers(F.col("text")).alias("numbers")).filter(F.size("numbers") >= 2)
    return numbers.select("document_id", F.posexplode("numbers").alias("row_index", "parcel_number")).withColumn("confidence", F.lit(65.0))


def with_digits(readings: DataFrame) -> DataFrame:
    """readings without those of number fields that hold no digit."""
    return readings.filter(~F.col("field_name").isin(*DIGIT_ONLY) | F.coalesce(F.col("value").rlike(r"\p{Nd}"), F.lit(False)))


def identifies_parcels(columns: Column) -> Column:
    """Whether an array of column names holds one that tells parcels or owners; null counts as no columns."""
    return F.coalesce(F.arrays_overlap(columns, F.array(*map(F.lit, IDENTIFYING))), F.lit(False))


def blank_cell(ink: Column) -> Column:
    """Whether a table cell is blank, by its share of ink; a cell without an inside (null) is."""
    return F.coalesce(ink < BLANK_INK, F.lit(True))


def reread(field: Column, value: Column, confidence: Column, source: Column, again: Column, again_confidence: Column) -> Column:
    """value, confidence and source of a reading after a second one of its digits alone.

    The second one counts only in fields of digits and if it holds a digit itself. It is taken if clearly more confident,
    or if it has the field's shape and the first one hasn't.
    """
    shaped = lambda v: ~field.isin(*SHAPES) | F.coalesce(has_shape(field, v), F.lit(False))

    def better(new: Column, fits: Column) -> Column:
        taken = field.isin(*DIGIT_ONLY) & new.rlike(r"\p{Nd}") & ((again_confidence >= confidence + REREAD_GAIN) | (fits & ~shaped(value)))
        sure = F.round(F.least(F.lit(REREAD_TOP), F.when(fits, F.greatest(again_confidence, confidence)).otherwise(again_confidence)), 1)
        kept = F.struct(value.alias("value"), confidence.alias("confidence"), source.alias("source"))
        return F.when(taken, F.struct(new.alias("value"), sure.alias("confidence"), F.lit("rule+digits").alias("source"))).otherwise(kept)

    return once(trimmed(again), lambda new: once(shaped(new), lambda fits: better(new, fits)))


def agreement_summary(states: DataFrame) -> DataFrame:
    """Per document the counts of states (document_id, field_name, source, state) and the share that agrees, in percent; metadata doesn't count."""
    count = lambda s: F.count_if(F.coalesce("state", F.lit("only_primary")) == s).alias(s)
    per = states.filter(~F.col("source").eqNullSafe("metadata")).groupBy("document_id").agg(*map(count, ("agree", "disagree", "only_primary", "only_shadow")), F.count("*").alias("compared"))
    return per.withColumn("verification_rate", F.round(100 * F.col("agree") / F.col("compared"), 1))


def disagreements(states: DataFrame) -> DataFrame:
    """document_id, field, primary_value, shadow_value, shadow_source of each field whose two readings disagree; metadata doesn't count. One row each, so no document's are gathered."""
    some = states.filter(~F.col("source").eqNullSafe("metadata") & (F.col("state") == "disagree"))
    return some.select("document_id", F.col("field_name").alias("field"), F.col("value").alias("primary_value"), "shadow_value", "shadow_source")


#: Fixed value: lexicon texts from this length on are met by pieces at any place, as there are more places with so many edits than pieces in the other text.
LONG_TEXT = 128


def _edits(lengths: Column, cutoff: float) -> Column:
    """How many characters two texts of so many characters together may not share, for a ratio of cutoff."""
    return F.floor(lengths * ((100 - cutoff) / 100) + 1e-6).cast("int")


def _spans(read: DataFrame, seen: DataFrame, cutoff: float) -> DataFrame:
    """field_name, m, n, edits, pieces, size: for lengths of readings (m) and of the lexicon's texts (n) that allow the cutoff, the most edits between them and how texts of n characters are cut.

    Edits (single characters left out or put in) are even or odd as m - n is. Texts of n characters are cut into one piece more than any reading of m's parity may have edits.
    """
    m, n, odd = F.col("m"), F.col("n"), F.abs(F.col("m") - F.col("n")) % 2
    even = lambda most: most - (most + odd) % 2
    both = read.join(seen, "field_name").withColumn("edits", even(_edits(m + n, cutoff))).filter(F.col("edits") >= F.abs(m - n))
    most = F.greatest(F.lit(0), even(F.floor(n * (2 * (100 - cutoff) / cutoff) + 1e-6).cast("int")))
    return both.withColumn("pieces", most + 1).withColumn("size", F.floor(n / F.col("pieces")).cast("int"))


def _places(spans: DataFrame) -> DataFrame:
    """field_name, m, size, piece_no, start: where readings of m characters are looked at for pieces of the lexicon's texts.

    With fewer edits than pieces, one piece stands unchanged that has just as many edits before it as pieces: in front of the first at which fewer edits than pieces have come. With i edits before it, x of
    them put in, it is moved by 2 x - i. Pieces of long texts (piece_no -1) are looked for everywhere (start is null).
    """
    own = spans.filter(F.col("n") < LONG_TEXT).withColumn("piece_no", F.explode(F.sequence(F.lit(0), F.least("edits", F.col("pieces") - 1))))
    i, put_in, left_out = F.col("piece_no"), ((F.col("edits") + F.col("m") - F.col("n")) / 2).cast("int"), ((F.col("edits") - F.col("m") + F.col("n")) / 2).cast("int")
    low, high = F.greatest(F.lit(0), i - left_out), F.least(i, put_in)
    own = own.filter(low <= high).withColumn("x", F.explode(F.sequence(low, high))).withColumn("start", i * F.col("size") + 2 * F.col("x") - i)
    own = own.filter((F.col("start") >= 0) & (F.col("start") + F.col("size") <= F.col("m")))
    columns = ["field_name", "m", "size", "piece_no", "start"]
    return own.select(columns).unionByName(spans.filter((F.col("n") >= LONG_TEXT) & (F.col("size") <= F.col("m"))).select("field_name", "m", "size", F.lit(-1).alias("piece_no"), F.lit(None).cast("int").alias("start"))).distinct()


def _at(text: Column, start: Column, size: Column) -> Column:
    return F.substring(text, start + 1, size)


def near_readings(open_: DataFrame, latest: DataFrame, cutoff: float) -> DataFrame:
    """field_name, reading, seen, learned, id, s: the readings (field_name, reading) with all texts of the lexicon (field_name, seen, learned, id) of at least the cutoff's ratio s, and with some below it; a pair may come
    more than once. Callers filter by s after they have grouped, as a filter here would score each pair twice.

    Pairs meet by a piece of the lexicon's text at the places where a similar reading can have it (exact: no link goes). Of those, Spark's edit distance, which is no greater than the edits that a ratio
    counts, drops the rest before a pair is scored. Only the tables of lengths are broadcast.
    """
    from parcelry.functions.fuzzy import ratio

    read, lex = open_.withColumn("m", F.length("reading")), latest.filter("seen <> ''").withColumn("n", F.length("seen"))
    spans = _spans(read.select("field_name", "m").distinct(), lex.select("field_name", "n").distinct(), cutoff)
    size, start, long = F.col("size"), F.col("start"), F.col("piece_no") < 0
    anywhere = F.array_distinct(F.transform(F.sequence(F.lit(0), F.col("m") - size), lambda x: _at(F.col("reading"), x, size)))
    parts = read.join(F.broadcast(_places(spans)), ["field_name", "m"]).select("field_name", "reading", "piece_no", F.explode(F.when(long, anywhere).otherwise(F.array(_at(F.col("reading"), start, size)))).alias("piece"))
    cut = F.transform(F.sequence(F.lit(0), F.col("pieces") - 1), lambda i: F.struct(F.when(F.col("n") < LONG_TEXT, i).otherwise(F.lit(-1)).alias("piece_no"), _at(F.col("seen"), i * size, size).alias("piece")))
    cuts = lex.join(F.broadcast(spans.select("field_name", "n", "pieces", "size").distinct()), ["field_name", "n"])
    pieces = cuts.select("field_name", "seen", "learned", "id", F.explode(cut).alias("c")).select("field_name", "seen", "learned", "id", "c.*")
    met = parts.join(pieces.hint("merge"), ["field_name", "piece_no", "piece"])
    most = _edits(F.length("reading") + F.length("seen"), cutoff)
    met = met.filter((F.abs(F.length("reading") - F.length("seen")) <= most) & (F.levenshtein("reading", "seen") <= most))
    return met.select("field_name", "reading", "seen", "learned", "id", ratio("reading", "seen").alias("s"))


def corrected(values: DataFrame, lexicon: DataFrame, cutoff: float = 92) -> DataFrame:
    """values (field_name, value, ...) with learned: the reviewers' correction of an equal reading, else of a similar one.

    Equal readings meet in an equi-join; each distinct one of the rest meets the similar ones of the lexicon (near_readings). The lexicon is never broadcast, as its estimated size is no bound.
    """
    lex = lexicon.select(F.col("field_name"), F.lower(F.trim("ocr_value")).alias("seen"), "corrected_value", "id")
    latest = lex.groupBy("field_name", "seen").agg(F.max_by("corrected_value", "id").alias("learned"), F.max("id").alias("id"))
    v = values.withColumn("reading", F.lower(F.trim("value")))
    exact = v.join(latest.select("field_name", F.col("seen").alias("reading"), "learned").hint("merge"), ["field_name", "reading"], "left")
    open_ = exact.filter("learned is null and reading <> ''").select("field_name", "reading").distinct()
    best = near_readings(open_, latest, cutoff).groupBy("field_name", "reading").agg(F.max_by("learned", F.struct("s", -F.col("id"))).alias("near"), F.max("s").alias("s"))
    near = best.filter(F.col("s") >= cutoff).drop("s")
    return exact.join(near, ["field_name", "reading"], "left").withColumn("learned", F.coalesce("learned", "near")).drop("near", "reading")


def auto_accepted(failed_errors: Column, disagreements: Column, confidence: Column) -> Column:
    """auto_verified without failed errors and disagreements at 85 or more, else pending_review."""
    return F.when((failed_errors == 0) & (disagreements == 0) & (confidence >= AUTO_ACCEPT), "auto_verified").otherwise("pending_review")
