"""Text normalisation as Column expressions (all inside whole-stage code generation)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from parcelry.functions.constants import ASCII_DIGITS, DATE_FIELDS, DEVANAGARI_DIGITS, DOC_TYPES, NAME_FIELDS, NORMALISED_NAMES, NUMBER_FIELDS, SHAPES, UPLOAD_KINDS, VOCABULARIES


def once(value: Column, use) -> Column:
    """use(value), where value is computed once however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def ascii_digits(c: Column) -> Column:
    """Devanagari digits as ASCII digits."""
    return F.translate(c, DEVANAGARI_DIGITS, ASCII_DIGITS)


def normalize_number(c: Column) -> Column:
    """A number as read from a scan: digits unified, white space dropped, strokes and rings read as figures; '' is null."""
    squeezed = F.regexp_replace(ascii_digits(c), r"\s+", "")
    return blank_to_null(F.btrim(F.translate(squeezed, "\\|OolIS", "//00115"), F.lit("./-")))


def clean_parcel_number(c: Column) -> Column:
    """Figures and single slashes of a parcel number; null if nothing is left."""
    kept = F.regexp_replace(F.translate(ascii_digits(c), "lI|Oo", "11100"), "[^0-9/]", "")
    return blank_to_null(F.btrim(F.regexp_replace(kept, "/{2,}", "/"), F.lit("/")))


_UNIT_AT_END = r"(?i)(हे|हेक्टेयर|एकड़|बीघा|बिस्वा|गुंठा|ha|acre|bigha|biswa|guntha)\.?\s*$"


def clean_area(c: Column) -> Column:
    """The figure of an area cell with one decimal point, followed by its unit word if it ends with one."""
    s = ascii_digits(c)
    unit = F.regexp_extract(s, _UNIT_AT_END, 1)
    figure = F.translate(F.regexp_replace(s, _UNIT_AT_END, ""), "lI|fOoS,", "1111005.")
    figure = F.regexp_replace(F.regexp_replace(figure, "[^0-9.]", ""), r"\.{2,}", ".")
    figure = F.btrim(figure, F.lit("."))
    head, tail = F.substring_index(figure, ".", 1), F.regexp_replace(figure, r"^[0-9]*\.?", "")
    one_point = F.when(F.length(figure) > F.length(head), F.concat(head, F.lit("."), F.replace(tail, F.lit("."), F.lit("")))).otherwise(figure)
    return F.when(figure != "", F.when(unit != "", F.concat(one_point, F.lit(" "), unit)).otherwise(one_point))


def collapse(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+", " ")


def name_without_title(c: Column) -> Column:
    """White space collapsed, edge punctuation off, one leading honorific dropped; case stays."""
    s = F.btrim(collapse(c), F.lit(" .,:;-"))
    return F.regexp_replace(s, r"(?i)^(shri|smt|sri|श्री|श्रीमती)\.?\s+", "")


def ascii_title(c: Column) -> Column:
    """str.title for ASCII text without leaving the JVM: a letter after a non-letter is upper case, all others lower."""
    letters = F.split(F.lower(c), "")
    at = F.transform(letters, lambda ch, i: F.when((i == 0) | ~F.get(letters, i - 1).rlike("[a-z]"), F.upper(ch)).otherwise(ch))
    return F.when(c.rlike(r"^[\x00-\x7f]*$"), F.array_join(at, "")).otherwise(c)


def normalize_name(c: Column) -> Column:
    """A person's or place's name; null for null or empty text."""
    return F.when(c != "", ascii_title(name_without_title(c)))


def normalize_field(field: Column, value: Column) -> Column:
    """The normaliser that the field's kind asks for.

    An area prints its value and unit as they are, so one without a unit ends in "None" (kept for compatibility).
    """
    from parcelry.functions.area import parse_area
    from parcelry.functions.dates import parse_date

    area = parse_area(value)
    shown = F.concat_ws(" ", python_float(area["value"]), F.coalesce(area["unit"], F.lit("None")))
    return (
        F.when(field.isin(*NUMBER_FIELDS), normalize_number(value))
        .when(field.isin(*DATE_FIELDS), parse_date(value))
        .when(field.isin(*NORMALISED_NAMES), normalize_name(value))
        .when(field == "plot_area", F.when(area["value"].isNotNull(), shown).otherwise(value))
        .when(field == "record_year", ascii_digits(value))
        .otherwise(F.trim(value))
    )


def python_float(c: Column) -> Column:
    """A double below 10 million as text without an exponent, with at least one decimal."""
    return c.cast("string")


def comparable(c: Column) -> Column:
    """For comparing readings: digits unified, lower case, letters, digits and single spaces only (vowel signs drop)."""
    kept = F.regexp_replace(F.lower(ascii_digits(c)), r"[^\p{L}\p{N}\s]", "")
    return F.trim(collapse(kept))


def doc_type(text: Column) -> Column:
    """The first type, in order, one of whose keywords the text contains."""
    t = F.lower(text)
    found = None
    for name, keys in DOC_TYPES:
        hit = reduce(lambda a, b: a | b, [F.contains(t, F.lit(k)) for k in keys])
        found = F.when(hit, F.lit(name)) if found is None else found.when(hit, F.lit(name))
    return found.otherwise(F.lit("unknown"))


def first_term(text: Column, terms: tuple[str, ...]) -> Column:
    """The first of the terms that the text contains, or null."""
    t = F.lower(text)
    return F.coalesce(*[F.when(F.contains(t, F.lit(v)), F.lit(v)) for v in terms])


def has_shape(field: Column, value: Column) -> Column:
    """Whether the value has its field's shape; null for a field without one."""
    v = ascii_digits(value)
    found = None
    for name, pattern in SHAPES.items():
        found = F.when(field == name, v.rlike(pattern)) if found is None else found.when(field == name, v.rlike(pattern))
    return found


def is_gibberish(field: Column, value: Column) -> Column:
    """Three or more ASCII signs in a short value, or a name without Devanagari and without a plausible Latin word."""
    sign = "[!\"#$%&'()*+,;<=>?@\\[\\\\\\]^_`{}~“”‘’„«»]"
    word = value.rlike("[\\u0900-\\u097F]") | value.rlike(r"\b([A-Z][a-z]{2,}|[a-z]{3,})\b")
    return ((F.length(value) < 24) & value.rlike(f"(?s){sign}.*{sign}.*{sign}")) | (field.isin(*NAME_FIELDS) & ~word)


def looks_like_person(name: Column) -> Column:
    """No digit, no vocabulary term, and a token of two characters or more."""
    s = F.trim(name)
    terms = sorted({t.lower() for ts in VOCABULARIES.values() for t in ts})
    return (s != "") & ~s.rlike(r"\p{Nd}") & ~F.lower(s).isin(*terms) & s.rlike(r"\S\S")


def is_identifier(c: Column) -> Column:
    """Letters and digits with '/' or '-', at least one digit."""
    core = F.regexp_replace(c, "[/-]", "")
    return core.rlike(r"^[\p{L}\p{N}]+$") & core.rlike(r"\p{Nd}")


def squeezed(c: Column) -> Column:
    """A text's words with one space between them."""
    return F.btrim(F.regexp_replace(c, r"(?U)\s+", " "))


def word_count(c: Column) -> Column:
    """The number of words of a text with one space between them."""
    return F.when(c == "", 0).otherwise(F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit(""))) + 1)


def label_candidate(c: Column) -> Column:
    """Whether a fragment can be a label: two characters, and if Latin only then four letters and a vowel."""
    s = F.btrim(F.lower(F.trim(c)), F.lit(".:()"))
    latin = ~s.rlike("[\\u0900-\\u097F]")
    letters = F.length(F.regexp_replace(s, r"[^\p{L}]", ""))
    return (F.length(s) >= 2) & ~(latin & ((letters < 4) | ~s.rlike("[aeiou]")))


def has_content(values: Column) -> Column:
    """Whether any value of a row has a word character or a Devanagari one."""
    return F.exists(values, lambda v: F.coalesce(v.rlike("[\\w\\u0900-\\u097F]"), F.lit(False)))


def snippet(text: Column, query: str, reach: int = 60) -> Column:
    """The text around the first hit, ignoring case; its beginning if there is none."""
    at = F.locate(query.lower(), F.lower(text))
    start = F.greatest(at - reach, F.lit(1))
    end = at + len(query) + reach
    return F.when(at > 0, F.substring(text, start, end - start)).otherwise(F.substring(text, 1, 2 * reach))


def safe_extension(name: Column, allowed: tuple[str, ...] = UPLOAD_KINDS) -> Column:
    """The lower-cased extension if it is allowed, else '.bin'."""
    ext = F.lower(F.regexp_extract(name, r"(\.[A-Za-z0-9]+)$", 1))
    return F.when(ext.isin(*["." + a for a in allowed]), ext).otherwise(F.lit(".bin"))


def safe_filename(name: Column) -> Column:
    """The last part of a path, at most 256 characters; 'document' if there is none."""
    base = F.left(F.regexp_extract(name, r"([^/\\]*)$", 1), F.lit(256))
    return F.coalesce(blank_to_null(base), F.lit("document"))


def _packs(codes: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in (("en", "eng"), ("hi", "hin"), ("mr", "mar"), ("ne", "nep"), ("sa", "san")) for x in kv])
    return F.transform(codes, lambda c: F.coalesce(F.try_element_at(names, c), c))


def language_packs(codes: Column, installed: tuple[str, ...]) -> Column:
    """Codes as packs, those installed, with eng last; repeats keep their first place."""
    here = F.array_distinct(F.array_intersect(_packs(codes), F.array(*map(F.lit, installed))))
    return F.array_distinct(F.concat(here, F.array(F.lit("eng"))))


def missing_packs(codes: Column, installed: tuple[str, ...]) -> Column:
    """The packs asked for that aren't installed, in order, repeats and all; blanks don't count."""
    return F.filter(_packs(codes), lambda p: F.coalesce((p != "") & ~p.isin(*installed), F.lit(False)))


def language_orderings(packs: Column) -> Column:
    """[packs] if there is one, else [packs, reversed packs], each joined by '+'."""
    joined = F.array_join(packs, "+")
    return F.when(F.size(packs) < 2, F.array(joined)).otherwise(F.array(joined, F.array_join(F.reverse(packs), "+")))
