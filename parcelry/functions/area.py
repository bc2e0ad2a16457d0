"""Areas: parsing, units, formatting."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from parcelry.functions.constants import AREA_UNITS_SQM, HEADER_UNITS
from parcelry.functions.text import ascii_digits, blank_to_null

_AREA = r"^\s*([0-9]+(?:\.[0-9]+)?)\s*([a-zA-Zऀ-ॿ. ]*)"
#: The longest known unit that a text begins with.
_UNIT = f"^({'|'.join(map(re.escape, sorted(AREA_UNITS_SQM, key=len, reverse=True)))})"


def parse_area(c: Column) -> Column:
    """struct(value, unit, sqm) of text like '2.50 ha'.

    The unit is the longest known one that the unit text begins with; unknown unit text stays and gives no sqm. Without a
    leading number all three are null. Of a compound area only the first figure counts.
    """
    s = F.replace(F.lower(ascii_digits(c)), F.lit(","), F.lit("."))
    value = blank_to_null(F.regexp_extract(s, _AREA, 1)).cast("double")
    text = F.trim(F.btrim(F.regexp_extract(s, _AREA, 2), F.lit(". ")))
    unit = blank_to_null(F.regexp_extract(text, _UNIT, 1))  # one look at the text: a condition per unit would read it again for each
    factor = F.try_element_at(F.create_map(*[F.lit(x) for kv in AREA_UNITS_SQM.items() for x in (kv[0], float(kv[1]))]), unit)
    known = F.coalesce(unit, blank_to_null(text))
    return F.struct(value.alias("value"), F.when(value.isNotNull(), known).alias("unit"), F.round(value * factor, 2).alias("sqm"))


def has_figure(c: Column) -> Column:
    """Whether parse_area reads a value."""
    return ascii_digits(c).rlike(r"^\s*[0-9]")


def compound_area_sqm(c: Column) -> Column:
    """The corrected reading of compound areas: all figures with known units added up, in square metres.

    Unlike parse_area, which stays as it is for compatibility, '2 bigha 5 biswa' counts both parts.
    """
    s = F.replace(F.lower(ascii_digits(c)), F.lit(","), F.lit("."))
    parts = F.regexp_extract_all(s, F.lit(r"[0-9]+(?:\.[0-9]+)?\s*[a-zऀ-ॿ.]+"), F.lit(0))
    sqm = F.filter(F.transform(parts, lambda p: parse_area(p)["sqm"]), lambda x: x.isNotNull())
    return F.when(F.size(sqm) > 0, F.round(F.aggregate(sqm, F.lit(0.0), lambda a, x: a + x), 2))


def unit_from_header(header: Column) -> Column:
    """The unit whose word comes first in a column heading; of words at the same place, the first in the list."""
    low = F.lower(header)
    places = [F.when(F.locate(word, low) > 0, F.struct(F.locate(word, low).alias("at"), F.lit(i).alias("i"), F.lit(unit).alias("unit"))) for i, (word, unit) in enumerate(HEADER_UNITS)]
    return F.array_min(F.array_compact(F.array(*places)))["unit"]


def shown_area(sqm: Column) -> Column:
    """From 10,000 square metres on in hectares with three decimals, else in whole square metres."""
    return F.when(sqm >= 10000, F.format_string("%.3f ha", sqm / 10000)).otherwise(F.format_string("%.0f m2", sqm))


def stated_area_sqm(c: Column) -> Column:
    """A stated total in square metres; a figure without letters is in hectares."""
    bare = ~c.rlike(r"[\p{L}]")
    return F.when(bare, F.round(parse_area(c)["value"] * 10000, 2)).otherwise(parse_area(c)["sqm"])
