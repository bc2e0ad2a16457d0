"""Dates as ISO text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parcelry.functions.text import ascii_digits


def _read(s: Column, shape: str, pattern: str, short_year: bool = False) -> Column:
    got = F.to_date(F.when(s.rlike(shape), F.try_to_timestamp(s, F.lit(pattern))))
    if short_year:  # two-digit years up to 68 are 20xx, from 69 on 19xx
        got = F.when(F.year(got) > 2068, F.add_months(got, -1200)).otherwise(got)
    return got


def parse_date(c: Column) -> Column:
    """The ISO date of d/m/Y, d-m-Y, d.m.Y, d/m/y, d-m-y or Y-m-d text; other text stays, empty text is null."""
    s = F.trim(ascii_digits(c))
    found = F.coalesce(
        _read(s, r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"), _read(s, r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"), _read(s, r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.yyyy"),
        _read(s, r"^\d{1,2}/\d{1,2}/\d{2}$", "d/M/yy", True), _read(s, r"^\d{1,2}-\d{1,2}-\d{2}$", "d-M-yy", True), _read(s, r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    )
    return F.when(c != "", F.coalesce(F.date_format(found, "yyyy-MM-dd"), s))


def is_iso_like(c: Column) -> Column:
    """Ten characters that begin with a century."""
    return (F.length(c) == 10) & F.substring(c, 1, 2).isin("18", "19", "20")


def years_in(c: Column) -> Column:
    """All four-digit numbers of a text, as ints, in order."""
    found = F.regexp_extract_all(ascii_digits(c), F.lit(r"\b([0-9]{4})\b"), F.lit(1))
    return F.transform(found, lambda y: y.cast("int"))


def plausible_years(c: Column, this_year: int, first_year: int = 1850) -> Column:
    """Whether a text has a year and all its years lie between first_year and this_year."""
    years = years_in(c)
    return (F.size(years) > 0) & F.forall(years, lambda y: y.between(first_year, this_year))
