"""Scalar functions against values derived by hand."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parcelry.functions import fuzzy
from parcelry.functions import text as tx
from parcelry.functions.area import compound_area_sqm, parse_area, stated_area_sqm, unit_from_header
from parcelry.functions.dates import is_iso_like, parse_date, plausible_years, years_in


def values(spark, make, inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r.v for r in df.select("i", make(F.col("x")).alias("v")).orderBy("i").collect()]


def test_parse_area(spark):
    got = values(spark, parse_area, ["2.50 ha", "2 bigha 5 biswa", "0.0800", "5 foo", "abc", "१२ एकड़", "3,5 sq.m", "", None])
    assert [tuple(g) for g in got] == [(2.5, "ha", 25000.0), (2.0, "bigha", 5058.0), (0.08, None, None), (5.0, "foo", None), (None, None, None), (12.0, "एकड़", 48562.32), (3.5, "sq.m", 3.5), (None, None, None), (None, None, None)]


def test_compound_and_stated_areas(spark):
    assert values(spark, compound_area_sqm, ["2 bigha 5 biswa", "1 acre", "x"]) == [5690.25, 4046.86, None]
    assert values(spark, stated_area_sqm, ["0.61", "2 acre"]) == [6100.0, 8093.72]


def test_parse_date(spark):
    got = values(spark, parse_date, ["12/03/2019", "21-11-2018", "1/2/20", "31/02/2020", "x", "12/03/75", "12/03/68", "12.08.1987", "", None])
    assert got == ["2019-03-12", "2018-11-21", "2020-02-01", "31/02/2020", "x", "1975-03-12", "2068-03-12", "1987-08-12", None, None]


def test_numbers(spark):
    assert values(spark, tx.normalize_number, ["I2O/S", " १२ ३ ", "./-", "", None]) == ["120/5", "123", None, None, None]
    assert values(spark, tx.clean_parcel_number, ["I45", "/43", "1//2/", "abc", None]) == ["145", "43", "1/2", None, None]
    assert values(spark, tx.clean_area, ["0.I500", "0.4f00", "1.2.3", "0,25 ha.", "x", None]) == ["0.1500", "0.4100", "1.23", "0.25 ha", None, None]


def test_names(spark):
    assert values(spark, tx.normalize_name, ["Shri  ram-lal", "smt. SITA devi,", "o'neil s.k", "श्री राम", "", None]) == ["Ram-Lal", "Sita Devi", "O'Neil S.K", "राम", None, None]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(alphabet="abcXYZ'-. 9#", max_size=20), min_size=1, max_size=20))
def test_title_case_equals_python(spark, words):
    assert values(spark, tx.ascii_title, words) == [w.title() for w in words]


def test_field_dispatch_keeps_unitless_areas_as_they_are(spark):
    df = spark.createDataFrame([("plot_area", "2.5"), ("plot_area", "2 HA"), ("khasra_number", "I2"), ("record_year", "१४३०"), ("note", " x ")], "f string, v string")
    assert [r.r for r in df.select(tx.normalize_field(F.col("f"), F.col("v")).alias("r")).collect()] == ["2.5 None", "2.0 ha", "12", "1430", "x"]


def test_shapes(spark):
    assert values(spark, tx.is_identifier, ["12/4", "45-A", "abc", "1 2", "/"]) == [True, True, False, False, False]
    assert values(spark, tx.looks_like_person, ["राम लाल", "कृषि", "a b", "Ram 2", ""]) == [True, False, False, False, False]
    assert values(spark, lambda c: tx.is_gibberish(F.lit("village"), c), ["TAX, TOIT", "Meerut", "सदर", "a!!!b"]) == [True, False, False, True]
    assert values(spark, tx.label_candidate, ["TA T", "owner", "xyzq", "नाम"]) == [False, True, False, True]
    assert values(spark, tx.doc_type, ["Sale of khasra", "Khatauni 7", "survey", ""]) == ["sale_deed", "ror", "khasra", "unknown"]
    assert values(spark, unit_from_header, ["रकबा (हे./बीघा)", "area biswa", "none of it"]) == ["ha", "biswa", None]
    assert values(spark, is_iso_like, ["2019-03-12", "12.03.2019", "1"]) == [True, False, False]
    assert values(spark, years_in, ["1187 and २०२०", "abcd"]) == [[1187, 2020], []]
    assert values(spark, lambda c: plausible_years(c, 2024), ["1187", "2025", "abcd", "1900, 2024"]) == [False, False, False, True]


def test_snippets_and_files(spark):
    long = "x" * 100 + "KEY" + "y" * 100
    assert values(spark, lambda c: tx.snippet(c, "key", 5), [long, "none"]) == ["xxxxxKEYyyyyy", "none"]
    assert values(spark, tx.safe_extension, ["a/b.PDF", "x.exe", "noext"]) == [".pdf", ".bin", ".bin"]
    assert values(spark, tx.safe_filename, ["a/b.pdf", "a/", "c:\\d\\e.png"]) == ["b.pdf", "document", "e.png"]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
        row = new
    return row[-1]


def test_similarity_against_the_plain_table():
    r = random.Random(4)
    for _ in range(500):
        a, b = ("".join(r.choice("abcदी ") for _ in range(r.randint(0, 12))) for _ in range(2))
        assert fuzzy.common(a, b) == lcs(a, b)
    assert round(fuzzy.ratio_of("abc", "abd"), 2) == 66.67
    assert fuzzy.token_set_ratio_of("ram lal", "lal ram kumar") == 100.0
    assert fuzzy.token_set_ratio_of("", "ram") == 0.0
    assert fuzzy.partial_ratio_of("ram", "xx ram yy") == 100.0


@pytest.mark.parametrize("cutoff", [68, 85, 92])
def test_length_band_loses_nothing(cutoff):
    r = random.Random(cutoff)
    for _ in range(500):
        a, b = ("".join(r.choice("ab") for _ in range(r.randint(1, 30))) for _ in range(2))
        if fuzzy.ratio_of(a, b) >= cutoff:
            assert min(len(a), len(b)) >= max(len(a), len(b)) * cutoff / (200 - cutoff) - 1e-9
