"""Records, parcels, places, exports and guarded rules on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from parcelry.functions import text as tx
from parcelry.functions.constants import RECORD_COLUMNS
from parcelry.operators import records as rec
from parcelry.operators import rules
from parcelry.sources.files import duplicates_in, export_rows, new_files, paged, uploads, write_csv
from parcelry.sources.stored import new_path

FIELD = "document_id int, field_name string, normalized_value string, corrected_value string, confidence double"
PARCEL = "document_id int, row_index int, parcel_number string, owner_name string, area_sqm double"


def test_records_take_corrections_then_parcels(spark):
    documents = spark.createDataFrame([(1, "UP", None), (2, "", "Agra"), (3, None, None)], "document_id int, state string, district string")
    fields = spark.createDataFrame(
        [
            (1, "state", "MP", None, 90.0), (1, "owner_name", "Ram", "Shyam", 10.0), (1, "owner_name", "Mohan", None, 99.0), (1, "village", "low", None, 20.0), (1, "village", "high", None, 30.0), (1, "plot_area", "2 ha", None, 50.0),
            (1, "pargana", "", None, 90.0), (1, "encumbrance", "bank", None, 90.0), (1, "unknown", "x", None, 1.0), (2, "state", "MP", None, None), (2, "district", "Else", None, 9.0), (2, "plot_area", "none", None, 9.0), (2, "total_area", "1 acre", "3 acre", 9.0),
            (2, "khasra_number", "", None, 9.0), (9, "state", "no document", None, 9.0),
        ],
        FIELD,
    )
    parcels = spark.createDataFrame([(1, 0, "5", "A", 10.0), (2, 2, "9", "B", 4.0), (2, 1, None, "B", None), (2, 0, "7", "", 6.005), (3, 0, "1", "A", 0.0), (3, 1, "1", "C", None)], PARCEL)
    got = {r.document_id: r for r in rec.records_of(documents, fields, parcels).collect()}
    one, two, three = got[1], got[2], got[3]
    assert len(got) == 3 and (one.state, one.owner_name, one.village, one.khasra_number) == ("UP", "Shyam", "high", "5")
    assert (one.plot_area_value, one.plot_area_unit, one.plot_area_sqm, one.extra) == (2.0, "ha", 20000.0, {"encumbrance": "bank"})
    assert (two.state, two.district, two.khasra_number, two.owner_name, two.plot_area_sqm, two.extra) == ("MP", "Agra", "7-9", "B", 12140.58, {"total_area": "3 acre"})
    assert (three.state, three.khasra_number, three.owner_name, three.plot_area_sqm, three.extra) == (None, "1-1", "2 owners", None, None)
    assert rec.records_of(documents.limit(0), fields, parcels).count() == 0


def test_parcels_inherit_units_and_corrections(spark):
    schema = "document_id int, row_index int, parcel_number string, area string, area_unit string, unit_hint string, crop string, remarks string, confidences map<string,double>"
    rows = [(1, 0, "1", "2", None, "ha", " Wheet", "ok", {"area": 90.0, "crop": 80.04, "share": 0.0}), (1, 1, "2", "2 acre", "x", "ha", None, "", {}), (1, 2, None, None, "biswa", None, "rice", None, {"a": 100.0}), (2, 0, "3", "2 zzz", None, None, "x", None, None)]
    lexicon = spark.createDataFrame([("crop", "wheet", "wheat", 1), ("crop", "rice", "dhan", 1), ("crop", "RICE ", "paddy", 5), ("remarks", "rice", "no", 9)], "field_name string, ocr_value string, corrected_value string, id int")
    got = {(r.document_id, r.row_index): r for r in rec.built_parcels(spark.createDataFrame(rows, schema), lexicon).collect()}
    a, b, c, d = (got[k] for k in ((1, 0), (1, 1), (1, 2), (2, 0)))
    assert (a.area_sqm, a.area_unit, a.crop, a.confidence, a.needs_review, a.field_confidences["crop"]) == (20000.0, "ha", "wheat", 85.0, False, 80.0)
    assert (b.area_sqm, b.area_unit, b.crop, b.confidence, b.needs_review) == (8093.72, "acre", None, 0.0, True)
    assert (c.area_value, c.area_unit, c.crop, c.confidence) == (None, "biswa", "paddy", 100.0)
    assert (d.area_value, d.area_unit, d.area_sqm, d.confidence) == (2.0, "zzz", None, 0.0)
    assert rec.built_parcels(spark.createDataFrame(rows, schema)).filter("crop = ' Wheet'").count() == 1


RECORD = "document_id int, state string, district string, tehsil string, village string, owner_name string, khasra_number string, plot_area_sqm double, is_verified boolean, created_at int"


def test_places_add_up_at_every_level(spark):
    records = spark.createDataFrame([(1, "S", "D", "T", "V", "A", "10", 100.0, True, 1), (2, "S", "D", "T", "v", None, "9", None, False, 2), (3, "S", "D", "U", "W", "B", "10", 50.0, False, 3), (4, None, None, None, None, "", "", None, None, 4)], RECORD)
    parcels = spark.createDataFrame([(1, 0, "11", "B", 7.0), (1, 1, "", "A", None), (3, 0, "10", None, 1.0), (99, 0, "5", "Z", 5.0)], PARCEL)
    partials = rec.place_partials(records, parcels)
    total = rec.village_totals(partials.filter(F.lower("village") == "v"), []).first()
    assert tuple(total) == (2, 2, 1, 1, 3, "10", "9", 107.0, 0.0107)
    by = {r.tehsil: (r.records, r.parcels, r.khasras, r.area_sqm) for r in rec.village_totals(partials, ["state", "district", "tehsil"]).collect() if r.tehsil}
    assert by == {"T": (2, 2, 3, 107.0), "U": (1, 1, 1, 51.0)}
    halves = rec.place_partials(records.filter("document_id < 2"), parcels).unionByName(rec.place_partials(records.filter("document_id >= 2"), parcels))
    key = lambda d: sorted(map(str, rec.village_totals(d, ["state"]).filter("state is not null").collect()))
    assert key(halves) == key(partials)
    assert [tuple(r) for r in rec.village_owners(partials, 2).collect()] == [("A", 2, 100.0), ("B", 2, 57.0)]
    assert rec.village_totals(partials.limit(0), []).first().records == 0


def test_suggestions_by_jurisdiction(spark):
    rows = [("S1", "D1", "T1", "V1", "a", 1), ("S1", "D1", "T2", "V2", "b", 5), ("S1", "D2", "T3", "V3", "c", 9), ("S2", "D3", "T4", "V4", "", 7), ("S2", "D3", "T4", "V5", None, 8)]
    records = spark.createDataFrame(rows, "state string, district string, tehsil string, village string, owner_name string, created_at int")
    partials = rec.suggestion_partials(records, ("state", "district", "tehsil", "village", "owner_name"))

    def of(**place):
        out = {}
        for r in sorted(rec.suggestions(partials, **place).collect(), key=lambda r: r.place):
            out.setdefault(r.field, []).append(r.value)
        return out

    assert of()["state"] == ["S1", "S2"] and of()["owner_name"] == ["c", "b", "a"] and of(limit=1)["village"] == ["V3"]
    got = of(state="S1", district="D1", tehsil="T2")
    assert got == {"state": ["S1", "S2"], "district": ["D2", "D1"], "tehsil": ["T2", "T1"], "village": ["V2"], "owner_name": ["b", "a"]}


def test_export_has_all_columns(spark, tmp_path):
    records = spark.createDataFrame([(1, "a,b", None, True), (2, "x", "D", False), (3, None, "", True)], "id int, state string, district string, is_verified boolean")
    rows = export_rows(records).collect()
    assert export_rows(records).columns == list(RECORD_COLUMNS) and len(rows) == 2 and all(v is not None for r in rows for v in r)
    write_csv(records, str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.columns == list(RECORD_COLUMNS) and {r.state for r in back.collect()} == {"a,b", None}
    assert export_rows(records, state="a,b").count() == 1


def test_pages_as_text(spark):
    df = spark.createDataFrame([(i, None if i % 2 else "x") for i in range(7)], "id int, v string")
    page = lambda n, size: json.loads(paged(df, [("id", False)], n, size).first().page)
    assert page(2, 3) == {"items": [{"id": 3, "v": None}, {"id": 2, "v": "x"}, {"id": 1, "v": None}], "total": 7, "page": 2, "size": 3}
    assert page(9, 3) == {"items": [], "total": 7, "page": 9, "size": 3} and page(0, 0)["size"] == 1


def test_uploads_have_limits(spark, tmp_path):
    for k, n in (("few", 3), ("many", 21)):
        (tmp_path / k).mkdir()
        for i in range(n):
            (tmp_path / k / f"{i}.pdf").write_bytes(b"%d" % (i % 20))
    found = uploads(spark, str(tmp_path))
    assert {r.refused for r in found.filter("path like '%/many/%'").collect()} == {"too many files"} and found.filter("refused is null").count() == 3
    every = uploads(spark, str(tmp_path), most=None)
    assert every.filter("refused is null").count() == 24
    catalog = spark.createDataFrame([(r.sha256, 40 + i) for i, r in enumerate(every.filter("path like '%/few/%'").collect())], "sha256 string, document_id int")
    assert new_files(every, catalog).count() == 17 and new_files(every, catalog, allow_duplicate=True).count() == 24
    assert duplicates_in(found, catalog).count() == 3


def test_missing_packs(spark):
    df = spark.createDataFrame([(["hi", "", "zz", "hi", "en", None],), ([],)], "c array<string>")
    assert [r.m for r in df.select(tx.missing_packs(F.col("c"), ("eng", "mar")).alias("m")).collect()] == [["hin", "zz", "hin"], []]


def test_a_rule_that_raises_in_a_task_leaves_the_others(spark):
    records = spark.createDataFrame([(1,), (2,)], "document_id int")
    kept = dict(rules.RULES)
    rules.RULES.clear()
    try:
        rules.rule("A1", "records")(lambda r: rules.outcome(r, "A1", F.lit(True), "info", None, "fine"))
        rules.rule("A2", "records")(lambda r: rules.outcome(r, "A2", F.when(F.col("document_id") == 2, F.raise_error(F.lit("broken rule"))).otherwise(F.lit(True)), "info", None, "x"))
        rules.rule("A3", "records")(lambda r: rules.outcome(r.filter("nothing = 1"), "A3", F.lit(True), "info", None, "x"))
        path = new_path(spark, "rules")
        for _ in range(2):
            got = sorted((r.rule_id, r.document_id, r.passed, r.severity, (r.message or "")[:13]) for r in rules.validate_to(path, records=records).collect())
            assert got == [("A1", 1, True, "info", "fine"), ("A1", 2, True, "info", "fine"), *((a, d, False, "warning", "Rule crashed:") for a in ("A2", "A3") for d in (1, 2))]
        with pytest.raises(Exception):  # noqa: B017
            rules.validate(records=records).collect()
    finally:
        rules.RULES.clear()
        rules.RULES.update(kept)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_totals_sort_no_partials(spark):
    """The lowest and highest text come from the different numbers; before, all rows of a task were sorted for them, once a level."""
    records = spark.createDataFrame([(i, "S", "D", "T", "V", "A", str(i % 7), 1.0, True, 1) for i in range(50)], RECORD)
    path = new_path(spark, "partials")
    rec.place_partials(records, spark.createDataFrame([(1, 0, "x9", "B", 7.0), (99, 0, "y", "B", 7.0)], PARCEL), 3).write.parquet(path)
    held = spark.read.parquet(path)
    numbers = rec.different_numbers(held, ["state", "district"], 3)
    for by in ([], ["state"], ["state", "district"]):
        got = rec.village_totals(held, by, numbers)
        assert tuple(got.first())[len(by) :] == (50, 1, 50, 0, 8, "0", "x9", 57.0, 0.0057)
        assert "Sort [state" not in _plan(got).split("HashAggregate")[-1] and _plan(got).count("min(number") == _plan(got).count("max(number")
        assert not any("sum(" in line and "min(number" in line for line in _plan(got).splitlines())


def test_parcels_are_not_gathered_for_corrections(spark, tmp_path):
    """Each different reading is looked up once; before, all cells were shuffled by reading and by row, and rows of equal place took each other's correction."""
    path = str(tmp_path / "rows")
    spark.createDataFrame([(i % 3, 0, None, None, None, None, c, None, {}) for i, c in enumerate(["grm", "rice", None, "", "grm "])], "document_id int, row_index int, parcel_number string, area string, area_unit string, unit_hint string, crop string, remarks string, confidences map<string,double>").write.parquet(path)
    lexicon = spark.createDataFrame([("crop", "grm", "gram", 1)], "field_name string, ocr_value string, corrected_value string, id int")
    got = rec.built_parcels(spark.read.parquet(path), lexicon)
    assert sorted(str(r.crop) for r in got.collect()) == ["", "None", "gram", "gram", "rice"]
    assert "Exchange hashpartitioning" not in _plan(got)


def test_records_compare_readings_once(spark):
    """One comparison for each column and parcels grouped by owner; before, every column kept a second copy of its value, parcels passed a distinct count and areas were read inside a lambda for each row."""
    documents = spark.createDataFrame([(i, None, None) for i in range(1, 7)], "document_id int, state string, district string")
    read = [(1, "plot_area", "\t२,5 ha", None, None), (1, "total_area", "9 ha", None, 9.0), (2, "plot_area", ",5 ha", None, 9.0), (2, "total_area", "1 ha", None, 9.0), (3, "plot_area", "x", None, 9.0), (3, "total_area", "", None, 9.0), (4, "village", None, None, 95.0), (4, "village", "less sure", None, 9.0), (5, "village", "b", None, 9.0), (5, "village", "a", None, 9.0), (5, "village", "", "", 1.0)]
    fields = spark.createDataFrame(read, FIELD)
    parcels = spark.createDataFrame([(2, 0, "", None, 5.0), (3, 0, "8", "A", 1.0), (3, 1, "8", None, 1.0), (3, 1, "9", "A", 0.5), (6, 0, None, "", None)], PARCEL)
    df = rec.records_of(documents, fields, parcels)
    got = {r.document_id: r for r in df.collect()}
    assert [got[i].plot_area_sqm for i in range(1, 7)] == [25000.0, 10000.0, 2.5, None, None, None] and [got[i].village for i in (4, 5)] == [None, ""]
    assert (got[3].khasra_number, got[3].owner_name, got[2].khasra_number, got[6].owner_name) == ("8-9", "A", None, None)
    plan = _plan(df)
    assert "max_by(" not in plan and "merge_count" not in plan and "transform(" not in plan
