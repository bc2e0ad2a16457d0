"""Operators on small tables."""

import pytest
from pyspark.sql import functions as F

from parcelry.operators import extraction as ex
from parcelry.operators import rules, verify
from parcelry.operators import sequences as seq
from parcelry.operators.aggregates import recent_values
from parcelry.operators.relational import changes, page, scoped
from parcelry.sources.files import json_page, new_files, uploads

RECORD = "document_id int, owner_name string, village string, khasra_number string, survey_number string, khata_number string, plot_area_sqm double, stated_sqm double, mutation_date string, registration_date string, irrigated_sqm double, unirrigated_sqm double"
PARCEL = "document_id int, owner_name string, parcel_number string, area_sqm double"


def outcomes(df):
    return {(r.document_id, r.field_name, r.severity): r.passed for r in df.collect()}


def test_rules(spark):
    records = spark.createDataFrame(
        [
            (1, "Ram", "Rampur", "12/4", None, None, 25000.0, 6200.0, "2020-01-02", "2019-01-01", 3500.0, 2600.0),
            (2, None, "", None, None, "", None, None, "x", "2019-01-01", None, None),
        ],
        RECORD,
    )
    parcels = spark.createDataFrame([(1, "A", "143", 3000.0), (1, "B", "144", 3100.0), (2, "C", None, None), (2, "", "a1", None), (2, "D", "a1", None)], PARCEL)
    assert outcomes(rules.mandatory_fields(records, parcels)) == {(1, "owner_name", "error"): True, (1, "village", "error"): True, (1, None, "error"): True, (2, "owner_name", "error"): False, (2, "village", "error"): False, (2, None, "error"): False}
    assert outcomes(rules.area_range(records, parcels)) == {(1, "plot_area", "info"): True, (2, "plot_area", "warning"): False}
    assert outcomes(rules.parcel_area_total(records, parcels)) == {(1, "area", "warning"): True, (2, "area", "warning"): False}
    assert sorted((r.document_id, r.severity, r.passed, r.field_name, r.message) for r in rules.parcel_identifiers(records, parcels).collect()) == [
        (1, "error", True, "parcel_number", "Every parcel row has a number"), (1, "error", True, "parcel_number", "Parcel numbers are unique"), (1, "warning", True, "parcel_number", "Parcel numbers are well formed"),
        (2, "error", False, "parcel_number", "Duplicate parcel numbers on this sheet: a1"), (2, "error", False, "parcel_number", "Parcel rows without a number: 1"), (2, "warning", False, "parcel_number", "Parcel numbers with unexpected characters: a1"),
    ]
    assert outcomes(rules.irrigation_split(records, parcels)) == {(1, "irrigated_area", "warning"): True}
    fields = spark.createDataFrame([(1, "mutation_date", "2020-01-02", 50.0), (1, "record_year", None, 90.0), (2, "record_date", "", 99.0), (2, "mutation_date", "1187", 99.0), (2, "registration_date", "abcd", 99.0)], "document_id int, field_name string, value string, confidence double")
    assert outcomes(rules.plausible_dates(fields, 2024)) == {(1, "mutation_date", "warning"): True, (2, "mutation_date", "warning"): False, (2, "registration_date", "warning"): False}
    hashes = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x"), (4, None), (5, "y")], "document_id int, sha256 string")
    assert {(r.document_id, r.passed, r.message) for r in rules.duplicate_document(hashes).collect()} == {
        (1, False, "Exact duplicate of document 2"), (2, False, "Exact duplicate of document 1"), (3, False, "Exact duplicate of document 1"), (4, True, "No byte-identical duplicate"), (5, True, "No byte-identical duplicate"),
    }
    external = spark.createDataFrame([], "id int, source string, village string, khasra_number string, survey_number string, owner_name string, plot_area_sqm double, khata_number string")
    got = rules.validate(records=records, parcels=parcels, fields=fields, hashes=hashes, external=external, this_year=2024)
    assert tuple(got.columns) == rules.OUTCOME and {r.rule_id for r in got.collect()} == {f"R{i:02}" for i in range(1, 13)}
    broken = rules.validate(records=records, parcels=parcels, fields=fields.drop("confidence"), hashes=hashes, external=external, this_year=2024).filter("rule_id = 'R05'").collect()
    assert len(broken) == 2 and all(not r.passed and r.message.startswith("Rule crashed: ") for r in broken)


def test_duplicate_and_external_records(spark):
    records = spark.createDataFrame([(1, "Ram Prasad", "Rampur", "5", None, None, 100.0, None, None, None, None, None), (2, "Prasad Ram", "Rampur", "5", None, None, 100.0, None, None, None, None, None), (3, "Other", "Rampur", "5", None, None, 1.0, None, None, None, None, None), (4, "X", None, "5", None, None, 1.0, None, None, None, None, None), (5, "Y", "Kolar", "9", "s1", "7", 1.0, None, None, None, None, None)], RECORD)
    got = {(r.document_id, r.severity, r.passed) for r in rules.duplicate_records(records).collect()}
    assert got == {(1, "error", False), (2, "error", False), (3, "warning", False), (5, "info", True)}
    external = spark.createDataFrame([(1, "LRMS", "KOLAR", None, "s1", "Y", 1.02, "8"), (2, "LRMS", "rampur", "5", None, "Ram Prasad", 200.0, None), (3, "LRMS", "Rampur", "5", None, "Z", 1.0, None), (4, "LRMS", "Else", "9", None, "Q", 1.0, None)], "id int, source string, village string, khasra_number string, survey_number string, owner_name string, plot_area_sqm double, khata_number string")
    got = outcomes(rules.cross_database(records, external))
    assert got[5, "owner_name", "warning"] and got[5, "plot_area", "warning"] and not got[5, "khata_number", "warning"]
    assert got[1, "owner_name", "warning"] and not got[1, "plot_area", "warning"] and not got[3, "owner_name", "warning"]
    assert (4, "owner_name", "warning") in got  # no village: any village matches
    lone = spark.createDataFrame([(7, "Ram", "Nowhere", "5", None, None, 1.0, None, None, None, None, None)], RECORD)
    (only,) = rules.cross_database(lone, external).collect()
    assert not only.passed and only.severity == "warning" and only.field_name is None and only.message.startswith("No matching record")


def test_extraction(spark):
    lines = spark.createDataFrame([(1, 1, "Village : Rampur   Khasra No : 123/4", 90.0), (1, 2, "Owner Name - Ram Prasad Verma", 80.0), (1, 3, "Khasra 77", 60.0), (2, 1, "nothing here", 90.0)], "document_id int, line_no int, line string, conf double")
    texts = spark.createDataFrame([(1, "joint holding in HARYANA"), (2, "१०४ बीघा १०५ बीघा irrigated")], "document_id int, text string")
    got = {(r.document_id, r.field_name): r.value for r in ex.extracted(lines, texts).collect()}
    assert got[1, "village"] == "Rampur" and got[1, "khasra_number"] == "123/4" and got[1, "owner_name"] == "Ram Prasad Verma"
    assert got[1, "ownership_type"] == "joint" and got[1, "state"] == "Haryana"
    assert got[2, "khasra_number"] == "104-105" and got[2, "land_classification"] == "irrigated" and got[2, "plot_area"] == "१०४ बीघा १०५ बिस्वा" or got[2, "plot_area"].startswith("१०४ बीघा")


def test_khasra_rows(spark):
    df = spark.createDataFrame([("१०४ बीघा १०५ बीघा",), ("२०५५ १०४ 3 बीघा",), ("२०५० क बीघा",)], "t string")
    assert [r.k for r in df.select(ex.khasra_numbers(F.col("t")).alias("k")).collect()] == [["104", "105"], [], []]


def test_agreement_and_scores(spark):
    a = spark.createDataFrame([(1, "x", "Ram-Lal"), (1, "y", "1"), (1, "z", "q")], "document_id int, field_name string, value string")
    b = spark.createDataFrame([(1, "x", "ramlal."), (1, "y", "2"), (1, "w", "q")], "document_id int, field_name string, value string")
    assert {(r.field_name, r.state) for r in ex.agreement(a, b).collect()} == {("x", "agree"), ("y", "disagree"), ("z", "only_primary"), ("w", "only_shadow")}
    one = spark.range(1).select(ex.score(F.lit(100.0), F.lit(90.0), F.lit(0.9)).alias("s")).first().s
    assert one == 93.5


def test_snapping_and_headings(spark):
    df = spark.createDataFrame([("wheet",), ("zz",), (None,)], "t string")
    assert [r.k for r in df.select(ex.snapped(F.col("t"), "crop")["key"].alias("k")).collect()] == ["wheat", None, None]
    df = spark.createDataFrame([("Khasra No.",), ("मालिक का नाम",), ("qqqq",)], "t string")
    assert [r.k for r in df.select(ex.heading_column(F.col("t")).alias("k")).collect()] == ["parcel_number", "owner_name", None]


def test_corrections_exact_before_similar(spark):
    lex = spark.createDataFrame([("owner_name", "Ram Prasad Vermaa", "A", 1), ("owner_name", " ram prasad vermaa", "B", 2)], "field_name string, ocr_value string, corrected_value string, id int")
    v = spark.createDataFrame([("owner_name", "RAM PRASAD VERMAA"), ("owner_name", "Ram Prasad Verma"), ("owner_name", "Sita")], "field_name string, value string")
    assert {r.value: r.learned for r in ex.corrected(v, lex).collect()} == {"RAM PRASAD VERMAA": "B", "Ram Prasad Verma": "B", "Sita": None}


def test_sequences(spark):
    df = spark.createDataFrame([(1, 1, 5.0), (1, 2, 5.0), (1, 3, 9.0), (2, 1, None)], "k int, i int, v double")
    assert {(r.k, r.i) for r in seq.argmax_per_key(df, ["k"], "v", ["i"]).collect()} == {(1, 3), (2, 1)}


def test_paging_scope_and_changes(spark):
    df = spark.range(10).select("id", F.lit("UP").alias("state"), F.lit("d").alias("district"))
    got = page(df, [F.desc("id")], 2, 3).collect()
    assert [(r.id, r.total) for r in got] == [(6, 10), (5, 10), (4, 10)]
    assert scoped(df, "verifier", state="MP").count() == 0 and scoped(df, "admin", state="MP").count() == 10 and scoped(df, "operator").count() == 10
    a, b = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "k int, v string"), spark.createDataFrame([(1, "y"), (2, None), (4, "n")], "k int, v string")
    assert {(r.k, r.change) for r in changes(a, b, "k", ["v"]).collect()} == {(1, "update"), (2, "same"), (3, "delete"), (4, "insert")}
    recent = recent_values(spark.createDataFrame([("a", 1), ("a", 5), ("b", 3), ("", 9)], "s string, t int"), ["s"], "t", 1)
    assert [(r.value, r.last_used) for r in recent.collect()] == [("a", 5)]


def test_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one")
    (tmp_path / "b.pdf").write_bytes(b"one")
    (tmp_path / "c.exe").write_bytes(b"two")
    (tmp_path / "d.png").write_bytes(b"")
    found = uploads(spark, str(tmp_path))
    assert {r.name: r.refused for r in found.collect()} == {"a.pdf": None, "b.pdf": None, "c.exe": "type", "d.png": "empty"}
    none = spark.createDataFrame([], "sha256 string")
    assert [r.name for r in new_files(found, none).collect()] == ["a.pdf"]
    assert new_files(found, found.select("sha256")).count() == 0
    assert json_page(spark.range(2), 1, 2, 9).first().page == '{"items":[{"id":0},{"id":1}],"total":9,"page":1,"size":2}'


def test_streams(spark, tmp_path):
    from parcelry.streaming.ingest import daily_counts, ingest_documents

    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc_id long, text string")
    docs.write.parquet(src)
    ingest_documents(spark, src, "doc_id long, text string", out, ck).awaitTermination(120)
    docs.write.mode("append").parquet(src)
    ingest_documents(spark, src, "doc_id long, text string", out, ck).awaitTermination(120)
    assert sorted(r.text for r in spark.read.parquet(out).collect()) == ["a", "b"]
    events = spark.sql("SELECT timestamp_ntz'2024-01-01 10:00:00' AS ts UNION ALL SELECT timestamp_ntz'2024-01-01 11:00:00' UNION ALL SELECT timestamp_ntz'2024-01-03 11:00:00'")
    events.write.parquet(str(tmp_path / "ev"))
    q = daily_counts(spark, str(tmp_path / "ev"), "ts timestamp_ntz").writeStream.format("memory").queryName("days").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((str(r.day), r.n) for r in spark.table("days").collect()) == [("2024-01-01", 2), ("2024-01-03", 1)]


def test_corrections_lose_no_similar_reading(spark):
    """Against every pair, over short and long readings with edits at all places."""
    import random

    from parcelry.functions.fuzzy import ratio_of

    rng = random.Random(3)
    seen = sorted({"".join(rng.choice("abc ") for _ in range(rng.randint(1, 40))).strip() for _ in range(60)} - {""})
    read = []
    for s in seen:
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(s))
            s = rng.choice((s[:i] + s[i + 1 :], s[:i] + "z" + s[i:], s[:i] + "z" + s[i + 1 :]))
            if not s:
                break
        read.append(s)
    lex = spark.createDataFrame([("f", s, f"c{i}", i) for i, s in enumerate(seen)], "field_name string, ocr_value string, corrected_value string, id int")
    got = {r.value: r.learned for r in ex.corrected(spark.createDataFrame([("f", r) for r in sorted(set(read))], "field_name string, value string"), lex).collect()}
    for r in set(read):
        key = r.strip().lower()
        best = max(((ratio_of(key, s), -i) for i, s in enumerate(seen)), default=(0, 0))
        assert got[r] == (f"c{seen.index(key)}" if key in seen else f"c{-best[1]}" if key and best[0] >= 92 else None), r


def test_verified_fields_and_log(spark):
    fields = spark.createDataFrame([(1, "owner_name", "ram lal", "Ram Lal", 60.0, "rule"), (1, "remarks", "x", "x", 60.0, "rule")], "document_id int, field_name string, value string, normalized_value string, confidence double, source string")
    fixes = spark.createDataFrame([(1, "owner_name", 1, "Ram Lal"), (1, "owner_name", 2, "SHYAM"), (1, "crop", 3, "wheat"), (1, "village", 4, "")], "document_id int, field_name string, place int, corrected_value string")
    got = {r.field_name: r for r in verify.verified_fields(fields, fixes).collect()}
    assert got["owner_name"].normalized_value == "Shyam" and got["owner_name"].value == "ram lal" and got["owner_name"].source == "human" and got["owner_name"].confidence == 100
    assert got["remarks"].source == "rule" and got["crop"].value is None and got["crop"].normalized_value == "wheat"
    assert {(r.field_name, r.old, r.corrected_value) for r in verify.correction_log(fields, fixes).collect()} == {("owner_name", "Ram Lal", "SHYAM"), ("crop", None, "wheat")}
    status = spark.createDataFrame([("pending_review", "approve"), ("verified", "reject"), ("uploaded", "approve")], "s string, d string")
    assert [r.v for r in status.select(verify.decided(F.col("s"), F.col("d")).alias("v")).collect()] == ["verified", "rejected", None]


def test_parcel_edits(spark):
    parcels = spark.createDataFrame([(1, "a", 0, "table", "acre", "2 acre", "10"), (1, "b", 1, "table", "acre", "3 acre", "11"), (1, "c", 2, "table", None, None, "12"), (2, "d", 0, "table", None, "5", "13")], "document_id int, parcel_id string, row_index int, source string, area_unit string, area_text string, parcel_number string")
    edits = spark.createDataFrame([(1, "a", 0, "2 acre", "10"), (1, "b", 1, "4", "11"), (1, None, 2, "1", "99")], "document_id int, parcel_id string, place int, area_text string, parcel_number string")
    got = {(r.document_id, r.parcel_id): r for r in verify.edited_parcels(parcels, edits).collect()}
    assert set(got) == {(1, "a"), (1, "b"), (1, None), (2, "d")}
    assert got[1, "a"].source == "table" and got[1, "b"].source == "human" and got[1, "b"].area_unit == "acre" and got[1, "b"].area_sqm == 16187.44
    assert got[1, None].row_index == 2 and got[2, "d"].area_sqm is None
    assert {tuple(r) for r in verify.parcel_log(parcels, edits).collect()} == {(1, 2, "area", "3 acre", "4"), (1, 3, "parcel_number", None, "99"), (1, 3, "area", None, "1"), (1, 3, "row", "12", None)}


def test_table_helpers(spark):
    texts = spark.createDataFrame([(1, "१०४ बीघा १०५ बीघा"), (2, "१०४ बीघा"), (3, None)], "document_id int, text string")
    assert {(r.document_id, r.row_index, r.parcel_number, r.confidence) for r in ex.synthesised_parcels(texts).collect()} == {(1, 0, "104", 65.0), (1, 1, "105", 65.0)}
    readings = spark.createDataFrame([("khasra_number", "abc"), ("khasra_number", "१२"), ("record_year", None), ("owner_name", "abc")], "field_name string, value string")
    assert {(r.field_name, r.value) for r in ex.with_digits(readings).collect()} == {("khasra_number", "१२"), ("owner_name", "abc")}
    scores = spark.createDataFrame([("parcel_number", "12/3"), ("area", "2.5"), ("area", "25"), ("share", "x"), ("share", None)], "c string, v string")
    assert [r.s for r in scores.select(ex.numeric_score(F.col("c"), F.col("v")).alias("s")).collect()] == [100.0, 100.0, 55.0, 10.0, 0.0]


def test_names_by_role_and_relation(spark):
    rows = [(1, "राम लाल - मालिक. श्याम लाल : काश्तकार"), (2, "१०४ ५ बिस्वा राम लाल आत्मज हरि सिंह मोहन"), (3, "plain"), (4, None), (5, "राम आत्मज गेहूं")]
    got = {(r.document_id, r.field_name): (r.value, r.confidence, r.source) for r in ex.structural_fields(spark.createDataFrame(rows, "document_id int, text string")).collect()}
    assert got[1, "owner_name"] == ("राम लाल", 78.0, "pattern-role") and got[1, "possessor_name"] == ("श्याम लाल", 76.0, "pattern-role")
    assert got[2, "owner_name"] == ("राम लाल", 82.0, "pattern-relation") and got[2, "father_or_husband_name"] == ("हरि सिंह", 78.0, "pattern-relation")
    assert not any(k[0] in (3, 4, 5) for k in got)


def test_state_machine_and_reprocessing(spark):
    moves = spark.createDataFrame([("failed", "processing"), ("uploaded", "verified"), ("extracted", "pending_review"), ("rejected", "verified"), (None, "processing"), ("uploaded", None)], "a string, b string")
    assert [r.v for r in moves.select(verify.moved(F.col("a"), F.col("b")).alias("v")).collect()] == ["processing", None, "pending_review", None, None, None]
    docs = spark.createDataFrame([(i, "verified" if i % 2 else "pending_review", bool(i % 2), "x") for i in range(6)], "document_id int, status string, is_verified boolean, note string")
    reruns = spark.createDataFrame([(0, False, 0, 0, 90.0), (1, False, 1, 0, 90.0), (2, True, 0, 0, 90.0), (3, False, 0, 0, None), (4, None, 0, 1, 99.0)], "document_id int, crashed boolean, failed_errors int, disagreements int, confidence double")
    got = {r.document_id: (r.status, r.is_verified, r.note) for r in verify.reprocessed(docs, reruns).collect()}
    assert got == {0: ("auto_verified", True, "x"), 1: ("pending_review", True, "x"), 2: ("failed", False, "x"), 3: ("pending_review", True, "x"), 4: ("pending_review", False, "x"), 5: ("verified", True, "x")}


def test_cells_and_second_readings(spark):
    cells = spark.createDataFrame([(0.0149,), (0.015,), (None,)], "ink double")
    assert [r.v for r in cells.select(ex.blank_cell(F.col("ink")).alias("v")).collect()] == [True, False, True]
    tables = spark.createDataFrame([(["area", "owner_name"],), (["area"],), ([],), (None,)], "c array<string>")
    assert [r.v for r in tables.select(ex.identifies_parcels(F.col("c")).alias("v")).collect()] == [True, False, False, False]
    rows = [("record_year", "19b7", 90.0, "1987.", 60.0), ("record_year", "1987", 80.0, "1988", 84.9), ("record_year", "1987", 80.0, "1988", 85.0), ("owner_name", "Ram", 10.0, "1988", 99.0), ("khata_number", "12", 10.0, "--", 99.0), ("khata_number", "12", 97.0, "13", 104.0), ("khata_number", None, 50.0, "13", 20.0), ("khata_number", "12", 50.0, None, 99.0)]
    d = spark.createDataFrame(rows, "f string, v string, c double, w string, x double")
    got = [tuple(r.r) for r in d.select(ex.reread(F.col("f"), F.col("v"), F.col("c"), F.lit("rule"), F.col("w"), F.col("x")).alias("r")).collect()]
    assert got[:4] == [("1987", 90.0, "rule+digits"), ("1987", 80.0, "rule"), ("1988", 85.0, "rule+digits"), ("Ram", 10.0, "rule")]
    assert got[4:] == [("12", 10.0, "rule"), ("13", 99.0, "rule+digits"), ("13", 50.0, "rule+digits"), ("12", 50.0, "rule")]


def test_external_snapshots_append(spark, tmp_path):
    from parcelry.sources.files import sync_external

    rows = spark.range(3)
    for _ in range(2):
        sync_external(rows, str(tmp_path / "external"))
    assert spark.read.parquet(str(tmp_path / "external")).count() == 6
    with pytest.raises(ValueError):
        sync_external(rows.limit(0), str(tmp_path / "external"))


def test_headers_from_lines_without_copies_of_them(spark, tmp_path):
    """Two distinct counts used to make three rows of every line before the shuffle."""
    from parcelry.operators.relational import tasks_for
    from parcelry.plans import ORACLES, PLANS
    from tests.oracle import compare, connect

    rows = [(1, 1, 5, 7, 1.0), (1, 1, 4, 7, 2.0), (1, 2, 9, 8, 1.0), (2, 1, 5, 7, 0.5), (2, 2, 5, 7, 0.5), (3, 1, 6, 9, None), (9, 1, 1, 1, 1.0), (5, 3, 2, None, 1.0), (5, 1, 2, 4, 1.0)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1,), (2,), (2,), (3,), (4,), (5,)], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    for t in ("region", "nation", "customer", "supplier", "part", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        spark.range(1).write.parquet(f"{tmp_path}/{t}.parquet")
    df = PLANS["village_derived_header"](spark, str(tmp_path))
    assert compare(df, connect(str(tmp_path)), ORACLES["village_derived_header"]) == ""
    assert "Expand" not in df._jdf.queryExecution().executedPlan().toString()
    assert tasks_for(spark.range(10), spark.range(10), most=1) == 21


@pytest.mark.parametrize(("cutoff", "long"), [(92, 128), (92, 25), (80, 12), (60, 128)])
def test_pairs_meet_where_a_similar_reading_can_have_them(spark, monkeypatch, cutoff, long):
    """All pairs of brute force, of short and of long texts, whatever was put in or left out where."""
    import random

    from parcelry.functions.fuzzy import ratio_of

    monkeypatch.setattr(ex, "LONG_TEXT", long, raising=False)
    rng = random.Random(cutoff + long)
    seen = sorted({"".join(rng.choice("ab अ") for _ in range(rng.choice((1, 2, 3, 9, 12, 13, 24, 25, 26, 31, 40)))).strip() for _ in range(60)} - {""})
    read = set()
    for s in seen:
        for _ in range(2):
            t = s
            for _ in range(rng.randint(1, max(1, len(s) * (100 - cutoff) // 100))):
                i = rng.randrange(len(t) + 1)
                t = rng.choice((t[:i] + t[i + 1 :], t[:i] + "z" + t[i:], t[1:] + "z", "z" + t))
            read.add(t.strip())
    read = sorted(read - {""} - set(seen))
    open_ = spark.createDataFrame([("f", r) for r in read] + [("other", seen[0])], "field_name string, reading string")
    latest = spark.createDataFrame([("f", s, f"c{i}", i) for i, s in enumerate(seen)], "field_name string, seen string, learned string, id int")
    got = {(r.field_name, r.reading, r.seen) for r in ex.near_readings(open_, latest, cutoff).collect() if r.s >= cutoff}
    assert got == {("f", r, s) for r in read for s in seen if ratio_of(r, s) >= cutoff} and got


def test_unlike_readings_seldom_meet(spark):
    """Pieces count at their own place alone and unlike pairs are dropped before they are scored; before, a piece met every reading that had it anywhere, and each such pair was scored in Python."""
    import hashlib

    texts = [hashlib.md5(str(i).encode()).hexdigest() for i in range(3000)]
    latest = spark.createDataFrame([("f", t, "c", i) for i, t in enumerate(texts)], "field_name string, ocr_value string, corrected_value string, id int")
    values = spark.createDataFrame([("f", t[1:] + "x") for t in texts[::2]], "field_name string, value string")
    df = ex.corrected(values, latest)
    assert df.filter("learned = 'c'").count() == 1500
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "levenshtein(" in plan and plan.count("ArrowEvalPython") == 1
