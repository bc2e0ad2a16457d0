"""Stored tables and search: what is read, what is rewritten, and what comes out."""

import random

import pytest
from pyspark.sql import functions as F

from parcelry.operators import search
from parcelry.sources.stored import Stored, delete_with_children, new_path


def files(path):
    """Each partition's files, to see which were rewritten."""
    import glob
    import os

    return {d.rpartition("=")[2]: sorted(os.path.basename(f) for f in glob.glob(f"{d}/*.parquet")) for d in glob.glob(f"{path.removeprefix('file:')}/part=*")}


def held(table):
    return sorted((tuple(r) for r in table.read().collect()), key=str)


def test_edits_rewrite_only_touched_partitions(spark):
    rows = [(i % 50, i, f"v{i}") for i in range(500)] + [(None, -1, "null key")]
    table = Stored(spark, new_path(spark, "t"), "k", 16).write(spark.createDataFrame(rows, "k long, i long, v string"))
    before = files(table.path)
    keys, new = spark.createDataFrame([(3,), (7,), (3,)], "k long"), spark.createDataFrame([(3, 1000, "new"), (3, 1001, "new")], "k long, i long, v string")
    hit = table.replace(keys, new)
    want = sorted([r for r in rows if r[0] not in (3, 7)] + [(3, 1000, "new"), (3, 1001, "new")], key=str)
    assert held(table) == want
    after = files(table.path)
    assert 1 <= len(hit) <= 2 and {p for p in before if before[p] != after.get(p)} == set(map(str, hit))
    table.replace(keys, new)
    assert held(table) == want
    assert table.replace(keys.limit(0)) == [] and files(table.path).keys() == after.keys()
    table.replace(spark.createDataFrame([(None,)], "k long"))
    assert held(table) == [r for r in want if r[0] is not None]
    table.replace(spark.createDataFrame([(i,) for i in range(50)], "k long"))  # partitions without rows go
    assert table.spark.read.schema("k long, i long, v string, part int").parquet(table.path).count() == 0


def test_a_run_that_ends_half_way_is_completed(spark, monkeypatch):
    make = lambda name, key: Stored(spark, new_path(spark, name), key, 8).write(spark.range(200).select(F.col("id").alias(key), (F.col("id") * 2).alias("v")))
    parent, children = make("documents", "id"), [make(n, "document_id") for n in ("fields", "parcels", "results", "records")]
    keys = spark.range(0, 200, 5)
    put, calls = Stored._put, []

    def fails(self, *args):
        calls.append(self.path)
        if len(calls) == 3:
            raise RuntimeError("lost")
        put(self, *args)

    monkeypatch.setattr(Stored, "_put", fails)
    with pytest.raises(RuntimeError):
        delete_with_children(keys, parent, children)
    assert parent.read().count() == 200  # the parent goes last
    assert [c.read().count() for c in children] == [160, 160, 200, 200]
    done = delete_with_children(keys, parent, children)
    assert [t.read().count() for t in (parent, *children)] == [160] * 5
    assert list(done) == [t.path for t in (*children, parent)]
    again = files(parent.path)
    delete_with_children(keys, parent, children)
    assert [t.read().count() for t in (parent, *children)] == [160] * 5 and files(parent.path).keys() == again.keys()


def test_search_by_trigrams_is_the_scan(spark):
    r = random.Random(6)
    texts = ["".join(r.choice("abAB %_é\\") for _ in range(r.randint(0, 12))) for _ in range(400)] + [None, "", "ab", "aba"]
    df = spark.createDataFrame([(i, t, t and t[::-1]) for i, t in enumerate(texts)], "id int, a string, b string")
    index = search.write_postings(df, "id", ["a", "b"], new_path(spark, "trigrams"))
    assert index.groupBy("id", "trigram").count().filter("count > 1").isEmpty()
    for q in ("ab", "aba", "ABAB", "a%ba", "_ab", "a_bab", "%", "ab %", "zzz", "éab", "baabab", "b\\a"):
        got = {x.id for x in search.matching(df, "id", ["a", "b"], index, q).collect()}
        assert got == {x.id for x in search.matching(df, "id", ["a", "b"], None, q).collect()}, q
    plain = {i for i, t in enumerate(texts) if t and ("aba" in t.lower() or "aba" in t[::-1].lower())}
    assert {x.id for x in search.matching(df, "id", ["a", "b"], index, "Aba").collect()} == plain
    plan = search.candidates(df, "id", index, "abab")._jdf.queryExecution().executedPlan().toString()
    assert "In(trigram, [aba,bab])" in plan and "cell" in plan.partition("PartitionFilters")[2].partition("]")[0]


def test_shared_texts_are_indexed_once(spark, monkeypatch):
    """Before, a text's trigrams were written for every row that has it."""
    rows = spark.createDataFrame([(i, ("Yellow", "LOW", "lo_w", None)[i % 4], i % 10) for i in range(1000)], "id int, a string, b int")
    index = search.write_text_postings([rows.select("a"), rows.select("b"), rows.select("a")], new_path(spark, "trigrams"))
    assert index.count() == 4 + 1 + 2
    for few in (search.FEW, 0):
        monkeypatch.setattr(search, "FEW", few)
        for q in ("low", "Yell", "lo%w", "elo", "zzz", "9"):
            got = [sorted(r.id for r in search.matching(rows, "id", ["a", "b"], x, q).collect()) for x in (index, None)]
            assert got[0] == got[1], q


def test_hits_by_branch(spark):
    none = {c: None for c in search.RECORD_TEXTS}
    docs = spark.createDataFrame([(1, "x" * 80 + " Ram " + "y" * 80), (2, "ram"), (3, None), (4, "no"), (5, "")], "document_id int, ocr_text string")
    columns = ", ".join(f"{c} string" for c in search.RECORD_TEXTS)
    records = spark.createDataFrame([(1, *{**none, "owner_name": "RAM", "village": ""}.values()), (9, *{**none, "owner_name": "ram"}.values())], f"document_id int, {columns}")
    parcels = spark.createDataFrame([(1, 1, 0, "ram", "5", None, None), (2, 3, 1, "Ram", None, "wheat", None), (3, 3, 0, "x", "ram1", None, None), (4, 4, 0, "x", None, None, "ram land")], "parcel_id int, document_id int, row_index int, owner_name string, parcel_number string, crop string, land_classification string")
    fields = spark.createDataFrame([(1, 4, "village", "Rampur"), (2, 4, "crop", "ram"), (3, 3, "village", "Rampur"), (4, 5, "village", None)], "field_id int, document_id int, field_name string, value string")
    got = sorted((r.document_id, r.kind, r.snippet, r.parcel_row) for r in search.hits(docs, records, parcels, fields, " ram ").collect())
    text = "…" + ("x" * 59 + " Ram " + "y" * 59) + "…"
    assert got == [(1, "ocr", text, None), (1, "record", "— · RAM · khasra —", None), (2, "ocr", "…ram…", None), (3, "parcel", "parcel ram1 · owner x ·", 0), (4, "field", "village = Rampur", None)]
    first = search.first_hits(search.hits(docs, records, parcels, fields, "ram"), 2).collect()
    assert [(r.document_id, r.kind, r.total) for r in first] == [(1, "record", 5), (3, "parcel", 5)]
    with pytest.raises(ValueError):
        search.hits(docs, records, parcels, fields, " r ")


def test_batches_that_are_replayed_replace_themselves(spark, tmp_path):
    from parcelry.sources.files import append, appended, sync_external

    path = str(tmp_path / "log")
    for batch in (0, 1, 1, 0):
        append(spark.range(10 * batch, 10 * batch + 3), path, batch)
    assert sorted(r.id for r in appended(spark, path).collect()) == [0, 1, 2, 10, 11, 12]
    append(spark.range(100, 102), path)
    append(spark.range(100, 102), path)  # without a name each append counts
    assert appended(spark, path).count() == 10
    sync_external(spark.range(5), str(tmp_path / "e"), "monday")
    sync_external(spark.range(4), str(tmp_path / "e"), "monday")
    assert appended(spark, str(tmp_path / "e")).count() == 4


def test_ingestion_survives_replays_and_half_written_batches(spark, tmp_path):
    from parcelry.sources.files import appended
    from parcelry.streaming.ingest import append_stream, new_documents

    target = str(tmp_path / "t")
    sink, docs = new_documents(target), lambda *rows: spark.createDataFrame(list(rows), "doc_id long, text string")
    sink(docs((2, "a"), (1, "a"), (3, "b"), (4, None)), 0)
    sink(docs((5, "b"), (6, "c")), 1)
    want = {(1, "a"), (3, "b"), (4, None), (6, "c")}
    rows = lambda: [(r.doc_id, r.text) for r in appended(spark, target).select("doc_id", "text").collect()]
    assert set(rows()) == want and len(rows()) == 4
    sink(docs((5, "b"), (6, "c")), 1)
    assert set(rows()) == want and len(rows()) == 4
    failing = docs((7, "d"), (8, "boom")).repartition(2).withColumn("doc_id", F.expr("if(text = 'boom', raise_error('lost'), doc_id)"))
    with pytest.raises(Exception):  # noqa: B017
        sink(failing, 2)
    assert set(rows()) == want
    docs((9, "half")).withColumn("sha256", F.sha2("text", 256)).write.parquet(f"{target}/batch=2")  # what a lost run may have left
    sink(docs((7, "d"), (9, "half")), 2)
    assert set(rows()) == want | {(7, "d"), (9, "half")} and len(rows()) == 6

    source = str(tmp_path / "s")
    docs((1, "x"), (2, "y")).write.parquet(source)
    stream = spark.readStream.schema("doc_id long, text string").parquet(source)
    for checkpoint in ("c1", "c2"):  # a lost checkpoint replays batch 0
        append_stream(stream, str(tmp_path / "o"), str(tmp_path / checkpoint)).awaitTermination(120)
    assert appended(spark, str(tmp_path / "o")).count() == 2


def test_a_parcel_edit_touches_its_partitions_alone(spark, data):
    from parcelry.operators.verify import edited_parcels
    from parcelry.plans.state import _parcels
    from parcelry.sources.tables import Tables

    parcels, edits = _parcels(Tables(spark, data))
    table = Stored(spark, new_path(spark, "parcels"), "document_id", 32).write(parcels)
    before = files(table.path)
    one = edits.filter("document_id = 10")
    keys = one.select("document_id").distinct()
    if keys.isEmpty():
        pytest.skip("no such document")
    new = edited_parcels(table.read().join(keys, "document_id", "left_semi"), one)
    rows = sorted(map(str, new.select("document_id", "parcel_id", "area_text").collect()))
    hit = table.replace(keys, new)
    after = files(table.path)
    assert len(hit) == 1 and {p for p in before if before[p] != after.get(p)} == {str(hit[0])}
    assert sorted(map(str, table.read().filter("document_id = 10").select("document_id", "parcel_id", "area_text").collect())) == rows
