"""The pipeline's stages over a small table."""

from hashlib import md5

import pytest

from parcelry.llm.shared import saved

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_keep_the_columns_and_run_equals_them(spark, data, documents):
    docs = documents
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, data)
        assert docs.columns == documents.columns, name
        docs = docs.cache()
        assert docs.count() > 0
    got = pipeline.run(spark, data)
    assert got.agg({"length": "sum"}).first()[0] > 0
    assert {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} <= set(got.columns)


def test_names_and_order(spark):
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "near_dedup", "substring_dedup", "mixing", "packing"]


def test_stages_on_odd_rows(spark, data, nasty, empty):
    """Nulls in every column, empty texts, repeated rows and clashing names go through all stages; an empty table stays empty."""
    for docs, some in ((nasty, True), (empty, False)):
        columns = docs.columns
        for name, stage in pipeline.STAGES[:-1]:
            docs = stage(spark, docs, data)
            assert docs.columns == columns, name
            docs = saved(docs, f"test-{name}")
            assert docs.isEmpty() != some, name
        assert pipeline.STAGES[-1][1](spark, docs, data).isEmpty() != some


def test_decisions_of_stages_take_effect(spark, data):
    """What each stage must drop goes, and clean documents stay whole."""
    stages = dict(pipeline.STAGES)
    word = lambda i, j: "".join(chr(97 + b % 26) for b in md5(f"{i} {j}".encode()).digest()[:6])
    clean = [(i, " ".join(word(i, j) for j in range(60)), "en", "a", 0) for i in range(8)]
    shared = " ".join(word(99, j) for j in range(55))
    rows = [*clean, (100, clean[0][1], "en", "b", 0), (101, f"{shared} first tail", "en", "b", 0), (102, f"head {shared}", "en", "b", 0), (103, "!!! 123", "en", "a", 0), (104, None, "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    told = saved(stages["language_id"](spark, docs, data), "test-told")
    ids = lambda d: sorted(r.doc_id for r in d.select("doc_id").collect())
    assert ids(told) == [*range(8), 100, 101, 102]
    single = saved(stages["near_dedup"](spark, told, data), "test-single")
    kept = ids(single)
    assert len(kept) == len(set(kept)) and len({0, 100} & set(kept)) == 1 and set(range(1, 8)) <= set(kept)
    cut = {r.doc_id: r.text for r in stages["substring_dedup"](spark, single, data).collect()}
    assert all(cut[i] == clean[i][1] for i in range(1, 8))
    assert {101, 102} - set(kept) or cut[102].split() == ["head"]
