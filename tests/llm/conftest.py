import pytest

NASTY = [
    (1, "", "en", "a"), (2, None, "en", None), (3, "   \n\t ", None, "a"), (None, "no id here but words", "de", "b"), (5, "x", None, None), (6, "x", "fr", "a"),
    (7, "word " * 5000, "en", "c"), (8, "a\x00b\u2028c é́ ﷽ 中文 हिन्दी 🙂 \x1f", "de", "c"), (9, "Same text of some words that repeats.", "en", "c"), (9, "Same text of some words that repeats.", "en", "c"),
    (9, "Same id but another text altogether.", "en", "c"), (12, "!!! ??? ...", "fr", "a"),
]


@pytest.fixture(scope="session")
def nasty(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, and columns with names that operators use."""
    rows = [(*r, i, "d", 0.5, i) for i, r in enumerate(NASTY)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, row int, d string, score double, node int")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


@pytest.fixture(scope="session")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")
