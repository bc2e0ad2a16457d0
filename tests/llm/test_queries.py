"""The registered queries: names, columns, and the rows of their SQL."""

import re

import pytest

from parcelry.llm.queries import oracle_sql, queries
from tests.oracle import compare, connect


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries()) == list(range(1, 14))
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows_as_sql(spark, data, name):
    assert compare(queries()[name](spark, data), connect(data), oracle_sql()[name]) == ""


@pytest.mark.parametrize("name", ["op8_mixing", "op9_host_rules", "op10_url_reputation"])
def test_native_queries_run_no_python(spark, data, name):
    plan = queries()[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
