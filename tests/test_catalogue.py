"""Every catalogue query against its SQL; those without SQL must give the same rows twice."""

import pytest

from parcelry.plans import ORACLES, PLANS
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, data, con, name):
    assert compare(PLANS[name](spark, data), con, ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(PLANS) - set(ORACLES)))
def test_stable_rows(spark, data, name):
    first = sorted(map(str, PLANS[name](spark, data).collect()))
    assert first == sorted(map(str, PLANS[name](spark, data).collect()))


def test_entry_contract(spark, data):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.queries()["geo_progress"](spark, data).count() > 0


def test_filters_and_columns_reach_the_scan(spark, data):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = PLANS["lookup_point"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,F)" in plan
    assert "o_totalprice" not in plan
