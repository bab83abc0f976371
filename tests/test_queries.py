"""Every named query against its comparison SQL, and the shape of its plan."""

import os

import pytest

import __spark_entry__ as entry
from tidemill.plans.catalogue import ORACLES, QUERIES
from tools.check_queries import compare, connect

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_query_has_comparison_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF_DIR)
    problem, rows = compare(df, duck, entry.oracle_sql()[name])
    assert problem is None
    assert rows > 0
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan


def test_entry(spark):
    assert entry.entry(spark).count() > 0
