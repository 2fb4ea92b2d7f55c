"""Every registered query against DuckDB on the smallest check tables, and the shape of its plan."""

from pathlib import Path

import pytest

import __spark_entry__ as entry_point
from cropline_check.check import compare, connect
from cropline_check.oracle import oracle_statements
from cropline_check.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="check tables not present")

ORACLE = oracle_statements()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_a_statement():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry_point.queries()) and set(ORACLE) <= set(entry_point.oracle_sql())


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_same_rows_as_duckdb(spark, con, key):
    problem = compare(spark, con, SF, key, ORACLE[key])
    assert problem is None, problem


@pytest.mark.parametrize("threshold", ["10MB", "-1"])
def test_no_nested_loops_or_python_in_any_plan(spark, threshold):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        for key, query in QUERIES.items():
            plan = query(spark, SF)._jdf.queryExecution().executedPlan().toString()
            for operator in ("NestedLoop", "Cartesian", "Python", "ArrowEval"):
                assert operator not in plan, (key, operator)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
