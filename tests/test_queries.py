"""Every registered query of the reference's operators against its SQL, on the smallest tables."""

import duckdb
import pytest

from lattica import function_queries, queries  # noqa: F401  (register)
from lattica.registry import ORACLE, QUERIES
from tests.compare import same, tables

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, name):
    con = duckdb.connect()
    tables(con, SF)
    same(QUERIES[name](spark, SF), con.execute(ORACLE[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_filters_reach_the_scan(spark):
    plan = QUERIES["criteria_wildcards"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(p_size" in plan and "LessThanOrEqual(p_size" in plan
    plan = QUERIES["pivot_revenue"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_quantity,10.0)" in plan and plan.count("FileScan parquet") == 1
