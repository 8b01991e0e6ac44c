"""Every registered query against its SQL, and that it says something."""

import pytest
from oracle import compare, connect

from sparrowdoc.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()
#: Empty on the smallest tables.
SPARSE = {"census_crossdoc", "incomplete_streams"}


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    n = compare(df, con, SQL[name]) if name in SQL else len(df.collect())
    assert n or name in SPARSE


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(SQL) <= set(QUERIES) and len(QUERIES) > 80
    assert set(entry.oracle_sql()) <= set(entry.queries()) >= set(QUERIES)


def test_plans_stay_small(spark, sf):
    """Ranks are limited in each task, filters reach the scan, and only asked columns are read."""
    explain = lambda df: spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert "WindowGroupLimit" in explain(QUERIES["bm25_topk"](spark, sf)) and "WindowGroupLimit" in explain(QUERIES["dense_topk"](spark, sf))
    plan = explain(QUERIES["range_in_eq_filter_topk"](spark, sf))
    assert "In(l_returnflag, [A,R])" in plan and "GreaterThanOrEqual(l_shipdate" in plan and "TakeOrderedAndProject" in plan
    assert "l_tax" not in plan
