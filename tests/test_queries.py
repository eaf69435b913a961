import os

import pytest

from loomwire import queries
from tests import sqlcheck

pytestmark = pytest.mark.skipif(not os.path.isdir(sqlcheck.DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def connection():
    return sqlcheck.connect()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, connection, name):
    sqlcheck.equal(spark, connection, queries.QUERIES[name], queries.SQL[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_reach_the_scan(spark):
    from loomwire.session import table

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    recent = plan(queries.filter_recency(spark, sqlcheck.DATA))
    assert "GreaterThanOrEqual(source_date" in recent and "ReadSchema: struct<item_id:bigint,source_date:timestamp>" in recent
    assert "raw" not in plan(queries.history_window(spark, sqlcheck.DATA)).split("ReadSchema")[1]
    assert "WindowGroupLimit" in plan(queries.truncate_per_category(spark, sqlcheck.DATA))
    native = plan(queries.canonical_url(spark, sqlcheck.DATA)) + plan(queries.extract_time(spark, sqlcheck.DATA)) + plan(queries.p6_times(spark, sqlcheck.DATA))
    assert "Python" not in native and "Arrow" not in native
    assert table(spark, sqlcheck.DATA, "brief_news").count() > 0
