"""Every registered catalogue query against its SQL in DuckDB, on the smallest tables."""

import os

import pytest

from tests.compare import numbers_alike, rows

SF = "/root/testdata/sf0.001"

from lectern.plans import catalog_queries, change_queries, export_queries, scalar_queries, text_queries  # noqa: E402, F401
from lectern.plans.registry import QUERIES, SQL  # noqa: E402
from lectern.plans.standin import BASE  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for b in BASE:
        c.execute(f"CREATE VIEW {b} AS SELECT * FROM '{SF}/{b}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    ours, theirs = numbers_alike(QUERIES[name](spark, SF).toPandas()), numbers_alike(duck.execute(SQL[name]).df())
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_other_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
