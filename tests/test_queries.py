"""Every registered query against its SQL on the smallest tables."""

import pytest
from compare import connect, difference
from conftest import SMALL

from __spark_entry__ import entry, oracle_sql, queries

QUERIES, SQL = queries(), oracle_sql()


@pytest.fixture(scope="module")
def engine():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, engine, name):
    df = QUERIES[name](spark, SMALL)
    if name in SQL:
        assert difference(df, engine, SQL[name]) is None
    else:
        df.count()


def test_entry_runs(spark):
    assert entry(spark).count() > 0
