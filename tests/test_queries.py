"""Every registered query with SQL gives the rows DuckDB gives, on the smallest tables."""

import pytest

import __spark_entry__ as entry_module
from checks.compare import difference, duck

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", list(entry_module.queries()))
def test_query(spark, con, name):
    df = entry_module.queries()[name](spark, FOLDER)
    sql = entry_module.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        assert difference(df, con, sql) is None


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
