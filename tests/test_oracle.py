"""Every registered query runs at the smallest scale, next to its SQL where it has one."""

import os

import pytest

import __spark_entry__ as entry
from tests.compare import difference, duckdb_views

FOLDER = "/root/testdata/sf0.001"
SLOW = {"x10_boosted_trees"}
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return duckdb_views(FOLDER)


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - SLOW))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.collect()
    else:
        assert difference(df, con, sql) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
