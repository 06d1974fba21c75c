"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from grainsift import registry
from oracle import compare, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("key", list(registry.QUERIES))
def test_query(spark, duck, key):
    df = entry.queries()[key](spark, SF)
    sql = entry.oracle_sql().get(key)
    if sql is None:
        assert df.columns and df.count() >= 0
    else:
        assert compare(df, duck, sql) is None


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
