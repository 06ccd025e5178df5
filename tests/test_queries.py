"""Every registered query against its SQL twin, and the driver's contract."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_point
from suite import ORACLE, QUERIES
from suite.check import compare, duck


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(spark, con, sf, name):
    result = compare(spark, con, name, sf)
    assert result.startswith("ok") and "TYPES" not in result, result


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_sql_gives_rows(spark, sf, name):
    assert not QUERIES[name](spark, sf).isEmpty()


def test_contract(spark):
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
    out = entry_point.entry(spark)
    assert out.columns == ["product_id", "total", "share", "cum_share", "abc"]
    assert out.count() > 0
