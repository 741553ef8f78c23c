"""Every registered query with a SQL twin gives the same rows as that SQL; the others give rows."""

import pytest
from conftest import SMALL

import __spark_entry__ as entry
import oracle

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SMALL)


def test_registry():
    assert set(SQL) <= set(QUERIES)
    assert len(QUERIES) > 130


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 5 and all(r["rmsle"] > 0 for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, name):
    assert oracle.difference(QUERIES[name](spark, SMALL), con, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0
