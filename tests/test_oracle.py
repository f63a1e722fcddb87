"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect
from tidemark.catalog import load

QUERIES, STATEMENTS = load()


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, small, name):
    assert compare(spark, con, small, name, QUERIES[name], STATEMENTS.get(name)) is None


def test_every_query_has_sql():
    assert set(QUERIES) == set(STATEMENTS)


def test_registered():
    assert set(QUERIES) <= set(entry.queries()) and set(STATEMENTS) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
