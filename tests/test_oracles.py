"""Every registered query against its SQL twin on the smallest tables."""

import pytest
from oracle_check import compare, duck

import __spark_entry__ as entry
from leadspark.catalog.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


def test_every_twin_has_a_query():
    assert set(QUERIES) <= set(SQL) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 20


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    text, _, ok = compare(spark, con, name, QUERIES[name], SQL[name], FOLDER)
    assert ok, text
