"""Every registered query against its SQL on the smallest tables."""

import pytest
from conftest import SF

import __spark_entry__ as entry
from check import compare, connect


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    ok, text = compare(spark, con, name, SF)
    assert ok, text
