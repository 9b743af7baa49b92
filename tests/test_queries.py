"""Registered queries against their DuckDB statements at the smallest scale."""

import os

import pytest

import __spark_entry__ as entry
from faultsift.plans.registry import QUERIES
from oracle.compare import compare, connect
from oracle.statements import statements

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")


def test_every_query_has_a_statement():
    assert set(QUERIES) == set(statements())
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ok, note = compare(spark, name, QUERIES[name], statements()[name], SF, con)
    assert ok and "types agree" in note, note


def test_flagship(spark):
    assert entry.entry(spark).count() == 3
