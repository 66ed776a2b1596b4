"""The driver contract at the smallest scale: every query with SQL gives the rows of that SQL."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from pitchlake.plans.queries import QUERIES
from pitchlake.plans.sql import SQL

from .compare import assert_same, connect

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(DIR)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    assert_same(entry.queries()[name](spark, DIR).toPandas(), con.execute(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_gives_rows(spark, name):
    assert entry.queries()[name](spark, DIR).count() > 0


def test_entry(spark):
    assert not entry.entry(spark).isEmpty()


def test_sql_names_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
