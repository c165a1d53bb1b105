"""Every registered query on the smallest folder, against its check SQL on DuckDB."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from check import database, rows

FOLDER = "/root/testdata/sf0.001"
QUERIES, CHECKS = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return database(FOLDER)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_matches_check_sql(spark, connection, name):
    got, want = QUERIES[name](spark, FOLDER).toPandas(), connection.execute(CHECKS[name]).df()
    assert rows(got) == rows(want)
    assert sorted(got.columns) == sorted(want.columns)


def test_entry_and_unchecked_queries(spark):
    """Every query of the library proper has check SQL; those of the optional subpackage may have their own tests."""
    assert entry.entry(spark).count() > 0
    optional = {} if entry.llm is None else {*entry.llm.queries(), "pipeline"}
    assert set(QUERIES) - set(CHECKS) <= set(optional)
