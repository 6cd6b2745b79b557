"""Every query against DuckDB on the smallest tables."""

from __future__ import annotations

import re

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.check_oracle import connect, differences

QUERIES = queries()
STATEMENTS = oracle_sql()


@pytest.fixture(scope="module")
def database(folder):
    return connect(folder)


def test_every_query_has_sql():
    assert set(STATEMENTS) <= set(QUERIES)
    assert {name for name in QUERIES if not re.match(r"op\d|pipeline$", name)} <= set(STATEMENTS)


@pytest.mark.parametrize("name", STATEMENTS)
def test_same_as_sql(spark, database, folder, name):
    assert differences(spark, database, QUERIES[name], STATEMENTS[name], folder) == ""


def test_entry(spark):
    assert entry(spark).count() == 4
