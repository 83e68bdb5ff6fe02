"""Every query with SQL agrees with DuckDB on whole tables."""

import pytest

import __spark_entry__ as entry
from compare import connect, differences


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, folder, con, name):
    assert differences(entry.queries()[name](spark, folder), con, entry.oracle_sql()[name]) is None


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 5


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
