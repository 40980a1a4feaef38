"""Every registered query against its SQL, and the rest for a stable, non-empty result."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.conftest import SMALL
from tools.check_queries import compare, connect


@pytest.fixture(scope="module")
def database():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_agrees_with_sql(spark, database, name):
    assert compare(spark, database, SMALL, name) == ""


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_query_returns_rows(spark, name):
    df = queries()[name](spark, SMALL)
    assert df.columns and df.limit(1).count() == 1


def test_flagship(spark):
    rows = entry(spark).collect()
    assert len(rows) == 20
    assert [(-r.source_count, -r.report_count, r.ip) for r in rows] == sorted(
        (-r.source_count, -r.report_count, r.ip) for r in rows
    )


def test_every_check_belongs_to_a_query():
    assert set(oracle_sql()) <= set(queries())
