"""Every SQL-checkable query equals its DuckDB twin (rows, columns, values)."""

import pytest

import __spark_entry__ as E
from ledgerlens.plans.compare import compare, duckdb_connection

from conftest import SMALL

ORACLE = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duckdb_connection(SMALL)


def test_every_oracle_key_is_a_query():
    assert set(ORACLE) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    got = E.queries()[name](spark, SMALL).toPandas()
    want = con.sql(ORACLE[name]).df()
    ok, msg = compare(got, want)
    assert ok, msg


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 1 and rows[0]["total_revenue"] > 0
