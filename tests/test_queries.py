"""Every query beside its SQL, over the smallest tables."""

from __future__ import annotations

import decimal
import os

import duckdb
import pytest

from tests.conftest import SF
from tidebook.plans.queries import ORACLE_SQL, QUERIES


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, float, decimal.Decimal)):
        return float(value) + 0.0
    return value


def rows_of(columns, rows):
    place = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(plain(r[i]) for i in place) for r in rows), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sql, name):
    frame, want = QUERIES[name](spark, SF), sql.sql(ORACLE_SQL[name])
    assert sorted(frame.columns) == sorted(want.columns)
    assert rows_of(frame.columns, frame.collect()) == rows_of(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
