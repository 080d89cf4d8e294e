"""Every query of the library against its SQL on the smallest tables."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb
import pytest

import __spark_entry__

FOLDER = "/root/testdata/sf0.001"
LIBRARY = __spark_entry__._library()


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else int(value) if value.is_integer() else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for name in os.listdir(FOLDER):
        connection.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{name}'")
    return connection


@pytest.mark.parametrize("name", sorted(LIBRARY.ORACLES))
def test_matches_sql(spark, tables, name):
    found = LIBRARY.QUERIES[name](spark, FOLDER)
    columns = sorted(found.columns)
    expected = tables.sql(LIBRARY.ORACLES[name])
    assert sorted(expected.columns) == columns
    places = [expected.columns.index(c) for c in columns]
    got = sorted(repr(tuple(map(plain, row))) for row in found.select(columns).collect())
    assert got == sorted(repr(tuple(plain(row[i]) for i in places)) for row in expected.fetchall())


@pytest.mark.parametrize("name", sorted(set(LIBRARY.QUERIES) - set(LIBRARY.ORACLES)))
def test_runs_without_sql(spark, name):
    assert LIBRARY.QUERIES[name](spark, FOLDER).count() > 0


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0
