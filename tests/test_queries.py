"""Every registered query against its SQL, on whole tables."""

from __future__ import annotations

import datetime
import decimal

import duckdb
import pytest

import __spark_entry__ as entry_point
from tersely.plans.oracles import ORACLES
from tersely.plans.queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def sql(sf):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, (float, decimal.Decimal)):
        return round(float(value), 6)
    if isinstance(value, (datetime.date, datetime.datetime)):
        return str(value)
    return value


def ordered(rows):
    return sorted(rows, key=lambda row: tuple((v is None, str(type(v)), str(v)) for v in row))


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_point.queries())
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf, sql, name):
    df = entry_point.queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = [tuple(plain(row[c]) for c in columns) for row in df.collect()]
    answer = sql.execute(entry_point.oracle_sql()[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    expected = [tuple(plain(row[p]) for p in places) for row in answer.fetchall()]
    assert got, "a query must have rows"
    assert ordered(got) == ordered(expected)


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
