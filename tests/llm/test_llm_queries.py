"""Every query of the subpackage against its SQL, or for its columns where SQL has none."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry_point
from tersely.llm.queries import ORACLES, QUERIES

TABLES = "documents embeddings pages benchmark labels conversations".split()
BIG = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{BIG}/{name}.parquet'")
    return connection


def test_registered():
    assert set(QUERIES) <= set(entry_point.queries())
    assert {n for n in QUERIES if n.startswith("op")} == {
        n for n in entry_point.queries() if n.startswith("op")
    }
    assert "pipeline" in entry_point.queries()


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(spark, sql, name):
    df = QUERIES[name](spark, BIG)
    columns = sorted(df.columns)
    got = [tuple(row[c] for c in columns) for row in df.collect()]
    answer = sql.execute(ORACLES[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    expected = [tuple(row[p] for p in places) for row in answer.fetchall()]
    assert got, "a query must have rows"
    order = lambda row: tuple((v is None, str(v)) for v in row)
    assert sorted(got, key=order) == sorted(expected, key=order)
