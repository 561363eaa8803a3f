"""Every registered query against its SQL counterpart, whole tables at sf0.01."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF_DIR}/{table}.parquet')")
    yield connection
    connection.close()


def _comparable(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(_comparable(row[i]) for i in order) for row in rows), key=lambda r: tuple((v is None, str(v)) for v in r)
    )


def test_every_query_has_an_oracle():
    assert set(entry.QUERIES) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_oracle(spark, duck, name):
    result = entry.queries()[name](spark, SF_DIR)
    relation = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in relation.description]
    assert sorted(result.columns) == sorted(columns)
    got, want = _rows(result.columns, result.collect()), _rows(columns, relation.fetchall())
    assert want, "the oracle returns no rows, so the comparison says nothing"
    assert len(got) == len(want)
    assert got == want
