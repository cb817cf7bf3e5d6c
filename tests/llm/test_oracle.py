"""Queries of this package that have SQL give the rows that DuckDB gives on the same tables."""

import os

import duckdb
import pytest

from quern.llm.queries import ORACLE_SQL, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, name):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{DATA}/documents.parquet'")
    df = QUERIES[name](spark, DATA)
    expected = con.sql(ORACLE_SQL[name])
    order = sorted(df.columns)
    assert order == sorted(expected.columns)
    rows = lambda names, found: sorted(repr([r[list(names).index(c)] for c in order]) for r in found)
    assert rows(df.columns, df.collect()) == rows(expected.columns, expected.fetchall())
