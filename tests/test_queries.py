"""Every registered query that has SQL gives the rows that DuckDB gives on the same tables."""

import os

import duckdb
import pytest

from quern.plans import catalog, checks, history, recipes, records, stored, texts  # noqa: F401
from quern.plans.registry import ORACLE_SQL, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def same(columns, rows):
    order = sorted(columns)
    return order, sorted(tuple(repr(r[columns.index(c)]) for c in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = same(df.columns, [tuple(r) for r in df.collect()])
    expected = duck.sql(ORACLE_SQL[name])
    assert got == same(list(expected.columns), expected.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
