"""Every catalog query against its SQL statement, on the smallest tables (short-series branches)."""

import os
import sys

import duckdb
import pytest
from paths import TESTDATA

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from check import TABLES, normal

from __spark_entry__ import oracle_sql, queries

STATEMENTS = oracle_sql()
QUERIES = queries()


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(TESTDATA):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"create view {t} as select * from '{TESTDATA}/{t}.parquet'")
    return c


def test_statements_belong_to_queries():
    assert set(STATEMENTS) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(STATEMENTS))
def test_matches_sql(spark, con, name):
    got = QUERIES[name](spark, TESTDATA).toPandas()
    expected = con.execute(STATEMENTS[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert len(got) == len(expected)
    a, b = normal(got), normal(expected)
    assert {c: int((a[c] != b[c]).sum()) for c in a.columns if (a[c] != b[c]).any()} == {}
