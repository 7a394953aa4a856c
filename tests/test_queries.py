"""Every registered query against its SQL on the same files."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from ledgerloom.plans import PLANS

ROOT = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
DRIVER_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
QUERIES = {key: q for key, q in entry_points.queries().items() if key in PLANS}
SQL = entry_points.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{ROOT}/{t}.parquet'")
    return con


def in_name_order(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_sql(spark, duck, key):
    df = QUERIES[key](spark, ROOT)
    rel = duck.sql(SQL[key])
    assert sorted(df.columns) == sorted(rel.columns)
    got, want = in_name_order(df.columns, df.collect()), in_name_order(rel.columns, rel.fetchall())
    assert got == want


def test_every_query_has_sql_and_rows(spark):
    assert set(QUERIES) == set(PLANS) <= set(SQL)


def test_entry_has_one_row(spark):
    assert entry_points.entry(spark).count() == 1
