"""Every query of the package that SQL can express against its SQL, and the pipeline."""

import os

import duckdb
import pytest

import corpus_pipeline
from ledgerloom.llm.queries import ORACLE_SQL, QUERIES

ROOT = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{ROOT}/{t}.parquet'")
    return con


@pytest.mark.parametrize("key", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, duck, key):
    df, rel = QUERIES[key](spark, ROOT), duck.sql(ORACLE_SQL[key])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    place = [rel.columns.index(c) for c in columns]
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in df.collect()))) == sorted(
        repr(tuple(r[i] for i in place)) for r in rel.fetchall())


def test_all_operators_are_registered():
    assert {k.split("_")[0] for k in QUERIES} == {f"op{n}" for n in range(1, 14)} | {"pipeline"}


def test_pipeline_keeps_less_at_each_filter_and_encodes_what_is_left(spark):
    docs, counts = spark.read.parquet(f"{ROOT}/documents.parquet"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, ROOT).cache()
        counts.append(docs.count())
        if name != "token files":
            assert docs.columns == columns
    assert counts[0] >= counts[1] >= counts[2] > 0
    assert counts[4] == counts[3]
    rows = sorted((tuple(r) for r in docs.collect()), key=lambda r: r[1])
    assert [r[1] for r in rows[1:]] == [r[1] + r[2] for r in rows[:-1]]


def test_pipeline_handles_an_empty_table(spark, tmp_path):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, ROOT)
    assert docs.count() == 0
