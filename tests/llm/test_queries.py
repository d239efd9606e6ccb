"""Every registered query runs on the driver's smallest tables, and equals its SQL where it has one."""

import os

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from tidelog.llm import oracles, queries


def test_one_query_per_operator():
    names = list(queries.queries())
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 11))
    assert set(oracles.SQL) <= set(names) and "pipeline" in __spark_entry__.queries()


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_sql_agrees(spark, sf_dir, name):
    con = duckdb.connect()
    for t in os.listdir(sf_dir):
        con.sql(f"create view {t.split('.')[0]} as select * from '{sf_dir}/{t}'")
    rel = con.sql(oracles.SQL[name])
    columns = sorted(rel.columns)
    want = sorted((tuple(dict(zip(rel.columns, r, strict=True))[c] for c in columns) for r in rel.fetchall()), key=str)
    df = queries.queries()[name](spark, sf_dir)
    assert sorted(df.columns) == columns
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str) == want


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, {r["doc_id"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns, name
        after = {r["doc_id"] for r in docs.collect()}
        assert after <= before and len(after) > len(before) / 3, name
        before = after
    assert corpus_pipeline.run(spark, sf_dir).columns == ["doc_id", "source", "n_tokens", "ids", "decoded_sha256"]
