"""The stages one after the other, and the queries on the smallest tables."""

import os

import duckdb
import pytest

import corpus_pipeline
from kinloom.llm import queries, tokens

DATA = "/root/testdata/sf0.001"


def test_stages_keep_the_columns(spark, odd_docs, no_docs, tmp_path):
    for k, first in enumerate((odd_docs, no_docs)):
        docs = first
        for name, stage in corpus_pipeline.STAGES[:-1]:
            stage(spark, docs, "").write.parquet(str(tmp_path / f"{k}{name}"))
            docs = spark.read.parquet(str(tmp_path / f"{k}{name}"))
            assert docs.columns == first.columns
        out = corpus_pipeline.STAGES[-1][1](spark, docs, "")
        tokens_of = sum(len(tokens.ids(r.text or "", added=True)) + 1 for r in docs.select("text").collect())
        assert (out.agg({"length": "sum"}).first()[0] or 0) == tokens_of and (tokens_of == 0) == (k == 1)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_run(spark):
    out = corpus_pipeline.run(spark, DATA)
    assert out.count() > 0 and set(out.columns) >= {"doc_id", "piece", "sequence_id", "offset"}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    df = queries.queries()[name](spark, DATA)
    at = [want.columns.index(c) for c in df.columns]
    norm = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
    assert sorted(norm(r) for r in df.collect()) == sorted(norm([r[i] for i in at]) for r in want.fetchall())
