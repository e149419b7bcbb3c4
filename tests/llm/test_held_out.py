"""Learned operators on the driver's tables: held-out documents only."""

import os

import pyarrow.parquet as pq
import pytest

from kinloom.llm import queries

DATA = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def test_languages_of_held_out_documents(spark):
    langs = {r["doc_id"]: r["lang"] for r in pq.read_table(f"{DATA}/documents.parquet", columns=["doc_id", "lang"]).to_pylist()}
    rows = [r for r in queries.op7_language(spark, DATA).collect() if r.held_out and langs[r.doc_id] and r.lang_pred != "und"]
    assert len(rows) > 200 and sum(r.lang_pred == langs[r.doc_id] for r in rows) >= 0.95 * len(rows)


def test_quality_of_held_out_documents(spark):
    """The chance that a good document is scored over a bad one."""
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{DATA}/labels.parquet").to_pylist() if r["quality"] is not None}
    rows = [r for r in queries.op8_quality(spark, DATA).collect() if r.held_out and r.doc_id in labels]
    good, bad = ([r.score for r in rows if labels[r.doc_id] == y] for y in (1, 0))
    assert len(good) > 20 and len(bad) > 5
    assert sum((g > b) + (g == b) / 2 for g in good for b in bad) >= 0.9 * len(good) * len(bad)
