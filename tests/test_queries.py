"""Queries of the engine against their SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from kinloom import oracles, queries

DATA = "/root/testdata/sf0.001"
SOME = ("panel_mac_filter", "gmap_interpolate", "smooth_wide_gap", "pair_mismatch_bits", "ibd_segments", "features_chunked", "eval_accum_power", "correction_confusion")


def rounded(v):
    return None if v is None or isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v


def test_every_query_has_sql():
    assert set(queries.queries()) == set(oracles.oracle_sql())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", SOME)
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("nation", "part"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.sql(oracles.oracle_sql()[name])
    df = queries.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    right = sorted((tuple(rounded(r[i]) for i in at) for r in want.fetchall()), key=str)
    assert sorted((tuple(rounded(r[c]) for c in columns) for r in df.collect()), key=str) == right


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(queries.queries()) <= set(__spark_entry__.queries())
