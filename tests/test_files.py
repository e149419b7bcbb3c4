"""Queries that go through files against their SQL, and model files in binary form."""

import json
import os
import struct

import duckdb
import numpy as np
import pytest
from test_queries import rounded

from kinloom import file_queries, oracles, streaming
from kinloom.functions import models
from kinloom.sources import segments

DATA = "/root/testdata/sf0.001"
SOME = ("vcf_scan", "vcf_scan_mac", "map_plink", "segments_binary", "segments_indexed", "dataset_file", "error_log", "program_filtered", "seeds_closeout",
        "smooth_again", "grown_candidates", "grown_segments")


def test_every_query_has_sql():
    assert set(file_queries.queries()) == set(oracles.file_sql())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", SOME)
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("nation", "part", "supplier"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.sql(oracles.file_sql()[name])
    df = file_queries.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    at = [want.columns.index(c) for c in columns]
    right = sorted((tuple(rounded(r[i]) for i in at) for r in want.fetchall()), key=str)
    assert right and sorted((tuple(rounded(r[c]) for c in columns) for r in df.collect()), key=str) == right


def test_binary_segments(spark, tmp_path):
    s = spark.createDataFrame([("20", i, i + 1, 0, 9, 100, 900 + i, 2.5) for i in range(50)], streaming.SEGMENTS).repartition(3)
    for _ in range(2):  # the second time replaces the files
        assert segments.write_binary(s, f"file:{tmp_path}/b") == 50
    back = segments.read_binary(spark, f"{tmp_path}/b")
    assert sorted(back.collect()) == sorted(s.drop("chrom").collect())
    assert segments.write_binary(s.limit(0), f"{tmp_path}/none") == 0


def packed(x) -> bytes:
    """UBJSON with lengths before keys, typed arrays and counted containers."""
    text = lambda t: struct.pack(">cq", b"L", len(t.encode())) + t.encode()
    if isinstance(x, dict):
        return b"{" + b"".join(text(k) + packed(v) for k, v in x.items()) + b"}"
    if isinstance(x, np.ndarray):
        kind = {"f": b"d", "i": b"l", "u": b"U"}[x.dtype.kind]
        return b"[$" + kind + b"#" + struct.pack(">cq", b"L", len(x)) + x.astype({b"d": ">f4", b"l": ">i4", b"U": ">u1"}[kind]).tobytes()
    if isinstance(x, list):
        return b"[#i" + bytes([len(x)]) + b"".join(packed(v) for v in x)
    if isinstance(x, str):
        return b"S" + text(x)
    return {None: b"Z", True: b"T", False: b"F"}[x]


def test_trees_in_binary_form():
    tree = {"left_children": [1, -1, -1], "right_children": [2, -1, -1], "split_indices": [0, 0, 0], "split_conditions": [1.0, -2.0, 2.0], "default_left": [0, 0, 0]}
    typed = {k: np.array(v, "f4" if k == "split_conditions" else "u1" if k == "default_left" else "i4") for k, v in tree.items()}
    model = lambda t: {"learner": {"learner_model_param": {"base_score": "[5E-1]"}, "more": [None, True, []], "gradient_booster": {"model": {"trees": [t]}}}}
    x = np.array([[0.0], [1.0], [np.nan]])
    one, two = models.Trees.parse(packed(model(typed))), models.Trees.parse(json.dumps(model(tree)))
    assert np.allclose(one.predict(x), two.predict(x))
    with pytest.raises(Exception):
        models.Trees.parse(packed(model(typed))[:-9])
