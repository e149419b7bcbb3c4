"""Likeness of fingerprints against the exact cosine of the multisets of runs, and both ways to sum."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from kinloom.llm import fingerprints


def multiset(text):
    out = Counter()
    for line in text.split("\n"):
        w = line.split()
        out.update(" ".join(w[i:i + 4]) for i in range(len(w)))
    return out


def cosine(a, b):
    x, y = multiset(a), multiset(b)
    norm = np.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
    return sum(v * y[k] for k, v in x.items()) / norm if norm else 0.0


def test_likeness_is_near_the_cosine(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(60):
        a = [f"w{v}" for v in rng.integers(0, 2000, 300)]
        b = list(a)
        for at in rng.integers(0, 300, k):
            b[at] = f"x{rng.integers(1 << 20)}"
        if k % 3 == 0:
            b.insert(0, "inserted")
        rows.append((k, " ".join(a), " ".join(b[:150]) + "\n" + " ".join(b[150:])))
    df = spark.createDataFrame(rows, "k int, a string, b string")
    for c in "ab":
        df = fingerprints.with_fingerprint(df, c, c)
    df = fingerprints.with_signs(df, "a", "b")
    got = {r.k: r.v for r in df.select("k", fingerprints.likeness("a", "b").alias("v")).collect()}
    off = [got[k] - cosine(a, b) for k, a, b in rows]
    assert np.sqrt(np.mean(np.square(off))) < 0.12 and max(map(abs, off)) < 0.4
    assert got[0] > 0.9  # one word before a long line changes one run


def test_both_ways_to_sum_agree(odd_docs, monkeypatch):
    monkeypatch.setattr(fingerprints, "SUMMED", 100)
    df = fingerprints.with_fingerprint(odd_docs.select(F.monotonically_increasing_id().alias("k"), "text"), "text", "a")
    want = {r.k: (r.asketch, r.an) for r in df.collect()}
    runs = odd_docs.select(F.monotonically_increasing_id().alias("k"), fingerprints.runs(F.coalesce("text", F.lit(""))).alias("r"))
    got = {r.k: (r.sketch, r.n) for r in fingerprints.sketched(runs, ["k"], "r").collect()}
    assert got == want and any(n > 20_000 for _, n in got.values())


def test_splits_of_ids(spark):
    df = spark.range(1000).selectExpr("id AS v").unionAll(spark.sql("SELECT CAST(NULL AS bigint)"))
    for splits in ([], [5], list(range(0, 1000, 7))):
        got = {r.v: r.r for r in df.select("v", fingerprints.range_of(F.col("v"), splits).alias("r")).collect()}
        assert got == {v: -1 if v is None else sum(s < v for s in splits) for v in got}


def test_next_documents_over_several_ranges(spark, monkeypatch):
    monkeypatch.setattr(fingerprints.id_splits, "__defaults__", (8, 4096))
    docs = spark.createDataFrame([(i, f"a b c d e f g h {i // 2}") for i in range(200)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(docs).collect()}
    for i in range(200):
        n = got[(i - 1) % 200]
        assert (got[i].near_next == 1.0) == (got[i].fingerprint == n.fingerprint) == (i % 2 == 1)
