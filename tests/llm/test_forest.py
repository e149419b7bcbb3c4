"""The LSH forest on texts that share most of their words."""

import numpy as np
import pyarrow as pa
import pytest

from kinloom.llm import common, neardup


def planted(n, seed=1):
    """``n`` texts with 100 words in common, similar to 0.78; every two neighbours have 5 of the other 14 in common, and 0.82."""
    rng = np.random.default_rng(seed)
    shared = [f"s{i}" for i in range(100)]
    rows = []
    for k in range(n // 2):
        both = [f"b{k}x{j}" for j in range(5)]
        for side in "lr":
            words = shared + both + [f"{side}{k}x{j}" for j in range(9)]
            rows.append(" ".join(np.array(words)[rng.permutation(len(words))]))
    return rows


@pytest.mark.parametrize("n,region", [(400, 32), (400, 512), (1600, 64)])
def test_pairs_among_texts_that_are_nearly_similar(spark, monkeypatch, n, region):
    """No link is lost whatever the size of the regions, and no stranger is linked."""
    monkeypatch.setattr(neardup, "REGION", region)
    docs = spark.createDataFrame(list(enumerate(planted(n))), "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in neardup.components(docs, shingle=1, num=82).collect()}
    assert got == {i: i - i % 2 for i in range(n)}


def test_common_prefixes_of_sorted_labels():
    rng = np.random.default_rng(2)
    raw = sorted(rng.integers(0, 3, (60, neardup.DEPTH)).astype(">u4").tolist())
    got = neardup.common_prefixes(pa.array([np.array(x, ">u4").tobytes() for x in raw], pa.binary()))
    for k in range(1, len(raw)):
        assert got[k] == next((j for j, (a, b) in enumerate(zip(raw[k - 1], raw[k])) if a != b), neardup.DEPTH)
    assert got[0] == 0


def test_subtrees_are_as_deep_as_their_region_needs(spark, monkeypatch):
    monkeypatch.setattr(neardup, "REGION", 8)
    docs = spark.createDataFrame([(i, f"same words here and there, all of them {'x' if i < 60 else i}") for i in range(80)], "doc_id bigint, text string")
    f = neardup.features(docs, 1).where("n > 0").selectExpr("doc_id AS rep", "n", "s0", "s1", "labels")
    rows = neardup.forest(f)
    assert rows.count() == 80 * neardup.TREES
    out, large = neardup.subtrees(rows)
    by = {}
    for r in out.collect():
        by.setdefault(r.g, set()).add(r.rep)
    assert max(map(len, by.values())) <= 2 * 8 + 10 and set.union(*by.values()) == set(range(80))
    assert large.select("rep").distinct().count() >= 60


def test_components_that_do_not_converge_raise(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(64)], "a bigint, b bigint")
    with pytest.raises(RuntimeError):
        common.connected_components(chain, max_rounds=1)
    assert {r.component for r in common.connected_components(chain).collect()} == {0}
