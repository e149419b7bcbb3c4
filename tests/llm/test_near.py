"""Near-duplicate documents and embeddings against comparison of all pairs."""

import re

import numpy as np
import pytest

from kinloom.llm import bytehash, common, embeddings, neardup


def least_reachable(ids, links):
    to = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(to[a], to[b])
            if to[a] != m or to[b] != m:
                to[a] = to[b] = m
                changed = True
    return to


def shingle_set(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    k = min(k, len(w))
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


@pytest.mark.parametrize("k", [2, 5])
@pytest.mark.parametrize("region", [512, 3])
def test_components(spark, random_docs, monkeypatch, k, region):
    monkeypatch.setattr(neardup, "REGION", region)
    docs = {r.doc_id: shingle_set(r.text, k) for r in random_docs.collect()}
    links = [(a, b) for a in docs for b in docs if a < b and docs[a] and 100 * len(docs[a] & docs[b]) >= 80 * len(docs[a] | docs[b])]
    want = least_reachable(docs, links)
    got = {r.doc_id: r for r in neardup.components(random_docs, shingle=k).collect()}
    assert {i: got[i].n_shingles for i in docs} == {i: len(s) for i, s in docs.items()}
    assert {i: got[i].component_id for i in docs} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_a_large_group_of_near_copies(spark):
    """Copies of one text with a few words changed, more than a region holds."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(700):
        own = list(base)
        for j in rng.choice(100, 2, replace=False):
            own[j] = f"x{rng.integers(1 << 30)}"
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    sets = [shingle_set(t, 2) for _, t in rows]
    links = [(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = least_reachable(range(len(sets)), links)
    got = {r.doc_id: r.component_id for r in neardup.components(docs, shingle=2).collect()}
    assert got == want


def test_documents_that_hang_on_one_member_of_a_large_group(spark, monkeypatch):
    """Each is over 0.8 to one of many close copies and below that to all others."""
    monkeypatch.setattr(neardup, "REGION", 16)
    rng = np.random.default_rng(5)
    n, words, own = 400, 300, 2
    rows = [" ".join(f"w{j}" for j in range(words)) + " " + " ".join(f"o{i}x{j}" for j in range(own)) for i in range(n)]
    for i in range(0, n, 20):
        text = rows[i].split()
        for j in rng.choice(words, 20, replace=False):
            text[j] = f"y{rng.integers(1 << 30)}"
        for _ in range(30):
            text.append(f"z{rng.integers(1 << 30)}")
        rows.append(" ".join(text))
    sets = [shingle_set(t, 1) for t in rows]
    like = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    for k in range(n, len(rows)):
        assert [i for i in range(n) if like(i, k) >= 0.8] == [20 * (k - n)]
        assert not any(like(i, k) >= 0.8 for i in range(n, len(rows)) if i != k)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    got = neardup.components(docs, shingle=1).collect()
    assert {r.component_id for r in got} == {0} and sum(r.kept for r in got) == 1


def test_odd_documents(odd_docs, no_docs):
    got = sorted(neardup.components(odd_docs, shingle=2).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    by = {r.doc_id: r for r in got}
    assert len(got) == odd_docs.count()
    assert [by[i].component_id for i in (0, 1, 5, 6, 8, 9)] == [0, 0, 5, 5, 8, 8]
    assert [(by[i].n_shingles, by[i].kept) for i in (2, 3, 4)] == [(0, True)] * 3
    assert by[None].component_id is None and not by[None].kept
    assert neardup.components(no_docs).count() == 0
    kept = neardup.deduplicated(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == [-1, 0, 2, 3, 4, 5, 7, 8, 10, 12]


def test_semi_join_by_bitmap_or_by_shuffle(spark, monkeypatch):
    df = spark.createDataFrame([(i,) for i in (-70_000, -1, 0, 1, 32_768, 32_769, 10**12, None)], "x bigint")
    ids = spark.createDataFrame([(i,) for i in (-1, 1, 32_769, 10**12, 5, None)], "y bigint")
    for size in (1 << 20, 0):
        monkeypatch.setattr(common, "BITMAP_BYTES", size)
        assert sorted(r.x for r in common.among(df, "x", ids).collect()) == [-1, 1, 32_769, 10**12]


def test_connected_components(spark):
    rng = np.random.default_rng(5)
    links = [tuple(int(v) for v in rng.integers(0, 300, 2)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1200)] + [(5000, i) for i in range(5001, 5200)]
    edges = spark.createDataFrame(links + [(7, 7), (None, 3)], "a bigint, b bigint")
    nodes = {x for ab in links for x in ab if ab[0] != ab[1]}
    want = least_reachable(nodes, [ab for ab in links if ab[0] != ab[1]])
    assert {r.id: r.component for r in common.connected_components(edges).collect()} == want
    assert common.connected_components(edges.limit(0)).count() == 0


def test_word_hashes_depend_on_words_only():
    import pyarrow as pa

    a, b, c = bytehash.sets(pa.array(["A b  c", "xx a\tB c", None]), 2)
    assert len(a) == 2 and len(b) == 3 and len(c) == 0 and set(a) <= set(b)


def brute_vectors(rows, least):
    ok = {}
    for k, (i, v) in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            u = np.array(v, float)
            ok[k] = u / np.sqrt((u * u).sum())
    n = [0] * len(rows)
    links = []
    for a in ok:
        for b in ok:
            if a < b and len(ok[a]) == len(ok[b]) and float(ok[a] @ ok[b]) >= least:
                n[a] += 1
                n[b] += 1
                links.append((rows[a][0], rows[b][0]))
    return n, links


@pytest.mark.parametrize("cells", [1000, 20])
def test_vectors(spark, monkeypatch, cells):
    monkeypatch.setattr(embeddings, "CELL_ROWS", cells)
    monkeypatch.setattr(embeddings, "OWN_ROWS", 40)
    monkeypatch.setattr(embeddings, "GUEST_ROWS", 70)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(150, 16))
    near = base[rng.integers(0, 20, 150)] + rng.normal(size=(150, 16)) * rng.choice([0.02, 0.1, 0.2, 0.25], (150, 1))
    vectors = [[float(np.float32(x)) for x in v] for v in np.vstack([base, near, base[:10], 3 * base[:5]])]
    rows = [(7 * i % 1009, v) for i, v in enumerate(vectors)]
    n, links = brute_vectors(rows, 0.95)
    want = least_reachable([i for i, _ in rows], links)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = {r.vec_id: r for r in embeddings.near_duplicates(df).collect()}
    assert {i: got[i].n_links for i, _ in rows} == {i: k for (i, _), k in zip(rows, n)}
    assert {i: got[i].component_id for i, _ in rows} == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_odd_vectors(spark):
    kind = "vec_id bigint, embedding array<float>, key string, v int"
    rows = [(1, [1.0, 0.0], "k", 1), (2, [2.0, 0.0], "k", 1), (3, None, None, None), (4, [0.0, 0.0], "k", 1), (5, [1.0, None], "k", 1),
            (6, [float("nan"), 1.0], "k", 1), (7, [float("inf"), 1.0], "k", 1), (8, [1.0, 0.0, 0.0], "k", 1), (9, [], "k", 1), (10, [1.0, 0.0], "k", 1)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(spark.createDataFrame(rows, kind)).collect()}
    assert got == {1: (2, 1, True), 2: (2, 1, False), 10: (2, 1, False)} | {i: (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9)}
    assert embeddings.near_duplicates(spark.createDataFrame(rows, kind).limit(0)).count() == 0
