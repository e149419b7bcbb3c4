"""Whitening against eigenvectors of a covariance in Python's fractions."""

import math
from fractions import Fraction

import numpy as np
import pytest

from kinloom.llm import whitening

ROWS = "vec_id bigint, embedding array<double>, label int, n string"


def check(spark, rows, dims, most=16, scale=64, shift=1_000_000):
    """Compares all rows of one length; returns them by component."""
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], ROWS).repartition(3)
    got = whitening.whiten(df, most).collect()
    kept = [(i, [math.floor(Fraction(c) * scale) + shift for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    kept = [r for r in kept if len(r[1]) == dims]
    got = [r for r in got if r.vec_id in {i for i, _ in kept}]
    fit = sorted({tuple(x) for _, x in kept})
    n, s = len(fit), [sum(col) for col in zip(*fit)]
    mean = [Fraction(v, n) for v in s]
    centred = [[v - m for v, m in zip(x, mean)] for x in fit]
    cov = np.array([[float(sum(x[a] * x[b] for x in centred) / n) for b in range(dims)] for a in range(dims)])
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(most, int((values > values[0] * 1e-12).sum()))
    assert len(got) == len(kept) * k
    by = {}
    for r in got:
        by.setdefault(r.component, []).append(r)
    far = {i: sum((n * v - t) ** 2 for v, t in zip(x, s)) for i, x in kept}
    for j in range(k):
        own = sorted(by[j + 1], key=lambda r: r.vec_id)
        want = np.array([sum(float(v - m) * u for v, m, u in zip(x, mean, vectors[:, j])) for _, x in sorted(kept)]) / math.sqrt(values[j])
        mine = np.array([r.whitened for r in own])
        sign = np.sign(want @ mine)
        assert np.allclose(mine, sign * want, rtol=1e-6, atol=1e-6)
        for r in own:
            assert r.n == n and r.deviation == (far[r.vec_id] if far[r.vec_id] < 2**63 else None)
            assert r.explained == pytest.approx(values[j] / values.sum(), rel=1e-6) and r.identity_error < 1e-9
    return by


def test_components(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((200, 20)) @ np.diag(np.linspace(3, 0.2, 20)) @ rng.standard_normal((20, 20))
    rows = list(enumerate(x.tolist()))
    rows += [(1000 + i, rows[0][1]) for i in range(100)] + [(2000, None), (2001, [float("nan")] * 20), (2002, [None] + [0.0] * 19), (2003, [float("inf")] * 20)]
    by = check(spark, rows, 20)
    assert sorted(by) == list(range(1, 17)) and by[1][0].n == 200


def test_few_rows_and_no_variance(spark):
    rows = [(0, [1.0, 2.0, 5.0]), (1, [2.0, 1.0, 5.0]), (2, [0.5, 0.25, 5.0])]
    assert sorted(check(spark, rows, 3)) == [1, 2]  # three vectors vary in two directions
    one = spark.createDataFrame([(0, [1.0, 2.0], 1, "x"), (1, [1.0, 2.0], 1, "x"), (2, [], 1, "x")], ROWS)
    assert whitening.whiten(one).count() == 0
    assert whitening.whiten(one.limit(0)).count() == 0


def test_lengths_apart(spark):
    rng = np.random.default_rng(2)
    rows = list(enumerate(rng.standard_normal((40, 3)).tolist())) + list(enumerate(rng.standard_normal((30, 2)).tolist(), 100))
    assert len(check(spark, rows, 3)) == 3 and len(check(spark, rows, 2)) == 2


@pytest.mark.parametrize("size", [1e6, 1e11, 1e15])
def test_magnitudes(spark, size):
    rng = np.random.default_rng(3)
    rows = list(enumerate((size * rng.standard_normal((50, 4))).tolist()))
    check(spark, rows, 4)


def test_entries_beyond_a_long_drop_the_row(spark):
    df = spark.createDataFrame([(0, [1e300, 1.0], 1, "x"), (1, [1.0, 2.0], 1, "x"), (2, [3.0, 1.0], 1, "x")], ROWS)
    assert {r.vec_id for r in whitening.whiten(df).collect()} == {1, 2}
