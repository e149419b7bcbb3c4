"""Clusters against the same rounds in Python's integers."""

import hashlib
import math
from fractions import Fraction

import pytest

from kinloom.llm import clustering

ROWS = "vec_id bigint, embedding array<double>, label int, cluster string"


def plain(rows, count, rounds, dims):
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of each usable row, in order of input."""
    kept = [(i, [math.floor(Fraction(x) * 256) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    by_hash = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = [x for _, x in by_hash[:count]]
    for r in range(rounds + 1):
        far = [[sum((a - b) ** 2 for a, b in zip(x, own)) for own in c] for _, x in kept]
        near = [min(range(len(c)), key=d.__getitem__) for d in far]
        if r < rounds:
            for k in range(len(c)):
                own = [x for (_, x), n in zip(kept, near) if n == k]
                if own:
                    c[k] = [sum(col) // len(own) for col in zip(*own)]
    dist = [d[k] for d, k in zip(far, near)]
    top = 2**63 - 1
    inertia = [min(sum(d for d, n in zip(dist, near) if n == k), top) for k in range(len(c))]
    sha = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    return [(i, k, min(d, top), inertia[k], min(sum(dist), top), sha[k]) for (i, _), k, d in zip(kept, near, dist)]


def compare(spark, rows, **how):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], ROWS).repartition(3)
    got = [tuple(r) for r in clustering.cluster(df, **how).collect()]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(got, key=key) == sorted(plain(rows, how.get("count", 40), how.get("rounds", 5), how.get("dims", 64)), key=key)
    return got


def some(rng, n, dims, scale=1.0):
    return [[rng.gauss(0, scale) + 3 * scale * (i % 3) for _ in range(dims)] for i in range(n)]


def test_rounds(spark):
    import random

    rng = random.Random(3)
    rows = list(enumerate(some(rng, 150, 64)))
    rows += [(500 + i, rows[0][1]) for i in range(60)]  # copies of one vector
    rows += [(7, rows[9][1]), (7, rows[8][1]), (None, rows[3][1])]  # ids that repeat or are missing
    assert {r[0] for r in compare(spark, rows)} >= {None, 7, 559}


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, None), (1, []), (2, [1.0]), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 0.0]), (6, [0.0, 0.0]), (7, [-0.0, 0.0]),
            (8, [0.001, -0.001]), (9, [1.0, 2.0, 3.0]), (10, [-1.5, 2.25])]
    got = compare(spark, rows, count=3, rounds=5, dims=2)
    assert sorted(r[0] for r in got) == [6, 7, 8, 10]
    assert compare(spark, rows, count=40, rounds=5, dims=2)
    assert compare(spark, rows[:6], count=3, dims=2) == []
    assert compare(spark, [], count=3, dims=2) == []


def test_ties_take_the_smaller_number(spark):
    rows = [(i, [float(i % 2)]) for i in range(12)]
    compare(spark, rows, count=5, rounds=3, dims=1)


@pytest.mark.parametrize("scale", [1e4, 1e5, 1e6, 1e7, 1e12, 1e30, 1e300])
def test_every_magnitude_is_exact(spark, scale):
    """Beyond the product's bound in 64-bit integers, then in Python's; rows of several kinds in one table."""
    import random

    rng = random.Random(int(math.log10(scale)))
    rows = list(enumerate(some(rng, 30, 3) + some(rng, 30, 3, scale)))
    compare(spark, rows, count=4, rounds=5, dims=3)


def test_kinds_of_rows():
    near = clustering.Nearest([(0, 0), (256, 256)], 256)
    import numpy as np

    kinds = [x.dtype for _, x, _, _ in near.rows(np.array([[0.5, 0.5], [3e5, 1.0], [1e9, 0.0], [1e20, 1.0]]))]
    assert len(kinds) == 3 and kinds[-1] == object
