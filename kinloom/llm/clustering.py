"""Centroid clustering of integer vectors, exact whatever the order of the rows.

Components are scaled and floored to integers, so sums and distances have one
right value. Distances come from the expansion |x|^2 - 2 x.c + |c|^2 with one
matrix product for a block of rows: in double precision it is exact as long as
``dims * (max|x| + max|c|)^2`` stays below 2^53. Rows beyond that bound are
compared in 64-bit integers, and rows beyond the bound of those in Python's.

A round reads the vectors once and moves none of them: each task folds its rows
into a count and a sum for each centroid, a tree of tasks merges these, and the
driver holds the centroids alone. A lost executor costs the tasks it ran.

Defined results: vectors that are null, have another length, or hold null or
non-finite components are left out; repeated rows count as often as they occur;
rows that share an id are rows of their own, and among equal hashes the start is
the smaller vector; a null id is hashed as an empty one; with fewer vectors than
centroids there are as many centroids as vectors; distances and inertias that
exceed a long are its largest value; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, tree_fold

DIMS, CENTROIDS, ROUNDS, SCALE, SEED = 64, 40, 5, 256, "2:"
#: Integers up to here are exact in double precision.
EXACT = 1 << 53
LONG_MAX = (1 << 63) - 1
COLUMNS = {"cluster": "int", "distance": "bigint", "cluster_inertia": "bigint", "inertia": "bigint", "centroid_sha256": "string"}


def usable(vector: Column, dims: int) -> Column:
    """Whether a vector has ``dims`` components, all finite."""
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == dims) & fine, F.lit(False))


def raw_rows(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a list column are usable, and their components in double precision."""
    ok = np.asarray(pc.fill_null(pc.equal(pc.list_value_length(column), dims), False))
    flat = column.filter(pa.array(ok)).flatten().cast(pa.float64())
    x = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False).reshape(-1, dims)
    fine = np.isfinite(x).all(axis=1)
    ok[ok] = fine
    return ok, x[fine]


def floored(x: float, scale: int) -> int:
    """The exact floor of ``scale * x``, for a power of two."""
    return int(np.floor(x * scale)) if abs(x) < EXACT else int(x) * scale


class Nearest:
    """The nearest of some integer centroids, by the cheapest arithmetic that is exact for a row."""

    def __init__(self, centroids: list[tuple[int, ...]], scale: int):
        self.scale, self.centroids = scale, centroids
        self.most = max((abs(v) for c in centroids for v in c), default=0)
        self.fits = self.most < 1 << 62
        if self.fits:
            self.c = np.array(centroids, np.int64)
            self.c_float = self.c.astype(np.float64)
            self.c_square = (self.c_float * self.c_float).sum(axis=1)

    def rows(self, raw: np.ndarray):
        """``(places, x, cluster, distance)`` of the rows of each kind; x and the distances are integers."""
        # a bound of each row's magnitude, in double precision and so rounded up by a margin
        with np.errstate(over="ignore"):
            reach = (np.abs(raw).max(axis=1, initial=0) * self.scale + 1 + float(self.most)) * (1 + 1e-9)
            bound = reach * reach * raw.shape[1]
        product = bound < EXACT
        whole = ~product & (bound < 1 << 62) & self.fits
        for kind, chosen in ((self._by_product, product), (self._by_integers, whole), (self._by_python, ~product & ~whole)):
            at = np.flatnonzero(chosen)
            if len(at):
                yield at, *kind(raw[at])

    def _by_product(self, raw):
        x = np.floor(raw * self.scale)
        d = (x * x).sum(axis=1)[:, None] - 2 * (x @ self.c_float.T) + self.c_square
        k = d.argmin(axis=1)
        return x.astype(np.int64), k, d[np.arange(len(x)), k].astype(np.int64)

    def _by_integers(self, raw):
        x = np.floor(raw * self.scale).astype(np.int64)
        d = np.stack([((x - c) ** 2).sum(axis=1) for c in self.c], axis=1)
        k = d.argmin(axis=1)
        return x, k, d[np.arange(len(x)), k]

    def _by_python(self, raw):
        x = np.array([[floored(v, self.scale) for v in row] for row in raw.tolist()], object)
        d = [[sum((a - b) ** 2 for a, b in zip(row, c)) for c in self.centroids] for row in x]
        k = np.array([min(range(len(own)), key=own.__getitem__) for own in d])
        return x, k, np.array([own[i] for own, i in zip(d, k)], object)


def totals(vectors: DataFrame, nearest: Nearest, dims: int):
    """Counts, sums and summed distances of the clusters, as Python's integers; none without rows."""
    k = len(nearest.centroids)

    def fold(batches):
        count, total, inertia = (np.zeros(shape, object) for shape in (k, (k, dims), k))
        for b in batches:
            _, raw = raw_rows(b.column(0), dims)
            for _, x, cluster, distance in nearest.rows(raw):
                order = np.argsort(cluster, kind="stable")
                own, starts = np.unique(cluster[order], return_index=True)
                count[own] += np.diff(np.append(starts, len(order))).astype(object)
                total[own] += _sums(x[order], starts)
                inertia[own] += _sums(distance[order], starts)
        return count, total, inertia

    return tree_fold(vectors.select("embedding"), fold, lambda a, b: tuple(p + q for p, q in zip(a, b)))


def _sums(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the runs of rows that begin at ``starts``; whole numbers of any size."""
    if x.dtype != object and float(np.abs(x).max()) * len(x) >= 1 << 62:
        x = x.astype(object)
    return np.add.reduceat(x, starts, axis=0).astype(object)


def first_centroids(vectors: DataFrame, count: int, dims: int, scale: int, seed: str) -> list[tuple[int, ...]]:
    """The vectors whose ids have the smallest hashes, a fixed number of rows."""
    key = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.where(usable(F.col("embedding"), dims)).select(key.alias("key"), F.col("embedding").cast("array<double>").alias("v"))
    return [tuple(floored(c, scale) for c in r.v) for r in rows.orderBy("key", "v").limit(count).collect()]


def fit(vectors: DataFrame, count: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: str = SEED) -> list[tuple[int, ...]]:
    """Integer centroids of ``vectors(vec_id, embedding)`` after the rounds; an empty cluster keeps its centroid."""
    centroids = first_centroids(vectors, count, dims, scale, seed)
    for _ in range(rounds if centroids else 0):
        n, total, _ = totals(vectors, Nearest(centroids, scale), dims)
        moved = [tuple(int(s) // int(m) for s in own) if m else c for m, own, c in zip(n, total, centroids)]
        if moved == centroids:
            break  # the other rounds would find the same
        centroids = moved
    return centroids


def cluster(vectors: DataFrame, count: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: str = SEED) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of each usable vector."""
    bound_batches(vectors.sparkSession)
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    centroids = fit(vectors, count, rounds, dims, scale, seed)
    if not centroids:
        return vectors.where("false").selectExpr("vec_id", *(f"cast(null as {kind}) {name}" for name, kind in COLUMNS.items()))
    nearest = Nearest(centroids, scale)
    inertia = totals(vectors, nearest, dims)[2]
    own = pa.array([min(int(i), LONG_MAX) for i in inertia], pa.int64())
    every = min(int(sum(inertia)), LONG_MAX)
    digest = pa.array([hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids], pa.string())

    def run(batches):
        for b in batches:
            ok, raw = raw_rows(b.column(1), dims)
            if not len(raw):
                continue
            number, distance = np.zeros(len(raw), np.int32), np.zeros(len(raw), np.int64)
            for at, _, k, d in nearest.rows(raw):
                number[at] = k
                distance[at] = np.minimum(d, LONG_MAX) if d.dtype == object else d
            at = pa.array(number)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).filter(pa.array(ok)), at, pa.array(distance), own.take(at), pa.array(np.full(len(raw), every, np.int64)), digest.take(at)],
                names=["vec_id", *COLUMNS])

    return vectors.mapInArrow(run, ", ".join(["vec_id bigint", *(f"{name} {kind}" for name, kind in COLUMNS.items())]))


def oracle(count: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: str = SEED) -> str:
    """Plain SQL: all distances, one table for each round."""
    steps = [f"""v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda c: floor({scale} * c::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
e AS MATERIALIZED (SELECT vec_id, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM v),
c0 AS MATERIALIZED (
  SELECT k, unnest(x) AS c, generate_subscripts(x, 1) AS i
  FROM (SELECT row_number() OVER (ORDER BY sha256('{seed}' || vec_id::VARCHAR)) - 1 AS k, x FROM v ORDER BY k LIMIT {count}))"""]
    for r in range(rounds + 1):
        steps.append(f"""d{r} AS MATERIALIZED (
  SELECT vec_id, k, sum((x - c) * (x - c))::BIGINT AS d FROM e JOIN c{r} USING (i) GROUP BY ALL),
a{r} AS MATERIALIZED (
  SELECT vec_id, k, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, k) = 1)""")
        if r < rounds:
            steps.append(f"""s{r} AS (SELECT k, i, sum(x)::HUGEINT AS s, count(*) AS n FROM e JOIN a{r} USING (vec_id) GROUP BY ALL),
c{r + 1} AS MATERIALIZED (
  SELECT k, i, CASE WHEN n IS NULL THEN c ELSE (s - ((s % n) + n) % n) // n END::BIGINT AS c FROM c{r} LEFT JOIN s{r} USING (k, i))""")
    return "WITH " + ",\n".join(steps) + f""",
own AS (SELECT k, sum(d)::BIGINT AS cluster_inertia FROM a{rounds} GROUP BY k),
digest AS (SELECT k, sha256(string_agg(c::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY k)
SELECT vec_id, k::INT AS cluster, d AS distance, cluster_inertia, (SELECT sum(d) FROM a{rounds})::BIGINT AS inertia, centroid_sha256
FROM a{rounds} JOIN own USING (k) JOIN digest USING (k)"""
