"""Whitening of embeddings by a QR factorisation in a tree of tasks.

Entries are scaled and floored to integers, so the sums over the fit list (each
different vector once) are exact, and so is every entry of ``n x - S`` before
it is divided by n. Each task factors its centred rows block by block and keeps
the triangular R alone; a tree of tasks stacks and factors two R at a time. The
singular vectors of the last R are the components, its squared singular values
over n the eigenvalues: the covariance itself, which would square the condition
number, is never formed. What leaves a task has ``dims`` rows at most.

Defined results: rows whose vector is null, or holds entries that are null,
non-finite or too large for a long after scaling, are dropped; vectors of
another length are whitened among themselves; repeated rows are returned each,
and count once in the fit list; components without variance (a table of one
vector has no others) are left out; a deviation beyond a long is null; empty
vectors have no components; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import shared_folder
from .common import bound_batches, tree_fold

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Scaled entries below this are turned into a long.
MOST = float(1 << 60)
LONG_MAX = (1 << 63) - 1


def integers(vectors: DataFrame, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """``vec_id, x``: the usable vectors as integers."""
    fine = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(MOST / scale)))
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * F.lit(float(scale))).cast("long") + F.lit(shift).cast("long"))
    return vectors.where(F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def by_length(column: pa.Array):
    """``(dims, places, x)`` for the rows of each length of a list column of longs."""
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    for dims in np.unique(lengths):
        at = np.flatnonzero(lengths == dims)
        if dims:
            yield int(dims), at, column.take(pa.array(at)).flatten().to_numpy().reshape(-1, dims)


def exact_sums(x: np.ndarray) -> np.ndarray:
    """Sums of the columns as Python's integers."""
    if len(x) * float(np.abs(x).max()) >= 1 << 62:
        x = x.astype(object)
    return x.sum(axis=0).astype(object)


def deviations(x: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    """The exact ``n x - S``, in 64-bit integers if they hold it and in Python's otherwise."""
    if n * float(np.abs(x).max()) + float(max(map(abs, total))) < 1 << 62:
        return n * x - total.astype(np.int64)
    return n * x.astype(object) - total


def centred(x: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    d = deviations(x, n, total)
    return (d / n).astype(np.float64)


def folded(fit: DataFrame, one, two) -> dict:
    """One value for each length of the rows of ``fit(x)``: ``one`` takes the length, its value or None, and rows; ``two`` merges values."""

    def fold(batches):
        held: dict = {}
        for b in batches:
            for dims, _, x in by_length(b.column(0)):
                held[dims] = one(dims, held.get(dims), x)
        return held

    def merge(a, b):
        return {d: two(a[d], b[d]) if d in a and d in b else (a if d in a else b)[d] for d in {*a, *b}}

    return tree_fold(fit, fold, merge) or {}


def triangle(*rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(np.vstack(rows), mode="r")


class Space:
    """What whitens the vectors of one length."""

    def __init__(self, n: int, total: np.ndarray, r: np.ndarray, most: int):
        _, s, right = np.linalg.svd(r, full_matrices=False)
        values = s * s / n
        kept = min(most, int((s > s[0] * max(r.shape) * np.finfo(float).eps).sum())) if len(s) and s[0] > 0 else 0
        right = right[:kept]
        # of the two unit vectors, the one whose largest entry is positive
        sign = np.sign(right[np.arange(kept), np.abs(right).argmax(axis=1)]) if kept else np.ones(0)
        self.n, self.total = n, total
        self.turn = (right * sign[:, None]).T / np.sqrt(values[:kept])
        self.explained = values[:kept] / values.sum() if kept else np.zeros(0)
        self.identity_error = 0.0

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.total) @ self.turn


def fit_spaces(rows: DataFrame, most: int = COMPONENTS) -> dict[int, Space]:
    """A space for each length of ``rows(x)``, fitted to its different vectors."""
    spark = rows.sparkSession
    with shared_folder(spark) as path:
        rows.select("x").distinct().write.parquet(path)
        fit = spark.read.schema("x array<bigint>").parquet(path)
        sums = folded(fit, lambda d, held, x: _added(held, (len(x), exact_sums(x))), _added)
        r = folded(fit, partial(_factored, sums), triangle)
        spaces = {d: Space(*sums[d], r[d], most) for d in sums}
        grams = folded(fit, partial(_gram, spaces), np.add)
    for d, s in spaces.items():
        k = len(s.explained)
        s.identity_error = float(np.abs(grams[d] / s.n - np.eye(k)).max()) if k else 0.0
    return spaces


def _added(a, b):
    return b if a is None else (a[0] + b[0], a[1] + b[1])


def _factored(sums, dims, held, x):
    rows = centred(x, *sums[dims])
    return triangle(rows) if held is None else triangle(held, rows)


def _gram(spaces, dims, held, x):
    w = spaces[dims].whitened(x)
    return w.T @ w if held is None else held + w.T @ w


def squared(d: np.ndarray) -> np.ndarray:
    """Exact sums of squares of the rows."""
    if d.dtype != object and d.shape[1] * float(np.abs(d).max()) ** 2 >= 1 << 62:
        d = d.astype(object)
    return (d * d).sum(axis=1)


def whiten(vectors: DataFrame, most: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of ``vectors(vec_id, embedding)``."""
    bound_batches(vectors.sparkSession)
    rows = integers(vectors, scale, shift)
    spaces = fit_spaces(rows, most)

    def run(batches):
        for b in batches:
            for dims, at, x in by_length(b.column(1)):
                s = spaces[dims]
                k = len(s.explained)
                if not k:
                    continue
                far = squared(deviations(x, s.n, s.total))
                far = pa.array([int(v) if v <= LONG_MAX else None for v in far], pa.int64()) if far.dtype == object else pa.array(far)
                each = pa.array(np.repeat(np.arange(len(x)), k))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(at)).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                     pa.array(np.full(len(x) * k, s.n, np.int64)), far.take(each), pa.array(s.whitened(x).ravel()),
                     pa.array(np.tile(s.explained, len(x))), pa.array(np.full(len(x) * k, s.identity_error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
