"""Near-duplicate embeddings by a subspace pigeonhole join.

Vectors are brought to length one and rotated, and their coordinates are dealt
into ``BLOCKS`` low-dimensional blocks. If two vectors are within a squared
distance d, some block's parts are within d / BLOCKS: so each block is joined
by range under that budget, and the union of its candidates is verified on the
full vectors. A pair counts in the first block that has it within budget.

The range join of a block deals the vectors to the nearest of a number of
centers; a vector is a guest of every center of lower number that a vector
within the radius may belong to. Cells of many vectors are joined in parts, so
that every task compares bounded tables. Tasks return counts of links and, for
each vector, one link that connects it to its linked neighbours in the task:
groups of copies are never expanded into pairs.

Defined results: a vector that is null, zero, or holds null or non-finite
components links with nothing; so do vectors of different lengths with each
other; equal vectors are one class, compared once and counted by their copies;
repeated rows and rows that share an id are rows of their own with links
counted for each row; rows without an id have links but never name a
component; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut

COSINE = 0.95
BLOCKS = 8
#: Vectors for each center, centers of a block at most, vectors from which the centers are fitted.
CELL_ROWS, MOST_CELLS, FIT_ROWS = 1000, 2048, 8192
#: Rows of a cell and guests that are compared in one task.
OWN_ROWS, GUEST_ROWS = 2048, 4096
#: Added to squared radii against rounding of single-precision parts.
SLACK = 1e-4


def rotation(dims: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(20).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def block_bounds(dims: int, blocks: int) -> list[tuple[int, int]]:
    edge = np.linspace(0, dims, min(blocks, dims) + 1).astype(int)
    return list(zip(edge[:-1], edge[1:]))


def matrix(column, dims: int) -> np.ndarray:
    """Rows of a list column of equally long lists."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dims)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def classes(vectors: DataFrame) -> DataFrame:
    """``num, key, rep, copies, dims, v``: one numbered row for each different usable vector of ``vectors(vec_id, embedding)``.

    Numbers are fixed once the rows are written."""
    v = F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0))  # -0.0 becomes 0.0
    usable = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select("vec_id", v.alias("v")).where(F.coalesce(usable, F.lit(False)))
    own = rows.withColumn("key", _key(F.col("v"))).groupBy("key").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("v").alias("v"))
    return own.select(F.monotonically_increasing_id().alias("num"), "key", "rep", "copies", F.size("v").alias("dims"), "v")


def _key(v):
    return F.sha2(F.concat_ws(",", F.transform(v, lambda x: x.cast("string"))), 256)


def unpacked(column, kind: str, dims: int) -> np.ndarray:
    """Rows of a binary column of equally many numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), dims)


def fitted_centers(cls: DataFrame, dims: int, n: int, bounds, turn: np.ndarray) -> list[np.ndarray]:
    """Centers of each block: parts of vectors drawn by hash, at most ``MOST_CELLS``."""
    cells = max(1, min(MOST_CELLS, n // CELL_ROWS))
    share = min(1.0, FIT_ROWS / max(1, n))
    drawn = cls.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < share * (1 << 30)).select("key", "v").orderBy("key").limit(2 * FIT_ROWS).toArrow()
    if not len(drawn):
        return [np.zeros((1, b - a)) for a, b in bounds]
    x = unit(matrix(drawn["v"], dims)) @ turn
    out = []
    for a, b in bounds:
        part, rng = x[:, a:b], np.random.default_rng(len(out))
        c = part[rng.choice(len(part), min(cells, len(part)), replace=False)]
        for _ in range(3):
            near = nearest(part, c)
            for k in np.unique(near):
                c[k] = part[near == k].mean(axis=0)
        out.append(c)
    return out


def square_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1), 0)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return square_distances(x, c).argmin(axis=1)


def cells_of(x: np.ndarray, c: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The cell of each row, then ``(row, cell)`` of the cells of lower number it is a guest of.

    A point within the radius of x lies in cell k only if x is not farther than
    the radius beyond the plane between k and x's own center.
    """
    d = square_distances(x, c)
    own = d.argmin(axis=1)
    apart = np.sqrt(square_distances(c, c))[own]
    beyond = d - d[np.arange(len(x)), own][:, None]
    guest = (beyond <= 2 * apart * radius + 1e-9) & (np.arange(len(c)) < own[:, None])
    row, cell = np.nonzero(guest)
    return own, row, cell


def dealt(cls: DataFrame, dims: int, bounds, turn, centers, radius: float, kind: str) -> DataFrame:
    """``block, cell, own, num, copies, v``; vectors as packed numbers of the input's precision."""
    spark = cls.sparkSession
    shared = spark.sparkContext.broadcast((turn, centers))  # a bounded number of centers

    def run(batches):
        turn, centers = shared.value
        for b in batches:
            raw = matrix(b.column(2), dims)
            x = unit(raw) @ turn
            packed = pa.array([r.tobytes() for r in raw.astype(kind)], pa.binary())
            for k, (lo, hi) in enumerate(bounds):
                own, row, cell = cells_of(x[:, lo:hi], centers[k], radius)
                at = pa.array(np.r_[np.arange(len(x)), row])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), k, np.int32)), pa.array(np.r_[own, cell].astype(np.int32)), pa.array(np.r_[np.ones(len(own), bool), np.zeros(len(row), bool)]),
                     b.column(0).take(at), b.column(1).take(at), packed.take(at)],
                    names=["block", "cell", "own", "num", "copies", "v"])

    return cls.select("num", "copies", "v").mapInArrow(run, "block int, cell int, own boolean, num bigint, copies bigint, v binary")


def parted(rows: DataFrame) -> DataFrame:
    """Adds ``i`` and ``j``: the part of the cell's own rows and of its visitors (own rows and
    guests) that a table holds. Every own row meets every visitor in one table."""
    n = rows.groupBy("block", "cell").agg(
        F.sum(F.col("own").cast("long")).alias("n"), F.count("*").alias("m"))
    n = n.select("block", "cell", F.greatest(F.lit(1), F.ceil(F.col("n") / OWN_ROWS)).alias("ni"), F.ceil(F.col("m") / GUEST_ROWS).alias("nj"))
    at = rows.join(F.broadcast(n), ["block", "cell"])  # at most BLOCKS times MOST_CELLS rows
    i, j = F.pmod(F.xxhash64("num"), F.col("ni")), F.pmod(F.xxhash64(F.lit(1), "num"), F.col("nj"))
    every = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    as_own = at.where("own").select("*", i.alias("i"), F.explode(every(F.col("nj"))).alias("j"), F.lit(False).alias("visits"))
    as_visitor = at.select("*", F.explode(every(F.col("ni"))).alias("i"), j.alias("j"), F.lit(True).alias("visits"))
    return as_own.unionByName(as_visitor.select(as_own.columns))


def within(x: np.ndarray, y: np.ndarray, radius: float) -> np.ndarray:
    """Which rows of x and y may be within the radius, by one product in single precision: a superset, by its rounding."""
    left = np.c_[x, -(x * x).sum(axis=1) / 2, -np.ones(len(x))].astype(np.float32)
    right = np.c_[y, np.ones(len(y)), (y * y).sum(axis=1) / 2].astype(np.float32)
    return left @ right.T >= np.float32(-radius * radius / 2 - 1e-5)


def linked(tables: DataFrame, dims: int, bounds, turn, radius: float, cosine: float, kind: str) -> DataFrame:
    """``num, n, root``: links of a row that its table finds, and a linked row it hangs on."""

    def run(t: pa.Table) -> pa.Table:
        block = t["block"][0].as_py()
        lo, hi = bounds[block]
        visits = t["visits"].to_numpy()
        own_cell = t["own"].to_numpy()
        u = unit(unpacked(t["v"], kind, dims).astype(np.float64))
        part = (u @ turn)[:, :hi]
        nums, copies = t["num"].to_numpy(), t["copies"].to_numpy()
        own, vis = np.flatnonzero(~visits), np.flatnonzero(visits)
        n = np.zeros(len(nums), np.int64)
        pairs = []
        for at in range(0, len(own), 512):
            o = own[at:at + 512]
            r, c = np.nonzero(within(part[o][:, lo:hi], part[vis][:, lo:hi], radius))
            for a in range(0, len(r), 1 << 18):
                x, y = o[r[a:a + (1 << 18)]], vis[c[a:a + (1 << 18)]]
                # own rows of a cell meet twice as visitors: the smaller number goes first
                fresh = ~own_cell[y] | (nums[x] < nums[y])
                x, y = x[fresh], y[fresh]
                for k, (p, q) in enumerate(bounds[:block + 1]):  # in this block, and in none before it
                    near = ((part[x, p:q] - part[y, p:q]) ** 2).sum(axis=1) <= radius * radius
                    fresh = near if k == block else ~near
                    x, y = x[fresh], y[fresh]
                ok = (u[x] * u[y]).sum(axis=1) >= cosine
                x, y = x[ok], y[ok]
                np.add.at(n, x, copies[y])
                np.add.at(n, y, copies[x])
                pairs.append(np.stack([x, y]))
        if not pairs or not sum(p.shape[1] for p in pairs):
            return _EMPTY
        x, y = np.concatenate(pairs, axis=1)
        # a row is in the table as own and as visitor: both stand for its number
        names, same = np.unique(nums, return_inverse=True)
        root = np.arange(len(names))
        x, y = same[x], same[y]
        while True:
            low = np.minimum(root[x], root[y])
            before = root.copy()
            np.minimum.at(root, root[x], low)
            np.minimum.at(root, root[y], low)
            root = root[root]
            if (root == before).all():
                break
        total = np.zeros(len(names), np.int64)
        np.add.at(total, same, n)
        some = np.flatnonzero(total > 0)
        return pa.table({"num": names[some], "n": total[some], "root": names[root[some]]})

    return tables.groupBy("block", "cell", "i", "j").applyInArrow(run, "num bigint, n bigint, root bigint")


_EMPTY = pa.table({c: pa.array([], pa.int64()) for c in ("num", "n", "root")})


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, blocks: int = BLOCKS) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of ``vectors(vec_id bigint, embedding)``."""
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    every = cut(classes(vectors))
    kind = "<f4" if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else "<f8"
    found = None
    for dims, n in every.groupBy("dims").count().orderBy("dims").collect():  # a row for each length
        cls = every.where(F.col("dims") == dims)
        turn, bounds = rotation(dims), block_bounds(dims, blocks)
        radius = float(np.sqrt((2 - 2 * cosine) / len(bounds) + SLACK / len(bounds)))
        centers = fitted_centers(cls, dims, n, bounds, turn)
        rows = dealt(cls, dims, bounds, turn, centers, radius, kind)
        links = linked(parted(rows), dims, bounds, turn, radius, cosine, kind)
        found = links if found is None else found.unionByName(links)
    if found is None:
        return vectors.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                              F.col("vec_id").isNotNull().alias("kept"))
    found = cut(found)
    edges = found.select(F.col("num").alias("a"), F.col("root").alias("b")).where("a <> b").distinct()
    joined = connected_components(edges)
    members = every.select("num", "rep").join(joined, F.col("num") == F.col("id"), "left").withColumn("component", F.coalesce("component", "num"))
    least = members.groupBy("component").agg(F.min("rep").alias("component_id"))
    sums = found.groupBy("num").agg(F.sum("n").alias("n"))
    info = every.select("num", "key", "copies").join(sums, "num", "left").join(members.select("num", "component"), "num").join(least, "component").select(
        "key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    key = _key(F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0)))
    out = vectors.select("vec_id", key.alias("key")).join(info, "key", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


#: Links of all pairs, and what is reachable by them.
ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
u AS (
  SELECT vec_id, v FROM v WHERE v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(v, lambda x: x <> 0)) > 0),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id < b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
near AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT vec_id, vec_id AS c FROM v UNION SELECT r.vec_id, near.b FROM reach r JOIN near ON near.a = r.c),
least AS (SELECT vec_id, min(c) AS component_id FROM reach GROUP BY vec_id)
SELECT vec_id, (SELECT count(*) FROM near WHERE a = vec_id)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM least
"""
