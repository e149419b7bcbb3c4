"""Near-duplicate documents by an LSH forest over MinHash signatures.

A document's shingle set gives a label of ``DEPTH`` MinHash values in each of ``TREES``
trees. A tree is the sorted order of its labels; it is dealt out by subtrees, the rows that share a
prefix, each of which a task reads in order of its labels. All rows of a subtree have a common prefix of
its depth at least, so they are neighbours there. The depth adapts to the region: a subtree starts
``LEAST_DEPTH`` values deep, and where it has more than ``REGION`` rows its children take its place, down to whole labels.

Inside a subtree, a row's candidates are the rows whose signature bits agree as
often as similar sets must, taken by falling length of the common prefix, which is the least of the
common prefixes of adjacent labels between the two. Candidates are confirmed on
the full sets. Equal sets are one row from the start.

A first round confirms for each row the candidate with the longest common prefix in any tree, and in each
tree the one with the smallest id, which ties a region together. In a second one the
rows of a subtree that aren't connected yet are compared with each other on
their full sets inside one task, which returns the links that connect them: so
groups of copies are never expanded into pairs.

Going deeper only joins most rows of large regions cheaply. A third round then compares all rows of a region
that had more than ``REGION`` rows at ``LEAST_DEPTH`` and are
in different components, every part of it with every other part: parts of one
component need no comparison with each other, so the rows that hang on few
members of a large group meet all of the group. So every pair that has ``LEAST_DEPTH`` values of a label in
common in any tree is compared, whatever the size of a region.

Defined results: a text without words has an empty set and no links; a shorter
text than a shingle is one shingle; repeated rows and rows that share an id are
one node; rows without an id take the smallest id among their set's copies, or
stay without a component; an empty table gives no rows.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytehash
from .common import among, bound_batches, connected_components, cut, release

#: Trees, values of a label, and how many of them rows of a region share at least.
TREES, DEPTH, LEAST_DEPTH = 16, 8, 3
#: Rows of a file that a task compares with many others, and pairs of texts that it confirms, about.
HEAVY_ROWS, TEXT_PAIRS = 1 << 15, 1 << 12
#: Rows of a region that are compared with each other.
REGION = 512
#: Numbers of large regions that are broadcast at most; beyond, they are joined by shuffle.
HOT_ROWS = 200_000
VALUES = TREES * DEPTH
#: Bytes of a label's value.
VALUE_BYTES = 4
#: Signature bits (of VALUES) that may differ: five deviations beyond what a similarity of 0.8 gives.
DIFFERING = 30
_U = np.uint64
_FEATURES = "n bigint, ha bigint, hb bigint, s0 bigint, s1 bigint, labels binary"


@functools.lru_cache(maxsize=1)
def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    x = bytehash.mix(np.arange(1, 2 * VALUES + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))
    return x[:VALUES] | _U(1), x[VALUES:]


def signature(own: np.ndarray) -> np.ndarray:
    """The MinHash values of a set of hashes."""
    a, b = _multipliers()
    low = np.full(VALUES, np.iinfo(np.uint64).max, _U)
    for at in range(0, len(own), 2048):
        np.minimum(low, (own[at:at + 2048, None] * a + b).min(axis=0), out=low)
    return low


def features(docs: DataFrame, shingle: int) -> DataFrame:
    """``doc_id`` with the size and hash of its set, signature bits, and its labels one after the other."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            m = len(b)
            n, ha, hb = (np.zeros(m, np.int64) for _ in range(3))
            low = np.zeros((m, VALUES), _U)
            for i, own in enumerate(bytehash.sets(b.column(1), shingle)):
                n[i] = len(own)
                if len(own):
                    ha[i] = np.bitwise_xor.reduce(own).view(np.int64)
                    hb[i] = np.sum(bytehash.mix(own), dtype=_U).view(np.int64)
                    low[i] = signature(own)
            bits = np.packbits(((low >> _U(24)) & _U(1)).astype(np.uint8), axis=1).view(np.int64)
            # big-endian, so that bytes sort as values do
            labels = (bytehash.mix(low) >> _U(64 - 8 * VALUE_BYTES)).astype(f">u{VALUE_BYTES}")
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n), pa.array(ha), pa.array(hb), pa.array(np.ascontiguousarray(bits[:, 0])), pa.array(np.ascontiguousarray(bits[:, 1])),
                 pa.array([x.tobytes() for x in labels], pa.binary())],
                names=["doc_id", "n", "ha", "hb", "s0", "s1", "labels"])
        release()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {_FEATURES}")


def forest(reps: DataFrame) -> DataFrame:
    """``tree, label, rep, n, s0, s1``: each row with its label of every tree."""
    size = DEPTH * VALUE_BYTES
    return reps.select(F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"), "labels", "rep", "n", "s0", "s1").select(
        "tree", F.substring("labels", F.col("tree") * size + 1, F.lit(size)).alias("label"), "rep", "n", "s0", "s1")


def subtrees(rows: DataFrame, n_rows: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """``g, label, rep, n, s0, s1``: every row of the forest in its subtree ``g``, which is as deep as it needs to be
    for ``REGION`` rows; and the rows ``g, rep, n, s0, s1`` of the regions that were too large, whole.

    Whole labels that too many rows share are dealt into parts, each of which has the first row of all.
    ``n_rows``: how many rows there are at most, where that is known.
    """
    columns = ("label", "rep", "n", "s0", "s1")
    out, rest, large = None, rows, None
    for depth in range(LEAST_DEPTH, DEPTH + 1):
        rest = rest.withColumn("g", F.xxhash64("tree", F.substring("label", 1, depth * VALUE_BYTES)))
        hot = cut(rest.groupBy("g").count().where(F.col("count") > REGION), None if n_rows is None else n_rows // REGION)
        n_hot = hot.count()
        if n_hot:
            hot = F.broadcast(hot) if n_hot <= HOT_ROWS else hot
            part, rest = rest.join(hot, "g", "left_anti"), cut(rest.join(hot, "g"), n_rows)
        else:
            part, rest = rest, None
        part = part.select("g", *columns)
        out = part if out is None else out.unionByName(part)
        if rest is None:
            return out, large
        if depth == LEAST_DEPTH:
            large = rest.select("g", "rep", "n", "s0", "s1")
        if depth < DEPTH:
            rest = rest.drop("count", "g")
    parts = F.ceil(F.col("count") / REGION)
    own = rest.withColumn("part", F.pmod(F.xxhash64("rep"), parts))
    first = rest.groupBy("g", "count").agg(F.min_by(F.struct(*columns), "rep").alias("f")).select(
        "g", "f.*", F.explode(F.sequence(F.lit(0).cast("long"), parts.cast("long") - 1)).alias("part"))
    both = own.select("g", "part", *columns).unionByName(first.select("g", "part", *columns))
    return out.unionByName(both.select(F.xxhash64("g", "part").alias("g"), *columns)), large


def common_prefixes(label: pa.Array) -> np.ndarray:
    """How many values each label shares with the one before it (the first with none)."""
    if isinstance(label, pa.ChunkedArray):
        label = label.combine_chunks()
    raw = np.frombuffer(b"".join(x.as_py() for x in label), f">u{VALUE_BYTES}").reshape(len(label), DEPTH)
    same = np.zeros((len(label), DEPTH), bool)
    same[1:] = raw[1:] == raw[:-1]
    return np.logical_and.accumulate(same, axis=1).sum(axis=1).astype(np.int8)


def similar(n: np.ndarray, s0: np.ndarray, s1: np.ndarray, i: np.ndarray, j: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether sizes and signature bits leave rows i and j a chance."""
    differ = np.bitwise_count(s0[i] ^ s0[j]).astype(np.int16) + np.bitwise_count(s1[i] ^ s1[j])
    a, b = n[i], n[j]
    return (differ <= DIFFERING) & (np.minimum(a, b) * den >= np.maximum(a, b) * num)


def runs(batches, act):
    """Calls ``act`` with arrays of complete runs of equal ``g``; a run may span batches."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b])
        held = t if held is None else pa.concat_tables([held, t])
        g = held["g"].to_numpy()
        if len(g) and g[0] != g[-1]:
            end = len(g) - int(np.argmax(g[::-1] != g[-1]))
            yield from act(held.slice(0, end))
            held = held.slice(end).combine_chunks()
    if held is not None and len(held):
        yield from act(held)


def first_candidates(grouped: DataFrame, num: int, den: int) -> DataFrame:
    """Rows of subtrees with a candidate: the one with the smallest id (``first``, null for rows that come before theirs),
    and the one with the longest common prefix (``deep``, of ``prefix`` values)."""
    last = np.iinfo(np.int64).max

    def act(t):
        g, rep, n, s0, s1 = (t[c].to_numpy() for c in ("g", "rep", "n", "s0", "s1"))
        step = common_prefixes(t["label"])
        u0, u1 = s0.view(_U), s1.view(_U)
        first, deep = np.full(len(g), last), np.full(len(g), last)
        prefix = np.full(len(g), -1, np.int8)
        i = np.flatnonzero(g[:-1] == g[1:])
        shared = step[i + 1]
        o = 1
        while len(i):
            at = similar(n, u0, u1, i, i + o, num, den) & (rep[i] != rep[i + o])
            ok, long = i[at], shared[at]
            for own, other in ((ok, ok + o), (ok + o, ok)):
                np.minimum.at(first, own, rep[other])
                # offsets grow, so prefixes fall: the first one found is among the longest
                more = (long > prefix[own]) | (long == prefix[own]) & (rep[other] < deep[own])
                deep[own[more]], prefix[own[more]] = rep[other[more]], long[more]
            o += 1
            keep = i + o < len(g)
            i, shared = i[keep], shared[keep]
            keep = g[i] == g[i + o]
            i, shared = i[keep], shared[keep]
            shared = np.minimum(shared, step[i + o])
        at = np.flatnonzero(prefix >= 0)
        if len(at):
            f = first[at]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(x[at]) for x in (g, rep, n, s0, s1)), pa.array(f, mask=f > rep[at]), pa.array(deep[at]), pa.array(prefix[at].astype(np.int32))],
                names=["g", "rep", "n", "s0", "s1", "first", "deep", "prefix"])

    return grouped.repartition("g").sortWithinPartitions("g", "label", "rep").mapInArrow(
        lambda b: runs(b, act), "g bigint, rep bigint, n bigint, s0 bigint, s1 bigint, first bigint, deep bigint, prefix int")


def open_rows(labelled: DataFrame, num: int, den: int) -> DataFrame:
    """``g, rep, c``: rows of regions with a candidate in another component ``c``."""

    def act(t):
        g, rep, n, s0, s1, c = (t[x].to_numpy() for x in ("g", "rep", "n", "s0", "s1", "c"))
        u0, u1 = s0.view(_U), s1.view(_U)
        has = np.zeros(len(g), bool)
        i = np.flatnonzero(g[:-1] == g[1:])
        o = 1
        while len(i):
            ok = i[(c[i] != c[i + o]) & similar(n, u0, u1, i, i + o, num, den)]
            has[ok] = has[ok + o] = True
            o += 1
            i = i[i + o < len(g)]
            i = i[g[i] == g[i + o]]
        if has.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[has]) for x in (g, rep, c)], names=["g", "rep", "c"])

    return labelled.repartition("g").sortWithinPartitions("g", "rep").mapInArrow(lambda b: runs(b, act), "g bigint, rep bigint, c bigint")


def full_sets(docs: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """``rep, own``: the packed shingle set of each document in ``ids(rep)``."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([x.tobytes() for x in bytehash.sets(b.column(1), shingle)], pa.binary())], names=["rep", "own"])

    return among(docs.select(F.col("doc_id").alias("rep"), "text"), "rep", ids).mapInArrow(run, "rep bigint, own binary")


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """How many hashes each two of the sorted sets share."""
    r = len(sets)
    both = np.zeros((r, r), np.int64)
    if r <= 6:
        for i in range(r):
            for j in range(i):
                both[i, j] = both[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        return both
    h = np.concatenate(sets)
    row = np.repeat(np.arange(r), [len(x) for x in sets])
    o = np.argsort(h, kind="stable")
    h, row = h[o], row[o]
    column = np.cumsum(np.r_[False, h[1:] != h[:-1]])
    shared = np.bincount(column) > 1
    keep = shared[column]
    row, column = row[keep], (np.cumsum(shared) - 1)[column[keep]]
    edge = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else 0) + 4097, 4096))
    for k, (x, y) in enumerate(zip(edge[:-1], edge[1:])):
        part = np.zeros((r, 4096), np.float32)
        part[row[x:y], column[x:y] - 4096 * k] = 1
        both += (part @ part.T).astype(np.int64)
    return both


def connecting(near: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place that each row is connected to by links and components, and whether it is another row."""
    near = near | (c[:, None] == c)
    label = np.arange(len(c))
    while True:
        low = np.where(near, label, len(c)).min(axis=1)
        if (low == label).all():
            return label, label != np.arange(len(c))
        label = low


def region_links(with_sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links ``(a, b)`` that join the components of ``(g, rep, c, own)`` as all similar pairs of a region do.

    Every two sets of a region are compared in full; of the links found only
    those to the first row of what they connect are returned.
    """

    def act(t):
        g, rep, c = (t[x].to_numpy() for x in ("g", "rep", "c"))
        own = [np.frombuffer(x.as_py(), _U) for x in t["own"]]
        edge = np.r_[np.flatnonzero(np.r_[True, g[1:] != g[:-1]]), len(g)]
        a, b = [], []
        for x, y in zip(edge[:-1], edge[1:]):
            both = intersections(own[x:y])
            size = np.array([len(s) for s in own[x:y]])
            near = (both > 0) & (both * den >= (size[:, None] + size - both) * num)
            near &= c[x:y, None] != c[x:y]
            if not near.any():
                continue
            # rows are sorted by id: the first one stands for all
            to, moved = connecting(near, c[x:y])
            a.append(rep[x:y][to[moved]])
            b.append(rep[x:y][moved])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return with_sets.repartition("g").sortWithinPartitions("g", "rep").mapInArrow(lambda b: runs(b, act), "a bigint, b bigint").distinct()


def blocks(rows: DataFrame, size: int, n_rows: int) -> DataFrame:
    """``rows(g, rep, c, ...)`` in ``block`` and ``part``: every two parts of a region ``g`` of which
    some rows are in different components ``c`` meet in one block, and such a part meets itself in one.

    A component of ``size`` rows or more has parts of its own, the others share parts. ``n_rows``: how many rows there are.
    """
    per = cut(rows.groupBy("g", "c").agg(F.count("*").alias("k")), n_rows)
    number = lambda k: F.ceil(F.col(k) / size).cast("long")
    big = per.where(F.col("k") >= size).select("g", "c", number("k").alias("own"))
    small = per.where(F.col("k") < size).groupBy("g").agg(F.sum("k").alias("k")).select("g", number("k").alias("shared"))
    big, small = (cut(x, n_rows) for x in (big, small))
    own_part = lambda k: F.xxhash64(F.lit(1), "g", "c", k)
    shared_part = lambda k: F.xxhash64(F.lit(0), "g", k)
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).alias("k")
    parts = cut(big.select("g", "c", each("own")).select("g", own_part(F.col("k")).alias("part"), "c").unionByName(
        small.select("g", each("shared")).select("g", shared_part(F.col("k")).alias("part"), F.lit(None).cast("bigint").alias("c"))), n_rows)
    p, q = parts.select("g", "part", "c"), parts.select("g", F.col("part").alias("part2"), F.col("c").alias("c2"))
    met = p.join(q, "g").where((F.col("part") <= F.col("part2")) & ~F.coalesce(F.col("c") == F.col("c2"), F.lit(False)))
    met = met.withColumn("block", F.xxhash64("part", "part2"))
    places = met.select("block", F.explode(F.array_distinct(F.array("part", "part2"))).alias("part"))
    few = lambda x: F.broadcast(x) if x.count() <= HOT_ROWS else x
    dealt = rows.join(few(big), ["g", "c"], "left").join(few(small), "g", "left").withColumn(
        "part", F.when(F.col("own").isNotNull(), own_part(F.pmod(F.xxhash64("rep"), F.col("own")))).otherwise(
            shared_part(F.pmod(F.xxhash64(F.lit(2), "c"), F.col("shared")))))
    return dealt.select(*rows.columns, "part").join(places, "part")


def _meeting(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows of a block's two parts; twice the same if it has one."""
    one = part == part[0]
    both = np.arange(len(part))
    return (both, both) if one.all() else (both[one], both[~one])


def crossing(block_rows: DataFrame, num: int, den: int) -> DataFrame:
    """``g, rep, n, s0, s1, c``: rows of blocks with a candidate of another component in the other part."""

    def act(t):
        block, part, rep, n, s0, s1, c = (t[x].to_numpy() for x in ("g", "part", "rep", "n", "s0", "s1", "c"))
        u0, u1 = s0.view(_U), s1.view(_U)
        has = np.zeros(len(block), bool)
        edge = np.r_[np.flatnonzero(np.r_[True, block[1:] != block[:-1]]), len(block)]
        for x, y in zip(edge[:-1], edge[1:]):
            left, right = (x + side for side in _meeting(part[x:y]))
            for at in range(0, len(left), 128):
                some = left[at:at + 128]
                i, j = some[:, None], right[None, :]
                ok = (c[i] != c[j]) & similar(n, u0, u1, i, j, num, den)
                has[some] |= ok.any(axis=1)
                has[right] |= ok.any(axis=0)
        if has.any():
            yield t.select(["region", "rep", "n", "s0", "s1", "c"]).filter(pa.array(has)).combine_chunks().to_batches()[0]

    named = block_rows.select(F.col("block").alias("g"), F.col("g").alias("region"), "part", "rep", "n", "s0", "s1", "c")
    return named.repartition("g").sortWithinPartitions("g", "rep").mapInArrow(
        lambda b: runs(b, act), "region bigint, rep bigint, n bigint, s0 bigint, s1 bigint, c bigint").withColumnRenamed("region", "g").distinct()


def block_links(with_sets: DataFrame, num: int, den: int) -> DataFrame:
    """As :func:`region_links`, for the two parts of each block and for candidates only."""

    def act(t):
        block, part, rep, n, s0, s1, c = (t[x].to_numpy() for x in ("g", "part", "rep", "n", "s0", "s1", "c"))
        u0, u1 = s0.view(_U), s1.view(_U)
        edge = np.r_[np.flatnonzero(np.r_[True, block[1:] != block[:-1]]), len(block)]
        a, b = [], []
        for x, y in zip(edge[:-1], edge[1:]):
            left, right = _meeting(part[x:y])
            i, j = x + left[:, None], x + right[None, :]
            maybe = np.zeros((y - x, y - x), bool)
            maybe[np.ix_(left, right)] = (c[i] != c[j]) & similar(n, u0, u1, i, j, num, den)
            maybe |= maybe.T
            at = np.flatnonzero(maybe.any(axis=1))
            if not len(at):
                continue
            own = [np.frombuffer(t["own"][int(x + k)].as_py(), _U) for k in at]
            both = intersections(own)
            size = np.array([len(s) for s in own])
            near = maybe[np.ix_(at, at)] & (both > 0) & (both * den >= (size[:, None] + size - both) * num)
            to, moved = connecting(near, c[x + at])
            a.append(rep[x + at][to[moved]])
            b.append(rep[x + at][moved])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    named = with_sets.select(F.col("block").alias("g"), "part", "rep", "n", "s0", "s1", "c", "own")
    return named.repartition("g").sortWithinPartitions("g", "rep").mapInArrow(lambda b: runs(b, act), "a bigint, b bigint").distinct()


def large_links(docs: DataFrame, rows: DataFrame, joined: DataFrame, shingle: int, num: int, den: int, n_rows: int) -> DataFrame | None:
    """The links between components that the rows of large regions have, whatever the size of a region; ``n_rows`` rows at most."""
    label = cut(rows.join(joined, rows["rep"] == joined["id"], "left").select(
        "g", "rep", "n", "s0", "s1", F.coalesce("component", "rep").alias("c")), n_rows)
    n_rows = label.count()
    rest = cut(crossing(blocks(label, 4 * REGION, n_rows), num, den), n_rows)
    n_rest = rest.count()
    if not n_rest:
        return None
    sets = full_sets(docs, rest.select("rep").distinct(), shingle)
    return cut(block_links(blocks(rest, -(-REGION // 2), n_rest).join(sets, "rep"), num, den), n_rest)


def confirmed(docs: DataFrame, pairs: DataFrame, shingle: int, num: int, den: int) -> DataFrame:
    """The pairs ``(a, b)`` of ids whose full shingle sets are similar enough."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    docs = among(docs, "doc_id", ends)
    one = docs.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    two = docs.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))

    def run(batches):
        for b in batches:
            keep = np.zeros(len(b), bool)
            for i, (x, y) in enumerate(zip(bytehash.sets(b.column(2), shingle), bytehash.sets(b.column(3), shingle))):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = both > 0 and both * den >= (len(x) + len(y) - both) * num
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in b.columns[:2]], names=["a", "b"])

    return pairs.join(one, "a").join(two, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint")


def components(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of ``docs(doc_id bigint, text)``.

    Documents are linked if ``den * intersection >= num * union`` of their shingle sets.
    """
    bound_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    f = cut(features(docs, shingle))
    n_rows = TREES * f.count()
    reps = f.where("n > 0").groupBy("ha", "hb", "n").agg(
        F.min("doc_id").alias("rep"), *(F.first(c).alias(c) for c in ("s0", "s1", "labels"))).where("rep IS NOT NULL")
    bounded, large = subtrees(forest(reps), n_rows)
    near = cut(first_candidates(bounded, num, den), n_rows, HEAVY_ROWS)
    longest = near.groupBy("rep").agg(F.max(F.struct("prefix", (-F.col("deep")).alias("deep"))).alias("d")).select(
        F.least(-F.col("d.deep"), "rep").alias("a"), F.greatest(-F.col("d.deep"), "rep").alias("b"))
    tied = near.where("first IS NOT NULL").select(F.col("first").alias("a"), F.col("rep").alias("b"))
    pairs = cut(tied.unionByName(longest).distinct(), 2 * near.count())
    links = cut(confirmed(docs, pairs, shingle, num, den), pairs.count(), TEXT_PAIRS)
    n_links = links.count()
    joined = connected_components(links, rows=n_links)
    label = near.join(joined, near["rep"] == joined["id"], "left").select(
        "g", "rep", "n", "s0", "s1", F.coalesce("component", "rep").alias("c"))
    rest = cut(open_rows(label, num, den), n_rows, HEAVY_ROWS)
    n_rest = rest.count()
    if n_rest:
        sets = full_sets(docs, rest.select("rep").distinct(), shingle)
        links = cut(links.unionByName(region_links(rest.join(sets, "rep").select("g", "rep", "c", "own"), num, den)), n_links + n_rest)
        joined = connected_components(links, rows=n_links + n_rest)
    more = large_links(docs, large, joined, shingle, num, den, n_rows) if large is not None else None
    if more is not None:
        joined = connected_components(links.unionByName(more), rows=n_links + n_rest + more.count())
    cls = reps.select("ha", "hb", "n", "rep").join(joined, F.col("rep") == joined["id"], "left").select(
        "ha", "hb", "n", F.coalesce("component", "rep").alias("component_id"))
    out = f.select("doc_id", "n", "ha", "hb").join(cls, ["ha", "hb", "n"], "left")
    component = F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def deduplicated(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row of ``docs`` for each group of near duplicates, and every row without an id."""
    found = components(docs, shingle, num, den).where("kept").select("doc_id")
    own = docs.dropDuplicates(["doc_id", "text"]) if docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").limit(1).count() else docs
    return among(own, "doc_id", found).unionByName(docs.where("doc_id IS NULL"))


#: Links of all pairs that share a shingle, of two words, and what is reachable by them.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n FROM s),
e AS (SELECT doc_id, hash(unnest(s)) AS g FROM s),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
near AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT doc_id, doc_id AS c FROM n UNION SELECT r.doc_id, near.b FROM reach r JOIN near ON near.a = r.c),
least AS (SELECT doc_id, min(c) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN least USING (doc_id)
"""
