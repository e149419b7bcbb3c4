"""Removal of byte strings that an earlier document holds already.

Every ``length``-byte string that also starts in a document with a smaller id is
found exactly, by the common prefixes of sorted suffixes. Texts are dealt into
chunks once; three passes over the chunks exchange only digests with buckets:

1. Every string has an anchor, the least hash of the shorter strings inside it;
   equal strings have equal anchors. Buckets find the anchors that more than one
   document holds.
2. Stretches of text with such anchors are cut where the least hash of their
   inner strings changes, and each part goes to the bucket of that hash, once
   for a chunk. Equal strings meet in one bucket. Strings whose anchor more than ``HOT_CHUNKS`` chunks
   hold make parts of their own: these meet in slices of the chunks first, where of equal parts only those of
   the least document go on, so a bucket gets a passage that all chunks hold once for a slice.
3. A bucket sorts the suffixes of its distinct parts and derives their common
   prefixes from the Burrows-Wheeler transform: breadth-first backward
   extension splits the intervals of strings of one byte, two bytes and so on
   up to ``length``. An interval's least document owns the string; the string
   is removed elsewhere.

Defined results: a null text is an empty one; texts shorter than ``length``
keep everything; documents that share an id don't count as earlier than each
other; rows without an id come after all others, in the order of a hash of their texts (so equal
ones keep theirs), and are dealt out by it; ids are expected below 2**62; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytehash
from .common import bound_batches, release

LENGTH = 50
#: Bytes of text in a chunk, and for each bucket of anchors and of parts.
CHUNK_BYTES, ANCHOR_BUCKET_BYTES, PART_BUCKET_BYTES = 4 << 20, 8 << 20, 2 << 20
#: Chunks that may hold an anchor before its parts are combined in slices.
HOT_CHUNKS = 128
#: Rows without an id go by numbers from here on.
NO_ID = 1 << 62
_U = np.uint64
_LAST = np.iinfo(np.int64).max


def _words8(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number."""
    return np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), strides=(1,))


def gram_hashes(data: np.ndarray, m: int) -> np.ndarray:
    """A hash of the m bytes (8 at least) from each place on."""
    x, n = _words8(data), len(data) - m + 1
    h = x[:n] * _U(0x9E3779B97F4A7C15)
    for k, at in enumerate([*range(8, m - 8, 8), m - 8] if m > 8 else []):
        h += x[at:at + n] * _U((0xC2B2AE3D27D4EB4F + 0x632BE59BD9B4E019 * 2 * k) & 0xFFFFFFFFFFFFFFFF | 1)
    h ^= h >> _U(29)
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(32)
    return h


def window_least(h: np.ndarray, w: int) -> np.ndarray:
    """The least of the w values from each place on."""
    size, n = 1, len(h) - w + 1
    while 2 * size <= w:
        h = np.minimum(h[:len(h) - size], h[size:])
        size *= 2
    return h[:n] if size == w else np.minimum(h[:n], h[w - size:w - size + n])


def anchors(data: np.ndarray, bounds: np.ndarray, length: int, inner: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of string starts with one anchor: ``(first start, end, anchor)``; a run is inside one text."""
    n = len(data) - length + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, _U)
    least = window_least(gram_hashes(data, inner), length - inner + 1)
    change = np.ones(n + 1, bool)
    np.not_equal(least[1:], least[:-1], out=change[1:n])
    change[bounds[bounds <= n]] = True
    crossing = bounds[1:] - length + 1
    change[np.clip(crossing, 0, n)] = True
    first = np.flatnonzero(change)
    first, end = first[:-1], first[1:]
    of = np.searchsorted(bounds, first, side="right")
    inside = end + length - 1 <= bounds[of]
    return first[inside], end[inside], least[first[inside]]


def bucket_of(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """A bucket, and 31 more bits."""
    h = bytehash.mix(h)
    return ((h >> _U(33)) % _U(buckets)).astype(np.int64), (h & _U(0x7FFFFFFF)).astype(np.uint32)


def cuts(keys: np.ndarray) -> np.ndarray:
    """Bounds of the runs of equal keys."""
    return np.r_[np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]), len(keys)] if len(keys) else np.zeros(1, np.int64)


def suffix_order(data: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of at least ``depth`` bytes from there on (zeros after the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    key = np.ndarray((n,), ">u8", np.r_[data, np.zeros(8, np.uint8)].tobytes(), strides=(1,)).astype(_U)
    have = 8
    while True:
        order = np.argsort(key)
        if have >= depth:
            return order
        ordered = key[order]
        rank = np.empty(n, _U)
        rank[order] = np.cumsum(np.r_[False, ordered[1:] != ordered[:-1]]).astype(_U) + _U(1)
        if rank[order[-1]] == n:
            return order
        key = rank << _U(32)
        key[:max(0, n - have)] |= rank[have:]
        have *= 2


def string_classes(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order and, along it, the number of the interval of equal ``length``-byte strings.

    The intervals of strings one byte longer come from those at hand: rows r-1
    and r of the sorted suffixes share a byte and then what the rows of their
    next places share. Rows get their common prefix in increasing order, and
    those that have none when ``length`` is reached share it all.
    """
    n = len(data)
    order = suffix_order(data, length)
    row = np.empty(n + 1, np.int32)
    row[order] = np.arange(n, dtype=np.int32)
    row[n] = -1
    follow = row[order + 1]
    first = data[order]
    split = np.ones(n, bool)
    np.not_equal(first[1:], first[:-1], out=split[1:])
    open_rows = np.flatnonzero(~split)
    one, two = follow[open_rows - 1], follow[open_rows]
    number = np.empty(n + 1, np.int32)
    for _ in range(1, length):
        if not len(open_rows):
            break
        np.cumsum(split, out=number[:n])
        number[n] = 0  # of what lies after the end: row -1
        apart = number[one] != number[two]
        split[open_rows[apart]] = True
        open_rows, one, two = open_rows[~apart], one[~apart], two[~apart]
    return order, np.cumsum(split, dtype=np.int64) - 1


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of spans, one after the other."""
    end = np.cumsum(size)
    return np.repeat(start - (end - size), size) + np.arange(end[-1] if len(end) else 0)


def later_runs(data: np.ndarray, sizes: np.ndarray, owners: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which strings of the parts, joined by single bytes in ``data``, a part of a smaller owner holds.

    Returns part, first start and last start of each run of such strings.
    """
    starts = np.cumsum(sizes + 1) - sizes - 1
    owner = np.repeat(owners, np.r_[sizes[:-1] + 1, sizes[-1:]])
    step = np.zeros(len(data) + 1, np.int8)
    step[starts] += 1
    step[starts + sizes - length + 1] -= 1
    valid = np.cumsum(step[:-1], dtype=np.int8).astype(bool)
    order, number = string_classes(data, length)
    ranked = np.where(valid, owner, _LAST)[order]
    least = np.minimum.reduceat(ranked, cuts(number)[:-1])
    later = np.zeros(len(data) + 2, np.int8)
    later[order + 1] = least[number] < ranked
    edge = np.diff(later)
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
    part = np.searchsorted(starts, first, side="right") - 1
    return part, first - starts[part], last - starts[part]


def _joined(arrays, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() or b"" for x in arrays), dtype)


def _texts(t: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    return bytehash.slices(t["text"].combine_chunks().cast(pa.large_string()))


def plan_removals(docs: DataFrame, length: int, anchor_buckets: int, part_buckets: int, slices: int) -> DataFrame:
    """``chunk, ids, starts, ends``: byte ranges to remove, packed, of ``docs(__key, text, __chunk)``; the key orders the documents.

    Other columns of ``docs`` ride along, so that all passes share one exchange.
    """
    inner = max(8, length // 2 - 1)
    part_inner = max(8, length // 4)

    def find(t: pa.Table) -> pa.Table:
        release()
        ids = t["__key"].to_numpy()
        values, owner = [], []
        for at, data, bounds in _texts(t):
            first, _, h = anchors(data, bounds, length, inner)
            values.append(h)
            owner.append(ids[at + np.searchsorted(bounds, first, side="right") - 1])
        h, d = np.concatenate(values or [np.zeros(0, _U)]), np.concatenate(owner or [np.zeros(0, np.int64)])
        o = np.argsort(h)
        h, d = h[o], d[o]
        c = cuts(h)
        if len(h):
            many = np.minimum.reduceat(d, c[:-1]) != np.maximum.reduceat(d, c[:-1])
            h = h[c[:-1]]
        else:
            many = np.zeros(0, bool)
        b, bits = bucket_of(h, anchor_buckets)
        o = np.argsort(b, kind="stable")
        b, packed = b[o], (bits << np.uint32(1) | many)[o].astype(np.uint32)
        c = cuts(b)
        k = t["__chunk"][0].as_py()
        return pa.table({"bucket": pa.array(b[c[:-1]]), "chunk": pa.array(np.full(len(c) - 1, k, np.int64)),
                         "packed": pa.array([packed[x:y].tobytes() for x, y in zip(c[:-1], c[1:])], pa.binary())})

    def meet(t: pa.Table) -> pa.Table:
        release()
        packed = [np.frombuffer(x.as_py(), np.uint32) for x in t["packed"]]
        chunk = t["chunk"].to_numpy()
        v = np.concatenate(packed)
        k = np.repeat(np.arange(len(packed), dtype=np.int32), [len(x) for x in packed])
        o = np.argsort(v >> np.uint32(1), kind="stable")
        c = cuts((v >> np.uint32(1))[o])
        shared = (np.diff(c) > 1) | (np.maximum.reduceat(v[o] & np.uint32(1), c[:-1]) > 0)
        hot = np.zeros(len(v), np.uint32)
        hot[o] = np.repeat(np.diff(c) > HOT_CHUNKS, np.diff(c))
        take = np.sort(o[np.repeat(shared, np.diff(c))])
        v, k = v[take] & ~np.uint32(1) | hot[take], k[take]
        c = cuts(k)
        bucket = t["bucket"][0].as_py()
        return pa.table({"chunk": pa.array(chunk[k[c[:-1]]] if len(k) else np.zeros(0, np.int64)),
                         "bucket": pa.array(np.full(len(c) - 1, bucket, np.int64)),
                         "packed": pa.array([np.sort(v[x:y]).tobytes() for x, y in zip(c[:-1], c[1:])], pa.binary())})

    def cut_parts(t: pa.Table, hits: pa.Table) -> pa.Table:
        release()
        out = {c: [] for c in ("bucket", "slice", "chunk", "ids", "starts", "sizes", "data", "given")}
        if len(t) and len(hits):
            ids, k = t["__key"].to_numpy(), t["__chunk"][0].as_py()
            # bucket, 31 bits, whether hot
            known = np.sort(np.concatenate([np.frombuffer(p.as_py(), np.uint32).astype(np.int64) | b << 32 for b, p in zip(hits["bucket"].to_numpy(), hits["packed"])]))
            found = [_parts_of(ids[at:at + len(bounds) - 1], data, bounds, known) for at, data, bounds in _texts(t)]
            doc, start, size, least, digest, hot = (np.concatenate(x) for x in list(zip(*found))[:6])
            blobs = [f[6] for f in found]
            if len(doc):
                base = np.cumsum([0] + [len(x) for x in blobs])
                place = np.concatenate([f[7] + b for f, b in zip(found, base)])
                text = np.concatenate(blobs)
                # of equal parts in this chunk only those of the least document ask their bucket
                o = np.lexsort((doc, digest))
                c = cuts(digest[o])
                head = np.repeat(doc[o][c[:-1]], np.diff(c))
                later = np.zeros(len(doc), bool)
                later[o] = doc[o] > head
                given = np.stack([doc[later], start[later], start[later] + size[later]])
                b = bucket_of(least, part_buckets)[0] << 1 | hot
                ask = np.flatnonzero(~later)
                ask = ask[np.argsort(b[ask], kind="stable")]
                c = cuts(b[ask])
                for x, y in zip(c[:-1], c[1:]):
                    own = ask[x:y]
                    to = int(b[own[0]])
                    row = (to >> 1, 1 + k % slices if to & 1 else 0, k, doc[own].tobytes(), start[own].astype(np.int32).tobytes(), size[own].astype(np.int32).tobytes(),
                           text[spread(place[own], size[own])].tobytes(), given.tobytes() if x == 0 else b"")
                    for column, v in zip(out.values(), row):
                        column.append(v)
        return pa.table({c: pa.array(v, pa.int64() if c in ("bucket", "slice", "chunk") else pa.binary()) for c, v in out.items()})

    def _parts_of(ids, data, bounds, known):
        """Document, start, size, least inner hash, digest of each part and whether it is hot; the stretches' bytes and places there."""
        first, end, h = anchors(data, bounds, length, inner)
        b, bits = bucket_of(h, anchor_buckets)
        key = bits.astype(np.int64) << 1 | b << 32
        i = np.minimum(np.searchsorted(known, key), max(0, len(known) - 1))
        hit = known[i] >> 1 == key >> 1 if len(known) else np.zeros(len(key), bool)
        first, end, hot = first[hit], end[hit], known[i[hit]] & 1
        of = np.searchsorted(bounds, first, side="right") - 1
        fresh = np.ones(len(first), bool)
        fresh[1:] = (first[1:] != end[:-1]) | (of[1:] != of[:-1]) | (hot[1:] != hot[:-1])
        head = np.flatnonzero(fresh)
        lo, hi = first[head], (end[np.r_[head[1:] - 1, len(end) - 1]] + length - 1) if len(head) else first[head]
        n = hi - lo
        inner_bounds = np.r_[0, np.cumsum(n)]
        where = np.repeat(lo - inner_bounds[:-1], n) + np.arange(inner_bounds[-1])
        stretch = np.ascontiguousarray(data[where]) if len(where) else np.zeros(0, np.uint8)
        a, z, least = anchors(stretch, inner_bounds, length, part_inner)
        s = np.searchsorted(inner_bounds, a, side="right") - 1
        size = z - a + length - 1
        digest = span_hashes(stretch, a, size)
        return (ids[of[head]][s] if len(head) else np.zeros(0, np.int64), (a - inner_bounds[s] + (lo - bounds[of[head]])[s]) if len(a) else a,
                size, least, digest, hot[head][s] if len(head) else np.zeros(0, np.int64), stretch, a)

    def entries(t: pa.Table):
        """Row, document, start, size and text place of each part of a table, its class of equal parts, and the classes' first ones."""
        doc, start, size = (_joined(t[c], kind) for c, kind in (("ids", np.int64), ("starts", np.int32), ("sizes", np.int32)))
        start, size = start.astype(np.int64), size.astype(np.int64)
        k = np.repeat(np.arange(len(t)), [len(x.as_py()) // 8 for x in t["ids"]])
        data = _joined(t["data"], np.uint8)
        place = np.cumsum(size) - size
        digest = span_hashes(data, place, size)
        o = np.lexsort((doc, digest))
        c = cuts(digest[o])
        lead = o[c[:-1]]
        cls = np.empty(len(o), np.int64)
        cls[o] = np.repeat(np.arange(len(lead)), np.diff(c))
        return k, doc, start, size, data, place, cls, lead

    def combine(t: pa.Table) -> pa.Table:
        """Of the equal parts of a slice those of the least document; the others are removed whatever comes."""
        release()
        chunk, bucket = t["chunk"].to_numpy(), t["bucket"][0].as_py()
        k, doc, start, size, data, place, cls, lead = entries(t)
        gone = doc > doc[lead][cls] if len(doc) else np.zeros(0, bool)
        rows = []
        stay, go = np.flatnonzero(~gone), np.flatnonzero(gone)  # both in the order of rows
        text = data[spread(place[stay], size[stay])]
        at, to = (np.searchsorted(k[x], np.arange(len(t) + 1)) for x in (stay, go))
        byte = np.r_[0, np.cumsum(size[stay])]
        for j in range(len(t)):
            x, y = at[j], at[j + 1]
            if y > x:
                own = stay[x:y]
                rows.append((bucket, int(chunk[j]), doc[own].tobytes(), start[own].astype(np.int32).tobytes(), size[own].astype(np.int32).tobytes(),
                             text[byte[x]:byte[y]].tobytes()))
            rest = go[to[j]:to[j + 1]]
            g = np.frombuffer(t["given"][j].as_py() or b"", np.int64).reshape(3, -1)
            if len(rest) or g.shape[1]:  # ready: to no bucket
                rows.append((-1 - int(chunk[j]), int(chunk[j]), np.r_[doc[rest], g[0]].tobytes(), np.r_[start[rest], g[1]].astype(np.int32).tobytes(),
                             np.r_[(start + size)[rest], g[2]].astype(np.int32).tobytes(), b""))
        return sent(rows)

    def sent(rows: list) -> pa.Table:
        columns = list(zip(*rows)) if rows else [[]] * 6
        return pa.table({c: pa.array(v, pa.int64() if c in ("bucket", "chunk") else pa.binary()) for c, v in zip(("bucket", "chunk", "ids", "starts", "sizes", "data"), columns)})

    def first_round(t: pa.Table) -> pa.Table:
        if t["slice"][0].as_py():
            return combine(t)
        done = settle(t)
        rows = zip(done["chunk"].to_pylist(), *(done[c].to_pylist() for c in ("ids", "starts", "ends")))
        return sent([(-1 - c, c, *x, b"") for c, *x in rows])

    def second_round(t: pa.Table) -> pa.Table:
        if t["bucket"][0].as_py() >= 0:
            return settle(t.append_column("given", pa.array([b""] * len(t), pa.binary())))
        return t.select(["chunk", "ids", "starts", "sizes"]).rename_columns(["chunk", "ids", "starts", "ends"])

    def settle(t: pa.Table) -> pa.Table:
        release()
        chunk = t["chunk"].to_numpy()
        k, doc, start, size, data, place, cls, lead = entries(t)
        gone = doc > doc[lead][cls]
        # the distinct parts, each with a byte after it that no string spans
        own, n = np.zeros(int(size[lead].sum()) + max(0, len(lead) - 1), np.uint8), size[lead]
        own[spread(np.cumsum(n + 1) - n - 1, n)] = data[spread(place[lead], n)]
        part, first, last = later_runs(own, n, doc[lead], length)
        # what is found for a part holds for all entries of its least document
        kept = np.flatnonzero(~gone)
        lo, hi = np.searchsorted(part, cls[kept]), np.searchsorted(part, cls[kept], side="right")
        i, r = np.repeat(kept, hi - lo), spread(lo, hi - lo)
        row = np.r_[k[gone], k[i]]
        doc, a, z = np.r_[doc[gone], doc[i]], np.r_[start[gone], start[i] + first[r]], np.r_[(start + size)[gone], start[i] + last[r] + length]
        o = np.lexsort((a, doc, row))
        row, doc, a, z = row[o], doc[o], a[o], z[o]
        fresh = np.ones(len(row), bool)
        if len(row):  # ranges of one document that overlap become one
            base = np.cumsum(np.r_[0, (row[1:] != row[:-1]) | (doc[1:] != doc[:-1])]) << 32
            reach = np.maximum.accumulate(base + z)
            fresh[1:] = (base + a)[1:] > reach[:-1]
            head = np.flatnonzero(fresh)
            end = np.r_[head[1:], len(row)] - 1
            row, doc, a, z = row[head], doc[head], a[head], reach[end] - base[end]
        at = np.searchsorted(row, np.arange(len(chunk) + 1))
        rows = []
        for j, g in enumerate(t["given"]):
            g = np.frombuffer(g.as_py() or b"", np.int64).reshape(3, -1)
            x, y = at[j], at[j + 1]
            if y > x or g.shape[1]:
                rows.append((int(chunk[j]), np.r_[doc[x:y], g[0]].tobytes(), *(np.r_[v[x:y], w].astype(np.int32).tobytes() for v, w in ((a, g[1]), (z, g[2])))))
        columns = list(zip(*rows)) if rows else [[], [], [], []]
        return pa.table({"chunk": pa.array(columns[0], pa.int64()), **{c: pa.array(v, pa.binary()) for c, v in zip(("ids", "starts", "ends"), columns[1:])}})

    packed = "bucket bigint, chunk bigint, packed binary"
    found = docs.groupBy("__chunk").applyInArrow(find, packed)
    shared = found.groupBy("bucket").applyInArrow(meet, "chunk bigint, bucket bigint, packed binary")
    parts = docs.groupBy("__chunk").cogroup(shared.groupBy("chunk")).applyInArrow(
        cut_parts, "bucket bigint, slice bigint, chunk bigint, ids binary, starts binary, sizes binary, data binary, given binary")
    first = parts.groupBy("bucket", "slice").applyInArrow(first_round, "bucket bigint, chunk bigint, ids binary, starts binary, sizes binary, data binary")
    return first.groupBy("bucket").applyInArrow(second_round, "chunk bigint, ids binary, starts binary, ends binary")


def span_hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of ``data``."""
    if not len(start):
        return np.zeros(0, _U)
    up, down = bytehash._powers(1 << max(20, (len(data) - 1).bit_length()))
    running = np.r_[_U(0), np.cumsum(bytehash.mix(data.astype(_U) + _U(1)) * up[:len(data)], dtype=_U)]
    return bytehash.mix((running[start + size] - running[start]) * down[start] + size.astype(_U) * _U(0xD6E8FEB86659FD93))


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal ranges of their union; ranges that touch are one."""
    o = np.argsort(start, kind="stable")
    start, reach = start[o], np.maximum.accumulate(end[o])
    fresh = np.r_[True, start[1:] > reach[:-1]]
    head = np.flatnonzero(fresh)
    return start[head], reach[np.r_[head[1:] - 1, len(reach) - 1]]


def _with_removals(docs: DataFrame, length: int, act, schema) -> DataFrame:
    """``act(rows, [(kept bytes, removed, spans), ...])`` over the chunks of ``docs``."""
    bound_batches(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks, anchor_buckets, part_buckets = (max(16, -(-size // x)) for x in (CHUNK_BYTES, ANCHOR_BUCKET_BYTES, PART_BUCKET_BYTES))
    hashed = F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 2) + F.lit(NO_ID)
    dealt = docs.withColumn("__key", F.coalesce(F.col("doc_id").cast("long"), hashed))
    dealt = dealt.withColumn("__chunk", F.pmod(F.xxhash64("__key"), F.lit(chunks)).cast("long"))
    plan = plan_removals(dealt, length, anchor_buckets, part_buckets, math.isqrt(chunks) + 1)

    def finish(t: pa.Table, spans: pa.Table) -> pa.Table:
        release()
        ids = t["__key"].to_numpy()
        doc, a, z = (_joined(spans[c], kind) for c, kind in (("ids", np.int64), ("starts", np.int32), ("ends", np.int32)))
        o = np.argsort(doc, kind="stable")
        doc, a, z = doc[o], a[o], z[o]
        lo, hi = np.searchsorted(doc, ids), np.searchsorted(doc, ids, side="right")
        done = []
        for text, x, y in zip(t["text"], lo, hi):
            raw = (text.as_py() or "").encode()
            if x == y:
                done.append((raw, 0, 0))
                continue
            first, end = merged(a[x:y], z[x:y])
            kept = b"".join(raw[p:q] for p, q in zip(np.r_[0, end], np.r_[first, len(raw)]))
            done.append((kept, len(raw) - len(kept), len(first)))
        return act(t, done)

    return dealt.groupBy("__chunk").cogroup(plan.groupBy("chunk")).applyInArrow(finish, schema)


def removals(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of ``docs(doc_id bigint, text)``.

    Rows that share an id must not differ in text.
    """

    def act(t: pa.Table, done) -> pa.Table:
        return pa.table({
            "doc_id": t["doc_id"], "n_bytes": pa.array([len(k) + r for k, r, _ in done], pa.int64()),
            "n_removed": pa.array([r for _, r, _ in done], pa.int64()), "n_spans": pa.array([s for _, _, s in done], pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k, _, _ in done], pa.string())})

    return _with_removals(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), length, act,
                          "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def trimmed(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with the kept bytes as ``text``; broken characters at the seams are left out.

    Documents of which nothing is kept, though they had a text, go.
    """
    columns = docs.columns

    def act(t: pa.Table, done) -> pa.Table:
        text = [k.decode("utf-8", "ignore") if r else x for (k, r, _), x in zip(done, t["text"].to_pylist())]
        out = t.select(columns).set_column(columns.index("text"), "text", pa.array(text, pa.string()))
        if "n_chars" in columns:
            n = [len(x) if r else old for x, (_, r, _), old in zip(text, done, t["n_chars"].to_pylist())]
            out = out.set_column(columns.index("n_chars"), "n_chars", pa.array(n, out.schema.field("n_chars").type))
        return out.filter(pa.array([not r or bool(x) for x, (_, r, _) in zip(text, done)], pa.bool_()))

    return _with_removals(docs, length, act, docs.schema)


#: A table of all strings of 50 bytes, in hexadecimal digits.
ORACLE = """
WITH h AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
n AS (SELECT *, (length(h) // 2)::BIGINT AS n FROM h),
g AS (SELECT doc_id, p, substring(h, 2 * p + 1, 100) AS g FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS p FROM n)),
hit AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY g) AS first FROM g) WHERE doc_id > first),
isle AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM (
  SELECT *, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS fresh FROM hit)),
run AS (SELECT doc_id, k, min(p) AS a, max(p) + 50 AS z FROM isle GROUP BY doc_id, k),
gap AS (
  SELECT doc_id, coalesce(lag(z) OVER w, 0) AS a, a AS z FROM run WINDOW w AS (PARTITION BY doc_id ORDER BY a)
  UNION ALL SELECT n.doc_id, coalesce(max(z), 0), any_value(n) FROM n LEFT JOIN run USING (doc_id) GROUP BY n.doc_id),
kept AS (SELECT doc_id, string_agg(substring(h, 2 * a + 1, 2 * (z - a)), '' ORDER BY a) AS t FROM gap JOIN h USING (doc_id) GROUP BY doc_id)
SELECT n.doc_id, n AS n_bytes, (n - length(t) // 2)::BIGINT AS n_removed, (SELECT count(*) FROM run WHERE run.doc_id = n.doc_id)::BIGINT AS n_spans, sha256(unhex(t)) AS kept_sha256
FROM n JOIN kept USING (doc_id)
"""
