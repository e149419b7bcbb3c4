"""Best-two-fit packing of tokenised documents into sequences of bounded length.

Documents longer than a sequence are cut into full pieces, the remainder first.
Pieces of one length can stand for each other, so the packing is worked out on
the histogram of lengths (as many entries as a sequence has tokens, whatever
the corpus): a bin is filled greedily with the longest pieces that fit, then
its smallest piece gives way to the two unpacked pieces that fit its expanded
gap more tightly. The bin is repeated as often as the histogram allows, and
the pieces take their places by rank among those of their length.

Defined results: a null text is an empty one, whose only token is the end mark;
repeated rows are documents of their own; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .common import bound_batches, cut, release, two_level_offsets

SEQUENCE_TOKENS = 1024
END_ID = 2
#: Pieces of one length are ranked in parts of about so many rows.
RANK_ROWS = 200_000


def pieces_of(ids: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Starts and lengths: full pieces, after one that takes the remainder."""
    n = len(ids)
    first = n % most or min(n, most)
    starts = [0, *range(first, n, most)]
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], n])]


def cut_documents(docs: DataFrame, most: int = SEQUENCE_TOKENS, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of ``docs(doc_id, text)``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    bound_batches(docs.sparkSession)

    def run(batches):
        where = path or tokens.default_path()
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for i, text in zip(b.column(0).to_pylist(), b.column(1)):
                own = np.append(tokens.ids(text.as_py() or "", where, added=True), np.uint32(end_id)).astype("<u4")
                for k, (start, n) in enumerate(pieces_of(own, most)):
                    for column, v in zip(out, (i, k, start, n, zlib.crc32(own[start:start + n].tobytes()))):
                        column.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], b.schema.field(0).type), *(pa.array(x, t) for x, t in zip(out[1:], (pa.int32(), pa.int64(), pa.int64(), pa.int64())))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )
        release()

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"
    )


def best_two_fit(counts: dict[int, int], most: int) -> list[tuple[list[int], int]]:
    """Bins ``(lengths, times)`` that hold all pieces of the histogram ``counts``."""
    left = {n: c for n, c in counts.items() if c > 0}
    sizes = sorted(left)
    bins: list[tuple[list[int], int]] = []
    while sizes:
        used: Counter = Counter()
        free = lambda n: left.get(n, 0) - used[n]

        def longest(room: int) -> int:
            i = bisect_right(sizes, room) - 1
            while i >= 0 and free(sizes[i]) <= 0:
                i -= 1
            return sizes[i] if i >= 0 else 0

        own = [sizes[-1]]
        used[own[0]] += 1
        gap = most - own[0]
        while gap and (n := longest(gap)):
            own.append(n)
            used[n] += 1
            gap -= n
        if gap and len(own) > 1:
            small = own[-1]
            used[small] -= 1
            if pair := tightest_pair(sizes, free, small + gap, small):
                own[-1:] = pair
                used.update(pair)
            else:
                used[small] += 1
        times = min(left[n] // c for n, c in used.items() if c)
        bins.append((own, times))
        for n, c in used.items():
            if c:
                left[n] -= c * times
                if not left[n]:
                    del left[n]
                    sizes.remove(n)
    return bins


def tightest_pair(sizes: list[int], free, room: int, more_than: int) -> list[int] | None:
    """The two free pieces with the largest sum of at most ``room``, if over ``more_than``."""
    best, pair = more_than, None
    i, j = 0, bisect_right(sizes, room) - 1
    while i <= j:
        a, b = sizes[i], sizes[j]
        if free(a) < 1:
            i += 1
        elif free(b) < 1:
            j -= 1
        elif a + b > room or i == j and free(a) < 2:
            j -= 1
        else:
            if a + b > best:
                best, pair = a + b, [b, a]
            i += 1
    return pair


def placement(bins: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """Where the pieces of each length go, by rank: sorted by ``(length, first rank)``.

    ``each`` consecutive ranks share a sequence, in places ``length`` apart.
    """
    rows, nth, sequence = [], Counter(), 0
    for lengths, times in bins:
        offset = 0
        for n in dict.fromkeys(lengths):
            each = lengths.count(n)
            rows.append((n, nth[n], each, sequence, offset))
            nth[n] += each * times
            offset += each * n
        sequence += times
    rows.sort()
    at = np.array(rows, dtype=np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "each", "sequence", "offset"), at.T.copy()))


def pack(pieces: DataFrame, most: int = SEQUENCE_TOKENS) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to ``pieces(doc_id, piece, start, length, ids_crc32)``."""
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `most` rows
    where = placement(best_two_fit(histogram, most))
    parts = max(16, sum(histogram.values()) // RANK_ROWS)
    p = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)))
    base = two_level_offsets(p, ["length"], "part", None)
    order = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        p.withColumn("nth", F.row_number().over(order) - 1).join(base, ["length", "part"])
        .select(*pieces.columns, (F.col("nth") + F.col("base")).cast("long").alias("nth"))
    )
    schema = pieces.schema.add("sequence_id", "long").add("offset", "long")

    def place(batches):
        key = where["length"] << 42 | where["rank"]
        for b in batches:
            n, nth = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "nth"))
            i = np.searchsorted(key, n << 42 | nth, side="right") - 1
            past = nth - where["rank"][i]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(where["sequence"][i] + past // where["each"][i]),
                 pa.array(where["offset"][i] + past % where["each"][i] * n)],
                names=[*b.schema.names[:-1], "sequence_id", "offset"],
            )

    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, most: int = SEQUENCE_TOKENS, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Pieces of ``docs(doc_id, text)`` with their places; tokenises every text once."""
    return pack(cut(cut_documents(docs, most, path, end_id)), most)
