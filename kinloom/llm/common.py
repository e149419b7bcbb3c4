"""Helpers shared by the operators: tables, checkpoints, connected components."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import shared_dir

#: Characters that separate words: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


#: Bytes and rows of an Arrow batch that goes to a Python worker, at most.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 2000


def bound_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches than the usual 10000 rows or 64 MB, unless the session sets its own."""
    for key, usual, value in (("maxBytesPerBatch", "67108864b", f"{BATCH_BYTES}b"), ("maxRecordsPerBatch", "10000", str(BATCH_ROWS))):
        name = f"spark.sql.execution.arrow.{key}"
        if spark.conf.get(name, None) == usual:
            spark.conf.set(name, value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; an error where a cluster names none."""
    return shared_dir(spark)


#: Narrow rows of a checkpoint file, about.
FILE_ROWS = 1 << 18


def cut(df: DataFrame, rows: int | None = None, each: int = FILE_ROWS) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there.

    A checkpoint has a file for each partition. Where about how many ``rows`` come
    is known, partitions are put together without a shuffle into files of about
    ``each`` rows, but not into fewer than two for each core.
    """
    checkpoint_dir(df.sparkSession)
    if rows is not None:
        df = df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-rows // each)))
    return df.checkpoint(eager=True)


def connected_components(edges: DataFrame, max_rounds: int = 200, rows: int | None = None) -> DataFrame:
    """Smallest id reachable from each node of ``edges(a, b)``.

    Alternates large-star and small-star steps (both are one aggregate and one
    join on the node), so no neighbour list is ever gathered: a hub is reduced
    by partial aggregation and its join side is split by adaptive execution.
    Returns ``(id, component)`` for nodes that have a link; self links and nulls
    are ignored. An empty input gives an empty result. Rounds grow with the logarithm
    of a component's size; labels that aren't final after ``max_rounds`` raise an error.
    """
    e = (
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where("u <> v").distinct()
    )
    e = cut(e, rows)
    rows = e.count()
    before = None
    for _ in range(max_rounds):
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v").distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                      F.struct(F.col("u"), F.col("m").alias("v")))).alias("p"))
            .select("p.u", "p.v").where("u <> v").distinct()
        )
        e = cut(small, 2 * rows)
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.count_distinct("u")).first()
        if now == before or now[0] == now[2] and e.join(
            e.select(F.col("u").alias("v")), "v", "left_semi"
        ).isEmpty():
            break
        before = now
    else:
        raise RuntimeError(f"components aren't final after {max_rounds} rounds")
    out = e.groupBy("u").agg(F.min("v").alias("component"))
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return out.select(F.col("u").alias("id"), "component").unionByName(roots)


#: A set of ids is broadcast as bitmaps of 32768 ids while they take at most so many bytes.
BITMAP_BYTES, BITMAP_PAGE = 32 << 20, 4096


def among(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """The rows of ``df`` whose bigint ``column`` is in the one column of ``ids``; null isn't.

    The ids are packed into bitmap pages. Only if the counted pages are few
    enough are they broadcast, which spares the rows a shuffle; otherwise this is
    a plain semi join.
    """
    (name,) = ids.columns
    pages = cut(ids.where(F.col(name).isNotNull()).groupBy(F.bitmap_bucket_number(name).alias("_page")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(name)).alias("_bits")), 0)
    if pages.count() * BITMAP_PAGE > BITMAP_BYTES:
        return df.join(ids.select(F.col(name).alias("_id")).distinct(), F.col(column) == F.col("_id"), "left_semi")
    at = F.bitmap_bit_position(column)
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.call_function("shiftright", byte, F.pmod(at, F.lit(8)).cast("int")).bitwiseAND(F.lit(1))
    return df.join(F.broadcast(pages), F.bitmap_bucket_number(column) == F.col("_page")).where(bit == 1).drop("_page", "_bits")


def release() -> None:
    """Gives the freed memory of a Python worker, which later stages use again, back to the system."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def tree_fold(df: DataFrame, fold: Callable[[Iterable], Any], merge: Callable[[Any, Any], Any]) -> Any:
    """What ``fold`` makes of the Arrow batches of each task, merged by a tree of tasks; None without tasks.

    The rows stay where they are read: only the folded values, which must not
    grow with a task's rows, move. ``merge`` takes two of them.
    """

    def run(batches):
        import pyarrow as pa

        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fold(batches))], pa.binary())], names=["value"])

    def both(a, b):
        return b if a is None else a if b is None else merge(a, b)

    return df.mapInArrow(run, "value binary").rdd.map(lambda r: pickle.loads(r[0])).treeAggregate(None, both, both, depth=3)


def two_level_offsets(df: DataFrame, key: list[str], part: str, size: Column | None) -> DataFrame:
    """Rows (or words) of the parts before each part of a key: ``key, part, base``.

    ``part`` has a bounded number of values for each key, so the window sees
    one row for each of them and never the rows of a hot key.
    """
    from pyspark.sql import Window

    total = F.count("*") if size is None else F.sum(size)
    sums = df.groupBy(*key, part).agg(total.alias("_n"))
    w = Window.partitionBy(*key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*key, part, F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("base"))
