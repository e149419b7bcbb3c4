"""Block-gzipped text, read and written by many tasks.

A block-gzipped file is a row of gzip members of at most 64 KiB, each with its
size in a fixed header. Spark takes any ``.gz`` file for one stream, so the file
is read by a link in a view file system, under a name without that ending, and
is then split like any other: its records are what lies between two headers. A
task inflates the blocks that begin in its split and cuts them into lines; what
crosses the edge of a split is put together from one or two short rows a split.

Defined results: the same lines as the decompressed file has; empty blocks give
nothing; a block of the wrong size or checksum raises an error.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# What begins a block (gzip's mark, flags, no time, the extra field BC), and the empty block that ends a file.
HEAD = bytes([0x1F, 0x8B, 0x08, 0x04, 0, 0, 0, 0, 0, 0xFF, 6, 0, 0x42, 0x43, 2, 0])
END = HEAD + bytes([0x1B, 0, 3, 0, 0, 0, 0, 0, 0, 0, 0, 0])
#: Bytes of text in a block that is written.
BLOCK_BYTES = 0xFF00


def block(text: bytes) -> bytes:
    """One block that holds at most ``BLOCK_BYTES`` bytes."""
    for level in (6, 0):
        packer = zlib.compressobj(level, zlib.DEFLATED, -15)
        body = packer.compress(text) + packer.flush()
        size = len(HEAD) + 2 + len(body) + 8
        if size <= 1 << 16:
            return HEAD + struct.pack("<H", size - 1) + body + struct.pack("<II", zlib.crc32(text), len(text))
    raise ValueError("too much text for a block")


def inflated(record: bytes) -> bytes:
    """The text of a block without its ``HEAD``."""
    if len(record) < 10 or struct.unpack_from("<H", record)[0] + 1 != len(HEAD) + len(record):
        raise ValueError("a block of the wrong size")
    text = zlib.decompress(record[2:-8], -15)
    if struct.unpack_from("<II", record, len(record) - 8) != (zlib.crc32(text), len(text)):
        raise ValueError("a block with the wrong checksum")
    return text


def first_bytes(spark: SparkSession, path: str, n: int) -> bytes:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    opened = where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where)
    try:
        out = bytearray()
        while len(out) < n and (b := opened.read()) >= 0:
            out.append(b)
        return bytes(out)
    finally:
        opened.close()


def is_block_gzip(spark: SparkSession, files: list[str]) -> bool:
    """Whether all of the files begin with a block's header."""
    return bool(files) and all(first_bytes(spark, f, len(HEAD)) == HEAD for f in files)


def records(spark: SparkSession, files: list[str]) -> DataFrame:
    """``file, start, record``: the blocks of each file without their header, in order within each split; ``file`` is a place in the list."""
    view = f"kinloom-{uuid.uuid4().hex}"
    width = len(str(len(files)))
    links = {f"fs.viewfs.mounttable.{view}.link./blocks/{i:0{width}d}": f for i, f in enumerate(files)}
    raw = spark.read.options(**links, encoding="ISO-8859-1", lineSep=HEAD.decode("latin1")).text([f"viewfs://{view}/blocks/{i:0{width}d}" for i in range(len(files))])
    return raw.select(
        F.element_at(F.split(F.input_file_name(), "/"), -1).cast("int").alias("file"), F.input_file_block_start().alias("start"),
        F.col("value").cast("binary").alias("record"))


def _cut(batches) -> Iterator[pa.RecordBatch]:
    """``file, start, nth, line, whole``: whole lines of a split, and what lies before its first (nth 0) and
    after its last line end (``whole`` false); nth of what follows the last end is that of the line it begins, and
    a split without a line end has one row, of nth -1."""
    split, tail, lines, ended = None, [], 0, False

    def out(texts: list[bytes], first: int, whole: list[bool]) -> pa.RecordBatch:
        n = len(texts)
        return pa.RecordBatch.from_arrays(
            [pa.array([split[0]] * n, pa.int32()), pa.array([split[1]] * n, pa.int64()), pa.array(range(first, first + n), pa.int64()),
             pa.array(texts, pa.binary()), pa.array(whole, pa.bool_())], names=["file", "start", "nth", "line", "whole"])

    def rest():
        if split is not None and (tail or ended):
            yield out([b"".join(tail)], lines if ended else -1, [False])

    for b in batches:
        for file, start, record in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            if (file, start) != split:
                yield from rest()
                split, tail, lines, ended = (file, start), [], 0, False
            raw = record.as_py()
            text = inflated(raw) if raw else b""
            *own, last = text.split(b"\n")
            if own:
                own[0] = b"".join([*tail, own[0]])
                yield out(own, lines, [ended, *[True] * (len(own) - 1)])
                tail, lines, ended = [], lines + len(own), True
            if last:
                tail.append(last)
    yield from rest()


def read_lines(spark: SparkSession, files: list[str]) -> DataFrame:
    """``value, file, block, nth``: the lines of block-gzipped files and their order; each split is a task of its own."""
    from ..checkpoints import written

    cut = records(spark, files).mapInArrow(_cut, "file int, start bigint, nth bigint, line binary, whole boolean")
    text = F.regexp_replace(F.col("line").cast("string"), "\r$", "")
    whole = cut.where("whole").select(text.alias("value"), "file", F.col("start").alias("block"), "nth")
    # two rows a split at most: what ends a line, what begins one, or a part from the middle of one
    edges = written(cut.where("not whole"))
    order = Window.partitionBy("file").orderBy("start", "nth")
    ends = F.when(F.col("nth") == 0, 1).otherwise(0)  # a line end follows
    part = F.sum(ends).over(order.rowsBetween(Window.unboundedPreceding, -1))
    joined = edges.withColumn("part", F.coalesce(part, F.lit(0))).groupBy("file", "part").agg(
        F.array_sort(F.collect_list(F.struct("start", "nth", "line"))).alias("p"))
    line = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["line"]))
    crossing = joined.select(
        line.alias("line"), "file", F.col("p")[0]["start"].alias("block"), F.col("p")[0]["nth"].alias("nth"), F.max(F.col("part")).over(Window.partitionBy("file")).alias("_last"), "part")
    crossing = crossing.where((F.length("line") > 0) | (F.col("part") < F.col("_last")))  # nothing follows the last line end
    return whole.unionByName(crossing.select(text.alias("value"), "file", "block", "nth"))


def write_lines(lines: DataFrame, path: str) -> None:
    """``value`` of each row as lines of block-gzipped parts, in the order of each partition.

    Spark's own writer commits the parts: what it puts after each row is the empty block."""

    def run(batches):
        held, size = [], 0

        def out(texts: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([block(t) for t in texts], pa.binary())], names=["value"])

        for b in batches:
            text = "".join(f"{x}\n" for x in b.column(0).to_pylist()).encode()
            held.append(text)
            size += len(text)
            if size >= BLOCK_BYTES:
                whole = b"".join(held)
                upto = len(whole) - len(whole) % BLOCK_BYTES
                yield out([whole[i:i + BLOCK_BYTES] for i in range(0, upto, BLOCK_BYTES)])
                held, size = [whole[upto:]], len(whole) - upto
        if size:
            yield out([b"".join(held)])

    blocks = lines.select("value").mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    blocks.write.mode("overwrite").option("encoding", "ISO-8859-1").option("lineSep", END.decode("latin1")).text(path)
