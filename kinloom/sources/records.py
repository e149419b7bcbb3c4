"""Segments of 28-byte records as a Spark data source, ``spark.read.format("kinloom_segments")``.

A file is read in ranges of whole records, each by a task of its own, so its size doesn't matter. Tasks write
under a temporary name; the parts get theirs when all tasks are done (commit), and a failed or repeated task leaves
none (abort). Paths are local ones, or what pyarrow's file systems open.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

NAME = "kinloom_segments"
WHOLE = ("h1", "h2", "start_idx", "end_idx", "start_bp", "end_bp")
SCHEMA = ", ".join([*(f"{c} bigint" for c in WHOLE), "length_cm double"])
RECORD = np.dtype([*((c, "<i4") for c in WHOLE), ("length_cm", "<f4")])
#: Records of a task, and of a batch in it, unless the options ``records`` and ``batch`` say otherwise.
TASK_RECORDS, BATCH_RECORDS = 1 << 22, 1 << 16


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """A file system of pyarrow for the path, and the path there."""
    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path
    return fs.FileSystem.from_uri(path)


def batch_of(raw: bytes | memoryview) -> pa.RecordBatch:
    rows = np.frombuffer(raw, RECORD, len(raw) // RECORD.itemsize)
    return pa.RecordBatch.from_arrays(
        [*(pa.array(rows[c].astype(np.int64)) for c in WHOLE), pa.array(rows["length_cm"].astype(np.float64))], names=[*WHOLE, "length_cm"])


@dataclass
class Range(InputPartition):
    """Records of a file."""

    path: str
    first: int
    count: int


@dataclass
class Part(WriterCommitMessage):
    """A part that a task wrote under a temporary name."""

    written: str
    name: str
    records: int


class SegmentReader(DataSourceReader):
    def __init__(self, path: str, task: int, batch: int):
        self.path, self.task, self.batch = path, task, batch

    def partitions(self) -> list[Range]:
        """Ranges of the files in name order; what isn't a whole record at a file's end is left out."""
        where, top = file_system(self.path)
        info = where.get_file_info(top)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.type == fs.FileType.File else where.get_file_info(fs.FileSelector(top))
        files = sorted((f.path, f.size // RECORD.itemsize) for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))
        return [Range(p, a, min(self.task, n - a)) for p, n in files for a in range(0, n, self.task)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.count:
            return
        where, _ = file_system(self.path)
        with where.open_input_file(partition.path) as f:
            f.seek(partition.first * RECORD.itemsize)
            left = partition.count
            while left:
                raw = f.read(min(left, self.batch) * RECORD.itemsize)
                if len(raw) % RECORD.itemsize or not raw:
                    raise EOFError(f"{partition.path} is shorter than when it was listed")
                left -= len(raw) // RECORD.itemsize
                yield batch_of(raw)


class SegmentWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def _folder(self, top: str) -> str:
        return f"{top}/_writing-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        from pyspark import TaskContext

        where, top = file_system(self.path)
        task = TaskContext.get()
        folder = self._folder(top)
        where.create_dir(folder, recursive=True)
        own, n = f"{folder}/{task.partitionId()}-{task.taskAttemptId()}", 0
        with where.open_output_stream(own) as out:
            for b in iterator:
                rows = np.empty(len(b), RECORD)
                for c in (*WHOLE, "length_cm"):
                    rows[c] = b.column(c).to_numpy(zero_copy_only=False)
                out.write(rows.tobytes())
                n += len(b)
        return Part(own, f"part-{task.partitionId():05d}-{self.job[:8]}.bin", n)

    def commit(self, messages: list[Part | None]) -> None:
        where, top = file_system(self.path)
        old = [f.path for f in where.get_file_info(fs.FileSelector(top, allow_not_found=True)) if f.type == fs.FileType.File] if self.overwrite else []
        where.create_dir(top, recursive=True)
        for m in messages:
            if m is not None:
                where.move(m.written, f"{top}/{m.name}")
        for path in old:  # after the new parts are there
            where.delete_file(path)
        self._clear(where, top)

    def abort(self, messages: list[Part | None]) -> None:
        self._clear(*file_system(self.path))

    def _clear(self, where: fs.FileSystem, top: str) -> None:
        """The temporary folder goes, with what failed or repeated attempts left there."""
        if where.get_file_info(self._folder(top)).type == fs.FileType.Directory:
            where.delete_dir(self._folder(top))


class SegmentSource(DataSource):
    """``path``; options ``records`` (of a task) and ``batch``. Writing appends, or replaces all parts with ``overwrite``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> SegmentReader:
        return SegmentReader(self.options["path"], int(self.options.get("records", TASK_RECORDS)), int(self.options.get("batch", BATCH_RECORDS)))

    def writer(self, schema: StructType, overwrite: bool) -> SegmentWriter:
        return SegmentWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(SegmentSource)
    return spark


def read(spark: SparkSession, path: str, **options: int) -> DataFrame:
    return register(spark).read.format(NAME).options(**options).load(path)


def write(segs: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows = segs.selectExpr(*(f"cast({c} as bigint) {c}" for c in WHOLE), "cast(length_cm as double) length_cm")
    register(segs.sparkSession)
    rows.write.format(NAME).mode(mode).save(path)
