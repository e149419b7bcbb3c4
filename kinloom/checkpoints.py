"""Results that several parts of a plan read are written once to the shared checkpoint folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session: ``spark.checkpoint.dir``, or one that was set before.

    Without either, a local master gets a folder beside its warehouse; a cluster
    raises an error, as executors can't read a folder of the driver's machine.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("a cluster needs spark.checkpoint.dir, a folder that all its machines share")
        named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-checkpoints"
    sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame) -> DataFrame:
    """``df`` from a checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def shared_folder(spark: SparkSession) -> Iterator[str]:
    """A fresh path in the checkpoint folder, deleted at the end."""
    path = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    try:
        yield path
    finally:
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def write_file(spark: SparkSession, path: str, content: bytes) -> None:
    """One small file, wherever the session's file systems reach."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()
