"""From raw documents to packed training sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)``, works on all that the stage before
it kept and returns the columns of ``documents``; the last returns the pieces of
the packed sequences. Stages are written as Parquet and read again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from kinloom.llm import language, mixing, neardup, packing, repeats
from kinloom.llm.common import checkpoint_dir, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language go."""
    return language.accepted(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays (five-word shingles, 0.8)."""
    return neardup.deduplicated(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of 50-byte strings that an earlier document holds go."""
    return repeats.trimmed(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, the last time perhaps in part, in the order of its schedule."""
    return mixing.mixed_documents(docs, in_order=True)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequences and places there."""
    return packing.pack_documents(docs)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", drop_repeats),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Tokens, signatures and learned languages can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; what lies between them goes once it has been read."""
    top = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(top)
    docs = table(spark, sf_dir, "documents")
    try:
        for name, stage in STAGES[:-1]:
            stage(spark, docs, sf_dir).write.parquet(f"{top}/{name}")
            docs = spark.read.parquet(f"{top}/{name}")
        return STAGES[-1][1](spark, docs, sf_dir)  # its pieces are in a checkpoint
    finally:
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
