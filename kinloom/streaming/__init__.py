"""Segment files that keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.extend import reported

SEGMENTS = ("chrom string, h1 bigint, h2 bigint, start_idx bigint, end_idx bigint, start_bp bigint, end_bp bigint, length_cm double")


def reported_stream(spark: SparkSession, path: str, min_output: float = 2.0) -> DataFrame:
    """A stream of the segments in a folder of Parquet files that pass the output predicate."""
    return reported(spark.readStream.schema(SEGMENTS).parquet(path), min_output)
