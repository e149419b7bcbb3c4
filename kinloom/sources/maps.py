"""Genetic maps: PLINK (``chrom strand cm bp``) and HapMap (``chrN bp rate cm``) text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parsed(lines: DataFrame) -> DataFrame:
    """``chrom, bp, cm`` of lines ``value``; blank ones are skipped, a malformed one raises an error.

    A line whose first three characters are ``chr`` is in HapMap form."""
    f = F.split(F.trim("value"), r"\s+")
    rows = lines.where(F.trim("value") != "").select(f.alias("f"), "value").where(~F.lower(F.col("f")[1]).startswith("position"))
    hapmap = F.col("f")[0].startswith("chr")
    bp = F.when(hapmap, F.get("f", F.lit(1))).otherwise(F.get("f", F.lit(3)))
    cm = F.when(hapmap, F.get("f", F.lit(3))).otherwise(F.get("f", F.lit(2)))
    rows = rows.select("value", F.regexp_replace(F.col("f")[0], "^chr", "").alias("chrom"), bp.try_cast("long").alias("bp"), cm.try_cast("double").alias("cm"))
    bad = F.raise_error(F.concat(F.lit("malformed map line: "), "value"))
    return rows.select(
        "chrom", F.coalesce("bp", bad.cast("long")).alias("bp"), F.coalesce("cm", bad.cast("double")).alias("cm"))


def read_map(spark: SparkSession, path: str) -> DataFrame:
    return parsed(spark.read.text(path))


def plink_lines(knots: DataFrame) -> DataFrame:
    """``value``: knots as PLINK text, ``chrom . cm bp``; 0.0 is written as 0."""
    cm = F.when(F.col("cm") == 0, "0").otherwise(F.col("cm").cast("string"))
    return knots.select(F.concat_ws(" ", "chrom", F.lit("."), cm, F.col("bp").cast("string")).alias("value"))
