"""Segment files, datasets of features, and their writers."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import records

INDEXED = "sample1 int, hap1 int, sample2 int, hap2 int, start_bp bigint, end_bp bigint, cm double"
NAMED = "id1 string, hap1 int, id2 string, hap2 int, chrom string, start_bp bigint, end_bp bigint, cm double"
TRUTH = "hap1 bigint, hap2 bigint, start_bp bigint, end_bp bigint, cm_start double, cm_end double"


def six(x: Column) -> Column:
    return F.format_string("%.6f", x)


def indexed_rows(segs: DataFrame) -> DataFrame:
    """``s1 h1 s2 h2 start_bp end_bp cm`` with samples and haplotypes counted from 0."""
    return segs.select(
        F.shiftright("h1", 1).alias("sample1"), (F.col("h1") % 2).alias("hap1"), F.shiftright("h2", 1).alias("sample2"),
        (F.col("h2") % 2).alias("hap2"), "start_bp", "end_bp", six(F.col("length_cm")).alias("cm"))


def named_rows(segs: DataFrame, samples: DataFrame) -> DataFrame:
    """``id1 hap1 id2 hap2 chrom start_bp end_bp cm`` with sample names and haplotypes counted from 1."""
    one = samples.select(F.col("sample_idx").alias("_s1"), F.col("sample_id").alias("id1"))
    two = samples.select(F.col("sample_idx").alias("_s2"), F.col("sample_id").alias("id2"))
    s = segs.withColumn("_s1", F.shiftright("h1", 1)).withColumn("_s2", F.shiftright("h2", 1))
    return s.join(one, "_s1").join(two, "_s2").select(
        "id1", (F.col("h1") % 2 + 1).alias("hap1"), "id2", (F.col("h2") % 2 + 1).alias("hap2"), "chrom", "start_bp", "end_bp", six(F.col("length_cm")).alias("cm"))


def write_tsv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, sep="\t")


def write_dataset(features: DataFrame, path: str) -> None:
    features.write.mode("overwrite").csv(path, header=True)


def save_bucketed(segs: DataFrame, name: str, buckets: int, key: tuple[str, str] = ("h1", "h2")) -> DataFrame:
    """The table ``name`` of the catalog: segments in ``buckets`` files, dealt out and sorted by their pair.

    Tables with the same number of buckets meet without a shuffle (see :func:`side_by_side`)."""
    segs.repartition(buckets, *key).write.mode("overwrite").bucketBy(buckets, *key).sortBy(*key).saveAsTable(name)
    return segs.sparkSession.table(name)


@contextmanager
def side_by_side(spark: SparkSession) -> Iterator[None]:
    """Plans made in here join tables where their buckets are, though the joins have further keys than the buckets."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a tab separated file; lines that don't fit the schema are left out."""
    return spark.read.csv(path, sep="\t", schema=schema, mode="DROPMALFORMED")


def read_binary(spark: SparkSession, path: str, **options: int) -> DataFrame:
    """Segments of 28-byte records, by ranges of whole records; a rest of fewer bytes is left out."""
    return records.read(spark, path, **options)


def write_binary(segs: DataFrame, path: str) -> int:
    """A folder of 28-byte records, a file for each partition, in place of what was there; returns how many records it has.

    The records are counted as they are written."""
    from pyspark.sql import Observation

    seen = Observation("records")
    records.write(segs.observe(seen, F.count("*").alias("n")), path)
    return seen.get["n"]


def normalized(named: DataFrame) -> DataFrame:
    """``id1, id2, start, end, cm`` with haplotype numbers for ids: ``tsk_7`` and haplotype 2 give 15."""
    number = lambda i, h: 2 * F.regexp_replace(i, "^tsk_", "").cast("long") + F.col(h) - 1
    return named.select(
        number("id1", "hap1").alias("id1"), number("id2", "hap2").alias("id2"),
        F.col("start_bp").cast("double").alias("start"), F.col("end_bp").cast("double").alias("end"), "cm")


def normalized_truth(truth: DataFrame) -> DataFrame:
    return truth.select(
        F.col("hap1").alias("id1"), F.col("hap2").alias("id2"), F.col("start_bp").cast("double").alias("start"),
        F.col("end_bp").cast("double").alias("end"), (F.col("cm_end") - F.col("cm_start")).alias("cm"))


def at_least(segs: DataFrame, cm: float) -> DataFrame:
    return segs.where(F.col("cm") >= cm)


def dataset_rows(dataset: DataFrame, prediction: str, chrom: str = "20", chunks: int = 10) -> DataFrame:
    """Rows that a model keeps (prediction 0) as named segments; their length is that of the chunks, to 3 digits."""
    total = sum((F.col(f"gen_len_{c}") for c in range(chunks)), F.lit(0.0))
    return dataset.where(F.col(prediction) == 0).select(
        "id1", (F.col("hap1") + 1).alias("hap1"), "id2", (F.col("hap2") + 1).alias("hap2"), F.lit(chrom).alias("chrom"), "start", "end", F.round(total, 3).alias("cm"))


def error_lines(loci: DataFrame, samples: DataFrame) -> DataFrame:
    """``value``: a sample's name, then its flipped sites, tab separated."""
    s = loci.withColumn("sample_idx", F.shiftright("hap_id", 1)).groupBy("sample_idx").agg(F.array_sort(F.collect_list("site_id")).alias("s"))
    return samples.join(s, "sample_idx", "left").select(F.concat_ws("\t", "sample_id", F.transform("s", lambda x: x.cast("string"))).alias("value"))


def with_indices(indexed: DataFrame, sites: DataFrame, chrom: str) -> DataFrame:
    """Indexed rows with haplotype numbers and site indices: the first site at or after the start, the
    last one at or before the end; ``sites(chrom, site_id, bp)``."""
    from ..operators.gmap import site_at

    s = indexed.select(
        F.lit(chrom).alias("chrom"), (2 * F.col("sample1") + F.col("hap1")).cast("bigint").alias("h1"), (2 * F.col("sample2") + F.col("hap2")).cast("bigint").alias("h2"),
        "start_bp", "end_bp", F.col("cm").alias("length_cm"))
    s = site_at(s.withColumnRenamed("start_bp", "bp"), sites).withColumnsRenamed({"bp": "start_bp", "site_id": "start_idx"})
    s = site_at(s.withColumnRenamed("end_bp", "bp"), sites, "before").withColumnsRenamed({"bp": "end_bp", "site_id": "end_idx"})
    return s.select("chrom", "h1", "h2", "start_idx", "end_idx", "start_bp", "end_bp", "length_cm")
