"""Phased VCF text, plain, gzipped or block-gzipped."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import written
from ..operators import panel
from ..operators.panel import WORD
from . import bgzf

FIXED = ("CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT")


@dataclass
class Panel:
    """``samples(sample_idx, sample_id)``, ``sites(chrom, site_id, bp, fields)`` and
    ``haplotypes(chrom, site_id, hap_id, allele)`` of a file, with its header lines. A panel that was read
    also has ``words(chrom, site_id, words)``, where its haplotypes come from: ``panel.WORD`` alleles to a number."""

    samples: DataFrame
    sites: DataFrame
    haplotypes: DataFrame
    header: list[str]
    words: DataFrame | None = None
    n_haps: int = 0


def check_name(path: str) -> None:
    if not path.endswith((".vcf", ".vcf.gz")):
        raise ValueError(f"not a .vcf or .vcf.gz file: {path}")


def header_lines(spark: SparkSession, files: list[str]) -> list[str]:
    """The lines that begin with ``#`` at the top of the first of the files that has any, read up to there."""
    jvm = spark._jvm
    for f in files:
        where = jvm.org.apache.hadoop.fs.Path(f)
        conf = spark._jsc.hadoopConfiguration()
        opened = where.getFileSystem(conf).open(where)
        if f.endswith(".gz") or bgzf.first_bytes(spark, f, 2) == b"\x1f\x8b":
            opened = jvm.java.util.zip.GZIPInputStream(opened)
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(opened, "UTF-8"))
        try:
            out = []
            while (line := reader.readLine()) is not None and (line.startswith("#") or not line):
                out += [line] if line else []
        finally:
            reader.close()
        if out:
            return out
    return []


def read_lines(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """``value, file, block, nth`` of a text file (or folder, or pattern) and its header lines. Block-gzipped files are read
    by many tasks each, other gzipped ones by one task each."""
    lines = spark.read.text(path)
    files = sorted(lines.inputFiles())
    header = header_lines(spark, files)
    if bgzf.is_block_gzip(spark, files):
        return bgzf.read_lines(spark, files), header
    return lines.select("value", F.input_file_name().alias("file"), F.input_file_block_start().alias("block"), F.monotonically_increasing_id().alias("nth")), header


def packed_genotypes(gt: Column, n_samples: int) -> Column:
    """The alleles of the tab separated sample columns ``gt`` as numbers of ``WORD`` each, the first in the lowest bit.

    A line of plain genotypes (``0|1``) is packed by replacing characters; others column by column. Columns that are
    missing have allele 0; a genotype of other than two alleles raises an error.
    """
    pair = lambda x: F.split(F.substring_index(x, ":", 1), r"[|/]")
    allele = lambda a: F.when(a.isin("0", "."), "0").otherwise("1")
    each = F.transform(F.slice(F.split(gt, "\t"), 1, n_samples), lambda x: F.when(F.size(pair(x)) == 2, F.concat(allele(pair(x)[0]), allele(pair(x)[1]))).otherwise(
        F.raise_error(F.lit("a genotype of other than two alleles")).cast("string")))
    plain = F.translate(gt, "./23456789", "0|11111111")
    marks = F.repeat(F.lit("|\t"), n_samples - 1)
    is_plain = (F.length(gt) == 4 * n_samples - 1) & (F.translate(plain, "01", "") == F.concat(marks, F.lit("|")))
    bits = F.when(is_plain, F.translate(plain, "|\t", "")).otherwise(F.rpad(F.concat_ws("", each), 2 * n_samples, "0"))
    last = (2 * n_samples - 1) // WORD
    return F.transform(F.sequence(F.lit(0), F.lit(last)), lambda w: F.conv(F.reverse(F.substring(bits, w * WORD + 1, F.lit(WORD))), 2, 10).cast("long"))


def read_vcf(spark: SparkSession, path: str, biallelic_only: bool = False, min_mac: int = 0) -> Panel:
    """Every site with at least one sample column. The genotype comes first in each sample's
    column; ``.`` and 0 are allele 0, any other allele is 1. Lines with fewer than nine tabs are
    left out; haploid genotypes raise an error. Sites are numbered by chromosome, position and
    place in the file, once: a line becomes its packed alleles where it is read, rare sites go there, and
    the numbered rows are written.
    """
    check_name(path)
    lines, header = read_lines(spark, path)
    names = next((h.split("\t")[len(FIXED):] for h in reversed(header) if h.startswith("#CHROM")), [])
    if not names:
        raise ValueError("a VCF needs at least one sample")
    samples = spark.createDataFrame(list(enumerate(names)), "sample_idx bigint, sample_id string")
    front = F.substring_index("value", "\t", len(FIXED))
    is_site = ~F.col("value").startswith("#") & (F.length(front) < F.length("value"))
    # the optimiser may evaluate genotypes before the filter, so other lines have none
    rows = lines.where(is_site).select(F.split(front, "\t").alias("fields"), F.when(is_site, F.substring("value", F.length(front) + 2, F.length("value"))).alias("gt"), "file", "block", "nth")
    if biallelic_only:
        rows = rows.where(~F.col("fields")[4].contains(","))
    n_haps = 2 * len(names)
    rows = rows.select(F.col("fields")[0].alias("chrom"), F.col("fields")[1].cast("long").alias("bp"), "fields", packed_genotypes(F.col("gt"), len(names)).alias("words"), "file", "block", "nth")
    if min_mac > 0:
        rows = rows.where(panel.packed_mac(F.col("words"), n_haps) >= min_mac)
    rows = written(_numbered(rows))
    words = rows.select("chrom", "site_id", "words")
    return Panel(samples, rows.select("chrom", "site_id", "bp", "fields"), panel.unpacked(words, n_haps), header, words, n_haps)


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows with ``site_id`` in place of ``file, block, nth``; only buckets of base pairs are sorted, whatever the chromosome."""
    return panel.numbered(rows, ["file", "block", "nth"]).select("chrom", "site_id", "bp", "fields", "words")


def vcf_lines(panel: Panel, haplotypes: DataFrame | None = None) -> DataFrame:
    """``chrom, site_id, value``: a line for each site; fixed fields as read, genotypes of ``haplotypes`` (or the panel's own)."""
    haps = panel.haplotypes if haplotypes is None else haplotypes
    gt = F.array_sort(F.collect_list(F.struct("hap_id", "allele")))
    lines = haps.groupBy("chrom", "site_id").agg(F.transform(gt, lambda x: x["allele"].cast("string")).alias("a"))
    pairs = F.transform(F.sequence(F.lit(0), F.expr("cast(size(a) / 2 as int) - 1")), lambda i: F.concat(
        F.get("a", 2 * i), F.lit("|"), F.get("a", 2 * i + 1)))
    return lines.join(panel.sites, ["chrom", "site_id"]).select(
        "chrom", "site_id", F.concat_ws("\t", F.concat("fields", pairs)).alias("value"))


def write_vcf(panel: Panel, path: str, haplotypes: DataFrame | None = None, blocks: bool = False) -> None:
    """A directory of text parts in site order, the header in the first one; block-gzipped ones with ``blocks``."""
    spark = panel.sites.sparkSession
    head = spark.createDataFrame([("", i - len(panel.header), h) for i, h in enumerate(panel.header)], "chrom string, site_id bigint, value string")
    lines = head.unionByName(vcf_lines(panel, haplotypes))
    lines = lines.repartitionByRange("chrom", "site_id").sortWithinPartitions("chrom", "site_id").select("value")
    if blocks:
        bgzf.write_lines(lines, path)
    else:
        lines.write.mode("overwrite").text(path)


def smoothed_name(path: str) -> str:
    """``x.vcf`` and ``x.vcf.gz`` become ``x_smooth.vcf`` and ``x_smooth.vcf.gz``."""
    check_name(path)
    name = path.rsplit("/", 1)[-1]
    end = ".vcf.gz" if name.endswith(".gz") else ".vcf"
    return f"{name.removesuffix(end)}_smooth{end}"
