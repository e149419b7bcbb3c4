"""Haplotype panels: in long form ``chrom, site_id, hap_id, allele``, or packed.

``hap_id`` is twice the sample's index plus 0 or 1. A packed panel has a row for each site with the alleles of
all haplotypes in an array of numbers (``chrom, site_id, words``), ``WORD`` to a number, or, turned
round, the alleles of a haplotype over blocks of ``WORD`` sites (``chrom, hap_id, block, bits``). Counts,
filters and the turn work on these numbers; no row for each allele is made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD_BITS = 32
#: Alleles in a number of a packed panel.
WORD = 60
#: Base pairs of a bucket in which sites are numbered.
BUCKET = 1 << 16


def sample_of(hap: Column) -> Column:
    return F.shiftright(hap, 1)


def allele_counts(haps: DataFrame) -> DataFrame:
    """``chrom, site_id, n_alt, n_haps, mac``."""
    g = haps.groupBy("chrom", "site_id").agg(F.sum(F.col("allele").cast("long")).alias("n_alt"), F.count("*").alias("n_haps"))
    return g.withColumn("mac", F.least("n_alt", F.col("n_haps") - F.col("n_alt")))


def site_type(n_alt: Column, n_haps: Column) -> Column:
    """DENSE, SPARSE (alternative alleles at most a 32nd of the samples), MONO_REF or MONO_ALT."""
    samples = F.floor(n_haps / 2)
    return (
        F.when(n_alt == 0, "MONO_REF").when(n_alt == n_haps, "MONO_ALT")
        .when(n_alt <= F.floor(samples / 32), "SPARSE").otherwise("DENSE"))


def numbered(sites: DataFrame, order: list[str]) -> DataFrame:
    """``sites`` with dense ``site_id`` from 0 by ``bp`` and ``order`` in each chromosome.

    Only buckets of base pairs are sorted; a window over a row for each bucket gives where it starts."""
    rows = sites.withColumn("_b", F.floor(F.col("bp") / BUCKET))
    before = Window.partitionBy("chrom").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("chrom", "_b").count().select("chrom", "_b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    within = F.row_number().over(Window.partitionBy("chrom", "_b").orderBy("bp", *order))
    return rows.withColumn("_in", within).join(base, ["chrom", "_b"]).withColumn("site_id", (F.col("_base") + F.col("_in") - 1).cast("long")).drop("_b", "_in", "_base")


def kept_sites(haps: DataFrame, sites: DataFrame, min_mac: int = 2) -> DataFrame:
    """Sites with at least ``min_mac`` minor alleles, numbered densely; the old number is ``orig_site_id``."""
    return _kept(allele_counts(haps), sites, min_mac)


def _kept(counts: DataFrame, sites: DataFrame, min_mac: int) -> DataFrame:
    counts = counts.where(F.col("mac") >= min_mac).select("chrom", "site_id", "mac", "n_alt", "n_haps")
    kept = sites.join(counts, ["chrom", "site_id"]).withColumnRenamed("site_id", "orig_site_id")
    return numbered(kept.select("chrom", "orig_site_id", "bp", "mac", "n_alt", "n_haps"), ["orig_site_id"]).select(
        "chrom", "site_id", "orig_site_id", "bp", "mac", site_type(F.col("n_alt"), F.col("n_haps")).alias("site_type"))


# Packed panels ----------------------------------------------------------------

def packed_alt(words: Column) -> Column:
    """Alternative alleles of a site, by counting bits."""
    return F.aggregate(words, F.lit(0).cast("long"), lambda n, w: n + F.bit_count(w))


def packed_mac(words: Column, n_haps: int) -> Column:
    n = packed_alt(words)
    return F.least(n, n_haps - n)


def packed_counts(words: DataFrame, n_haps: int) -> DataFrame:
    """:func:`allele_counts` of ``words(chrom, site_id, words)``."""
    w = words.select("chrom", "site_id", packed_alt(F.col("words")).alias("n_alt"), F.lit(n_haps).cast("long").alias("n_haps"))
    return w.withColumn("mac", F.least("n_alt", F.col("n_haps") - F.col("n_alt")))


def packed_kept_sites(words: DataFrame, sites: DataFrame, n_haps: int, min_mac: int = 2) -> DataFrame:
    """:func:`kept_sites` of a packed panel."""
    return _kept(packed_counts(words, n_haps), sites, min_mac)


def packed_renumbered(words: DataFrame, kept: DataFrame) -> DataFrame:
    to = kept.select("chrom", F.col("site_id").alias("_new"), F.col("orig_site_id").alias("site_id"))
    return words.join(to, ["chrom", "site_id"]).select("chrom", F.col("_new").alias("site_id"), "words")


def unpacked(words: DataFrame, n_haps: int) -> DataFrame:
    """The long form of a packed panel."""
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_haps - 1).cast("long"))).alias("hap_id")
    bit = F.getbit(F.col("words")[F.expr(f"cast(hap_id div {WORD} as int)")], F.expr(f"cast(hap_id % {WORD} as int)"))
    return words.select("chrom", "site_id", "words", each).select("chrom", "site_id", "hap_id", bit.cast("int").alias("allele"))


def site_words(haps: DataFrame) -> DataFrame:
    """``chrom, site_id, words`` of a panel in long form; haplotypes that a site doesn't have are allele 0 there."""
    last = haps.agg(F.floor(F.max("hap_id") / WORD).cast("int").alias("_last"))
    bit = F.call_function("shiftleft", F.col("allele").cast("long"), F.pmod("hap_id", F.lit(WORD)).cast("int"))
    each = haps.groupBy("chrom", "site_id", F.floor(F.col("hap_id") / WORD).cast("int").alias("w")).agg(F.sum(bit).alias("bits"))
    rows = each.groupBy("chrom", "site_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "bits"))).alias("m")).crossJoin(F.broadcast(last))  # one row
    return rows.select("chrom", "site_id", F.transform(F.sequence(F.lit(0), F.col("_last")), lambda w: F.coalesce(F.try_element_at("m", w), F.lit(0).cast("long"))).alias("words"))


def haplotype_words(words: DataFrame, n_haps: int) -> DataFrame:
    """``chrom, hap_id, block, bits``: a packed panel turned round, block of sites by block of sites.

    A row for each site and number is shuffled at most, and mostly one for each block: the bits of a number's haplotypes
    are gathered by as many sums before and after the shuffle."""
    w = words.select("chrom", "site_id", F.posexplode("words").alias("w", "bits"))
    at = F.pmod("site_id", F.lit(WORD)).cast("int")
    gathered = [F.sum(F.call_function("shiftleft", F.getbit("bits", F.lit(i)).cast("long"), at)).alias(f"b{i}") for i in range(min(WORD, n_haps))]
    turned = w.groupBy("chrom", F.floor(F.col("site_id") / WORD).alias("block"), "w").agg(*gathered)
    each = F.posexplode(F.array(*[f"b{i}" for i in range(len(gathered))])).alias("i", "bits")
    return turned.select("chrom", "block", "w", each).select("chrom", (F.col("w") * WORD + F.col("i")).cast("long").alias("hap_id"), "block", "bits").where(F.col("hap_id") < n_haps)


def packed_flipped(words: DataFrame, edits: DataFrame) -> DataFrame:
    """A packed panel with the alleles at ``edits(chrom, site_id, hap_id)`` flipped."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("hap_id", F.lit(WORD)).cast("int"))
    masks = edits.select("chrom", "site_id", "hap_id").distinct().groupBy("chrom", "site_id", F.floor(F.col("hap_id") / WORD).cast("int").alias("w")).agg(F.sum(bit).alias("x"))
    masks = masks.groupBy("chrom", "site_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "x"))).alias("_m"))  # an entry for each number of the site
    flip = F.transform("words", lambda x, i: x.bitwiseXOR(F.coalesce(F.try_element_at("_m", i), F.lit(0).cast("long"))))
    return words.join(masks, ["chrom", "site_id"], "left").select("chrom", "site_id", F.when(F.col("_m").isNull(), F.col("words")).otherwise(flip).alias("words"))


def renumbered(haps: DataFrame, kept: DataFrame) -> DataFrame:
    """The panel at the kept sites, by their new numbers."""
    to = kept.select("chrom", F.col("site_id").alias("_new"), F.col("orig_site_id").alias("site_id"))
    return haps.join(to, ["chrom", "site_id"]).select("chrom", F.col("_new").alias("site_id"), "hap_id", "allele")


def _packed(haps: DataFrame, key: str, along: str) -> DataFrame:
    bit = F.call_function("shiftleft", F.col("allele").cast("long"), F.pmod(F.col(along), F.lit(WORD_BITS)).cast("int"))
    return haps.groupBy("chrom", key, F.floor(F.col(along) / WORD_BITS).alias("word")).agg(F.sum(bit).alias("bits"))


def packed_sites(haps: DataFrame) -> DataFrame:
    """``chrom, site_id, word, bits``: 32 haplotypes to a word."""
    return _packed(haps, "site_id", "hap_id")


def packed_haplotypes(haps: DataFrame) -> DataFrame:
    """``chrom, hap_id, word, bits``: 32 sites to a word."""
    return _packed(haps, "hap_id", "site_id")


def transposed(site_words: DataFrame) -> DataFrame:
    """Site-major words turned into haplotype-major ones."""
    bits = F.explode(F.transform(
        F.sequence(F.lit(0), F.lit(WORD_BITS - 1)),
        lambda i: F.struct((F.col("word") * WORD_BITS + i).alias("hap_id"),
                           F.col("bits").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i)).cast("boolean").cast("int").alias("allele"))))
    # haplotypes without any bit still have words of zeros
    long = site_words.select("chrom", "site_id", bits.alias("b")).select("chrom", "site_id", "b.hap_id", "b.allele")
    return _packed(long, "hap_id", "site_id")


def mismatch_counts(hap_words: DataFrame, pairs: DataFrame) -> DataFrame:
    """``chrom, h1, h2, n_mismatches`` of the pairs, by exclusive or of their words."""
    a = hap_words.select("chrom", F.col("hap_id").alias("h1"), "word", F.col("bits").alias("x"))
    b = hap_words.select("chrom", F.col("hap_id").alias("h2"), "word", F.col("bits").alias("y"))
    joined = pairs.join(a, "h1").join(b, ["chrom", "h2", "word"])
    return joined.groupBy("chrom", "h1", "h2").agg(F.sum(F.bit_count(F.col("x").bitwiseXOR(F.col("y"))).cast("long")).alias("n_mismatches"))


def at_site(haps: DataFrame, site: int) -> DataFrame:
    return haps.where(F.col("site_id") == site)


def of_haplotype(haps: DataFrame, hap: int) -> DataFrame:
    return haps.where(F.col("hap_id") == hap)


def common_snps(haps: DataFrame, sites: DataFrame, maf: float) -> DataFrame:
    """Sites of ``sites(chrom, site_id, ref, alt, ...)`` with two one-letter alleles and a minor frequency of ``maf`` or more."""
    two = sites.where((F.length("ref") == 1) & (F.length("alt") == 1))
    common = allele_counts(haps).where(F.col("mac") / F.col("n_haps") >= maf).select("chrom", "site_id")
    return two.join(common, ["chrom", "site_id"], "left_semi")


def flipped(haps: DataFrame, loci: DataFrame) -> DataFrame:
    """The panel with the alleles at ``loci(chrom, site_id, hap_id)`` flipped."""
    hit = loci.select("chrom", "site_id", "hap_id", F.lit(True).alias("_hit")).distinct()
    allele = F.when(F.col("_hit"), 1 - F.col("allele")).otherwise(F.col("allele"))
    return haps.join(hit, ["chrom", "site_id", "hap_id"], "left").select(
        "chrom", "site_id", "hap_id", allele.cast("int").alias("allele"))


def error_loci(samples: DataFrame, sites: DataFrame, rates: list[float], seed: str = "error") -> DataFrame:
    """``chrom, site_id, hap_id``: for each sample the share of sites that its rate asks for, one
    haplotype at each. The rate is drawn from ``rates`` by the sample; all draws are by digest."""
    drawn = lambda *cols: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *cols)), 1, 8), 16, 10).cast("long")
    rate = F.element_at(F.lit([float(r) for r in rates]), (drawn(F.lit("rate"), "sample_idx") % len(rates) + 1).cast("int"))
    n = sites.groupBy("chrom").agg(F.count("*").alias("n_sites"))
    each = samples.select("sample_idx", rate.alias("rate")).crossJoin(F.broadcast(n)).withColumn("k", F.floor(F.col("n_sites") * F.col("rate")))
    place = drawn(F.lit("site"), "sample_idx", "site_id")
    w = Window.partitionBy("chrom", "sample_idx").orderBy(place, "site_id")
    every = each.where("k > 0").join(sites.select("chrom", "site_id"), "chrom")
    return every.withColumn("nth", F.row_number().over(w)).where("nth <= k").select(
        "chrom", "site_id", (2 * F.col("sample_idx") + drawn(F.lit("hap"), "sample_idx", "site_id") % 2).alias("hap_id"))
