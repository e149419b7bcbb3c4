"""Correction of isolated allele errors inside blocks of identical haplotypes.

Around a gap of sites, haplotypes with the same alleles over the sites before it
and the sites after it form a block. Both flanks are exact bit sums over window
frames, so blocks are plain groups on two numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import written
from ..params import Smoothing
from .panel import WORD

#: Sites whose alleles fit into one number.
_LONG = 60
#: Rows of blocks that are broadcast at most, of about 50 bytes each.
FEW = 500_000


def _flank(first: int, last: int) -> list[Column]:
    """Exact numbers for the alleles of the rows from ``first`` to ``last`` around the current one."""
    along = Window.partitionBy("chrom", "hap_id").orderBy("site_id")
    out = []
    for at in range(first, last + 1, _LONG):
        to = min(last, at + _LONG - 1)
        # all rows of one site agree on the places of bits, whatever the haplotype
        bit = F.call_function("shiftleft", F.col("allele").cast("long"), F.pmod(F.col("site_id"), F.lit(to - at + 1)).cast("int")) if to > at else F.col("allele").cast("long")
        out.append(F.sum(bit).over(along.rowsBetween(at, to)))
    return out


def blocks(haps: DataFrame, p: Smoothing) -> DataFrame:
    """``chrom, eff, k, hap_id, site_id, allele, size, ones``: every haplotype in its block at each
    effective site ``eff``, for each site ``eff + k`` of the gap. Site ids must be dense from 0."""
    along = Window.partitionBy("chrom", "hap_id").orderBy("site_id")
    last = F.max("site_id").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    left, right = _flank(-p.length, -1), _flank(p.gap, p.gap + p.length - 1)
    names = [f"l{i}" for i in range(len(left))] + [f"r{i}" for i in range(len(right))]
    rows = haps.select(
        "chrom", "hap_id", "site_id", "allele", last.alias("_last"),
        *(c.alias(n) for c, n in zip([*left, *right], names)),
        *(F.lead("allele", k).over(along).alias(f"a{k}") for k in range(p.gap)))
    rows = rows.where((F.col("site_id") >= p.length) & (F.col("site_id") <= F.col("_last") + 1 - p.gap - p.length))
    block = Window.partitionBy("chrom", "site_id", *names)
    rows = rows.withColumn("size", F.count("*").over(block)).where(F.col("size") >= p.width)
    for k in range(p.gap):
        rows = rows.withColumn(f"n{k}", F.sum(F.col(f"a{k}").cast("long")).over(block))
    gap = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"a{k}").alias("allele"), F.col(f"n{k}").alias("ones")) for k in range(p.gap)]))
    return rows.select("chrom", F.col("site_id").alias("eff"), "hap_id", "size", gap.alias("g")).select(
        "chrom", "eff", "g.k", "hap_id", (F.col("eff") + F.col("g.k")).alias("site_id"), "g.allele", "size", "g.ones")


def decisions(haps: DataFrame, p: Smoothing) -> DataFrame:
    """``chrom, site_id, hap_id, eff, allele, value``: the consensus of every block that has one; a tie is 0."""
    b = blocks(haps, p)
    zeros = F.col("size") - F.col("ones")
    agreed = F.least("ones", zeros) <= F.col("size") * p.rho
    return b.where(agreed).select("chrom", "site_id", "hap_id", "eff", "allele", F.when(zeros < F.col("ones"), 1).otherwise(0).alias("value"))


def correction_events(haps: DataFrame, p: Smoothing) -> DataFrame:
    """``chrom, site_id, hap_id, eff, old, new``: each change of an allele, in the order of ``eff``.

    With a gap of several sites later blocks override earlier ones."""
    w = Window.partitionBy("chrom", "site_id", "hap_id").orderBy("eff")
    d = decisions(haps, p).withColumn("old", F.coalesce(F.lag("value").over(w), F.col("allele").cast("int")))
    return d.where("old <> value").select("chrom", "site_id", "hap_id", "eff", "old", F.col("value").alias("new"))


def corrections(haps: DataFrame, p: Smoothing) -> DataFrame:
    """``chrom, site_id, hap_id, old, new``: alleles that differ after smoothing.

    With a gap of one site and flanks that fit into a number the panel is packed first."""
    if p.gap == 1 and p.length < WORD:
        from .seeds import packed

        n = haps.groupBy("chrom").agg((F.max("site_id") + 1).alias("n"))
        return packed_corrections(packed(haps).join(F.broadcast(n), "chrom"), p)  # a row for each chromosome
    if p.gap == 1:
        d = decisions(haps, p)
    else:
        d = decisions(haps, p).groupBy("chrom", "site_id", "hap_id").agg(
            F.first("allele").alias("allele"), F.max_by("value", "eff").alias("value"))
    return d.where("allele <> value").select(
        "chrom", "site_id", "hap_id", F.col("allele").cast("int").alias("old"), F.col("value").alias("new"))


def packed_corrections(words: DataFrame, p: Smoothing) -> DataFrame:
    """:func:`corrections` of ``words(chrom, hap_id, block, bits)``, for a gap of one site.

    Flanks are cut out of three neighbouring numbers. A task has whole blocks of sites, so what it shuffles are the counts
    of its different flanks, not alleles; only blocks with a minority that is corrected are kept, and the haplotypes of these
    minorities come back by a semi join, which needs no shuffle while the counted blocks are few.
    """
    if p.gap != 1 or p.length >= WORD:
        raise ValueError("packed smoothing takes a gap of one site and flanks that fit into a number")
    n, mask = p.length, (1 << p.length) - 1
    along = Window.partitionBy("chrom", "hap_id").orderBy("block")
    near = lambda f: F.coalesce(f("bits").over(along), F.lit(0).cast("long"))
    w = words.select("chrom", "hap_id", "block", "bits", near(F.lag).alias("prev"), near(F.lead).alias("next"))
    w = written(w.repartition("chrom", "block"))
    ends = sites_of(words).select("chrom", (F.col("n") - 1 - n).alias("_last"))
    up, down = (lambda x, k: F.call_function("shiftleft", F.col(x), k.cast("int"))), (lambda x, k: F.call_function("shiftrightunsigned", F.col(x), k.cast("int")))
    i = F.col("i")
    left = F.when(i >= n, down("bits", i - n)).otherwise(down("prev", WORD + i - n).bitwiseOR(up("bits", n - i)))
    at = i + 1
    right = F.when(at + n <= WORD, down("bits", at)).when(at >= WORD, down("next", at - WORD)).otherwise(down("bits", at).bitwiseOR(up("next", WORD - at)))
    each = w.select("*", F.explode(F.lit(list(range(WORD)))).alias("i")).select(
        "chrom", (F.col("block") * WORD + i).alias("site_id"), "hap_id", F.getbit("bits", i).cast("int").alias("allele"),
        left.bitwiseAND(F.lit(mask)).alias("l"), right.bitwiseAND(F.lit(mask)).alias("r")).join(F.broadcast(ends), "chrom")  # a row for each chromosome
    each = each.where((F.col("site_id") >= n) & (F.col("site_id") <= F.col("_last"))).drop("_last")
    key = ["chrom", "site_id", "l", "r"]
    zeros, few = F.col("size") - F.col("ones"), F.least("ones", F.col("size") - F.col("ones"))
    counts = each.groupBy(*key).agg(F.count("*").alias("size"), F.sum("allele").alias("ones")).where(
        (F.col("size") >= p.width) & (few > 0) & (few <= F.col("size") * p.rho))
    agreed = written(counts.select(*key, F.when(zeros < F.col("ones"), 1).otherwise(0).alias("new")))
    side = F.broadcast(agreed) if agreed.count() <= FEW else agreed
    return each.join(side, key).where("allele <> new").select("chrom", "site_id", "hap_id", F.col("allele").alias("old"), "new")


def words_flipped(words: DataFrame, edits: DataFrame) -> DataFrame:
    """``words(chrom, hap_id, block, bits, ...)`` with the alleles at ``edits(chrom, site_id, hap_id)`` flipped."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.col("site_id"), F.lit(WORD)).cast("int"))
    masks = edits.select("chrom", "site_id", "hap_id").distinct().groupBy("chrom", "hap_id", F.floor(F.col("site_id") / WORD).alias("block")).agg(F.sum(bit).alias("_x"))
    joined = words.join(masks, ["chrom", "hap_id", "block"], "left")
    return joined.withColumn("bits", F.col("bits").bitwiseXOR(F.coalesce("_x", F.lit(0).cast("long")))).select(*words.columns)


def sites_of(words: DataFrame) -> DataFrame:
    """``chrom, n``: sites of each chromosome of ``words(chrom, hap_id, block, bits, n)``."""
    if "n" not in words.columns:
        raise ValueError("words need the number of sites of their chromosome")
    return words.groupBy("chrom").agg(F.max("n").alias("n"))


def packed_smoothed(panel_words: DataFrame, words: DataFrame, n_haps: int, p: Smoothing) -> tuple[DataFrame, DataFrame]:
    """The smoothed site-major ``panel_words`` and its corrections, found on the haplotype-major ``words``; a panel that is smooth already stays."""
    from .panel import packed_flipped

    edits = written(packed_corrections(words, p))
    if is_smooth_already(edits.count(), panel_words.count() * n_haps):
        return panel_words, edits.limit(0)
    return packed_flipped(panel_words, edits), edits


def block_counts(haps: DataFrame, p: Smoothing) -> DataFrame:
    """``chrom, eff, n_blocks, n_haps``: blocks of at least the least width, and haplotypes in them."""
    b = blocks(haps, p).where("k = 0")
    return b.groupBy("chrom", "eff").agg(F.round(F.sum(F.lit(1.0) / F.col("size"))).cast("long").alias("n_blocks"), F.count("*").alias("n_haps"))


def apply_corrections(haps: DataFrame, edits: DataFrame) -> DataFrame:
    to = edits.select("chrom", "site_id", "hap_id", F.col("new").alias("_new"))
    return haps.join(to, ["chrom", "site_id", "hap_id"], "left").select(
        "chrom", "site_id", "hap_id", F.coalesce("_new", F.col("allele").cast("int")).alias("allele"))


def is_smooth_already(n_corrections: int, n_alleles: int, below: float = 0.001) -> bool:
    """A panel with very few corrections, but some, has been smoothed before."""
    return 0 < n_corrections < below * n_alleles


def smoothed(haps: DataFrame, p: Smoothing) -> tuple[DataFrame, DataFrame]:
    """The smoothed panel and its corrections; a panel that is smooth already stays as it is."""
    edits = written(corrections(haps, p))
    n = edits.count()
    if is_smooth_already(n, haps.count()):
        return haps, edits.limit(0)
    return apply_corrections(haps, edits), edits
