"""From a panel and a map to segments, and from segments to those that a model keeps."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import written
from ..functions.models import Network, Trees, kept, scored
from ..operators import extend, features, gmap, panel, seeds, smooth
from ..params import Detection, Smoothing
from ..sources.vcf import Panel


@dataclass
class Found:
    """Segments with what they were found on; ``corrections`` are at the sites' new numbers, ``words`` the packed haplotypes."""

    segments: DataFrame
    sites: DataFrame
    haplotypes: DataFrame
    words: DataFrame
    corrections: DataFrame
    statistics: dict[str, float] = field(default_factory=dict)

    @property
    def mismatches(self) -> DataFrame:
        """Of the pairs that have a segment."""
        return seeds.packed_mismatches(self.words, self.segments.select("chrom", "h1", "h2").distinct())


def detect(haps: DataFrame, sites: DataFrame, knots: DataFrame, p: Detection = Detection(), s: Smoothing | None = Smoothing(),
           by_candidates: bool = True) -> Found:
    """Smooth (unless ``s`` is None), drop rare sites, place the rest on the map, find seeds and extend them.

    With ``by_candidates`` only pairs that agree on as much as the least seed holds are compared; the segments are
    the same either way.
    """
    edits = None
    if s is not None:
        haps, edits = smooth.smoothed(haps, s)
    kept_sites = written(panel.kept_sites(haps, sites, p.min_mac))
    haps = panel.renumbered(haps, kept_sites)
    placed = written(gmap.interpolated(kept_sites, knots))
    words = written(seeds.packed(haps))
    return _found(words, placed, haps, kept_sites, edits, p, None if by_candidates else seeds.all_pairs(haps))


def detect_panel(read: Panel, knots: DataFrame, p: Detection = Detection(), s: Smoothing | None = Smoothing()) -> Found:
    """:func:`detect` on the packed alleles of a panel that was read: no row for each allele is made on the way."""
    words, edits, n = read.words, None, read.n_haps
    if s is not None and s.gap == 1 and s.length < panel.WORD:
        last = read.sites.groupBy("chrom").agg((F.max("site_id") + 1).alias("n"))
        turned = panel.haplotype_words(words, n).join(F.broadcast(last), "chrom")  # a row for each chromosome
        words, edits = smooth.packed_smoothed(words, written(turned), n, s)
    elif s is not None:
        edits = written(smooth.corrections(read.haplotypes, s))
        if smooth.is_smooth_already(edits.count(), words.count() * n):
            edits = edits.limit(0)
        words = panel.packed_flipped(words, edits)
    kept_sites = written(panel.packed_kept_sites(words, read.sites, n, p.min_mac))
    words = written(panel.packed_renumbered(words, kept_sites))
    placed = written(gmap.interpolated(kept_sites, knots))
    turned = written(panel.haplotype_words(words, n))
    return _found(turned, placed, panel.unpacked(words, n), kept_sites, edits, p, None)


def _found(words: DataFrame, placed: DataFrame, haps: DataFrame, kept_sites: DataFrame, edits: DataFrame | None, p: Detection, pairs: DataFrame | None) -> Found:
    """Segments of ``words(chrom, hap_id, block, bits)``, and what scoring needs."""
    pairs = written(seeds.least_pairs(words, placed, p.min_markers, p.min_seed) if pairs is None else pairs)
    run = written(seeds.long_runs(words, pairs, placed, extend.least_run(p)))
    segs = extend.segments(seeds.seeds(run, placed, p), seeds.packed_mismatches(words, pairs), placed, p, run)
    if edits is None:
        moved = haps.select("chrom", "site_id", "hap_id").limit(0)
    else:
        to = kept_sites.select("chrom", F.col("orig_site_id").alias("_o"), F.col("site_id").alias("_n"))
        e = edits.select("chrom", F.col("site_id").alias("_o"), "hap_id")
        moved = e.join(to, ["chrom", "_o"]).select("chrom", F.col("_n").alias("site_id"), "hap_id")
    return Found(segs, placed, haps, words, moved)


def filtered(found: Found, model: Network | Trees, below: float = 0.5) -> DataFrame:
    """Segments whose scaled features the model gives a low probability of being false."""
    names = features.feature_names()
    segs = written(found.segments)
    mm = seeds.mismatches_inside(found.words, segs)
    f = written(features.wide(features.chunked(segs, found.sites, mm, found.corrections)))
    ok = kept(scored(features.scaled(f, names), names, model), below=below).select(*features.KEY)
    return segs.join(ok, list(features.KEY), "left_semi")


def summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """``processed, kept, filtered, kept_percent``."""
    a = before.agg(F.count("*").alias("processed"))
    b = after.agg(F.count("*").alias("kept"))
    return a.crossJoin(b).select(
        "processed", "kept", (F.col("processed") - F.col("kept")).alias("filtered"), F.try_divide(100.0 * F.col("kept"), F.col("processed")).alias("kept_percent"))


def run_statistics(found: Found, samples: DataFrame) -> DataFrame:
    """``samples, markers, segments, segments_per_sample``."""
    one = samples.agg(F.count("*").alias("samples")).crossJoin(found.sites.agg(F.count("*").alias("markers")))
    two = one.crossJoin(found.segments.agg(F.count("*").alias("segments")))
    return two.withColumn("segments_per_sample", F.coalesce(F.try_divide("segments", "samples"), F.lit(0.0)))


def counted(samples: int, markers: int, segments: int) -> dict[str, float]:
    """:func:`run_statistics` of numbers that were counted on the way."""
    return {"samples": samples, "markers": markers, "segments": segments, "segments_per_sample": segments / samples if samples else 0.0}


def passed(processed: int, kept: int) -> dict[str, float]:
    """:func:`summary` of numbers that were counted on the way."""
    return {"processed": processed, "kept": kept, "filtered": processed - kept, "kept_percent": 100.0 * kept / processed if processed else float("nan")}
