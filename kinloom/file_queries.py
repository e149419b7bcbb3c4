"""Queries that go through files: panels, maps, segments, models and datasets are written to the shared
checkpoint folder, read again by the sources, and compared with what SQL says they hold."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import __main__ as program
from . import queries as q
from .checkpoints import shared_folder, write_file, written
from .functions import models
from .operators import evaluate, extend, features, gmap, panel, seeds, smooth
from .plans import detect
from .sources import maps, segments, vcf

#: A panel of two kinds of sites: every fifth has two alternative alleles.
MULTI = "site_id % 5 = 0"


def _panel(spark, d, haps: DataFrame, multi: bool = False) -> vcf.Panel:
    names = [r[0] for r in q.samples(spark, d).orderBy("sample_idx").select("sample_id").collect()]  # the file's header has them all
    alt = F.when(F.expr(MULTI), "C,G").otherwise("C") if multi else F.lit("C")
    fixed = F.array(F.col("chrom"), F.col("bp").cast("string"), F.lit("."), F.lit("A"), alt, *[F.lit(x) for x in (".", "PASS", ".", "GT")])
    head = ["##fileformat=VCFv4.2", "#" + "\t".join([*vcf.FIXED, *names])]
    return vcf.Panel(q.samples(spark, d), q.sites(spark, d).withColumn("fields", fixed), haps, head)


def _with_places(p: vcf.Panel) -> DataFrame:
    return p.haplotypes.join(p.sites.select("chrom", "site_id", "bp"), ["chrom", "site_id"]).select("chrom", "site_id", "bp", "hap_id", "allele")


def vcf_scan(spark, d):
    with shared_folder(spark) as at:
        vcf.write_vcf(_panel(spark, d, q.error_panel(spark, d)), f"{at}/panel.vcf")
        return written(_with_places(vcf.read_vcf(spark, f"{at}/panel.vcf")))


def vcf_blocks(spark, d):
    """A block-gzipped panel, read by ranges of its blocks."""
    with shared_folder(spark) as at:
        vcf.write_vcf(_panel(spark, d, q.error_panel(spark, d)), f"{at}/panel.vcf.gz", blocks=True)
        return written(_with_places(vcf.read_vcf(spark, f"{at}/panel.vcf.gz")))


def vcf_packed_counts(spark, d):
    """Allele counts of a panel that was read, by counting the bits of its packed alleles."""
    with shared_folder(spark) as at:
        vcf.write_vcf(_panel(spark, d, q.error_panel(spark, d)), f"{at}/panel.vcf")
        read = vcf.read_vcf(spark, f"{at}/panel.vcf")
        return written(panel.packed_counts(read.words, read.n_haps))


def vcf_turned(spark, d):
    """A panel that was read, turned round block by block: 60 sites of a haplotype to a number."""
    with shared_folder(spark) as at:
        vcf.write_vcf(_panel(spark, d, q.error_panel(spark, d)), f"{at}/panel.vcf")
        read = vcf.read_vcf(spark, f"{at}/panel.vcf")
        return written(panel.haplotype_words(read.words, read.n_haps).select("chrom", "hap_id", "block", "bits"))


def vcf_scan_mac(spark, d):
    with shared_folder(spark) as at:
        vcf.write_vcf(_panel(spark, d, q.error_panel(spark, d), multi=True), f"{at}/panel.vcf")
        return written(_with_places(vcf.read_vcf(spark, f"{at}/panel.vcf", biallelic_only=True, min_mac=q.P.min_mac)))


def vcf_smoothed(spark, d):
    """The smoothed panel as a file, by its usual name."""
    with shared_folder(spark) as at:
        own = _panel(spark, d, q.error_panel(spark, d))
        path = f"{at}/{vcf.smoothed_name('panel.vcf')}"
        vcf.write_vcf(own, path, smooth.smoothed(own.haplotypes, q.S)[0])
        return written(panel.allele_counts(vcf.read_vcf(spark, path).haplotypes))


def map_plink(spark, d):
    """A HapMap file turned into a PLINK file, read again."""
    k = q.knots(spark, d)
    lines = k.select(F.concat_ws("\t", F.concat(F.lit("chr"), "chrom"), F.col("bp").cast("string"), F.lit("0.5"), F.format_string("%.3f", F.col("cm"))).alias("value"))
    with shared_folder(spark) as at:
        lines.write.text(f"{at}/hapmap")
        maps.plink_lines(maps.read_map(spark, f"{at}/hapmap")).write.text(f"{at}/plink")
        return written(maps.read_map(spark, f"{at}/plink"))


def _segments(spark, d) -> DataFrame:
    return written(q._segments(spark, d))


def segments_binary(spark, d):
    with shared_folder(spark) as at:
        segments.write_binary(_segments(spark, d), f"{at}/binary")
        return written(segments.read_binary(spark, f"{at}/binary").select("h1", "h2", "start_idx", "end_idx", "start_bp", "end_bp", *q.r6("length_cm")))


def segments_indexed(spark, d):
    """Segments as a file of seven columns, read and given their site indices again."""
    with shared_folder(spark) as at:
        segments.write_tsv(segments.indexed_rows(_segments(spark, d)), f"{at}/tsv")
        back = segments.with_indices(segments.read_tsv(spark, f"{at}/tsv", segments.INDEXED), q.sites(spark, d), "20")
        return written(back.select("chrom", "h1", "h2", "start_idx", "end_idx", "start_bp", "end_bp", *q.r6("length_cm")))


def segments_text(spark, d):
    with shared_folder(spark) as at:
        segments.write_tsv(segments.named_rows(_segments(spark, d), q.samples(spark, d)), f"{at}/tsv")
        return written(segments.read_tsv(spark, f"{at}/tsv", segments.NAMED))


def segments_union(spark, d):
    """Segments of two folders, read as one."""
    s = _segments(spark, d)
    with shared_folder(spark) as at:
        for k in (0, 1):
            segments.write_tsv(segments.indexed_rows(s.where(F.col("h1") % 2 == k)), f"{at}/all/{k}")
        return written(segments.read_tsv(spark, f"{at}/all/*", segments.INDEXED))


def segments_bucketed(spark, d):
    """Reported and true segments as tables bucketed by their pair, compared where their buckets are."""
    names = [f"kinloom_{what}_{uuid.uuid4().hex}" for what in ("reported", "truth")]
    try:
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        a, b = (q._as_intervals(segments.save_bucketed(s, n, buckets)) for n, s in zip(names, (_segments(spark, d), q._truth(spark, d).select("chrom", "h1", "h2", "start_bp", "end_bp"))))
        with segments.side_by_side(spark):
            both = [written(x) for x in (evaluate.accuracy(a, b), evaluate.length_accuracy(a, b), evaluate.power(b, a), evaluate.accumulative_power(b, a))]
        one = both[0]
        for x in both[1:]:  # single rows
            one = one.crossJoin(x)
        return one.select(*q.r6("accuracy", "length_accuracy", "power", "accumulative_power"))
    finally:
        for n in names:
            spark.sql(f"DROP TABLE IF EXISTS {n}")


def _dataset(spark, d) -> DataFrame:
    """Features of segments with their samples, places and the class that the trees give them."""
    names = features.feature_names()
    s = _segments(spark, d)
    at = written(q.placed(spark, d))
    mm = seeds.mismatches_inside(q._words(spark, d), s)
    wide = features.wide(features.chunked(s, at, mm, q._edits(spark, d)))
    scored = models.scored(wide, names, q.trees()).join(s.select(*features.KEY, "start_bp", "end_bp"), list(features.KEY))
    return scored.select(
        F.shiftright("h1", 1).alias("id1"), (F.col("h1") % 2).alias("hap1"), F.shiftright("h2", 1).alias("id2"), (F.col("h2") % 2).alias("hap2"),
        F.col("start_bp").alias("start"), F.col("end_bp").alias("end"), *names, F.when(F.col("score") > 0.5, 3).otherwise(2).alias("classification"))


def dataset_file(spark, d):
    """A dataset of features as CSV with a header, read again."""
    with shared_folder(spark) as at:
        segments.write_dataset(_dataset(spark, d), f"{at}/csv")
        back = spark.read.csv(f"{at}/csv", header=True, inferSchema=True)
        whole = ("id1", "hap1", "id2", "hap2", "start", "end", "classification")
        return written(back.select(*(F.col(c).cast("long").alias(c) for c in whole), *(F.round(F.col(c).cast("double"), 6).alias(c) for c in features.feature_names())))


def dataset_segments(spark, d):
    """Rows of a dataset that a model keeps, as segments."""
    rows = segments.dataset_rows(_dataset(spark, d).withColumn("xgb_pred", F.col("classification") - 2), "xgb_pred")
    return rows.select("id1", "hap1", "id2", "hap2", "chrom", "start", "end", *q.r6("cm"))


def error_log(spark, d):
    loci = panel.error_loci(q.samples(spark, d), q.sites(spark, d), [0.0, 0.005, 0.01, 0.02])
    with shared_folder(spark) as at:
        segments.error_lines(loci, q.samples(spark, d)).write.text(f"{at}/log")
        return written(spark.read.text(f"{at}/log"))


def truth_cutoff(spark, d):
    """True segments as a file of six columns, normalised and cut off by length."""
    t = q._truth(spark, d).select(F.col("h1").alias("hap1"), F.col("h2").alias("hap2"), "start_bp", "end_bp", "cm_start", "cm_end")
    with shared_folder(spark) as at:
        segments.write_tsv(t, f"{at}/truth")
        back = segments.normalized_truth(segments.read_tsv(spark, f"{at}/truth", segments.TRUTH))
        return written(segments.at_least(back, 1.5).select("id1", "id2", "start", "end", *q.r6("cm")))


def network_file(spark, d):
    with shared_folder(spark) as at:
        write_file(spark, f"{at}/network.bin", q.network().pack())
        net = models.load_network(spark, f"{at}/network.bin")
    return models.scored(q._scaled(spark, d), features.feature_names(), net).select(*features.KEY, *q.r6("score"))


def _trees_json() -> bytes:
    return json.dumps({"learner": {"learner_model_param": {"base_score": "5E-1"}, "gradient_booster": {"model": {"trees": [
        {k: v.tolist() for k, v in t.items()} for t in q.trees().trees]}}}}).encode()


def trees_file(spark, d):
    with shared_folder(spark) as at:
        write_file(spark, f"{at}/trees.json", _trees_json())
        boosted = models.load_trees(spark, f"{at}/trees.json")
    return models.scored(q._wide(spark, d), features.feature_names(), boosted).select(*features.KEY, *q.r6("score"))


def both_predictions(spark, d):
    names = features.feature_names()
    f = written(q._wide(spark, d))
    both = models.both_predictions(f, features.scaled(f, names), list(features.KEY), names, q.trees(), q.network())
    return both.select(*features.KEY, "xgb_pred", "nn_pred")


def features_scaled_all(spark, d):
    return q._scaled(spark, d).select(*features.KEY, *q.r6(*features.feature_names()))


def _program(spark, d, at: str):
    """The program over files of the panel, the map and the trees."""
    vcf.write_vcf(_panel(spark, d, q.error_panel(spark, d)), f"{at}/panel.vcf")
    maps.plink_lines(q.knots(spark, d)).write.text(f"{at}/map")
    write_file(spark, f"{at}/trees.json", _trees_json())
    p, s = q.P, q.S
    return program.run(spark, program.options([
        f"{at}/panel.vcf", f"{at}/map", f"--min-seed={p.min_seed}", f"--max-gap={p.max_gap}", f"--min-extend={p.min_extend}", f"--min-markers={p.min_markers}",
        f"--min-output={p.min_output}", f"--ps-length={s.length}", f"--ps-width={s.width}", f"--ps-gap={s.gap}", f"--ps-rho={s.rho}",
        "--filter=x", f"--model-path={at}/trees.json", f"--output={at}/kept", f"--segments={at}/segments"]))


def program_filtered(spark, d):
    """From files to the segments that the trees keep, by the command line's program."""
    with shared_folder(spark) as at:
        _program(spark, d, at)
        return written(segments.read_tsv(spark, f"{at}/kept", segments.NAMED))


def run_statistics(spark, d):
    found = detect.detect(q.error_panel(spark, d), q.sites(spark, d), q.knots(spark, d), q.P, q.S)
    return detect.run_statistics(found, q.samples(spark, d)).select("samples", "markers", "segments", *q.r6("segments_per_sample"))


def corrections_by_site(spark, d):
    return q._edits(spark, d).select("site_id", "hap_id", "old", "new").orderBy("site_id", "hap_id")


def corrections_by_haplotype(spark, d):
    return q._edits(spark, d).select("hap_id", "site_id", "old", "new").orderBy("hap_id", "site_id")


def _nearly_clean(spark, d) -> DataFrame:
    """The panel after smoothing, with one allele in some thousands flipped again."""
    n = q.sites(spark, d).groupBy("chrom").agg((F.max("site_id") + 1).alias("n"))
    words = written(seeds.packed(q.error_panel(spark, d)).join(F.broadcast(n), "chrom"))
    for k in range(4):
        edits = written(smooth.packed_corrections(words, q.S))
        if k or not smooth.is_smooth_already(edits.count(), q.error_panel(spark, d).count()):
            words = written(smooth.words_flipped(words, edits))
    each = words.select("*", F.explode(F.lit(list(range(panel.WORD)))).alias("i")).withColumn("site_id", F.col("block") * panel.WORD + F.col("i")).where("site_id < n")
    hit = F.expr("(hap_id * 31 + site_id * 17) % 4001 = 7")
    allele = F.getbit("bits", F.col("i")).cast("int")
    return written(each.select("chrom", "site_id", "hap_id", F.when(hit, 1 - allele).otherwise(allele).alias("allele")))


def smooth_again(spark, d):
    """A panel with so few corrections that it counts as smooth already: it stays as it is."""
    h = _nearly_clean(spark, d)
    n, all_alleles = smooth.corrections(h, q.S).count(), h.count()
    out, edits = smooth.smoothed(h, q.S)
    changed = evaluate.changed_alleles(h, out).select(F.col("n_changed").alias("n_changed"))
    return changed.crossJoin(edits.agg(F.count("*").alias("n_corrections"))).select(
        "n_changed", "n_corrections", F.lit(smooth.is_smooth_already(n, all_alleles)).alias("smooth_already"))


def seeds_closeout(spark, d):
    """Seeds that only the relaxed close-out keeps: runs up to the last site with just enough markers."""
    p = replace(q.P, min_seed=0.3, min_markers=30)
    at = written(q.placed(spark, d))
    run = written(q._long_runs(spark, d, at, p.min_markers, p.min_markers, p.min_seed))
    return seeds.seeds(run, at, replace(p, closeout_strict=False)).exceptAll(seeds.seeds(run, at, p))


# A panel whose haplotypes grow with the tables: two for each supplier, founders an eighth of the haplotypes.

def _grown_samples(spark, d) -> DataFrame:
    return q._table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("sample_idx"))


def grown_sites(spark, d) -> DataFrame:
    """All parts, dealt to 2000 sites at most."""
    return q._table(spark, d, "part").groupBy((F.col("p_partkey") % 2000).alias("site_id")).agg(F.sum("p_size").alias("w")).select(
        F.lit("20").alias("chrom"), "site_id", (1000 + 100 * F.col("site_id") + F.col("w") % 50).alias("bp"))


def grown_panel(spark, d) -> DataFrame:
    ids = _grown_samples(spark, d).select(F.explode(F.array(2 * F.col("sample_idx"), 2 * F.col("sample_idx") + 1)).alias("hap_id"))
    founders = ids.agg(F.greatest(F.lit(5).cast("long"), F.expr("count(*) div 8")).alias("nf"))
    # 2000 sites at most meet the haplotypes where these are, and the founders are one row
    ids = ids.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "hap_id")
    h = ids.crossJoin(F.broadcast(grown_sites(spark, d).select("chrom", "site_id"))).crossJoin(F.broadcast(founders))
    h = h.withColumn("f", F.expr("(hap_id * 7 + (site_id div 50) * (1 + hap_id % 13)) % nf"))
    allele = F.expr("((f * f * 31 + f * site_id * 17 + site_id * site_id * 13 + (site_id div 7) * f * f) % 1009) % 2")
    hit = F.expr("(hap_id * 31 + site_id * 17) % 397 = 0")
    return h.select("chrom", "site_id", "hap_id", F.when(hit, 1 - allele).otherwise(allele).cast("int").alias("allele"))


def _grown_words(spark, d):
    return seeds.packed(grown_panel(spark, d)), written(grown_placed(spark, d))


def grown_placed(spark, d):
    return gmap.interpolated(grown_sites(spark, d), grown_sites(spark, d).where("site_id % 40 = 0").select("chrom", "bp", (F.col("bp") * 0.0003).alias("cm")))


def grown_candidates(spark, d):
    return seeds.seed_candidates(grown_panel(spark, d), q.P.min_markers)


def grown_pairs(spark, d):
    """Pairs with a seed, found where they begin to agree."""
    words, at = _grown_words(spark, d)
    return seeds.seed_counts(words, at, q.P)


def grown_runs(spark, d):
    words, at = _grown_words(spark, d)
    return seeds.begun_runs(words, at, q.P.min_markers)


def grown_segments(spark, d):
    words, at = _grown_words(spark, d)
    return extend.panel_segments(words, at, q.P).select("chrom", "h1", "h2", "start_idx", "end_idx", "start_bp", "end_bp", *q.r6("length_cm"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    plain = (
        vcf_scan, vcf_blocks, vcf_packed_counts, vcf_turned, vcf_scan_mac, vcf_smoothed, map_plink, segments_binary, segments_indexed, segments_text, segments_union, segments_bucketed, dataset_file,
        dataset_segments, error_log, truth_cutoff, network_file, trees_file, both_predictions, features_scaled_all, program_filtered,
        run_statistics, corrections_by_site, corrections_by_haplotype, smooth_again, seeds_closeout, grown_candidates,
        grown_pairs, grown_runs, grown_segments)
    return {f.__name__: f for f in plain}
