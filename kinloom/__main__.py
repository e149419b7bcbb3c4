"""``python -m kinloom PANEL.vcf[.gz] MAP [options]``: segments of a panel, filtered by a model if asked for."""

from __future__ import annotations

import argparse

from pyspark.sql import Observation, SparkSession
from pyspark.sql import functions as F

from .checkpoints import written
from .functions import models
from .params import Detection, Smoothing
from .plans import detect
from .sources import maps, segments, vcf

MODES = ("none", "x", "n")


def options(args: list[str] | None = None) -> argparse.Namespace:
    """Known options; unknown ones are ignored. ``--threads`` has no effect on results: Spark deals out the work."""
    p = argparse.ArgumentParser(prog="kinloom", description=__doc__)
    p.add_argument("panel")
    p.add_argument("map")
    p.add_argument("--threads", type=int, default=1)
    p.add_argument("--min-output", type=float, default=2.0)
    p.add_argument("--min-seed", type=float, default=2.0)
    p.add_argument("--max-gap", type=int, default=1000)
    p.add_argument("--min-extend", type=float)
    p.add_argument("--min-markers", type=int, default=100)
    p.add_argument("--min-mac", type=int, default=2)
    p.add_argument("--no-psmoother", action="store_true", help="take the panel as it is")
    p.add_argument("--ps-length", type=int, default=20)
    p.add_argument("--ps-width", type=int, default=20)
    p.add_argument("--ps-gap", type=int, default=1)
    p.add_argument("--ps-rho", type=float, default=0.05)
    p.add_argument("--filter", type=str.lower, default="none", choices=MODES, help="x: boosted trees, n: network")
    p.add_argument("--model-path")
    p.add_argument("--output", default="predicted_segments.txt")
    p.add_argument("--segments", default="segments.tsv")
    known, _ = p.parse_known_args(args)
    if known.filter != "none" and not known.model_path:
        p.error("--filter needs --model-path")
    return known


def run(spark: SparkSession, o: argparse.Namespace) -> detect.Found:
    """Detects, writes and, with a model, filters. The counts in ``statistics`` are taken off the writes, so nothing runs twice for them."""
    panel = vcf.read_vcf(spark, o.panel)
    s = None if o.no_psmoother else Smoothing(o.ps_length, o.ps_width, o.ps_gap, o.ps_rho)
    p = Detection(o.min_seed, o.max_gap, o.min_extend, o.min_markers, o.min_mac, o.min_output)
    found = detect.detect_panel(panel, maps.read_map(spark, o.map), p, s)
    found.segments = written(found.segments)
    seen = Observation("segments")
    segments.write_tsv(segments.indexed_rows(found.segments.observe(seen, F.count("*").alias("n"))), o.segments)
    found.statistics = detect.counted(panel.n_haps // 2, found.sites.count(), seen.get["n"])
    if o.filter != "none":
        load = models.load_trees if o.filter == "x" else models.load_network
        kept, passed = detect.filtered(found, load(spark, o.model_path)), Observation("kept")
        segments.write_tsv(segments.named_rows(kept.observe(passed, F.count("*").alias("n")), panel.samples), o.output)
        found.statistics |= detect.passed(seen.get["n"], passed.get["n"])
    return found


def main() -> None:
    o = options()
    spark = SparkSession.builder.appName("kinloom").config("spark.cleaner.referenceTracking.cleanCheckpoints", "true").getOrCreate()
    for name, value in run(spark, o).statistics.items():
        print(f"{name}\t{value}")


if __name__ == "__main__":
    main()
