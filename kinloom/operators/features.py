"""Features of segments, by chunks of their sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNKS = 10
NAMES = ("phys_len", "gen_len", "n_mismatches", "n_corrections")
KEY = ("chrom", "h1", "h2", "start_idx", "end_idx")
#: Sites that share a bucket of the range joins.
BUCKET = 256


def feature_names(chunks: int = CHUNKS) -> list[str]:
    return [f"{n}_{c}" for c in range(chunks) for n in NAMES]


def _inside(segs: DataFrame, events: DataFrame, last_site: bool) -> DataFrame:
    """Events ``(chrom, *key, site_id)`` of a segment's key inside it, by buckets of sites."""
    key = [c for c in events.columns if c not in ("chrom", "site_id", "n")]
    span = segs.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start_idx") / BUCKET), F.floor(F.col("end_idx") / BUCKET))))
    ev = events.withColumn("_b", F.floor(F.col("site_id") / BUCKET))
    end = F.col("site_id") <= F.col("end_idx") if last_site else F.col("site_id") < F.col("end_idx")
    return span.join(ev, ["chrom", *key, "_b"]).where((F.col("site_id") >= F.col("start_idx")) & end)


def _counted(segs: DataFrame, mm: DataFrame, edits: DataFrame, chunk: Column, last_site: bool) -> DataFrame:
    """Mismatches of the pair and corrections of either haplotype, by segment and chunk."""
    key = list(KEY)
    wrong = _inside(segs.select(*key), mm, last_site).withColumn("chunk", chunk).groupBy(*key, "chunk").agg(
        F.count("*").alias("n_mismatches"), F.lit(0).cast("long").alias("n_corrections"))
    each = segs.select(*key, F.explode(F.array("h1", "h2")).alias("hap_id"))
    mended = _inside(each, edits.select("chrom", "hap_id", "site_id"), last_site).withColumn("chunk", chunk).groupBy(*key, "chunk").agg(
        F.lit(0).cast("long").alias("n_mismatches"), F.count("*").alias("n_corrections"))
    return wrong.unionByName(mended).groupBy(*key, "chunk").agg(
        F.sum("n_mismatches").alias("n_mismatches"), F.sum("n_corrections").alias("n_corrections"))


def chunked(segs: DataFrame, sites: DataFrame, mm: DataFrame, edits: DataFrame, chunks: int = CHUNKS, flavour: str = "even") -> DataFrame:
    """``chrom, h1, h2, start_idx, end_idx, chunk`` with the four features, in long form.

    ``even``: chunk c of n sites spans ``[c n div chunks, (c+1) n div chunks)``; the
    segment's last site is left out of the counts. ``remainder``: chunks of
    ``n div (chunks-1)`` sites and a last one of the rest, the physical length up to
    the next chunk's first site. Empty chunks are zeros.
    """
    key = list(KEY)
    n = F.col("end_idx") - F.col("start_idx") + 1
    each = segs.select(*key, F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    into = F.col("site_id") - F.col("start_idx")
    if flavour == "even":
        lo = F.col("start_idx") + F.expr(f"(chunk * (end_idx - start_idx + 1)) div {chunks}")
        hi = F.col("start_idx") + F.expr(f"((chunk + 1) * (end_idx - start_idx + 1)) div {chunks}")
        chunk = F.expr(f"((site_id - start_idx + 1) * {chunks} - 1) div (end_idx - start_idx + 1)")
        each = each.withColumns({"lo": lo, "hi": hi, "phys_end": hi - 1})
    else:
        size = F.expr(f"(end_idx - start_idx + 1) div {chunks - 1}")
        last = F.col("chunk") == chunks - 1
        lo = F.col("start_idx") + F.col("chunk") * size
        hi = F.when(last, F.col("start_idx") + n).otherwise(lo + size)
        chunk = F.when(size == 0, chunks - 1).otherwise(F.least(F.lit(chunks - 1), F.floor(into / F.greatest(size, F.lit(1)))))
        each = each.withColumns({"lo": lo, "hi": hi, "phys_end": hi})
    at = sites.select("chrom", "site_id", "bp", "cm")
    end = sites.groupBy("chrom").agg(F.max("site_id").alias("_last"))
    each = each.join(F.broadcast(end), "chrom").where("hi > lo").withColumn("phys_end", F.least("phys_end", "_last")).withColumn("gen_end", F.col("hi") - 1)
    named = lambda site, *cols: at.select("chrom", F.col("site_id").alias(site), *(F.col(c).alias(f"{site}_{c}") for c in cols))
    each = each.join(named("lo", "bp", "cm"), ["chrom", "lo"]).join(named("phys_end", "bp"), ["chrom", "phys_end"]).join(named("gen_end", "cm"), ["chrom", "gen_end"])
    lengths = each.select(*key, "chunk", (F.col("phys_end_bp") - F.col("lo_bp")).cast("double").alias("phys_len"), (F.col("gen_end_cm") - F.col("lo_cm")).alias("gen_len"))
    counts = _counted(segs, mm, edits, chunk.cast("int"), flavour != "even")
    every = segs.select(*key, F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    filled = every.join(lengths, [*key, "chunk"], "left").join(counts, [*key, "chunk"], "left")
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
    return filled.select(*key, "chunk", *(zero(c) for c in NAMES))


def wide(long: DataFrame, chunks: int = CHUNKS) -> DataFrame:
    """One row for each segment, with a column for each feature of each chunk."""
    at = [F.max(F.when(F.col("chunk") == c, F.col(n))).alias(f"{n}_{c}") for c in range(chunks) for n in NAMES]
    return long.groupBy(*KEY).agg(*at)


def statistics(features: DataFrame, names: list[str]) -> DataFrame:
    """``name, mean, std`` of each feature: population deviation, 1 where there is none."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("x")) for n in names]))
    s = features.select(each.alias("f")).groupBy("f.name").agg(F.avg("f.x").alias("mean"), F.stddev_pop("f.x").alias("std"))
    return s.select("name", "mean", F.when(F.col("std") < 1e-8, 1.0).otherwise(F.col("std")).alias("std"))


def scaled(features: DataFrame, names: list[str]) -> DataFrame:
    """Features as z-scores, by the statistics over all rows (one row, broadcast)."""
    stats = features.agg(*(f(n).alias(f"_{k}_{n}") for n in names for k, f in (("m", F.avg), ("s", F.stddev_pop))))
    z = lambda n: ((F.col(n) - F.col(f"_m_{n}")) / F.when(F.col(f"_s_{n}") < 1e-8, 1.0).otherwise(F.col(f"_s_{n}"))).alias(n)
    rest = [c for c in features.columns if c not in names]
    return features.crossJoin(F.broadcast(stats)).select(*rest, *(z(n) for n in names))


def without_truth(dataset: DataFrame) -> DataFrame:
    """Rows of class 2 and 3 as 0 and 1."""
    return dataset.where("classification <> 1").withColumn("classification", F.col("classification") - 2)
