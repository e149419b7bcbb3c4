"""Comparison of reported segments with true ones, and of panels with each other.

Segments are ``id1, id2, start, end``, and ``chrom`` where both sides have it; a row stands for itself, so repeated rows count each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import written
from .seeds import merged

PAIR = ["id1", "id2"]
#: Base pairs of a bucket in which intervals meet.
REACH = 1 << 20
#: Base pairs of a bucket in which trees meet segments.
NEAR = 1 << 14
#: Trees of a bucket that :func:`thinned_trees` uses at most; a chromosome has a bucket for each so many times the base pairs between two used ones.
STEPS = 256


def coverage(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    """Share of ``[start, end]`` that the other interval covers; null without a length."""
    return F.try_divide(F.greatest(F.lit(0.0), F.least(end, other_end) - F.greatest(start, other_start)), end - start)


def _key(*rows: DataFrame) -> list[str]:
    """What overlapping intervals share: the pair, and the chromosome where all have one."""
    return PAIR + (["chrom"] if all("chrom" in r.columns for r in rows) else [])


def _overlaps(query: DataFrame, other: DataFrame, how) -> DataFrame:
    """Adds ``cov``: an aggregate of the coverage of each query row by the other rows of its pair.

    Intervals meet in buckets of ``REACH`` base pairs, so the many of one pair are not all compared; two that share several
    buckets count in the first of them."""
    key = _key(query, other)
    first = lambda c: F.floor(F.col(c) / REACH)
    buckets = lambda a, b: F.explode_outer(F.sequence(first(a), F.greatest(first(a), first(b)))).alias("_bucket")
    o = other.select(*key, F.col("start").alias("_s"), F.col("end").alias("_e")).select("*", buckets("_s", "_e"))
    q = query.groupBy(*query.columns).agg(F.count("*").alias("_copies")).select("*", buckets("start", "end"))
    c = F.when(F.col("_s").isNotNull() & (F.col("_bucket") == F.greatest(first("start"), first("_s"))), coverage(F.col("start"), F.col("end"), F.col("_s"), F.col("_e")))
    found = q.join(o, [*key, "_bucket"], "left").groupBy(*query.columns, "_copies").agg(F.coalesce(how(c), F.when(F.col("end") > F.col("start"), 0.0)).alias("cov"))
    return found.withColumn("_copies", F.explode(F.sequence(F.lit(1).cast("long"), "_copies"))).drop("_copies")


def best_coverage(query: DataFrame, other: DataFrame) -> DataFrame:
    return _overlaps(query, other, F.max)


def accuracy(reported: DataFrame, truth: DataFrame, least: float = 0.5) -> DataFrame:
    """``accuracy``: share of reported segments that one true segment covers enough."""
    return best_coverage(reported, truth).agg(F.avg((F.col("cov") >= least).cast("double")).alias("accuracy"))


def length_accuracy(reported: DataFrame, truth: DataFrame) -> DataFrame:
    return best_coverage(reported, truth).agg(F.avg("cov").alias("length_accuracy"))


def power(truth: DataFrame, reported: DataFrame) -> DataFrame:
    """``power``: mean over true segments of their coverage by all reported ones, summed."""
    return _overlaps(truth, reported, F.sum).agg(F.avg("cov").alias("power"))


def accumulative_power(truth: DataFrame, reported: DataFrame) -> DataFrame:
    """Power with reported segments that touch merged first."""
    key = _key(truth, reported)
    whole = merged(reported.select(*key, "start", "end"), key, "start", "end", touch=0)
    return power(truth, whole).select(F.col("power").alias("accumulative_power"))


def split_by_truth(reported: DataFrame, truth: DataFrame, cutoff: float = 0.5) -> DataFrame:
    """Adds ``is_false``: no true segment covers more than ``cutoff`` of the row."""
    return best_coverage(reported, truth).withColumn("is_false", F.col("cov") <= cutoff)


def per_sample(segs: DataFrame, n_samples: int) -> DataFrame:
    """``n_segments, per_sample``: 0 without samples."""
    n = F.count("*")
    return segs.agg(n.alias("n_segments"), (n / n_samples if n_samples else F.lit(0.0)).alias("per_sample"))


def changed_alleles(one: DataFrame, two: DataFrame) -> DataFrame:
    """``n_changed``: alleles that differ between two panels of the same sites and haplotypes."""
    o = two.select("chrom", "site_id", "hap_id", F.col("allele").alias("_a"))
    return one.join(o, ["chrom", "site_id", "hap_id"]).agg(F.coalesce(F.sum((F.col("allele") != F.col("_a")).cast("long")), F.lit(0)).alias("n_changed"))


def correction_confusion(original: DataFrame, with_error: DataFrame, smooth: DataFrame) -> DataFrame:
    """Errors, corrections and their confusion matrix, with precision and recall (null without a denominator)."""
    key = ["chrom", "site_id", "hap_id"]
    named = lambda df, c: df.select(*key, F.col("allele").alias(c))
    t = named(original, "o").join(named(with_error, "w"), key).join(named(smooth, "s"), key)
    n = lambda cond: F.coalesce(F.sum(F.expr(cond).cast("long")), F.lit(0))
    m = t.agg(
        n("o <> w").alias("errors"), n("s <> w").alias("corrections"), n("s = w").alias("non_corrections"),
        n("s <> w AND o = s").alias("tp"), n("s <> w AND o <> s").alias("fp"), n("s = w AND o <> s").alias("fn"), n("s = w AND o = s").alias("tn"))
    return m.select("*", F.try_divide("tp", F.col("tp") + F.col("fp")).alias("precision"), F.try_divide("tp", F.col("tp") + F.col("fn")).alias("recall"))


def thinned_trees(trees: DataFrame, apart: int = 5000) -> DataFrame:
    """``chrom, tree_left`` of the trees that are used: the first one, then each that lies far enough
    from the last one used (from 0 at first).

    What a bucket of base pairs makes of the place from which its trees may be used only depends on the first tree that may; few can be that,
    so each bucket is gone through once for each of them. A fold over a row for each bucket then names the place for every bucket,
    and those with their places go through their trees once more: no rounds."""
    step = max(apart, 1)
    begin = F.col("bucket") * (STEPS * step)
    places = written(trees.select("chrom", F.col("tree_left").cast("long").alias("bp")).distinct())
    first = places.groupBy("chrom").agg(F.min("bp").alias("first"))
    far = places.join(F.broadcast(first), "chrom").where(F.col("bp") >= F.greatest(F.col("first") + 1, F.lit(apart)))  # a row for each chromosome
    dealt = written(far.groupBy("chrom", F.floor(F.col("bp") / (STEPS * step)).alias("bucket")).agg(F.sort_array(F.collect_set("bp")).alias("at")))
    # the place from which a tree may be used lies less than a step behind the beginning of a bucket
    enters = F.filter("at", lambda p, i: (i == 0) | (F.get("at", i - 1) < begin + step))
    leaves = F.transform(enters, lambda e: F.struct(e.alias("enter"), F.aggregate("at", e, lambda t, p: F.when(p >= t, p + step).otherwise(t)).alias("leave")))
    row = dealt.select("chrom", F.struct("bucket", leaves.alias("ways")).alias("b")).groupBy("chrom").agg(F.sort_array(F.collect_list("b")).alias("bs"))
    onward = lambda t, b: F.coalesce(F.get(F.filter(b["ways"], lambda x: x["enter"] >= t), F.lit(0))["leave"], t)
    none = F.array().cast("array<struct<bucket: bigint, from: bigint>>")
    chain = F.aggregate("bs", F.struct(F.lit(-(1 << 62)).alias("t"), none.alias("seen")), lambda x, b: F.struct(
        onward(x["t"], b).alias("t"), F.array_append(x["seen"], F.struct(b["bucket"].alias("bucket"), x["t"].alias("from"))).alias("seen")))
    entered = row.select("chrom", F.explode(chain["seen"]).alias("x")).select("chrom", "x.bucket", "x.from")
    walk = F.aggregate("at", F.struct(F.col("from").alias("t"), F.array().cast("array<bigint>").alias("used")), lambda x, p: F.when(
        p >= x["t"], F.struct((p + step).alias("t"), F.array_append(x["used"], p).alias("used"))).otherwise(x))
    used = dealt.join(entered, ["chrom", "bucket"]).select("chrom", F.explode(walk["used"]).alias("tree_left"))
    return first.select("chrom", F.col("first").alias("tree_left")).unionByName(used)


def mrca_segments(trees: DataFrame, ends: DataFrame, apart: int = 5000) -> DataFrame:
    """Spans of an unchanged common ancestor of two haplotypes.

    ``trees(chrom, h1, h2, tree_left, mrca)``, ``ends(chrom, end_bp)``; returns
    ``chrom, h1, h2, start_bp, end_bp``."""
    return mrca_spans(trees.join(thinned_trees(trees, apart), ["chrom", "tree_left"]), ends)


def mrca_spans(used: DataFrame, ends: DataFrame) -> DataFrame:
    """:func:`mrca_segments` of trees that are all used: of those that :func:`thinned_trees` chose by their places, before haplotypes were paired."""
    w = Window.partitionBy("chrom", "h1", "h2").orderBy("tree_left")
    change = used.withColumn("_new", F.coalesce(F.lag("mrca").over(w) != F.col("mrca"), F.lit(True))).where("_new")
    spans = change.withColumn("_to", F.lead("tree_left").over(w)).join(F.broadcast(ends), "chrom")
    return spans.select("chrom", "h1", "h2", F.col("tree_left").cast("long").alias("start_bp"), F.coalesce("_to", "end_bp").cast("long").alias("end_bp"))


def tree_ends(used: DataFrame, ends: DataFrame) -> DataFrame:
    """``used(chrom, tree_left, ...)``, a row for each tree that is used, with its number ``nth`` and ``to_bp``, where the next one or the end of the chromosome is."""
    w = Window.partitionBy("chrom").orderBy("tree_left")
    return used.withColumns({"nth": F.row_number().over(w), "_to": F.lead("tree_left").over(w)}).join(F.broadcast(ends), "chrom").withColumn(
        "to_bp", F.coalesce("_to", "end_bp").cast("long")).drop("_to", "end_bp")


def shared_spans(shared: DataFrame) -> DataFrame:
    """:func:`mrca_spans` of the trees in which two haplotypes share an ancestor, with ``cm_start, cm_end``; the other trees aren't read.

    ``shared(chrom, h1, h2, mrca, nth, tree_left, to_bp, cm_start, cm_end)``: trees that follow each other with one ancestor are a span."""
    w = Window.partitionBy("chrom", "h1", "h2", "mrca").orderBy("nth")
    islands = shared.withColumn("_island", F.col("nth") - F.row_number().over(w)).groupBy("chrom", "h1", "h2", "mrca", "_island").agg(
        F.min("tree_left").cast("long").alias("start_bp"), F.max("to_bp").cast("long").alias("end_bp"),
        F.min_by("cm_start", "nth").alias("cm_start"), F.max_by("cm_end", "nth").alias("cm_end"))
    return islands.select("chrom", "h1", "h2", "start_bp", "end_bp", "cm_start", "cm_end")


def trees_beside(segs: DataFrame, trees: DataFrame) -> DataFrame:
    """``trees(chrom, tree_left, to_bp, ...)`` with ``h1, h2``: each tree once for each pair that has a segment which overlaps it.

    They meet in buckets of ``NEAR`` base pairs, so the trees that are looked at grow with the length of the segments."""
    first = lambda c: F.floor(F.col(c) / NEAR)
    buckets = lambda a, b: F.explode(F.sequence(first(a), F.greatest(first(a), first(b)))).alias("_bucket")
    s = segs.select("chrom", "h1", "h2", "start_bp", "end_bp", buckets("start_bp", "end_bp"))
    t = trees.select("*", buckets("tree_left", "to_bp"))
    met = s.join(t, ["chrom", "_bucket"]).where("start_bp < to_bp AND tree_left < end_bp")
    return met.select("h1", "h2", *trees.columns).distinct()
