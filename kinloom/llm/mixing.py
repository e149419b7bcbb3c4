"""Mixing sources to target weights by a low-discrepancy schedule.

The words of a source, its documents in a shuffled order, form a stream that is
cut into blocks of equally many words. Van der Corput points mapped through the
cumulative block counts of the sources give an endless schedule in which every
source appears evenly; the k-th slot of a source takes its k-th block, going
round the stream as often as the target asks for.

Defined results: a null or wordless text has size 0 and is never taken; a null
source is a source of its own, last in order; repeated rows are documents of
their own; an empty table gives an empty mix. Other columns of the documents may have any names.

Windows over sources see one row for each source, in one task: sources may be many (millions of short
rows), but not as many as documents of a large corpus.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, two_level_offsets

#: Words in a block.
BLOCK_WORDS = 512
#: A target stops at so many times its source's size.
MAX_REPEATS = 3
WEIGHTS = (5, 2, 1)
#: Leading hexadecimal digits of the shuffle key that split a source for prefix sums.
ORDER_DIGITS = 3
#: Consecutive slots that are ranked together.
SLOT_RUN = 1 << 12
#: Slots of a bucket of the range join between points and sources.
SLOT_BUCKET = 1 << 12


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def measured(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """``doc_id, source, src, size, ord, part``: sizes and the shuffled order."""
    return docs.select(
        "doc_id",
        "source",
        F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("src"),
        word_count(F.col("text")).alias("size"),
        F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("ord"),
    ).withColumn("part", F.substring("ord", 1, ORDER_DIGITS))


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Water filling over ``(src, source, source_size)``, one row for each source.

    Sources sorted by ``cap / weight`` are capped until the level that shares
    the rest by weight lies under the next cap. The windows run over one row
    for each source, never over documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("i") - 1) % len(weights) + 1).cast("int"))
    named = sizes.withColumn("i", F.row_number().over(by_name)).withColumn("w", pick)
    level = Window.orderBy((max_repeats * F.col("source_size") / F.col("w")).asc(), F.col("i").asc())
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    shared = named.select(
        "*",
        ((F.sum("source_size").over(every) - max_repeats * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
         / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))).alias("level"),
    )
    uncapped = max_repeats * F.col("source_size") / F.col("w") >= F.col("level")
    top = F.min(F.when(uncapped, F.struct(max_repeats * F.col("source_size") / F.col("w"), "i", "level"))).over(every)
    return shared.select(
        "src", "source", "source_size",
        F.least(F.lit(float(max_repeats)) * F.col("source_size"), top["level"] * F.col("w")).alias("target"),
    )


def with_blocks(targets: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """Adds the words to take and the slots they need; ``lo`` is the first slot share of a source."""
    words = F.floor(F.col("target") + 0.5)
    t = targets.withColumn("words", words).withColumn("blocks", F.ceil(F.col("source_size") / block))
    rounds = F.when(F.col("source_size") > 0, F.expr("words div source_size")).otherwise(0)
    t = t.withColumn("rounds", rounds).withColumn("rest", F.col("words") - F.col("rounds") * F.col("source_size"))
    t = t.withColumn("slots", F.col("rounds") * F.col("blocks") + F.ceil(F.col("rest") / block))
    w = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    return t.withColumn("lo", F.coalesce(F.sum("slots").over(w), F.lit(0)))


def van_der_corput(i: Column, bits: int) -> Column:
    """The bits of ``i`` in reverse order."""
    return F.conv(F.reverse(F.lpad(F.bin(i), bits, "0")), 2, 10).cast("long")


def schedule(planned: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """``slot, src, k, block, epoch, words``: which block every slot of the mix takes.

    At least twice as many points as slots are drawn. The first 2**b points of the sequence hit every one of 2**b equal
    intervals, so each slot share is hit and no source is met too seldom; the points of a source after its last slot are left out. The last
    slot of a source takes only the words that its target still misses.
    """
    spark = planned.sparkSession
    n = planned.agg(F.sum("slots")).first()[0] or 0
    bits = max(2, math.ceil(math.log2(2 * n + 1)))
    points = spark.range(1 << bits if n else 0).select(
        F.col("id").alias("slot"),
        F.floor(van_der_corput(F.col("id"), bits) * F.lit(n / (1 << bits))).cast("long").alias("x"),
        F.floor(F.col("id") / SLOT_RUN).alias("run"),
    )
    # A range join by buckets of slots: a large source has a row for each bucket it covers.
    owner = planned.where("slots > 0").withColumn(
        "at", F.explode(F.expr(f"sequence(lo div {SLOT_BUCKET}, (lo + slots - 1) div {SLOT_BUCKET})")))
    hits = points.withColumn("at", F.expr(f"x div {SLOT_BUCKET}")).join(owner, "at").where("x >= lo AND x < lo + slots")
    base = two_level_offsets(hits, ["src"], "run", None)
    k = F.row_number().over(Window.partitionBy("src", "run").orderBy("slot")) - 1
    ranked = hits.withColumn("k", k).join(base, ["src", "run"]).withColumn("k", F.col("k") + F.col("base"))
    ranked = ranked.where("k < slots").withColumn("block", F.expr("k % blocks")).withColumn("epoch", F.expr("k div blocks"))
    whole = F.least(F.lit(block), F.col("source_size") - F.col("block") * block)
    last = F.col("words") - F.col("epoch") * F.col("source_size") - F.col("block") * block
    return ranked.select("slot", "src", "k", "block", "epoch", F.least(whole, last).cast("long").alias("words"))


def streamed(m: DataFrame) -> DataFrame:
    """Adds ``start``: the words of the same source before each document."""
    base = two_level_offsets(m, ["src"], "part", F.col("size"))
    w = Window.partitionBy("src", "part").orderBy("ord", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    within = m.withColumn("_in", F.coalesce(F.sum("size").over(w), F.lit(0)))
    return within.join(base, ["src", "part"]).withColumn("start", F.col("_in") + F.col("base")).drop("_in", "base")


def mix(docs: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS, block: int = BLOCK_WORDS,
        seed: str = "mix") -> tuple[DataFrame, DataFrame]:
    """The mix of ``docs(doc_id, text, source)``.

    Returns ``(taken, schedule)``: one row for each document with its ``size,
    source_size, target, taken, ord`` and ``start``, the words of its source before it, and the slots in order. Words that the
    mix takes are read off the scheduled blocks.
    """
    m = cut(measured(docs, seed))
    sources = m.groupBy("src", "source").agg(F.sum("size").alias("source_size"))
    planned = cut(with_blocks(source_targets(sources, weights, max_repeats), block))
    plan = cut(schedule(planned, block))  # a row for each block of words
    # A block is taken whole in most slots and in part in the last one.
    full = F.least(F.lit(block), F.col("source_size") - F.col("block") * block)
    uses = (
        plan.join(planned.select("src", "source_size"), "src")
        .groupBy("src", "block")
        .agg(F.sum((F.col("words") >= full).cast("long")).alias("times"),
             F.max(F.when(F.col("words") < full, F.col("words"))).alias("part_words"))
    )
    pieces = (
        streamed(m).where("size > 0")
        .withColumn("block", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")))
        .withColumn("from", F.greatest(F.col("start") - F.col("block") * block, F.lit(0)))
        .withColumn("to", F.least(F.col("start") + F.col("size") - F.col("block") * block, F.lit(block)))
    )
    part = F.least(F.coalesce("part_words", F.lit(0)), F.col("to")) - F.col("from")
    got = F.coalesce("times", F.lit(0)) * (F.col("to") - F.col("from")) + F.greatest(part, F.lit(0))
    taken = (
        pieces.join(uses, ["src", "block"], "left")
        .groupBy("src", "start", "doc_id", "size", "ord").agg(F.sum(got).cast("long").alias("taken"))
        .select("doc_id", "src", "size", "ord", "start", "taken")
        .unionByName(m.where("size = 0").select(
            "doc_id", "src", "size", "ord", F.lit(None).cast("long").alias("start"), F.lit(0).cast("long").alias("taken")))
    )
    return taken.join(planned.select("src", "source_size", "target"), "src"), plan


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word, spacing included."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(rf"([\x20\x09-\x0D]*{WORD})"), 1), F.lit(1), n), "")


def mixed_documents(docs: DataFrame, slot: str | None = None, in_order: bool = False, block: int = BLOCK_WORDS, **how) -> DataFrame:
    """The rows of ``docs`` that the mix holds, repeats as rows of their own.

    A document that the mix takes only in part comes with its text up to the end of its last word there. A copy's
    place in the mix is the slot of the block that holds its first word in that round of its source:
    ``slot`` names a column for it; ``in_order`` deals the rows to partitions by it, in order, and sorts them there.
    """
    taken, plan = mix(docs, block=block, **how)
    taken = taken.where("taken > 0").select(
        F.col("doc_id").alias("__id"), F.col("size").alias("__size"), F.col("taken").alias("__taken"), F.col("src").alias("__src"), F.col("start").alias("__start"))
    own = docs.select(F.struct(*docs.columns).alias("__doc"))
    own = own.select("__doc", F.col("__doc.doc_id").alias("__key"), word_count(F.col("__doc.text")).alias("__words"), F.xxhash64("__doc.text").alias("__hash"),
                     F.coalesce(F.concat(F.lit("s"), F.col("__doc.source")), F.lit("n")).alias("__of"))
    same = F.col("__key").eqNullSafe(F.col("__id")) & (F.col("__words") == F.col("__size")) & (F.col("__of") == F.col("__src"))
    if not taken.groupBy("__id", "__size", "__src").count().where("count > 1").isEmpty():
        # rows with one id, source and size: the n-th of them takes the n-th share. Ids that don't repeat spare the texts this window's shuffle
        place = F.row_number().over(Window.partitionBy("__key", "__words", "__of").orderBy("__hash"))
        nth = F.row_number().over(Window.partitionBy("__id", "__size", "__src").orderBy("__taken", "__start"))
        own, taken = own.withColumn("__place", place), taken.withColumn("__nth", nth)
        same = same & (F.col("__place") == F.col("__nth"))
    joined = own.join(taken, same)
    some = F.expr("cast(__taken % __size as int)")
    rounds = F.sequence(F.lit(0).cast("long"), F.expr("(__taken + __size - 1) div __size - 1"))
    each = joined.select("*", F.explode(rounds).alias("__epoch"))
    text = F.when(F.col("__epoch") < F.expr("__taken div __size"), F.col("__doc.text")).otherwise(first_words(F.col("__doc.text"), some))
    each = each.withColumn("__text", text)
    if slot or in_order:
        where = plan.select(F.col("src").alias("__src"), F.col("block").alias("__block"), F.col("epoch").alias("__epoch"), F.col("slot").alias("__slot"))
        each = each.withColumn("__block", F.expr(f"__start div {block}")).join(where, ["__src", "__block", "__epoch"])
    if in_order:
        n = (plan.agg(F.max("slot")).first()[0] or 0) + 1
        parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        each = each.repartitionById(parts, (F.col("__slot") * F.lit(parts / n)).cast("int")).sortWithinPartitions("__slot", "__start")
    new = {"text": F.col("__text"), "n_chars": F.char_length("__text")}
    out = [(new[c].cast(docs.schema[c].dataType) if c in new else F.col("__doc").getField(c)).alias(c) for c in docs.columns]
    return each.select(*out, *([F.col("__slot").alias(slot)] if slot else []))


ORACLE = r"""
WITH m AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix' || coalesce(doc_id::VARCHAR, '')) AS ord
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM m GROUP BY source),
n AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS i FROM s),
w AS (SELECT *, CASE (i - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM n),
l AS (
  SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w WINDOW o AS (ORDER BY (3 * source_size)::DOUBLE / w, i)),
t AS (
  SELECT source, source_size, least(3.0::DOUBLE * source_size,
         w * (SELECT level FROM l WHERE (3 * source_size)::DOUBLE / w >= level ORDER BY (3 * source_size)::DOUBLE / w, i LIMIT 1)) AS target
  FROM l),
d AS (
  SELECT doc_id, source, size,
         coalesce(sum(size) OVER (PARTITION BY source ORDER BY ord, doc_id, size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM m)
SELECT d.doc_id, d.size, t.source_size, t.target,
       (CASE WHEN d.size = 0 THEN 0 ELSE
         (floor(t.target + 0.5)::BIGINT // t.source_size) * d.size
         + greatest(0, least(d.size, floor(t.target + 0.5)::BIGINT % t.source_size - d.start)) END)::BIGINT AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
"""
