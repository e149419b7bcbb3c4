"""Homomorphic multiset fingerprints of documents, in DataFrame functions only.

A text is the multiset of its paragraphs (parts between line feeds). Each
paragraph is hashed to a wide vector and the vectors are summed modulo powers of
two, so the order of paragraphs doesn't matter and a paragraph is inserted or
deleted by adding or subtracting its vector:

* ``exact``: 8 lanes modulo 2**60 from two SHA-256 digests of the paragraph; equal
  fingerprints mean equal multisets,
* ``sketch``: 40 numbers modulo 2**60 of three counters each. Every run of four words that follow each
  other in a line (the last ones shorter) adds the 120 bits of its hash, so a word that is inserted or deleted changes
  four runs; the counters of two texts,
  read as sums of signs, give the cosine of their multisets of runs,
* ``n``: the runs summed so far.

Defined results: a null text is an empty one (a single empty paragraph). Texts
of over 2**20 runs keep exact lanes and sums; their counters run into each
other, so only the likeness gets less precise. Repeated ids follow each other by
their text's hash; null ids come last; an only document is its own next one.
An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LANES, LANE_BITS = 8, 60
#: Counters of 20 bits, three to a number, for two halves of a run's hash.
FIELD_BITS, FIELDS, HASHES = 20, 3, 2
#: Hexadecimal digits of a half.
DIGITS = FIELD_BITS * FIELDS // 4
#: Words that follow each other in a line, from every word on: four, or as many as the line still has.
RUN = r"(?=([^\s]+(?: [^\s]+){0,3}))[^\s]+"
#: Runs that are summed as plain numbers, which hold 8 times as many.
SUMMED = 1 << 20
#: Odd numbers of 30 bits.
MIXERS = (0x2545F491, 0x1B873593)
_SPREAD = sum(1 << (FIELD_BITS * i) for i in range(FIELDS))
_SKETCH_MASK = (1 << (FIELD_BITS * FIELDS)) - 1
_LANE_MASK = (1 << LANE_BITS) - 1


def _number(digits: Column) -> Column:
    return F.conv(digits, 16, 10).cast("long")


def _sum(values: Column, term, mask: int) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: (a + term(x)).bitwiseAND(F.lit(mask)))


def paragraphs(text: Column) -> Column:
    """Digests of the paragraphs, 128 hexadecimal digits each."""
    return F.transform(F.split(text, "\n", -1), lambda p: F.concat(F.sha2(p, 256), F.sha2(F.concat(F.lit("|"), p), 256)))


def lanes(digests: Column) -> Column:
    """The exact part: sums over the digests of paragraphs, which must be a column, as it is read for each lane."""
    return F.array(*[_sum(digests, lambda h, k=k: _number(F.substring(h, 1 + LANE_BITS // 4 * k, LANE_BITS // 4)), _LANE_MASK) for k in range(LANES)])


def runs(text: Column) -> Column:
    single = F.when(F.contains(text, F.lit("\t")) | F.contains(text, F.lit("  ")), F.regexp_replace(text, "[ \t]+", " ")).otherwise(text)
    return F.regexp_extract_all(single, F.lit(RUN), F.lit(1))


def halves(run: Column) -> list[Column]:
    """Two numbers of 60 bits: the first digits of a digest, and a product of them by odd numbers."""
    one = _number(F.substring(F.md5(run), 1, DIGITS))
    bits = FIELD_BITS * FIELDS // 2
    low, high = one.bitwiseAND(F.lit((1 << bits) - 1)), F.shiftright(one, bits)
    mixed = (low * F.lit(MIXERS[0]) + high * F.lit(MIXERS[1])).bitwiseAND(F.lit(_SKETCH_MASK))
    return [one, mixed.bitwiseXOR(F.shiftright(mixed, bits - 1))]


def _counted(half: Column, k: int) -> Column:
    """The bits of counter number k: one for each of its fields."""
    return F.shiftrightunsigned(half, k).bitwiseAND(F.lit(_SPREAD))


def with_fingerprint(df: DataFrame, text: str, prefix: str) -> DataFrame:
    """Adds ``<prefix>exact``, ``<prefix>sketch`` and ``<prefix>n`` of the column ``text``, row by row."""
    own = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumns({f"{prefix}_r": F.transform(runs(own), lambda r: F.array(*halves(r))), f"{prefix}_p": paragraphs(own)})
    counters = [_sum(F.col(f"{prefix}_r"), lambda h, j=j, k=k: _counted(h[j], k), _SKETCH_MASK) for j in range(HASHES) for k in range(FIELD_BITS)]
    return df.withColumns({
        f"{prefix}exact": lanes(F.col(f"{prefix}_p")), f"{prefix}sketch": F.array(*counters), f"{prefix}n": F.size(f"{prefix}_r").cast("long")}).drop(f"{prefix}_r", f"{prefix}_p")


def sketched(df: DataFrame, key: list[str], runs: str) -> DataFrame:
    """``key, sketch, n``: the same sums as in :func:`with_fingerprint` for unique rows ``key`` with their runs,
    as plain aggregates over exploded runs. A table that is dealt out by a part of the key isn't shuffled again."""
    each = df.select(*key, F.posexplode_outer(runs).alias("_at", "_run")).withColumn("_part", F.expr(f"_at div {SUMMED}"))
    each = each.select(*key, "_part", "_run", *(h.alias(f"_h{j}") for j, h in enumerate(halves(F.col("_run")))))
    names = [f"_c{i}" for i in range(HASHES * FIELD_BITS)]
    sums = [F.coalesce(F.sum(_counted(F.col(f"_h{j}"), k)), F.lit(0)).alias(names[FIELD_BITS * j + k]) for j in range(HASHES) for k in range(FIELD_BITS)]
    parts = each.groupBy(*key, "_part").agg(F.count("_run").alias("_n"), *sums)
    total = lambda c: (F.sum(F.col(c).cast("decimal(38,0)")) % F.lit(_SKETCH_MASK + 1)).cast("long")  # noqa: E731
    return parts.groupBy(*key).agg(F.array(*[total(c) for c in names]).alias("sketch"), F.sum("_n").alias("n"))


def changed(whole: str, part: str, out: str, sign: int = 1):
    """Columns of ``whole`` with the paragraphs of ``part`` inserted (sign 1) or deleted (-1)."""
    step = lambda mask: lambda a, b: (a + sign * b).bitwiseAND(F.lit(mask))  # noqa: E731
    return {
        f"{out}exact": F.zip_with(f"{whole}exact", f"{part}exact", step(_LANE_MASK)),
        f"{out}sketch": F.zip_with(f"{whole}sketch", f"{part}sketch", step(_SKETCH_MASK)),
        f"{out}n": F.col(f"{whole}n") + sign * F.col(f"{part}n"),
    }


def as_text(prefix: str) -> Column:
    """Lanes, then counters, then the number of runs, as hexadecimal digits."""
    digits = lambda column, n: F.array_join(  # noqa: E731
        F.transform(column, lambda x: F.lower(F.lpad(F.hex(x), n, "0"))), "")
    return F.concat(digits(f"{prefix}exact", LANE_BITS // 4), digits(f"{prefix}sketch", FIELD_BITS * FIELDS // 4),
                    F.lower(F.hex(f"{prefix}n")))


def _dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)


def with_signs(df: DataFrame, *prefixes: str) -> DataFrame:
    """Adds ``<prefix>signs``, the counters as sums of signs, and ``<prefix>norm``."""
    field = lambda x, i: F.shiftright(x, FIELD_BITS * i).bitwiseAND(F.lit((1 << FIELD_BITS) - 1))  # noqa: E731
    signs = lambda p: F.flatten(F.transform(  # noqa: E731
        f"{p}sketch", lambda x: F.array(*[(2 * field(x, i) - F.col(f"{p}n")).cast("double") for i in range(FIELDS)])))
    df = df.withColumns({f"{p}signs": signs(p) for p in prefixes})
    return df.withColumns({f"{p}norm": F.sqrt(_dot(F.col(f"{p}signs"), F.col(f"{p}signs"))) for p in prefixes})


def likeness(a: str, b: str) -> Column:
    """Cosine of two multisets of runs, from their fingerprints ``with_signs``: 0 to 1."""
    same = (F.col(f"{a}exact") == F.col(f"{b}exact")) & (F.col(f"{a}sketch") == F.col(f"{b}sketch"))
    norm = F.col(f"{a}norm") * F.col(f"{b}norm")
    cosine = F.coalesce(F.try_divide(_dot(F.col(f"{a}signs"), F.col(f"{b}signs")), norm), F.lit(0.0))
    return F.when(same, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), cosine)))


def range_of(value: Column, splits: list[int]) -> Column:
    """How many of the sorted ``splits`` lie below ``value``; -1 for null."""
    if not splits:
        return F.when(value.isNull(), -1).otherwise(0)
    step = max(1, math.isqrt(len(splits)))
    below = lambda part: F.size(F.filter(part, lambda s: s < value))  # noqa: E731
    first = below(F.lit(splits[step - 1::step]))
    return F.when(value.isNull(), -1).otherwise(
        first * step + below(F.slice(F.lit(splits), first * step + 1, F.lit(step))))


def id_splits(docs: DataFrame, rows: int = 512, most: int = 1 << 16) -> list[int]:
    """Quantiles that deal the ids into ranges of about ``rows`` rows, ``most`` at most."""
    n = docs.count()
    k = min(most, n // rows)
    if k < 2:
        return []
    at = [(i + 1) / k for i in range(k - 1)]
    found = docs.agg(F.percentile_approx("doc_id", at, 10 * k)).first()[0]
    return sorted(set(found or []))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of ``docs(doc_id, text)`` and of each text edited with its next document.

    The next document (by descending id) comes from one shuffle into id ranges:
    each range gets a copy of the first row of the range after it. Runs are
    summed where the shuffle put their texts.
    """
    splits = id_splits(docs.select("doc_id"))
    rows = docs.select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), range_of(F.col("doc_id"), splits).alias("range")
    ).withColumn("th", F.xxhash64("text"))
    heads = rows.groupBy("range").agg(
        F.max_by(F.struct("doc_id", "th", "text"), F.struct("doc_id", "th")).alias("head"))
    down = Window.orderBy(F.col("range").desc())  # one row for each range
    before = F.lag("range").over(down)
    last = F.min("range").over(Window.partitionBy())
    guests = heads.withColumn("range", F.coalesce(before, last)).select(
        "head.doc_id", "head.text", "range", "head.th", F.lit(False).alias("own"))
    near = Window.partitionBy("range").orderBy(
        F.col("own").desc(), F.col("doc_id").desc_nulls_last(), F.col("th").desc())
    both = rows.withColumn("own", F.lit(True)).unionByName(guests).withColumn("nth", F.row_number().over(near)).withColumn("nxt", F.lead("text").over(near))
    n = F.char_length("text")
    half = F.expr("char_length(text) div 2")
    edited = F.concat(F.substring("text", F.lit(1), (n - half).cast("int")), F.substring("nxt", F.lit(1), half.cast("int")))
    both = both.select("range", "nth", "own", "doc_id", n.cast("long").alias("n_chars"), "text", F.when(F.col("own"), edited).alias("edited"))
    both = both.select(
        "range", "nth", "own", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        F.explode(F.filter(F.array(F.struct(F.lit(0).alias("which"), F.col("text")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("text"))),
                           lambda x: x["text"].isNotNull())).alias("x"))
    key = ["range", "nth", "which", "own", "doc_id", "n_chars", "edited_sha256", "exact"]
    both = both.select(*key[:2], "x.which", *key[3:-1], paragraphs(F.col("x.text")).alias("digests"), runs(F.col("x.text")).alias("runs"))
    sums = sketched(both.select(*key[:-1], lanes(F.col("digests")).alias("exact"), "runs"), key, "runs")
    # a document, its edited text, the next document
    order = Window.partitionBy("range").orderBy("nth", "which")
    own = F.struct("exact", "sketch", "n")
    out = sums.select("*", F.lead(own).over(order).alias("e"), F.lead(own, 2).over(order).alias("b")).where("own AND which = 0")
    out = out.select("doc_id", "n_chars", "edited_sha256", *(F.col(c).alias(f"a{c}") for c in ("exact", "sketch", "n")),
                     *(F.col(f"{x}.{c}").alias(f"{x}{c}") for x in "eb" for c in ("exact", "sketch", "n")))
    return with_signs(out, "a", "e", "b").select(
        "doc_id", "n_chars", "edited_sha256", as_text("a").alias("fingerprint"), as_text("e").alias("edited_fingerprint"),
        likeness("a", "e").alias("near_edited"), likeness("a", "b").alias("near_next"))


def merged(df: DataFrame, key: str, prefix: str = "") -> DataFrame:
    """Fingerprint of the union of the paragraphs of all rows of a key, by plain sums."""
    total = lambda column, n, mask: F.array(*[  # noqa: E731
        F.sum(F.col(column)[i].cast("decimal(38,0)")) % F.lit(mask + 1) for i in range(n)])
    return df.groupBy(key).agg(
        F.transform(total(f"{prefix}exact", LANES, _LANE_MASK), lambda x: x.cast("long")).alias(f"{prefix}exact"),
        F.transform(total(f"{prefix}sketch", FIELD_BITS * HASHES, _SKETCH_MASK), lambda x: x.cast("long")).alias(f"{prefix}sketch"),
        F.sum(f"{prefix}n").alias(f"{prefix}n"))


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS a FROM documents),
x AS (SELECT doc_id, a, coalesce(lead(a) OVER (ORDER BY doc_id DESC), first_value(a) OVER (ORDER BY doc_id DESC)) AS b FROM t),
d AS (SELECT *, substring(a, 1, length(a) - length(a) // 2) || substring(b, 1, length(a) // 2) AS e FROM x),
every AS (SELECT doc_id, 0 AS which, a AS text FROM d UNION ALL SELECT doc_id, 1, e FROM d),
lane AS (
  SELECT doc_id, which, string_agg(printf('%015x', (v % 1152921504606846976)::BIGINT), '' ORDER BY k) AS lanes FROM (
    SELECT doc_id, which, k, sum(('0x' || substr(h, 1 + 15 * k, 15))::BIGINT) AS v
    FROM (SELECT doc_id, which, sha256(p) || sha256('|' || p) AS h FROM (SELECT doc_id, which, unnest(string_split(text, chr(10))) AS p FROM every)),
      (SELECT unnest(range(8)) AS k) GROUP BY ALL) GROUP BY ALL),
line AS (SELECT doc_id, which, regexp_extract_all(unnest(regexp_split_to_array(text, '[

]')), '[^ 	]+') AS w FROM every),
run AS (SELECT doc_id, which, md5(unnest(list_transform(range(1, len(w) + 1), lambda i: array_to_string(w[i:i + 3], ' ')))) AS h FROM line),
one AS (SELECT doc_id, which, ('0x' || substr(h, 1, 15))::BIGINT AS h0 FROM run),
mixed AS (SELECT doc_id, which, h0, ((h0 & 1073741823) * MIXER_0 + (h0 >> 30) * MIXER_1) & 1152921504606846975 AS m FROM one),
half AS (SELECT doc_id, which, h0, xor(m, m >> 29) AS h1 FROM mixed),
counts AS (SELECT doc_id, which, count(*) AS n, COUNTERS FROM half GROUP BY ALL),
f AS (SELECT doc_id, which, lanes, coalesce(n, 0) AS n, FIELDS FROM every JOIN lane USING (doc_id, which) LEFT JOIN counts USING (doc_id, which)),
s AS (SELECT doc_id, which, lanes || list_aggregate(list_transform(c, lambda v: lpad(printf('%x', v), 15, '0')), 'string_agg', '') || printf('%x', n) AS text,
        flatten(list_transform(c, lambda v: [(2 * ((v >> (20 * i)) & 1048575) - n)::DOUBLE for i in range(3)])) AS signs FROM f),
p AS (
  SELECT d.doc_id, length(d.a) AS n_chars, sha256(d.e) AS edited_sha256, a.text AS ta, e.text AS te, a.signs AS sa, e.signs AS se,
    coalesce(lead(a.text) OVER w, first_value(a.text) OVER w) AS tb, coalesce(lead(a.signs) OVER w, first_value(a.signs) OVER w) AS sb
  FROM d JOIN s a ON a.doc_id = d.doc_id AND a.which = 0 JOIN s e ON e.doc_id = d.doc_id AND e.which = 1 WINDOW w AS (ORDER BY d.doc_id DESC))
SELECT doc_id, n_chars, edited_sha256, ta AS fingerprint, te AS edited_fingerprint, NEAR_E AS near_edited, NEAR_B AS near_next FROM p
"""


def oracle() -> str:
    half = [(j, k) for j in range(HASHES) for k in range(FIELD_BITS)]
    counters = ", ".join(f"sum((h{j} >> {k}) & {_SPREAD}) % {_SKETCH_MASK + 1} AS c{FIELD_BITS * j + k}" for j, k in half)
    fields = "[" + ", ".join(f"coalesce(c{i}, 0)::BIGINT" for i in range(len(half))) + "] AS c"

    def near(x: str) -> str:
        norm = f"sqrt(list_inner_product(sa, sa)) * sqrt(list_inner_product(s{x}, s{x}))"
        return f"CASE WHEN ta = t{x} THEN 1.0 WHEN {norm} > 0 THEN least(1.0, greatest(0.0, list_inner_product(sa, s{x}) / ({norm}))) ELSE 0.0 END"

    return ORACLE.replace("MIXER_0", str(MIXERS[0])).replace("MIXER_1", str(MIXERS[1])).replace("COUNTERS", counters).replace("FIELDS", fields).replace("NEAR_E", near("e")).replace("NEAR_B", near("b"))
