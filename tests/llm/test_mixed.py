"""Rows of a mix: places in the schedule, whole spacing, columns with any names."""

import re

from pyspark.sql import functions as F

from kinloom.llm import mixing


def test_spacing_and_columns(spark, random_docs):
    docs = random_docs.withColumn("text", F.replace("text", F.lit(" "), F.lit(" \t\n"))).selectExpr(
        "*", "7 AS size", "1 AS taken", "2 AS start", "'x' AS src", "3 AS __nth", "4 AS _size", "5 AS slot", "6 AS block")
    texts = {r.doc_id: r.text for r in docs.collect()}
    out = mixing.mixed_documents(docs, slot="__place", block=16)
    assert out.columns == [*docs.columns, "__place"]
    rows = out.collect()
    assert rows and all(texts[r.doc_id].startswith(r.text) and r.n_chars == len(r.text) and (r.size, r.slot) == (7, 5) for r in rows)
    cut = [r for r in rows if r.text != texts[r.doc_id]]
    assert cut and all(re.fullmatch(r"(?s).*[^\x20\x09-\x0D]", r.text) for r in cut)
    got = {}
    for r in rows:
        got[r.doc_id] = got.get(r.doc_id, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    assert got == {r.doc_id: r.taken for r in mixing.mix(docs, block=16)[0].collect() if r.taken}


def test_rows_follow_the_schedule(random_docs):
    taken, plan = mixing.mix(random_docs, block=16)
    start = {r.doc_id: (r.src, r.start) for r in taken.collect()}
    slots = {(r.src, r.block, r.epoch): r.slot for r in plan.collect()}
    seen, before = {}, -1
    out = mixing.mixed_documents(random_docs, slot="place", in_order=True, block=16)
    by = {}
    for r in out.collect():
        assert r.place >= before
        before = r.place
        by.setdefault(r.doc_id, []).append(r.place)
    for i, places in by.items():
        src, at = start[i]
        assert sorted(places) == sorted(slots[src, at // 16, e] for e in range(len(places)))
        seen[src] = seen.get(src, 0) + 1
    assert len(seen) > 2


def test_schedule_over_many_sources(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('s', id % 1500) AS source", "repeat('w ', 40) AS text")
    taken, plan = mixing.mix(docs, block=16)
    rows = taken.collect()
    assert len(rows) == 3000 and sum(r.words for r in plan.collect()) == sum(r.taken for r in rows)
    assert abs(sum(r.taken for r in rows) - 3000 * 40) <= 1500
