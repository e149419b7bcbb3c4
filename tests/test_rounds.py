"""Trees are thinned without rounds, and runs are made whole where they begin."""

import random
import re

from kinloom.operators import evaluate, gmap, seeds

from engine_helpers import rows


def test_trees_are_thinned_without_rounds(spark, monkeypatch):
    calls = []
    plain = evaluate.written
    monkeypatch.setattr(evaluate, "written", lambda df: calls.append(1) or plain(df))
    r = random.Random(2)
    places = sorted({r.randrange(9_000_000, 40_000_000) for _ in range(4000)} | {70_000_000})
    used, least = places[:1], places[0] + 1
    for p in places[1:]:
        if p >= least:
            used.append(p)
            least = p + 5000
    found = evaluate.thinned_trees(spark.createDataFrame([("1", p) for p in places], "chrom string, tree_left long"))
    assert rows(found, "chrom", "tree_left") == [("1", p) for p in used]
    assert len(calls) == 2


def test_runs_are_whole_where_they_begin(spark, monkeypatch):
    """Ends meet beginnings in a shuffle only for runs beyond the next number, and Java compiles the loop (it leaves methods over 8000 bytes)."""
    made = []
    plain = seeds.written
    monkeypatch.setattr(seeds, "written", lambda df: made.append(df) or plain(df))
    other = {0, 30, 59, 60, 130, 300, 301, 420, 480}
    bits = lambda b: sum(1 << i for i in range(60) if 60 * b + i in other)
    words = spark.createDataFrame([("1", h, b, h * bits(b)) for h in (0, 1) for b in range(9)], "chrom string, hap_id long, block long, bits long")
    sites = spark.range(510).selectExpr("'1' AS chrom", "id AS site_id", "id / 10 AS cm")
    found = seeds.long_runs(words, seeds.all_pairs(words), sites, 9)
    at = sorted({-1, 510} | other)
    assert rows(found, "s", "e") == [(a + 1, b - 1) for a, b in zip(at, at[1:]) if b - a > 9]
    assert made[-1].where("s IS NULL OR e IS NULL").count() < 8
    debug = getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$").__getattr__("MODULE$")
    code = debug.codegenString(made[-1]._jdf.queryExecution().executedPlan())
    assert all(int(n) < 8000 for n in re.findall(r"maxMethodCodeSize:(\d+)", code))


def test_values_at_and_beside_sites(spark):
    sites = spark.range(125).selectExpr("'1' AS chrom", "id AS site_id", "10 * id AS bp")
    found = gmap.at_site(sites.select("chrom", "site_id"), gmap.site_words(sites, "bp"), "site_id", here=("bp", 0), before=("bp", -1), after=("bp", 1))
    assert rows(found, "site_id", "here", "before", "after") == [(i, 10 * i, 10 * i - 10 if i else None, 10 * i + 10 if i < 124 else None) for i in range(125)]
