"""Truth that is made beside segments, and pairs of few haplotypes."""

import random

from kinloom import queries as q
from kinloom.operators import evaluate, seeds

DATA = "/root/testdata/sf0.001"


def test_accuracy_makes_no_tree_of_every_pair(spark, monkeypatch):
    """Neither the trees of all pairs nor a search for pairs; what a segment meets of the truth is the same."""
    whole = q._truth(spark, DATA).select("chrom", "h1", "h2", "start_bp", "end_bp").localCheckpoint()

    def never(*a, **k):
        raise AssertionError

    monkeypatch.setattr(q.evaluate, "mrca_spans", never)
    monkeypatch.setattr(q.seeds, "least_pairs", never)
    found, near = (x.localCheckpoint() for x in q._compared(spark, DATA))
    whole = q._as_intervals(whole)
    assert near.exceptAll(whole).isEmpty() and 0 < near.count() < whole.count() / 2
    left = whole.exceptAll(near).withColumnsRenamed({"start": "s", "end": "e"})
    assert found.join(left, ["chrom", "id1", "id2"]).where("s < `end` AND start < e").isEmpty()
    assert sorted(evaluate.best_coverage(found, near).collect()) == sorted(evaluate.best_coverage(found, whole).collect())
    assert evaluate.accuracy(found, whole).collect() == evaluate.accuracy(found, near).collect()


def test_spans_of_shared_ancestors(spark):
    r = random.Random(3)
    places = {c: sorted(r.sample(range(100_000), 40)) for c in "12"}
    used = spark.createDataFrame([(c, p) for c in places for p in places[c]], "chrom string, tree_left long")
    ends = spark.createDataFrame([("1", 100_000), ("2", 200_000)], "chrom string, end_bp long")
    rows = [(c, 0, h, p, r.choice([1, 1, 2, 1000 + i])) for c in places for h in (1, 2) for i, p in enumerate(places[c])]
    trees = spark.createDataFrame(rows, "chrom string, h1 long, h2 long, tree_left long, mrca long")
    tree = evaluate.tree_ends(used, ends).selectExpr("*", "-tree_left / 10 AS cm_start", "-to_bp / 10 AS cm_end")  # a map that falls keeps its ends too
    shared = evaluate.shared_spans(trees.where("mrca < 1000").join(tree, ["chrom", "tree_left"]))
    single = trees.where("mrca >= 1000").join(tree, ["chrom", "tree_left"]).select("chrom", "h1", "h2", "tree_left", "to_bp")
    assert shared.where("cm_start <> -start_bp / 10 OR cm_end <> -end_bp / 10").isEmpty()
    found = shared.drop("cm_start", "cm_end").collect() + single.collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, evaluate.mrca_spans(trees, ends).collect()))


def test_trees_beside_segments_once_each(spark):
    r = random.Random(4)
    tree = [("1", i, 5000 * i, 5000 * i + r.choice([5000, 40_000])) for i in range(60)]
    segs = [("1", 0, h, s, s + r.choice([0, 900, 20_000])) for h in (2, 3) for s in (r.randrange(300_000) for _ in range(25))]
    want = {(h, i) for _, _, h, s, e in segs for _, i, a, b in tree if s < b and a < e}
    found = evaluate.trees_beside(
        spark.createDataFrame(segs, "chrom string, h1 long, h2 long, start_bp long, end_bp long"), spark.createDataFrame(tree, "chrom string, block long, tree_left long, to_bp long"))
    assert sorted((x.h2, x.block) for x in found.collect()) == sorted(want)


def test_many_haplotypes_are_searched_for_pairs(spark, monkeypatch):
    r = random.Random(5)
    words = spark.createDataFrame([("1", h, b, r.getrandbits(60)) for h in range(6) for b in range(2)], "chrom string, hap_id long, block long, bits long")
    sites = spark.createDataFrame([("1", i, i / 10) for i in range(120)], "chrom string, site_id long, cm double")
    assert seeds.compared_pairs(words, sites, 60).count() == 15
    monkeypatch.setattr(seeds, "ALL", 5)
    assert seeds.compared_pairs(words, sites, 60).count() == seeds.least_pairs(words, sites, 60).count() < 15
    assert seeds.compared_pairs(words.limit(0), sites, 60).count() == 0


def test_a_run_moves_to_its_pair_once(spark):
    """The events of a run are made where its pair is, and runs without any are dropped before."""
    from kinloom.operators import extend
    from kinloom.params import Detection

    sites = spark.createDataFrame([("1", i, 100 * i, i / 10) for i in range(120)], "chrom string, site_id long, bp long, cm double")
    run = spark.createDataFrame([("1", 0, 2, 0, 30), ("1", 0, 2, 32, 34), ("1", 0, 2, 36, 70)], "chrom string, h1 long, h2 long, s long, e long")
    found = extend.run_steps(run, sites, Detection(min_seed=3.0, max_gap=500, min_extend=2.0, min_markers=20))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.index("Generate explode") < plan.index("RepartitionByExpression")
    assert sorted(map(tuple, found.collect())) == [("1", 0, 2, False, 36, -1), ("1", 0, 2, True, 30, 70)]
