"""Hand-computed cases."""

import pytest
from engine_helpers import rows
from pyspark.sql import functions as F

from kinloom.functions.models import Network, Trees, scored, tree_columns
from kinloom.operators import evaluate, features, gmap, panel, seeds, smooth
from kinloom.params import Detection, Smoothing

KNOTS = [("1", 1000, 0.0), ("1", 2000, 1.0), ("1", 10000, 6.0)]


def panel_of(spark, haps):
    return spark.createDataFrame([("1", s, h, a) for h, row in enumerate(haps) for s, a in enumerate(row)], "chrom string, site_id bigint, hap_id bigint, allele int")


def test_map_interpolation(spark):
    k = spark.createDataFrame(KNOTS, "chrom string, bp bigint, cm double")
    at = spark.createDataFrame([("1", x) for x in (500, 1500, 2000, 12000)], "chrom string, bp bigint")
    got = {r.bp: r.cm for r in gmap.interpolated(at, k).collect()}
    assert got == pytest.approx({500: -1 / 3, 1500: 0.5, 2000: 1.0, 12000: 7.25})
    got = {r.bp: r.cm for r in gmap.interpolated(at, k, "clamp").collect()}
    assert got == pytest.approx({500: 0.0, 1500: 0.5, 2000: 1.0, 12000: 6.0})


def test_map_of_one_knot_and_repeated_places(spark):
    one = spark.createDataFrame(KNOTS[:1], "chrom string, bp bigint, cm double")
    exact = spark.createDataFrame([("1", 1000)], "chrom string, bp bigint")
    assert gmap.interpolated(exact, one).first().cm == 0.0
    with pytest.raises(Exception, match="one knot"):
        gmap.interpolated(spark.createDataFrame([("1", 7)], "chrom string, bp bigint"), one).collect()
    two = spark.createDataFrame(KNOTS + [("1", 2000, 3.0)], "chrom string, bp bigint, cm double")
    assert gmap.interpolated(spark.createDataFrame([("1", 2000)], "chrom string, bp bigint"), two).first().cm == 1.0


def test_smoothing(spark):
    alone = panel_of(spark, [[0, 1, x, 1, 0] for x in (0, 0, 0, 1)])
    assert rows(smooth.corrections(alone, Smoothing(2, 4, 1, 0.25))) == [("1", 2, 3, 1, 0)]
    assert rows(smooth.corrections(alone, Smoothing(2, 5, 1, 0.25))) == []
    tie = panel_of(spark, [[0, 1, x, 1, 0] for x in (0, 0, 1, 1)])
    assert rows(smooth.corrections(tie, Smoothing(2, 4, 1, 0.5)), "site_id", "hap_id", "new") == [(2, 2, 0), (2, 3, 0)]
    assert smooth.is_smooth_already(1, 10_000) and not smooth.is_smooth_already(0, 10) and not smooth.is_smooth_already(10, 10_000)


def test_runs_and_close_out(spark):
    pairs = spark.createDataFrame([("1", 0, 2)], "chrom string, h1 bigint, h2 bigint")
    mm = spark.createDataFrame([("1", 0, 2, 3), ("1", 0, 2, 7)], "chrom string, h1 bigint, h2 bigint, site_id bigint")
    at = spark.createDataFrame([("1", i, 100 * i, 5.0 * i) for i in range(10)], "chrom string, site_id bigint, bp bigint, cm double")
    run = seeds.runs(mm, pairs, at)
    assert rows(run, "s", "e") == [(0, 2), (4, 6), (8, 9)]
    strict = Detection(min_seed=2.0, min_markers=2)
    assert rows(seeds.seeds(run, at, strict), "s", "e") == [(0, 2), (4, 6)]
    relaxed = Detection(min_seed=2.0, min_markers=2, closeout_strict=False)
    assert rows(seeds.seeds(run, at, relaxed), "s", "e") == [(0, 2), (4, 6), (8, 9)]


def test_merging(spark):
    s = spark.createDataFrame([("p", 0, 4), ("p", 5, 9), ("p", 11, 12)], "k string, s bigint, e bigint")
    assert rows(seeds.merged(s, ["k"]), "s", "e") == [(0, 9), (11, 12)]
    s = spark.createDataFrame([("p", 1, 5), ("p", 5, 8), ("p", 10, 12)], "k string, s bigint, e bigint")
    assert rows(seeds.merged(s, ["k"], touch=0), "s", "e") == [(1, 8), (10, 12)]


def test_coverage(spark):
    kind = "id1 bigint, id2 bigint, start double, end double"
    rep = spark.createDataFrame([(0, 2, 100.0, 200.0), (0, 2, 100.0, 200.0), (1, 3, 5.0, 5.0)], kind)
    tru = spark.createDataFrame([(0, 2, 140.0, 400.0)], kind)
    assert rows(evaluate.best_coverage(rep.where("id1 = 0"), tru), "cov") == [(0.6,), (0.6,)]
    assert evaluate.power(tru, rep.where("id1 = 0").distinct()).first()[0] == pytest.approx(60 / 260)
    assert evaluate.accumulative_power(tru, rep).first()[0] == pytest.approx(60 / 260)
    assert evaluate.best_coverage(rep.where("id1 = 1"), tru).first().cov is None
    assert evaluate.accuracy(rep.limit(0), tru).first()[0] is None


def test_chunk_bounds_and_features(spark):
    at = spark.createDataFrame([("1", i, 10 * i, 0.1 * i) for i in range(30)], "chrom string, site_id bigint, bp bigint, cm double")
    seg = spark.createDataFrame([("1", 0, 2, 0, 24)], "chrom string, h1 bigint, h2 bigint, start_idx bigint, end_idx bigint")
    mm = spark.createDataFrame([("1", 0, 2, x) for x in (2, 4, 24)], "chrom string, h1 bigint, h2 bigint, site_id bigint")
    edits = spark.createDataFrame([("1", 5, 0), ("1", 5, 2), ("1", 24, 2)], "chrom string, site_id bigint, hap_id bigint")
    f = features.chunked(seg, at, mm, edits)
    got = {r.chunk: r for r in f.collect()}
    bounds = [0, 2, 5, 7, 10, 12, 15, 17, 20, 22, 25]
    assert [got[c].phys_len for c in range(10)] == [10 * (b - 1 - a) for a, b in zip(bounds, bounds[1:])]
    assert [got[c].n_mismatches for c in range(10)] == [0, 2, 0, 0, 0, 0, 0, 0, 0, 0]  # the last site doesn't count
    assert [got[c].n_corrections for c in range(10)] == [0, 0, 2, 0, 0, 0, 0, 0, 0, 0]
    f = features.chunked(seg, at, mm, edits, flavour="remainder")
    got = {r.chunk: r for r in f.collect()}
    assert [got[c].phys_len for c in range(10)] == [20.0] * 9 + [70.0]
    assert sum(r.n_mismatches for r in got.values()) == 3
    assert features.wide(f).count() == 1


def test_scaling_of_a_constant(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0)], "id int, x double")
    assert rows(features.scaled(df, ["x"])) == [(1, 0.0), (2, 0.0)]
    assert rows(features.statistics(df, ["x"])) == [("x", 5.0, 1.0)]


def test_network_file_and_two_ways_to_score(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    net = Network([rng.normal(size=(3, 4)), rng.normal(size=(1, 3))], [rng.normal(size=3), rng.normal(size=1)])
    again = Network.parse(net.pack())
    x = rng.normal(size=(5, 4))
    assert np.allclose(net.predict(x), again.predict(x), atol=1e-5)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id int, a double, `b.b` double, c double, score double")
    got = scored(df, ["a", "b.b", "c", "score"], net, "out")
    assert got.columns == [*df.columns, "out"]
    assert np.allclose([r.out for r in sorted(got.collect())], net.predict(x))
    over = scored(df, ["a", "b.b", "c", "score"], net)  # a column of that name is replaced
    assert over.columns == df.columns and np.allclose([r.score for r in sorted(over.collect())], net.predict(x))
    missing = spark.createDataFrame([(1.0, None)], "a double, b double")
    one = Network([np.ones((1, 2))], [np.zeros(1)])
    assert scored(missing, ["a", "b"], one).first().score is None
    with pytest.raises(ValueError):
        Network.parse(b"\0" * 12)
    with pytest.raises(ValueError):
        Network.parse(net.pack()[:-4])


def test_trees_take_the_default_side_of_a_missing_value():
    import json

    import numpy as np

    model = Trees.parse(json.dumps({"learner": {"learner_model_param": {"base_score": "[5E-1]"}, "gradient_booster": {"model": {"trees": [
        {"left_children": [1, -1, -1], "right_children": [2, -1, -1], "split_indices": [0, 0, 0], "split_conditions": [1.0, -2.0, 2.0], "default_left": [0, 0, 0]}]}}}}))
    got = model.predict(np.array([[0.0], [1.0], [np.nan]]))
    assert np.allclose(got, 1 / (1 + np.exp([2.0, -2.0, -2.0])))


def test_trees_in_the_jvm_score_as_over_arrays(spark):
    import numpy as np

    rng = np.random.default_rng(5)

    def grown(depth):
        """A tree with leaves at all depths up to ``depth``."""
        t = {k: [] for k in ("left_children", "right_children", "split_indices", "split_conditions", "default_left")}

        def node(d):
            at = len(t["left_children"])
            for k, v in zip(t, (-1, -1, int(rng.integers(3)), float(np.float32(rng.normal())), bool(rng.integers(2)))):
                t[k].append(v)
            if d and (d == depth or rng.random() < 0.8):
                t["left_children"][at], t["right_children"][at] = node(d - 1), node(d - 1)
            return at

        node(depth)
        return {k: np.array(v, np.float32 if k == "split_conditions" else None) for k, v in t.items()}

    model = Trees([grown(d) for d in (0, 1, 3, 6)], -0.25)
    x = rng.normal(size=(200, 3))
    x[::7, 1] = np.nan
    x[0] = model.trees[1]["split_conditions"][0]  # equal to a condition: right
    x[1] = [np.inf, -np.inf, np.inf]
    df = spark.createDataFrame([(i, *(None if i % 2 and np.isnan(v) else float(v) for v in r)) for i, r in enumerate(x)], "id int, a double, b double, c double")
    got = scored(df, ["a", "b", "c"], model)
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    assert np.allclose([r.score for r in sorted(got.collect())], model.predict(x), rtol=1e-12)
    many = Trees([grown(4) for _ in range(20)], 0.5)  # over Arrow batches
    assert np.allclose([r.score for r in sorted(scored(df, ["a", "b", "c"], many).collect())], many.predict(x))
    walked = df.select("id", tree_columns(F.array(*[F.coalesce(F.col(c), F.lit(float("nan"))).cast("float") for c in "abc"]), many).alias("score"))
    assert np.allclose([r.score for r in sorted(walked.collect())], many.predict(x), rtol=1e-12)
    assert np.allclose([r.score for r in scored(df, ["a"], Trees([], 0.5)).collect()], 1 / (1 + np.exp(-0.5)))


def test_site_types_and_packing(spark):
    haps = panel_of(spark, [[0, 1, 0], [0, 1, 1], [0, 1, 0], [0, 1, 0]])
    c = panel.allele_counts(haps)
    kinds = rows(c.select("site_id", panel.site_type(c["n_alt"], c["n_haps"])))
    assert kinds == [(0, "MONO_REF"), (1, "MONO_ALT"), (2, "DENSE")]
    assert rows(panel.packed_haplotypes(haps), "hap_id", "bits") == [(0, 2), (1, 6), (2, 2), (3, 2)]
    back = panel.transposed(panel.packed_sites(haps)).where("hap_id < 4")
    assert rows(back, "hap_id", "bits") == [(0, 2), (1, 6), (2, 2), (3, 2)]


def test_trees_of_ancestors(spark):
    t = spark.createDataFrame([("1", 0, 1, x, m) for x, m in ((0, 1), (3000, 2), (6000, 2), (9000, 1), (20000, 2))], "chrom string, h1 bigint, h2 bigint, tree_left bigint, mrca bigint")
    assert rows(evaluate.thinned_trees(t), "tree_left") == [(0,), (6000,), (20000,)]
    ends = spark.createDataFrame([("1", 30000)], "chrom string, end_bp bigint")
    assert rows(evaluate.mrca_segments(t, ends), "start_bp", "end_bp") == [(0, 6000), (6000, 30000)]
