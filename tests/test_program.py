"""The command line from files to files, and the smaller helpers of the programs."""

import pytest
from engine_helpers import rows
from test_properties import mosaic

from kinloom import __main__ as program
from kinloom.functions import models
from kinloom.operators import features
from kinloom.plans import detect
from kinloom.queries import network, trees
from kinloom.sources import segments, vcf


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("files")
    h, _ = mosaic(6)
    names = [f"s{i}" for i in range(len(h) // 2)]
    lines = ["##fileformat=VCFv4.2", "\t".join([*"#CHROM POS ID REF ALT QUAL FILTER INFO FORMAT".split(), *names])]
    for j in range(h.shape[1]):
        gt = [f"{h[2 * i, j]}|{h[2 * i + 1, j]}" for i in range(len(names))]
        lines.append("\t".join(["1", str(100 + 100 * j), ".", "A", "C", ".", "PASS", ".", "GT", *gt]))
    (d / "p.vcf").write_text("\n".join(lines) + "\n")
    (d / "m.map").write_text("1 . 0.0 50\n1 . 12.0 16100\n")
    (d / "nn.bin").write_bytes(network().pack())
    return d


def test_program(spark, files):
    args = [str(files / "p.vcf"), str(files / "m.map"), "--min-seed=1", "--min-markers=10", "--min-output=1", "--max-gap=200", "--ps-length=5", "--ps-width=3", "--ps-rho=0.34",
            "--filter=N", f"--model-path={files / 'nn.bin'}", f"--output={files / 'kept'}", f"--segments={files / 'segs'}", "--unknown=1"]
    found = program.run(spark, program.options(args))
    n = found.segments.count()
    assert n > 0
    back = segments.read_tsv(spark, str(files / "segs"), segments.INDEXED)
    assert back.count() == n
    kept = segments.read_tsv(spark, str(files / "kept"), segments.NAMED)
    assert kept.count() <= n
    again = segments.with_indices(back, found.sites, "1")
    key = ("h1", "h2", "start_idx", "end_idx", "start_bp", "end_bp")
    assert rows(again, *key) == rows(found.segments, *key)
    r = detect.run_statistics(found, vcf.read_vcf(spark, str(files / "p.vcf")).samples).first()
    assert (r.samples, r.segments) == (6, n) and r.segments_per_sample == n / 6
    f = features.wide(features.chunked(found.segments, found.sites, found.mismatches, found.corrections))
    names = features.feature_names()
    both = models.both_predictions(f, features.scaled(f, names), list(features.KEY), names, trees(), network())
    assert both.count() == n and {r.nn_pred for r in both.collect()} <= {0, 1}


def test_options(files):
    o = program.options(["a.vcf", "b"])
    assert (o.min_output, o.filter, o.ps_width, o.output) == (2.0, "none", 20, "predicted_segments.txt")
    assert program.options(["a.vcf", "b", "--filter=X", "--model-path=m"]).filter == "x"
    for bad in (["a.vcf"], ["a.vcf", "b", "--filter=Q"], ["a.vcf", "b", "--filter=X"]):
        with pytest.raises(SystemExit):
            program.options(bad)


def test_model_files(spark, files):
    net = models.load_network(spark, str(files / "nn.bin"))
    assert [w.shape for w in net.weights] == [(36, 40), (18, 36), (9, 18), (3, 9), (1, 3)]
    with pytest.raises(Exception):
        models.load_trees(spark, str(files / "none.json"))
