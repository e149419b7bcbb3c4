"""Packed panels, block-gzipped files, and pairs and runs found on packed alleles."""

import gzip
import random

import numpy as np
import pytest
from engine_helpers import rows

from kinloom.operators import evaluate, panel, seeds, smooth
from kinloom.params import Smoothing
from kinloom.plans import detect
from kinloom.sources import bgzf, vcf


def mosaic(spark, n, m, seed, errors=0.02, founders=4, every=37):
    """A panel in long form, its array, and sites on a map that isn't quite monotone."""
    rng = np.random.default_rng(seed)
    f, h = rng.integers(0, 2, (founders, n)), np.zeros((m, n), int)
    for k in range(m):
        for b in range(0, n, every):
            h[k, b:b + every] = f[rng.integers(founders), b:b + every]
    h ^= rng.random((m, n)) < errors
    cm = np.cumsum(rng.random(n) * 0.2)
    cm[n // 2] -= 0.1
    haps = spark.createDataFrame([("1", j, k, int(h[k, j])) for k in range(m) for j in range(n)], "chrom string, site_id bigint, hap_id bigint, allele int")
    sites = spark.createDataFrame([("1", j, 100 * j, float(cm[j])) for j in range(n)], "chrom string, site_id bigint, bp bigint, cm double")
    return haps, h, sites, cm


def all_runs(h):
    for a in range(len(h)):
        for b in range(a + 1, len(h)):
            at = np.r_[-1, np.flatnonzero(h[a] != h[b]), h.shape[1]]
            for s, e in zip(at[:-1] + 1, at[1:] - 1):
                if e >= s:
                    yield a, b, int(s), int(e)


@pytest.mark.parametrize("n,m,least,markers,cm", [(157, 12, 7, 10, 0.0), (2500, 6, 61, 70, 0.0), (300, 12, 5, 11, 2.0), (121, 8, 60, 20, 3.0), (60, 6, 1, 5, 0.5)])
def test_pairs_and_runs(spark, n, m, least, markers, cm):
    haps, h, sites, at = mosaic(spark, n, m, n)
    words = seeds.packed(haps)
    runs = list(all_runs(h))
    got = seeds.long_runs(words, seeds.all_pairs(haps), sites, least)
    assert rows(got, "h1", "h2", "s", "e") == sorted(r for r in runs if r[3] - r[2] + 1 >= least)
    need = {r[:2] for r in runs if r[3] - r[2] + 1 >= markers and at[r[3]] - at[r[2]] >= cm}
    assert need <= set(rows(seeds.least_pairs(words, sites, markers, cm), "h1", "h2"))


def test_pairs_are_few(spark):
    """On founders without chance agreement, hardly more pairs are made than have a seed."""
    haps, h, sites, at = mosaic(spark, 900, 24, 5, errors=0.004, founders=12, every=60)
    found = set(rows(seeds.least_pairs(seeds.packed(haps), sites, 20, 3.0), "h1", "h2"))
    need = {r[:2] for r in all_runs(h) if r[3] - r[2] + 1 >= 20 and at[r[3]] - at[r[2]] >= 3.0}
    assert need <= found and len(found) <= 3 * len(need)


def test_packed_panel(spark):
    haps, h, sites, _ = mosaic(spark, 130, 70, 1)
    words = panel.site_words(haps)
    assert rows(panel.unpacked(words, 70)) == rows(haps)
    assert rows(panel.haplotype_words(words, 70)) == rows(seeds.packed(haps), "chrom", "hap_id", "block", "bits")
    assert rows(panel.packed_counts(words, 70)) == rows(panel.allele_counts(haps))
    assert rows(panel.packed_kept_sites(words, sites, 70, 20)) == rows(panel.kept_sites(haps, sites, 20))
    edits = spark.createDataFrame([("1", 3, 65), ("1", 3, 2), ("1", 129, 69), ("1", 3, 2)], "chrom string, site_id bigint, hap_id bigint")
    flipped = h.copy()
    for _, j, k in set(map(tuple, edits.collect())):
        flipped[k, j] ^= 1
    assert [r[3] for r in rows(panel.unpacked(panel.packed_flipped(words, edits), 70))] == flipped.T.ravel().tolist()


@pytest.mark.parametrize("n,length", [(200, 5), (131, 20), (90, 44), (8, 5)])
def test_packed_smoothing(spark, monkeypatch, n, length):
    haps, _, sites, _ = mosaic(spark, n, 16, length, errors=0.03, founders=2, every=90)
    p = Smoothing(length, 3, 1, 0.34)
    words = seeds.packed(haps).selectExpr("*", f"{n}L as n")
    want = rows(smooth.corrections(haps, p))
    assert rows(smooth.packed_corrections(words, p)) == want and (want or n < 50 or length > 40)
    monkeypatch.setattr(smooth, "FEW", -1)  # without a broadcast
    assert rows(smooth.packed_corrections(words, p)) == want


def genotype_lines(rng, names, n):
    odd = [lambda a, b: f"{a}|{b}", lambda a, b: f"{a}/{b}:12", lambda a, b: f"{10 if a else '.'}|{b}", lambda a, b: f"{a}|{b}:a|b"]
    out, h = [], []
    for j in range(n):
        g = [(rng.randint(0, 1), rng.randint(0, 1)) for _ in names]
        form = rng.choice(odd) if j % 2 else odd[0]
        out.append("\t".join(["1", str(100 * j), ".", "A", "C", ".", "PASS", ".", "GT", *(form(*x) for x in g)]))
        h.append([a for x in g for a in x])
    return ["##fileformat=VCFv4.2", "\t".join(["#CHROM POS ID REF ALT QUAL FILTER INFO FORMAT".replace(" ", "\t"), *names]), *out], h


def block_gzip(text: bytes, size: int) -> bytes:
    return b"".join(bgzf.block(text[i:i + size]) for i in range(0, len(text), size)) + bgzf.END


def test_block_gzip_is_read_by_many_tasks(spark, tmp_path):
    rng = random.Random(3)
    lines, h = genotype_lines(rng, [f"s{i}" for i in range(75)], 220)
    raw = ("\n".join(lines) + "\n").encode()
    (tmp_path / "a.vcf").write_bytes(raw)
    (tmp_path / "a.vcf.gz").write_bytes(blocks := block_gzip(raw, 700))
    assert gzip.decompress(blocks) == raw
    small = {"spark.sql.files.maxPartitionBytes": "8k", "spark.sql.files.openCostInBytes": "1"}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        files = [f"file:{tmp_path}/a.vcf.gz"]
        assert bgzf.is_block_gzip(spark, files) and not bgzf.is_block_gzip(spark, [f"file:{tmp_path}/a.vcf"])
        parts = bgzf.records(spark, files).rdd.glom().map(len).collect()
        assert sum(n > 1 for n in parts) >= 4
        one, two = vcf.read_vcf(spark, str(tmp_path / "a.vcf.gz")), vcf.read_vcf(spark, str(tmp_path / "a.vcf"))
        assert rows(one.haplotypes) == rows(two.haplotypes) == [("1", j, k, a) for j, own in enumerate(h) for k, a in enumerate(own)]
        assert one.header == two.header == lines[:2] and rows(one.sites) == rows(two.sites)
    finally:
        for k in small:
            spark.conf.unset(k)


@pytest.mark.parametrize("text", [b"", b"\n", b"a", b"a\nb", b"\n\na\n\n", b"x" * 5000 + b"\ny\n" + b"z" * 3000])
def test_lines_of_blocks(spark, tmp_path, text):
    (tmp_path / "x.gz").write_bytes(block_gzip(text, 100))
    got = bgzf.read_lines(spark, [f"file:{tmp_path}/x.gz"]).orderBy("file", "block", "nth").collect()
    assert [r.value for r in got] == text.decode().splitlines()


def test_damaged_blocks_raise(spark, tmp_path):
    raw = bytearray(block_gzip(b"abc\n" * 500, 300))
    raw[60] ^= 1
    (tmp_path / "x.gz").write_bytes(bytes(raw))
    with pytest.raises(Exception):
        bgzf.read_lines(spark, [f"file:{tmp_path}/x.gz"]).collect()
    with pytest.raises(ValueError):
        bgzf.inflated(b"\x05\x00")


def test_written_blocks(spark, tmp_path):
    rng = random.Random(4)
    lines = ["".join(rng.choice("ab01\t|") for _ in range(rng.randint(0, 4000))) for _ in range(200)] + ["é" * 70000]
    bgzf.write_lines(spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1), f"file:{tmp_path}/out.gz")
    (part,) = (tmp_path / "out.gz").glob("part*")
    assert gzip.decompress(part.read_bytes()).decode().splitlines() == lines
    assert part.read_bytes().endswith(bgzf.END)


def test_no_row_for_each_allele(spark, tmp_path):
    """A scan with a filter of minor alleles has rows for lines and numbers only."""
    rng = random.Random(5)
    lines, h = genotype_lines(rng, [f"s{i}" for i in range(60)], 40)
    (tmp_path / "a.vcf").write_text("\n".join(lines) + "\n")
    read = vcf.read_vcf(spark, str(tmp_path / "a.vcf"), min_mac=50)
    want = [own for own in h if min(sum(own), 120 - sum(own)) >= 50]
    assert read.words.count() == len(want) and [len(r.words) for r in read.words.collect()] == [2] * len(want)
    assert "Generate" not in read.words._jdf.queryExecution().optimizedPlan().toString()
    assert panel.haplotype_words(read.words, 120).count() == 120 * -(-len(want) // 60)


def test_detection_on_packed_alleles(spark, tmp_path):
    from kinloom.queries import P
    from kinloom.sources import maps

    haps, h, sites, _ = mosaic(spark, 400, 24, 9, errors=0.01, founders=3, every=150)
    head = ["\t".join([*("#CHROM POS ID REF ALT QUAL FILTER INFO FORMAT".split()), *(f"s{i}" for i in range(12))])]
    lines = ["\t".join(["1", str(100 * j), ".", "A", "C", ".", ".", ".", "GT", *(f"{h[2 * i, j]}|{h[2 * i + 1, j]}" for i in range(12))]) for j in range(400)]
    (tmp_path / "a.vcf").write_text("\n".join(head + lines) + "\n")
    (tmp_path / "m").write_text("1 . 0.0 0\n1 . 20.0 40000\n")
    knots = maps.read_map(spark, str(tmp_path / "m"))
    read = vcf.read_vcf(spark, str(tmp_path / "a.vcf"))
    for s in (Smoothing(5, 3, 1, 0.34), Smoothing(5, 3, 2, 0.34), None):
        one, two = detect.detect_panel(read, knots, P, s), detect.detect(read.haplotypes, read.sites, knots, P, s, by_candidates=False)
        assert rows(one.segments) == rows(two.segments) and one.segments.count() > 0
        assert rows(one.corrections) == rows(two.corrections) and rows(one.haplotypes) == rows(two.haplotypes)


def test_overlaps_stay_in_their_chromosome(spark):
    kind = "chrom string, id1 int, id2 int, start double, end double"
    q = spark.createDataFrame([("1", 0, 1, 0.0, 100.0), ("2", 0, 1, 0.0, 100.0), ("1", 0, 1, 5.0, 5.0), ("1", 0, 1, 1e6, 4e6)], kind)
    o = spark.createDataFrame([("1", 0, 1, 50.0, 150.0), ("1", 0, 1, 9e5, 3e6), ("1", 0, 1, 3.5e6, 3.7e6)], kind)
    assert rows(evaluate.best_coverage(q, o), "chrom", "start", "cov") == sorted([("1", 0.0, 0.5), ("2", 0.0, 0.0), ("1", 5.0, None), ("1", 1e6, 2 / 3)])
    assert rows(evaluate.power(q.where("end > 1e6"), o))[0][0] == pytest.approx((2e6 + 2e5) / 3e6)


def test_thinned_trees(spark):
    rng = random.Random(8)
    for apart in (1, 50, 5000):
        lefts = sorted({rng.randint(0, 40_000) for _ in range(300)})
        used, at = [lefts[0]], 0
        for x in lefts[1:]:
            if x - at >= apart:
                used.append(x)
                at = x
        trees = spark.createDataFrame([(c, x) for c in ("1", "2") for x in lefts for _ in range(2)], "chrom string, tree_left bigint")
        assert rows(evaluate.thinned_trees(trees, apart)) == [(c, x) for c in ("1", "2") for x in used]
    assert evaluate.thinned_trees(trees.limit(0)).collect() == []
