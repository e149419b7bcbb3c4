"""Files written and read again."""

import gzip
import struct

import pytest
from engine_helpers import rows

from kinloom import streaming
from kinloom.operators import evaluate
from kinloom.sources import maps, segments, vcf

HEAD = ["##fileformat=VCFv4.2", "\t".join([*("#CHROM POS ID REF ALT QUAL FILTER INFO FORMAT".split()), "a", "b"])]
LINES = [
    "1\t100\t.\tA\tC\t.\tPASS\t.\tGT:DP\t0|1:3\t.|1:4",
    "1\t200\trs\tA\tC,G\t.\tPASS\t.\tGT\t2|0\t1|1",
    "too\tshort"]


@pytest.mark.parametrize("end", [".vcf", ".vcf.gz"])
def test_vcf(spark, tmp_path, end):
    path = str(tmp_path / f"x{end}")
    raw = "\n".join(HEAD + LINES) + "\n"
    (gzip.open(path, "wt") if end.endswith("gz") else open(path, "w")).write(raw)
    p = vcf.read_vcf(spark, path)
    assert rows(p.samples) == [(0, "a"), (1, "b")]
    assert rows(p.haplotypes, "site_id", "hap_id", "allele") == [(0, 0, 0), (0, 1, 1), (0, 2, 0), (0, 3, 1), (1, 0, 1), (1, 1, 0), (1, 2, 1), (1, 3, 1)]
    assert vcf.read_vcf(spark, path, biallelic_only=True).sites.count() == 1
    vcf.write_vcf(p, str(tmp_path / "out.vcf"))
    again = vcf.read_vcf(spark, str(tmp_path / "out.vcf"))
    assert rows(again.haplotypes) == rows(p.haplotypes)
    assert again.header == HEAD


def test_vcf_errors(spark, tmp_path):
    with pytest.raises(ValueError):
        vcf.read_vcf(spark, "x.txt")
    f = tmp_path / "none.vcf"
    f.write_text(HEAD[0] + "\n")
    with pytest.raises(ValueError):
        vcf.read_vcf(spark, str(f))
    f = tmp_path / "haploid.vcf"
    f.write_text("\n".join([*HEAD, "1\t1\t.\tA\tC\t.\t.\t.\tGT\t0\t1"]) + "\n")
    with pytest.raises(Exception, match="two alleles"):
        vcf.read_vcf(spark, str(f)).haplotypes.collect()
    assert vcf.smoothed_name("d/x.vcf.gz") == "x_smooth.vcf.gz"


def test_maps(spark, tmp_path):
    (tmp_path / "p").write_text("1 . 0.5 100\n\n1 . 1.5 200\n")
    (tmp_path / "h").write_text("chr1\t100\t2.0\t0.5\nchr1\t200\t2.0\t1.5\n")
    for name in "ph":
        assert rows(maps.read_map(spark, str(tmp_path / name))) == [("1", 100, 0.5), ("1", 200, 1.5)]
    (tmp_path / "bad").write_text("1 . x 100\n")
    with pytest.raises(Exception, match="malformed"):
        maps.read_map(spark, str(tmp_path / "bad")).collect()
    k = spark.createDataFrame([("1", 5, 0.0), ("1", 9, 2.5)], "chrom string, bp bigint, cm double")
    assert rows(maps.plink_lines(k)) == [("1 . 0 5",), ("1 . 2.5 9",)]


def test_segment_files(spark, tmp_path):
    s = spark.createDataFrame([("20", 1, 6, 0, 9, 100, 900, 2.5)], streaming.SEGMENTS)
    segments.write_tsv(segments.indexed_rows(s), str(tmp_path / "t"))
    assert rows(segments.read_tsv(spark, str(tmp_path / "t"), segments.INDEXED)) == [(0, 1, 3, 0, 100, 900, 2.5)]
    names = spark.createDataFrame([(i, f"tsk_{i}") for i in range(4)], "sample_idx bigint, sample_id string")
    named = segments.named_rows(s, names)
    assert rows(named) == [("tsk_0", 2, "tsk_3", 1, "20", 100, 900, "2.500000")]
    assert rows(segments.normalized(named), "id1", "id2") == [(1, 6)]
    (tmp_path / "b.bin").write_bytes(struct.pack("<6if", 1, 6, 0, 9, 100, 900, 2.5) * 2 + b"rest")
    assert rows(segments.read_binary(spark, str(tmp_path / "b.bin"))) == [(1, 6, 0, 9, 100, 900, 2.5)] * 2


def test_stream(spark, tmp_path):
    s = spark.createDataFrame([("20", 1, 6, 0, 9, 100, 900, 2.5), ("20", 0, 1, 0, 9, 100, 900, 2.5), ("20", 0, 6, 0, 9, 100, 900, 0.5)], streaming.SEGMENTS)
    s.write.parquet(str(tmp_path / "in"))
    q = streaming.reported_stream(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("seen"), "h1", "h2") == [(1, 6)]


def test_error_log(spark):
    loci = spark.createDataFrame([("1", 7, 3), ("1", 2, 2)], "chrom string, site_id bigint, hap_id bigint")
    names = spark.createDataFrame([(0, "a"), (1, "b")], "sample_idx bigint, sample_id string")
    assert rows(segments.error_lines(loci, names)) == [("a",), ("b\t2\t7",)]


def test_bucketed_tables_meet_without_a_shuffle(spark):
    kind = "chrom string, h1 bigint, h2 bigint, start_bp bigint, end_bp bigint"
    one = spark.createDataFrame([(c, i, i + 1, 100 * k, 100 * k + 80) for c in "12" for i in range(9) for k in range(4)], kind)
    two = spark.createDataFrame([("1", i, i + 1, 50, 290) for i in range(0, 9, 2)], kind)
    name = lambda s: s.selectExpr("chrom", "h1 id1", "h2 id2", "double(start_bp) start", "double(end_bp) end")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        a, b = (name(segments.save_bucketed(s, n, 5)) for s, n in ((one, "reported_b"), (two, "truth_b")))
        with segments.side_by_side(spark):
            for fn, x, y in ((evaluate.best_coverage, a, b), (evaluate.split_by_truth, a, b)):
                plan = fn(x, y)._jdf.queryExecution().executedPlan().toString()
                assert "Exchange" not in plan and "SortMergeJoin" in plan
            assert rows(evaluate.best_coverage(a, b)) == rows(evaluate.best_coverage(name(one), name(two)))
            for fn in (evaluate.power, evaluate.accumulative_power):
                found = fn(b, a)
                plan = found._jdf.queryExecution().executedPlan().toString()
                assert "Exchange hashpartitioning" not in plan
                assert rows(found) == rows(fn(name(two), name(one)))
        assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        for n in ("reported_b", "truth_b"):
            spark.sql(f"DROP TABLE IF EXISTS {n}")
