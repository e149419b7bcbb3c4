"""Counts that a run takes off its writes, in all modes of the command line."""

import pytest
from engine_helpers import rows
from test_program import files  # noqa: F401

from kinloom import __main__ as program
from kinloom.plans import detect
from kinloom.queries import network
from kinloom.sources import segments, vcf

SMALL = ["--min-seed=1", "--min-markers=10", "--min-output=1", "--max-gap=200", "--ps-length=5", "--ps-width=3", "--ps-rho=0.34"]


@pytest.mark.parametrize("more", [[], ["--no-psmoother"], ["--filter=n"]])
def test_counts_of_a_run(spark, files, tmp_path, more):  # noqa: F811
    (tmp_path / "nn.bin").write_bytes(network().pack())
    args = [str(files / "p.vcf"), str(files / "m.map"), *SMALL, *more, f"--model-path={tmp_path / 'nn.bin'}", f"--output={tmp_path / 'kept'}", f"--segments={tmp_path / 'segs'}"]
    found = program.run(spark, program.options(args))
    want = detect.run_statistics(found, vcf.read_vcf(spark, str(files / "p.vcf")).samples).first().asDict()
    assert {k: found.statistics[k] for k in want} == want and want["segments"] > 0
    assert segments.read_tsv(spark, str(tmp_path / "segs"), segments.INDEXED).count() == want["segments"]
    if "--filter=n" in more:
        n = segments.read_tsv(spark, str(tmp_path / "kept"), segments.NAMED).count()
        assert (found.statistics["processed"], found.statistics["kept"], found.statistics["filtered"]) == (want["segments"], n, want["segments"] - n)
    if "--no-psmoother" in more:
        assert rows(found.corrections) == []


def test_without_segments():
    assert detect.counted(0, 5, 0)["segments_per_sample"] == 0.0
    assert detect.passed(0, 0)["kept_percent"] != detect.passed(0, 0)["kept_percent"]
