"""Records of segments in files: ranges, commits and aborts."""

import struct

import pytest
from engine_helpers import rows
from pyspark.sql import functions as F

from kinloom.sources import records, segments


def some(spark, n, parts=3):
    return spark.range(n).repartition(parts).selectExpr("id h1", "id + 1 h2", "0L start_idx", "9L end_idx", "100L start_bp", "900 + id end_bp", "cast(id as double) / 4 length_cm")


def test_a_file_of_several_tasks(spark, tmp_path):
    raw = b"".join(struct.pack("<6if", i, i + 1, 0, 9, 100, 900 + i, i / 4) for i in range(1000))
    (tmp_path / "a.bin").write_bytes(raw + b"a rest")
    (tmp_path / ".hidden").write_bytes(raw)
    for path in (tmp_path / "a.bin", tmp_path):
        back = segments.read_binary(spark, f"file:{path}", records=300, batch=70)
        assert back.rdd.glom().map(len).collect() == [300, 300, 300, 100]
        assert rows(back) == rows(some(spark, 1000))
    assert segments.read_binary(spark, str(tmp_path / "a.bin")).where("h1 = 999").count() == 1


def test_parts_are_replaced_or_added(spark, tmp_path):
    path = f"file:{tmp_path}/out"
    assert segments.write_binary(some(spark, 50), path) == 50
    assert segments.write_binary(some(spark, 20, 2), path) == 20
    assert rows(segments.read_binary(spark, path)) == rows(some(spark, 20))
    records.write(some(spark, 5), path, mode="append")
    assert segments.read_binary(spark, path).count() == 25
    assert sorted(p.suffix for p in (tmp_path / "out").iterdir()) == [".bin"] * len(list((tmp_path / "out").iterdir()))
    assert segments.write_binary(some(spark, 0), path) == 0 and segments.read_binary(spark, path).count() == 0


def test_a_failed_task_leaves_no_part(spark, tmp_path):
    path = f"file:{tmp_path}/out"
    segments.write_binary(some(spark, 10), path)
    before = sorted(p.name for p in (tmp_path / "out").iterdir())
    bad = some(spark, 100, 4).withColumn("h1", F.when(F.col("h1") == 57, F.raise_error(F.lit("bad row")).cast("bigint")).otherwise(F.col("h1")))
    with pytest.raises(Exception):
        records.write(bad, path)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == before
    assert rows(segments.read_binary(spark, path)) == rows(some(spark, 10))


def test_missing_and_shortened_files(spark, tmp_path):
    with pytest.raises(Exception):
        segments.read_binary(spark, f"file:{tmp_path}/none").collect()
    (tmp_path / "a.bin").write_bytes(struct.pack("<6if", *range(6), 1.0) * 3)
    part = records.SegmentReader(str(tmp_path / "a.bin"), 10, 2).partitions()[0]
    (tmp_path / "a.bin").write_bytes(b"")
    with pytest.raises(EOFError):
        list(records.SegmentReader(str(tmp_path / "a.bin"), 10, 2).read(part))
