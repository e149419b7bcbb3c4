"""Checkpoints of few rows have few files, and hold all rows."""

from kinloom.llm.common import connected_components, cut


def test_few_rows_go_into_few_files(spark):
    least = 2 * spark.sparkContext.defaultParallelism
    rows = spark.range(0, 1000, 1, 3 * least)
    few = cut(rows, 1000)
    assert few.rdd.getNumPartitions() == least
    assert few.count() == 1000 and few.distinct().count() == 1000
    assert cut(rows).rdd.getNumPartitions() == 3 * least
    assert cut(rows, 1000, 1).rdd.getNumPartitions() == 3 * least  # never more than there are
    assert cut(rows.where("id < 0"), 0).count() == 0


def test_a_wrong_count_of_edges_changes_no_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(50, 51), (50, 51)], "a bigint, b bigint")
    expected = {**dict.fromkeys(range(41), 0), 50: 50, 51: 50}
    for rows in (None, 0, 1, 10**9):
        assert {r["id"]: r["component"] for r in connected_components(edges, rows=rows).collect()} == expected
