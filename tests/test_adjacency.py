"""Stored adjacency against plain filtering."""

import random

import pytest

from chronograin.operators import adjacency
from chronograin.session import work_path


@pytest.mark.parametrize(("row_edges", "bits"), [(1 << 16, 10), (5, 2), (1, 0), (64, 3)])
def test_neighbors_of_sources_and_of_ranges(spark, row_edges, bits):
    rng = random.Random(row_edges)
    edges = [(rng.choice([-7, 0, 3, 3, 3, rng.randrange(-50, 200), 1 << 60]), rng.choice([rng.randrange(-9, 99), -(1 << 63), (1 << 63) - 1])) for _ in range(400)]
    frame = spark.createDataFrame([*edges, (None, 1), (1, None)], "a bigint, b bigint").repartition(5)
    path = work_path(spark, "adjacency")
    adjacency.write_adjacency(frame, path, row_edges, bits)
    rows = adjacency.stored_rows(spark, path).collect()
    assert all(len(r.gaps) // r.width <= row_edges and {s >> bits for s in r.srcs} == {r.block} for r in rows)
    asked = [3, 3, None, 55, 1 << 60, -7, 999]
    got = adjacency.neighbors(spark, path, spark.createDataFrame([(a,) for a in asked], "x bigint"), bits)
    assert sorted(map(tuple, got.collect())) == sorted(e for e in edges if e[0] in asked)
    for low, high in ((-7, 3), (0, 0), (5, 4), (-100, 1 << 61)):
        got = adjacency.neighbors_between(spark, path, low, high, bits)
        assert sorted(map(tuple, got.collect())) == sorted(e for e in edges if low <= e[0] <= high)


def test_ranges_reach_the_scan_and_gaps_are_small(spark):
    frame = spark.range(200_000).selectExpr("id DIV 20 AS a", "1000000000000 + id % 20 * 3 AS b")
    path = work_path(spark, "adjacency")
    adjacency.write_adjacency(frame, path)
    plan = adjacency.neighbors_between(spark, path, 10, 40)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(block" in plan
    assert {r.width for r in adjacency.stored_rows(spark, path).collect()} == {1}
    assert adjacency.neighbors_between(spark, path, 10, 40).count() == 31 * 20


def test_no_edges(spark):
    path = work_path(spark, "adjacency")
    adjacency.write_adjacency(spark.createDataFrame([], "a bigint, b bigint"), path)
    assert adjacency.neighbors(spark, path, spark.range(3)).count() == 0
