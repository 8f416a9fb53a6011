"""Selections of n rows against sorting, and the guard on constants."""

import pytest
from pyspark.sql import functions as F

from chronograin.functions.draws import draw
from chronograin.operators import selection
from chronograin.operators.joins import with_constants


@pytest.mark.parametrize(("n", "last_rows", "pass_bits"), [(0, 10, 12), (1, 10, 3), (37, 10, 12), (37, 5, 2), (200, 50, 5), (999, 1, 4), (1000, 10, 12), (5000, 10, 12)])
def test_subsample_takes_the_smallest_draws(spark, monkeypatch, n, last_rows, pass_bits):
    monkeypatch.setattr(selection, "LAST_ROWS", last_rows)
    monkeypatch.setattr(selection, "PASS_BITS", pass_bits)
    df = spark.range(1000).select("id", (F.col("id") * 3).alias("v"))
    got = [tuple(r) for r in selection.subsample(df, ["id"], n, 7).collect()]
    want = [tuple(r) for r in df.orderBy(draw(7, "id"), "id").limit(n).collect()]
    assert sorted(got) == sorted(want)


def test_subsample_of_repeated_keys_and_missing_keys(spark, monkeypatch):
    monkeypatch.setattr(selection, "LAST_ROWS", 3)
    df = spark.createDataFrame([(1, "x")] * 40 + [(None, "y")] * 5 + [(i, "z") for i in range(50)], "id bigint, v string")
    for n in (1, 20, 44, 94, 95, 96):
        assert selection.subsample(df, ["id"], n, 1).count() == min(n, 95)
    assert selection.subsample(df.limit(0), ["id"], 4, 1).count() == 0


def test_no_task_sees_all_chosen_rows(spark):
    chosen = selection.subsample(spark.range(100_000), ["id"], 60_000, 3)
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan.split("Union")[0] and chosen.count() == 60_000
    limits = [line for line in plan.splitlines() if "TakeOrderedAndProject" in line]
    assert all(int(line.split("limit=")[1].split(",")[0]) < 1000 for line in limits)


def test_first_rows_along_an_order(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 500).alias("a"), F.col("id").alias("b"))
    got = selection.first_rows(df, ["a", "b"], 60)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.orderBy("a", "b").limit(60).collect()))


def test_constants_are_one_row(spark):
    df = spark.range(3)
    one = spark.createDataFrame([(5, None)], "x int, y string")
    assert sorted(map(tuple, with_constants(df, one).collect())) == [(i, 5, None) for i in range(3)]
    assert with_constants(df, one.limit(0)).count() == 0
    with pytest.raises(Exception, match="more than one row of constants"):
        with_constants(df, one.unionByName(one)).collect()
