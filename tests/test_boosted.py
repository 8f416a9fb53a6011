"""Boosted trees for every kind of task, on targets that one feature decides."""

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from chronograin.model import TaskKind
from chronograin.plans import boosted

KINDS = {"x": "numerical", "s": "categorical"}


@pytest.fixture(scope="module")
def rows(spark):
    # few distinct values, so that every threshold is a bin of its own
    x = F.floor(F.col("id") / 10).cast("double")
    return spark.range(120).select(
        "id", F.when(F.col("id") % 40 != 7, x).alias("x"), F.lit("a").alias("s"), F.floor(F.col("id") / 40).cast("int").alias("y"),
        F.array((x < 4).cast("int"), (x >= 8).cast("int")).alias("flags"),
    ).cache()


def fitted(rows, target, kind):
    model, scores = boosted.fit_boosted(rows, rows, target, KINDS, kind, depths=(2,), rounds=3)
    known = boosted.predict(model, rows, KINDS).where(F.col("x").isNotNull())
    return known.select(target, "pred").collect(), scores


def test_classes_are_told_apart_and_add_up(rows):
    found, scores = fitted(rows, "y", TaskKind.MULTICLASS)
    assert all(len(r.pred) == 3 and sum(r.pred) == pytest.approx(1) for r in found)
    assert all(max(range(3), key=lambda c: r.pred[c]) == r.y for r in found)
    assert -1.1 < scores[2] < 0


def test_each_label_has_a_probability(rows):
    found, scores = fitted(rows, "flags", TaskKind.MULTILABEL)
    assert all([int(p > 0.5) for p in r.pred] == r.flags for r in found)
    assert scores[2] < 0


def test_pairs_and_empty_targets_are_errors(rows):
    with pytest.raises(ValueError, match="link_prediction"):
        fitted(rows, "y", TaskKind.LINK)
    with pytest.raises(ValueError, match="learn"):
        fitted(rows.where("id < 0"), "y", TaskKind.MULTICLASS)


def test_rows_to_learn_from_are_computed_once(spark):
    """Two fits of three rounds pass over their rows many times, but what leads to them runs once for each side."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    def counted(n):
        rows = spark.range(n).select(F.col("id").cast("double").alias("x"), F.lit("a").alias("s"), (F.col("id") % 3 == 0).cast("int").alias("y"))
        return rows.mapInArrow(count, rows.schema)

    boosted.fit_boosted(counted(60), counted(30), "y", KINDS, TaskKind.BINARY, depths=(1, 2), rounds=2)
    assert seen.value == 90


def test_all_rounds_are_run_and_the_validation_split_says_how_many_trees_stay(spark):
    """Trees that only learn the noise of the training rows are tried, but do not stay."""
    noisy = spark.range(200).select(
        (F.col("id") % 20).cast("double").alias("x"), F.lit("a").alias("s"), F.pmod(F.xxhash64("id"), F.lit(2)).cast("int").alias("y")
    )
    other = noisy.select("x", "s", (1 - F.col("y")).alias("y"))
    model, _ = boosted.fit_boosted(noisy, other, "y", KINDS, TaskKind.BINARY, depths=(3,), rounds=8)
    assert model.models[0].getNumTrees == 1
    model, _ = boosted.fit_boosted(noisy, noisy, "y", KINDS, TaskKind.BINARY, depths=(3,), rounds=8)
    assert model.models[0].getNumTrees == 8


def test_baseline_is_boosted_in_full(spark, small_dir, monkeypatch):
    """The query takes the depths and rounds of ``fit_boosted``, not fewer."""
    given = {}

    def noted(*rows, **rest):
        given.update(rest)
        raise InterruptedError

    monkeypatch.setattr(boosted, "fit_boosted", noted)
    with pytest.raises(InterruptedError):
        queries()["boosted_tree_baseline"](spark, small_dir)
    assert not given and boosted.ROUNDS >= 100
