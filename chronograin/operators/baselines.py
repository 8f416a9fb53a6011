"""Predictions without a model: constants, entity history, popularity, chance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronograin.functions.draws import DRAW_BITS, draw
from chronograin.operators.joins import with_constants
from chronograin.operators.quantiles import percentiles

GLOBAL = ("global_zero", "global_mean", "global_median", "majority")
ENTITY = ("entity_mean", "entity_median")


def _one_row(rows: DataFrame, value: DataFrame) -> DataFrame:
    return with_constants(rows, value)


def majority_of(df: DataFrame, col: str) -> DataFrame:
    """One row with the most frequent value, the smallest on ties. Counts are partial aggregates."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
    return counts.agg(F.max_by(F.col(col), F.struct(F.col("_n"), -F.col(col))).alias("pred"))


def global_prediction(train: DataFrame, rows: DataFrame, target: str, how: str) -> DataFrame:
    """``rows`` with the same prediction each."""
    value = F.col(target).cast("double")
    if how == "global_zero":
        return rows.withColumn("pred", F.lit(0.0))
    if how == "global_mean":
        return _one_row(rows, train.agg(F.avg(value).alias("pred")))
    if how == "global_median":
        return _one_row(rows, percentiles(train.select(value.alias("_v0")), "_v0", {"pred": 0.5}))
    if how == "majority":
        counted = majority_of(train.select(F.col(target).cast("int").alias("_v0")), "_v0")
        return _one_row(rows, counted.select(F.col("pred").cast("double").alias("pred")))
    raise ValueError(f"unknown baseline {how}")


def entity_prediction(train: DataFrame, rows: DataFrame, entity: str, target: str, how: str) -> DataFrame:
    """Mean or median of an entity's earlier labels, 0 for new entities.

    An entity has one label per anchor, so its labels are few even if its facts are many.
    """
    value = F.col(target).cast("double")
    agg = {"entity_mean": F.avg(value), "entity_median": F.percentile(value, F.lit(0.5))}[how]
    past = train.groupBy(entity).agg(agg.alias("pred"))
    return rows.join(past, entity, "left").fillna(0.0, subset=["pred"])


def uniform(seed: int, *keys: str) -> Column:
    """A number in [0, 1) that only depends on the keys and the seed."""
    return draw(seed, *keys) / F.lit(float(1 << DRAW_BITS))


def random_prediction(rows: DataFrame, keys: list[str], seed: int) -> DataFrame:
    return rows.withColumn("pred", uniform(seed, *keys))


def majority_multilabel(train: DataFrame, rows: DataFrame, target: str) -> DataFrame:
    """Most frequent value at each list position, the smallest on ties."""
    at = train.select(F.posexplode(target).alias("place", "v"))
    counts = at.groupBy("place", "v").agg(F.count(F.lit(1)).alias("_n"))
    best = counts.groupBy("place").agg(F.max_by("v", F.struct("_n", -F.col("v"))).alias("v"))
    # one row per list position
    one = best.agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "v"))), lambda e: e["v"]).alias("pred"))
    return _one_row(rows, one)


def random_multilabel(rows: DataFrame, keys: list[str], width: int, seed: int) -> DataFrame:
    return rows.withColumn("pred", F.array(*[uniform(seed + i, *keys) for i in range(width)]))
