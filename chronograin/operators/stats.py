"""Statistics of label tables per anchor, per split and in total, from one pass each."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronograin.model import TaskKind
from chronograin.operators.quantiles import percentiles

LEVELS = ("split", "timestamp")


def _levels(df: DataFrame) -> DataFrame:
    """Every row three times: for its anchor, its split, and the whole (NULL where rolled up)."""
    whole = F.array(
        F.struct(F.col("split").alias("s"), F.col("timestamp").alias("t")),
        F.struct(F.col("split").alias("s"), F.lit(None).cast("timestamp_ntz").alias("t")),
        F.struct(F.lit(None).cast("string").alias("s"), F.lit(None).cast("timestamp_ntz").alias("t")),
    )
    rest = [c for c in df.columns if c not in LEVELS]
    return df.select(*rest, F.explode(whole).alias("_l")).select(
        F.coalesce("_l.s", F.lit("total")).alias("split"), F.col("_l.t").alias("timestamp"), *rest
    )


def _rolled(df: DataFrame, aggs: Mapping[str, Column]) -> DataFrame:
    """Grouping sets (split, timestamp), (split), (): partial aggregation per level."""
    sets = [[F.col("split"), F.col("timestamp")], [F.col("split")], []]
    out = df.groupingSets(sets, "split", "timestamp").agg(*[c.alias(n) for n, c in aggs.items()])
    return out.withColumn("split", F.coalesce("split", F.lit("total")))


def entity_stats(labels: DataFrame, entity: str, target: str, kind: TaskKind) -> DataFrame:
    """(split, timestamp, ..): timestamp is NULL for the totals of a split and of all splits."""
    base = {"num_rows": F.count(F.lit(1)), "num_unique_entities": F.count_distinct(entity)}
    y = F.col(target)
    if kind is TaskKind.BINARY:
        one = y.cast("int")
        return _rolled(labels, base | {"num_positives": F.count_if(one == 1), "num_negatives": F.count_if(one == 0)})
    if kind is TaskKind.REGRESSION:
        simple = base | {"min_target": F.min(y), "max_target": F.max(y), "mean_target": F.avg(y)}
        # values are counted once per anchor; splits and the whole add up these counts, not the rows
        counted = labels.groupBy(*LEVELS, target).agg(F.count(F.lit(1)).alias("_rows"))
        levels = _levels(counted).withColumn("_key", F.coalesce(F.col("timestamp").cast("string"), F.lit("")))
        quartiles = percentiles(
            levels, target,
            {"quantile_25_target": 0.25, "median_target": 0.5, "quantile_75_target": 0.75}, ["split", "_key"], "_rows",
        )
        keyed = _rolled(labels, simple).withColumn("_key", F.coalesce(F.col("timestamp").cast("string"), F.lit("")))
        return keyed.join(quartiles, ["split", "_key"]).drop("_key")
    raise ValueError(f"no entity statistics for {kind}")


def multilabel_stats(labels: DataFrame, target: str) -> DataFrame:
    """Per level: classes per entity, and the most and least frequent class."""
    per_row = F.aggregate(target, F.lit(0).cast("bigint"), lambda a, x: a + x)
    rows = _rolled(
        labels.select(*LEVELS, per_row.alias("_n")),
        {
            "mean_num_classes_per_entity": F.round(F.avg("_n"), 4),
            "max_num_classes_per_entity": F.max("_n"),
            "min_num_classes_per_entity": F.min("_n"),
        },
    )
    by_class = (
        _levels(labels.select(*LEVELS, F.posexplode(target).alias("_class", "_v")))
        .groupBy(*LEVELS, "_class")
        .agg(F.sum("_v").alias("_n"))
    )
    first = -F.col("_class")
    best = by_class.groupBy(*LEVELS).agg(
        F.max_by("_class", F.struct(F.col("_n"), first)).alias("max_num_class_idx"),
        F.max("_n").alias("max_num_class_num"),
        F.max_by("_class", F.struct(-F.col("_n"), first)).alias("min_num_class_idx"),
        F.min("_n").alias("min_num_class_num"),
    )
    same = (F.col("r.split") == F.col("b.split")) & F.col("r.timestamp").eqNullSafe(F.col("b.timestamp"))
    return rows.alias("r").join(best.alias("b"), same).select("r.*", *[f"b.{c}" for c in best.columns if c not in LEVELS])


def link_stats(pairs: DataFrame, src: str, dst: str) -> DataFrame:
    """Per level, over distinct pairs: lists, distinct sources, distinct and all destinations."""
    per_list = pairs.groupBy(*LEVELS, src).agg(F.count(F.lit(1)).alias("_n"))
    lists = _rolled(
        per_list,
        {
            "num_rows": F.count(F.lit(1)),
            "num_unique_src_entities": F.count_distinct(src),
            "num_dst_entities": F.sum("_n"),
        },
    )
    ends = _rolled(pairs.select(*LEVELS, dst).distinct(), {"num_unique_dst_entities": F.count_distinct(dst)})
    same = (F.col("a.split") == F.col("b.split")) & F.col("a.timestamp").eqNullSafe(F.col("b.timestamp"))
    return lists.alias("a").join(ends.alias("b"), same).select("a.*", "b.num_unique_dst_entities")


def train_test_overlap(labels: DataFrame, entity: str) -> DataFrame:
    """One row: share of the test split's entities that also occur in training."""
    seen = labels.groupBy(entity).agg(
        F.max((F.col("split") == "train").cast("int")).alias("_train"),
        F.max((F.col("split") == "test").cast("int")).alias("_test"),
    )
    return seen.agg(
        F.try_divide(F.sum(F.col("_train") * F.col("_test")), F.sum("_test")).alias("ratio_train_test_entity_overlap")
    )
