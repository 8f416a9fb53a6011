"""Joins between label tables, entities and facts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronograin.model import Table


def with_constants(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a frame that holds a single row, such as a global aggregate.

    A second row is an error, not a second copy of every row of ``df``; without any row there is nothing to add to.
    """
    whole = one_row.agg(F.count(F.lit(1)).alias("_rows"), F.first(F.struct(*one_row.columns)).alias("_row"))
    too_many = F.raise_error(F.lit("more than one row of constants")).cast("boolean")
    single = F.when(F.col("_rows") <= 1, F.col("_rows") == 1).otherwise(too_many)
    return df.join(F.broadcast(whole.where(single).select("_row.*")))


def lookup(df: DataFrame, dim: DataFrame, on: str, dim_key: str, cols: Sequence[str]) -> DataFrame:
    """Add dimension attributes to every row; NULL where the key is unknown."""
    side = dim.select(F.col(dim_key).alias("_key"), *cols)
    return df.join(side, F.col(on) == F.col("_key"), "left").drop("_key")


def conditional_left(left: DataFrame, right: DataFrame, on: str, condition: Column) -> DataFrame:
    """Left join whose ON clause also tests the right side: filtered before the join."""
    return left.join(right.where(condition), on, "left")


def feature_join(labels: DataFrame, entity_col: str, entity: Table) -> DataFrame:
    """Every label row with the features of its entity."""
    cols = entity.feature_columns
    return lookup(labels, entity.df, entity_col, entity.pkey, cols)


def pair_feature_join(
    pairs: DataFrame, src_col: str, src: Table, dst_col: str, dst: Table
) -> DataFrame:
    """Every pair with the features of both ends; names in both get ``_x`` and ``_y``."""
    src_cols, dst_cols = src.feature_columns, dst.feature_columns
    both = set(src_cols) & set(dst_cols)
    left = src.df.select(F.col(src.pkey).alias("_s"), *[F.col(c).alias(f"{c}_x" if c in both else c) for c in src_cols])
    right = dst.df.select(F.col(dst.pkey).alias("_d"), *[F.col(c).alias(f"{c}_y" if c in both else c) for c in dst_cols])
    joined = pairs.join(left, F.col(src_col) == F.col("_s"), "left").drop("_s")
    return joined.join(right, F.col(dst_col) == F.col("_d"), "left").drop("_d")


def totals_upto(
    labels: DataFrame, entity_col: str, cutoff: str, facts: DataFrame, fact_entity: str, fact_time: str,
    sums: Mapping[str, Column] = {}, highest: Mapping[str, Column] = {},
) -> DataFrame:
    """(entity, cutoff, n, sums.., highest..) over an entity's facts with time <= cutoff, for each of its cut-offs.

    A fact counts towards the first cut-off of its entity that it precedes, by partial aggregation; running totals over the
    few cut-offs give the rest. So facts are never multiplied by the cut-offs that follow them. Cut-offs without
    a fact are left out.
    """
    keys = labels.select(F.col(entity_col).alias("_e"), F.col(cutoff).alias("_t")).distinct()
    # an entity has as many cut-offs as it has labels
    own = keys.groupBy("_e").agg(F.array_sort(F.collect_list("_t")).alias("_cuts"))
    met = facts.join(own, F.col(fact_entity) == F.col("_e"))
    first = F.get(F.filter("_cuts", lambda c: c >= F.col(fact_time)), F.lit(0))
    added = {"n": F.count(F.lit(1)), **{k: F.sum(c) for k, c in sums.items()}}
    tops = {k: F.max(c) for k, c in highest.items()}
    steps = (
        met.withColumn("_t", first)
        .where(F.col("_t").isNotNull())
        .groupBy("_e", "_t")
        .agg(*[c.alias(k) for k, c in (added | tops).items()])
    )
    upto = Window.partitionBy("_e").orderBy("_t").rowsBetween(Window.unboundedPreceding, 0)
    every = keys.join(steps, ["_e", "_t"], "left")
    out = every.select(
        F.col("_e").alias(entity_col), F.col("_t").alias(cutoff),
        *[F.sum(k).over(upto).alias(k) for k in added], *[F.max(k).over(upto).alias(k) for k in tops],
    )
    return out.where(F.col("n") > 0)


def facts_upto(
    labels: DataFrame, entity_col: str, cutoff: str, facts: DataFrame, fact_entity: str, fact_time: str
) -> DataFrame:
    """Facts of an entity with time <= cutoff, for each (entity, cutoff); inclusive.

    A fact meets the later cut-offs of its own entity only, which are as many as it has labels.
    """
    keys = labels.select(F.col(entity_col).alias("_e"), F.col(cutoff).alias("_t")).distinct()
    on = (F.col(fact_entity) == F.col("_e")) & (F.col(fact_time) <= F.col("_t"))
    return facts.join(keys, on).withColumnsRenamed({"_e": entity_col, "_t": cutoff}) if (
        fact_entity != entity_col
    ) else facts.join(keys, on).drop("_e").withColumnRenamed("_t", cutoff)
