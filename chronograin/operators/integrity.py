"""Keys: uniqueness, dense renumbering, dangling references."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronograin.model import Database, Table
from chronograin.operators.running import dense_row_ids


def duplicate_keys(df: DataFrame, pkey: str) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(pkey).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def check_unique(name: str, table: Table) -> None:
    if table.pkey is not None and not duplicate_keys(table.df, table.pkey).isEmpty():
        raise RuntimeError(f"the primary key {table.pkey} of {name} has duplicates")


def dense_key_summary(df: DataFrame, pkey: str) -> DataFrame:
    """One row: row count, smallest and largest key, distinct keys, and whether keys are 0 .. n-1."""
    n = F.count(F.lit(1))
    lo, hi, distinct = F.min(pkey), F.max(pkey), F.count_distinct(pkey)
    return df.agg(
        n.alias("n_rows"), lo.alias("min_key"), hi.alias("max_key"), distinct.alias("n_keys")
    ).withColumn(
        "is_dense",
        (F.col("n_rows") == 0)
        | (
            (F.col("min_key") == 0)
            & (F.col("max_key") == F.col("n_rows") - 1)
            & (F.col("n_keys") == F.col("n_rows"))
        ),
    )


def check_dense(name: str, table: Table) -> None:
    if table.pkey is not None and not dense_key_summary(table.df, table.pkey).first()["is_dense"]:
        raise RuntimeError(f"the primary key {table.pkey} of {name} is not numbered 0 .. n-1")


def null_dangling(df: DataFrame, fkey: str, keys: DataFrame, pkey: str) -> DataFrame:
    """Set a foreign key to NULL where the referenced row is missing; keep every row."""
    known = keys.select(F.col(pkey).alias("_known"))
    return (
        df.join(known, F.col(fkey) == F.col("_known"), "left")
        .withColumn(fkey, F.col("_known").cast(df.schema[fkey].dataType))
        .drop("_known")
        .select(*df.columns)
    )


def null_dangling_fkeys(db: Database) -> Database:
    """Repair every foreign key against its (already truncated) table.

    A table without time loses no rows when it is truncated, but its keys are checked all the
    same: raw data may hold references that never had a row.
    """

    def repaired(table: Table) -> Table:
        df = table.df
        for fkey, target in table.fkeys.items():
            df = null_dangling(df, fkey, db[target].df, db[target].pkey)
        return table.with_df(df)

    return db.map(repaired)


def keep_known(df: DataFrame, col: str, ids: DataFrame) -> DataFrame:
    """Rows whose ``col`` occurs in the one-column frame ``ids``."""
    known = ids.toDF("_known")
    return df.join(known, F.col(col) == F.col("_known"), "left_semi")


def filter_list(df: DataFrame, col: str, ids: DataFrame, row_keys: list[str]) -> DataFrame:
    """Drop list items that are not in ``ids``, and rows whose list becomes empty.

    Lists are taken apart, filtered by a semi-join and put together again, so that the known
    ids need not fit anywhere.
    """
    items = df.select(*row_keys, F.explode(col).alias(col))
    kept = keep_known(items, col, ids)
    lists = kept.groupBy(*row_keys).agg(F.sort_array(F.collect_list(col)).alias(col))
    return df.drop(col).join(lists, row_keys).select(*df.columns)


def _key_order(table: Table) -> list[Column]:
    """Time order, rows without time last, ties by key."""
    by_key = [F.col(table.pkey)]
    return by_key if table.time_col is None else [F.col(table.time_col).asc_nulls_last(), *by_key]


def key_numbers(table: Table) -> DataFrame:
    """Old key -> dense number in time order."""
    kept = [table.pkey] if table.time_col is None else [table.pkey, table.time_col]
    numbered = dense_row_ids(table.df.select(*kept), _key_order(table), "_number")
    return numbered.select(F.col(table.pkey).alias("_key"), "_number")


def reindex(db: Database) -> Database:
    """Replace keys by dense numbers in time order; references without a row become NULL."""
    for name, table in db.tables.items():
        check_unique(name, table)
    numbers = {name: key_numbers(t) for name, t in db.tables.items() if t.pkey is not None}

    def mapped(df: DataFrame, col: str, target: str, how: str) -> DataFrame:
        return (
            df.join(numbers[target], F.col(col) == F.col("_key"), how)
            .withColumn(col, F.col("_number"))
            .drop("_key", "_number")
        )

    out = {}
    for name, table in db.tables.items():
        df = table.df
        if table.pkey is not None:
            df = mapped(df, table.pkey, name, "inner")
        for fkey, target in table.fkeys.items():
            df = mapped(df, fkey, target, "left")
        out[name] = replace(table, df=df.select(*table.df.columns))
    return Database(out)


def surrogate_ids(df: DataFrame, value: str, name: str, order: str) -> tuple[DataFrame, DataFrame]:
    """Number distinct values by first appearance along ``order``.

    Returns the rows with their number, and the (number, value) table.
    """
    first = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.min(order).alias("_first"))
    ids = dense_row_ids(first, ["_first", value], name).select(name, value)
    return df.join(ids, value, "left"), ids


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the smallest along ``order``. Partial aggregation, no window."""
    rest = [c for c in df.columns if c not in keys]
    picked = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(picked).select(*keys, "_row.*").select(*df.columns)
