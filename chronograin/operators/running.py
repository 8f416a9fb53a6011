"""Running totals and dense numbers over a total order, without a single-task window.

Rows are range partitioned by (keys, order), so a hot key is spread over many tasks. The ordered
rows are written once to the shared folder; partial totals per (partition, key) then give each
partition its offset. No window ever holds more than one range partition or one row per partition.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronograin.session import cut_lineage

# monotonically_increasing_id() keeps the partition number above this bit, the row number below
_ROW_BITS = 33
_AT = "_at"
_SALT = "_salt"


def _order_columns(order: Sequence[Column | str]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def _ordered(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], kept: Sequence[str] | None = None
) -> DataFrame:
    by = [*[F.col(k) for k in keys], *_order_columns(order)]
    # the salt splits rows that tie on everything, so that copies need not share a partition
    salted = df.withColumn(_SALT, F.monotonically_increasing_id())
    placed = salted.repartitionByRange(*by, F.col(_SALT)).sortWithinPartitions(*by, _SALT)
    slim = placed.drop(_SALT) if kept is None else placed.select(*kept)
    return cut_lineage(slim.withColumn(_AT, F.monotonically_increasing_id()))


def _partition() -> Column:
    return F.shiftright(_AT, _ROW_BITS)


def dense_row_ids(
    df: DataFrame, order: Sequence[Column | str], name: str, kept: Sequence[str] | None = None
) -> DataFrame:
    """Number rows 0 .. n-1 along ``order`` (which should be total, for stable numbers).

    Only the columns ``kept`` (by default all) are written and returned; the order may use others.
    """
    rows = _ordered(df, [], order, kept)
    sizes = rows.groupBy(_partition().alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    local = F.col(_AT).bitwiseAND((1 << _ROW_BITS) - 1)
    # one row per partition: its size is bounded by the number of shuffle partitions
    return (
        rows.withColumn("_p", _partition())
        .join(F.broadcast(starts), "_p")
        .withColumn(name, F.col("_start") + local)
        .drop("_p", "_start", _AT)
    )


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    totals: Mapping[str, Column],
) -> DataFrame:
    """Add inclusive running sums per key along ``order``.

    Rows that tie on the whole order get an arbitrary sequence, so ``order`` should be total.
    Keys must not be null.
    """
    keys = list(keys)
    rows = _ordered(df, keys, order).withColumn("_p", _partition())
    by = [*keys, "_p"]
    partial = rows.groupBy(*by).agg(*[F.sum(c).alias(f"_t_{n}") for n, c in totals.items()])
    before = (
        Window.partitionBy(*(keys or [F.lit(0)]))
        .orderBy("_p")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = partial.select(
        *by, *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in totals]
    )
    upto = Window.partitionBy(*by).orderBy(_AT).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.select("*", *[F.sum(c).over(upto).alias(f"_l_{n}") for n, c in totals.items()])
    return (
        local.join(offsets, by)
        .withColumns({n: F.col(f"_l_{n}") + F.col(f"_o_{n}") for n in totals})
        .drop("_p", _AT, *[f"_l_{n}" for n in totals], *[f"_o_{n}" for n in totals])
    )


def positions(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str
) -> DataFrame:
    """1-based position of each row among the rows of its key."""
    return running_totals(df, keys, order, {name: F.lit(1).cast("bigint")})
