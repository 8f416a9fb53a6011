"""Lists per key, in parts of bounded length.

A list that outgrows ``part_rows`` is continued in further rows (part 1, 2, ..), so a key that
holds a third of all rows never meets in one task. Nothing is dropped: the parts of a key,
in order, are its whole list.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronograin.operators.running import running_totals

PART_ROWS = 100_000


def hot_keys(rows: DataFrame, keys: Sequence[str], part_rows: int, weight: Column | None = None) -> DataFrame:
    """Keys whose list outgrows ``part_rows``."""
    size = F.sum(F.lit(1).cast("bigint") if weight is None else weight.cast("bigint"))
    sized = rows.dropna(subset=list(keys)).groupBy(*keys).agg(size.alias("_n"))
    return sized.where(F.col("_n") > part_rows).drop("_n")


def split_parts(
    rows: DataFrame,
    keys: Sequence[str],
    item: Column,
    order: Sequence[str],
    name: str,
    part_rows: int = PART_ROWS,
    weight: Column | None = None,
    continued: bool | None = None,
    near: Sequence[str] | None = None,
) -> tuple[DataFrame, DataFrame | None]:
    """First parts (keys.., name) and, only where a list is continued, the rest (keys.., part, name).

    Items are sorted along ``order``. Keys are weighed first, by partial aggregation. Only keys
    above ``part_rows`` take the range-partitioned path that numbers their rows; all others are
    grouped directly. ``weight`` is the size of an item (1 by default). ``continued`` tells
    whether any key exceeds ``part_rows`` where that is known already. ``near`` are the keys, if not
    all, by which lists that are not continued are dealt to tasks, so that those of an owner meet there.
    """
    keys = list(keys)
    weight = F.lit(1).cast("bigint") if weight is None else weight.cast("bigint")
    known = rows.dropna(subset=keys)
    by, entry = F.struct(*[F.col(c) for c in order]).alias("_by"), item.alias("_item")

    def grouped(df: DataFrame, at: Sequence[str], entry: Column, near: Sequence[str] | None = None) -> DataFrame:
        # lists do not shrink under partial aggregation, so rows are shuffled as they are, each column once
        return df.repartition(*(near or at)).groupBy(*at).agg(F.sort_array(F.collect_list(entry))["_item"].alias(name))

    if continued is None:
        continued = not hot_keys(rows, keys, part_rows, weight).isEmpty()
    if not continued:
        return grouped(known, keys, F.struct(by, entry), near), None
    hot = hot_keys(rows, keys, part_rows, weight)
    packed = known.select(*keys, by, entry, weight.alias("_w"))
    placed = running_totals(
        packed.join(hot, keys, "left_semi"), keys, ["_by", F.xxhash64("_item")], {"_upto": F.col("_w")}
    )
    part = F.floor((F.col("_upto") - F.col("_w")) / F.lit(part_rows))
    placed = placed.withColumn("part", part)
    pair = F.struct("_by", "_item")
    small = grouped(packed.join(hot, keys, "left_anti"), keys, pair)
    first = small.unionByName(grouped(placed.where(F.col("part") == 0), keys, pair))
    return first, grouped(placed.where(F.col("part") > 0), [*keys, "part"], pair)


def collect_parts(
    rows: DataFrame,
    keys: Sequence[str],
    item: Column,
    order: Sequence[str],
    name: str,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """(keys.., part, name): all parts of all lists, sorted within and across parts."""
    first, rest = split_parts(rows, keys, item, order, name, part_rows)
    out = first.select(*keys, F.lit(0).cast("bigint").alias("part"), name)
    return out if rest is None else out.unionByName(rest)


def pairs_to_lists(
    pairs: DataFrame, keys: Sequence[str], dst: str, part_rows: int = PART_ROWS
) -> DataFrame:
    """Distinct pairs to sorted lists (keys.., part, dst)."""
    return collect_parts(pairs, keys, F.col(dst), [dst], dst, part_rows)


def lists_to_pairs(df: DataFrame, dst: str) -> DataFrame:
    """One row per list item; rows with an empty or NULL list vanish."""
    return df.withColumn(dst, F.explode(dst))
