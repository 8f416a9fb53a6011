"""Exact percentiles (linear interpolation) of any number of rows.

Spark's ``percentile`` holds all distinct values of a group in one task. Here values are counted
by partial aggregation and ranked over range partitions, so a group may have any size.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronograin.operators.joins import with_constants
from chronograin.operators.running import running_totals


def percentiles(
    df: DataFrame, col: str, fractions: Mapping[str, float], keys: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    """(keys.., name..): one column per named fraction; NULL values are ignored.

    Where ``weight`` names a column, a row stands for so many equal ones.
    """
    keys = list(keys)
    rows = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = df.where(F.col(col).isNotNull()).groupBy(*keys, F.col(col).alias("_v")).agg(rows.alias("_n"))
    ranked = running_totals(counts, keys, ["_v"], {"_upto": F.col("_n")})
    totals = ranked.groupBy(*keys).agg(F.max("_upto").alias("_all"))
    both = ranked.join(totals, keys) if keys else with_constants(ranked, totals)

    def value_at(index):
        inside = (F.col("_upto") - F.col("_n") <= index) & (index < F.col("_upto"))
        return F.max(F.when(inside, F.col("_v"))).cast("double")

    picked = []
    for name, fraction in fractions.items():
        at = (F.col("_all") - 1) * F.lit(fraction)
        picked += [
            value_at(F.floor(at)).alias(f"_lo_{name}"),
            value_at(F.ceil(at)).alias(f"_hi_{name}"),
            F.max(at - F.floor(at)).alias(f"_w_{name}"),
        ]
    found = both.groupBy(*keys).agg(*picked)
    mixed = [
        (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_w_{n}")).alias(n)
        for n in fractions
    ]
    return found.select(*keys, *mixed)
