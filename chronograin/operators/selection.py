"""The first n rows along a random or given order, without bringing n rows to one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronograin.functions.draws import DRAW_BITS, draw
from chronograin.operators.running import dense_row_ids

# leading bits that one counting pass tells apart, and rows that may be sorted in one task at the end
PASS_BITS = 12
LAST_ROWS = 10_000

_DRAW = "_draw"


def subsample(df: DataFrame, keys: Sequence[str], n: int, seed: int) -> DataFrame:
    """``n`` rows picked by a draw of their key, ties by the key: the same rows on every run.

    Draws are counted by their leading bits; all rows below the bucket that holds the n-th draw are taken as they
    are, and the bucket is counted by its next bits, until few rows are left to choose from. A pass sends at
    most 2 ** PASS_BITS counts to the driver. Rows with equal keys share their draw, so they are told apart at the end.
    """
    drawn = df.withColumn(_DRAW, draw(seed, *keys))
    low, bits, wanted = 0, DRAW_BITS, n
    while wanted > 0:
        step = min(PASS_BITS, bits)
        bits -= step
        inside = drawn.where((F.col(_DRAW) >= low) & (F.col(_DRAW) < low + (1 << (bits + step)))).select(_DRAW)
        bucket = F.shiftright(F.col(_DRAW) - F.lit(low), bits).alias("b")
        counts = sorted((r["b"], r["n"]) for r in inside.groupBy(bucket).agg(F.count(F.lit(1)).alias("n")).collect())
        cut = None
        for b, rows in counts:
            if rows >= wanted:
                cut = b, rows
                break
            wanted -= rows
        if cut is None:
            # fewer rows than asked for
            return df
        low += cut[0] << bits
        if cut[1] == wanted:
            return drawn.where(F.col(_DRAW) < low + (1 << bits)).drop(_DRAW)
        if cut[1] <= LAST_ROWS or not bits:
            break
    if wanted <= 0:
        return df.limit(0)
    last = drawn.where((F.col(_DRAW) >= low) & (F.col(_DRAW) < low + (1 << bits)))
    taken = last.orderBy(_DRAW, *keys).limit(wanted)
    return drawn.where(F.col(_DRAW) < low).unionByName(taken).drop(_DRAW)


def first_rows(df: DataFrame, order: Sequence[Column | str], n: int) -> DataFrame:
    """The first ``n`` rows along ``order``, numbered over range partitions."""
    return dense_row_ids(df, order, "_nr").where(F.col("_nr") < n).drop("_nr")
