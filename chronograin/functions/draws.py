"""Random numbers from keys: the same on every run, engine and partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# a draw is a whole number below 2 ** DRAW_BITS, which a double holds exactly
DRAW_BITS = 52


def draw(seed: int, *keys: Column | str) -> Column:
    """The first 13 hex digits of the md5 of the keys and the seed, as a number; NULL keys are skipped."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    text = F.concat_ws("|", *[c.cast("string") for c in cols], F.lit(str(seed)))
    return F.conv(F.left(F.md5(text.cast("binary")), F.lit(DRAW_BITS // 4)), 16, 10).cast("bigint")


def draw_sql(seed: int, *keys: str) -> str:
    """The same number in the dialect of the SQL twins."""
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(keys)}, '{seed}')), 1, {DRAW_BITS // 4}))::BIGINT"
