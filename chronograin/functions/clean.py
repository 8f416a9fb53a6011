"""Cleaning of raw columns. Everything is built-in and tolerant: bad input becomes NULL."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronograin.model import Table
from chronograin.operators.joins import with_constants
from chronograin.operators.quantiles import percentiles

# Marker of a missing value in the raw racing files, and the time that replaces it
MISSING_MARK = r"\N"
MISSING_TIME = "00:00:00"
# Fixed value: a price starts with a dollar sign and ends at the first blank
PRICE = r"^\$([0-9,]*\.?[0-9]*)(?: |$)"
# Fixed value: time format of exported documents
DOCUMENT_TIME = "yyyy-MM-dd HH:mm:ss"

# Formats tried in turn by ``parse_time``; zone marks are read and then dropped
MIXED_FORMATS = (
    "yyyy-MM-dd['T'][ ]HH:mm:ss[.SSSSSS][.SSS][XXX][X]",
    "yyyy-MM-dd",
    "MM/dd/yyyy[ HH:mm[:ss]]",
)


def parse_time(col: Column, formats: Sequence[str] = MIXED_FORMATS) -> Column:
    """First format that fits, as a zone-free timestamp; NULL if none does."""
    return F.coalesce(*[F.try_to_timestamp(col, F.lit(f)) for f in formats]).cast("timestamp_ntz")


def clean_time(df: DataFrame, col: str, formats: Sequence[str] = MIXED_FORMATS) -> DataFrame:
    """Parse ``col`` and drop the rows where that fails."""
    return df.withColumn(col, parse_time(F.col(col), formats)).where(F.col(col).isNotNull())


def unparsed_share(df: DataFrame, col: str, formats: Sequence[str] = MIXED_FORMATS) -> DataFrame:
    """One row: rows, rows that ``clean_time`` drops, and their percentage."""
    bad = F.count_if(parse_time(F.col(col), formats).isNull())
    return df.agg(F.count(F.lit(1)).alias("n_rows"), bad.alias("n_dropped")).withColumn(
        "percent_dropped", F.try_divide(F.col("n_dropped") * 100.0, F.col("n_rows"))
    )


def from_unix_seconds(col: Column) -> Column:
    return F.timestamp_seconds(col).cast("timestamp_ntz")


def to_unix_seconds(col: Column) -> Column:
    return F.unix_seconds(col.cast("timestamp"))


def join_date_time(date: Column, time: Column) -> Column:
    """``date`` and ``time`` text as one timestamp; a missing time means midnight, a bad one gives NULL."""
    filled = F.when(time == MISSING_MARK, MISSING_TIME).otherwise(time)
    return F.try_to_timestamp(F.concat_ws(" ", date, filled), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")


def marks_to_null(df: DataFrame, mark: str = MISSING_MARK) -> DataFrame:
    """NULL for the marker in every text column."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.nullif(F.col(c), F.lit(mark)) for c in text})


def nan_to_null(df: DataFrame) -> DataFrame:
    """NULL is the only missing value downstream."""
    real = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in real})


def to_number(col: Column) -> Column:
    return col.try_cast("double")


def to_numbers(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    return df.withColumns({c: to_number(F.col(c)) for c in cols})


def parse_price(col: Column) -> Column:
    """First amount of ``$1,234.56`` or ``$1,234.56 - $2,000.00``; NULL for anything else."""
    amount = F.regexp_replace(F.regexp_extract(col, PRICE, 1), ",", "")
    return F.nullif(amount, F.lit("")).try_cast("double")


def empty_to_null(col: Column) -> Column:
    return F.when(F.size(col) > 0, col)


def first_or_null(col: Column) -> Column:
    return F.try_element_at(col, F.lit(1))


def split_numbers(col: Column) -> Column:
    """Blank-separated numbers as an array; NULL stays NULL."""
    return F.transform(F.split(F.trim(col), r"\s+"), lambda x: x.try_cast("bigint"))


def shift_time(col: Column, by: timedelta) -> Column:
    return col + F.lit(by)


def cast_keys(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).try_cast("bigint") for c in cols if c in df.columns})


def columns_to_array(df: DataFrame, cols: Sequence[str], name: str) -> DataFrame:
    """The present ones of ``cols`` as one array column, in order."""
    present = [c for c in cols if c in df.columns]
    return df.withColumn(name, F.array(*present)).drop(*present)


def numbered(prefix: str, last: int) -> list[str]:
    return [f"{prefix}{i}" for i in range(1, last + 1)]


def json_safe(df: DataFrame) -> DataFrame:
    """Timestamps as text and NaN as NULL, on top level columns and inside structs and arrays."""

    def safe(col: Column, kind: T.DataType) -> Column:
        if isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
            return F.date_format(col, DOCUMENT_TIME)
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return F.when(~F.isnan(col), col)
        if isinstance(kind, T.StructType):
            inner = F.struct(*[safe(col[f.name], f.dataType).alias(f.name) for f in kind.fields])
            return F.when(col.isNotNull(), inner)
        if isinstance(kind, T.ArrayType) and _needs_care(kind.elementType):
            return F.transform(col, lambda x: safe(x, kind.elementType))
        return col

    return df.select(*[safe(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def _needs_care(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_needs_care(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _needs_care(kind.elementType)
    return isinstance(kind, (T.TimestampNTZType, T.TimestampType, T.DoubleType, T.FloatType))


def input_columns(table: Table) -> DataFrame:
    """Time and key columns only: what a masked label table shows."""
    keep = [c for c in (table.time_col, *table.fkeys) if c is not None]
    return table.df.select(*keep)


def features(table: Table) -> DataFrame:
    """Feature columns; a constant where a table has none."""
    cols = [c for c in table.feature_columns if c != table.time_col]
    return table.df.select(*cols) if cols else table.df.select(F.lit(1.0).alias("const"))


def age_days(seed: Column, row: Column) -> Column:
    """Days from a row's time to the seed time."""
    return (to_unix_seconds(seed) - to_unix_seconds(row)) / F.lit(86_400)


def clamp_to_percentiles(
    df: DataFrame, col: str, reference: DataFrame, reference_col: str, low: float = 0.02, high: float = 0.98
) -> DataFrame:
    """Clip ``col`` to two exact percentiles of ``reference_col``; the bounds are a single row."""
    bounds = percentiles(reference, reference_col, {"_low": low, "_high": high})
    clipped = F.least(F.greatest(F.col(col), F.col("_low")), F.col("_high"))
    return with_constants(df, bounds).withColumn(col, clipped).drop("_low", "_high")


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))
