"""Kinds of columns (numerical, categorical, ..) and their statistics for encoders."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronograin.model import Database, Table
from chronograin.operators.links import top_k
from chronograin.operators.running import running_totals
from chronograin.operators.windows import union_all

NUMERICAL, CATEGORICAL, MULTI, TEXT, TIME = (
    "numerical", "categorical", "multicategorical", "text_embedded", "timestamp",
)

# few distinct values make a category, longer strings with many distinct values a text
MAX_CATEGORY_SHARE = 0.2
MAX_NUMERIC_CATEGORIES = 10


def column_kinds(df: DataFrame) -> DataFrame:
    """(column_name, kind), from the types and from the values of the whole table.

    Values are counted in one pass: each row gives a hash of its value for each column of texts or whole numbers, which are
    aggregated by (column, value) and then by column. Arrays count as multicategorical; columns of other types
    are left out.
    """
    by_type: dict[str, str] = {}
    counted: dict[str, bool] = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            by_type[f.name] = TIME
        elif isinstance(f.dataType, T.BooleanType):
            by_type[f.name] = CATEGORICAL
        elif isinstance(f.dataType, T.ArrayType):
            by_type[f.name] = MULTI
        elif isinstance(f.dataType, T.FractionalType):
            by_type[f.name] = NUMERICAL
        elif isinstance(f.dataType, (T.StringType, T.IntegralType)):
            counted[f.name] = isinstance(f.dataType, T.StringType)
    spark, schema = df.sparkSession, "column_name string, kind string"
    typed = spark.createDataFrame(list(by_type.items()), schema)
    if not counted:
        return typed
    one = [
        F.struct(
            F.lit(c).alias("column_name"), F.lit(text).alias("text"),
            F.when(F.col(c).isNotNull(), F.xxhash64(F.col(c))).alias("value"),
        )
        for c, text in counted.items()
    ]
    values = df.select(F.inline(F.array(*one))).where(F.col("value").isNotNull())
    per_value = values.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    seen = per_value.groupBy("column_name").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("distinct"))
    every = spark.createDataFrame(list(counted.items()), "column_name string, text boolean")
    sized = every.join(F.broadcast(seen), "column_name", "left").fillna(0, ["n", "distinct"])
    of_text = F.when(F.col("distinct") <= F.greatest("n", F.lit(1)) * MAX_CATEGORY_SHARE, CATEGORICAL).otherwise(TEXT)
    few = (F.col("distinct") > 0) & (F.col("distinct") <= MAX_NUMERIC_CATEGORIES)
    kind = F.when(F.col("text"), of_text).otherwise(F.when(few, CATEGORICAL).otherwise(NUMERICAL))
    return typed.unionByName(sized.select("column_name", kind.alias("kind")))


def infer_kinds(table: Table) -> dict[str, str]:
    """Kind of each column, in the order of the table: one small row per column reaches the driver."""
    found = {r["column_name"]: r["kind"] for r in column_kinds(table.df).collect()}
    return {c: found[c] for c in table.df.columns if c in found}


def without_keys(kinds: dict[str, str], table: Table) -> dict[str, str]:
    return {c: k for c, k in kinds.items() if c != table.pkey and c not in table.fkeys}


def database_kinds(db: Database) -> DataFrame:
    """(table_name, column_name, kind) of all tables."""
    parts = [column_kinds(t.df).select(F.lit(name).alias("table_name"), "column_name", "kind") for name, t in db.tables.items()]
    return union_all(parts)


def save_kinds(kinds: DataFrame, path: str) -> None:
    """JSON lines beside the data, one for each column.

    Only the few rows found go to one task: without that shuffle it would also take the counting of all tables.
    """
    kinds.repartition(1).write.json(path)


def load_kinds(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("table_name string, column_name string, kind string").json(path)


def as_number(df: DataFrame, kinds: dict[str, str], col: str) -> Column:
    """What the statistics of a column are about: timestamps in seconds, texts and arrays by length."""
    c = F.col(col)
    if kinds[col] == TIME:
        return F.unix_seconds(c.cast("timestamp")).cast("double")
    if kinds[col] == MULTI:
        return F.size(c).cast("double")
    if isinstance(df.schema[col].dataType, T.StringType):
        return F.length(c).cast("double")
    return c.cast("double")


def column_stats(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """(column, kind, n, n_missing, mean, std, low, q25, q50, q75, high): a few passes over the table, for all columns at once."""
    cols = list(kinds)
    numbers = {c: as_number(df, kinds, c) for c in cols}
    aggs = []
    for i, c in enumerate(cols):
        v = numbers[c]
        aggs += [
            F.count(c).alias(f"n_{i}"), F.count_if(F.col(c).isNull()).alias(f"m_{i}"), F.avg(v).alias(f"a_{i}"),
            F.stddev_pop(v).alias(f"s_{i}"), F.min(v).alias(f"l_{i}"), F.max(v).alias(f"h_{i}"),
        ]
    one = df.agg(*aggs)
    cuts = exact_quantiles(df, numbers, QUARTILES)
    names = {"n": "n", "m": "n_missing", "a": "mean", "s": "std", "l": "low", "h": "high"}
    per_col = [
        F.struct(
            F.lit(c).alias("column"), F.lit(kinds[c]).alias("kind"),
            *[F.col(f"{k}_{i}").alias(name) for k, name in names.items()],
            *[F.lit(cuts[c][q]).cast("double").alias(q) for q in QUARTILES],
        )
        for i, c in enumerate(cols)
    ]
    return one.select(F.inline(F.array(*per_col)))


QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
# relative error in rank of the mergeable summaries that bracket a quantile
SUMMARY_ERROR = 1e-3


def exact_quantiles(
    df: DataFrame, numbers: Mapping[str, Column], fractions: Mapping[str, float], error: float = SUMMARY_ERROR
) -> dict[str, dict[str, float | None]]:
    """Exact quantiles (linear interpolation) of many columns at once; NULL and NaN are left out, no value gives None.

    One scan builds a mergeable summary of each column, whose error in rank is bounded; so two of its values bracket each
    quantile. A second scan counts what lies below and within the brackets. Only the values within a bracket, a
    hundredth of the column or less, are counted one by one, by partial aggregation, and ranked over range partitions.
    A bracket that missed, which the counts would show, is widened to the whole column.
    """
    if not numbers:
        return {}
    values = [F.when(~F.isnan(c.cast("double")), c.cast("double")).alias(f"_v{i}") for i, c in enumerate(numbers.values())]
    named = df.select(*values)
    ends = [f for q in fractions.values() for f in (max(0.0, q - 3 * error), min(1.0, q + 3 * error))]
    sketch = [
        x for i in range(len(values))
        for x in (F.count(f"_v{i}").alias(f"n{i}"), F.percentile_approx(f"_v{i}", ends, round(1 / error)).alias(f"p{i}"))
    ]
    summary = named.agg(*sketch).first()
    brackets = [
        (i, q, summary[f"p{i}"][2 * j], summary[f"p{i}"][2 * j + 1])
        for i in range(len(values)) for j, q in enumerate(fractions.values()) if summary[f"n{i}"]
    ]
    out: dict[str, dict[str, float | None]] = {c: dict.fromkeys(fractions) for c in numbers}
    if not brackets:
        return out
    tallies = []
    for b, (i, _, low, high) in enumerate(brackets):
        v = F.col(f"_v{i}")
        tallies += [F.count_if(v < low).alias(f"below{b}"), F.count_if(v.between(low, high)).alias(f"in{b}")]
    tally = named.agg(*tallies).first()
    picked: list[Column] = []
    inside: list[Column] = []
    found: dict[int, tuple[float, float]] = {}
    shares: list[float] = []
    for b, (i, q, low, high) in enumerate(brackets):
        place = (summary[f"n{i}"] - 1) * q
        first, last = math.floor(place), math.ceil(place)
        shares.append(place - first)
        below, within = tally[f"below{b}"], tally[f"in{b}"]
        if below > first or last >= below + within:
            below, low, high = 0, -math.inf, math.inf
        elif low == high:
            found[b] = low, low
            continue
        v = F.col(f"_v{i}")
        inside.append(F.struct(F.lit(b).alias("b"), F.when(v.between(low, high), v).alias("v")))
        for name, rank in (("first", first - below), ("last", last - below)):
            hit = (F.col("b") == b) & (F.col("upto") - F.col("n") <= rank) & (rank < F.col("upto"))
            picked.append(F.max(F.when(hit, F.col("v"))).alias(f"{name}{b}"))
    if inside:
        counts = named.select(F.inline(F.array(*inside))).where("v IS NOT NULL").groupBy("b", "v").agg(F.count(F.lit(1)).alias("n"))
        row = running_totals(counts, ["b"], ["v"], {"upto": F.col("n")}).agg(*picked).first()
        found |= {b: (row[f"first{b}"], row[f"last{b}"]) for b in range(len(brackets)) if b not in found}
    columns, names = list(numbers), list(fractions)
    for b, (i, q, _, _) in enumerate(brackets):
        low, high = found[b]
        name = next(n for n in names if fractions[n] == q)
        out[columns[i]][name] = low + (high - low) * shares[b]
    return out


def top_categories(df: DataFrame, cols: Sequence[str], k: int) -> DataFrame:
    """(column, category, n, rank): the k most frequent values of each column as text, ties by the text; NULL is none.

    Values of all columns are counted by one partial aggregation; the cut to k happens before the last shuffle.
    """
    one = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("category")) for c in cols]
    counts = df.select(F.inline(F.array(*one))).dropna().groupBy("column", "category").agg(F.count(F.lit(1)).alias("n"))
    return top_k(counts, ["column"], [F.desc("n"), F.asc("category")], k)


def category_counts(df: DataFrame, col: str) -> DataFrame:
    """Categories with their counts; arrays count each item."""
    values = df.select(F.explode(col) if isinstance(df.schema[col].dataType, T.ArrayType) else F.col(col))
    return values.toDF("category").dropna().groupBy("category").agg(F.count(F.lit(1)).alias("n"))
