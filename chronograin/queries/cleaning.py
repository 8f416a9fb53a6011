"""Projection, cleaning and scalar operators over the given tables."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from chronograin.functions import clean
from chronograin.model import Table
from chronograin.plans.catalog import get_task
from chronograin.queries import Book, read
from chronograin.queries.databases import DATASETS

BOOK = Book()
CUT = datetime(2000, 7, 1)


def _line_table(spark, sf_dir) -> Table:
    cols = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate"]
    return Table(read(spark, sf_dir, "lineitem").select(*cols), None, "l_shipdate", {"l_orderkey": "orders"})


_LINE = "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate FROM lineitem"


@BOOK.query("rows_upto", f"{_LINE} WHERE l_shipdate <= TIMESTAMP '{CUT}'")
def rows_upto(spark, sf_dir):
    return _line_table(spark, sf_dir).upto(CUT).df


@BOOK.query("rows_from", f"{_LINE} WHERE l_shipdate >= TIMESTAMP '{CUT}'")
def rows_from(spark, sf_dir):
    return _line_table(spark, sf_dir).from_(CUT).df


def _raw_dates(spark, sf_dir):
    """Order dates as text, those of one status not a date at all."""
    text = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    raw = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("on "), text)).otherwise(text)
    return read(spark, sf_dir, "orders").select("o_orderkey", raw.alias("placed"))


@BOOK.query("clean_datetime", "SELECT o_orderkey, o_orderdate AS placed FROM orders WHERE o_orderstatus <> 'P'")
def clean_datetime(spark, sf_dir):
    return clean.clean_time(_raw_dates(spark, sf_dir), "placed")


@BOOK.query(
    "clean_datetime_share",
    """SELECT count(*) AS n_rows, count(*) FILTER (o_orderstatus = 'P') AS n_dropped,
    round(100.0 * count(*) FILTER (o_orderstatus = 'P') / count(*), 6) AS percent_dropped FROM orders""",
)
def clean_datetime_share(spark, sf_dir):
    share = clean.unparsed_share(_raw_dates(spark, sf_dir), "placed")
    return share.withColumn("percent_dropped", F.round("percent_dropped", 6))


@BOOK.query(
    "parse_mixed_datetime",
    """SELECT event_id, CASE event_type WHEN 'click' THEN date_trunc('second', ts) WHEN 'view' THEN date_trunc('day', ts)
    WHEN 'signup' THEN date_trunc('minute', ts) WHEN 'error' THEN date_trunc('millisecond', ts) END AS at_time FROM events""",
)
def parse_mixed_datetime(spark, sf_dir):
    kind = F.col("event_type")
    raw = (
        F.when(kind == "click", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
        .when(kind == "view", F.date_format("ts", "yyyy-MM-dd"))
        .when(kind == "signup", F.date_format("ts", "MM/dd/yyyy HH:mm"))
        .when(kind == "error", F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z")))
        .otherwise("soon")
    )
    return read(spark, sf_dir, "events").select("event_id", clean.parse_time(raw).alias("at_time"))


@BOOK.query(
    "unix_time",
    """SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS seconds, date_trunc('second', ts) AS back FROM events""",
)
def unix_time(spark, sf_dir):
    seconds = clean.to_unix_seconds(F.col("ts"))
    return read(spark, sf_dir, "events").select(
        "event_id", seconds.alias("seconds"), clean.from_unix_seconds(seconds).alias("back")
    )


@BOOK.query(
    "concat_date_time",
    """SELECT event_id, CASE event_type WHEN 'error' THEN date_trunc('day', ts) ELSE date_trunc('second', ts) END AS at_time
    FROM events""",
)
def concat_date_time(spark, sf_dir):
    time = F.when(F.col("event_type") == "error", clean.MISSING_MARK).otherwise(F.date_format("ts", "HH:mm:ss"))
    raw = read(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("d"), time.alias("t"))
    return raw.select("event_id", clean.join_date_time(F.col("d"), F.col("t")).alias("at_time"))


@BOOK.query(
    "sentinel_to_null",
    """SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status, CASE WHEN o_orderpriority LIKE '4%' THEN NULL
    ELSE o_orderpriority END AS priority FROM orders""",
)
def sentinel_to_null(spark, sf_dir):
    mark = F.lit(clean.MISSING_MARK)
    raw = read(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "P", mark).otherwise(F.col("o_orderstatus")).alias("status"),
        F.when(F.col("o_orderpriority").startswith("4"), mark).otherwise(F.col("o_orderpriority")).alias("priority"),
    )
    return clean.marks_to_null(raw)


@BOOK.query(
    "to_numeric_coerce",
    """SELECT l_orderkey, l_linenumber, TRY_CAST(CASE l_returnflag WHEN 'A' THEN 'x' || l_quantity ELSE l_quantity || '' END AS DOUBLE)
    AS quantity FROM lineitem""",
)
def to_numeric_coerce(spark, sf_dir):
    text = F.col("l_quantity").cast("string")
    raw = F.when(F.col("l_returnflag") == "A", F.concat(F.lit("x"), text)).otherwise(text)
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", raw.alias("quantity"))
    return clean.to_numbers(lines, ["quantity"])


@BOOK.query(
    "parse_price",
    "SELECT p_partkey, CASE WHEN p_size % 3 = 2 THEN NULL ELSE round(p_retailprice, 2) END AS price FROM part",
)
def parse_price(spark, sf_dir):
    price = F.concat(F.lit("$"), F.format_number("p_retailprice", 2))
    raw = (
        F.when(F.col("p_size") % 3 == 0, price)
        .when(F.col("p_size") % 3 == 1, F.concat(price, F.lit(" - "), F.lit("$9,999.00")))
        .otherwise(F.concat(F.lit("<b>"), price))
    )
    return read(spark, sf_dir, "part").select("p_partkey", clean.parse_price(raw).alias("price"))


@BOOK.query(
    "empty_list_to_null",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag <> 'R' AND l_linestatus <> 'F' AS is_null,
    CASE WHEN l_returnflag = 'R' THEN l_partkey WHEN l_linestatus = 'F' THEN l_suppkey END AS first_item FROM lineitem""",
)
def empty_list_to_null(spark, sf_dir):
    """Lists of none, one or two items."""
    items = F.array_compact(
        F.array(
            F.when(F.col("l_returnflag") == "R", F.col("l_partkey")),
            F.when(F.col("l_linestatus") == "F", F.col("l_suppkey")),
        )
    )
    raw = read(spark, sf_dir, "lineitem").withColumn("l", clean.empty_to_null(items))
    return raw.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.col("l").isNull().alias("is_null"), clean.first_or_null(F.col("l")).alias("first_item"),
    )


@BOOK.query("drop_columns", "SELECT o_orderkey, o_custkey, o_orderdate FROM orders")
def drop_columns(spark, sf_dir):
    return read(spark, sf_dir, "orders").drop("o_orderstatus", "o_totalprice", "o_orderpriority")


@BOOK.query("select_columns", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def select_columns(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")


@BOOK.query(
    "rename_columns", "SELECT s_suppkey AS driver_id, s_name AS name, s_nationkey AS nation_id, s_acctbal FROM supplier"
)
def rename_columns(spark, sf_dir):
    names = {"s_suppkey": "driver_id", "s_name": "name", "s_nationkey": "nation_id"}
    return clean.rename(read(spark, sf_dir, "supplier"), names)


def _gaps(spark, sf_dir):
    return read(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("user_id"),
        F.when(F.col("o_orderstatus") != "F", F.col("o_orderpriority")).alias("title"),
    )


_GAPS = """(SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS user_id,
  CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority END AS title FROM orders)"""


@BOOK.query("drop_null", f"SELECT * FROM {_GAPS} WHERE user_id IS NOT NULL")
def drop_null(spark, sf_dir):
    return _gaps(spark, sf_dir).dropna(subset=["user_id"])


@BOOK.query("fill_null", f"SELECT o_orderkey, user_id, coalesce(title, '') AS title FROM {_GAPS}")
def fill_null(spark, sf_dir):
    return _gaps(spark, sf_dir).fillna("", subset=["title"])


@BOOK.query("shift_time", "SELECT o_orderkey, o_orderdate - INTERVAL 1 DAY AS day_before FROM orders")
def shift_time(spark, sf_dir):
    moved = clean.shift_time(F.col("o_orderdate"), timedelta(days=-1))
    return read(spark, sf_dir, "orders").select("o_orderkey", moved.alias("day_before"))


@BOOK.query(
    "filter_domain",
    """SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'O' AND o_orderdate >= TIMESTAMP '1997-01-01'
    AND o_custkey IS NOT NULL AND o_totalprice BETWEEN 1000 AND 300000""",
)
def filter_domain(spark, sf_dir):
    kept = (
        (F.col("o_orderstatus") == "O")
        & (F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz"))
        & F.col("o_custkey").isNotNull()
        & F.col("o_totalprice").between(1000, 300000)
    )
    return read(spark, sf_dir, "orders").where(kept).select("o_orderkey", "o_orderdate")


@BOOK.query("text_length_filter", "SELECT doc_id, length(text) AS n FROM documents WHERE length(text) > 300")
def text_length_filter(spark, sf_dir):
    length = F.length("text")
    return read(spark, sf_dir, "documents").where(length > 300).select("doc_id", length.cast("bigint").alias("n"))


@BOOK.query(
    "case_flag",
    """SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE 0 END AS visited,
    CAST(value > 100 AS INTEGER) AS big, event_type = 'error' AS failed FROM events""",
)
def case_flag(spark, sf_dir):
    kind = F.col("event_type")
    return read(spark, sf_dir, "events").select(
        "event_id",
        F.when(kind.isin("view", "click"), 1).otherwise(0).alias("visited"),
        (F.col("value") > 100).cast("int").alias("big"),
        (kind == "error").alias("failed"),
    )


@BOOK.query(
    "cast_keys",
    """SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_custkey END AS user_id
    FROM orders""",
)
def cast_keys(spark, sf_dir):
    raw = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("o_orderkey"),
        F.when(F.col("o_orderstatus") == "P", "none").otherwise(F.col("o_custkey").cast("string")).alias("user_id"),
    )
    return clean.cast_keys(raw, ["o_orderkey", "user_id"])


@BOOK.query(
    "split_to_list",
    """SELECT l_orderkey, 4 AS n, l_orderkey + l_partkey + l_suppkey + l_linenumber AS total,
    least(l_orderkey, l_partkey, l_suppkey, l_linenumber) AS lo FROM lineitem""",
)
def split_to_list(spark, sf_dir):
    """Keys of a line as blank-separated text, split into numbers again."""
    text = F.concat_ws("  ", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    numbers = read(spark, sf_dir, "lineitem").select("l_orderkey", clean.split_numbers(text).alias("p"))
    total = F.aggregate("p", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return numbers.select(
        "l_orderkey", F.size("p").alias("n"), total.alias("total"), F.array_min("p").alias("lo")
    )


@BOOK.query(
    "mask_input_cols",
    """WITH a AS (SELECT DISTINCT o_custkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey
      WHERE l_shipdate > TIMESTAMP '2000-07-01' - INTERVAL 91 DAY AND l_shipdate <= TIMESTAMP '2000-07-01')
    SELECT TIMESTAMP '2000-07-01' AS timestamp, o_custkey AS customer_id FROM a WHERE o_custkey IN (SELECT c_custkey FROM customer)""",
)
def mask_input_cols(spark, sf_dir):
    """The test table of a task as a model sees it: no target."""
    return get_task("shop", "user-churn").table(DATASETS["shop"](spark, sf_dir), "test").df


@BOOK.query("remove_key_features", "SELECT rating, verified, review_text, summary FROM ({})".format(
    """SELECT CAST(l_linenumber % 5 + 1 AS DOUBLE) AS rating, l_linestatus = 'F' AS verified,
    repeat(o_orderpriority, CAST(l_quantity AS INTEGER)) AS review_text, l_returnflag || ' ' || o_orderpriority AS summary
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""
))
def remove_key_features(spark, sf_dir):
    return clean.features(DATASETS["shop"](spark, sf_dir).full_db["review"])


@BOOK.query(
    "relative_time_days",
    """SELECT l_orderkey, l_linenumber, l_partkey, round((epoch(TIMESTAMP '2000-07-01') - epoch(l_shipdate)) / 86400, 6) AS age
    FROM lineitem""",
)
def relative_time_days(spark, sf_dir):
    age = clean.age_days(F.lit("2000-07-01").cast("timestamp_ntz"), F.col("l_shipdate"))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(age, 6).alias("age"))


@BOOK.query(
    "columns_to_array",
    """SELECT l_orderkey, l_linenumber, l_partkey, 4 AS n, round(l_quantity + l_extendedprice + l_discount + l_tax, 2) AS total
    FROM lineitem""",
)
def columns_to_array(spark, sf_dir):
    values = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    named = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", *[F.col(c).alias(f"c_{i}") for i, c in enumerate(values, 1)]
    )
    packed = clean.columns_to_array(named, clean.numbered("c_", 100), "c_vector")
    total = F.aggregate("c_vector", F.lit(0.0), lambda a, x: a + x)
    return packed.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.size("c_vector").alias("n"), F.round(total, 2).alias("total")
    )


@BOOK.query(
    "json_safe",
    """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value
    FROM events""",
)
def json_safe(spark, sf_dir):
    value = F.when(F.col("event_type") == "error", F.lit(float("nan"))).otherwise(F.col("value"))
    return clean.json_safe(read(spark, sf_dir, "events").select("event_id", "ts", value.alias("value")))


@BOOK.query(
    "clamp_percentile",
    """SELECT c_custkey, round(least(greatest(c_acctbal, (SELECT quantile_cont(s_acctbal, 0.02) FROM supplier)),
    (SELECT quantile_cont(s_acctbal, 0.98) FROM supplier)), 6) AS c_acctbal FROM customer""",
)
def clamp_percentile(spark, sf_dir):
    pred = read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    clipped = clean.clamp_to_percentiles(pred, "c_acctbal", read(spark, sf_dir, "supplier"), "s_acctbal")
    return clipped.withColumn("c_acctbal", F.round("c_acctbal", 6))


@BOOK.query("const_feature", "SELECT const, count(*) AS n FROM (SELECT 1.0::DOUBLE AS const FROM lineitem) GROUP BY const")
def const_feature(spark, sf_dir):
    """A link table has keys only, so it gets a constant feature."""
    links = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    table = Table(links, None, None, {"l_orderkey": "orders", "l_partkey": "part"})
    return clean.features(table).groupBy("const").agg(F.count(F.lit(1)).alias("n"))
