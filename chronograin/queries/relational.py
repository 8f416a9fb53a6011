"""Joins, aggregations, windows and set operators over the given tables."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from chronograin.functions.draws import draw, draw_sql
from chronograin.grid import Grid, anchor_table
from chronograin.model import Table
from chronograin.operators import integrity, joins, windows
from chronograin.operators.running import positions
from chronograin.operators.selection import subsample
from chronograin.queries import Book, read

BOOK = Book()

# twelve quarterly anchors from 1997 on
GRID = Grid("train", datetime(1997, 1, 1), timedelta(days=91), 12)
DAYS = 91
_A = """anchors AS (SELECT TIMESTAMP '1997-01-01' + 91 * k * INTERVAL 1 DAY AS timestamp FROM generate_series(0, 11) AS s(k))"""
_SEEN = "o_orderdate > timestamp AND o_orderdate <= timestamp + INTERVAL 91 DAY"
_PAST = "o_orderdate > timestamp - INTERVAL 91 DAY AND o_orderdate <= timestamp"


def _orders(spark, sf_dir):
    return read(spark, sf_dir, "orders")


def _lines(spark, sf_dir):
    return read(spark, sf_dir, "lineitem")


# --- joins ------------------------------------------------------------------------------------


@BOOK.query(
    "window_join_left",
    f"WITH {_A} SELECT timestamp, count(o_orderkey) AS n FROM anchors LEFT JOIN orders ON {_SEEN} GROUP BY timestamp",
)
def window_join_left(spark, sf_dir):
    """Facts per anchor; anchors without facts stay."""
    tagged = windows.tag_windows(_orders(spark, sf_dir).select("o_orderdate"), "o_orderdate", [GRID])
    n = tagged.groupBy("timestamp").agg(F.count(F.lit(1)).alias("n"))
    anchors = anchor_table(spark, [GRID]).select("timestamp")
    return anchors.join(n, "timestamp", "left").fillna(0, subset=["n"])


@BOOK.query(
    "window_join_keyed",
    f"WITH {_A} SELECT timestamp, o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM anchors JOIN orders ON {_SEEN} GROUP BY ALL",
)
def window_join_keyed(spark, sf_dir):
    out = windows.aggregate(
        _orders(spark, sf_dir).select("o_custkey", "o_orderdate", "o_totalprice"),
        "o_custkey", "o_orderdate", [GRID], n=F.count(F.lit(1)), total=F.round(F.sum("o_totalprice"), 2),
    )
    return out.drop("split")


@BOOK.query(
    "exists_window",
    f"""WITH {_A} SELECT timestamp, c_custkey FROM anchors CROSS JOIN customer
    WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND {_PAST})""",
)
def exists_window(spark, sf_dir):
    active = windows.tag_range(
        _orders(spark, sf_dir).select("o_custkey", "o_orderdate"), "o_orderdate", [GRID], timedelta(days=DAYS), timedelta(0)
    )
    found = active.select("timestamp", F.col("o_custkey").alias("c_custkey")).distinct()
    return integrity.keep_known(found, "c_custkey", read(spark, sf_dir, "customer").select("c_custkey"))


@BOOK.query(
    "not_exists_window",
    f"""WITH {_A} SELECT timestamp, c_custkey, CAST(NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND {_SEEN}) AS INTEGER) AS quiet
    FROM anchors CROSS JOIN customer""",
)
def not_exists_window(spark, sf_dir):
    seen = windows.tag_windows(_orders(spark, sf_dir).select("o_custkey", "o_orderdate"), "o_orderdate", [GRID])
    hits = seen.select("split", "timestamp", F.col("o_custkey").alias("c_custkey")).distinct().withColumn("quiet", F.lit(0))
    every = windows.for_each_existing(read(spark, sf_dir, "customer"), "c_custkey", hits, "quiet", [GRID], None, F.lit(1))
    return every.drop("split")


@BOOK.query("cross_anchor_entity", f"WITH {_A} SELECT timestamp, s_suppkey FROM anchors CROSS JOIN supplier")
def cross_anchor_entity(spark, sf_dir):
    """Every entity at every anchor: anchors are numbers in a row, so nothing is joined."""
    return windows.spread_since(read(spark, sf_dir, "supplier").select("s_suppkey"), [GRID]).drop("split")


@BOOK.query(
    "correlated_scalar_agg",
    f"""WITH {_A} SELECT timestamp, c_custkey, round(coalesce((SELECT sum(o_totalprice) FROM orders
    WHERE o_custkey = c_custkey AND {_SEEN}), 0), 2) AS total FROM anchors CROSS JOIN customer""",
)
def correlated_scalar_agg(spark, sf_dir):
    paid = windows.aggregate(
        _orders(spark, sf_dir).select(F.col("o_custkey").alias("c_custkey"), "o_orderdate", "o_totalprice"),
        "c_custkey", "o_orderdate", [GRID], total=F.round(F.sum("o_totalprice"), 2),
    )
    every = windows.for_each_existing(read(spark, sf_dir, "customer"), "c_custkey", paid, "total", [GRID], None, F.lit(0.0))
    return every.drop("split")


@BOOK.query(
    "in_subquery_lookback",
    f"""WITH {_A}, seen AS (SELECT DISTINCT timestamp, o_custkey FROM anchors JOIN orders ON {_SEEN}),
    past AS (SELECT DISTINCT timestamp, o_custkey FROM anchors JOIN orders
      ON o_orderdate > timestamp - INTERVAL 365 DAY AND o_orderdate <= timestamp)
    SELECT seen.* FROM seen JOIN past ON past.timestamp = seen.timestamp AND past.o_custkey = seen.o_custkey""",
)
def in_subquery_lookback(spark, sf_dir):
    """Active in the window, given active in the year before: each order meets at most five anchors."""
    dates = _orders(spark, sf_dir).select("o_custkey", "o_orderdate")
    seen = windows.tag_windows(dates, "o_orderdate", [GRID]).select("timestamp", "o_custkey").distinct()
    past = windows.tag_range(dates, "o_orderdate", [GRID], timedelta(days=365), timedelta(0))
    return seen.join(past.select("timestamp", "o_custkey"), ["timestamp", "o_custkey"], "left_semi")


@BOOK.query(
    "existed_before_join",
    f"WITH {_A} SELECT timestamp, o_orderkey FROM anchors JOIN orders ON o_orderdate <= timestamp AND o_orderstatus = 'P'",
)
def existed_before_join(spark, sf_dir):
    pending = _orders(spark, sf_dir).where(F.col("o_orderstatus") == "P")
    spread = windows.spread_since(pending.select("o_orderkey", "o_orderdate"), [GRID], "o_orderdate")
    return spread.select("timestamp", "o_orderkey")


@BOOK.query(
    "nested_left_join",
    f"""WITH {_A}, joined AS (SELECT c_nationkey, o_orderdate, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey)
    SELECT timestamp, c_nationkey, count(DISTINCT o_orderkey) AS n FROM anchors LEFT JOIN joined ON {_SEEN} GROUP BY ALL""",
)
def nested_left_join(spark, sf_dir):
    customer = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    orders = _orders(spark, sf_dir).select("o_custkey", "o_orderkey", "o_orderdate")
    both = customer.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    out = windows.aggregate(both, "c_nationkey", "o_orderdate", [GRID], n=F.count_distinct("o_orderkey"))
    return out.drop("split")


@BOOK.query(
    "multi_table_equi_join",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, cn.n_name AS customer_nation, sn.n_name AS supplier_nation
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN supplier ON l_suppkey = s_suppkey JOIN nation cn ON cn.n_nationkey = c_nationkey JOIN nation sn ON sn.n_nationkey = s_nationkey""",
)
def multi_table_equi_join(spark, sf_dir):
    nation = read(spark, sf_dir, "nation")
    of_customer = nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("customer_nation"))
    of_supplier = nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("supplier_nation"))
    customer = read(spark, sf_dir, "customer").join(of_customer, "c_nationkey")
    supplier = read(spark, sf_dir, "supplier").join(of_supplier, "s_nationkey")
    return (
        _lines(spark, sf_dir)
        .join(_orders(spark, sf_dir), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "customer_nation", "supplier_nation")
    )


@BOOK.query(
    "conditional_left_join",
    """SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_returnflag = 'R'
    GROUP BY o_orderkey""",
)
def conditional_left_join(spark, sf_dir):
    lines = _lines(spark, sf_dir).select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag")
    joined = joins.conditional_left(
        _orders(spark, sf_dir).select("o_orderkey"), lines, "o_orderkey", F.col("l_returnflag") == "R"
    )
    return joined.groupBy("o_orderkey").agg(F.count("l_returnflag").alias("n"))


@BOOK.query(
    "lookup_join",
    """SELECT l_orderkey, l_linenumber, l_partkey, o_orderdate FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey
    AND o_orderstatus <> 'P'""",
)
def lookup_join(spark, sf_dir):
    known = _orders(spark, sf_dir).where(F.col("o_orderstatus") != "P")
    facts = _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey")
    return joins.lookup(facts, known, "l_orderkey", "o_orderkey", ["o_orderdate"])


@BOOK.query(
    "semi_filter",
    "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#2')",
)
def semi_filter(spark, sf_dir):
    brand = read(spark, sf_dir, "part").where(F.col("p_brand") == "Brand#2").select("p_partkey")
    return integrity.keep_known(_lines(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey"), "l_partkey", brand)


@BOOK.query(
    "inner_flatten_join",
    """SELECT o_custkey AS "user", l_suppkey AS friend FROM orders JOIN lineitem ON o_orderkey = l_orderkey
    JOIN customer ON c_custkey = l_suppkey WHERE c_acctbal > 0""",
)
def inner_flatten_join(spark, sf_dir):
    """Links to users that exist; here, customers with credit."""
    users = read(spark, sf_dir, "customer").where(F.col("c_acctbal") > 0).select("c_custkey")
    links = _orders(spark, sf_dir).join(_lines(spark, sf_dir), F.col("o_orderkey") == F.col("l_orderkey"))
    return links.join(users, F.col("c_custkey") == F.col("l_suppkey")).select(
        F.col("o_custkey").alias("user"), F.col("l_suppkey").alias("friend")
    )


@BOOK.query(
    "star_denormalize",
    """SELECT l_orderkey, l_linenumber, l_partkey, p_name, p_brand, o_custkey, c_name FROM lineitem
    LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey""",
)
def star_denormalize(spark, sf_dir):
    facts = _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey")
    wide = joins.lookup(facts, read(spark, sf_dir, "part"), "l_partkey", "p_partkey", ["p_name", "p_brand"])
    wide = joins.lookup(wide, _orders(spark, sf_dir), "l_orderkey", "o_orderkey", ["o_custkey"])
    return joins.lookup(wide, read(spark, sf_dir, "customer"), "o_custkey", "c_custkey", ["c_name"])


@BOOK.query(
    "m2m_inner",
    "SELECT DISTINCT l_orderkey AS nct_id, s_suppkey AS facility_id, s_name AS name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey",
)
def m2m_inner(spark, sf_dir):
    links = _lines(spark, sf_dir).select(F.col("l_orderkey").alias("nct_id"), F.col("l_suppkey").alias("facility_id")).distinct()
    sites = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("facility_id"), F.col("s_name").alias("name"))
    return links.join(sites, "facility_id").select("nct_id", "facility_id", "name")


@BOOK.query(
    "asof_history",
    f"""WITH {_A}, cut AS (SELECT DISTINCT timestamp, o_custkey FROM anchors JOIN orders ON {_PAST})
    SELECT cut.timestamp, cut.o_custkey, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total, max(o_orderdate) AS last_order
    FROM cut JOIN orders ON orders.o_custkey = cut.o_custkey AND o_orderdate <= timestamp GROUP BY ALL""",
)
def asof_history(spark, sf_dir):
    """The whole history of an entity up to each of its cut-offs."""
    orders = _orders(spark, sf_dir).select("o_custkey", "o_orderdate", "o_totalprice")
    active = windows.tag_range(orders, "o_orderdate", [GRID], timedelta(days=DAYS), timedelta(0))
    found = joins.totals_upto(
        active, "o_custkey", "timestamp", orders, "o_custkey", "o_orderdate",
        {"total": F.col("o_totalprice")}, {"last_order": F.col("o_orderdate")},
    )
    return found.select("timestamp", "o_custkey", F.col("n").alias("n_orders"), F.round("total", 2).alias("total"), "last_order")


# --- aggregations -------------------------------------------------------------------------------


@BOOK.query(
    "window_aggregates",
    f"""WITH {_A} SELECT timestamp, o_custkey, round(sum(o_totalprice), 2) AS sum_window,
    count(*) FILTER (o_orderstatus IN ('O', 'F')) AS count_if_window, count(DISTINCT o_orderpriority) AS count_distinct_window,
    round(avg(o_totalprice), 4) AS avg_window, max(CASE WHEN o_orderstatus <> 'O' THEN 1 ELSE 0 END) AS max_flag_window,
    CASE WHEN min(o_totalprice) <= 50000 THEN 1 ELSE 0 END AS min_threshold_window
    FROM anchors JOIN orders ON {_SEEN} GROUP BY ALL""",
)
def window_aggregates(spark, sf_dir):
    """All label aggregates in one pass, grouped by (anchor, entity)."""
    status, price = F.col("o_orderstatus"), F.col("o_totalprice")
    facts = _orders(spark, sf_dir).select("o_custkey", "o_orderdate", "o_totalprice", "o_orderstatus", "o_orderpriority")
    return windows.aggregate(
        facts, "o_custkey", "o_orderdate", [GRID],
        sum_window=F.round(F.coalesce(F.sum(price), F.lit(0.0)), 2),
        count_if_window=F.count_if(status.isin("O", "F")),
        count_distinct_window=F.count_distinct("o_orderpriority"),
        avg_window=F.round(F.avg(price), 4),
        max_flag_window=F.max(F.when(status != "O", 1).otherwise(0)),
        min_threshold_window=F.when(F.min(price) <= 50000, 1).otherwise(0),
    ).drop("split")


@BOOK.query(
    "ratio_window",
    f"""WITH {_A} SELECT timestamp, o_custkey, round(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) / count(o_orderkey), 6) AS ratio
    FROM anchors JOIN orders ON {_SEEN} GROUP BY ALL HAVING sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) > 0""",
)
def ratio_window(spark, sf_dir):
    hit = F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0))
    facts = _orders(spark, sf_dir).select("o_custkey", "o_orderdate", "o_orderstatus", "o_orderkey")
    both = windows.aggregate(facts, "o_custkey", "o_orderdate", [GRID], hits=hit, n=F.count("o_orderkey"))
    return both.where(F.col("hits") > 0).select(
        "timestamp", "o_custkey", F.round(F.col("hits") / F.col("n"), 6).alias("ratio")
    )


@BOOK.query(
    "two_level_agg",
    """WITH per_day AS (SELECT l_suppkey, l_shipdate, min(CASE WHEN l_discount < 0.05 THEN 1 ELSE 0 END) AS ok FROM lineitem GROUP BY ALL)
    SELECT l_suppkey, count(*) AS n_days, round(sum(ok) / count(ok), 6) AS share FROM per_day GROUP BY l_suppkey""",
)
def two_level_agg(spark, sf_dir):
    ok = F.min(F.when(F.col("l_discount") < 0.05, 1).otherwise(0)).alias("ok")
    per_day = _lines(spark, sf_dir).groupBy("l_suppkey", "l_shipdate").agg(ok)
    return per_day.groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("n_days"), F.round(F.sum("ok") / F.count("ok"), 6).alias("share")
    )


@BOOK.query(
    "drop_duplicates_first",
    """SELECT * FROM (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate, l_quantity FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_quantity) = 1)""",
)
def drop_duplicates_first(spark, sf_dir):
    cols = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", "l_quantity"]
    order = ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    return integrity.first_per_key(_lines(spark, sf_dir).select(*cols), ["l_orderkey"], order)


@BOOK.query("distinct_rows", "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def distinct_rows(spark, sf_dir):
    return _lines(spark, sf_dir).select("l_partkey", "l_suppkey").distinct()


@BOOK.query(
    "min_max_timestamp",
    """SELECT 'orders' AS table_name, min(o_orderdate) AS min_time, max(o_orderdate) AS max_time FROM orders UNION ALL
    SELECT 'lineitem', min(l_shipdate), max(l_shipdate) FROM lineitem UNION ALL SELECT 'events', min(ts), max(ts) FROM events""",
)
def min_max_timestamp(spark, sf_dir):
    from chronograin.model import Database

    timed = {"orders": "o_orderdate", "lineitem": "l_shipdate", "events": "ts", "customer": None}
    tables = {n: Table(read(spark, sf_dir, n), None, t) for n, t in timed.items()}
    return Database(tables).time_bounds_by_table()


@BOOK.query("row_count", "SELECT 'part' AS table_name, count(*) AS n FROM part UNION ALL SELECT 'orders', count(*) FROM orders")
def row_count(spark, sf_dir):
    counts = [
        read(spark, sf_dir, n).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("table_name"), "n")
        for n in ("part", "orders")
    ]
    return windows.union_all(counts)


# --- windows and limits ---------------------------------------------------------------------------


@BOOK.query(
    "prev_flag_window",
    f"""WITH {_A}, g AS (SELECT timestamp, o_custkey, max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS flag
    FROM anchors JOIN orders ON {_SEEN} GROUP BY ALL)
    SELECT *, max(flag) OVER (PARTITION BY o_custkey ORDER BY timestamp ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS prev_flag FROM g""",
)
def prev_flag_window(spark, sf_dir):
    flag = F.max(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0))
    facts = _orders(spark, sf_dir).select("o_custkey", "o_orderdate", "o_orderstatus")
    per_anchor = windows.aggregate(facts, "o_custkey", "o_orderdate", [GRID], flag=flag).drop("split")
    return windows.add_previous_max(per_anchor, ["o_custkey"], "timestamp", "flag", 2, "prev_flag")


@BOOK.query(
    "sort_history",
    """SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_quantity, row_number() OVER (PARTITION BY l_suppkey
    ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity) AS place FROM lineitem""",
)
def sort_history(spark, sf_dir):
    """Place of each fact in its entity's history; a hot entity is ranked by many tasks."""
    rows = _lines(spark, sf_dir).select("l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity"]
    return positions(rows, ["l_suppkey"], order, "place").drop("l_shipdate")


@BOOK.query("head_n", "SELECT o_orderkey, o_custkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 25")
def head_n(spark, sf_dir):
    """First rows of an explicit order: the limit is the feature."""
    rows = _orders(spark, sf_dir).select("o_orderkey", "o_custkey", "o_orderdate")
    return rows.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(25)


@BOOK.query(
    "subsample_n",
    f"SELECT o_orderkey, o_custkey FROM orders ORDER BY {draw_sql(42, 'o_orderkey')}, o_orderkey LIMIT 500",
)
def subsample_n(spark, sf_dir):
    return subsample(_orders(spark, sf_dir).select("o_orderkey", "o_custkey"), ["o_orderkey"], 500, 42)


@BOOK.query(
    "sample_rows_for_inference",
    f"SELECT doc_id, lang, source FROM documents ORDER BY {draw_sql(42, 'doc_id')}, doc_id LIMIT 1000",
)
def sample_rows_for_inference(spark, sf_dir):
    """Rows to look at, whatever the layout of the files: the limit is the feature."""
    return subsample(read(spark, sf_dir, "documents").select("doc_id", "lang", "source"), ["doc_id"], 1000, 42)


# --- sets and reshaping -----------------------------------------------------------------------------


@BOOK.query(
    "union_distinct",
    """SELECT o_orderkey AS id, o_custkey AS user_id, o_orderdate AS at_time FROM orders UNION
    SELECT l_orderkey, l_suppkey, l_shipdate FROM lineitem UNION SELECT event_id, user_id, ts FROM events""",
)
def union_distinct(spark, sf_dir):
    parts = [("orders", "o_orderkey", "o_custkey", "o_orderdate"), ("lineitem", "l_orderkey", "l_suppkey", "l_shipdate"), ("events", "event_id", "user_id", "ts")]
    frames = [read(spark, sf_dir, t).select(F.col(i).alias("id"), F.col(u).alias("user_id"), F.col(d).alias("at_time")) for t, i, u, d in parts]
    return windows.union_all(frames).distinct()


@BOOK.query(
    "union_all",
    "SELECT c_nationkey AS nation, c_acctbal AS acctbal FROM customer UNION ALL SELECT s_nationkey, s_acctbal FROM supplier",
)
def union_all(spark, sf_dir):
    customer = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("acctbal"))
    supplier = read(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("acctbal"), F.col("s_nationkey").alias("nation"))
    return customer.unionByName(supplier)


@BOOK.query("intersect_keys", "SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_linenumber = 7")
def intersect_keys(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    keys = F.col("l_partkey").alias("k")
    return lines.where(F.col("l_returnflag") == "R").select(keys).intersect(lines.where(F.col("l_linenumber") == 7).select(keys))


@BOOK.query(
    "except_keys",
    "SELECT DISTINCT l_orderkey AS event, l_suppkey AS \"user\" FROM lineitem EXCEPT SELECT o_orderkey, o_custkey FROM orders",
)
def except_keys(spark, sf_dir):
    """Engaged with, but not created by the user."""
    engaged = _lines(spark, sf_dir).select(F.col("l_orderkey").alias("event"), F.col("l_suppkey").alias("user")).distinct()
    created = _orders(spark, sf_dir).select(F.col("o_orderkey").alias("event"), F.col("o_custkey").alias("user"))
    return engaged.join(created, ["event", "user"], "left_anti")


@BOOK.query(
    "melt_status",
    """SELECT p_partkey, 'size' AS status, CAST(p_size AS DOUBLE) AS amount FROM part UNION ALL
    SELECT p_partkey, 'price', p_retailprice FROM part""",
)
def melt_status(spark, sf_dir):
    wide = read(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return wide.unpivot("p_partkey", ["size", "price"], "status", "amount")


@BOOK.query(
    "explode_list",
    """SELECT l_orderkey, l_linenumber, l_partkey, unnest([l_suppkey, l_partkey]) AS item, unnest([0, 1]) AS place FROM lineitem""",
)
def explode_list(spark, sf_dir):
    listed = _lines(spark, sf_dir).withColumn("items", F.array("l_suppkey", "l_partkey"))
    return listed.select("l_orderkey", "l_linenumber", "l_partkey", F.posexplode("items").alias("place", "item"))


@BOOK.query(
    "list_filter",
    """SELECT l_orderkey, min(l_partkey) AS lo, max(l_partkey) AS hi, count(DISTINCT l_partkey) AS n FROM lineitem
    WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25) GROUP BY l_orderkey""",
)
def list_filter(spark, sf_dir):
    """Part lists per order, reduced to known parts; orders without any vanish."""
    from chronograin.operators.lists import pairs_to_lists

    pairs = _lines(spark, sf_dir).select("l_orderkey", "l_partkey").distinct()
    lists = pairs_to_lists(pairs, ["l_orderkey"], "l_partkey")
    big = read(spark, sf_dir, "part").where(F.col("p_size") > 25).select("p_partkey")
    kept = integrity.filter_list(lists, "l_partkey", big, ["l_orderkey", "part"])
    return kept.groupBy("l_orderkey").agg(
        F.min(F.array_min("l_partkey")).alias("lo"), F.max(F.array_max("l_partkey")).alias("hi"),
        F.sum(F.size("l_partkey")).alias("n"),
    )


