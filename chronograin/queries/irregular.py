"""Windows and anchors that form no grid: any time, any length, overlapping or not."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronograin.operators import intervals
from chronograin.plans.catalog import TASKS
from chronograin.queries import Book, Query, read
from chronograin.queries.databases import DATASETS, VIEWS
from chronograin.queries.labels import ROUNDED, SQL

BOOK = Book()

# every order looks at its customer's orders of the days before it, none to 960 of them
_DAYS = 10
_WINDOWS = f"""windows AS (SELECT o_orderkey AS asked, o_custkey, o_orderdate AS until,
  o_orderdate - {_DAYS} * (o_orderkey % 97) * INTERVAL 1 DAY AS since FROM orders)"""


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = F.make_dt_interval((_DAYS * (F.col("o_orderkey") % 97)).cast("int"))
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("asked"), "o_custkey", F.col("o_orderdate").alias("until"), (F.col("o_orderdate") - back).alias("since")
    )


@BOOK.query(
    "window_join_irregular",
    f"""WITH {_WINDOWS} SELECT asked, o_orderkey AS found, o_totalprice AS price
    FROM windows w JOIN orders o ON o.o_custkey = w.o_custkey AND o_orderdate > since AND o_orderdate <= until""",
)
def window_join_irregular(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    met = intervals.window_pairs(_windows(spark, sf_dir), orders, ["o_custkey"], "since", "until", "o_orderdate")
    return met.select("asked", F.col("o_orderkey").alias("found"), F.col("o_totalprice").alias("price"))


@BOOK.query(
    "window_aggregate_irregular",
    f"""WITH {_WINDOWS} SELECT asked, count(o_orderkey) AS n, round(sum(o_totalprice), 2) AS total,
      min(o_totalprice) AS least, max(o_totalprice) AS most
    FROM windows w LEFT JOIN orders o ON o.o_custkey = w.o_custkey AND o_orderdate > since AND o_orderdate <= until GROUP BY asked""",
)
def window_aggregate_irregular(spark, sf_dir):
    price = F.col("o_totalprice")
    found = intervals.window_aggregate(
        _windows(spark, sf_dir), read(spark, sf_dir, "orders"), ["o_custkey"], "since", "until", "o_orderdate",
        {"n": ("count", F.col("o_orderkey")), "total": ("sum", price), "least": ("min", price), "most": ("max", price)},
    )
    return found.select("asked", "n", F.round("total", 2).alias("total"), "least", "most")


@BOOK.query(
    "window_totals_irregular",
    f"""WITH {_WINDOWS},
    met AS (SELECT asked, o_totalprice AS p FROM windows LEFT JOIN orders ON o_orderdate > since AND o_orderdate <= until WHERE asked % 20 = 0)
    SELECT asked, count(p) AS n, coalesce(sum(round(p * 100)::BIGINT), 0)::BIGINT AS cents FROM met GROUP BY asked""",
)
def window_totals_irregular(spark, sf_dir):
    """Orders of all customers within the windows of one order in twenty, without a key to meet by."""
    # a set of queries: the orders whose key 20 divides, against all orders
    asked = _windows(spark, sf_dir).where(F.col("asked") % 20 == 0).select("asked", "since", "until")
    orders = read(spark, sf_dir, "orders").select("o_orderdate", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"))
    found = intervals.window_totals(
        asked, orders, [], "since", "until", "o_orderdate", {"n": F.lit(1).cast("bigint"), "cents": F.col("cents")}
    )
    return found.select("asked", "n", "cents")


# anchors at growing distances: early windows overlap, late ones leave gaps
DAILY = [datetime(1993, 1, 5, 6) + timedelta(days=7 * k * k, hours=k) for k in range(15)]
HOURLY = [datetime(2024, 1, 1, 3) + timedelta(hours=2 * k * k, minutes=k) for k in range(14)]


def _times(schema: str) -> list[datetime]:
    return HOURLY if schema == "classifieds" else DAILY


def labels_at(schema: str, name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = TASKS[schema][name].labels_at(DATASETS[schema](spark, sf_dir), _times(schema))
        return out.withColumns({c: F.round(c, n) for c, n in ROUNDED.items() if c in out.columns})

    return run


def labels_at_sql(schema: str, name: str) -> str:
    anchors = ", ".join(f"('train', TIMESTAMP '{t}')" for t in _times(schema))
    return f"WITH {VIEWS[schema].strip()},\nanchors(split, timestamp) AS (VALUES {anchors}),\n{SQL[schema, name].strip()}"


# one task for each way of building labels
for _schema, _name in (
    ("shop", "user-churn"),
    ("shop", "user-ltv"),
    ("shop", "user-item-purchase"),
    ("classifieds", "user-clicks"),
    ("racing", "driver-position"),
    ("fashion", "item-sales"),
    ("forum", "user-engagement"),
    ("forum", "post-votes"),
    ("trials", "site-success"),
):
    BOOK.add(f"labels_at_{_schema}_{_name.replace('-', '_')}", labels_at(_schema, _name), labels_at_sql(_schema, _name))
