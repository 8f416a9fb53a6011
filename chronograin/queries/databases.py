"""The given tables seen as the seven task schemas, in Spark and in SQL.

Each schema is a projection of (or one key join over) the given tables, so its size follows
theirs. ``VIEWS`` states the same projections as SQL for the checks.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronograin.model import Database, Dataset, Table
from chronograin.queries import read

SHOP_VAL, SHOP_TEST = datetime(1999, 7, 1), datetime(2000, 7, 1)
EVENT_VAL, EVENT_TEST = datetime(2024, 1, 20), datetime(2024, 1, 25)


def _choose(col: str, cases: dict[str, object], default: object = None) -> Column:
    out = F.when(F.lit(False), F.lit(None))
    for value, result in cases.items():
        out = out.when(F.col(col) == value, F.lit(result))
    return out.otherwise(F.lit(default))


def _lines_with_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey)


def shop(spark: SparkSession, sf_dir: str) -> Dataset:
    review = _lines_with_orders(spark, sf_dir).select(
        F.col("o_custkey").alias("customer_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_shipdate").alias("review_time"),
        ((F.col("l_linenumber") % 5) + 1).cast("double").alias("rating"),
        (F.col("l_linestatus") == "F").alias("verified"),
        F.repeat("o_orderpriority", F.col("l_quantity").cast("int")).alias("review_text"),
        F.concat_ws(" ", "l_returnflag", "o_orderpriority").alias("summary"),
    )
    customer = read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("customer_name")
    )
    product = read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_brand").alias("brand"),
        F.col("p_name").alias("title"),
        F.col("p_type").alias("category"),
        F.col("p_retailprice").alias("price"),
    )
    tables = {
        "customer": Table(customer, "customer_id"),
        "product": Table(product, "product_id"),
        "review": Table(
            review, None, "review_time", {"customer_id": "customer", "product_id": "product"}
        ),
    }
    return Dataset(Database(tables), SHOP_VAL, SHOP_TEST)


def classifieds(spark: SparkSession, sf_dir: str) -> Dataset:
    events = read(spark, sf_dir, "events").withColumn(
        "ad", F.regexp_extract("props", r'"k": (\d+)', 1).try_cast("bigint")
    )
    part = read(spark, sf_dir, "part")
    customer = read(spark, sf_dir, "customer")
    category = read(spark, sf_dir, "region")
    location = read(spark, sf_dir, "nation")
    stream = {"UserID": "UserInfo", "AdID": "AdsInfo"}
    tables = {
        "UserInfo": Table(
            customer.select(
                F.col("c_custkey").alias("UserID"), F.col("c_mktsegment").alias("Segment")
            ),
            "UserID",
        ),
        "AdsInfo": Table(
            part.select(
                F.col("p_partkey").alias("AdID"),
                F.col("p_name").alias("Title"),
                F.col("p_retailprice").alias("Price"),
                (F.col("p_size") % 5).alias("CategoryID"),
                (F.col("p_size") % 25).alias("LocationID"),
            ),
            "AdID",
            None,
            {"CategoryID": "Category", "LocationID": "Location"},
        ),
        "Category": Table(
            category.select(
                F.col("r_regionkey").alias("CategoryID"), F.col("r_name").alias("CategoryName")
            ),
            "CategoryID",
        ),
        "Location": Table(
            location.select(
                F.col("n_nationkey").alias("LocationID"), F.col("n_name").alias("LocationName")
            ),
            "LocationID",
        ),
        "SearchInfo": Table(
            events.select(
                F.col("event_id").alias("SearchID"),
                F.col("user_id").alias("UserID"),
                F.col("ts").alias("SearchDate"),
                (F.col("ad") % 5).cast("int").alias("CategoryID"),
                (F.col("ad") % 25).cast("int").alias("LocationID"),
            ),
            "SearchID",
            "SearchDate",
            {"UserID": "UserInfo", "CategoryID": "Category", "LocationID": "Location"},
        ),
        "SearchStream": Table(
            events.select(
                F.col("event_id").alias("SearchID"),
                F.col("ad").alias("AdID"),
                F.col("ts").alias("SearchDate"),
                F.when(F.col("event_type") == "click", 1.0).otherwise(0.0).alias("IsClick"),
            ),
            None,
            "SearchDate",
            {"SearchID": "SearchInfo", "AdID": "AdsInfo"},
        ),
        "VisitStream": Table(
            events.where(F.col("event_type").isin("view", "click")).select(
                F.col("user_id").alias("UserID"), F.col("ad").alias("AdID"), F.col("ts").alias("ViewDate")
            ),
            None,
            "ViewDate",
            stream,
        ),
        "PhoneRequestsStream": Table(
            events.where(F.col("event_type") == "purchase").select(
                F.col("user_id").alias("UserID"),
                F.col("ad").alias("AdID"),
                F.col("ts").alias("PhoneRequestDate"),
            ),
            None,
            "PhoneRequestDate",
            stream,
        ),
    }
    return Dataset(Database(tables), EVENT_VAL, EVENT_TEST)


def _user_since_first_order(spark: SparkSession, sf_dir: str, key: str, created: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    return orders.groupBy(F.col("o_custkey").alias(key)).agg(F.min("o_orderdate").alias(created))


def meetups(spark: SparkSession, sf_dir: str) -> Dataset:
    lines, orders = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    status = (
        F.when(F.col("l_linenumber") <= 2, "yes")
        .when(F.col("l_linenumber") == 3, "maybe")
        .when(F.col("l_linenumber") <= 6, "invited")
        .otherwise("no")
    )
    tables = {
        "users": Table(_user_since_first_order(spark, sf_dir, "user_id", "joinedAt"), "user_id", "joinedAt"),
        "events": Table(
            orders.select(
                F.col("o_orderkey").alias("event_id"),
                F.col("o_custkey").alias("user_id"),
                F.col("o_orderdate").alias("start_time"),
                F.col("o_totalprice").alias("c_1"),
                F.length("o_orderpriority").cast("double").alias("c_2"),
            ),
            "event_id",
            "start_time",
            {"user_id": "users"},
        ),
        "event_attendees": Table(
            lines.select(
                F.col("l_orderkey").alias("event"),
                F.col("l_suppkey").alias("user_id"),
                F.col("l_shipdate").alias("start_time"),
                status.alias("status"),
            ),
            None,
            "start_time",
            {"event": "events", "user_id": "users"},
        ),
        "event_interest": Table(
            lines.where(F.col("l_returnflag") == "R").select(
                F.col("l_orderkey").alias("event"),
                F.col("l_suppkey").alias("user"),
                F.col("l_shipdate").alias("timestamp"),
                F.col("l_linenumber").alias("interested"),
            ),
            None,
            "timestamp",
            {"event": "events", "user": "users"},
        ),
        "user_friends": Table(
            _lines_with_orders(spark, sf_dir).select(
                F.col("o_custkey").alias("user"), F.col("l_suppkey").alias("friend")
            ),
            None,
            None,
            {"user": "users", "friend": "users"},
        ),
    }
    return Dataset(Database(tables), SHOP_VAL, SHOP_TEST)


def racing(spark: SparkSession, sf_dir: str) -> Dataset:
    lines, orders = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    supplier, nation = read(spark, sf_dir, "supplier"), read(spark, sf_dir, "nation")
    of_race = {"raceId": "races", "driverId": "drivers"}
    status = _choose("l_returnflag", {"A": 1, "N": 2}, 3).alias("statusId")
    tables = {
        "constructors": Table(
            read(spark, sf_dir, "part").select(
                F.col("p_partkey").alias("constructorId"), F.col("p_name").alias("name"), F.col("p_brand").alias("nationality")
            ),
            "constructorId",
        ),
        "status": Table(lines.select(status, F.col("l_returnflag").alias("status")).distinct(), "statusId"),
        "circuits": Table(
            nation.select(F.col("n_nationkey").alias("circuitId"), F.col("n_name").alias("name")), "circuitId"
        ),
        "races": Table(
            orders.select(
                F.col("o_orderkey").alias("raceId"),
                F.year("o_orderdate").alias("year"),
                F.length("o_orderpriority").alias("circuitId"),
                F.col("o_orderdate").alias("date"),
            ),
            "raceId",
            "date",
            {"circuitId": "circuits"},
        ),
        "drivers": Table(
            supplier.select(F.col("s_suppkey").alias("driverId"), F.col("s_name").alias("surname")),
            "driverId",
        ),
        "results": Table(
            lines.select(
                F.col("l_orderkey").alias("raceId"),
                F.col("l_suppkey").alias("driverId"),
                F.col("l_shipdate").alias("date"),
                F.col("l_linenumber").alias("positionOrder"),
                status,
                F.col("l_quantity").alias("points"),
                F.col("l_partkey").alias("constructorId"),
            ),
            None,
            "date",
            {**of_race, "constructorId": "constructors"},
        ),
        "qualifying": Table(
            lines.select(
                F.col("l_orderkey").alias("raceId"),
                F.col("l_suppkey").alias("driverId"),
                (F.col("l_shipdate") - F.expr("INTERVAL 1 DAY")).alias("date"),
                F.col("l_quantity").cast("int").alias("position"),
            ),
            None,
            "date",
            of_race,
        ),
        "standings": Table(
            lines.where(F.col("l_linestatus") == "F").select(
                F.col("l_orderkey").alias("raceId"),
                F.col("l_suppkey").alias("driverId"),
                F.col("l_shipdate").alias("date"),
                F.col("l_extendedprice").alias("points"),
            ),
            None,
            "date",
            of_race,
        ),
    }
    return Dataset(Database(tables), SHOP_VAL, SHOP_TEST)


def fashion(spark: SparkSession, sf_dir: str) -> Dataset:
    customer, part = read(spark, sf_dir, "customer"), read(spark, sf_dir, "part")
    transactions = _lines_with_orders(spark, sf_dir).select(
        F.col("o_orderdate").alias("t_dat"),
        F.col("o_custkey").alias("customer_id"),
        F.col("l_partkey").alias("article_id"),
        F.col("l_extendedprice").alias("price"),
        _choose("l_linestatus", {"O": 1}, 2).alias("sales_channel_id"),
    )
    tables = {
        "customer": Table(
            customer.select(
                F.col("c_custkey").alias("customer_id"), F.col("c_mktsegment").alias("club_member_status")
            ),
            "customer_id",
        ),
        "article": Table(
            part.select(F.col("p_partkey").alias("article_id"), F.col("p_name").alias("prod_name")),
            "article_id",
        ),
        "transactions": Table(
            transactions, None, "t_dat", {"customer_id": "customer", "article_id": "article"}
        ),
    }
    return Dataset(Database(tables), SHOP_VAL, SHOP_TEST)


def forum(spark: SparkSession, sf_dir: str) -> Dataset:
    lines, orders = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    line_id = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    on_post = [
        line_id.alias("Id"),
        F.col("l_orderkey").alias("PostId"),
        F.col("l_suppkey").alias("UserId"),
        F.col("l_shipdate").alias("CreationDate"),
    ]
    post_user = {"PostId": "posts", "UserId": "users"}
    tables = {
        "users": Table(_user_since_first_order(spark, sf_dir, "Id", "CreationDate"), "Id", "CreationDate"),
        "posts": Table(
            orders.select(
                F.col("o_orderkey").alias("Id"),
                F.col("o_custkey").alias("OwnerUserId"),
                F.col("o_orderdate").alias("CreationDate"),
                _choose("o_orderstatus", {"P": 2}, 1).alias("PostTypeId"),
            ),
            "Id",
            "CreationDate",
            {"OwnerUserId": "users"},
        ),
        "votes": Table(
            lines.select(*on_post, _choose("l_returnflag", {"R": 2}, 1).alias("VoteTypeId")),
            None,
            "CreationDate",
            post_user,
        ),
        "comments": Table(
            lines.where(F.col("l_linestatus") == "F").select(*on_post, F.col("l_returnflag").alias("Text")),
            None,
            "CreationDate",
            post_user,
        ),
        "badges": Table(
            lines.where(F.col("l_returnflag") == "A").select(
                line_id.alias("Id"), F.col("l_suppkey").alias("UserId"), F.col("l_shipdate").alias("Date")
            ),
            None,
            "Date",
            {"UserId": "users"},
        ),
        "postLinks": Table(
            lines.select(
                line_id.alias("Id"),
                F.col("l_orderkey").alias("PostId"),
                F.col("l_partkey").alias("RelatedPostId"),
                F.col("l_shipdate").alias("CreationDate"),
            ),
            None,
            "CreationDate",
            {"PostId": "posts", "RelatedPostId": "posts"},
        ),
        "postHistory": Table(
            lines.where(F.col("l_linestatus") == "O").select(*on_post), None, "CreationDate", post_user
        ),
    }
    return Dataset(Database(tables), SHOP_VAL, SHOP_TEST)


def trials(spark: SparkSession, sf_dir: str) -> Dataset:
    lines, orders = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    part, supplier = read(spark, sf_dir, "part"), read(spark, sf_dir, "supplier")
    customer, nation = read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation")
    of_line = [F.col("l_orderkey").alias("nct_id"), F.col("l_shipdate").alias("date")]
    tables = {
        "studies": Table(
            orders.select(
                F.col("o_orderkey").alias("nct_id"),
                F.col("o_orderdate").alias("start_date"),
                F.col("o_orderpriority").alias("phase"),
            ),
            "nct_id",
            "start_date",
        ),
        "outcomes": Table(
            orders.select(
                F.col("o_orderkey").alias("id"),
                F.col("o_orderkey").alias("nct_id"),
                _choose("o_orderstatus", {"P": "Secondary"}, "Primary").alias("outcome_type"),
                F.col("o_orderdate").alias("date"),
            ),
            "id",
            "date",
            {"nct_id": "studies"},
        ),
        "outcome_analyses": Table(
            lines.select(
                *of_line,
                F.col("l_orderkey").alias("outcome_id"),
                F.col("l_discount").alias("p_value"),
                _choose("l_returnflag", {"A": ">", "N": "="}).alias("p_value_modifier"),
            ),
            None,
            "date",
            {"nct_id": "studies", "outcome_id": "outcomes"},
        ),
        "reported_event_totals": Table(
            lines.select(
                *of_line,
                _choose("l_returnflag", {"R": "serious", "A": "deaths"}, "other").alias("event_type"),
                F.col("l_quantity").alias("subjects_affected"),
            ),
            None,
            "date",
            {"nct_id": "studies"},
        ),
        "facilities": Table(
            supplier.select(F.col("s_suppkey").alias("facility_id"), F.col("s_name").alias("name")),
            "facility_id",
        ),
        "facilities_studies": Table(
            lines.select(*of_line, F.col("l_suppkey").alias("facility_id")),
            None,
            "date",
            {"nct_id": "studies", "facility_id": "facilities"},
        ),
        "conditions": Table(
            part.select(F.col("p_partkey").alias("condition_id"), F.col("p_name").alias("mesh_term")),
            "condition_id",
        ),
        "conditions_studies": Table(
            lines.select(*of_line, F.col("l_partkey").alias("condition_id")),
            None,
            "date",
            {"nct_id": "studies", "condition_id": "conditions"},
        ),
        "sponsors": Table(
            nation.select(F.col("n_nationkey").alias("sponsor_id"), F.col("n_name").alias("name")),
            "sponsor_id",
        ),
        "sponsors_studies": Table(
            orders.join(customer, orders.o_custkey == customer.c_custkey).select(
                F.col("o_orderkey").alias("nct_id"),
                F.col("c_nationkey").alias("sponsor_id"),
                F.col("o_orderdate").alias("date"),
            ),
            None,
            "date",
            {"nct_id": "studies", "sponsor_id": "sponsors"},
        ),
    }
    return Dataset(Database(tables), SHOP_VAL, SHOP_TEST)


# built once per session and folder, so that time bounds are read once for all tasks of a schema
DATASETS: dict[str, Callable[[SparkSession, str], Dataset]] = {
    build.__name__: lru_cache(maxsize=8)(build)
    for build in (shop, classifieds, meetups, racing, fashion, forum, trials)
}

# The same projections in SQL; {first} / {last} are the time bounds of the whole schema.
VIEWS: dict[str, str] = {
    "shop": """
review AS (SELECT o_custkey AS customer_id, l_partkey AS product_id, l_shipdate AS review_time,
  CAST(l_linenumber % 5 + 1 AS DOUBLE) AS rating, l_linestatus = 'F' AS verified,
  repeat(o_orderpriority, CAST(l_quantity AS INTEGER)) AS review_text,
  l_returnflag || ' ' || o_orderpriority AS summary
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
shop_customer AS (SELECT c_custkey AS customer_id, c_name AS customer_name FROM customer),
product AS (SELECT p_partkey AS product_id, p_brand AS brand, p_name AS title, p_type AS category,
  p_retailprice AS price FROM part),
bounds AS (SELECT min(review_time) AS first, max(review_time) AS last FROM review)""",
    "classifieds": """
ev AS (SELECT *, TRY_CAST(regexp_extract(props, '"k": (\\d+)', 1) AS BIGINT) AS ad FROM events),
SearchInfo AS (SELECT event_id AS SearchID, user_id AS UserID, ts AS SearchDate,
  CAST(ad % 5 AS INTEGER) AS CategoryID, CAST(ad % 25 AS INTEGER) AS LocationID FROM ev),
SearchStream AS (SELECT event_id AS SearchID, ad AS AdID, ts AS SearchDate,
  CASE WHEN event_type = 'click' THEN 1.0 ELSE 0.0 END::DOUBLE AS IsClick FROM ev),
VisitStream AS (SELECT user_id AS UserID, ad AS AdID, ts AS ViewDate FROM ev WHERE event_type IN ('view', 'click')),
PhoneRequestsStream AS (SELECT user_id AS UserID, ad AS AdID, ts AS PhoneRequestDate FROM ev WHERE event_type = 'purchase'),
UserInfo AS (SELECT c_custkey AS UserID, c_mktsegment AS Segment FROM customer),
AdsInfo AS (SELECT p_partkey AS AdID, p_name AS Title, p_retailprice AS Price, p_size % 5 AS CategoryID,
  p_size % 25 AS LocationID FROM part),
Category AS (SELECT r_regionkey AS CategoryID, r_name AS CategoryName FROM region),
Location AS (SELECT n_nationkey AS LocationID, n_name AS LocationName FROM nation),
bounds AS (SELECT min(ts) AS first, max(ts) AS last FROM ev)""",
    "meetups": """
users AS (SELECT o_custkey AS user_id, min(o_orderdate) AS joinedAt FROM orders GROUP BY 1),
meetup AS (SELECT o_orderkey AS event_id, o_custkey AS user_id, o_orderdate AS start_time, o_totalprice AS c_1,
  CAST(length(o_orderpriority) AS DOUBLE) AS c_2 FROM orders),
event_attendees AS (SELECT l_orderkey AS event, l_suppkey AS user_id, l_shipdate AS start_time,
  CASE WHEN l_linenumber <= 2 THEN 'yes' WHEN l_linenumber = 3 THEN 'maybe'
       WHEN l_linenumber <= 6 THEN 'invited' ELSE 'no' END AS status FROM lineitem),
event_interest AS (SELECT l_orderkey AS event, l_suppkey AS "user", l_shipdate AS timestamp,
  l_linenumber AS interested FROM lineitem WHERE l_returnflag = 'R'),
user_friends AS (SELECT o_custkey AS "user", l_suppkey AS friend FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
bounds AS (SELECT least((SELECT min(o_orderdate) FROM orders), (SELECT min(l_shipdate) FROM lineitem)) AS first,
  greatest((SELECT max(o_orderdate) FROM orders), (SELECT max(l_shipdate) FROM lineitem)) AS last)""",
    "racing": """
drivers AS (SELECT s_suppkey AS driverId, s_name AS surname FROM supplier),
circuits AS (SELECT n_nationkey AS circuitId, n_name AS name FROM nation),
races AS (SELECT o_orderkey AS raceId, CAST(year(o_orderdate) AS INTEGER) AS year,
  CAST(length(o_orderpriority) AS INTEGER) AS circuitId, o_orderdate AS date FROM orders),
results AS (SELECT l_orderkey AS raceId, l_suppkey AS driverId, l_shipdate AS date, l_linenumber AS positionOrder,
  CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS statusId, l_quantity AS points, l_partkey AS constructorId FROM lineitem),
constructors AS (SELECT p_partkey AS constructorId, p_name AS name, p_brand AS nationality FROM part),
status AS (SELECT DISTINCT CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS statusId, l_returnflag AS status FROM lineitem),
qualifying AS (SELECT l_orderkey AS raceId, l_suppkey AS driverId, l_shipdate - INTERVAL 1 DAY AS date,
  CAST(l_quantity AS INTEGER) AS position FROM lineitem),
standings AS (SELECT l_orderkey AS raceId, l_suppkey AS driverId, l_shipdate AS date, l_extendedprice AS points
  FROM lineitem WHERE l_linestatus = 'F'),
bounds AS (SELECT least((SELECT min(o_orderdate) FROM orders), (SELECT min(l_shipdate) - INTERVAL 1 DAY FROM lineitem)) AS first,
  greatest((SELECT max(o_orderdate) FROM orders), (SELECT max(l_shipdate) FROM lineitem)) AS last)""",
    "fashion": """
transactions AS (SELECT o_orderdate AS t_dat, o_custkey AS customer_id, l_partkey AS article_id,
  l_extendedprice AS price, CASE l_linestatus WHEN 'O' THEN 1 ELSE 2 END AS sales_channel_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
fashion_customer AS (SELECT c_custkey AS customer_id, c_mktsegment AS club_member_status FROM customer),
article AS (SELECT p_partkey AS article_id, p_name AS prod_name FROM part),
bounds AS (SELECT min(t_dat) AS first, max(t_dat) AS last FROM transactions)""",
    "forum": """
line AS (SELECT l_orderkey * 10 + l_linenumber AS Id, l_orderkey AS PostId, l_suppkey AS UserId,
  l_shipdate AS CreationDate, * FROM lineitem),
users AS (SELECT o_custkey AS Id, min(o_orderdate) AS CreationDate FROM orders GROUP BY 1),
posts AS (SELECT o_orderkey AS Id, o_custkey AS OwnerUserId, o_orderdate AS CreationDate,
  CASE o_orderstatus WHEN 'P' THEN 2 ELSE 1 END AS PostTypeId FROM orders),
votes AS (SELECT Id, PostId, UserId, CreationDate, CASE l_returnflag WHEN 'R' THEN 2 ELSE 1 END AS VoteTypeId FROM line),
comments AS (SELECT Id, PostId, UserId, CreationDate, l_returnflag AS Text FROM line WHERE l_linestatus = 'F'),
badges AS (SELECT Id, UserId, CreationDate AS Date FROM line WHERE l_returnflag = 'A'),
postLinks AS (SELECT Id, PostId, l_partkey AS RelatedPostId, CreationDate FROM line),
postHistory AS (SELECT Id, PostId, UserId, CreationDate FROM line WHERE l_linestatus = 'O'),
bounds AS (SELECT least((SELECT min(o_orderdate) FROM orders), (SELECT min(l_shipdate) FROM lineitem)) AS first,
  greatest((SELECT max(o_orderdate) FROM orders), (SELECT max(l_shipdate) FROM lineitem)) AS last)""",
    "trials": """
studies AS (SELECT o_orderkey AS nct_id, o_orderdate AS start_date, o_orderpriority AS phase FROM orders),
outcomes AS (SELECT o_orderkey AS id, o_orderkey AS nct_id,
  CASE o_orderstatus WHEN 'P' THEN 'Secondary' ELSE 'Primary' END AS outcome_type, o_orderdate AS date FROM orders),
outcome_analyses AS (SELECT l_orderkey AS nct_id, l_shipdate AS date, l_orderkey AS outcome_id, l_discount AS p_value,
  CASE l_returnflag WHEN 'A' THEN '>' WHEN 'N' THEN '=' END AS p_value_modifier FROM lineitem),
reported_event_totals AS (SELECT l_orderkey AS nct_id, l_shipdate AS date,
  CASE l_returnflag WHEN 'R' THEN 'serious' WHEN 'A' THEN 'deaths' ELSE 'other' END AS event_type,
  l_quantity AS subjects_affected FROM lineitem),
facilities AS (SELECT s_suppkey AS facility_id, s_name AS name FROM supplier),
facilities_studies AS (SELECT l_orderkey AS nct_id, l_shipdate AS date, l_suppkey AS facility_id FROM lineitem),
conditions AS (SELECT p_partkey AS condition_id, p_name AS mesh_term FROM part),
conditions_studies AS (SELECT l_orderkey AS nct_id, l_shipdate AS date, l_partkey AS condition_id FROM lineitem),
sponsors AS (SELECT n_nationkey AS sponsor_id, n_name AS name FROM nation),
sponsors_studies AS (SELECT o_orderkey AS nct_id, c_nationkey AS sponsor_id, o_orderdate AS date
  FROM orders JOIN customer ON o_custkey = c_custkey),
bounds AS (SELECT least((SELECT min(o_orderdate) FROM orders), (SELECT min(l_shipdate) FROM lineitem)) AS first,
  greatest((SELECT max(o_orderdate) FROM orders), (SELECT max(l_shipdate) FROM lineitem)) AS last)""",
}


def anchors_sql(days: int, evals: int, events: bool) -> str:
    """CTE ``anchors(split, timestamp)`` derived from the time bounds, as the splits define it."""
    val, test = (EVENT_VAL, EVENT_TEST) if events else (SHOP_VAL, SHOP_TEST)
    v, t, d = f"TIMESTAMP '{val}'", f"TIMESTAMP '{test}'", f"INTERVAL {days} DAY"
    steps = f"generate_series(0, {max(evals, 4000)})"
    return f"""
anchors AS (
  SELECT 'train' AS split, {v} - {days} * (k + 1) * INTERVAL 1 DAY AS timestamp
  FROM {steps} AS s(k), bounds WHERE {v} - {days} * (k + 1) * INTERVAL 1 DAY >= bounds.first
  UNION ALL
  SELECT 'val', {v} + {days} * k * INTERVAL 1 DAY FROM {steps} AS s(k)
  WHERE k < {evals} AND {v} + {days} * k * INTERVAL 1 DAY <= {t} - {d}
  UNION ALL
  SELECT 'test', {t} + {days} * k * INTERVAL 1 DAY FROM {steps} AS s(k), bounds
  WHERE k < {evals} AND {t} + {days} * k * INTERVAL 1 DAY <= bounds.last - {d})"""
