"""One query per prediction task: its labels for all three splits over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronograin.plans.catalog import TASKS
from chronograin.plans.task import all_splits
from chronograin.queries import Book, Query
from chronograin.queries.databases import DATASETS, SHOP_TEST, VIEWS, anchors_sql

BOOK = Book()

# decimals that make sums of doubles independent of their order
ROUNDED = {"ltv": 2, "sales": 2, "position": 6, "success_rate": 6}
ROUNDED_IN = {("classifieds", "ad-ctr"): ("num_click", 6)}


def label_query(schema: str, name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = all_splits(TASKS[schema][name], DATASETS[schema](spark, sf_dir))
        digits = dict(ROUNDED)
        if (schema, name) in ROUNDED_IN:
            col, n = ROUNDED_IN[schema, name]
            digits[col] = n
        return out.withColumns({c: F.round(c, n) for c, n in digits.items() if c in out.columns})

    return run


def label_sql(schema: str, name: str, body: str) -> str:
    task = TASKS[schema][name]
    anchors = anchors_sql(task.delta.days, task.evals, schema == "classifieds")
    return f"WITH {VIEWS[schema].strip()},\n{anchors.strip()},\n{body.strip()}"


def in_window(days: int, time: str) -> str:
    return f"{time} > timestamp AND {time} <= timestamp + INTERVAL {days} DAY"


def in_lookback(days: int, time: str) -> str:
    return f"{time} > timestamp - INTERVAL {days} DAY AND {time} <= timestamp"


def _churn_sql(facts: str, key: str, time: str, entity: str, days: int) -> str:
    return f"""
before AS (SELECT DISTINCT split, timestamp, {key} FROM anchors JOIN {facts} ON {in_lookback(days, time)}),
after AS (SELECT DISTINCT split, timestamp, {key} FROM anchors JOIN {facts} ON {in_window(days, time)})
SELECT b.split, b.timestamp, b.{key}, CASE WHEN a.{key} IS NULL THEN 1 ELSE 0 END AS churn
FROM before b LEFT JOIN after a ON a.split = b.split AND a.timestamp = b.timestamp AND a.{key} = b.{key}
WHERE b.{key} IN (SELECT {key} FROM {entity})"""


def _pairs_sql(facts: str, src: str, dst: str, time: str, days: int, known: str, where: str = "TRUE") -> str:
    return f"""
facts AS (SELECT * FROM {facts} WHERE {where})
SELECT DISTINCT split, timestamp, {src}, {dst} FROM anchors JOIN facts ON {in_window(days, time)}
WHERE {known}"""


_SHOP_KNOWN = "customer_id IN (SELECT customer_id FROM shop_customer) AND product_id IN (SELECT product_id FROM product)"
_USER_AS_OF = f"(SELECT user_id FROM users WHERE joinedAt <= TIMESTAMP '{SHOP_TEST}')"
_FORUM_USER = f"(SELECT Id FROM users WHERE CreationDate <= TIMESTAMP '{SHOP_TEST}')"
_FORUM_POST = f"(SELECT Id FROM posts WHERE CreationDate <= TIMESTAMP '{SHOP_TEST}')"
_STUDY = f"(SELECT nct_id FROM studies WHERE start_date <= TIMESTAMP '{SHOP_TEST}')"

_SPONSOR_RUN = """
pairs AS (SELECT DISTINCT split, timestamp, {col}, sponsor_id FROM anchors
  JOIN {links} l ON l.date > timestamp AND l.date <= timestamp + INTERVAL 365 DAY
  JOIN sponsors_studies s ON s.nct_id = l.nct_id)
SELECT * FROM pairs WHERE {col} IS NOT NULL AND sponsor_id IS NOT NULL"""

_TRIAL_INFO = """
usable AS (SELECT a.nct_id, a.p_value, a.date, o.nct_id AS study FROM outcome_analyses a
  JOIN outcomes o ON a.outcome_id = o.id AND o.outcome_type = 'Primary'
  WHERE (a.p_value_modifier IS NULL OR a.p_value_modifier <> '>') AND a.p_value BETWEEN 0 AND 1)"""

SQL: dict[tuple[str, str], str] = {
    ("shop", "user-churn"): _churn_sql("review", "customer_id", "review_time", "shop_customer", 91),
    ("shop", "item-churn"): _churn_sql("review", "product_id", "review_time", "product", 91),
    ("shop", "user-ltv"): f"""
before AS (SELECT DISTINCT split, timestamp, customer_id FROM anchors JOIN review ON {in_lookback(91, "review_time")}),
after AS (SELECT split, timestamp, customer_id, sum(price) AS paid FROM anchors
  JOIN review ON {in_window(91, "review_time")} JOIN product ON product.product_id = review.product_id GROUP BY ALL)
SELECT b.split, b.timestamp, b.customer_id, round(coalesce(paid, 0), 2) AS ltv FROM before b
LEFT JOIN after a ON a.split = b.split AND a.timestamp = b.timestamp AND a.customer_id = b.customer_id
WHERE b.customer_id IN (SELECT customer_id FROM shop_customer)""",
    ("shop", "item-ltv"): f"""
sold AS (SELECT product_id, review_time, price FROM review JOIN product USING (product_id))
SELECT split, timestamp, product_id, round(coalesce(sum(price), 0), 2) AS ltv
FROM anchors JOIN sold ON {in_window(91, "review_time")} GROUP BY split, timestamp, product_id""",
    ("shop", "user-item-purchase"): _pairs_sql("review", "customer_id", "product_id", "review_time", 91, _SHOP_KNOWN),
    ("shop", "user-item-rate"): _pairs_sql(
        "review", "customer_id", "product_id", "review_time", 91, _SHOP_KNOWN, "rating = 5"
    ),
    ("shop", "user-item-review"): _pairs_sql(
        "review", "customer_id", "product_id", "review_time", 91, _SHOP_KNOWN, "length(review_text) > 300"
    ),
    ("classifieds", "ad-ctr"): f"""
shown AS (SELECT s.* FROM SearchStream s JOIN AdsInfo i ON i.AdID = s.AdID)
SELECT split, timestamp, AdID, round(sum(IsClick) / count(SearchID), 6) AS num_click
FROM anchors JOIN shown ON {in_window(4, "SearchDate")}
GROUP BY split, timestamp, AdID HAVING sum(IsClick) > 0""",
    ("classifieds", "user-visits"): f"""
known AS (SELECT v.* FROM VisitStream v JOIN UserInfo u ON u.UserID = v.UserID)
SELECT split, timestamp, UserID, count(DISTINCT AdID) > 1 AS num_click
FROM anchors JOIN known ON {in_window(4, "ViewDate")} GROUP BY split, timestamp, UserID""",
    ("classifieds", "user-clicks"): f"""
known AS (SELECT i.UserID, i.SearchDate AS done_at, s.AdID FROM SearchInfo i JOIN UserInfo u ON u.UserID = i.UserID
  LEFT JOIN SearchStream s ON s.SearchID = i.SearchID AND s.IsClick = 1)
SELECT split, timestamp, UserID, count(AdID) > 1 AS num_click
FROM anchors JOIN known ON {in_window(4, "done_at")} GROUP BY split, timestamp, UserID""",
    ("classifieds", "user-ad-visit"): _pairs_sql(
        "VisitStream", "UserID", "AdID", "ViewDate", 4,
        "UserID IN (SELECT UserID FROM UserInfo) AND AdID IN (SELECT AdID FROM AdsInfo)",
    ),
    ("meetups", "user-attendance"): f"""
per_user AS (SELECT split, timestamp, user_id AS "user",
  CAST(count(*) FILTER (status IN ('yes', 'maybe')) AS BIGINT) AS target
  FROM anchors JOIN event_attendees ON {in_window(7, "start_time")} GROUP BY split, timestamp, user_id)
SELECT * FROM per_user WHERE "user" IN {_USER_AS_OF}""",
    ("meetups", "user-repeat"): f"""
longer AS (SELECT split, timestamp FROM anchors
  UNION ALL SELECT split, timestamp - k * INTERVAL 7 DAY FROM anchors, (VALUES (1), (2)) AS s(k) WHERE split <> 'train'),
active AS (SELECT split, timestamp, user_id AS "user", max(CASE WHEN status IN ('yes', 'maybe') THEN 1 ELSE 0 END) AS target
  FROM longer JOIN event_attendees ON {in_window(7, "start_time")} GROUP BY split, timestamp, user_id),
flagged AS (SELECT *, max(target) OVER (PARTITION BY split, "user" ORDER BY timestamp ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS prev
  FROM active)
SELECT f.split, f.timestamp, f."user", f.target FROM flagged f
JOIN anchors a ON a.split = f.split AND a.timestamp = f.timestamp
WHERE prev = 1 AND f."user" IN {_USER_AS_OF}""",
    ("meetups", "user-ignore"): f"""
per_user AS (SELECT split, timestamp, user_id AS "user",
  CASE WHEN count(*) FILTER (status = 'invited') > 2 THEN 1 ELSE 0 END AS target
  FROM anchors JOIN event_attendees ON {in_window(7, "start_time")} GROUP BY split, timestamp, user_id)
SELECT * FROM per_user WHERE "user" IN {_USER_AS_OF}""",
    ("racing", "driver-position"): f"""
known AS (SELECT r.* FROM results r JOIN drivers d ON d.driverId = r.driverId)
SELECT split, timestamp, driverId, round(avg(positionOrder), 6) AS position
FROM anchors JOIN known ON {in_window(60, "date")} GROUP BY split, timestamp, driverId""",
    ("racing", "driver-dnf"): f"""
known AS (SELECT r.* FROM results r JOIN drivers d ON d.driverId = r.driverId)
SELECT split, timestamp, driverId, max(CASE WHEN statusId <> 1 THEN 1 ELSE 0 END) AS did_not_finish
FROM anchors JOIN known ON {in_window(30, "date")} GROUP BY split, timestamp, driverId""",
    ("racing", "driver-top3"): f"""
known AS (SELECT q.* FROM qualifying q JOIN drivers d ON d.driverId = q.driverId)
SELECT split, timestamp, driverId, CAST(min(position) <= 3 AS BIGINT) AS qualifying
FROM anchors JOIN known ON {in_window(30, "date")} GROUP BY split, timestamp, driverId""",
    ("fashion", "user-item-purchase"): _pairs_sql(
        "transactions", "customer_id", "article_id", "t_dat", 7,
        "customer_id IN (SELECT customer_id FROM fashion_customer) AND article_id IN (SELECT article_id FROM article)",
    ),
    ("fashion", "user-churn"): _churn_sql("transactions", "customer_id", "t_dat", "fashion_customer", 7),
    ("fashion", "item-sales"): f"""
sold AS (SELECT split, timestamp, article_id, sum(price) AS paid FROM anchors
  JOIN transactions ON {in_window(7, "t_dat")} GROUP BY split, timestamp, article_id)
SELECT a.split, a.timestamp, i.article_id, round(coalesce(paid, 0), 2) AS sales FROM anchors a CROSS JOIN article i
LEFT JOIN sold s ON s.split = a.split AND s.timestamp = a.timestamp AND s.article_id = i.article_id""",
    ("forum", "user-engagement"): f"""
made AS (SELECT OwnerUserId AS u, CreationDate AS done_at FROM posts UNION ALL SELECT UserId, CreationDate FROM votes
  UNION ALL SELECT UserId, CreationDate FROM comments),
began AS (SELECT DISTINCT split, timestamp, u FROM anchors JOIN made ON done_at <= timestamp),
after AS (SELECT DISTINCT split, timestamp, u FROM anchors JOIN made ON {in_window(91, "done_at")})
SELECT b.split, b.timestamp, b.u AS OwnerUserId, CASE WHEN a.u IS NULL THEN 0 ELSE 1 END AS contribution
FROM began b LEFT JOIN after a ON a.split = b.split AND a.timestamp = b.timestamp AND a.u = b.u
WHERE b.u <> -1 AND b.u IN {_FORUM_USER}""",
    ("forum", "post-votes"): f"""
existing AS (SELECT split, timestamp, Id AS PostId FROM anchors
  JOIN posts ON CreationDate <= timestamp AND PostTypeId = 1 AND OwnerUserId <> -1),
up AS (SELECT split, timestamp, PostId, count(DISTINCT Id) AS n FROM anchors
  JOIN votes ON VoteTypeId = 2 AND {in_window(91, "CreationDate")} GROUP BY split, timestamp, PostId)
SELECT e.split, e.timestamp, e.PostId, coalesce(n, 0) AS popularity FROM existing e
LEFT JOIN up ON up.split = e.split AND up.timestamp = e.timestamp AND up.PostId = e.PostId
WHERE e.PostId IN {_FORUM_POST}""",
    ("forum", "user-badge"): f"""
existing AS (SELECT split, timestamp, Id AS UserId FROM anchors JOIN users ON CreationDate <= timestamp),
won AS (SELECT DISTINCT split, timestamp, UserId FROM anchors JOIN badges ON {in_window(91, "badges.Date")})
SELECT e.split, e.timestamp, e.UserId, CASE WHEN w.UserId IS NULL THEN 0 ELSE 1 END AS WillGetBadge FROM existing e
LEFT JOIN won w ON w.split = e.split AND w.timestamp = e.timestamp AND w.UserId = e.UserId
WHERE e.UserId IN {_FORUM_USER}""",
    ("forum", "user-post-comment"): f"""
on_owned AS (SELECT c.UserId, c.PostId, c.CreationDate AS done_at, p.CreationDate AS created FROM comments c
  JOIN posts p ON p.Id = c.PostId WHERE p.OwnerUserId <> -1)
SELECT DISTINCT split, timestamp, UserId, PostId FROM anchors
JOIN on_owned ON created <= timestamp AND {in_window(91, "done_at")}
WHERE UserId IN {_FORUM_USER} AND PostId IN {_FORUM_POST}""",
    ("forum", "post-post-related"): f"""
linked AS (SELECT l.PostId, l.RelatedPostId, l.CreationDate AS done_at, p.CreationDate AS c1, r.CreationDate AS c2
  FROM postLinks l JOIN posts p ON p.Id = l.PostId JOIN posts r ON r.Id = l.RelatedPostId)
SELECT DISTINCT split, timestamp, PostId, RelatedPostId AS postLinksIdList FROM anchors
JOIN linked ON c1 <= timestamp AND c2 <= timestamp AND {in_window(91, "done_at")}
WHERE PostId IN {_FORUM_POST} AND RelatedPostId IN {_FORUM_POST}""",
    ("trials", "study-outcome"): f"""{_TRIAL_INFO.strip()},
begun AS (SELECT u.*, s.start_date FROM usable u JOIN studies s ON s.nct_id = u.study)
SELECT split, timestamp, nct_id, CASE WHEN min(p_value) <= 0.05 THEN 1 ELSE 0 END AS outcome
FROM anchors JOIN begun ON start_date <= timestamp AND {in_window(365, "date")}
WHERE nct_id IN {_STUDY} GROUP BY split, timestamp, nct_id""",
    ("trials", "study-adverse"): f"""
severe AS (SELECT r.*, s.start_date FROM reported_event_totals r JOIN studies s ON s.nct_id = r.nct_id
  WHERE event_type IN ('serious', 'deaths') AND subjects_affected IS NOT NULL)
SELECT split, timestamp, nct_id, sum(subjects_affected) AS num_of_adverse_events
FROM anchors JOIN severe ON start_date <= timestamp AND {in_window(365, "date")}
WHERE nct_id IN {_STUDY} GROUP BY split, timestamp, nct_id""",
    ("trials", "site-success"): f"""{_TRIAL_INFO.strip()},
won AS (SELECT nct_id, date, min(CASE WHEN p_value < 0.05 THEN 1 ELSE 0 END) AS ok FROM usable GROUP BY nct_id, date),
at_site AS (SELECT f.facility_id, w.date, w.ok FROM won w JOIN facilities_studies f ON f.nct_id = w.nct_id)
SELECT split, timestamp, facility_id, round(sum(ok) / count(ok), 6) AS success_rate
FROM anchors JOIN at_site ON {in_window(365, "date")} GROUP BY split, timestamp, facility_id""",
    ("trials", "condition-sponsor-run"): _SPONSOR_RUN.format(col="condition_id", links="conditions_studies"),
    ("trials", "site-sponsor-run"): _SPONSOR_RUN.format(col="facility_id", links="facilities_studies"),
}

for _schema, _tasks in TASKS.items():
    for _name in _tasks:
        BOOK.add(
            f"label_{_schema}_{_name.replace('-', '_')}",
            label_query(_schema, _name),
            label_sql(_schema, _name, SQL[_schema, _name]),
        )

__all__ = ["BOOK", "label_query"]
