"""Nested documents over the mapped schemas: JSON text equal to the SQL twin's, byte by byte."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronograin.operators import documents
from chronograin.queries import Book, read
from chronograin.queries.databases import DATASETS, VIEWS
from chronograin.queries.labels import BOOK as LABELS

BOOK = Book()


def _query(schema, build):
    def run(spark, sf_dir):
        return build(DATASETS[schema](spark, sf_dir).full_db)

    return run


def _t(col: str) -> str:
    return f"strftime({col}, '%Y-%m-%d %H:%M:%S')"


_MAIN = "'' AS section, 0::BIGINT AS part"
_REVIEW = f"""review_text: r.review_text, summary: r.summary, review_time: {_t("r.review_time")}, rating: r.rating, verified: r.verified"""
_PRODUCT = "{product_id: r.product_id, title: p.title, brand: p.brand, price: p.price, category: p.category}"

BOOK.add(
    "document_customer",
    _query("shop", documents.customer_documents),
    f"""WITH {VIEWS["shop"].strip()}, i AS (SELECT r.customer_id, {{{_REVIEW}, product: {_PRODUCT}}} AS item, r.review_time AS t, r.product_id AS p
      FROM review r LEFT JOIN product p ON p.product_id = r.product_id),
    l AS (SELECT customer_id, list(item ORDER BY t, p, item) AS reviews FROM i GROUP BY customer_id)
    SELECT customer_id::VARCHAR AS key, {_MAIN}, to_json({{customer_id: l.customer_id, customer_name: c.customer_name, reviews: reviews}})::VARCHAR AS doc
    FROM l LEFT JOIN shop_customer c USING (customer_id)""",
)

BOOK.add(
    "document_item",
    _query("shop", documents.item_documents),
    f"""WITH {VIEWS["shop"].strip()}, i AS (SELECT r.product_id, {{{_REVIEW}, customer: {{customer_id: r.customer_id, customer_name: c.customer_name}}}} AS item,
      r.review_time AS t, r.customer_id AS c FROM review r LEFT JOIN shop_customer c ON c.customer_id = r.customer_id),
    l AS (SELECT product_id, list(item ORDER BY t, c, item) AS reviews FROM i GROUP BY product_id)
    SELECT product_id::VARCHAR AS key, {_MAIN}, to_json({{product_id: l.product_id, title: title, brand: brand, price: price,
      category: category, reviews: reviews}})::VARCHAR AS doc FROM l LEFT JOIN product USING (product_id)""",
)


@BOOK.query(
    "document_labelled_cutoff",
    f"""WITH lab AS ({LABELS.sql["label_shop_user_churn"]}), {VIEWS["shop"].strip()},
    i AS (SELECT lab.customer_id, lab.timestamp, {{{_REVIEW}, product: {_PRODUCT}}} AS item, r.review_time AS t, r.product_id AS p FROM lab
      JOIN review r ON r.customer_id = lab.customer_id AND r.review_time <= lab.timestamp LEFT JOIN product p ON p.product_id = r.product_id),
    l AS (SELECT customer_id, timestamp, list(item ORDER BY t, p, item) AS reviews FROM i GROUP BY ALL)
    SELECT l.customer_id || '|' || strftime(l.timestamp, '%Y-%m-%d %H:%M:%S') AS key, {_MAIN}, to_json({{customer_id: l.customer_id,
      customer_name: c.customer_name, timestamp: {_t("l.timestamp")}, label: churn, reviews: reviews}})::VARCHAR AS doc
    FROM l JOIN lab ON lab.customer_id = l.customer_id AND lab.timestamp = l.timestamp JOIN shop_customer c ON c.customer_id = l.customer_id""",
)
def document_labelled_cutoff(spark, sf_dir):
    """Labels of all splits, each with the customer's history up to its time."""
    labels = LABELS.queries["label_shop_user_churn"](spark, sf_dir)
    return documents.labelled_documents(DATASETS["shop"](spark, sf_dir).full_db, labels, "churn")


_AD = """{{AdID: a.AdID, Title: a.Title, Price: a.Price, CategoryID: a.CategoryID, LocationID: a.LocationID,
  ad_location: {{LocationName: al.LocationName}}, ad_category: {{CategoryName: ac.CategoryName}}}}"""
_AD_FROM = """JOIN AdsInfo a ON a.AdID = {on}.AdID JOIN Location al ON al.LocationID = a.LocationID JOIN Category ac ON ac.CategoryID = a.CategoryID"""


def _ad_list(table: str, time: str, name: str) -> str:
    return f"""(SELECT s.UserID, list({{UserID: s.UserID, AdID: s.AdID, {time}: {_t("s." + time)}, {name}: {_AD.format()}}} ORDER BY s.{time}, s.AdID) AS items
      FROM {table} s {_AD_FROM.format(on="s")} GROUP BY s.UserID)"""


BOOK.add(
    "document_classifieds_user",
    _query("classifieds", documents.classifieds_user_documents),
    f"""WITH {VIEWS["classifieds"].strip()},
    res AS (SELECT s.SearchID, list({{SearchID: s.SearchID, AdID: s.AdID, SearchDate: {_t("s.SearchDate")}, IsClick: s.IsClick, ad_shown: {_AD.format()}}}
      ORDER BY s.SearchDate, s.AdID) AS shown FROM SearchStream s {_AD_FROM.format(on="s")} GROUP BY s.SearchID),
    sea AS (SELECT s.UserID, list({{SearchID: s.SearchID, UserID: s.UserID, SearchDate: {_t("s.SearchDate")}, CategoryID: s.CategoryID,
      LocationID: s.LocationID, search_location: {{LocationName: l.LocationName}}, search_category: {{CategoryName: c.CategoryName}},
      search_results_shown: coalesce(shown, [])}} ORDER BY s.SearchDate, s.SearchID) AS items
      FROM SearchInfo s JOIN Location l ON l.LocationID = s.LocationID JOIN Category c ON c.CategoryID = s.CategoryID
      LEFT JOIN res ON res.SearchID = s.SearchID GROUP BY s.UserID)
    SELECT u.UserID::VARCHAR AS key, {_MAIN}, to_json({{UserID: u.UserID, Segment: u.Segment, search_history: coalesce(sea.items, []),
      ad_visits: coalesce(v.items, []), phone_requests: coalesce(ph.items, [])}})::VARCHAR AS doc FROM UserInfo u
    LEFT JOIN sea ON sea.UserID = u.UserID LEFT JOIN {_ad_list("VisitStream", "ViewDate", "ad_viewed")} v ON v.UserID = u.UserID
    LEFT JOIN {_ad_list("PhoneRequestsStream", "PhoneRequestDate", "ad_requested")} ph ON ph.UserID = u.UserID""",
)

BOOK.add(
    "document_meetup_user",
    _query("meetups", documents.meetup_user_documents),
    f"""WITH {VIEWS["meetups"].strip()},
    att AS (SELECT event, list({{event: event, user_id: user_id, start_time: {_t("start_time")}, status: status}} ORDER BY start_time, user_id, status) AS items
      FROM event_attendees GROUP BY event),
    intr AS (SELECT event, list({{event: event, "user": "user", timestamp: {_t("timestamp")}, interested: interested}} ORDER BY timestamp, "user", interested) AS items
      FROM event_interest GROUP BY event),
    cre AS (SELECT m.user_id, list({{event_id: m.event_id, user_id: m.user_id, start_time: {_t("m.start_time")}, c_vector: [c_1, c_2],
      attendees: coalesce(att.items, []), interest_shown: coalesce(intr.items, [])}} ORDER BY m.start_time, m.event_id) AS items
      FROM meetup m LEFT JOIN att ON att.event = m.event_id LEFT JOIN intr ON intr.event = m.event_id GROUP BY m.user_id),
    fr AS (SELECT "user", list(friend ORDER BY friend) AS items FROM user_friends GROUP BY "user"),
    a1 AS (SELECT user_id AS u, event AS e, {{start_time: {_t("start_time")}, status: status}} AS attended FROM event_attendees
      QUALIFY row_number() OVER (PARTITION BY user_id, event ORDER BY start_time, status) = 1),
    i1 AS (SELECT "user" AS u, event AS e, {{timestamp: {_t("timestamp")}, interested: interested}} AS interest FROM event_interest
      QUALIFY row_number() OVER (PARTITION BY "user", event ORDER BY timestamp, interested) = 1),
    eng AS (SELECT a1.u, list({{user_engagement_details: {{attended: attended, interest: interest}}, event: CASE WHEN m.event_id IS NULL THEN NULL ELSE
      {{user_id: m.user_id, start_time: {_t("m.start_time")}, c_vector: [c_1, c_2]}} END}} ORDER BY a1.e) AS items
      FROM a1 LEFT JOIN i1 ON i1.u = a1.u AND i1.e = a1.e LEFT JOIN meetup m ON m.event_id = a1.e
      WHERE m.user_id IS DISTINCT FROM a1.u GROUP BY a1.u)
    SELECT u.user_id::VARCHAR AS key, {_MAIN}, to_json({{user_id: u.user_id, joinedAt: {_t("u.joinedAt")}, friends: coalesce(fr.items, []),
      events_created: coalesce(cre.items, []), event_engagements: coalesce(eng.items, [])}})::VARCHAR AS doc FROM users u
    LEFT JOIN fr ON fr."user" = u.user_id LEFT JOIN cre ON cre.user_id = u.user_id LEFT JOIN eng ON eng.u = u.user_id""",
)

BOOK.add(
    "document_driver",
    _query("racing", documents.driver_documents),
    f"""WITH {VIEWS["racing"].strip()},
    q AS (SELECT raceId, driverId, {{date: {_t("date")}, position: position}} AS v FROM qualifying QUALIFY row_number() OVER (PARTITION BY raceId, driverId ORDER BY date, position) = 1),
    s AS (SELECT raceId, driverId, {{date: {_t("date")}, points: points}} AS v FROM standings QUALIFY row_number() OVER (PARTITION BY raceId, driverId ORDER BY date, points) = 1),
    st AS (SELECT r.driverId, r.raceId, ra.year, {{race: {{year: ra.year, circuitId: ra.circuitId, date: {_t("ra.date")}, name: c.name}},
      driver_performance: {{constructor: CASE WHEN co.constructorId IS NULL THEN NULL ELSE {{name: co.name, nationality: co.nationality}} END,
      qualifying: q.v, result: {{date: {_t("r.date")}, positionOrder: positionOrder, statusId: r.statusId, points: points, constructorId: r.constructorId,
        status: {{statusId: r.statusId, status: stat.status}}}},
      championship_standing: s.v}}}} AS item FROM results r JOIN races ra ON ra.raceId = r.raceId LEFT JOIN circuits c ON c.circuitId = ra.circuitId
      LEFT JOIN constructors co ON co.constructorId = r.constructorId LEFT JOIN status stat ON stat.statusId = r.statusId
      LEFT JOIN q ON q.raceId = r.raceId AND q.driverId = r.driverId LEFT JOIN s ON s.raceId = r.raceId AND s.driverId = r.driverId),
    se AS (SELECT driverId, year, list(item ORDER BY raceId, item) AS races FROM st GROUP BY driverId, year),
    l AS (SELECT driverId, list({{year: year, races: races}} ORDER BY year) AS seasons FROM se GROUP BY driverId)
    SELECT d.driverId::VARCHAR AS key, {_MAIN}, to_json({{driverId: d.driverId, surname: surname, seasons: coalesce(seasons, [])}})::VARCHAR AS doc
    FROM drivers d LEFT JOIN l ON l.driverId = d.driverId""",
)

BOOK.add(
    "document_purchase",
    _query("fashion", documents.purchase_documents),
    f"""WITH {VIEWS["fashion"].strip()},
    l AS (SELECT t.customer_id, list({{transaction_date: {_t("t.t_dat")}, price: t.price, sales_channel_id: t.sales_channel_id,
      article_purchased: {{prod_name: a.prod_name}}}} ORDER BY t.t_dat, t.article_id, t.price, t.sales_channel_id) AS items
      FROM transactions t JOIN article a ON a.article_id = t.article_id GROUP BY t.customer_id)
    SELECT c.customer_id::VARCHAR AS key, {_MAIN}, to_json({{customer_id: c.customer_id, club_member_status: club_member_status,
      purchase_history: coalesce(items, [])}})::VARCHAR AS doc FROM fashion_customer c LEFT JOIN l ON l.customer_id = c.customer_id""",
)


def _post_list(table: str, fields: str, name: str, where: str = "PostId") -> str:
    return f"""{name}_l AS (SELECT {where} AS k, list({{{fields}}} ORDER BY CreationDate, Id, {{{fields}}}) AS items FROM {table} GROUP BY {where})"""


_CD = _t("CreationDate")
BOOK.add(
    "document_forum_user",
    _query("forum", documents.forum_user_documents),
    f"""WITH {VIEWS["forum"].strip()},
    {_post_list("comments", f"Id: Id, UserId: UserId, CreationDate: {_CD}, Text: Text", "co")},
    {_post_list("votes", f"Id: Id, UserId: UserId, CreationDate: {_CD}, VoteTypeId: VoteTypeId", "vo")},
    {_post_list("postHistory", f"Id: Id, UserId: UserId, CreationDate: {_CD}", "hi")},
    {_post_list("postLinks", f"Id: Id, RelatedPostId: RelatedPostId, CreationDate: {_CD}", "li")},
    po AS (SELECT OwnerUserId AS k, list({{Id: Id, CreationDate: {_CD}, PostTypeId: PostTypeId, comments: coalesce(co_l.items, []),
      votes: coalesce(vo_l.items, []), post_history: coalesce(hi_l.items, []), post_links: coalesce(li_l.items, [])}} ORDER BY CreationDate, Id) AS items
      FROM posts LEFT JOIN co_l ON co_l.k = Id LEFT JOIN vo_l ON vo_l.k = Id LEFT JOIN hi_l ON hi_l.k = Id LEFT JOIN li_l ON li_l.k = Id GROUP BY OwnerUserId),
    ba AS (SELECT UserId AS k, list({{Id: Id, Date: {_t("Date")}}} ORDER BY Date, Id) AS items FROM badges GROUP BY UserId),
    {_post_list("comments", f"Id: Id, PostId: PostId, CreationDate: {_CD}, Text: Text", "uc", "UserId")},
    {_post_list("votes", f"Id: Id, PostId: PostId, CreationDate: {_CD}, VoteTypeId: VoteTypeId", "uv", "UserId")}
    SELECT u.Id::VARCHAR AS key, {_MAIN}, to_json({{Id: u.Id, CreationDate: {_t("u.CreationDate")}, posts: coalesce(po.items, []),
      badges: coalesce(ba.items, []), user_comments: coalesce(uc_l.items, []), user_votes: coalesce(uv_l.items, [])}})::VARCHAR AS doc
    FROM users u LEFT JOIN po ON po.k = u.Id LEFT JOIN ba ON ba.k = u.Id LEFT JOIN uc_l ON uc_l.k = u.Id LEFT JOIN uv_l ON uv_l.k = u.Id""",
)


def _many(name: str, key: str, label: str) -> str:
    return f"""{name}_l AS (SELECT nct_id AS k, list({{{key}: x.{key}, date: {_t("x.date")}, {label}: d.{label}}} ORDER BY x.date, x.{key}) AS items
      FROM {name}_studies x JOIN {name} d ON d.{key} = x.{key} GROUP BY nct_id)"""


BOOK.add(
    "document_study",
    _query("trials", documents.study_documents),
    f"""WITH {VIEWS["trials"].strip()}, {_many("sponsors", "sponsor_id", "name")}, {_many("facilities", "facility_id", "name")},
    {_many("conditions", "condition_id", "mesh_term")},
    an AS (SELECT outcome_id AS k, list({{nct_id: nct_id, date: {_t("date")}, p_value: p_value, p_value_modifier: p_value_modifier}}
      ORDER BY date, p_value, p_value_modifier NULLS FIRST) AS items FROM outcome_analyses GROUP BY outcome_id),
    ou AS (SELECT nct_id AS k, list({{id: id, outcome_type: outcome_type, date: {_t("date")}, analyses: coalesce(an.items, [])}} ORDER BY id) AS items
      FROM outcomes LEFT JOIN an ON an.k = id GROUP BY nct_id),
    ev AS (SELECT nct_id AS k, list({{date: {_t("date")}, event_type: event_type, subjects_affected: subjects_affected}}
      ORDER BY date, event_type, subjects_affected) AS items FROM reported_event_totals GROUP BY nct_id)
    SELECT s.nct_id::VARCHAR AS key, {_MAIN}, to_json({{nct_id: s.nct_id, start_date: {_t("start_date")}, phase: phase,
      sponsors: coalesce(sponsors_l.items, []), facilities: coalesce(facilities_l.items, []), conditions: coalesce(conditions_l.items, []),
      outcomes: coalesce(ou.items, []), reported_event_totals: coalesce(ev.items, [])}})::VARCHAR AS doc FROM studies s
    LEFT JOIN sponsors_l ON sponsors_l.k = s.nct_id LEFT JOIN facilities_l ON facilities_l.k = s.nct_id
    LEFT JOIN conditions_l ON conditions_l.k = s.nct_id LEFT JOIN ou ON ou.k = s.nct_id LEFT JOIN ev ON ev.k = s.nct_id""",
)


@BOOK.query(
    "sample_task_and_objects",
    f"""WITH lab AS ({LABELS.sql["label_shop_user_churn"]}),
    n AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY timestamp, customer_id) AS n FROM lab),
    ids AS (SELECT DISTINCT customer_id FROM n WHERE (split = 'train' AND n <= 200) OR (split <> 'train' AND n <= 50))
    SELECT c_custkey AS customer_id, c_name, c_mktsegment FROM customer WHERE c_custkey IN (SELECT customer_id FROM ids)""",
)
def sample_task_and_objects(spark, sf_dir):
    """Entities of the first rows of each split: the limits are the feature."""
    labels = LABELS.queries["label_shop_user_churn"](spark, sf_dir)
    sizes = {"train": 200, "val": 50, "test": 50}
    tables = [(labels.where(F.col("split") == s), n) for s, n in sizes.items()]
    ids = documents.sampled_ids(tables, "customer_id", ["timestamp", "customer_id"])
    customers = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer_id"), "c_name", "c_mktsegment")
    return documents.documents_of(customers, ids, "customer_id", "c_name")


@BOOK.query(
    "nested_collect",
    """WITH t AS (SELECT conv_id, list({turn: turn, role: role, text: text} ORDER BY turn, role, text) AS turns FROM conversations GROUP BY conv_id)
    SELECT conv_id::VARCHAR AS key, '' AS section, 0::BIGINT AS part, to_json({conv_id: conv_id, turns: turns})::VARCHAR AS doc FROM t""",
)
def nested_collect(spark, sf_dir):
    """Conversations with their turns."""
    nest = documents.Nest()
    turns = read(spark, sf_dir, "conversations")
    lists = nest.lists(turns, ["conv_id"], F.struct("turn", "role", "text"), ["turn"], "turns")
    return nest.documents(lists, ["conv_id"], [F.col("conv_id"), F.col("turns")])
