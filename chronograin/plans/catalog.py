"""The thirty prediction tasks, by database schema and task name."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronograin.grid import Grid
from chronograin.model import Database, TaskKind
from chronograin.operators import windows
from chronograin.operators.windows import ANCHOR
from chronograin.plans.task import EntityTask, LinkTask, Task

BINARY_METRICS = ("average_precision", "accuracy", "f1", "roc_auc")
REGRESSION_METRICS = ("r2", "mae", "rmse")
LINK_METRICS = ("link_precision", "link_recall", "link_map")

# Window lengths of the tasks
QUARTER = timedelta(days=91)
WEEK = timedelta(days=7)
FOUR_DAYS = timedelta(days=4)
MONTH = timedelta(days=30)
TWO_MONTHS = timedelta(days=60)
YEAR = timedelta(days=365)

# Thresholds and codes in the label definitions
TOP_RATING = 5.0
LONG_REVIEW_CHARS = 300
ATTENDING = ("yes", "maybe")
INVITED = "invited"
IGNORED_ABOVE = 2
FINISHED_STATUS = 1
TOP_QUALIFYING = 3
QUESTION_POST = 1
UP_VOTE = 2
NO_OWNER = -1
SIGNIFICANT_P = 0.05
SEVERE_EVENTS = ("serious", "deaths")


# --- shop: customer, product, review ---------------------------------------------------------


def shop_user_churn(db: Database, grids: Sequence[Grid]) -> DataFrame:
    return windows.churn(db.df("review"), "customer_id", "review_time", grids, "churn")


def shop_item_churn(db: Database, grids: Sequence[Grid]) -> DataFrame:
    return windows.churn(db.df("review"), "product_id", "review_time", grids, "churn")


def shop_user_ltv(db: Database, grids: Sequence[Grid]) -> DataFrame:
    # a review of an unknown product still shows that its customer was active
    review = db.df("review").select("customer_id", "product_id", "review_time")
    priced = review.join(db.df("product").select("product_id", "price"), "product_id", "left")
    return windows.value_of_active(priced, "customer_id", "review_time", "price", grids, "ltv")


def shop_item_ltv(db: Database, grids: Sequence[Grid]) -> DataFrame:
    # reviews are counted before prices are looked up: a best seller is one row per anchor by then
    review = db.df("review").select("product_id", "review_time")
    sold = windows.aggregate(review, "product_id", "review_time", grids, _n=F.count(F.lit(1)))
    priced = sold.join(db.df("product").select("product_id", "price"), "product_id")
    value = F.coalesce(F.col("_n") * F.col("price"), F.lit(0.0))
    return priced.select(*ANCHOR, "product_id", value.alias("ltv"))


def shop_user_item_purchase(db: Database, grids: Sequence[Grid]) -> DataFrame:
    return windows.distinct_pairs(db.df("review"), "customer_id", "product_id", "review_time", grids)


def shop_user_item_rate(db: Database, grids: Sequence[Grid]) -> DataFrame:
    best = db.df("review").where(F.col("rating") == TOP_RATING)
    return windows.distinct_pairs(best, "customer_id", "product_id", "review_time", grids)


def shop_user_item_review(db: Database, grids: Sequence[Grid]) -> DataFrame:
    long = db.df("review").where(F.length("review_text") > LONG_REVIEW_CHARS)
    return windows.distinct_pairs(long, "customer_id", "product_id", "review_time", grids)


# --- classifieds: AdsInfo, UserInfo, SearchInfo, SearchStream, VisitStream ---------------------


def classifieds_ad_ctr(db: Database, grids: Sequence[Grid]) -> DataFrame:
    shown = db.df("SearchStream").select("AdID", "SearchID", "SearchDate", "IsClick")
    rate = windows.aggregate(
        shown, "AdID", "SearchDate", grids, _clicks=F.sum("IsClick"), _shown=F.count("SearchID")
    )
    return rate.where(F.col("_clicks") > 0).select(
        *ANCHOR, "AdID", (F.col("_clicks") / F.col("_shown")).alias("num_click")
    )


def classifieds_user_visits(db: Database, grids: Sequence[Grid]) -> DataFrame:
    visits = db.df("VisitStream").select("UserID", "AdID", "ViewDate")
    return windows.aggregate(
        visits, "UserID", "ViewDate", grids, num_click=F.count_distinct("AdID") > 1
    )


def classifieds_user_clicks(db: Database, grids: Sequence[Grid]) -> DataFrame:
    """More than one clicked ad (not distinct) among the results of a user's searches."""
    clicked = (
        db.df("SearchStream")
        .where((F.col("IsClick") == 1.0) & F.col("AdID").isNotNull())
        .groupBy("SearchID")
        .agg(F.count("AdID").alias("_clicks"))
    )
    searches = db.df("SearchInfo").select("SearchID", "UserID", "SearchDate").join(clicked, "SearchID", "left")
    return windows.aggregate(
        searches, "UserID", "SearchDate", grids, num_click=F.coalesce(F.sum("_clicks"), F.lit(0)) > 1
    )


def classifieds_user_ad_visit(db: Database, grids: Sequence[Grid]) -> DataFrame:
    return windows.distinct_pairs(db.df("VisitStream"), "UserID", "AdID", "ViewDate", grids)


# --- meetups: users, events, event_attendees, event_interest, user_friends ---------------------


def _attendance(db: Database) -> DataFrame:
    return db.df("event_attendees").select(F.col("user_id").alias("user"), "start_time", "status")


def meetups_user_attendance(db: Database, grids: Sequence[Grid]) -> DataFrame:
    going = F.sum(F.when(F.col("status").isin(*ATTENDING), 1).otherwise(0)).cast("bigint")
    return windows.aggregate(_attendance(db), "user", "start_time", grids, target=going)


def meetups_user_repeat(db: Database, grids: Sequence[Grid]) -> DataFrame:
    """Attendance of users who attended in one of their two previous active windows.

    A grid with one anchor is extended by two earlier anchors, which only serve as history.
    """
    long = [
        g if g.count > 1 else Grid(g.split, g.start - 2 * g.step, g.step, g.count + 2) for g in grids
    ]
    went = F.max(F.when(F.col("status").isin(*ATTENDING), 1).otherwise(0))
    active = windows.aggregate(_attendance(db), "user", "start_time", long, target=went)
    flagged = windows.add_previous_max(active, ["split", "user"], "timestamp", "target", 2, "_prev")
    starts = {g.split: g.start for g in grids if g.count == 1}
    kept = flagged.where(F.col("_prev") == 1)
    for split, start in starts.items():
        kept = kept.where((F.col("split") != split) | (F.col("timestamp") >= windows.ntz(start)))
    return kept.drop("_prev")


def meetups_user_ignore(db: Database, grids: Sequence[Grid]) -> DataFrame:
    ignored = F.sum(F.when(F.col("status") == INVITED, 1).otherwise(0)) > IGNORED_ABOVE
    return windows.aggregate(_attendance(db), "user", "start_time", grids, target=ignored.cast("int"))


# --- racing: drivers, results, qualifying --------------------------------------------------------


def racing_driver_position(db: Database, grids: Sequence[Grid]) -> DataFrame:
    results = db.df("results").select("driverId", "date", "positionOrder")
    return windows.aggregate(results, "driverId", "date", grids, position=F.avg("positionOrder"))


def racing_driver_dnf(db: Database, grids: Sequence[Grid]) -> DataFrame:
    results = db.df("results").select("driverId", "date", "statusId")
    out = F.max(F.when(F.col("statusId") != FINISHED_STATUS, 1).otherwise(0))
    return windows.aggregate(results, "driverId", "date", grids, did_not_finish=out)


def racing_driver_top3(db: Database, grids: Sequence[Grid]) -> DataFrame:
    laps = db.df("qualifying").select("driverId", "date", "position")
    top = F.when(F.min("position") <= TOP_QUALIFYING, 1).otherwise(0).cast("bigint")
    return windows.aggregate(laps, "driverId", "date", grids, qualifying=top)


# --- fashion: customer, article, transactions ----------------------------------------------------


def fashion_user_item_purchase(db: Database, grids: Sequence[Grid]) -> DataFrame:
    return windows.distinct_pairs(db.df("transactions"), "customer_id", "article_id", "t_dat", grids)


def fashion_user_churn(db: Database, grids: Sequence[Grid]) -> DataFrame:
    return windows.churn(db.df("transactions"), "customer_id", "t_dat", grids, "churn")


def fashion_item_sales(db: Database, grids: Sequence[Grid]) -> DataFrame:
    """A row for every article and anchor, 0 without sales."""
    sales = windows.aggregate(
        db.df("transactions").select("article_id", "t_dat", "price"),
        "article_id",
        "t_dat",
        grids,
        sales=F.coalesce(F.sum("price"), F.lit(0.0)),
    )
    return windows.for_each_existing(
        db.df("article"), "article_id", sales, "sales", grids, None, F.lit(0.0)
    )


# --- forum: users, posts, votes, comments, badges, postLinks --------------------------------------


def forum_user_engagement(db: Database, grids: Sequence[Grid]) -> DataFrame:
    """Any post, vote or comment in the window, for users with any earlier one."""
    made = windows.union_all(
        [
            db.df("posts").select("OwnerUserId", "CreationDate"),
            db.df("votes").select(F.col("UserId").alias("OwnerUserId"), "CreationDate"),
            db.df("comments").select(F.col("UserId").alias("OwnerUserId"), "CreationDate"),
        ]
    ).where(F.col("OwnerUserId") != NO_OWNER)
    return windows.for_each_since_first(made, "OwnerUserId", "CreationDate", grids, "contribution")


def forum_post_votes(db: Database, grids: Sequence[Grid]) -> DataFrame:
    questions = (
        db.df("posts")
        .where((F.col("PostTypeId") == QUESTION_POST) & (F.col("OwnerUserId") != NO_OWNER))
        .select(F.col("Id").alias("PostId"), "CreationDate")
    )
    up = db.df("votes").where(F.col("VoteTypeId") == UP_VOTE).select("Id", "PostId", "CreationDate")
    votes = windows.aggregate(up, "PostId", "CreationDate", grids, popularity=F.count_distinct("Id"))
    return windows.for_each_existing(
        questions, "PostId", votes, "popularity", grids, "CreationDate", F.lit(0).cast("bigint")
    )


def forum_user_badge(db: Database, grids: Sequence[Grid]) -> DataFrame:
    users = db.df("users").select(F.col("Id").alias("UserId"), "CreationDate")
    badges = db.df("badges").select("UserId", "Id", "Date")
    won = windows.aggregate(
        badges, "UserId", "Date", grids, WillGetBadge=(F.count("Id") >= 1).cast("int")
    )
    return windows.for_each_existing(
        users, "UserId", won, "WillGetBadge", grids, "CreationDate", F.lit(0)
    )


def forum_user_post_comment(db: Database, grids: Sequence[Grid]) -> DataFrame:
    owned = (
        db.df("posts")
        .where(F.col("OwnerUserId") != NO_OWNER)
        .select(F.col("Id").alias("PostId"), F.col("CreationDate").alias("_created"))
    )
    comments = windows.distinct_pairs(db.df("comments"), "UserId", "PostId", "CreationDate", grids)
    older = comments.join(owned, "PostId").where(F.col("_created") <= F.col("timestamp"))
    return older.select(*ANCHOR, "UserId", "PostId")


def forum_post_post_related(db: Database, grids: Sequence[Grid]) -> DataFrame:
    links = windows.distinct_pairs(db.df("postLinks"), "PostId", "RelatedPostId", "CreationDate", grids)
    created = db.df("posts").select("Id", "CreationDate")
    for col in ("PostId", "RelatedPostId"):
        known = created.toDF("_id", "_created")
        links = (
            links.join(known, F.col(col) == F.col("_id"))
            .where(F.col("_created") <= F.col("timestamp"))
            .drop("_id", "_created")
        )
    return links.select(*ANCHOR, "PostId", F.col("RelatedPostId").alias("postLinksIdList"))


# --- trials: studies, outcomes, outcome_analyses, reported_event_totals, link tables --------------


def _primary_analyses(db: Database) -> DataFrame:
    primary = db.df("outcomes").where(F.col("outcome_type") == "Primary")
    primary = primary.select(F.col("id").alias("outcome_id"), F.col("nct_id").alias("_study"))
    usable = F.coalesce(F.col("p_value_modifier") != ">", F.lit(True)) & F.col("p_value").between(0, 1)
    analyses = db.df("outcome_analyses").where(usable)
    return analyses.select("nct_id", "outcome_id", "p_value", "date").join(primary, "outcome_id")


def _with_start(df: DataFrame, db: Database, study_col: str) -> DataFrame:
    starts = db.df("studies").select(F.col("nct_id").alias(study_col), F.col("start_date").alias("_start"))
    return df.join(starts, study_col)


def trials_study_outcome(db: Database, grids: Sequence[Grid]) -> DataFrame:
    tagged = windows.tag_windows(_primary_analyses(db).dropna(subset=["nct_id"]), "date", grids)
    lowest = tagged.groupBy(*ANCHOR, "nct_id", "_study").agg(F.min("p_value").alias("_p"))
    begun = _with_start(lowest, db, "_study").where(F.col("_start") <= F.col("timestamp"))
    # an analysis may point to an outcome of another study, hence the second aggregation
    return begun.groupBy(*ANCHOR, "nct_id").agg(
        F.when(F.min("_p") <= SIGNIFICANT_P, 1).otherwise(0).alias("outcome")
    )


def trials_study_adverse(db: Database, grids: Sequence[Grid]) -> DataFrame:
    severe = db.df("reported_event_totals").where(
        F.col("event_type").isin(*SEVERE_EVENTS) & F.col("subjects_affected").isNotNull()
    )
    affected = windows.aggregate(
        severe.select("nct_id", "date", "subjects_affected"),
        "nct_id",
        "date",
        grids,
        num_of_adverse_events=F.sum("subjects_affected"),
    )
    begun = _with_start(affected, db, "nct_id").where(F.col("_start") <= F.col("timestamp"))
    return begun.select(*ANCHOR, "nct_id", "num_of_adverse_events")


def trials_site_success(db: Database, grids: Sequence[Grid]) -> DataFrame:
    """Share of successful (study, date) results per site; a result needs all analyses below 0.05."""
    results = (
        _primary_analyses(db)
        .groupBy("nct_id", "date")
        .agg(F.min(F.when(F.col("p_value") < SIGNIFICANT_P, 1).otherwise(0)).alias("_won"))
    )
    per_study = (
        windows.tag_windows(results, "date", grids)
        .groupBy(*ANCHOR, "nct_id")
        .agg(F.sum("_won").alias("_won"), F.count("_won").alias("_all"))
    )
    sites = db.df("facilities_studies").select("nct_id", "facility_id").dropna(subset=["facility_id"])
    return (
        per_study.join(sites, "nct_id")
        .groupBy(*ANCHOR, "facility_id")
        .agg((F.sum("_won") / F.sum("_all")).alias("success_rate"))
    )


def _run_with_sponsor(db: Database, grids: Sequence[Grid], links: str, col: str) -> DataFrame:
    """Distinct (col, sponsor) over studies; both sides are made distinct before they meet."""
    runs = windows.tag_windows(db.df(links).select("nct_id", col, "date").dropna(), "date", grids)
    runs = runs.select(*ANCHOR, "nct_id", col).distinct()
    sponsors = db.df("sponsors_studies").select("nct_id", "sponsor_id").dropna().distinct()
    return runs.join(sponsors, "nct_id").select(*ANCHOR, col, "sponsor_id").distinct()


def trials_condition_sponsor_run(db: Database, grids: Sequence[Grid]) -> DataFrame:
    return _run_with_sponsor(db, grids, "conditions_studies", "condition_id")


def trials_site_sponsor_run(db: Database, grids: Sequence[Grid]) -> DataFrame:
    return _run_with_sponsor(db, grids, "facilities_studies", "facility_id")


# --- registry --------------------------------------------------------------------------------------


def _entity(
    name: str, build, delta: timedelta, col: str, table: str, target: str, *,
    binary: bool, evals: int = 1, time_name: str = "timestamp",
) -> EntityTask:
    kind, metrics = (
        (TaskKind.BINARY, BINARY_METRICS) if binary else (TaskKind.REGRESSION, REGRESSION_METRICS)
    )
    return EntityTask(
        name, kind, delta, build, metrics, evals, time_name,
        entity_col=col, entity_table=table, target_col=target,
    )


def _link(
    name: str, build, delta: timedelta, src: tuple[str, str], dst: tuple[str, str], k: int
) -> LinkTask:
    return LinkTask(
        name, TaskKind.LINK, delta, build, LINK_METRICS,
        src_col=src[0], src_table=src[1], dst_col=dst[0], dst_table=dst[1], k=k,
    )


_CUSTOMER_PRODUCT = (("customer_id", "customer"), ("product_id", "product"))

TASKS: dict[str, dict[str, Task]] = {
    "shop": {
        "user-churn": _entity("user-churn", shop_user_churn, QUARTER, "customer_id", "customer", "churn", binary=True),
        "user-ltv": _entity("user-ltv", shop_user_ltv, QUARTER, "customer_id", "customer", "ltv", binary=False),
        "item-churn": _entity("item-churn", shop_item_churn, QUARTER, "product_id", "product", "churn", binary=True),
        "item-ltv": _entity("item-ltv", shop_item_ltv, QUARTER, "product_id", "product", "ltv", binary=False),
        "user-item-purchase": _link("user-item-purchase", shop_user_item_purchase, QUARTER, *_CUSTOMER_PRODUCT, 10),
        "user-item-rate": _link("user-item-rate", shop_user_item_rate, QUARTER, *_CUSTOMER_PRODUCT, 10),
        "user-item-review": _link("user-item-review", shop_user_item_review, QUARTER, *_CUSTOMER_PRODUCT, 10),
    },
    "classifieds": {
        "ad-ctr": _entity("ad-ctr", classifieds_ad_ctr, FOUR_DAYS, "AdID", "AdsInfo", "num_click", binary=False),
        "user-visits": _entity("user-visits", classifieds_user_visits, FOUR_DAYS, "UserID", "UserInfo", "num_click", binary=True),
        "user-clicks": _entity("user-clicks", classifieds_user_clicks, FOUR_DAYS, "UserID", "UserInfo", "num_click", binary=True),
        "user-ad-visit": _link("user-ad-visit", classifieds_user_ad_visit, FOUR_DAYS, ("UserID", "UserInfo"), ("AdID", "AdsInfo"), 12),
    },
    "meetups": {
        "user-attendance": _entity("user-attendance", meetups_user_attendance, WEEK, "user", "users", "target", binary=False),
        "user-repeat": _entity("user-repeat", meetups_user_repeat, WEEK, "user", "users", "target", binary=True),
        "user-ignore": _entity("user-ignore", meetups_user_ignore, WEEK, "user", "users", "target", binary=True),
    },
    "racing": {
        "driver-position": _entity("driver-position", racing_driver_position, TWO_MONTHS, "driverId", "drivers", "position", binary=False, evals=40, time_name="date"),
        "driver-dnf": _entity("driver-dnf", racing_driver_dnf, MONTH, "driverId", "drivers", "did_not_finish", binary=True, evals=40, time_name="date"),
        "driver-top3": _entity("driver-top3", racing_driver_top3, MONTH, "driverId", "drivers", "qualifying", binary=True, evals=40, time_name="date"),
    },
    "fashion": {
        "user-item-purchase": _link("user-item-purchase", fashion_user_item_purchase, WEEK, ("customer_id", "customer"), ("article_id", "article"), 12),
        "user-churn": _entity("user-churn", fashion_user_churn, WEEK, "customer_id", "customer", "churn", binary=True),
        "item-sales": _entity("item-sales", fashion_item_sales, WEEK, "article_id", "article", "sales", binary=False),
    },
    "forum": {
        "user-engagement": _entity("user-engagement", forum_user_engagement, QUARTER, "OwnerUserId", "users", "contribution", binary=True),
        "post-votes": _entity("post-votes", forum_post_votes, QUARTER, "PostId", "posts", "popularity", binary=False),
        "user-badge": _entity("user-badge", forum_user_badge, QUARTER, "UserId", "users", "WillGetBadge", binary=True),
        "user-post-comment": _link("user-post-comment", forum_user_post_comment, QUARTER, ("UserId", "users"), ("PostId", "posts"), 100),
        "post-post-related": _link("post-post-related", forum_post_post_related, QUARTER, ("PostId", "posts"), ("postLinksIdList", "posts"), 100),
    },
    "trials": {
        "study-outcome": _entity("study-outcome", trials_study_outcome, YEAR, "nct_id", "studies", "outcome", binary=True),
        "study-adverse": _entity("study-adverse", trials_study_adverse, YEAR, "nct_id", "studies", "num_of_adverse_events", binary=False),
        "site-success": _entity("site-success", trials_site_success, YEAR, "facility_id", "facilities", "success_rate", binary=False),
        "condition-sponsor-run": _link("condition-sponsor-run", trials_condition_sponsor_run, YEAR, ("condition_id", "conditions"), ("sponsor_id", "sponsors"), 10),
        "site-sponsor-run": _link("site-sponsor-run", trials_site_sponsor_run, YEAR, ("facility_id", "facilities"), ("sponsor_id", "sponsors"), 10),
    },
}


@dataclass(frozen=True)
class Registry:
    """Tasks by schema and name; further schemas and tasks can be added."""

    tasks: dict[str, dict[str, Task]]

    def names(self, schema: str) -> list[str]:
        return list(self.tasks[schema])

    def get(self, schema: str, name: str) -> Task:
        try:
            return self.tasks[schema][name]
        except KeyError:
            raise KeyError(f"no task {name!r} for schema {schema!r}") from None

    def register(self, schema: str, task: Task) -> None:
        self.tasks.setdefault(schema, {})[task.name] = task


REGISTRY = Registry(TASKS)


def get_task(schema: str, name: str) -> Task:
    return REGISTRY.get(schema, name)


__all__ = ["REGISTRY", "TASKS", "get_task"]
