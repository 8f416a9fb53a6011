"""Databases of the seven schemas from their raw files, as lazy frames.

A builder only declares the cleaning; write its result once with ``write_database`` and read that
from then on. Numbers in CSV files are recognised by Spark (one pass over the text); times stay text
until they are parsed here, so that bad values become NULL and not an error.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronograin.functions import clean
from chronograin.model import Database, Dataset, Table
from chronograin.operators.integrity import first_per_key, keep_known, surrogate_ids
from chronograin.operators.joins import lookup
from chronograin.sources.files import read_json_lines
from chronograin.sources.tables import list_names, reindexed_or_loaded

# Validation cut-off, test cut-off and first used day of each schema
CUTOFFS: dict[str, tuple[datetime, datetime, datetime | None]] = {
    "shop": (datetime(2015, 10, 1), datetime(2016, 1, 1), datetime(2008, 1, 1)),
    "classifieds": (datetime(2015, 5, 8), datetime(2015, 5, 14), datetime(2015, 4, 25)),
    "meetups": (datetime(2012, 11, 21), datetime(2012, 11, 29), None),
    "racing": (datetime(2005, 1, 1), datetime(2010, 1, 1), None),
    "fashion": (datetime(2020, 9, 7), datetime(2020, 9, 14), datetime(2019, 9, 7)),
    "forum": (datetime(2020, 10, 1), datetime(2021, 1, 1), None),
    "trials": (datetime(2020, 1, 1), datetime(2021, 1, 1), None),
}

# Primary key, time column and foreign keys of every table
_RACE_DRIVER = {"raceId": "races", "driverId": "drivers"}
_RACE_TEAM = {"raceId": "races", "constructorId": "constructors"}
_VISIT = {"UserID": "UserInfo", "AdID": "AdsInfo"}
_POST_USER = {"PostId": "posts", "UserId": "users"}
_STUDY = {"nct_id": "studies"}
KEYS: dict[str, dict[str, tuple[str | None, str | None, Mapping[str, str]]]] = {
    "shop": {
        "product": ("product_id", None, {}),
        "customer": ("customer_id", None, {}),
        "review": (None, "review_time", {"customer_id": "customer", "product_id": "product"}),
    },
    "classifieds": {
        "AdsInfo": ("AdID", None, {"LocationID": "Location", "CategoryID": "Category"}),
        "Category": ("CategoryID", None, {}),
        "Location": ("LocationID", None, {}),
        "PhoneRequestsStream": (None, "PhoneRequestDate", _VISIT),
        "SearchInfo": ("SearchID", "SearchDate", {"UserID": "UserInfo", "LocationID": "Location", "CategoryID": "Category"}),
        "SearchStream": (None, "SearchDate", {"SearchID": "SearchInfo", "AdID": "AdsInfo"}),
        "UserInfo": ("UserID", None, {}),
        "VisitStream": (None, "ViewDate", _VISIT),
    },
    "meetups": {
        "users": ("user_id", "joinedAt", {}),
        "events": ("event_id", "start_time", {"user_id": "users"}),
        "event_attendees": (None, "start_time", {"event": "events", "user_id": "users"}),
        "event_interest": (None, "timestamp", {"event": "events", "user": "users"}),
        "user_friends": (None, None, {"user": "users", "friend": "users"}),
    },
    "racing": {
        "races": ("raceId", "date", {"circuitId": "circuits"}),
        "circuits": ("circuitId", None, {}),
        "drivers": ("driverId", None, {}),
        "constructors": ("constructorId", None, {}),
        "results": ("resultId", "date", {**_RACE_DRIVER, "constructorId": "constructors"}),
        "standings": ("driverStandingsId", "date", _RACE_DRIVER),
        "constructor_results": ("constructorResultsId", "date", _RACE_TEAM),
        "constructor_standings": ("constructorStandingsId", "date", _RACE_TEAM),
        "qualifying": ("qualifyId", "date", {**_RACE_DRIVER, "constructorId": "constructors"}),
    },
    "fashion": {
        "article": ("article_id", None, {}),
        "customer": ("customer_id", None, {}),
        "transactions": (None, "t_dat", {"customer_id": "customer", "article_id": "article"}),
    },
    "forum": {
        "users": ("Id", "CreationDate", {}),
        "posts": ("Id", "CreationDate", {"OwnerUserId": "users", "ParentId": "posts", "AcceptedAnswerId": "posts"}),
        "comments": ("Id", "CreationDate", _POST_USER),
        "votes": ("Id", "CreationDate", _POST_USER),
        "postHistory": ("Id", "CreationDate", _POST_USER),
        "badges": ("Id", "Date", {"UserId": "users"}),
        "postLinks": ("Id", "CreationDate", {"PostId": "posts", "RelatedPostId": "posts"}),
    },
    "trials": {
        "studies": ("nct_id", "start_date", {}),
        "outcomes": ("id", "date", _STUDY),
        "outcome_analyses": ("id", "date", {**_STUDY, "outcome_id": "outcomes"}),
        "drop_withdrawals": ("id", "date", _STUDY),
        "reported_event_totals": ("id", "date", _STUDY),
        "designs": ("id", "date", _STUDY),
        "eligibilities": ("id", "date", _STUDY),
        "sponsors": ("sponsor_id", None, {}),
        "facilities": ("facility_id", None, {}),
        "conditions": ("condition_id", None, {}),
        "interventions": ("intervention_id", None, {}),
        "sponsors_studies": ("id", "date", {**_STUDY, "sponsor_id": "sponsors"}),
        "facilities_studies": ("id", "date", {**_STUDY, "facility_id": "facilities"}),
        "conditions_studies": ("id", "date", {**_STUDY, "condition_id": "conditions"}),
        "interventions_studies": ("id", "date", {**_STUDY, "intervention_id": "interventions"}),
    },
}

# Columns left out because they leak the future or say nothing
DROPPED: dict[str, dict[str, tuple[str, ...]]] = {
    "classifieds": {"AdsInfo": ("Params",), "SearchInfo": ("SearchParams",), "Category": ("__index_level_0__",)},
    "racing": {
        "races": (
            "url", "fp1_date", "fp1_time", "fp2_date", "fp2_time", "fp3_date", "fp3_time",
            "quali_date", "quali_time", "sprint_date", "sprint_time",
        ),
        "circuits": ("url",),
        "drivers": ("number", "url"),
        "results": ("positionText", "time", "fastestLapTime", "fastestLapSpeed"),
        "standings": ("positionText",),
        "constructors": ("url",),
        "constructor_standings": ("positionText",),
        "constructor_results": ("status",),
        "qualifying": ("q1", "q2", "q3"),
    },
    "forum": {
        "users": ("Reputation", "Views", "UpVotes", "DownVotes", "LastAccessDate"),
        "posts": (
            "ViewCount", "AnswerCount", "CommentCount", "FavoriteCount", "CommunityOwnedDate", "ClosedDate", "LastEditDate",
            "LastActivityDate", "Score", "LastEditorDisplayName", "LastEditorUserId",
        ),
        "comments": ("Score",),
        "votes": ("BountyAmount",),
    },
    "trials": {
        "drop_withdrawals": ("result_group_id", "ctgov_group_code", "drop_withdraw_comment", "reason_comment", "count_units"),
        "conditions": ("downcase_mesh_term", "mesh_type"),
        "interventions": ("downcase_mesh_term", "mesh_type"),
    },
}

# Columns kept of wide raw tables
KEPT: dict[str, tuple[str, ...]] = {
    "studies": (
        "nct_id", "start_date", "target_duration", "study_type", "acronym", "baseline_population", "brief_title",
        "official_title", "phase", "enrollment", "enrollment_type", "source", "limitations_and_caveats", "number_of_arms",
        "number_of_groups", "has_dmc", "is_fda_regulated_drug", "is_fda_regulated_device", "is_unapproved_device", "is_ppsd",
        "is_us_export", "biospec_retention", "biospec_description", "source_class", "baseline_type_units_analyzed",
        "fdaaa801_violation", "plan_to_share_ipd",
    ),
    "outcomes": (
        "id", "nct_id", "outcome_type", "title", "description", "time_frame", "population", "units", "units_analyzed",
        "dispersion_type", "param_type",
    ),
    "reported_event_totals": ("id", "nct_id", "event_type", "classification", "subjects_affected", "subjects_at_risk"),
}

# Numbers among the raw racing results
RESULT_NUMBERS = ("rank", "number", "grid", "position", "points", "laps", "milliseconds", "fastestLap")
# Raw fields of products and reviews, and their names in the schema
PRODUCT_FIELDS = "asin string, category array<string>, brand string, title string, description array<string>, price string"
REVIEW_FIELDS = (
    "unixReviewTime int, reviewerID string, reviewerName string, asin string, overall float, verified boolean, reviewText string, summary string"
)
REVIEW_NAMES = {
    "unixReviewTime": "review_time", "reviewerID": "customer_id", "reviewerName": "customer_name", "asin": "product_id",
    "overall": "rating", "reviewText": "review_text",
}
# What counts as a finished study and a root term, and the first start day
ACTUAL, ROOT_TERM, FIRST_START = "Actual", "mesh-list", "2000-01-01"
ATTENDANCE = ("yes", "maybe", "invited", "no")


# Files with free text, whose quoted values may hold line breaks. Spark reads such a file in one task,
# so large ones should come as a folder of parts; all other files are split.
FREE_TEXT = {
    "articles.csv", "Users.csv", "Posts.csv", "Comments.csv", "PostHistory.csv", "studies.txt", "outcomes.txt",
    "outcome_analyses.txt", "designs.txt", "eligibilities.txt", "drop_withdrawals.txt", "detailed_descriptions.txt",
    "brief_summaries.txt",
}


class Raw:
    """CSV files of one folder; a file may be compressed, or be a folder of parts."""

    def __init__(self, spark: SparkSession, folder: str, sep: str = ",") -> None:
        self.spark, self.folder, self.sep = spark, folder.rstrip("/"), sep
        self.names = set(list_names(spark, folder))

    def csv(self, name: str) -> DataFrame:
        file = name if name in self.names else f"{name}.gz"
        reader = self.spark.read.options(
            header=True, sep=self.sep, quote='"', escape='"', multiLine=name in FREE_TEXT, inferSchema=True,
            # formats no value has: times stay text
            dateFormat="'no date'", timestampFormat="'no time'", timestampNTZFormat="'no time'",
        )
        return reader.csv(f"{self.folder}/{file}")


def _text(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in cols})


def _assembled(schema: str, frames: Mapping[str, DataFrame]) -> Database:
    dropped = DROPPED.get(schema, {})
    out = {
        name: Table(clean.nan_to_null(df.drop(*dropped.get(name, ()))), *KEYS[schema][name]) for name, df in frames.items()
    }
    db, first = Database(out), CUTOFFS[schema][2]
    return db if first is None else db.from_(first)


def shop(spark: SparkSession, products: str, reviews: str) -> Database:
    """Products and reviews as JSON lines."""
    product = read_json_lines(spark, products, PRODUCT_FIELDS).withColumnRenamed("asin", "product_id")
    product = first_per_key(product, ["product_id"], ["title", "brand", "price"])
    product = product.withColumns(
        {
            "price": clean.parse_price(F.col("price")),
            "category": clean.empty_to_null(F.col("category")),
            "description": clean.first_or_null(F.col("description")),
        }
    ).dropna(subset=["price"])
    review = clean.rename(read_json_lines(spark, reviews, REVIEW_FIELDS), REVIEW_NAMES)
    review = review.withColumn("review_time", clean.from_unix_seconds(F.col("review_time")))
    known = review.select("product_id").distinct()
    review = keep_known(review, "product_id", product.select("product_id"))
    product = keep_known(product, "product_id", known)
    customer = first_per_key(
        review.select("customer_id", "customer_name", "review_time"), ["customer_id"], ["review_time", "customer_name"]
    ).drop("review_time")
    return _assembled("shop", {"product": product, "customer": customer, "review": review.drop("customer_name")})


def classifieds(spark: SparkSession, folder: str) -> Database:
    """One folder of Parquet parts per table. Map columns are left out of the schema."""
    frames = {name: spark.read.parquet(f"{folder.rstrip('/')}/{name}") for name in KEYS["classifieds"]}
    for name, col in (("AdsInfo", "AdID"), ("Location", "LocationID")):
        frames[name] = frames[name].dropna(subset=[col])
    frames["AdsInfo"] = frames["AdsInfo"].fillna("", subset=["Title"])
    for name in ("SearchInfo", "SearchStream", "PhoneRequestsStream", "VisitStream"):
        time = KEYS["classifieds"][name][1]
        if dict(frames[name].dtypes)[time] == "string":
            frames[name] = clean.clean_time(frames[name], time)
        else:
            frames[name] = frames[name].withColumn(time, F.col(time).cast("timestamp_ntz")).dropna(subset=[time])
    return _assembled("classifieds", frames)


def meetups(spark: SparkSession, folder: str) -> Database:
    raw = Raw(spark, folder)
    users = raw.csv("users.csv")
    users = users.withColumns(
        {"birthyear": clean.to_number(F.col("birthyear").cast("string")), "joinedAt": clean.parse_time(F.col("joinedAt").cast("string"))}
    )
    events = raw.csv("events.csv").withColumn("start_time", clean.parse_time(F.col("start_time").cast("string")))
    interest = raw.csv("train.csv").withColumn("timestamp", clean.parse_time(F.col("timestamp").cast("string")))
    friends = raw.csv("user_friends.csv").select(
        F.col("user").cast("bigint"), F.explode(clean.split_numbers(F.col("friends").cast("string"))).alias("friend")
    )
    friends = keep_known(friends, "friend", users.select("user_id"))
    wide = _text(raw.csv("event_attendees.csv"), *ATTENDANCE)
    long = wide.unpivot("event", list(ATTENDANCE), "status", "user_ids").dropna()
    attendees = long.select("event", "status", F.explode(clean.split_numbers(F.col("user_ids"))).alias("user_id"))
    attendees = lookup(attendees, events, "event", "event_id", ["start_time"]).dropna(subset=["user_id"])
    return _assembled(
        "meetups",
        {"users": users, "events": events, "event_attendees": attendees, "event_interest": interest, "user_friends": friends},
    )


def racing(spark: SparkSession, folder: str) -> Database:
    raw = Raw(spark, folder)
    files = {name: "driver_standings" if name == "standings" else name for name in KEYS["racing"]}
    frames = {name: raw.csv(f"{file}.csv") for name, file in files.items()}
    races = _text(frames["races"], "date", "time")
    races = races.withColumn("date", clean.join_date_time(F.col("date"), F.coalesce("time", F.lit(clean.MISSING_MARK))))
    frames["races"] = races
    for name in ("results", "standings", "constructor_results", "constructor_standings", "qualifying"):
        frames[name] = lookup(frames[name], races, "raceId", "raceId", ["date"])
    frames["qualifying"] = frames["qualifying"].withColumn("date", clean.shift_time(F.col("date"), timedelta(days=-1)))
    results = _text(frames["results"], *RESULT_NUMBERS)
    frames["results"] = clean.to_numbers(clean.marks_to_null(results), RESULT_NUMBERS)
    circuits = clean.marks_to_null(_text(frames["circuits"], "alt"))
    frames["circuits"] = clean.to_numbers(circuits, ["alt"])
    frames["drivers"] = frames["drivers"].withColumn("dob", clean.parse_time(F.col("dob").cast("string")))
    return _assembled("racing", frames)


def fashion(spark: SparkSession, folder: str) -> Database:
    raw = Raw(spark, folder)
    transactions = raw.csv("transactions_train.csv")
    transactions = transactions.withColumn("t_dat", clean.parse_time(F.col("t_dat").cast("string"), ["yyyy-MM-dd"]))
    return _assembled(
        "fashion", {"article": raw.csv("articles.csv"), "customer": raw.csv("customers.csv"), "transactions": transactions}
    )


def forum(spark: SparkSession, folder: str) -> Database:
    raw, frames = Raw(spark, folder), {}
    for name, (_, time, _) in KEYS["forum"].items():
        df = _text(raw.csv(f"{name[0].upper()}{name[1:]}.csv"), time)
        frames[name] = clean.clean_time(df, time)
    return _assembled("forum", frames)


def trials(spark: SparkSession, folder: str) -> Database:
    """Pipe separated text. Results exist from a study's end on, its set-up from its start on."""
    raw = Raw(spark, folder, "|")

    def read(name: str) -> DataFrame:
        return raw.csv(f"{name}.txt")

    finished = _text(read("studies"), "start_date", "completion_date").where(
        (F.col("completion_date_type") == ACTUAL) & (F.col("start_date") >= FIRST_START) & F.col("nct_id").isNotNull()
    )
    finished = finished.withColumns({c: clean.parse_time(F.col(c)) for c in ("start_date", "completion_date")})
    studies = finished.select(*KEPT["studies"])
    for name, column in (("detailed_descriptions", "detailed_descriptions"), ("brief_summaries", "brief_summaries")):
        texts = read(name).groupBy("nct_id").agg(F.max("description").alias(column))
        studies = lookup(studies, texts, "nct_id", "nct_id", [column])

    def of_finished(df: DataFrame, moment: str) -> DataFrame:
        # inner join: rows of other studies go, the study's time comes
        times = finished.select("nct_id", F.col(moment).alias("date"))
        return df.join(times, "nct_id")

    frames = {"studies": studies}
    for name in ("outcomes", "outcome_analyses", "drop_withdrawals", "reported_event_totals"):
        df = read(name)
        frames[name] = of_finished(df.select(*KEPT[name]) if name in KEPT else df, "completion_date")
    for name in ("designs", "eligibilities"):
        frames[name] = of_finished(read(name), "start_date")
    entities = (
        ("sponsors", "sponsors", "name", "sponsor_id", ("agency_class",), ("lead_or_collaborator",)),
        ("facilities", "facilities", "name", "facility_id", ("city", "state", "zip", "country"), ()),
        ("browse_conditions", "conditions", "mesh_term", "condition_id", (), ()),
        ("browse_interventions", "interventions", "mesh_term", "intervention_id", (), ()),
    )
    for file, name, value, key, about, of_link in entities:
        df = read(file)
        df = df.where(F.col("mesh_type") == ROOT_TERM) if "mesh_type" in df.columns else df
        numbered, _ = surrogate_ids(of_finished(df, "start_date"), value, key, "id")
        frames[f"{name}_studies"] = numbered.select("id", "nct_id", key, *of_link, "date")
        frames[name] = first_per_key(
            numbered.where(F.col(key).isNotNull()).select(key, value, *about, "id"), [key], ["id"]
        ).drop("id")
    return _assembled("trials", frames)


BUILDERS: dict[str, Callable[..., Database]] = {
    build.__name__: build for build in (shop, classifieds, meetups, racing, fashion, forum, trials)
}


def get_dataset(spark: SparkSession, schema: str, *paths: str, store: str | None = None) -> Dataset:
    """The dataset of a schema from its raw files, with keys renumbered in time order.

    ``store`` is a folder for the finished database: written on the first call, read afterwards.
    """
    if schema not in BUILDERS:
        raise KeyError(f"no schema {schema!r}; known are {sorted(BUILDERS)}")
    val, test, _ = CUTOFFS[schema]
    db = reindexed_or_loaded(spark, lambda: BUILDERS[schema](spark, *paths), store)
    return Dataset(db, val, test)

