"""Entities as nested JSON documents.

Children are collected bottom-up, one aggregation per level. A list that outgrows ``part_rows``
is continued in further documents that name the owner and the section, so no document and no
task ever holds an unbounded group, and nothing is left out.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from math import prod

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronograin.functions.clean import DOCUMENT_TIME, columns_to_array, json_safe, numbered
from chronograin.model import Database
from chronograin.operators.joins import facts_upto, lookup
from chronograin.operators.lists import PART_ROWS, hot_keys, split_parts
from chronograin.operators.selection import first_rows
from chronograin.operators.windows import union_all
from chronograin.session import cut_lineage

# NULLs are kept, and times become text as the document is written, not before they are shuffled and sorted
_JSON = {"ignoreNullFields": "false", "timestampFormat": DOCUMENT_TIME, "timestampNTZFormat": DOCUMENT_TIME}
# field of a continuation that names its list; whole documents have none
CONTINUES = "continues"
# a table of that many rows is sent to every task, whatever its estimated size
FEW_ROWS = 1000


def field(df: DataFrame, col: str) -> Column:
    """A column as document field: times as far as their text goes, so that they sort as it does."""
    kind = df.schema[col].dataType
    timed = isinstance(kind, (T.TimestampNTZType, T.TimestampType))
    return F.date_trunc("second", col).cast(kind).alias(col) if timed else F.col(col)


def fields(df: DataFrame, *, drop: Sequence[str] = ()) -> list[Column]:
    """All columns as document fields, timestamps to the second."""
    return [field(df, c) for c in df.columns if c not in drop and not c.startswith("_")]


def _longest(asked: Mapping[str, tuple[DataFrame, str]]) -> dict[str, int]:
    """The largest number of rows of one key, for each of some (rows, key); one job for all of them."""
    found = []
    for name, (rows, key) in asked.items():
        sizes = rows.dropna(subset=[key]).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
        found.append(sizes.agg(F.lit(name).alias("name"), F.coalesce(F.max("_n"), F.lit(0)).alias("n")))
    return {r["name"]: r["n"] for r in union_all(found).collect()} if found else {}


@dataclass(frozen=True)
class Child:
    """A list below an owner: ``item`` of each of ``rows``, found by ``key``, sorted along ``order``.

    ``holds`` names the lists within an item, whose lengths add to its weight. ``longest`` is a bound on the number of
    items of a list, where one is known already.
    """

    name: str
    rows: DataFrame
    key: str
    item: Column
    order: Sequence[str]
    section: str = ""
    holds: Sequence[str] = ()
    longest: int | None = None

    @property
    def weight(self) -> Column | None:
        return _sizes(*self.holds) if self.holds else None


class Nest:
    """Collects lists for their owners and remembers what has to be continued."""

    def __init__(self, part_rows: int = PART_ROWS) -> None:
        self.part_rows = part_rows
        self.rest: list[DataFrame] = []
        # the number of items of the longest list of each name
        self.longest: dict[str, int] = {}

    def lists(
        self, rows: DataFrame, keys: Sequence[str], item: Column, order: Sequence[str], name: str, section: str = "",
        weight: Column | None = None, continued: bool | None = None, near: Sequence[str] | None = None,
    ) -> DataFrame:
        """(keys.., name) with the first part of each list."""
        first, rest = split_parts(rows, keys, item, order, name, self.part_rows, weight, continued, near)
        if rest is not None:
            # a line of its own says whom it belongs to, which list it goes on with, and where
            owner = [c.alias(k.lstrip("_")) for c, k in zip(_owners(rest, keys), keys, strict=True)]
            line = F.struct(*owner, F.lit(section or name).alias(CONTINUES), "part", name)
            self.rest.append(
                rest.select(
                    _key(keys), F.lit(section or name).alias("section"), "part", F.to_json(line, _JSON).alias("doc")
                )
            )
        return first

    def _continued(self, children: Sequence[Child]) -> set[str]:
        """Names of the lists that outgrow a part for some owner.

        One job finds the longest list of each child. An item weighs at most as much as the longest lists that it may hold,
        so lists are only weighed one by one where that bound allows one to outgrow a part.
        """
        self.longest |= {c.name: c.longest for c in children if c.longest is not None}
        self.longest |= _longest({c.name: (c.rows, c.key) for c in children if c.longest is None})
        most = {c.name: self.longest[c.name] * (1 + sum(self.longest[n] for n in c.holds)) for c in children}
        long = [c for c in children if most[c.name] > self.part_rows]
        unsure = [hot_keys(c.rows, [c.key], self.part_rows, c.weight).limit(1).select(F.lit(c.name).alias("name")) for c in long if c.holds]
        heavy = {r.name for r in union_all(unsure).collect()} if unsure else set()
        return heavy | {c.name for c in long if not c.holds}

    def under(self, owners: DataFrame, owner_key: str, *children: Child) -> DataFrame:
        """``owners`` with a list column per child, empty where there is none, and its length as ``_n_<name>``.

        Lengths are counted apart from the lists. Where they are not asked for, that join falls
        away; where only they are asked for, the lists do.
        """
        continued = self._continued(children)
        for c in children:
            counts = c.rows.dropna(subset=[c.key]).groupBy(F.col(c.key).alias("_counted"))
            counts = counts.agg(F.count(F.lit(1)).alias(f"_n_{c.name}"))
            owners = owners.join(counts, F.col(owner_key) == F.col("_counted"), "left").drop("_counted")
            lists = self.lists(c.rows, [c.key], c.item, c.order, c.name, c.section, c.weight, c.name in continued)
            lists = lists.withColumnRenamed(c.key, "_owner")
            owners = owners.join(lists, F.col(owner_key) == F.col("_owner"), "left").drop("_owner")
            owners = owners.withColumn(c.name, F.coalesce(c.name, F.array().cast(lists.schema[c.name].dataType)))
        return owners

    def documents(self, rows: DataFrame, keys: Sequence[str], doc: Sequence[Column]) -> DataFrame:
        """(key, section, part, doc): main documents have section '' and part 0."""
        main = rows.select(
            _key(keys), F.lit("").alias("section"), F.lit(0).cast("bigint").alias("part"),
            F.to_json(F.struct(*doc), _JSON).alias("doc"),
        )
        return union_all([main, *self.rest])


def _owners(df: DataFrame, keys: Sequence[str]) -> list[Column]:
    """Key columns as document fields."""
    return [field(df, k) for k in keys]


def _key(keys: Sequence[str]) -> Column:
    return F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("key")


def _sizes(*names: str) -> Column:
    """Weight of an item that carries lists."""
    total = F.lit(1).cast("bigint")
    for n in names:
        total = total + F.coalesce(f"_n_{n}", F.lit(0))
    return total


# --- shop ---------------------------------------------------------------------------------------------

# Field names of the documents, here and in the sections below
_REVIEW = ("review_text", "summary", "review_time", "rating", "verified")
_PRODUCT = ("product_id", "title", "brand", "price", "category", "description")


def _present(df: DataFrame, names: Sequence[str]) -> list[str]:
    return [n for n in names if n in df.columns]


def _reviews_with_product(db: Database) -> tuple[DataFrame, Column]:
    product, review = db.df("product"), db.df("review")
    about = [c for c in _present(product, _PRODUCT) if c != "product_id"]
    rows = lookup(review, product, "product_id", "product_id", about)
    whole = [field(review, c) for c in _present(review, _REVIEW)]
    item = F.struct(*whole, F.struct("product_id", *about).alias("product"))
    return rows, item


def customer_documents(db: Database, part_rows: int = PART_ROWS) -> DataFrame:
    """Customers with their reviews, each with its product."""
    nest = Nest(part_rows)
    rows, item = _reviews_with_product(db)
    lists = nest.lists(rows, ["customer_id"], item, ["review_time", "product_id"], "reviews")
    named = lookup(lists, db.df("customer"), "customer_id", "customer_id", ["customer_name"])
    return nest.documents(named, ["customer_id"], [F.col(c) for c in ("customer_id", "customer_name", "reviews")])


def item_documents(db: Database, part_rows: int = PART_ROWS) -> DataFrame:
    """Products with their reviews, each with its customer."""
    nest = Nest(part_rows)
    product, review = db.df("product"), db.df("review")
    rows = lookup(review, db.df("customer"), "customer_id", "customer_id", ["customer_name"])
    whole = [field(review, c) for c in _present(review, _REVIEW)]
    item = F.struct(*whole, F.struct("customer_id", "customer_name").alias("customer"))
    lists = nest.lists(rows, ["product_id"], item, ["review_time", "customer_id"], "reviews")
    about = [c for c in _present(product, _PRODUCT) if c != "product_id"]
    named = lookup(lists, product, "product_id", "product_id", about)
    return nest.documents(named, ["product_id"], [F.col(c) for c in ("product_id", *about, "reviews")])


def _review_lists(review: DataFrame, product: DataFrame, order: Sequence[str]) -> DataFrame:
    """(customer_id, _all): a customer's reviews, each with its time and its product, sorted along ``order``.

    Reviews are shuffled once, to their customer. Only the place of each in its list goes to the product, and brings it back.
    """
    about = [c for c in _present(product, _PRODUCT) if c != "product_id"]
    by = F.struct(*order).alias("_by")
    own = F.struct(*[field(review, c) for c in _present(review, _REVIEW)]).alias("_review")
    known = review.dropna(subset=["customer_id"]).repartition("customer_id")
    # sorted, so that places are the same whenever a list is made
    lists = known.groupBy("customer_id").agg(F.sort_array(F.collect_list(F.struct(by, own))).alias("_reviews"))
    places = lists.select("customer_id", F.posexplode(F.transform("_reviews", lambda e: e["_by"]["product_id"])).alias("_at", "_product"))
    met = lookup(places, product, "_product", "product_id", about).repartition("customer_id")
    met = met.groupBy("customer_id").agg(F.collect_list(F.struct("_at", F.struct(F.col("_product").alias("product_id"), *about).alias("product"))).alias("_met"))

    def dated(e: Column) -> Column:
        row = F.get("_reviews", e["_at"])
        item = F.struct(*[row["_review"][f].alias(f) for f in _present(review, _REVIEW)], e["product"].alias("product"))
        return F.struct(row["_by"].alias("_by"), F.struct(row["_by"]["review_time"].alias("_when"), item.alias("_item")).alias("_dated"))

    return lists.join(met, "customer_id").select("customer_id", F.sort_array(F.transform("_met", dated))["_dated"].alias("_all"))


def labelled_documents(db: Database, labels: DataFrame, target: str, part_rows: int = PART_ROWS) -> DataFrame:
    """A document per label row: the customer's reviews up to the label's time, and the label.

    Reviews are collected once per customer, not once per label; each label then takes those up to its time. Only customers
    with more than ``part_rows`` reviews meet their labels one by one, as their lists may need parts.
    """
    nest, order = Nest(part_rows), ["review_time", "product_id"]
    rows, item = _reviews_with_product(db)
    review, product = db.df("review"), db.df("product")
    # a customer has at most as many reviews with a product as reviews, times the rows of a product
    most = _longest({"reviews": (review, "customer_id"), "products": (product, "product_id")})
    crowded = most["reviews"] * max(1, most["products"]) > part_rows
    if crowded:
        busy = cut_lineage(hot_keys(rows, ["customer_id"], part_rows))
        crowded = not busy.isEmpty()
    whole = _review_lists(review.join(busy, "customer_id", "left_anti") if crowded else review, product, order)
    all_rows = labels.select("customer_id", "timestamp", F.col(target).alias("label"))
    named = lookup(all_rows, db.df("customer"), "customer_id", "customer_id", ["customer_name"])
    joined = named.join(whole, "customer_id", "left")
    found = [F.transform(F.filter("_all", lambda e: e["_when"] <= F.col("timestamp")), lambda e: e["_item"])]
    if crowded:
        asked = labels.join(busy, "customer_id", "left_semi")
        seen = facts_upto(asked, "customer_id", "timestamp", rows.join(busy, "customer_id", "left_semi"), "customer_id", "review_time")
        lists = nest.lists(seen, ["customer_id", "timestamp"], item, order, "reviews")
        joined, found = joined.join(lists, ["customer_id", "timestamp"], "left"), ["reviews", *found]
    none = F.array().cast(T.ArrayType(whole.schema["_all"].dataType.elementType["_item"].dataType))
    told = joined.withColumn("reviews", F.coalesce(*found, none))
    doc = [F.col("customer_id"), F.col("customer_name"), field(labels, "timestamp"), F.col("label"), F.col("reviews")]
    return nest.documents(told, ["customer_id", "timestamp"], doc)


# --- classifieds --------------------------------------------------------------------------------------


def _dimension(df: DataFrame, key: str, name: str) -> DataFrame:
    return df.select(F.col(key).alias(f"_{name}"), F.struct(*fields(df, drop=[key])).alias(name))


def _with(df: DataFrame, dim: DataFrame, on: str, name: str) -> DataFrame:
    return df.join(dim, F.col(on) == F.col(f"_{name}"), "left").drop(f"_{name}")


def _ads(db: Database, name: str) -> DataFrame:
    ads = _with(db.df("AdsInfo"), _dimension(db.df("Location"), "LocationID", "ad_location"), "LocationID", "ad_location")
    ads = _with(ads, _dimension(db.df("Category"), "CategoryID", "ad_category"), "CategoryID", "ad_category")
    return ads.select(F.col("AdID").alias(f"_{name}"), F.struct(*fields(ads)).alias(name))


def classifieds_user_documents(db: Database, part_rows: int = PART_ROWS) -> DataFrame:
    """Users with searches (and the ads shown), ad visits and phone requests."""
    nest = Nest(part_rows)
    shown = _with(db.df("SearchStream"), _ads(db, "ad_shown"), "AdID", "ad_shown")
    search = _with(db.df("SearchInfo"), _dimension(db.df("Location"), "LocationID", "search_location"), "LocationID", "search_location")
    search = _with(search, _dimension(db.df("Category"), "CategoryID", "search_category"), "CategoryID", "search_category")
    shown_list = Child(
        "search_results_shown", shown, "SearchID", F.struct(*fields(shown)), ["SearchDate", "AdID"], "search_history.search_results_shown"
    )
    search = nest.under(search, "SearchID", shown_list)
    children = [
        Child(
            "search_history", search, "UserID", F.struct(*fields(search)), ["SearchDate", "SearchID"],
            holds=("search_results_shown",),
        )
    ]
    for table, time, ad, name in (
        ("VisitStream", "ViewDate", "ad_viewed", "ad_visits"),
        ("PhoneRequestsStream", "PhoneRequestDate", "ad_requested", "phone_requests"),
    ):
        rows = _with(db.df(table), _ads(db, ad), "AdID", ad)
        children.append(Child(name, rows, "UserID", F.struct(*fields(rows)), [time, "AdID"]))
    users = nest.under(db.df("UserInfo"), "UserID", *children)
    return nest.documents(users, ["UserID"], fields(users))


# --- meetups --------------------------------------------------------------------------------------------


def meetup_user_documents(db: Database, part_rows: int = PART_ROWS) -> DataFrame:
    """Users with friends, created events (attendees, interest) and other events they engaged in."""
    nest = Nest(part_rows)
    events = columns_to_array(db.df("events"), numbered("c_", 100), "c_vector")
    attendees, interest = db.df("event_attendees"), db.df("event_interest")
    created = nest.under(
        events, "event_id",
        Child(
            "attendees", attendees, "event", F.struct(*fields(attendees)), ["start_time", "user_id", "status"], "events_created.attendees"
        ),
        Child(
            "interest_shown", interest, "event", F.struct(*fields(interest)), ["timestamp", "user"], "events_created.interest_shown"
        ),
    )
    friends = db.df("user_friends").where(F.col("friend").isNotNull())
    engaged = _engagements(events, attendees, interest, nest.longest["attendees"] + nest.longest["interest_shown"] <= part_rows)
    # a user is engaged in at most as many events as there are records, times the rows of an event
    told = _longest({"attended": (attendees, "user_id"), "interested": (interest, "user"), "events": (events, "event_id")})
    most = (told["attended"] + told["interested"]) * max(1, told["events"])
    users = nest.under(
        db.df("users"), "user_id",
        Child("friends", friends, "user", F.col("friend"), ["friend"]),
        Child(
            "events_created", created, "user_id", F.struct(*fields(created)), ["start_time", "event_id"],
            holds=("attendees", "interest_shown"),
        ),
        Child(
            "event_engagements", engaged, "engaged_user", F.struct("user_engagement_details", "event"), ["engaged_event"],
            longest=most if most <= part_rows else None,
        ),
    )
    return nest.documents(users, ["user_id"], fields(users))


def _engagements(events: DataFrame, attendees: DataFrame, interest: DataFrame, by_event: bool) -> DataFrame:
    """(engaged_user, engaged_event, user_engagement_details, event) for events the user did not create.

    The first record of each kind counts. ``by_event`` is for events of bounded size, whose records lie in one task: these are
    dealt as for the lists of an event, and so are shuffled once for both. Otherwise ``min`` of a struct is a partial aggregate,
    so a user with very many records for an event is reduced before the shuffle, and a large event is spread.
    """
    if by_event:
        return _engagements_by_event(events, attendees, interest)
    keys = ["engaged_user", "engaged_event"]

    def told(df: DataFrame, user: str, order: list[str], name: str) -> DataFrame:
        rest = [c for c in df.columns if c not in (user, "event", *order)]
        record = F.struct(*[field(df, c) for c in [*order, *rest]]).alias(name)
        return df.select(F.col(user).alias("engaged_user"), F.col("event").alias("engaged_event"), record)

    met = events.select(F.col("user_id").alias("engaged_user"), F.col("event_id").alias("engaged_event"), F.lit(True).alias("_own"))
    kinds = told(attendees, "user_id", ["start_time", "status"], "attended"), told(interest, "user", ["timestamp"], "interest")
    for kind in kinds:
        met = met.unionByName(kind, allowMissingColumns=True)
    found = met.dropna(subset=keys).groupBy(*keys).agg(*[F.min(c).alias(c) for c in ("_own", "attended", "interest")])
    about = events.select(F.col("event_id").alias("engaged_event"), F.struct(*fields(events, drop=["event_id"])).alias("event"))
    return found.where(F.col("_own").isNull()).join(about, "engaged_event", "left").select(
        *keys, F.struct("attended", "interest").alias("user_engagement_details"), "event"
    )


def _engagements_by_event(events: DataFrame, attendees: DataFrame, interest: DataFrame) -> DataFrame:
    """``_engagements`` of events of bounded size: all that is told of an event becomes one row, nothing is shuffled after that."""

    def first(df: DataFrame, user: str, order: list[str], name: str) -> DataFrame:
        rest = [c for c in df.columns if c not in (user, "event", *order)]
        record = F.struct(*[field(df, c) for c in [*order, *rest]])
        # dealt by the same plan as those of the event's list, filters included; a test of the user before would make it another
        near = df.dropna(subset=["event"]).where(F.col("event").isNotNull()).repartition("event").groupBy("event", user)
        found = near.agg(F.min(record).alias(name), F.max(user).alias("_user")).where(F.col("_user").isNotNull())
        lists = found.groupBy(F.col("event").alias("engaged_event")).agg(F.collect_list(F.struct(F.col("_user").alias("user"), name)).alias(f"_{name}"))
        return lists.join(about, "engaged_event", "left")

    row = F.struct("user_id", F.struct(*fields(events, drop=["event_id"])).alias("event"))
    about = events.select(F.col("event_id").alias("engaged_event"), row.alias("_row")).dropna(subset=["engaged_event"])
    # an event is one row but for copies of its key
    about = about.groupBy("engaged_event").agg(F.collect_list("_row").alias("_rows"))
    attended = first(attendees, "user_id", ["start_time", "status"], "attended")
    interested = first(interest, "user", ["timestamp"], "interest").withColumnRenamed("_rows", "_also")
    kinds = {name: df.schema[f"_{name}"].dataType.elementType[name].dataType for name, df in (("attended", attended), ("interest", interested))}

    def told(name: str) -> Column:
        both = [F.lit(name == n).alias(f"is_{n}") for n in kinds]
        return F.transform(
            F.coalesce(f"_{name}", F.array()),
            lambda e: F.struct(e["user"].alias("user"), *both, *[(e[n] if n == name else F.lit(None).cast(k)).alias(n) for n, k in kinds.items()]),
        )

    met = attended.join(interested, "engaged_event", "full").select(
        "engaged_event", F.coalesce("_rows", "_also", F.array()).alias("_rows"),
        # at most two entries of a user, those of attendance first
        F.array_sort(F.concat(*map(told, kinds)), lambda x, y: F.when(x["user"] < y["user"], -1).when(x["user"] > y["user"], 1).when(x["is_attended"], -1).otherwise(1)).alias("_told"),
    )

    def joined(e: Column, i: Column) -> Column:
        then = F.get("_told", i + 1)
        interest = F.when(e["user"] == then["user"], then["interest"]).otherwise(e["interest"])
        second = F.when(i > 0, F.get("_told", i - 1)["user"] == e["user"]).otherwise(F.lit(False))
        return F.struct(e["user"].alias("user"), e["attended"].alias("attended"), interest.alias("interest"), second.alias("second"))

    own = F.transform("_rows", lambda r: r["user_id"])
    others = F.filter(
        F.transform("_told", joined), lambda e: ~e["second"] & ~F.coalesce(F.exists(own, lambda u: u == e["user"]), F.lit(False))
    )
    found = met.select("engaged_event", "_rows", F.explode(others).alias("_one"))
    return found.select(
        F.col("_one.user").alias("engaged_user"), "engaged_event", F.struct("_one.attended", "_one.interest").alias("user_engagement_details"),
        F.explode_outer("_rows").alias("_row"),
    ).select("engaged_user", "engaged_event", "user_engagement_details", "_row.event")


# --- racing ---------------------------------------------------------------------------------------------


def driver_documents(db: Database, part_rows: int = PART_ROWS) -> DataFrame:
    """Drivers with seasons, races and their performance (team, qualifying, result with its status, standing).

    Databases without a table of teams or of statuses leave that field out.
    """
    nest = Nest(part_rows)
    circuits, races = db.df("circuits"), db.df("races")
    about = [c for c in circuits.columns if c != "circuitId"]
    races = lookup(races, circuits, "circuitId", "circuitId", about)
    race = races.select(F.col("raceId").alias("_race"), F.col("year").alias("_year"), F.struct(*fields(races, drop=["raceId"])).alias("race"))

    def others(name: str, order: list[str], alias: str) -> DataFrame:
        df = db.df(name)
        rest = [c for c in df.columns if c not in ("raceId", "driverId", *order)]
        return df.select("raceId", "driverId", F.struct(*[field(df, c) for c in [*order, *rest]]).alias(alias))

    results = db.df("results")
    own, team, said = fields(results, drop=["raceId", "driverId"]), [], []
    # a driver has at most as many starts as results, times the rows that a result may meet
    met = {"results": (results, "driverId"), "races": (races, "raceId")}
    if "constructors" in db.tables:
        met["constructors"] = (db.df("constructors"), "constructorId")
        results = _with(results, _dimension(db.df("constructors"), "constructorId", "constructor"), "constructorId", "constructor")
        team = ["constructor"]
    starts = results.select("raceId", "driverId", *team, F.struct(*own).alias("result"))
    # all that is told of a race meets in one shuffle, but for races of very many rows; the first record of each kind counts
    for kind in (others("qualifying", ["date"], "qualifying"), others("standings", ["date"], "championship_standing")):
        starts = starts.unionByName(kind, allowMissingColumns=True)
    start = ["raceId", "driverId"]
    spread = _longest({"race": (starts, "raceId")})["race"] > part_rows
    starts = starts.repartition(*(start if spread else ["raceId"])).withColumns({c: F.min(c).over(Window.partitionBy(*start)) for c in ("qualifying", "championship_standing")})
    starts = starts.where(F.col("result").isNotNull()).join(race, F.col("raceId") == F.col("_race")).where(F.col("_year").isNotNull())
    if "status" in db.tables:
        status = db.df("status")
        met["status"] = (status, "statusId")
        about = _dimension(status, "statusId", "status_text")
        # by a key of few values, all results would meet in as few tasks
        few = status.limit(FEW_ROWS + 1).count() <= FEW_ROWS
        starts = _with(starts.withColumn("statusId", F.col("result.statusId")), F.broadcast(about) if few else about, "statusId", "status_text")
        said = [F.struct("statusId", "status_text.*").alias("status")]
    most = _longest(met)
    longest = most["results"] * prod(max(1, n) for name, n in most.items() if name != "results")
    # where no driver outgrows a part, a driver's seasons are collected in one task, and not shuffled again
    whole = {"continued": False, "near": ["driverId"]} if longest <= part_rows else {}
    result = F.struct("result.*", *said).alias("result")
    item = F.struct("race", F.struct(*team, "qualifying", result, "championship_standing").alias("driver_performance"))
    seasons = nest.lists(starts, ["driverId", "_year"], item, ["raceId"], "races", "seasons.races", **whole)
    season = F.struct(F.col("_year").alias("year"), "races")
    # a driver has as many seasons as there are years
    listed = Child("seasons", seasons, "driverId", season, ["_year"], longest=longest if whole else None)
    drivers = nest.under(db.df("drivers"), "driverId", listed)
    return nest.documents(drivers, ["driverId"], fields(drivers))


# --- fashion --------------------------------------------------------------------------------------------


def purchase_documents(db: Database, part_rows: int = PART_ROWS) -> DataFrame:
    """Customers with their purchases, each with its article; customers without any stay."""
    nest = Nest(part_rows)
    article = _dimension(db.df("article"), "article_id", "article_purchased")
    bought = _with(db.df("transactions"), article, "article_id", "article_purchased")
    item = F.struct(
        field(bought, "t_dat").alias("transaction_date"), "price", "sales_channel_id", "article_purchased"
    )
    purchases = Child("purchase_history", bought, "customer_id", item, ["t_dat", "article_id"])
    customers = nest.under(db.df("customer"), "customer_id", purchases)
    return nest.documents(customers, ["customer_id"], fields(customers))


# --- forum ----------------------------------------------------------------------------------------------


def forum_user_documents(db: Database, part_rows: int = PART_ROWS) -> DataFrame:
    """Users with posts (comments, votes, history, links), badges, comments and votes."""
    nest = Nest(part_rows)
    names = {"comments": "comments", "votes": "votes", "postHistory": "post_history", "postLinks": "post_links"}
    below = [
        Child(name, db.df(t), "PostId", F.struct(*fields(db.df(t), drop=["PostId"])), ["CreationDate", "Id"], f"posts.{name}")
        for t, name in names.items()
    ]
    posts = nest.under(db.df("posts"), "Id", *below)
    children = [
        Child(
            "posts", posts, "OwnerUserId", F.struct(*fields(posts, drop=["OwnerUserId"])), ["CreationDate", "Id"],
            holds=tuple(names.values()),
        )
    ]
    for table, time, name in (("badges", "Date", "badges"), ("comments", "CreationDate", "user_comments"), ("votes", "CreationDate", "user_votes")):
        rows = db.df(table)
        children.append(Child(name, rows, "UserId", F.struct(*fields(rows, drop=["UserId"])), [time, "Id"]))
    users = nest.under(db.df("users"), "Id", *children)
    return nest.documents(users, ["Id"], fields(users))


# --- trials ---------------------------------------------------------------------------------------------

_MANY = (
    ("sponsors", "sponsor_id"), ("facilities", "facility_id"), ("conditions", "condition_id"), ("interventions", "intervention_id"),
)


def study_documents(db: Database, part_rows: int = PART_ROWS) -> DataFrame:
    """Studies with design, eligibility, linked entities, outcomes (with analyses) and events."""
    nest = Nest(part_rows)
    studies = db.df("studies")
    for table, name in (("designs", "design"), ("eligibilities", "eligibility")):
        if table in db.tables:
            studies = _with(studies, _dimension(db.df(table), "nct_id", name), "nct_id", name)
    children = []
    for name, key in _MANY:
        if name in db.tables:
            rows = db.df(f"{name}_studies").join(db.df(name), key)
            children.append(Child(name, rows, "nct_id", F.struct(*fields(rows, drop=["nct_id"])), ["date", key]))
    outcomes, analyses = db.df("outcomes"), db.df("outcome_analyses")
    below = Child(
        "analyses", analyses, "outcome_id", F.struct(*fields(analyses, drop=["outcome_id"])), ["date", "p_value"], "outcomes.analyses"
    )
    outcomes = nest.under(outcomes, "id", below)
    children.append(
        Child("outcomes", outcomes, "nct_id", F.struct(*fields(outcomes, drop=["nct_id"])), ["id"], holds=("analyses",))
    )
    for table in ("drop_withdrawals", "reported_event_totals"):
        if table in db.tables:
            rows = db.df(table)
            children.append(Child(table, rows, "nct_id", F.struct(*fields(rows, drop=["nct_id"])), ["date"]))
    studies = nest.under(studies, "nct_id", *children)
    return nest.documents(studies, ["nct_id"], fields(studies))


# --- sampling of documents --------------------------------------------------------------------------------


def sampled_ids(tables: Sequence[tuple[DataFrame, int]], entity: str, order: Sequence[str]) -> DataFrame:
    """Distinct entity ids of the first n rows of each label table, along an explicit order."""
    # only what decides is sorted, not the whole rows
    narrow = [(df.select(*dict.fromkeys([entity, *order])), n) for df, n in tables]
    heads = [first_rows(df, order, n).select(entity) for df, n in narrow]
    return union_all(heads).distinct()


def documents_of(documents: DataFrame, ids: DataFrame, key: str, order: str) -> DataFrame:
    """Documents of the given ids with all their parts, the first along ``order`` where an id has several."""
    wanted = documents.join(ids.select(F.col(ids.columns[0]).alias("_id")).distinct(), F.col(key) == F.col("_id"), "left_semi")
    by = [key, *[c for c in ("section", "part") if c in documents.columns]]
    rest = [c for c in documents.columns if c not in by]
    return wanted.groupBy(*by).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_d")).select(*by, "_d.*")


DOCUMENTS = {
    "customer": customer_documents,
    "item": item_documents,
    "classifieds_user": classifieds_user_documents,
    "meetup_user": meetup_user_documents,
    "driver": driver_documents,
    "purchase": purchase_documents,
    "forum_user": forum_user_documents,
    "study": study_documents,
}

__all__ = ["DOCUMENTS", "Nest", "documents_of", "json_safe", "labelled_documents", "sampled_ids"]
