"""Raw files of every schema, from small hand-written files to labels."""

import gzip
import json
from datetime import datetime

import pytest

from chronograin.operators import integrity
from chronograin.plans.catalog import get_task
from chronograin.sources import raw


def put(folder, name, header, rows, sep=","):
    text = "\n".join([sep.join(header), *[sep.join(str(v) for v in r) for r in rows]]) + "\n"
    (folder / name).write_text(text)


def ids(db, table, *cols):
    return sorted(tuple(r) for r in db.df(table).select(*cols).collect())


def test_shop(spark, tmp_path):
    products = [
        {"asin": "p1", "title": "b", "price": "$1,000.50", "category": [], "description": ["d", "e"], "extra": 1},
        {"asin": "p1", "title": "a", "price": "$2.00 - $3.00", "category": ["x"], "description": []},
        {"asin": "p2", "title": "c", "price": "call us"},
        {"asin": "p3", "title": "never sold", "price": "$4"},
    ]
    reviews = [
        {"asin": "p1", "reviewerID": "u1", "reviewerName": "new name", "unixReviewTime": 1300000000, "overall": 5.0},
        {"asin": "p1", "reviewerID": "u1", "reviewerName": "name", "unixReviewTime": 1200000000, "overall": 4.0},
        {"asin": "p2", "reviewerID": "u2", "unixReviewTime": 1200000000},
        {"asin": "p1", "reviewerID": "u3", "unixReviewTime": 1000000000},
    ]
    with gzip.open(tmp_path / "meta.json.gz", "wt") as f:
        f.write("\n".join(map(json.dumps, products)))
    (tmp_path / "reviews.json").write_text("\n".join(map(json.dumps, reviews)))
    db = raw.shop(spark, str(tmp_path / "meta.json.gz"), str(tmp_path / "reviews.json"))
    assert [tuple(r) for r in db.df("product").select("product_id", "title", "price", "category", "description").collect()] == [
        ("p1", "a", 2.0, ["x"], None)
    ]
    assert ids(db, "customer", "customer_id", "customer_name") == [("u1", "name"), ("u3", None)]
    assert ids(db, "review", "customer_id", "review_time") == [
        ("u1", datetime.fromtimestamp(1200000000)), ("u1", datetime.fromtimestamp(1300000000)),
    ]


def test_racing(spark, tmp_path):
    put(tmp_path, "races.csv", ["raceId", "year", "circuitId", "date", "time", "url"],
        [[1, 2004, 1, "2004-03-07", "03:00:00"] + ["u"], [2, 2004, 1, "2004-03-21", "\\N", "u"]])
    put(tmp_path, "circuits.csv", ["circuitId", "name", "alt", "url"], [[1, "ring", "\\N", "u"]])
    put(tmp_path, "drivers.csv", ["driverId", "number", "dob", "url"], [[7, 44, "1980-01-02", "u"]])
    put(tmp_path, "constructors.csv", ["constructorId", "name", "url"], [[3, "team", "u"]])
    put(tmp_path, "results.csv",
        ["resultId", "raceId", "driverId", "constructorId", "positionOrder", "statusId", *raw.RESULT_NUMBERS, "positionText", "time"],
        [[1, 1, 7, 3, 2, 1, *["\\N"] * 4, 8.5, 50, "\\N", "x", "R", "t"]])
    put(tmp_path, "driver_standings.csv", ["driverStandingsId", "raceId", "driverId", "points", "positionText"], [[1, 2, 7, 3, "1"]])
    put(tmp_path, "constructor_results.csv", ["constructorResultsId", "raceId", "constructorId", "status"], [[1, 1, 3, "D"]])
    put(tmp_path, "constructor_standings.csv", ["constructorStandingsId", "raceId", "constructorId", "positionText"], [[1, 1, 3, "1"]])
    put(tmp_path, "qualifying.csv", ["qualifyId", "raceId", "driverId", "constructorId", "position", "q1", "q2", "q3"], [[1, 1, 7, 3, 2, "", "", ""]])
    db = raw.racing(spark, str(tmp_path))
    assert ids(db, "races", "raceId", "date") == [(1, datetime(2004, 3, 7, 3)), (2, datetime(2004, 3, 21))]
    assert ids(db, "qualifying", "driverId", "date") == [(7, datetime(2004, 3, 6, 3))]
    result = db.df("results").first().asDict()
    assert (result["points"], result["laps"], result["rank"], result["fastestLap"]) == (8.5, 50.0, None, None)
    assert not {"url", "positionText", "time"} & {c for t in ("results", "drivers", "circuits") for c in db.df(t).columns}
    assert db.df("circuits").first()["alt"] is None
    store = str(tmp_path / "store")
    first = raw.get_dataset(spark, "racing", str(tmp_path), store=store)
    again = raw.get_dataset(spark, "racing", "/nowhere", store=store)
    for dataset in (first, again):
        assert ids(dataset.full_db, "results", "resultId", "raceId", "driverId") == [(0, 0, 0)]
        assert dataset.full_db["results"].fkeys["raceId"] == "races"


def test_meetups(spark, tmp_path):
    put(tmp_path, "users.csv", ["user_id", "birthyear", "joinedAt"], [[1, "None", "2012-10-02T06:40:55.524Z"], [2, 1990, "never"], [3, 1980, "2012-09-01"]])
    with gzip.open(tmp_path / "events.csv.gz", "wt") as f:
        f.write("event_id,user_id,start_time,c_1,c_2\n10,1,2012-11-01T01:00:00.003Z,2,0\n")
    put(tmp_path, "train.csv", ["user", "event", "timestamp", "interested"], [[1, 10, "2012-10-02 15:53:05.754000+00:00", 1]])
    put(tmp_path, "user_friends.csv", ["user", "friends"], [[1, "2 99 3"], [2, ""]])
    put(tmp_path, "event_attendees.csv", ["event", "yes", "maybe", "invited", "no"], [[10, "1 2", "", 3, ""], [11, "", "", "", 1]])
    db = raw.meetups(spark, str(tmp_path))
    assert ids(db, "user_friends", "user", "friend") == [(1, 2), (1, 3)]
    start = datetime(2012, 11, 1, 1, 0, 0, 3000)
    rows = {(r.event, r.status, r.user_id, r.start_time) for r in db.df("event_attendees").collect()}
    assert rows == {(10, "yes", 1, start), (10, "yes", 2, start), (10, "invited", 3, start), (11, "no", 1, None)}
    assert {r.user_id: (r.birthyear, r.joinedAt) for r in db.df("users").collect()} == {
        1: (None, datetime(2012, 10, 2, 6, 40, 55, 524000)), 2: (1990.0, None), 3: (1980.0, datetime(2012, 9, 1)),
    }
    assert db.df("event_interest").first()["timestamp"] == datetime(2012, 10, 2, 15, 53, 5, 754000)


def test_fashion(spark, tmp_path):
    put(tmp_path, "articles.csv", ["article_id", "prod_name"], [[108775015, "strap"]])
    put(tmp_path, "customers.csv", ["customer_id", "age"], [["00ab", 30]])
    put(tmp_path, "transactions_train.csv", ["t_dat", "customer_id", "article_id", "price", "sales_channel_id"],
        [["2019-09-06", "00ab", 108775015, 0.05, 2], ["2019-09-07", "00ab", 108775015, 0.03, 2]])
    db = raw.fashion(spark, str(tmp_path))
    assert ids(db, "transactions", "t_dat", "price") == [(datetime(2019, 9, 7), 0.03)]


def test_forum(spark, tmp_path):
    put(tmp_path, "Users.csv", ["Id", "CreationDate", "Reputation", "Views", "UpVotes", "DownVotes", "LastAccessDate"],
        [[-1, "2010-01-01 00:00:00", 1, 1, 1, 1, "x"], [5, "2011-01-01 00:00:00", 1, 1, 1, 1, "x"], [6, "broken", 1, 1, 1, 1, "x"]])
    put(tmp_path, "Posts.csv", ["Id", "CreationDate", "OwnerUserId", "ParentId", "AcceptedAnswerId", "PostTypeId", "Body", "Score"],
        [[1, "2011-02-01 10:00:00.25", 5, "", 2, 1, '"two\nlines, ""quoted"""', 3], [2, "2011-02-02 10:00:00", 5, 1, "", 2, "b", 0]])
    for name in ("Comments", "Votes", "PostHistory"):
        put(tmp_path, f"{name}.csv", ["Id", "PostId", "UserId", "CreationDate"], [[1, 1, 5, "2011-03-01 00:00:00"]])
    put(tmp_path, "Badges.csv", ["Id", "UserId", "Date"], [[1, 5, "2011-03-01 00:00:00"]])
    put(tmp_path, "PostLinks.csv", ["Id", "PostId", "RelatedPostId", "CreationDate"], [[1, 1, 2, "2011-03-01 00:00:00"]])
    db = raw.forum(spark, str(tmp_path))
    assert ids(db, "users", "Id") == [(-1,), (5,)]
    post = db.df("posts").where("Id = 1").first()
    assert (post.Body, post.CreationDate, "Score" in db.df("posts").columns) == (
        'two\nlines, "quoted"', datetime(2011, 2, 1, 10, 0, 0, 250000), False,
    )
    renumbered = integrity.reindex(db)
    assert ids(renumbered, "posts", "Id", "OwnerUserId") == [(0, 1), (1, 1)]
    assert [tuple(r) for r in renumbered.df("posts").orderBy("Id").select("ParentId", "AcceptedAnswerId").collect()] == [(None, 1), (0, None)]


def trial_files(folder):
    wide = [c for c in raw.KEPT["studies"] if c not in ("nct_id", "start_date")]
    rows = [["n1", "2005-01-31", "2006-02-28", "Actual"], ["n2", "1999-01-01", "2001-01-01", "Actual"],
            ["n3", "2005-01-01", "2006-01-01", "Anticipated"], ["n4", "2005-05-01", "2006-06-01", "Actual"], ["n5", "2005-07-01", "2006-05-01", "Actual"]]
    put(folder, "studies.txt", ["nct_id", "start_date", "completion_date", "completion_date_type", *wide], [r + ["w"] * len(wide) for r in rows], "|")
    for name in ("detailed_descriptions", "brief_summaries"):
        put(folder, f"{name}.txt", ["id", "nct_id", "description"], [[1, "n1", '"a | b"']], "|")
    outcome = [c for c in raw.KEPT["outcomes"] if c not in ("id", "nct_id", "outcome_type")]
    put(folder, "outcomes.txt", ["id", "nct_id", "outcome_type", *outcome],
        [[i, n, "Primary", *["w"] * len(outcome)] for i, n in ((1, "n1"), (2, "n2"), (3, "n4"), (4, "n5"))], "|")
    put(folder, "outcome_analyses.txt", ["id", "nct_id", "outcome_id", "p_value", "p_value_modifier"],
        [[1, "n1", 1, 0.01, ""], [2, "n4", 3, 0.01, ">"], [3, "n4", 3, 0.3, "="], [4, "n5", 4, 0.01, ""]], "|")
    put(folder, "reported_event_totals.txt", raw.KEPT["reported_event_totals"], [[1, "n1", "serious", "c", 4, 9]], "|")
    put(folder, "drop_withdrawals.txt", ["id", "nct_id", "reason", *raw.DROPPED["trials"]["drop_withdrawals"]], [[1, "n1", "r", *["w"] * 5]], "|")
    for name in ("designs", "eligibilities"):
        put(folder, f"{name}.txt", ["id", "nct_id", "v"], [[1, "n1", "x"]], "|")
    put(folder, "sponsors.txt", ["id", "nct_id", "name", "agency_class", "lead_or_collaborator"],
        [[1, "n1", "S", "a", "lead"], [2, "n4", "T", "a", "lead"], [3, "n4", "S", "b", "collaborator"]], "|")
    put(folder, "facilities.txt", ["id", "nct_id", "name", "city", "state", "zip", "country"], [[1, "n1", "F", "c", "s", "z", "x"]], "|")
    for name in ("conditions", "interventions"):
        put(folder, f"browse_{name}.txt", ["id", "nct_id", "mesh_term", "downcase_mesh_term", "mesh_type"],
            [[1, "n1", "M", "m", "mesh-list"], [2, "n1", "A", "a", "mesh-ancestor"]], "|")


def test_trials(spark, tmp_path):
    trial_files(tmp_path)
    db = raw.trials(spark, str(tmp_path))
    assert ids(db, "studies", "nct_id") == [("n1",), ("n4",), ("n5",)]
    assert db.df("studies").where("nct_id = 'n1'").first()["brief_summaries"] == "a | b"
    assert ids(db, "outcomes", "id", "date") == [
        (1, datetime(2006, 2, 28)), (3, datetime(2006, 6, 1)), (4, datetime(2006, 5, 1)),
    ]
    assert ids(db, "sponsors", "sponsor_id", "name", "agency_class") == [(0, "S", "a"), (1, "T", "a")]
    assert ids(db, "sponsors_studies", "id", "sponsor_id", "date") == [
        (1, 0, datetime(2005, 1, 31)), (2, 1, datetime(2005, 5, 1)), (3, 0, datetime(2005, 5, 1)),
    ]
    assert ids(db, "conditions", "condition_id", "mesh_term") == [(0, "M")]
    task = get_task("trials", "study-outcome")
    from chronograin.grid import Grid

    grid = Grid("train", datetime(2005, 6, 1), task.delta, 2)
    got = sorted((r.timestamp.year, r.nct_id, r.outcome) for r in task.build(db, [grid]).collect())
    # n5 ends in the window but had not begun at the anchor
    assert got == [(2005, "n1", 1), (2005, "n4", 0)]


def test_classifieds(spark, tmp_path):
    frames = {
        "AdsInfo": ("AdID int, LocationID int, CategoryID int, Title string, Params map<int,string>", [(1, 1, 1, None, {1: "x"}), (None, 1, 1, "t", None)]),
        "Category": ("CategoryID int, Level int, __index_level_0__ bigint", [(1, 1, 0)]),
        "Location": ("LocationID int, Level int", [(1, 1), (None, 2)]),
        "PhoneRequestsStream": ("UserID int, AdID int, PhoneRequestDate string", [(1, 1, "2015-05-01 10:00:00")]),
        "SearchInfo": ("SearchID int, UserID int, LocationID int, CategoryID int, SearchDate string, SearchParams map<int,string>",
                       [(1, 1, 1, 1, "2015-05-01 10:00:00", None), (2, 1, 1, 1, "2015-04-01 10:00:00", None)]),
        "SearchStream": ("SearchID int, AdID int, SearchDate string, IsClick double", [(1, 1, "2015-05-01 10:00:00", 1.0), (1, 1, "?", 1.0)]),
        "UserInfo": ("UserID int", [(1,)]),
        "VisitStream": ("UserID int, AdID int, ViewDate string", [(1, 1, "2015-05-02 10:00:00")]),
    }
    for name, (schema, rows) in frames.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / name))
    db = raw.classifieds(spark, str(tmp_path))
    assert ids(db, "AdsInfo", "AdID", "Title") == [(1, "")]
    assert ids(db, "SearchInfo", "SearchID") == [(1,)]
    assert db.df("SearchStream").count() == 1
    assert not {"Params", "SearchParams", "__index_level_0__"} & {c for t in db.tables.values() for c in t.df.columns}


def test_unknown_schema(spark):
    with pytest.raises(KeyError, match="no schema"):
        raw.get_dataset(spark, "nope")
