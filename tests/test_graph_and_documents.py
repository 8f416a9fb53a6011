"""Sampling invariants, brute force on small graphs, documents in parts."""

import json
import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from chronograin.model import Database, Table, TaskKind
from chronograin.operators import documents, graph
from chronograin.plans.catalog import get_task
from chronograin.queries.databases import fashion, shop

T0 = datetime(2020, 1, 1)


def tiny(spark, n=400):
    """One customer holds a third of all reviews; some references have no row."""
    rng = random.Random(5)
    rows = [
        (3 if rng.random() < 0.35 else rng.randrange(12), rng.randrange(9), T0 + timedelta(hours=rng.randrange(300)), i) for i in range(n)
    ]
    review = spark.createDataFrame(rows, "customer_id bigint, product_id bigint, review_time timestamp_ntz, nr int")
    customer = spark.createDataFrame([(i, f"c{i}") for i in range(10)], "customer_id bigint, customer_name string")
    product = spark.createDataFrame([(i, f"p{i}") for i in range(8)], "product_id bigint, title string")
    tables = {
        "customer": Table(customer, "customer_id"),
        "product": Table(product, "product_id"),
        "review": Table(review, None, "review_time", {"customer_id": "customer", "product_id": "product"}),
        "relations": Table(review.select("customer_id", "product_id"), None, None, {"customer_id": "customer", "product_id": "product"}),
    }
    return rows, Database(tables)


def test_edges_have_both_directions_and_no_dangling_ends(spark):
    rows, db = tiny(spark)
    db = graph.with_row_ids(db)
    edges = graph.fk_edges(db).cache()
    kinds = Counter((r.edge_type, r.src_table, r.dst_table) for r in edges.collect())
    assert set(kinds) == set(graph.edge_types(db)) and len(kinds) == 8
    assert kinds["f2p_customer_id", "review", "customer"] == sum(c < 10 for c, *_ in rows)
    assert kinds["rev_f2p_product_id", "product", "relations"] == sum(p < 8 for _, p, *_ in rows)
    ids = sorted(r.row_id for r in db.df("review").collect())
    assert ids == list(range(len(rows)))


def test_table_without_features_gets_a_constant(spark):
    _, db = tiny(spark, 20)
    node = graph.node_table(graph.with_row_ids(db)["relations"])
    assert node.columns == ["row_id", "unix_time", "const"]
    assert {(r.unix_time, r.const) for r in node.collect()} == {(None, 1.0)}


@pytest.mark.parametrize("strategy", ["last", "uniform"])
def test_neighbors_respect_time_and_fan_out(spark, strategy):
    _, db = tiny(spark)
    db = graph.with_row_ids(db)
    edges = graph.fk_edges(db)
    seeds = [(s, 1577836800 + 3600 * h, c) for s, (h, c) in enumerate((h, c) for h in (0, 20, 150, 400) for c in range(10))]
    asks = spark.createDataFrame(seeds, "seed_id bigint, seed_time bigint, dst_id bigint").select(
        "*", F.lit("f2p_customer_id").alias("edge_type"), F.lit("review").alias("src_table"), F.lit("customer").alias("dst_table")
    )
    got = defaultdict(list)
    for r in graph.temporal_neighbors(edges, asks, 6, strategy, 1).collect():
        got[r.seed_id].append((r.src_time, r.src_id))
    into = defaultdict(list)
    for r in edges.where("edge_type = 'f2p_customer_id' and src_table = 'review'").collect():
        into[r.dst_id].append((r.src_time, r.src_id))
    for s, t, c in seeds:
        seen = sorted(e for e in into[c] if e[0] <= t)
        assert len(got[s]) == len(set(got[s])) == min(6, len(seen))
        assert set(got[s]) <= set(seen)
        if strategy == "last":
            assert sorted(got[s]) == seen[-6:]
    everything = graph.temporal_neighbors(edges, asks, -1).count()
    assert everything == sum(e[0] <= t for _, t, c in seeds for e in into[c])


def test_uniform_sampling_reaches_every_neighbor_about_equally(spark):
    edges = spark.createDataFrame([(i, i) for i in range(20)], "src_id bigint, src_time bigint").select(
        F.lit("e").alias("edge_type"), F.lit("a").alias("src_table"), F.lit("b").alias("dst_table"), F.lit(1).cast("bigint").alias("dst_id"), "src_id", "src_time"
    )
    asks = spark.range(3000).select(
        F.col("id").alias("seed_id"), F.lit(100).cast("bigint").alias("seed_time"), F.lit("e").alias("edge_type"),
        F.lit("a").alias("src_table"), F.lit("b").alias("dst_table"), F.lit(1).cast("bigint").alias("dst_id"),
    )
    counts = Counter(r.src_id for r in graph.temporal_neighbors(edges, asks, 6, "uniform", 9).collect())
    assert len(counts) == 20 and sum(counts.values()) == 18000
    assert all(750 < n < 1050 for n in counts.values())


def test_subgraphs_expand_each_node_once_per_seed(spark):
    _, db = tiny(spark, 120)
    db = graph.with_row_ids(db)
    seeds = spark.createDataFrame([(i, 1577836800 + 3600 * 200, i) for i in range(10)], "seed_id bigint, seed_time bigint, node_id bigint")
    out = graph.sample_subgraphs(db, "customer", seeds, graph.halving(6, 3), "uniform", 3).collect()
    assert {r.hop for r in out} == {1, 2, 3}
    assert all(r.src_time is None or r.src_time <= r.seed_time for r in out)
    asked = defaultdict(set)
    per_ask = Counter()
    for r in out:
        asked[r.seed_id, r.dst_table, r.dst_id].add(r.hop)
        per_ask[r.seed_id, r.hop, r.edge_type, r.src_table, r.dst_id] += 1
    assert all(len(h) == 1 for h in asked.values())
    assert all(n <= {1: 6, 2: 3, 3: 1}[key[1]] for key, n in per_ask.items())


def test_empty_edges_give_an_empty_sample(spark):
    _, db = tiny(spark, 5)
    db = graph.with_row_ids(db.map(lambda t: t.with_df(t.df.where("false"))))
    seeds = spark.createDataFrame([(1, 10**10, 1)], "seed_id bigint, seed_time bigint, node_id bigint")
    assert graph.sample_subgraphs(db, "customer", seeds, [4, 2]).count() == 0


def test_batches_are_full_and_share_their_time(spark):
    rows = [(i, 1 if i < 70 else 2 + i % 3) for i in range(200)]
    df = spark.createDataFrame(rows, "input_id bigint, unix_time bigint")
    out = graph.same_time_batches(df, 16, 1).collect()
    sizes = Counter((r.unix_time, r.batch) for r in out)
    assert set(sizes.values()) == {16}
    want = Counter(t for _, t in rows)
    assert Counter(t for t, _ in sizes) == {t: n // 16 for t, n in want.items()}
    assert len({r.input_id for r in out}) == len(out)


def test_triples_take_a_true_destination(spark):
    links = spark.createDataFrame([(i, i, d, 5) for i in range(30) for d in range(i % 4 + 1)], "input_id bigint, src bigint, dst bigint, unix_time bigint")
    out = graph.link_triples(links, 50, 3).collect()
    assert len(out) == 30
    assert all(0 <= r.pos_dst <= r.src % 4 and 0 <= r.neg_dst < 50 for r in out)


def test_node_input_types(spark):
    df = spark.createDataFrame([(T0, 4, 1)], "timestamp timestamp_ntz, u int, y int")
    row = graph.node_train_input(df, "u", "y", TaskKind.REGRESSION).first()
    assert (row.node, row.unix_time, row.target) == (4, 1577836800, 1.0)
    assert "target" not in graph.node_train_input(df.drop("y"), "u", "y", TaskKind.REGRESSION).columns


@pytest.mark.parametrize("part_rows", [25, 100_000])
def test_document_parts_add_up(spark, part_rows):
    rows, db = tiny(spark)
    docs = documents.customer_documents(db, part_rows).collect()
    assert (any(d.section for d in docs)) == (part_rows == 25)
    got = defaultdict(list)
    for d in sorted(docs, key=lambda d: (d.key, d.part)):
        doc = json.loads(d.doc)
        assert len(doc["reviews"]) <= part_rows
        got[int(d.key)] += [(r["review_time"], r["product"]["product_id"]) for r in doc["reviews"]]
    want = defaultdict(list)
    for c, p, t, _ in sorted(rows, key=lambda r: (r[2], r[1])):
        want[c].append((t.strftime("%Y-%m-%d %H:%M:%S"), p))
    assert got == want


def test_nested_parts_weigh_their_children(spark, small_dir):
    whole = documents.forum_user_documents
    from chronograin.queries.databases import forum

    db = forum(spark, small_dir).full_db

    def leaves(docs):
        posts, votes = set(), 0
        for d in docs:
            doc = json.loads(d.doc)
            for post in doc.get("posts", []):
                assert post["Id"] not in posts
                posts.add(post["Id"])
                votes += len(post["votes"])
            if d.section == "posts.votes":
                votes += len(doc["votes"])
        return len(posts), votes

    one, many = whole(db).collect(), whole(db, 20).collect()
    assert len(many) > len(one)
    assert leaves(one) == leaves(many)


def test_documents_keep_customers_without_purchases(spark, small_dir):
    db = fashion(spark, small_dir).full_db
    none = Database({**db.tables, "transactions": db["transactions"].with_df(db.df("transactions").where("false"))})
    docs = documents.purchase_documents(none).collect()
    assert len(docs) == db["customer"].count()
    assert all(json.loads(d.doc)["purchase_history"] == [] for d in docs)


def test_masked_tables_hide_the_answer(spark, small_dir):
    dataset, task = shop(spark, small_dir), get_task("shop", "user-item-purchase")
    assert task.table(dataset, "test").df.columns == ["timestamp", "customer_id"]
    assert "product_id" in task.table(dataset, "test", keep_dst=True).df.columns
    assert "product_id" in task.table(dataset, "val").df.columns


def test_validation_needs_rows_up_to_the_end_of_its_window(spark):
    from chronograin.model import Dataset

    rows = [(1, 1, T0 + timedelta(days=d)) for d in (*range(0, 600, 7), 700)]
    review = spark.createDataFrame(rows, "customer_id bigint, product_id bigint, review_time timestamp_ntz")
    one = spark.createDataFrame([(1,)], "customer_id bigint")
    db = Database({"customer": Table(one, "customer_id"), "review": Table(review, None, "review_time", {"customer_id": "customer"})})
    task = get_task("shop", "user-churn")
    late = Dataset(db, T0 + timedelta(days=510), T0 + timedelta(days=601))
    with pytest.raises(RuntimeError, match="val window ends after"):
        task.grids(late)
    fine = Dataset(db, T0 + timedelta(days=497), T0 + timedelta(days=595))
    assert [g.count for g in task.grids(fine)] == [5, 1, 1]
    assert {r.churn for r in task.table(fine, "val").df.collect()} == {0}


def test_own_task_end_to_end(spark, small_dir):
    from chronograin.operators import windows
    from chronograin.operators.baselines import entity_prediction, majority_of
    from chronograin.plans.catalog import REGISTRY
    from chronograin.plans.task import EntityTask

    def reviews(db, grids):
        return windows.aggregate(db.df("review"), "product_id", "review_time", grids, n=F.count(F.lit(1)))

    task = EntityTask("item-reviews", TaskKind.REGRESSION, timedelta(days=60), reviews, ("mae", "r2"),
                      entity_col="product_id", entity_table="product", target_col="n")
    REGISTRY.register("shop", task)
    try:
        assert REGISTRY.get("shop", "item-reviews") is task
    finally:
        REGISTRY.tasks["shop"].pop("item-reviews")
    dataset = shop(spark, small_dir)
    train, test = task.table(dataset, "train").df, task.table(dataset, "test").df
    assert test.columns == ["timestamp", "product_id"]
    scores = task.evaluate(dataset, entity_prediction(train, test, "product_id", "n", "entity_mean"))
    assert scores["mae"] > 0 and set(scores) == {"mae", "r2"}
    rows = task.stats(dataset).where("timestamp is null").collect()
    assert {r.split for r in rows} == {"train", "val", "test", "total"}
    assert 0 < task.overlap(dataset).first()[0] <= 1
    assert majority_of(train, "n").first()[0] >= 1


@pytest.mark.parametrize("name", ["write_jsonl_documents", "row_count_file"])
def test_files_of_documents_do_not_depend_on_the_size_of_parts(spark, small_dir, name):
    from chronograin.queries import storage

    run = storage.BOOK.queries[name]
    whole, parted = (sorted(map(tuple, run(spark, small_dir, n).collect()), key=str) for n in (100_000, 2))
    assert whole == parted


def test_all_parts_of_sampled_documents_are_kept(spark, small_dir):
    from chronograin.queries.databases import DATASETS

    docs = documents.purchase_documents(DATASETS["fashion"](spark, small_dir).full_db, 2)
    ids = docs.where("section <> ''").select("key").distinct().limit(5)
    kept = documents.documents_of(docs, ids, "key", "doc").collect()
    wanted = docs.join(ids, "key", "left_semi").collect()
    assert len(kept) == len(wanted) > 10
    lines = [json.loads(r["doc"]) for r in kept if r["section"]]
    assert all(line["customer_id"] and line[documents.CONTINUES] == "purchase_history" and line["part"] for line in lines)


def test_masked_lists_give_one_row_per_source(spark, small_dir):
    from dataclasses import replace

    from chronograin.plans.catalog import get_task
    from chronograin.queries.databases import DATASETS

    task, dataset = get_task("shop", "user-item-rate"), DATASETS["shop"](spark, small_dir)
    small = replace(task, part_rows=1, time_name="seen_at")
    plain = task.table(dataset, "test").df
    masked = small.table(dataset, "test").df
    assert masked.columns == ["seen_at", "customer_id"]
    assert sorted(map(tuple, masked.collect())) == sorted(map(tuple, plain.collect()))
    parts = small.table(dataset, "test", keep_dst=True).df
    assert parts.count() > masked.count()


def test_unfinished_cache_is_written_anew(spark, small_dir, tmp_path):
    from chronograin.plans.catalog import get_task
    from chronograin.queries.databases import DATASETS

    task, dataset = get_task("shop", "user-churn"), DATASETS["shop"](spark, small_dir)
    (tmp_path / f"{task.name}-val.parquet").mkdir()
    spark.range(3).write.mode("overwrite").parquet(f"file://{tmp_path}/{task.name}-val.parquet")
    (tmp_path / f"{task.name}-val.parquet" / "_SUCCESS").unlink()
    assert task.table(dataset, "val", cache_dir=f"file://{tmp_path}").df.columns == ["timestamp", "customer_id", "churn"]


def test_spread_asks_are_not_broadcast(spark):
    """Spark knows these frames to be small, as it takes spread asks to be."""
    into = [F.lit("e").alias("edge_type"), F.lit("f").alias("src_table"), F.lit("c").alias("dst_table"), (F.col("id") % 3).alias("dst_id")]
    none = F.lit(None).cast("bigint").alias("dst_time")
    edges = spark.range(30).select(*into, F.col("id").alias("src_id"), F.col("id").alias("src_time"), none)
    asks = spark.range(6).select(*into, F.col("id").alias("seed_id"), F.lit(9).cast("bigint").alias("seed_time"))
    for k, on in ((-1, "dst_id"), (2, "_pos")):
        found = graph.temporal_neighbors(edges, asks, k)
        joins = [x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x and on in x]
        assert joins and all("SortMergeJoin" in x for x in joins), joins
        assert found.count() == (20 if k < 0 else 12)


@pytest.mark.parametrize("part_rows", [10, 100_000])
def test_labelled_documents_collect_a_customer_once(spark, part_rows):
    rows, db = tiny(spark)
    asked = [(c, T0 + timedelta(hours=h), h % 2) for c in [*range(12), None] for h in (-1, 100, 200, 400)]
    asked += asked[:1]
    labels = spark.createDataFrame(asked, "customer_id bigint, timestamp timestamp_ntz, churn int")
    found = documents.labelled_documents(db, labels, "churn", part_rows)
    if part_rows > len(rows):
        # reviews are dealt by customer; no row for each label that follows them
        assert "hashpartitioning(customer_id" in (plan := found._jdf.queryExecution().executedPlan().toString())
        assert not [x for x in plan.splitlines() if "hashpartitioning(" in x and "timestamp" in x]
    got = defaultdict(list)
    mains = Counter()
    for r in sorted(found.collect(), key=lambda r: (r.key, r.part)):
        doc = json.loads(r.doc)
        mains[r.key] += r.part == 0
        got[r.key] += [x["review_time"] for x in doc["reviews"]]
    for c, t, _ in set(asked):
        key = f"{c}|{t}" if c is not None else str(t)
        want = sorted(str(at) for own, _, at, _ in rows if own == c and at <= t)
        assert got[key] == want * mains[key] if part_rows > len(rows) else got[key][: len(want)] == want, key
    assert sum(mains.values()) == len(asked)


def test_lists_are_dealt_as_plain_columns_and_weighed_only_where_they_may_outgrow_a_part(spark, small_dir, monkeypatch):
    from chronograin.queries.databases import forum

    db = forum(spark, small_dir).full_db
    # parts that single lists stay below, but the lists of a post's lists would not
    parted = documents.forum_user_documents(db, 100)
    assert parted.where("section = 'posts'").count() > 0

    def weigh(*_):
        raise AssertionError("lists that cannot outgrow a part were weighed")

    monkeypatch.setattr(documents, "hot_keys", weigh)
    plan = documents.forum_user_documents(db)._jdf.queryExecution().optimizedPlan().toString()
    # times become text in the document itself only
    assert "date_format" not in plan


def _racing(spark):
    """Races and results that come twice, unknown and NULL keys, several records of a kind, equal times to the second."""
    at = [T0 + timedelta(days=i // 2, microseconds=500 * (i % 2)) for i in range(12)]
    races = [(i, 2020 + i // 3, i % 2, at[i]) for i in range(6)] + [(2, 2021, 0, at[3]), (7, None, 0, at[0]), (None, 2020, 0, at[0])]
    results = [(i % 8, i % 4, at[i % 12], i, i % 4, i % 3) for i in range(40)] + [(None, 1, at[0], 50, 1, 1), (1, None, at[0], 51, 1, 1)] * 2
    other = [(i % 9, i % 5, at[(7 * i) % 12], 100 - i) for i in range(45)] + [(None, 1, at[0], 0), (1, None, at[0], 0), (1, 1, None, 3)]
    frame = spark.createDataFrame
    tables = {
        "circuits": Table(frame([(0, "a"), (1, "b")], "circuitId int, name string"), "circuitId"),
        "races": Table(frame(races, "raceId bigint, year int, circuitId int, date timestamp_ntz"), "raceId", "date"),
        "drivers": Table(frame([(i, f"d{i}") for i in range(6)], "driverId bigint, surname string"), "driverId"),
        "results": Table(
            frame(results, "raceId bigint, driverId bigint, date timestamp_ntz, positionOrder int, statusId int, constructorId bigint"), None, "date"
        ),
        "qualifying": Table(frame(other, "raceId bigint, driverId bigint, date timestamp_ntz, position int"), None, "date"),
        "standings": Table(frame(other[::2], "raceId bigint, driverId bigint, date timestamp_ntz, points int"), None, "date"),
        "status": Table(frame([(0, "s0"), (1, "s1"), (2, None)], "statusId int, status string"), "statusId"),
        "constructors": Table(frame([(0, "c0"), (1, "c1"), (1, "c1 again")], "constructorId bigint, name string"), "constructorId"),
    }
    return (races, results, other), Database(tables)


def _text(at):
    return at and at.strftime("%Y-%m-%d %H:%M:%S")


@pytest.mark.parametrize("part_rows", [3, 100_000])
def test_driver_documents_meet_their_race_in_one_shuffle(spark, part_rows):
    (races, results, other), db = _racing(spark)
    docs = documents.driver_documents(db, part_rows)
    plan = docs._jdf.queryExecution().optimizedPlan().toString()
    dealt = [x.split("RepartitionByExpression ")[1] for x in plan.splitlines() if "RepartitionByExpression" in x]
    if part_rows == 100_000:
        # once by race, and once by driver (the seasons find their rows in place): never by (race, driver) or (driver, year)
        assert [x.split("#")[0] for x in dealt] == ["[driverId", "[driverId", "[raceId"] and not any("," in x.split("]")[0] for x in dealt)

    def first(rows, race, driver):
        found = [(_text(d) or "", p) for r, o, d, p in rows if r is not None and (r, o) == (race, driver)]
        return list(min(found)) if found else None

    want = defaultdict(list)
    for race, driver, date, place, status, team in results:
        for r, year, _, _ in races:
            if race is None or driver is None or r != race or year is None:
                continue
            for name in {0: ["c0"], 1: ["c1", "c1 again"]}.get(team, [None]):
                want[driver].append(
                    [year, race, place, _text(date), {0: "s0", 1: "s1"}.get(status), name, first(other, race, driver), first(other[::2], race, driver)]
                )
    got = defaultdict(list)
    for d in docs.collect():
        doc = json.loads(d.doc)
        for season in [doc] if d.section == "seasons.races" else doc["seasons"]:
            for x in season["races"]:
                p, kept = x["driver_performance"], x["driver_performance"]["result"]
                told = [list(v.values()) if v else None for v in (p["qualifying"], p["championship_standing"])]
                told = [v and [v[0] or "", v[1]] for v in told]
                year = x["race"]["year"]
                race = kept["positionOrder"] % 8
                name = (p["constructor"] or {}).get("name")
                got[int(d.key.split("|")[0])].append([year, race, kept["positionOrder"], kept["date"], kept["status"]["status"], name, *told])
    for driver in range(6):
        assert sorted(map(str, got[driver])) == sorted(map(str, want[driver])), driver


@pytest.mark.parametrize("part_rows", [2, 100_000])
def test_engagements_meet_their_event_in_one_shuffle(spark, part_rows):
    """Own events, several records of a kind, unknown and NULL keys, and an event that comes twice."""
    at = [T0 + timedelta(days=i) for i in range(9)]
    events = [(i, i % 3, at[i]) for i in range(6)] + [(2, 1, at[8]), (7, None, at[7])]
    attended = [(i % 9, (i * 5) % 4, at[i % 7], "yno"[i % 3]) for i in range(40)] + [(None, 1, at[0], "y"), (1, None, at[0], "y")]
    shown = [(i % 8, (i * 3) % 4, at[i % 5], i % 2) for i in range(30)]
    frame = spark.createDataFrame
    numbers = [F.lit(float(i)).alias(f"c_{i}") for i in (1, 2)]
    tables = {
        "users": Table(frame([(i,) for i in range(4)], "user_id bigint"), "user_id"),
        "events": Table(frame(events, "event_id bigint, user_id bigint, start_time timestamp_ntz").select("*", *numbers), "event_id"),
        "event_attendees": Table(frame(attended, "event bigint, user_id bigint, start_time timestamp_ntz, status string"), None),
        "event_interest": Table(frame(shown, "event bigint, user bigint, timestamp timestamp_ntz, interested int"), None),
        "user_friends": Table(frame([(1, 2)], "user bigint, friend bigint"), None),
    }
    docs = documents.meetup_user_documents(Database(tables), part_rows)
    if part_rows == 100_000:
        plan = docs._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(engaged_event" in plan and "hashpartitioning(engaged_user#" in plan
        assert not [x for x in plan.splitlines() if "hashpartitioning(engaged_" in x and x.count("engaged_") > 1]
    got = defaultdict(list)
    for d in docs.collect():
        for x in json.loads(d.doc).get("event_engagements", []):
            told, event = x["user_engagement_details"], x["event"]
            got[int(d.key)].append(
                [told["attended"] and list(told["attended"].values()), told["interest"] and list(told["interest"].values()), event and event["start_time"]]
            )
    own = {(u, e) for e, u, _ in events}
    want = defaultdict(list)
    for user, event in {(r[1], r[0]) for r in attended + shown if None not in r[:2]} - own:
        first = [min(((_text(t), s) for e, u, t, s in rows if (e, u) == (event, user)), default=None) for rows in (attended, shown)]
        for start in [_text(t) for e, _, t in events if e == event] or [None]:
            want[user].append([f and list(f) for f in first] + [start])
    for user in range(4):
        assert sorted(map(str, got[user])) == sorted(map(str, want[user]))


@pytest.mark.parametrize("strategy", ["uniform", "last"])
def test_neighbors_are_drawn_from_one_row_per_node(spark, monkeypatch, strategy):
    """Seeds that come twice, unknown and NULL nodes and times; nodes of few and of many edges give the same sample."""
    _, db = tiny(spark, 150)
    db = graph.with_row_ids(db)
    start = 1577836800
    asked = [(i, start + 3600 * 40 * (i % 7) if i % 6 else None, i % 13 if i % 11 else None) for i in range(30)]
    seeds = spark.createDataFrame(asked + asked[:3], "seed_id bigint, seed_time bigint, node_id bigint")

    def sample():
        out = graph.sample_subgraphs(db, "customer", seeds, [5, 3], strategy, 9)
        return Counter(map(tuple, out.select("hop", "seed_id", "seed_time", "edge_type", "src_table", "dst_table", "dst_id", "src_id", "src_time").collect()))

    found = {}
    for near in (0, 12):
        monkeypatch.setattr(graph, "NEAR_EDGES", near)
        found[near] = sample()

    def placed(*_):
        raise AssertionError("asks of nodes of few edges were sorted and written")

    monkeypatch.undo()
    monkeypatch.setattr(graph, "running_totals", placed)
    assert sample() == found[0] == found[12]
    assert len(found[0]) > 100


def test_labelled_documents_shuffle_texts_to_their_customer_only(spark):
    """Products and reviews that come twice, unknown and NULL keys, equal times; only places of reviews meet products."""
    at = [T0 + timedelta(days=i) for i in range(4)]
    rows = [(i % 3 or None, i % 5 if i % 4 else None, at[i % 4] if i % 7 else None, f"text {i % 6}") for i in range(40)]
    rows += rows[:9]
    review = spark.createDataFrame(rows, "customer_id bigint, product_id bigint, review_time timestamp_ntz, review_text string")
    products = [(0, "a"), (1, "b"), (1, "c"), (2, None), (2, "d"), (None, "x")]
    product = spark.createDataFrame(products, "product_id bigint, title string")
    customer = spark.createDataFrame([(1, "one"), (5, "five")], "customer_id bigint, customer_name string")
    db = Database({
        "customer": Table(customer, "customer_id"), "product": Table(product, "product_id"),
        "review": Table(review, None, "review_time", {"customer_id": "customer", "product_id": "product"}),
    })
    asked = [(c, t, 1) for c in (1, 2, 5) for t in (at[0], at[2])]
    labels = spark.createDataFrame(asked, "customer_id bigint, timestamp timestamp_ntz, churn int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = documents.labelled_documents(db, labels, "churn")
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(_product" in plan and "hashpartitioning(product_id" not in plan
        docs = {r.key: json.loads(r.doc)["reviews"] for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for c, t, _ in asked:
        want = [(when, p, text, title) for own, p, when, text in rows if own == c and when is not None and when <= t
                for title in [x for k, x in products if k == p and p is not None] or [None]]
        want.sort(key=lambda r: [(x is not None, x) for x in r])
        got = [(x["review_time"], x["product"]["product_id"], x["review_text"], x["product"]["title"]) for x in docs[f"{c}|{t}"]]
        assert got == [(str(r[0]), *r[1:]) for r in want]


def test_records_of_an_event_are_dealt_once_for_its_lists_and_its_engagements(spark, small_dir, monkeypatch):
    """Engagements are counted by their records, not by making them, and share the shuffles of the lists of events."""
    from chronograin.queries.databases import meetups

    db, asked, longest = meetups(spark, small_dir).full_db, [], documents._longest

    def noted(rows):
        asked.extend(rows)
        return longest(rows)

    monkeypatch.setattr(documents, "_longest", noted)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = documents.meetup_user_documents(db)
        assert "attendees" in asked and "event_engagements" not in asked
        docs.collect()
        plan = docs._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0]
        shared = [x for x in plan.splitlines() if "ReusedExchange" in x and "hashpartitioning(event#" in x]
        assert len(shared) == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
