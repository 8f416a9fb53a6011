"""Windows of any place and length, and anchors that form no grid, against plain comparison."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from chronograin.grid import Grid, Moments
from chronograin.operators import intervals, windows

T0 = datetime(1969, 12, 20)
US = timedelta(microseconds=1)
FACTS = "k bigint, j string, at timestamp_ntz, v bigint"
WINDOWS = "w bigint, k bigint, j string, since timestamp_ntz, until timestamp_ntz"


def frames(spark, seed, n_facts=150, n_windows=60, unit=timedelta(minutes=7), hot=0.5):
    rng = random.Random(seed)

    def key():
        return (1 if rng.random() < hot else rng.choice([2, 3, None])), rng.choice(["a", "a", None])

    def moment(span):
        return T0 + unit * rng.randrange(span) + US * rng.choice([0, 0, 1, -1])

    facts = [(*key(), moment(3000) if rng.random() < 0.95 else None, rng.choice([None, *range(9)])) for _ in range(n_facts)]
    asked = []
    for w in range(n_windows):
        since = moment(3000)
        asked.append((w, *key(), since, since + unit * rng.choice([-3, 0, 1, 2, 64, 500, 4000]) + US * rng.choice([0, 1])))
    asked[0] = (0, 1, "a", None, T0)
    return facts, asked, spark.createDataFrame(facts, FACTS), spark.createDataFrame(asked, WINDOWS)


def brute(facts, asked):
    found = []
    for w, k, j, since, until in asked:
        for fk, fj, at, v in facts:
            if None not in (k, j, since, until, at) and (k, j) == (fk, fj) and since < at <= until:
                found.append((w, at, v))
    return found


@pytest.mark.parametrize("tree", [None, intervals.Tree(22, 12), intervals.Tree(30, 0), intervals.Tree(29, 3), intervals.Tree(20, 30)])
def test_pairs_and_aggregates(spark, tree):
    facts, asked, f, w = frames(spark, 5)
    want = brute(facts, asked)
    args = (["k", "j"], "since", "until", "at")
    met = intervals.window_pairs(w, f, *args, tree)
    assert met.columns == ["w", "k", "j", "since", "until", "at", "v"]
    order = lambda r: tuple(map(str, r))
    assert sorted(((r.w, r.at, r.v) for r in met.collect()), key=order) == sorted(want, key=order) and want
    aggs = {"n": ("count", F.lit(1)), "known": ("count", F.col("v")), "total": ("sum", F.col("v")), "least": ("min", F.col("v")), "last": ("max", F.col("at"))}
    got = {r.w: r for r in intervals.window_aggregate(w, f, *args, aggs, tree).collect()}
    assert sorted(got) == [a[0] for a in asked]
    for i in got:
        values = [v for x, _, v in want if x == i]
        known = [v for v in values if v is not None]
        times = [at for x, at, _ in want if x == i]
        expect = (len(values), len(known), sum(known) if known else None, min(known, default=None), max(times, default=None))
        assert (got[i].n, got[i].known, got[i]["total"], got[i].least, got[i]["last"]) == expect
    sums = {r.w: (r.n, r.total) for r in intervals.window_totals(w, f, *args, {"n": F.lit(1), "total": F.col("v")}).collect()}
    assert sums == {a[0]: (sum(x == a[0] for x, _, _ in want), sum(v or 0 for x, _, v in want if x == a[0])) for a in asked}


def test_windows_without_keys_and_empty_tables(spark):
    facts, asked, f, w = frames(spark, 8, 60, 20)
    f, w = f.select("at", "v"), w.select("w", "since", "until")
    want = brute([(0, 0, at, v) for _, _, at, v in facts], [(i, 0, 0, a, b) for i, _, _, a, b in asked])
    assert intervals.window_pairs(w, f, [], "since", "until", "at").count() == len(want)
    got = intervals.window_totals(w, f, [], "since", "until", "at", {"n": F.lit(1)})
    assert {(r.w, r.n) for r in got.collect()} == {(a[0], sum(x == a[0] for x, _, _ in want)) for a in asked}
    for a, b in ((w.limit(0), f), (w, f.limit(0)), (w.limit(0), f.limit(0))):
        assert intervals.window_pairs(a, b, [], "since", "until", "at").count() == 0
        n = a.count()
        assert intervals.window_aggregate(a, b, [], "since", "until", "at", {"n": ("count", F.lit(1))}).where("n = 0").count() == n
        assert intervals.window_totals(a, b, [], "since", "until", "at", {"n": F.lit(1)}).where("n = 0").count() == n


def test_a_window_has_few_nodes_and_no_nested_loop(spark):
    tree = intervals.Tree.of_lengths(timedelta(days=1), timedelta(days=365))
    lo, hi = F.lit(12345678901), F.lit(12345678901 + 365 * 86_400_000_000)
    row = spark.range(1).select(F.size(tree.inner(lo, hi)).alias("inner"), F.size(tree.ends(lo, hi)).alias("ends")).first()
    assert row.inner <= 2 * (tree.levels + 1) and row.ends <= 2 and tree.levels == intervals.LEVELS
    _, _, f, w = frames(spark, 1)
    with pytest.raises(ValueError, match="'j'"):
        intervals.window_pairs(w, f, ["k"], "since", "until", "at", tree)
    f = f.drop("j")
    for df in (
        intervals.window_pairs(w, f, ["k"], "since", "until", "at", tree),
        intervals.window_pairs(w.drop("k"), f.drop("k"), [], "since", "until", "at", tree),
        intervals.window_aggregate(w, f, ["k"], "since", "until", "at", {"n": ("count", F.lit(1))}, tree),
    ):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_a_busy_key_is_spread_over_nodes(spark):
    n = 20_000
    facts = spark.range(n).select(F.lit(1).alias("k"), F.timestamp_micros(F.col("id") * 60_000_000).cast("timestamp_ntz").alias("at"))
    asked = spark.range(0, n, 50).select(
        F.lit(1).alias("k"), F.col("id").alias("w"),
        F.timestamp_micros(F.col("id") * 60_000_000).cast("timestamp_ntz").alias("since"),
        F.timestamp_micros((F.col("id") + 5000) * 60_000_000).cast("timestamp_ntz").alias("until"),
    )
    tree = intervals.Tree.of_windows(asked, "since", "until")
    leaves = facts.select(tree.node(F.unix_micros(F.col("at").cast("timestamp")), 0).alias("n")).groupBy("n").count()
    assert leaves.agg(F.max("count")).first()[0] < n / 100
    got = intervals.window_aggregate(asked, facts, ["k"], "since", "until", "at", {"n": ("count", F.lit(1))})
    assert got.where(F.col("n") != F.least(F.lit(5000), F.lit(n - 1) - F.col("w"))).count() == 0 and got.count() == n // 50


@pytest.mark.parametrize("seed", range(6))
def test_anchors_without_a_grid(spark, seed):
    rng = random.Random(seed)
    step = timedelta(hours=rng.randrange(1, 60))
    times = sorted({T0 + timedelta(minutes=rng.randrange(60_000)) for _ in range(rng.choice([1, 2, 9, 25]))})
    grids = [Moments("train", tuple(times), step), Grid("val", T0 + timedelta(days=20), step, 3)]
    rows = [(i, rng.choice([T0 + timedelta(minutes=rng.randrange(-5000, 70_000)), rng.choice(times), rng.choice(times) + step, None])) for i in range(80)]
    df = spark.createDataFrame(rows, "who bigint, at timestamp_ntz")
    anchors = [(g.split, t) for g in grids for t in g.moments()]

    def expect(test):
        return sorted((i, s, t) for i, m in rows for s, t in anchors if m is not None and test(m, t))

    def got(tagged):
        return sorted((r.who, r.split, r.timestamp) for r in tagged.collect())

    assert got(windows.tag_windows(df, "at", grids)) == expect(lambda m, t: t < m <= t + step)
    both = windows.tag_windows_and_lookback(df, "at", grids)
    assert got(both.where("in_window")) == expect(lambda m, t: t < m <= t + step)
    assert got(both.where("NOT in_window")) == expect(lambda m, t: t - step < m <= t)
    day = timedelta(days=1)
    assert got(windows.tag_range(df, "at", grids, 2 * day, day)) == expect(lambda m, t: t - 2 * day < m <= t + day)
    spread = windows.spread_since(df.where("at IS NOT NULL"), grids, "at")
    assert got(spread) == expect(lambda m, t: m <= t)
    numbers = windows.spread_since(df.limit(1), grids).select(windows.anchor_number(grids).alias("n")).orderBy("n").collect()
    assert [r.n for r in numbers] == list(range(len(anchors)))


def test_moments_are_checked(spark):
    with pytest.raises(ValueError, match="distinct, ascending"):
        Moments("train", (T0, T0), timedelta(days=1))
    with pytest.raises(ValueError, match="at least one"):
        Moments("train", (), timedelta(days=1))


def test_task_tables_at_any_times(spark, small_dir):
    from chronograin.plans.catalog import get_task
    from chronograin.queries.databases import DATASETS

    dataset = DATASETS["shop"](spark, small_dir)
    task, grid = get_task("shop", "user-churn"), get_task("shop", "user-churn").grids(dataset, ["train"])[0]
    regular = {tuple(r) for r in task.table(dataset, "train").df.collect()}
    assert {tuple(r) for r in task.table_at(dataset, grid.moments()).df.collect()} == regular
    assert task.table_at(dataset, [dataset.test_timestamp], "test").df.columns == ["timestamp", "customer_id"]
    with pytest.raises(ValueError, match="after the test cut-off"):
        task.table_at(dataset, [dataset.test_timestamp])
    lists = get_task("shop", "user-item-purchase").table_at(dataset, grid.moments()[:3]).df
    assert lists.columns == get_task("shop", "user-item-purchase").table(dataset, "train").df.columns


def test_only_busy_keys_take_the_tree(spark, monkeypatch):
    facts, asked, f, w = frames(spark, 6)
    args = (["k", "j"], "since", "until", "at")
    want = sorted((i, str(at), str(v)) for i, at, v in brute(facts, asked))
    for few in (0, 5, 1000):
        monkeypatch.setattr(intervals, "FEW", few)
        met = intervals.window_pairs(w, f, *args)
        assert sorted((r.w, str(r["at"]), str(r.v)) for r in met.collect()) == want
        # no row is copied where no key is busy
        assert ("Generate" in met._jdf.queryExecution().executedPlan().toString()) == (few < 1000)
