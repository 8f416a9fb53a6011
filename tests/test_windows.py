"""Window edges, and bucketing against plain comparison on random grids."""

from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from chronograin.grid import Grid, split_grid
from chronograin.operators import windows

T0 = datetime(2020, 1, 1)
DAY = timedelta(days=1)


def facts(spark, rows):
    return spark.createDataFrame(rows, "who bigint, at timestamp_ntz")


def test_window_is_open_closed(spark):
    grid = Grid("train", T0, 10 * DAY, 2)
    moments = [T0, T0 + timedelta(microseconds=1), T0 + 10 * DAY, T0 + 20 * DAY, T0 + 20 * DAY + timedelta(microseconds=1), None]
    df = facts(spark, [(i, m) for i, m in enumerate(moments)])
    got = {(r.who, r.timestamp) for r in windows.tag_windows(df, "at", [grid]).collect()}
    assert got == {(1, T0), (2, T0), (3, T0 + 10 * DAY)}


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(data=st.data())
def test_bucketing_equals_comparison(spark, data):
    step = timedelta(hours=data.draw(st.integers(1, 60)))
    grids, start = [], T0
    for name in data.draw(st.sampled_from([["train"], ["train", "val"], ["train", "val", "test"]])):
        overlap = data.draw(st.sampled_from([0, 0, 1]))
        count = data.draw(st.integers(1, 5))
        grids.append(Grid(name, start - overlap * step, step, count))
        start = grids[-1].last + step
    hours = data.draw(st.lists(st.integers(-80, 700), min_size=1, max_size=25))
    rows = [(i, T0 + timedelta(hours=h)) for i, h in enumerate(hours)]
    df = facts(spark, rows)
    anchors = [(g.split, t) for g in grids for t in g.moments()]

    def expect(test):
        return sorted((i, s, t) for i, m in rows for s, t in anchors if test(m, t))

    def got(tagged):
        return sorted((r.who, r.split, r.timestamp) for r in tagged.collect())

    assert got(windows.tag_windows(df, "at", grids)) == expect(lambda m, t: t < m <= t + step)
    both = windows.tag_windows_and_lookback(df, "at", grids)
    assert got(both.where("in_window")) == expect(lambda m, t: t < m <= t + step)
    assert got(both.where("not in_window")) == expect(lambda m, t: t - step < m <= t)
    lead, lag = timedelta(hours=37), timedelta(hours=11)
    assert got(windows.tag_range(df, "at", grids, lead, lag)) == expect(lambda m, t: t - lead < m <= t + lag)
    assert got(windows.spread_since(df, grids, "at")) == expect(lambda m, t: m <= t)


def test_grids_step_from_the_cutoffs():
    val, test = datetime(2020, 6, 1), datetime(2020, 7, 1)
    train = split_grid("train", 10 * DAY, val, test, datetime(2020, 4, 1), datetime(2020, 9, 1))
    assert train.last == val - 10 * DAY
    assert datetime(2020, 4, 1) <= train.start < datetime(2020, 4, 11)
    assert split_grid("val", 10 * DAY, val, test, T0, datetime(2020, 9, 1), 40).count == 3
    assert split_grid("test", 10 * DAY, val, test, T0, datetime(2020, 9, 1), 2).moments() == [test, test + 10 * DAY]


def test_guards():
    val, test = datetime(2020, 6, 1), datetime(2020, 7, 1)
    with pytest.raises(ValueError, match="longer"):
        split_grid("train", 40 * DAY, val, test, T0, test)
    with pytest.raises(RuntimeError, match="too few"):
        split_grid("train", 10 * DAY, val, test, datetime(2020, 5, 20), test)
    with pytest.raises(RuntimeError, match="after the last row"):
        split_grid("test", 10 * DAY, val, test, T0, datetime(2020, 7, 5))


def test_previous_rows_not_calendar_anchors(spark):
    rows = [(1, T0, 1), (1, T0 + 50 * DAY, 0), (1, T0 + 60 * DAY, 0), (1, T0 + 70 * DAY, 0)]
    df = spark.createDataFrame(rows, "who bigint, t timestamp_ntz, v int")
    out = {r.t: r.p for r in windows.add_previous_max(df, ["who"], "t", "v", 2, "p").collect()}
    assert [out[t] for _, t, _ in rows] == [None, 1, 1, 0]


def test_hits_before_creation_do_not_count(spark):
    grids = [Grid("train", T0, 10 * DAY, 3), Grid("val", T0 + 30 * DAY, 10 * DAY, 1)]
    entities = facts(spark, [(1, T0 + 5 * DAY), (2, T0 + 90 * DAY), (3, T0)])
    hits = spark.createDataFrame([("train", T0, 1, 4), ("train", T0 + 20 * DAY, 1, 6), ("val", T0 + 30 * DAY, 3, 9)],
                                 "split string, timestamp timestamp_ntz, who bigint, n bigint")
    from pyspark.sql import functions as F

    out = windows.for_each_existing(entities, "who", hits, "n", grids, "at", F.lit(0))
    got = {(r.who, r.split, (r.timestamp - T0).days): r.n for r in out.collect()}
    assert got == {
        (1, "train", 10): 0, (1, "train", 20): 6, (1, "val", 30): 0,
        (3, "train", 0): 0, (3, "train", 10): 0, (3, "train", 20): 0, (3, "val", 30): 9,
    }


def test_since_first_starts_at_the_first_fact(spark):
    grid = Grid("train", T0, 10 * DAY, 4)
    df = facts(spark, [(1, T0 + 5 * DAY), (1, T0 + 25 * DAY), (2, T0 - 90 * DAY), (3, T0 + 39 * DAY)])
    out = {(r.who, r.timestamp): r.hit for r in windows.for_each_since_first(df, "who", "at", [grid], "hit").collect()}
    assert out == {
        (1, T0 + 10 * DAY): 0, (1, T0 + 20 * DAY): 1, (1, T0 + 30 * DAY): 0,
        (2, T0): 0, (2, T0 + 10 * DAY): 0, (2, T0 + 20 * DAY): 0, (2, T0 + 30 * DAY): 0,
    }
