"""Keys, running totals, percentiles, and lists that are continued in parts."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronograin.functions import clean
from chronograin.model import Database, Dataset, Table
from chronograin.operators import integrity, lists
from chronograin.operators.quantiles import percentiles
from chronograin.operators.running import dense_row_ids, running_totals
from chronograin.queries import keys
from chronograin.sources import files, tables

T0 = datetime(2020, 1, 1)


def shop_db(spark, customers=("a", "b", "c")):
    customer = spark.createDataFrame([(c, i) for i, c in enumerate(customers)], "customer_id string, age int")
    rows = [("a", T0 + timedelta(days=2)), ("x", T0 + timedelta(days=1)), ("c", T0), (None, T0 + timedelta(days=9))]
    review = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "review_id int, customer_id string, review_time timestamp_ntz")
    return Database({
        "customer": Table(customer, "customer_id"),
        "review": Table(review, "review_id", "review_time", {"customer_id": "customer"}),
    })


def test_upto_and_from_are_inclusive_and_drop_null_times(spark):
    df = spark.createDataFrame([(T0,), (T0 + timedelta(days=1),), (None,)], "t timestamp_ntz")
    timed, untimed = Table(df, None, "t"), Table(df)
    assert timed.upto(T0).count() == 1
    assert timed.from_(T0).count() == 2
    assert untimed.upto(T0).count() == 3


def test_reindex_numbers_by_time_and_nulls_unknown_keys(spark):
    db = integrity.reindex(shop_db(spark))
    rows = sorted((r.review_id, r.customer_id) for r in db.df("review").collect())
    assert rows == [(0, 2), (1, None), (2, 0), (3, None)]
    for name, table in db.tables.items():
        integrity.check_dense(name, table)


def test_duplicate_key_is_an_error(spark):
    with pytest.raises(RuntimeError, match="duplicates"):
        integrity.reindex(shop_db(spark, customers=("a", "a")))


def test_dangling_keys_become_null_after_the_cut(spark):
    dataset = Dataset(shop_db(spark), T0, T0 + timedelta(days=1))
    rows = {r.review_id: r.customer_id for r in dataset.db.df("review").collect()}
    assert rows == {1: None, 2: "c"}


def test_sparse_keys_are_not_dense(spark):
    df = spark.createDataFrame([(0,), (2,)], "k int")
    assert not integrity.dense_key_summary(df, "k").first()["is_dense"]
    with pytest.raises(RuntimeError, match="not numbered"):
        integrity.check_dense("t", Table(df, "k"))


def hot_rows(spark, n=3000):
    """A third of the rows belong to one key, and a third share one time."""
    rng = random.Random(1)
    rows = [(7 if rng.random() < 0.4 else rng.randrange(40), 5 if rng.random() < 0.4 else rng.randrange(500), i) for i in range(n)]
    return rows, spark.createDataFrame(rows, "k bigint, t bigint, id bigint")


def test_running_totals_with_a_hot_key(spark):
    rows, df = hot_rows(spark)
    out = running_totals(df, ["k"], ["t", "id"], {"n": F.lit(1), "total": F.col("t")})
    want, seen = {}, defaultdict(lambda: [0, 0])
    for k, t, i in sorted(rows, key=lambda r: (r[1], r[2])):
        seen[k][0] += 1
        seen[k][1] += t
        want[i] = tuple(seen[k])
    assert {r.id: (r.n, r.total) for r in out.collect()} == want


def test_dense_ids_are_gapless_and_ordered(spark):
    rows, df = hot_rows(spark)
    out = {r.id: r.nr for r in dense_row_ids(df, ["t", "id"], "nr").collect()}
    assert [i for i, _ in sorted(out.items(), key=lambda e: e[1])] == [i for _, _, i in sorted(rows, key=lambda r: r[1:])]
    assert sorted(out.values()) == list(range(len(rows)))


def test_percentiles_equal_numpy(spark):
    rows, df = hot_rows(spark, 997)
    by_key = defaultdict(list)
    for k, t, _ in rows:
        by_key[k].append(t)
    out = percentiles(df, "t", {"a": 0.02, "b": 0.5, "c": 0.98}, ["k"]).collect()
    assert len(out) == len(by_key)
    for r in out:
        assert np.allclose([r.a, r.b, r.c], np.quantile(by_key[r.k], [0.02, 0.5, 0.98]))


def test_copies_of_one_row_are_spread_over_partitions(spark):
    copies = spark.range(4000).select(F.lit(1).cast("bigint").alias("k"), F.lit(5).cast("bigint").alias("t"))
    out = running_totals(copies, ["k"], ["t"], {"n": F.lit(1)})
    assert sorted(r.n for r in out.select("n").collect()) == list(range(1, 4001))
    from chronograin.operators.running import _ordered

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = _ordered(copies, ["k"], ["t"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r[1] for r in placed.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 3000


@pytest.mark.parametrize("part_rows", [50, 10_000])
def test_list_parts_hold_every_row_in_order(spark, part_rows):
    rows, df = hot_rows(spark)
    parts = lists.collect_parts(df, ["k"], F.struct("t", "id"), ["t", "id"], "items", part_rows).collect()
    whole = defaultdict(list)
    for p in sorted(parts, key=lambda p: (p.k, p.part)):
        assert 0 < len(p["items"]) <= part_rows
        whole[p.k] += [(i.t, i.id) for i in p["items"]]
    want = defaultdict(list)
    for k, t, i in sorted(rows, key=lambda r: r[1:]):
        want[k].append((t, i))
    assert whole == want
    assert (max(p.part for p in parts) > 0) == (part_rows == 50)


def test_filter_list_drops_unknown_items_and_empty_lists(spark):
    df = spark.createDataFrame([(1, [1, 2]), (2, [9])], "src bigint, dst array<bigint>")
    ids = spark.createDataFrame([(1,), (2,)], "id bigint")
    assert [(r.src, r.dst) for r in integrity.filter_list(df, "dst", ids, ["src"]).collect()] == [(1, [1, 2])]


def test_prices(spark):
    texts = {"$1,234.56": 1234.56, "$5.00 - $9.00": 5.0, "": None, "12": None, "<b>$3": None, None: None, "$": None, "$7": 7.0}
    df = spark.createDataFrame([(t,) for t in texts], "p string")
    got = {r.p: r.v for r in df.select("p", clean.parse_price(F.col("p")).alias("v")).collect()}
    assert got == texts


def test_mixed_times_lose_their_zone(spark):
    texts = {"2012-10-02T15:53:05.754000Z": datetime(2012, 10, 2, 15, 53, 5, 754000), "2012-10-02 15:53:05": datetime(2012, 10, 2, 15, 53, 5),
             "2012-10-02": datetime(2012, 10, 2), "02.10.2012": None}
    df = spark.createDataFrame([(t,) for t in texts], "p string")
    assert {r.p: r.v for r in df.select("p", clean.parse_time(F.col("p")).alias("v")).collect()} == texts


def test_footer_roles_of_foreign_files(spark, tmp_path):
    import json

    import pyarrow as pa
    import pyarrow.parquet as pq

    table = pa.table({"id": [1, 2], "owner": [5, 6], "x": [float("nan"), 1.5]}).replace_schema_metadata(
        {"pkey_col": json.dumps("id"), "time_col": json.dumps(None), "fkey_col_to_pkey_table": json.dumps({"owner": "users"})}
    )
    pq.write_table(table, tmp_path / "t.parquet")
    back = tables.read_foreign_table(spark, str(tmp_path / "t.parquet"))
    assert (back.pkey, back.time_col, dict(back.fkeys), back.count()) == ("id", None, {"owner": "users"}, 2)
    assert sorted(r.x for r in back.df.where("x is not null").collect()) == [1.5]


def test_tolerant_json_skips_only_bad_lines(spark, tmp_path):
    (tmp_path / "d.jsonl").write_text('{"a": 1, "b": "x"}\n{"a": 2\nnot json\n{"a": 3}\n')
    rows = files.read_json_lines_tolerant(spark, str(tmp_path), "a bigint, b string").collect()
    assert sorted((r.a, r.b) for r in rows) == [(1, "x"), (3, None)]


def test_tasks_of_the_registry_are_counted_one_after_the_other(spark, small_dir, monkeypatch):
    """The result holds the counts of labels, not one plan of all tasks at once."""
    running = []

    def labels(task, dataset):
        running.append(task.name)
        return spark.range(len(running))

    monkeypatch.setattr(keys, "all_splits", labels)
    found = keys.task_registry(spark, small_dir)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Union" not in plan and "Range" not in plan
    assert sorted(r.n_labels for r in found.collect()) == list(range(1, 31)) and len(set(running)) > 20
