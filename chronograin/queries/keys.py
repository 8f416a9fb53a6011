"""Key integrity, split grids, cached tables, registry."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from chronograin.grid import SPLITS, anchor_table
from chronograin.operators import integrity
from chronograin.plans.catalog import TASKS, get_task
from chronograin.plans.task import all_splits
from chronograin.queries import Book, read
from chronograin.queries.databases import DATASETS, SHOP_TEST, VIEWS, anchors_sql
from chronograin.queries.labels import BOOK as LABELS
from chronograin.session import work_path

BOOK = Book()


@BOOK.query("anchor_grid", f"WITH {VIEWS['racing'].strip()},{anchors_sql(30, 40, False)} SELECT * FROM anchors")
def anchor_grid(spark, sf_dir):
    """All anchors of a task with up to forty evaluation windows."""
    return anchor_table(spark, get_task("racing", "driver-dnf").grids(DATASETS["racing"](spark, sf_dir)))


@BOOK.query(
    "split_guards",
    " UNION ALL ".join(
        f"""SELECT '{s}' AS schema_name, '{n}' AS task, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'val') AS n_val,
        count(*) FILTER (split = 'test') AS n_test FROM (WITH {VIEWS[s].strip()},{anchors_sql(t.delta.days, t.evals, s == "classifieds")}
        SELECT * FROM anchors)"""
        for s, tasks in TASKS.items()
        for n, t in tasks.items()
    ),
)
def split_guards(spark, sf_dir):
    """Every task passes its checks on this data; counts of anchors per split."""
    rows = []
    for schema, tasks in TASKS.items():
        dataset = DATASETS[schema](spark, sf_dir)
        for name, task in tasks.items():
            rows.append((schema, name, *[g.count for g in task.grids(dataset, SPLITS)]))
    return spark.createDataFrame(rows, "schema_name string, task string, n_train bigint, n_val bigint, n_test bigint")


@BOOK.query(
    "null_dangling_fkeys",
    f"""SELECT l_orderkey * 10 + l_linenumber AS Id, CASE WHEN o.o_orderkey IS NULL THEN NULL ELSE l_orderkey END AS PostId,
    CASE WHEN u.o_custkey IS NULL THEN NULL ELSE l_suppkey END AS UserId, l_shipdate AS CreationDate FROM lineitem
    LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderdate <= TIMESTAMP '{SHOP_TEST}') o ON o.o_orderkey = l_orderkey
    LEFT JOIN (SELECT o_custkey FROM orders GROUP BY 1 HAVING min(o_orderdate) <= TIMESTAMP '{SHOP_TEST}') u ON u.o_custkey = l_suppkey
    WHERE l_linestatus = 'F' AND l_shipdate <= TIMESTAMP '{SHOP_TEST}'""",
)
def null_dangling_fkeys(spark, sf_dir):
    """Comments as of the test cut-off; posts written later leave them without a post."""
    return DATASETS["forum"](spark, sf_dir).db.df("comments").drop("Text")


@BOOK.query(
    "pk_uniqueness_check",
    "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1",
)
def pk_uniqueness_check(spark, sf_dir):
    return integrity.duplicate_keys(read(spark, sf_dir, "lineitem"), "l_orderkey")


@BOOK.query(
    "validate_dense_pk",
    """SELECT 'orders' AS table_name, count(*) AS n_rows, min(o_orderkey) AS min_key, max(o_orderkey) AS max_key, count(DISTINCT o_orderkey) AS n_keys,
    min(o_orderkey) = 0 AND max(o_orderkey) = count(*) - 1 AND count(DISTINCT o_orderkey) = count(*) AS is_dense FROM orders UNION ALL
    SELECT 'events', count(*), min(user_id), max(user_id), count(DISTINCT user_id),
    min(user_id) = 0 AND max(user_id) = count(*) - 1 AND count(DISTINCT user_id) = count(*) FROM events""",
)
def validate_dense_pk(spark, sf_dir):
    parts = [
        integrity.dense_key_summary(read(spark, sf_dir, t), k).withColumn("table_name", F.lit(t))
        for t, k in (("orders", "o_orderkey"), ("events", "user_id"))
    ]
    return parts[0].unionByName(parts[1])


_BY_TIME = "row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1"


@BOOK.query("time_ordered_rowid", f"SELECT o_orderkey, {_BY_TIME} AS row_id FROM orders")
def time_ordered_rowid(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return integrity.dense_row_ids(orders, ["o_orderdate", "o_orderkey"], "row_id").select("o_orderkey", "row_id")


@BOOK.query(
    "reindex_keys",
    f"""WITH p AS (SELECT o_orderkey, {_BY_TIME} AS post FROM orders),
    u AS (SELECT o_custkey, row_number() OVER (ORDER BY min(o_orderdate), o_custkey) - 1 AS usr FROM orders GROUP BY o_custkey)
    SELECT l_orderkey * 10 + l_linenumber AS Id, post AS PostId, usr AS UserId, l_shipdate AS CreationDate
    FROM lineitem LEFT JOIN p ON p.o_orderkey = l_orderkey LEFT JOIN u ON u.o_custkey = l_suppkey""",
)
def reindex_keys(spark, sf_dir):
    """Votes with their post and user renumbered in time order."""
    return integrity.reindex(DATASETS["forum"](spark, sf_dir).full_db).df("votes").drop("VoteTypeId")


@BOOK.query(
    "filter_dangling_entities",
    f"""SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1
    HAVING min(o_orderdate) <= TIMESTAMP '{SHOP_TEST}')""",
)
def filter_dangling_entities(spark, sf_dir):
    labels = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    return integrity.keep_known(labels, "o_custkey", DATASETS["forum"](spark, sf_dir).entity_ids("users"))


@BOOK.query(
    "filter_dangling_links",
    f"""WITH known AS (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey
      WHERE o_orderdate <= TIMESTAMP '{SHOP_TEST}')
    SELECT l_suppkey, string_agg(l_orderkey, ',' ORDER BY l_orderkey) AS posts FROM known GROUP BY l_suppkey""",
)
def filter_dangling_links(spark, sf_dir):
    """Lists of posts, without those written after the test cut-off."""
    from chronograin.operators.lists import pairs_to_lists

    pairs = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey").distinct()
    lists = pairs_to_lists(pairs, ["l_suppkey"], "l_orderkey")
    kept = integrity.filter_list(lists, "l_orderkey", DATASETS["forum"](spark, sf_dir).entity_ids("posts"), ["l_suppkey", "part"])
    spelled = F.concat_ws(",", F.col("l_orderkey").cast("array<string>"))
    return kept.select("l_suppkey", spelled.alias("posts"))


@BOOK.query(
    "surrogate_id",
    """WITH f AS (SELECT p_name, row_number() OVER (ORDER BY min(p_partkey), p_name) - 1 AS name_id FROM part GROUP BY p_name)
    SELECT p_partkey, name_id FROM part JOIN f USING (p_name)""",
)
def surrogate_id(spark, sf_dir):
    """Names numbered by first appearance."""
    rows, _ = integrity.surrogate_ids(read(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", "name_id", "p_partkey")
    return rows.select("p_partkey", "name_id")


@BOOK.query(
    "task_registry",
    " UNION ALL ".join(
        f"SELECT '{s}' AS schema_name, '{n}' AS task, '{t.kind.value}' AS kind, {t.delta.days} AS days, "
        f"(SELECT count(*) FROM ({LABELS.sql['label_' + s + '_' + n.replace('-', '_')]})) AS n_labels"
        for s, tasks in TASKS.items()
        for n, t in tasks.items()
    ),
)
def task_registry(spark, sf_dir):
    """Tasks by schema and name, with the number of labels they give on this data.

    Labels are counted one task after the other: a plan of all tasks at once would hold every plan, broadcast and shuffle
    status of the thirty in the driver together.
    """
    rows = []
    for schema, tasks in TASKS.items():
        dataset = DATASETS[schema](spark, sf_dir)
        for name, task in tasks.items():
            n_labels = all_splits(get_task(schema, name), dataset).count()
            rows.append((schema, name, task.kind.value, task.delta // timedelta(days=1), n_labels))
    return spark.createDataFrame(rows, "schema_name string, task string, kind string, days int, n_labels bigint")


@BOOK.query(
    "cached_task_table",
    f"""SELECT timestamp, customer_id, churn, count(*) AS n FROM (SELECT * FROM ({LABELS.sql["label_shop_user_churn"]}) WHERE split = 'val'
    UNION ALL SELECT * FROM ({LABELS.sql["label_shop_user_churn"]}) WHERE split = 'val') GROUP BY ALL""",
)
def cached_task_table(spark, sf_dir):
    """The first call computes and stores, the second loads; both give the same rows."""
    folder, task, dataset = work_path(spark, "labels"), get_task("shop", "user-churn"), DATASETS["shop"](spark, sf_dir)
    computed = task.table(dataset, "val", cache_dir=folder).df
    loaded = task.table(dataset, "val", cache_dir=folder).df
    return computed.unionByName(loaded).groupBy("timestamp", "customer_id", "churn").agg(F.count(F.lit(1)).alias("n"))


@BOOK.query(
    "link_list_form",
    f"""WITH p AS (SELECT * FROM ({LABELS.sql["label_shop_user_item_rate"]}) WHERE split = 'train')
    SELECT timestamp, customer_id, string_agg(product_id, ',' ORDER BY product_id) AS product_id FROM p GROUP BY ALL""",
)
def link_list_form(spark, sf_dir):
    """A recommendation label table as lists: collect_distinct_list per (anchor, source)."""
    lists = get_task("shop", "user-item-rate").table(DATASETS["shop"](spark, sf_dir), "train").df
    spelled = F.concat_ws(",", F.col("product_id").cast("array<string>"))
    return lists.select("timestamp", "customer_id", spelled.alias("product_id"))


@BOOK.query("masked_link_table", f"""SELECT DISTINCT timestamp, customer_id FROM ({LABELS.sql["label_shop_user_item_rate"]}) WHERE split = 'test'""")
def masked_link_table(spark, sf_dir):
    """The test split of a link task hides its destinations."""
    return get_task("shop", "user-item-rate").table(DATASETS["shop"](spark, sf_dir), "test").df


