"""Sources and sinks: the given tables written to the shared work folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronograin.model import Table
from chronograin.operators import columns, documents
from chronograin.queries import Book, read
from chronograin.queries.databases import DATASETS
from chronograin.queries.graphs import GIVEN, KINDS_SQL, REST, REST_KINDS_SQL, given_kinds
from chronograin.sources import files, tables
from chronograin.session import work_path

BOOK = Book()

_ORDERS = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"


@BOOK.query(
    "parquet_table_roundtrip",
    "SELECT o_orderkey, o_custkey, o_orderdate, 'o_orderkey' AS pkey, 'o_orderdate' AS time_col, 'o_custkey>customer' AS fkeys FROM orders",
)
def parquet_table_roundtrip(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    path = work_path(spark, "table")
    tables.write_table(Table(orders, "o_orderkey", "o_orderdate", {"o_custkey": "customer"}), path)
    back = tables.read_table(spark, path)
    fkeys = ",".join(f"{k}>{t}" for k, t in back.fkeys.items())
    return back.df.select("*", F.lit(back.pkey).alias("pkey"), F.lit(back.time_col).alias("time_col"), F.lit(fkeys).alias("fkeys"))


@BOOK.query(
    "database_roundtrip",
    """SELECT 'customer' AS table_name, count(*) AS n, 'customer_id' AS pkey, NULL AS time_col, 0 AS n_fkeys FROM customer
    UNION ALL SELECT 'product', count(*), 'product_id', NULL, 0 FROM part
    UNION ALL SELECT 'review', count(*), NULL, 'review_time', 2 FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
def database_roundtrip(spark, sf_dir):
    path = work_path(spark, "database")
    tables.write_database(DATASETS["shop"](spark, sf_dir).full_db, path)
    db = tables.read_database(spark, path)
    rows = [
        t.df.agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(name).alias("table_name"), "n", F.lit(t.pkey).cast("string").alias("pkey"),
            F.lit(t.time_col).cast("string").alias("time_col"), F.lit(len(t.fkeys)).alias("n_fkeys"),
        )
        for name, t in db.tables.items()
    ]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


@BOOK.query("read_csv", "SELECT * FROM orders")
def read_csv(spark, sf_dir):
    path = work_path(spark, "csv")
    files.write_csv(read(spark, sf_dir, "orders"), path)
    return files.read_csv(spark, path, _ORDERS)


@BOOK.query("read_compressed", "SELECT * FROM orders")
def read_compressed(spark, sf_dir):
    path = work_path(spark, "csv-gz")
    files.write_csv(read(spark, sf_dir, "orders"), path, compression="gzip")
    return files.read_csv(spark, path, _ORDERS)


@BOOK.query("read_delimited", "SELECT doc_id, lang, md5(text) AS digest, length(text)::BIGINT AS n FROM documents")
def read_delimited(spark, sf_dir):
    """Free text with separators, quotes and line breaks, pipe separated."""
    path = work_path(spark, "pipe")
    files.write_csv(read(spark, sf_dir, "documents").select("doc_id", "lang", "text"), path, sep="|")
    back = files.read_delimited(spark, path, "doc_id bigint, lang string, text string", "|", multi_line=True)
    return back.select("doc_id", "lang", F.md5(F.col("text").cast("binary")).alias("digest"), F.length("text").cast("bigint").alias("n"))


@BOOK.query("read_json_lines", "SELECT event_id, user_id, event_type, value FROM events")
def read_json_lines(spark, sf_dir):
    """An explicit schema; the fields it leaves out are ignored."""
    path = work_path(spark, "json")
    files.write_json_lines(read(spark, sf_dir, "events"), path, compression="gzip")
    return files.read_json_lines(spark, path, "event_id bigint, user_id bigint, event_type string, value double")


@BOOK.query("read_parquet_dir", "SELECT event_id, user_id, ts FROM events")
def read_parquet_dir(spark, sf_dir):
    path = work_path(spark, "parts")
    read(spark, sf_dir, "events").repartition(4, "user_id").write.parquet(path)
    return files.read_parquet_parts(spark, path).select("event_id", "user_id", "ts")


def _purchase_lines(spark, sf_dir, part_rows=documents.PART_ROWS):
    return documents.purchase_documents(DATASETS["fashion"](spark, sf_dir).full_db, part_rows)


@BOOK.query(
    "write_jsonl_documents",
    """SELECT c_custkey AS customer_id, c_mktsegment AS club_member_status, count(l_orderkey) AS n_items, round(coalesce(sum(l_extendedprice), 0), 2) AS spent
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL""",
)
def write_jsonl_documents(spark, sf_dir, part_rows=documents.PART_ROWS):
    """Documents as lines of JSON, read back and summed."""
    path = work_path(spark, "documents")
    files.write_text(_purchase_lines(spark, sf_dir, part_rows), F.col("doc"), path)
    schema = "customer_id bigint, club_member_status string, purchase_history array<struct<price: double>>"
    back = files.read_json_lines(spark, path, schema)
    spent = F.aggregate("purchase_history", F.lit(0.0), lambda a, x: a + x["price"])
    # a list in several parts lies on several lines of the same customer
    return back.groupBy("customer_id").agg(
        F.max("club_member_status").alias("club_member_status"),
        F.sum(F.size("purchase_history").cast("bigint")).alias("n_items"), F.round(F.sum(spent), 2).alias("spent"),
    )


@BOOK.query("read_documents_tolerant", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus <> 'P'")
def read_documents_tolerant(spark, sf_dir):
    """Lines of one status are cut short, and skipped."""
    orders = read(spark, sf_dir, "orders")
    line = files.to_json_line(F.col("o_orderkey"), F.col("o_totalprice"))
    broken = F.when(F.col("o_orderstatus") == "P", F.left(line, F.lit(20))).otherwise(line)
    path = work_path(spark, "broken")
    files.write_text(orders, broken, path)
    return files.read_json_lines_tolerant(spark, path, "o_orderkey bigint, o_totalprice double")


@BOOK.query("row_count_file", "SELECT count(*) AS n_lines FROM customer")
def row_count_file(spark, sf_dir, part_rows=documents.PART_ROWS):
    path = work_path(spark, "lines")
    files.write_text(_purchase_lines(spark, sf_dir, part_rows), F.col("doc"), path)
    return files.count_documents(spark, path, documents.CONTINUES)


@BOOK.query(
    "write_flat_csv",
    """SELECT l_orderkey AS event, l_suppkey AS user_id, count(*) AS n FROM lineitem GROUP BY ALL""",
)
def write_flat_csv(spark, sf_dir):
    """Flattened attendance as CSV, read back."""
    path = work_path(spark, "flat")
    flat = DATASETS["meetups"](spark, sf_dir).full_db.df("event_attendees")
    files.write_csv(flat.select("event", "user_id", "status"), path)
    back = files.read_csv(spark, path, "event bigint, user_id bigint, status string")
    return back.groupBy("event", "user_id").agg(F.count(F.lit(1)).alias("n"))


def _cached_kinds(spark, sf_dir, tables):
    """Kinds inferred, stored as JSON, and loaded again."""
    path = work_path(spark, "kinds")
    columns.save_kinds(given_kinds(spark, sf_dir, tables), path)
    return columns.load_kinds(spark, path)


@BOOK.query("column_kind_cache", KINDS_SQL)
def column_kind_cache(spark, sf_dir):
    return _cached_kinds(spark, sf_dir, GIVEN)


@BOOK.query("column_kind_cache_rest", REST_KINDS_SQL)
def column_kind_cache_rest(spark, sf_dir):
    return _cached_kinds(spark, sf_dir, REST)
