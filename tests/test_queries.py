"""Every registered query against its SQL twin, on the smallest data."""

import pytest
from check import compare, connect

from __spark_entry__ import entry, oracle_sql, queries

QUERIES, SQL = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con(small_dir):
    return connect(small_dir)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(name, spark, small_dir, con):
    outcome = compare(QUERIES[name], SQL.get(name), spark, small_dir, con)
    assert not outcome.startswith("FAIL"), outcome


def test_entry_has_rows(spark):
    df = entry(spark)
    assert df.columns == ["split", "timestamp", "customer_id", "churn"]
    assert df.count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_kinds_of_every_given_table(spark, small_dir):
    from check import TABLES

    for name in ("infer_column_kinds", "column_kind_cache"):
        found = QUERIES[name](spark, small_dir).unionAll(QUERIES[f"{name}_rest"](spark, small_dir)).collect()
        seen = sorted((r["table_name"], r["column_name"]) for r in found)
        assert seen == sorted((t, c) for t in TABLES for c in spark.read.parquet(f"{small_dir}/{t}.parquet").columns)
        assert ("embeddings", "embedding", "multicategorical") in {tuple(r) for r in found}
