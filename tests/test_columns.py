"""Exact quantiles of many columns and their most frequent values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronograin.operators import columns

FRACTIONS = {"q0": 0.0, "q10": 0.1, "q25": 0.25, "q50": 0.5, "q99": 0.99, "q100": 1.0}


@pytest.mark.parametrize("error", [1e-4, 0.02, 0.2])
@pytest.mark.parametrize("n", [1, 2, 7, 200, 5001])
def test_quantiles_equal_numpy(spark, n, error):
    rng = np.random.default_rng(n)
    data = {
        "even": np.arange(n, dtype=float), "normal": rng.normal(size=n), "few": rng.integers(0, 3, n).astype(float),
        "same": np.full(n, 4.5), "heavy": np.where(rng.random(n) < 0.5, 0.0, rng.exponential(size=n)),
    }
    rows = [tuple(float(data[c][i]) for c in data) for i in range(n)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in data)).repartition(3)
    got = columns.exact_quantiles(df, {c: F.col(c) for c in data}, FRACTIONS, error)
    for c in data:
        assert [got[c][q] for q in FRACTIONS] == pytest.approx(np.quantile(data[c], list(FRACTIONS.values())).tolist()), c


def test_quantiles_without_values(spark):
    df = spark.createDataFrame([(None, 1.0), (None, float("nan")), (None, None), (None, 3.0)], "a double, b double")
    got = columns.exact_quantiles(df, {"a": F.col("a"), "b": F.col("b")}, {"half": 0.5})
    assert got == {"a": {"half": None}, "b": {"half": 2.0}}
    assert columns.exact_quantiles(df.limit(0), {"b": F.col("b")}, {"half": 0.5}) == {"b": {"half": None}}
    assert columns.exact_quantiles(df, {}, {"half": 0.5}) == {}
    stats = columns.column_stats(df, {"a": columns.NUMERICAL, "b": columns.NUMERICAL}).collect()
    assert [(r["column"], r.n, r.n_missing, r.q50) for r in stats] == [("a", 0, 4, None), ("b", 3, 1, 2.0)]


def test_top_categories_break_ties_by_text(spark):
    df = spark.createDataFrame([("x", 1), ("y", 1), ("y", 2), (None, 2), ("x", 3), ("z", None)], "s string, i int")
    got = {(r["column"], r["rank"]): (r.category, r.n) for r in columns.top_categories(df, ["s", "i"], 2).collect()}
    assert got == {("s", 1): ("x", 2), ("s", 2): ("y", 2), ("i", 1): ("1", 2), ("i", 2): ("2", 2)}


def test_kinds_are_found_in_many_tasks_and_written_by_one(spark, tmp_path):
    found = spark.range(0, 8, 1, 4).select(
        F.lit("t").alias("table_name"), F.concat(F.lit("c"), "id").alias("column_name"), F.spark_partition_id().cast("string").alias("kind")
    )
    columns.save_kinds(found, str(tmp_path / "kinds"))
    back = columns.load_kinds(spark, str(tmp_path / "kinds")).collect()
    assert len(back) == 8 and {r.kind for r in back} == {"0", "1", "2", "3"}
    assert len(list((tmp_path / "kinds").glob("part-*.json"))) == 1
