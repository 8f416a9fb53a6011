"""Plans: no nested loop over facts, no row-wise Python, pruned and filtered scans."""

import re

import pytest

from __spark_entry__ import queries
from chronograin.queries.labels import BOOK as LABELS

QUERIES = queries()


def plan(spark, name, folder):
    return QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", list(LABELS.queries))
def test_labels_need_no_range_join(spark, small_dir, name):
    text = plan(spark, name, small_dir)
    assert "NestedLoop" not in text and "CartesianProduct" not in text
    assert "Python" not in text and "ArrowEval" not in text


def test_churn_is_one_scan_of_the_facts_with_pushed_time_bounds(spark, small_dir):
    text = plan(spark, "label_racing_driver_dnf", small_dir)
    assert text.count("lineitem.parquet") == 1
    assert text.count("Exchange hashpartitioning") == 1
    assert "GreaterThan(l_shipdate" in text
    assert re.search(r"ReadSchema: struct<l_suppkey:bigint,l_returnflag:string,l_shipdate:timestamp_ntz>", text)


def test_top_k_is_cut_before_the_shuffle(spark, small_dir):
    text = plan(spark, "topk_per_src", small_dir)
    assert text.count("WindowGroupLimit") >= 2
