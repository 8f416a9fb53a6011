"""Metrics against direct formulas, and the edges of evaluation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronograin.operators import links, metrics


def auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    return np.mean([(a > neg).mean() + 0.5 * (a == neg).mean() for a in pos])


def pr_points(y, p):
    out = [(0.0, 1.0)]
    for s in sorted(set(p), reverse=True):
        hit = p >= s
        out.append((y[hit].sum() / y.sum(), y[hit].mean()))
    return np.array(out)


@pytest.mark.parametrize("distinct", [1, 4, 1000])
def test_curves(spark, distinct):
    rng = np.random.default_rng(distinct)
    y, p = rng.integers(0, 2, 300), rng.integers(0, distinct, 300) / distinct
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p, strict=True)], "y int, p double")
    got = metrics.curve_metrics(df, "y", "p").first()
    pts = pr_points(y, p)
    assert got.roc_auc == pytest.approx(auc(y, p))
    assert got.average_precision == pytest.approx(np.sum(np.diff(pts[:, 0]) * pts[1:, 1]))
    assert got.auprc == pytest.approx(np.sum(np.diff(pts[:, 0]) * (pts[1:, 1] + pts[:-1, 1]) / 2))
    if distinct == 1:
        assert got.roc_auc == 0.5
        assert got.average_precision == pytest.approx(y.mean())


def test_auc_without_negatives_is_undefined(spark):
    df = spark.createDataFrame([(1, 0.3), (1, 0.4)], "y int, p double")
    assert metrics.curve_metrics(df, "y", "p").first().roc_auc is None


def test_thresholds_differ_at_one_half(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.1)], "y int, p double")
    row = df.agg(metrics.accuracy(F.col("y"), F.col("p")).alias("a"), metrics.f1(F.col("y"), F.col("p")).alias("f")).first()
    assert (row.a, row.f) == (0.5, 1.0)


def test_r2_of_constant_truth(spark):
    df = spark.createDataFrame([(2.0, 2.0), (2.0, 3.0)], "y double, p double")
    assert df.agg(metrics.r2(F.col("y"), F.col("p"))).first()[0] == 0.0
    assert df.limit(1).agg(metrics.r2(F.col("y"), F.col("p"))).first()[0] == 1.0


def test_link_metrics_equal_direct_formula(spark):
    rng, k = np.random.default_rng(3), 6
    truth = {s: set(rng.choice(30, rng.integers(1, 12), replace=False).tolist()) for s in range(25)}
    pred = {s: rng.integers(-1, 30, k).tolist() for s in range(25)}  # repeats and padding occur
    t = spark.createDataFrame([(s, d) for s, ds in truth.items() for d in ds], "src bigint, dst bigint")
    p = spark.createDataFrame(list(pred.items()), "src bigint, pred array<bigint>")
    got = metrics.link_metrics(metrics.link_hits(t, p, ["src"], "dst"), k).first()
    isin = np.array([[d in truth[s] for d in pred[s]] for s in range(25)], float)
    n = np.array([len(truth[s]) for s in range(25)])
    clipped = np.minimum(n, k)
    gain = 1 / np.log2(np.arange(k) + 2)
    assert got.link_recall == pytest.approx((isin.sum(1) / n).mean())
    assert got.link_precision == pytest.approx((isin.sum(1) / k).mean())
    assert got.link_map == pytest.approx(((np.cumsum(isin, 1) / (np.arange(k) + 1) * isin).sum(1) / clipped).mean())
    assert got.link_ndcg == pytest.approx(((isin * gain).sum(1) / np.cumsum(gain)[clipped - 1]).mean())


def labels(spark):
    return spark.createDataFrame([(1, 0.0), (2, 1.0), (3, 1.0)], "id bigint, y double")


@pytest.mark.parametrize("ids", [[1, 2], [1, 2, 4], [1, 2, 3, 3], [1, 2, 3, 4]])
def test_predictions_must_match_by_key(spark, ids):
    pred = spark.createDataFrame([(i, 0.7) for i in ids], "id bigint, pred double")
    with pytest.raises(ValueError, match="exactly one prediction"):
        metrics.evaluate_entity(labels(spark), pred, ["id"], "y", ["accuracy"])


def test_evaluation_takes_named_and_own_metrics(spark):
    pred = spark.createDataFrame([(3, 0.9), (1, 0.2), (2, 0.4)], "id bigint, pred double")

    def bias(y, p):
        return F.avg(p - y)

    got = metrics.evaluate_entity(labels(spark), pred, ["id"], "y", ["roc_auc", "accuracy", bias])
    assert got == pytest.approx({"roc_auc": 1.0, "accuracy": 2 / 3, "bias": -0.5 / 3})
    with pytest.raises(ValueError, match="unknown"):
        metrics.evaluate_entity(labels(spark), pred, ["id"], "y", ["nope"])


def test_link_evaluation_checks_the_shape(spark):
    truth = spark.createDataFrame([(1, 5)], "src bigint, dst bigint")
    short = spark.createDataFrame([(1, [5])], "src bigint, pred array<bigint>")
    with pytest.raises(ValueError, match="lists of 2"):
        metrics.evaluate_link(truth, short, ["src"], "dst", 2, ["link_map"])


def test_ties_in_top_k_go_to_the_smaller_id(spark):
    pairs = spark.createDataFrame([(1, d) for d in (9, 4, 4, 7, 9, 2)], "src bigint, dst bigint")
    rows = spark.createDataFrame([(1,), (2,)], "src bigint")
    past = {r.src: r.pred for r in links.predict_past_visits(rows, pairs, "src", "dst", 5).collect()}
    assert past == {1: [4, 9, 2, 7, -1], 2: [-1] * 5}
    top = {r.src: r.pred for r in links.predict_most_popular(rows, pairs, "dst", 3).collect()}
    assert top == {1: [4, 9, 2], 2: [4, 9, 2]}


def test_negative_pairs_can_avoid_known_links(spark):
    pairs = spark.createDataFrame([(s, d) for s in range(20) for d in range(5)], "src bigint, dst bigint")
    plain = links.negative_pairs(pairs, "dst", 6, 1)
    strict = links.negative_pairs(pairs, "dst", 6, 1, avoid_known=True)
    assert plain.count() == 100
    assert {r.dst for r in strict.collect()} == {5}


@pytest.mark.parametrize("bad", [None, float("nan")])
def test_a_prediction_without_a_number_is_refused(spark, bad):
    truth = spark.createDataFrame([(1, 0.0), (2, 1.0), (3, 0.0)], "id int, y double")
    pred = spark.createDataFrame([(1, 0.0), (2, bad), (3, 0.0)], "id int, pred double")
    with pytest.raises(ValueError, match="exactly one prediction"):
        metrics.evaluate_entity(truth, pred, ["id"], "y", ["mae"])
    lists = spark.createDataFrame([(1, [0, 1]), (2, [1, 1])], "id int, y array<int>")
    scores = spark.createDataFrame([(1, [0.1, bad]), (2, [0.2, 0.3])], "id int, pred array<double>")
    with pytest.raises(ValueError, match="exactly one prediction"):
        metrics.evaluate_entity(lists, scores, ["id"], "y", ["multilabel_f1_macro"])


def test_own_link_metric_and_checks_in_one_pass(spark):
    truth = spark.createDataFrame([(1, 7), (1, 8), (2, 9)], "src int, dst int")
    pred = spark.createDataFrame([(1, [7, 5]), (2, [4, 3])], "src int, pred array<int>")

    def share_hit(hits, n_true, k):
        return F.avg((F.size(hits) > 0).cast("double"))

    got = metrics.evaluate_link(truth, pred, ["src"], "dst", 2, ["link_recall", share_hit])
    assert got == {"link_recall": 0.25, "share_hit": 0.5}
    for wrong in ([(1, [7, 5])], [(1, [7, 5]), (2, [4])], [(1, [7, 5]), (2, None)], [(1, [7, 5]), (2, [4, 3]), (3, [1, 2])]):
        with pytest.raises(ValueError, match="lists of 2"):
            metrics.evaluate_link(truth, spark.createDataFrame(wrong, pred.schema), ["src"], "dst", 2, ["link_map"])
