"""Baselines, candidate lists, metrics and statistics over labels built from the given tables."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from chronograin.functions.draws import draw_sql
from chronograin.grid import Grid
from chronograin.model import Table, TaskKind, ntz
from chronograin.operators import baselines, joins, links, metrics, scoring, stats, windows
from chronograin.plans.catalog import get_task
from chronograin.queries import Book, read
from chronograin.queries.databases import DATASETS
from chronograin.queries.labels import BOOK as LABELS

BOOK = Book()

GRID = Grid("train", datetime(1997, 1, 1), timedelta(days=91), 12)
VAL_FROM = datetime(1999, 1, 1)
_LAB = f"""lab AS (SELECT timestamp, o_custkey, round(sum(o_totalprice), 2) AS total, count(*) % 3 AS few
  FROM (SELECT TIMESTAMP '1997-01-01' + 91 * k * INTERVAL 1 DAY AS timestamp FROM generate_series(0, 11) AS s(k))
  JOIN orders ON o_orderdate > timestamp AND o_orderdate <= timestamp + INTERVAL 91 DAY GROUP BY ALL),
train AS (SELECT * FROM lab WHERE timestamp < TIMESTAMP '{VAL_FROM}'),
val AS (SELECT timestamp, o_custkey FROM lab WHERE timestamp >= TIMESTAMP '{VAL_FROM}')"""


def _sales(spark, sf_dir):
    """Labels of spending per customer, as (train, rows to predict)."""
    facts = read(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    lab = windows.aggregate(
        facts, "o_custkey", "o_orderdate", [GRID], total=F.round(F.sum("o_totalprice"), 2), few=F.count(F.lit(1)) % 3
    ).drop("split")
    early = F.col("timestamp") < ntz(VAL_FROM)
    return lab.where(early), lab.where(~early).select("timestamp", "o_custkey")


def _global(how):
    def run(spark, sf_dir):
        train, rows = _sales(spark, sf_dir)
        target = "few" if how == "majority" else "total"
        return baselines.global_prediction(train, rows, target, how).withColumn("pred", F.round("pred", 4))

    return run


for _how, _value in {
    "global_zero": "0.0::DOUBLE",
    "global_mean": "round((SELECT avg(total) FROM train), 4)",
    "global_median": "round((SELECT median(total) FROM train), 4)",
    "majority": "(SELECT few FROM train GROUP BY few ORDER BY count(*) DESC, few LIMIT 1)::DOUBLE",
}.items():
    BOOK.add(f"baseline_{_how}", _global(_how), f"WITH {_LAB} SELECT *, {_value} AS pred FROM val")


def _entity(how):
    def run(spark, sf_dir):
        train, rows = _sales(spark, sf_dir)
        return baselines.entity_prediction(train, rows, "o_custkey", "total", how).withColumn("pred", F.round("pred", 6))

    return run


for _how, _fn in {"entity_mean": "avg", "entity_median": "median"}.items():
    BOOK.add(
        f"baseline_{_how}",
        _entity(_how),
        f"""WITH {_LAB}, past AS (SELECT o_custkey, {_fn}(total) AS p FROM train GROUP BY o_custkey)
        SELECT val.*, round(coalesce(p, 0), 6) AS pred FROM val LEFT JOIN past USING (o_custkey)""",
    )


@BOOK.query(
    "baseline_random",
    f"WITH {_LAB} SELECT val.*, {draw_sql(42, 'timestamp', 'o_custkey')} / {float(1 << 52)!r}::DOUBLE AS pred FROM val",
)
def baseline_random(spark, sf_dir):
    return baselines.random_prediction(_sales(spark, sf_dir)[1], ["timestamp", "o_custkey"], 42)


_ML = """ml AS (SELECT l_orderkey, l_linenumber, l_partkey, [CAST(l_linestatus = 'F' AS INTEGER), CAST(l_returnflag = 'R' AS INTEGER),
  CAST(l_linenumber > 4 AS INTEGER)] AS y, [l_discount * 10, l_tax * 12, l_quantity / 50] AS p,
  CASE WHEN l_shipdate <= TIMESTAMP '2000-07-01' THEN 'train' ELSE 'test' END AS split, date_trunc('year', l_shipdate) AS timestamp
  FROM lineitem)"""


def _multilabel(spark, sf_dir, more=()):
    """Three flags per line, scores for them, and a split by time."""
    return read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.array(
            (F.col("l_linestatus") == "F").cast("int"), (F.col("l_returnflag") == "R").cast("int"), (F.col("l_linenumber") > 4).cast("int")
        ).alias("y"),
        F.array(F.col("l_discount") * 10, F.col("l_tax") * 12, F.col("l_quantity") / 50).alias("p"),
        F.when(F.col("l_shipdate") <= ntz("2000-07-01 00:00:00"), "train").otherwise("test").alias("split"),
        F.date_trunc("year", "l_shipdate").cast("timestamp_ntz").alias("timestamp"),
        *more,
    )


def _flat(df, col, n=3):
    return df.select("*", *[F.col(col)[i].alias(f"{col}_{i}") for i in range(n)]).drop(col)


@BOOK.query(
    "majority_multilabel",
    f"""WITH {_ML}, best AS (SELECT
      (SELECT y[1] FROM ml WHERE split = 'train' GROUP BY y[1] ORDER BY count(*) DESC, y[1] LIMIT 1) AS pred_0,
      (SELECT y[2] FROM ml WHERE split = 'train' GROUP BY y[2] ORDER BY count(*) DESC, y[2] LIMIT 1) AS pred_1,
      (SELECT y[3] FROM ml WHERE split = 'train' GROUP BY y[3] ORDER BY count(*) DESC, y[3] LIMIT 1) AS pred_2)
    SELECT l_orderkey, l_linenumber, l_partkey, best.* FROM ml, best WHERE split = 'test'""",
)
def majority_multilabel(spark, sf_dir):
    ml = _multilabel(spark, sf_dir)
    rows = ml.where(F.col("split") == "test").select("l_orderkey", "l_linenumber", "l_partkey")
    return _flat(baselines.majority_multilabel(ml.where(F.col("split") == "train"), rows, "y"), "pred")


@BOOK.query(
    "random_multilabel",
    "SELECT l_orderkey, l_linenumber, l_partkey, "
    + ", ".join(
        f"{draw_sql(42 + i, 'l_orderkey', 'l_linenumber', 'l_partkey')} / {float(1 << 52)!r}::DOUBLE AS pred_{i}" for i in range(3)
    )
    + " FROM lineitem",
)
def random_multilabel(spark, sf_dir):
    rows = _multilabel(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey")
    return _flat(baselines.random_multilabel(rows, rows.columns, 3, 42), "pred")


# --- links ------------------------------------------------------------------------------------------

K = 5
_VISITS = """visits AS (SELECT o_custkey AS src, l_partkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  WHERE l_shipdate <= TIMESTAMP '2000-07-01'),
pair AS (SELECT src, dst, count(*) AS num_past_visit FROM visits GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY num_past_visit DESC, dst) AS rank FROM pair),
popular AS (SELECT dst, count(*) AS n, count(*) / max(count(*)) OVER () AS share,
  row_number() OVER (ORDER BY count(*) DESC, dst) AS rank FROM visits GROUP BY dst),
rows_ AS (SELECT c_custkey AS src FROM customer)"""


def _visits(spark, sf_dir):
    """Past (customer, part) visits, repeats included."""
    lines, orders = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    past = lines.where(F.col("l_shipdate") <= ntz("2000-07-01 00:00:00"))
    joined = past.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(F.col("o_custkey").alias("src"), F.col("l_partkey").alias("dst"))


def _sources(spark, sf_dir):
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("src"))


def _spelled(df, col="pred"):
    """Lists as text, which every engine prints alike."""
    return df.withColumn(col, F.concat_ws(",", F.col(col).cast("array<string>")))


@BOOK.query("pair_counts", f"WITH {_VISITS} SELECT * FROM pair")
def pair_counts(spark, sf_dir):
    return links.pair_counts(_visits(spark, sf_dir), "src", "dst")


@BOOK.query("popularity_fraction", f"WITH {_VISITS} SELECT dst, n, round(share, 6) AS global_popularity_fraction FROM popular")
def popularity_fraction(spark, sf_dir):
    share = links.popularity(_visits(spark, sf_dir), "dst")
    return share.withColumn("global_popularity_fraction", F.round("global_popularity_fraction", 6))


@BOOK.query(
    "topk_per_src",
    f"""WITH {_VISITS}, lists AS (SELECT src, string_agg(dst, ',' ORDER BY rank) AS l, count(*) AS n FROM ranked WHERE rank <= {K} GROUP BY src)
    SELECT rows_.src, CASE WHEN l IS NULL THEN rtrim(repeat('-1,', {K}), ',') WHEN n < {K} THEN l || repeat(',-1', {K} - n) ELSE l END AS pred
    FROM rows_ LEFT JOIN lists USING (src)""",
)
def topk_per_src(spark, sf_dir):
    return _spelled(links.predict_past_visits(_sources(spark, sf_dir), _visits(spark, sf_dir), "src", "dst", K))


@BOOK.query(
    "topk_global",
    f"WITH {_VISITS} SELECT src, (SELECT string_agg(dst, ',' ORDER BY rank) FROM popular WHERE rank <= {K}) AS pred FROM rows_",
)
def topk_global(spark, sf_dir):
    return _spelled(links.predict_most_popular(_sources(spark, sf_dir), _visits(spark, sf_dir), "dst", K))


_CANDIDATES = f"""mixed AS (SELECT src, dst, 2 * rank AS o FROM ranked WHERE rank <= {K}
  UNION ALL SELECT src, dst, 2 * rank + 1 FROM rows_, popular WHERE rank <= {2 * K}),
numbered AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY o) - 1 AS place FROM mixed WHERE src IN (SELECT src FROM rows_)),
cand AS (SELECT * FROM numbered WHERE place < {2 * K})"""


@BOOK.query("interleave_candidates", f"WITH {_VISITS}, {_CANDIDATES} SELECT src, dst, place::INTEGER AS place FROM cand")
def interleave_candidates(spark, sf_dir):
    return links.candidates(_sources(spark, sf_dir), _visits(spark, sf_dir), "src", "dst", K)


@BOOK.query(
    "candidate_features",
    f"""WITH {_VISITS}, {_CANDIDATES} SELECT c.src, c.dst, c.place::INTEGER AS place, coalesce(num_past_visit, 0) AS num_past_visit,
    round(coalesce(share, 0), 6) AS global_popularity_fraction FROM cand c
    LEFT JOIN pair ON pair.src = c.src AND pair.dst = c.dst LEFT JOIN popular ON popular.dst = c.dst""",
)
def candidate_features(spark, sf_dir):
    visits = _visits(spark, sf_dir)
    cand = links.candidates(_sources(spark, sf_dir), visits, "src", "dst", K)
    out = links.past_features(cand, visits, "src", "dst")
    return out.withColumn("global_popularity_fraction", F.round("global_popularity_fraction", 6))


@BOOK.query(
    "rank_predictions",
    f"""WITH s AS (SELECT o_custkey, l_partkey, max(l_discount) AS score FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, l_partkey) AS rank FROM s),
    l AS (SELECT o_custkey, string_agg(l_partkey, ',' ORDER BY rank) AS l, count(*) AS n FROM r WHERE rank <= {K} GROUP BY o_custkey)
    SELECT o_custkey, l || repeat(',-1', {K} - n) AS pred FROM l""",
)
def rank_predictions(spark, sf_dir):
    lines, orders = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    scored = (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("o_custkey", "l_partkey")
        .agg(F.max("l_discount").alias("score"))
    )
    return _spelled(links.rank_predictions(scored, ["o_custkey"], "l_partkey", "score", K))


@BOOK.query(
    "score_topk",
    """WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings),
    i AS (SELECT vec_id AS item_id, embedding::DOUBLE[] AS w FROM embeddings),
    s AS (SELECT query_id, item_id, list_inner_product(v, w) AS score FROM q, i),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM s)
    SELECT query_id, item_id, rank::INTEGER AS rank, round(score, 6) AS score FROM r WHERE rank <= 10""",
)
def score_topk(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    best = links.score_top_k(vectors, vectors, 10)
    return best.withColumn("score", F.round("score", 6))


@BOOK.query(
    "score_topk_pruned_blocks",
    f"""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
    c AS (SELECT row_number() OVER (ORDER BY d, vec_id) - 1 AS centre, v AS w FROM (
      SELECT vec_id, v, {draw_sql(3, "vec_id")} AS d FROM e ORDER BY d, vec_id LIMIT 12)),
    near AS (SELECT vec_id, v, centre, list_distance(v, w) AS far FROM e, c),
    own AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY far, centre) = 1),
    limits AS (SELECT centre, max(far) AS radius, max(sqrt(list_inner_product(v, v))) AS largest, count(*) AS n FROM own GROUP BY centre),
    s AS (SELECT q.vec_id AS query_id, list_inner_product(q.v, i.v) AS score FROM e q, e i),
    r AS (SELECT query_id, score AS mark FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC) = 10),
    b AS (SELECT query_id, mark, n, sqrt(list_inner_product(v, v)) AS norm, list_inner_product(v, w) AS dot, radius, largest
      FROM r JOIN e ON vec_id = query_id, c JOIN limits USING (centre))
    SELECT query_id, count(*) AS n_centres, sum(n)::BIGINT AS n_items FROM b
    WHERE least(dot + norm * radius, norm * largest) >= mark - 1e-9 * (1 + abs(mark)) GROUP BY query_id""",
)
def score_topk_pruned_blocks(spark, sf_dir):
    """What the bounds leave of the items, at each query's tenth best score."""
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    index = scoring.build_index(vectors, scoring.find_centres(vectors, 12, steps=0, seed=3))
    best, _ = scoring.search(vectors, index, 10)
    marks = best.where(F.col("rank") == 10).select("query_id", F.col("score").alias("mark"))
    return scoring.reachable(vectors, index, marks)


@BOOK.query(
    "feature_join",
    f"""WITH {_LAB} SELECT timestamp, o_custkey, total, c_name, c_acctbal, c_mktsegment FROM lab LEFT JOIN customer ON o_custkey = c_custkey""",
)
def feature_join(spark, sf_dir):
    facts = read(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    lab = windows.aggregate(facts, "o_custkey", "o_orderdate", [GRID], total=F.round(F.sum("o_totalprice"), 2)).drop("split")
    customer = Table(read(spark, sf_dir, "customer"), "c_custkey", None, {"c_nationkey": "nation"})
    return joins.feature_join(lab, "o_custkey", customer)


@BOOK.query(
    "pair_feature_join",
    """SELECT DISTINCT l_orderkey, l_suppkey, o_custkey, c.name AS name_x, c.acctbal AS acctbal_x, c.segment, s.name AS name_y, s.acctbal AS acctbal_y
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    LEFT JOIN (SELECT c_custkey, c_name AS name, c_acctbal AS acctbal, c_mktsegment AS segment FROM customer) c ON c_custkey = o_custkey
    LEFT JOIN (SELECT s_suppkey, s_name AS name, s_acctbal AS acctbal FROM supplier) s ON s_suppkey = l_suppkey""",
)
def pair_feature_join(spark, sf_dir):
    lines, orders = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    pairs = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_suppkey", "o_custkey").distinct()
    customer = read(spark, sf_dir, "customer").select(
        "c_custkey", F.col("c_name").alias("name"), F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("segment")
    )
    supplier = read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("name"), F.col("s_acctbal").alias("acctbal"))
    return joins.pair_feature_join(pairs, "o_custkey", Table(customer, "c_custkey"), "l_suppkey", Table(supplier, "s_suppkey"))


# --- metrics -----------------------------------------------------------------------------------------

_SCORED = "s AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, round(l_extendedprice / 100000, 3) AS p FROM lineitem)"


def _scored(spark, sf_dir):
    y = F.when(F.col("l_returnflag") == "R", 1).otherwise(0)
    return read(spark, sf_dir, "lineitem").select(y.alias("y"), F.round(F.col("l_extendedprice") / 100000, 3).alias("p"))


def _rounded(df, digits=6):
    return df.select(*[F.round(c, digits).alias(c) for c in df.columns])


@BOOK.query(
    "metric_binary",
    f"""WITH {_SCORED}, c AS (SELECT count(*) FILTER (y = 1 AND p >= 0.5) AS tp, count(*) FILTER (y = 0 AND p >= 0.5) AS fp,
      count(*) FILTER (y = 1 AND p < 0.5) AS fn, avg(CAST((p > 0.5) = (y = 1) AS INTEGER)) AS accuracy,
      -avg(y * ln(1 / (1 + exp(-p))) + (1 - y) * ln(1 - 1 / (1 + exp(-p)))) AS log_loss FROM s)
    SELECT round(accuracy, 6) AS accuracy, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1, round(log_loss, 6) AS log_loss FROM c""",
)
def metric_binary(spark, sf_dir):
    y, p = F.col("y"), F.col("p")
    one = _scored(spark, sf_dir).agg(
        metrics.accuracy(y, p).alias("accuracy"), metrics.f1(y, p).alias("f1"), metrics.log_loss(y, p).alias("log_loss")
    )
    return _rounded(one)


_CURVE = """st AS (SELECT {key} p, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM s GROUP BY ALL),
cu AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM st WINDOW w AS ({part} ORDER BY p DESC)),
pr AS (SELECT *, tp / (tp + fp) AS prec, CASE WHEN tp + fp = pos + neg THEN 1.0 ELSE (tp - pos) / (tp + fp - pos - neg) END AS before FROM cu),
re AS (SELECT {key} sum(neg * (tp - pos / 2)) / (sum(pos) * sum(neg)) AS roc_auc, sum(pos * prec) / sum(pos) AS average_precision,
  sum(pos * (prec + before) / 2) / sum(pos) AS auprc FROM pr GROUP BY ALL)"""


@BOOK.query(
    "metric_curves",
    f"""WITH {_SCORED}, {_CURVE.format(key="", part="")}
    SELECT round(roc_auc, 6) AS roc_auc, round(average_precision, 6) AS average_precision, round(auprc, 6) AS auprc FROM re""",
)
def metric_curves(spark, sf_dir):
    return _rounded(metrics.curve_metrics(_scored(spark, sf_dir), "y", "p"))


@BOOK.query(
    "metric_regression",
    """WITH s AS (SELECT l_quantity AS y, l_extendedprice / 2000 AS p FROM lineitem)
    SELECT round(avg(abs(y - p)), 6) AS mae, round(avg((y - p) ** 2), 5) AS mse, round(sqrt(avg((y - p) ** 2)), 6) AS rmse,
    round(1 - sum((y - p) ** 2) / sum((y - (SELECT avg(y) FROM s)) ** 2), 6) AS r2 FROM s""",
)
def metric_regression(spark, sf_dir):
    y, p = F.col("l_quantity"), F.col("l_extendedprice") / 2000
    one = read(spark, sf_dir, "lineitem").agg(
        metrics.mae(y, p).alias("mae"), metrics.mse(y, p).alias("mse"), metrics.rmse(y, p).alias("rmse"), metrics.r2(y, p).alias("r2")
    )
    return one.select(*[F.round(c, 5 if c == "mse" else 6).alias(c) for c in one.columns])


@BOOK.query(
    "metric_multiclass",
    """WITH s AS (SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS y,
      list_position([l_discount, l_tax, l_quantity / 500], greatest(l_discount, l_tax, l_quantity / 500)) - 1 AS v,
      [l_discount, l_tax, l_quantity / 500] AS q FROM lineitem),
    c AS (SELECT k, count(*) FILTER (y = k AND v = k) AS tp, count(*) FILTER (y <> k AND v = k) AS fp, count(*) FILTER (y = k AND v <> k) AS fn
      FROM s, (VALUES (0), (1), (2)) AS t(k) GROUP BY k),
    l AS (SELECT avg(CAST(y = v AS INTEGER)) AS a, -avg(ln(exp(q[y + 1]) / (exp(q[1]) + exp(q[2]) + exp(q[3])))) AS ll FROM s)
    SELECT round((SELECT a FROM l), 6) AS multiclass_accuracy, round((SELECT ll FROM l), 6) AS multiclass_log_loss,
    round(avg(2.0 * tp / (2 * tp + fp + fn)), 6) AS macro_f1, round(2.0 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS micro_f1 FROM c""",
)
def metric_multiclass(spark, sf_dir):
    flag = F.col("l_returnflag")
    scored = read(spark, sf_dir, "lineitem").select(
        F.when(flag == "A", 0).when(flag == "N", 1).otherwise(2).alias("y"),
        F.array("l_discount", "l_tax", F.col("l_quantity") / 500).alias("p"),
    )
    y, p = F.col("y"), F.col("p")
    simple = scored.agg(
        metrics.multiclass_accuracy(y, p).alias("multiclass_accuracy"), metrics.multiclass_log_loss(y, p).alias("multiclass_log_loss")
    )
    return _rounded(joins.with_constants(metrics.class_f1(scored, "y", "p"), simple))


@BOOK.query(
    "metric_multilabel_ranking",
    f"""WITH {_ML}, s AS (SELECT unnest([0, 1, 2]) AS label, unnest(y) AS y, unnest(p) AS p FROM ml),
    {_CURVE.format(key="label,", part="PARTITION BY label")}, macro AS (SELECT avg(average_precision) AS ap, avg(roc_auc) AS auc FROM re),
    {_CURVE.format(key="", part="").replace("st AS", "st2 AS").replace("FROM st ", "FROM st2 ").replace("cu AS", "cu2 AS").replace("FROM cu)", "FROM cu2)").replace("pr AS", "pr2 AS").replace("FROM pr ", "FROM pr2 ").replace("re AS", "re2 AS")}
    SELECT round(re2.average_precision, 6) AS multilabel_auprc_micro, round(re2.roc_auc, 6) AS multilabel_auroc_micro,
    round(macro.ap, 6) AS multilabel_auprc_macro, round(macro.auc, 6) AS multilabel_auroc_macro FROM re2, macro""",
)
def metric_multilabel_ranking(spark, sf_dir):
    return _rounded(metrics.multilabel_ranking(_multilabel(spark, sf_dir), "y", "p"))


@BOOK.query(
    "metric_multilabel_decisions",
    f"""WITH {_ML}, s AS (SELECT unnest([0, 1, 2]) AS label, unnest(y) AS y, unnest(p) AS p FROM ml),
    c AS (SELECT label, count(*) FILTER (y = 1 AND p > 0.5) AS tp, count(*) FILTER (y = 0 AND p > 0.5) AS fp,
      count(*) FILTER (y = 1 AND p <= 0.5) AS fn FROM s GROUP BY label)
    SELECT round(avg(2.0 * tp / (2 * tp + fp + fn)), 6) AS multilabel_f1_macro, round(avg(tp / (tp + fn)), 6) AS multilabel_recall_macro,
    round(avg(tp / (tp + fp)), 6) AS multilabel_precision_macro,
    round(2.0 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS multilabel_f1_micro,
    round(sum(tp) / (sum(tp) + sum(fn)), 6) AS multilabel_recall_micro, round(sum(tp) / (sum(tp) + sum(fp)), 6) AS multilabel_precision_micro FROM c""",
)
def metric_multilabel_decisions(spark, sf_dir):
    return _rounded(metrics.multilabel_decisions(_multilabel(spark, sf_dir), "y", "p"))


@BOOK.query(
    "metric_link",
    f"""WITH {_VISITS}, truth AS (SELECT DISTINCT o_custkey AS src, l_partkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey
      WHERE l_shipdate > TIMESTAMP '2000-07-01'),
    n AS (SELECT src, count(*) AS n_true, least(count(*), {2 * K}) AS m FROM truth WHERE src IN (SELECT src FROM rows_) GROUP BY src),
    hit AS (SELECT r.src, r.rank, row_number() OVER (PARTITION BY r.src ORDER BY r.rank) AS i FROM ranked r
      JOIN truth t ON t.src = r.src AND t.dst = r.dst WHERE r.rank <= {2 * K}),
    ideal AS (SELECT m, sum(1 / log2(j + 1)) AS best FROM (SELECT DISTINCT m FROM n), generate_series(1, {2 * K}) AS g(j) WHERE j <= m GROUP BY m),
    per AS (SELECT n.src, n_true, n.m, best, count(hit.i) AS h, coalesce(sum(i / rank), 0) AS gain, coalesce(sum(1 / log2(rank + 1)), 0) AS dcg
      FROM n JOIN ideal ON ideal.m = n.m LEFT JOIN hit ON hit.src = n.src GROUP BY ALL)
    SELECT round(avg(h / {2 * K}), 6) AS link_precision, round(avg(h / n_true), 6) AS link_recall, round(avg(gain / m), 6) AS link_map,
    round(avg(dcg / best), 6) AS link_ndcg FROM per""",
)
def metric_link(spark, sf_dir):
    """Past visits as predictions, later purchases as truth."""
    lines, orders = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    later = lines.where(F.col("l_shipdate") > ntz("2000-07-01 00:00:00")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    truth = later.select(F.col("o_custkey").alias("src"), F.col("l_partkey").alias("dst"))
    pred = links.predict_past_visits(_sources(spark, sf_dir), _visits(spark, sf_dir), "src", "dst", 2 * K)
    return _rounded(metrics.link_metrics(metrics.link_hits(truth, pred, ["src"], "dst"), 2 * K))


def _as_rows(spark, scores):
    return spark.createDataFrame([(n, None if v is None else round(float(v), 6)) for n, v in scores.items()], "metric string, value double")


@BOOK.query(
    "evaluate_entity",
    f"""WITH lab AS ({LABELS.sql["label_shop_user_ltv"]}), m AS (SELECT customer_id, avg(ltv) AS p FROM lab WHERE split = 'train' GROUP BY 1),
    s AS (SELECT ltv AS y, coalesce(p, 0) AS p FROM lab LEFT JOIN m USING (customer_id) WHERE split = 'val')
    SELECT 'r2' AS metric, round(1 - sum((y - p) ** 2) / sum((y - (SELECT avg(y) FROM s)) ** 2), 6) AS value FROM s
    UNION ALL SELECT 'mae', round(avg(abs(y - p)), 6) FROM s UNION ALL SELECT 'rmse', round(sqrt(avg((y - p) ** 2)), 6) FROM s""",
)
def evaluate_entity(spark, sf_dir):
    """Entity mean of past spending, scored on the validation labels of a task."""
    task, dataset = get_task("shop", "user-ltv"), DATASETS["shop"](spark, sf_dir)
    train, val = (task.table(dataset, s).df for s in ("train", "val"))
    rows = val.select("timestamp", "customer_id")
    pred = baselines.entity_prediction(train, rows, "customer_id", "ltv", "entity_mean")
    return _as_rows(spark, task.evaluate(dataset, pred, "val"))


@BOOK.query(
    "evaluate_link",
    f"""WITH lab AS ({LABELS.sql["label_fashion_user_item_purchase"]}),
    c AS (SELECT customer_id, article_id, count(*) AS seen FROM lab WHERE split = 'train' GROUP BY customer_id, article_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY seen DESC, article_id) AS rank FROM c),
    n AS (SELECT customer_id, count(*) AS n FROM lab WHERE split = 'val' GROUP BY 1),
    h AS (SELECT r.customer_id, rank, row_number() OVER (PARTITION BY r.customer_id ORDER BY rank) AS i FROM r JOIN lab ON lab.split = 'val'
      AND lab.customer_id = r.customer_id AND lab.article_id = r.article_id WHERE rank <= 12),
    per AS (SELECT n.customer_id, n, count(i) AS h, coalesce(sum(i / rank), 0) AS g FROM n LEFT JOIN h USING (customer_id) GROUP BY ALL)
    SELECT 'link_precision' AS metric, round(avg(h / 12), 6) AS value FROM per UNION ALL SELECT 'link_recall', round(avg(h / n), 6) FROM per
    UNION ALL SELECT 'link_map', round(avg(g / least(n, 12)), 6) FROM per""",
)
def evaluate_link(spark, sf_dir):
    """Past visits, scored on the validation pairs of a task."""
    task, dataset = get_task("fashion", "user-item-purchase"), DATASETS["fashion"](spark, sf_dir)
    train, val = (task.labels(dataset, [s]) for s in ("train", "val"))
    rows = val.select("timestamp", "customer_id").distinct()
    pred = links.predict_past_visits(rows, train, "customer_id", "article_id", task.k)
    return _as_rows(spark, task.evaluate(dataset, pred, "val"))


_LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]


def _long(query: str, names: list[str]) -> str:
    """The columns of a one-row query as (metric, value)."""
    rows = " UNION ALL ".join(f"SELECT '{n}' AS metric, {n}::DOUBLE AS value FROM one" for n in names)
    return f"WITH one AS ({query}) {rows}"


MULTICLASS = ["multiclass_accuracy", "multiclass_log_loss", "macro_f1", "micro_f1"]
MULTILABEL = [f"multilabel_{m}_{h}" for m in ("f1", "recall", "precision") for h in ("macro", "micro")]
MULTILABEL_RANKING = [f"multilabel_{m}_{h}" for m in ("auprc", "auroc") for h in ("micro", "macro")]


@BOOK.query("evaluate_multiclass", _long(BOOK.sql["metric_multiclass"], MULTICLASS))
def evaluate_multiclass(spark, sf_dir):
    """Three classes of lines against three scores each, met by key."""
    flag = F.col("l_returnflag")
    lines = read(spark, sf_dir, "lineitem")
    labels = lines.select(*_LINE_KEY, F.when(flag == "A", 0).when(flag == "N", 1).otherwise(2).alias("y"))
    pred = lines.select(*_LINE_KEY, F.array("l_discount", "l_tax", F.col("l_quantity") / 500).alias("pred"))
    return _as_rows(spark, metrics.evaluate_entity(labels, pred, _LINE_KEY, "y", MULTICLASS))


def _evaluated_flags(names):
    def run(spark, sf_dir):
        scored = _multilabel(spark, sf_dir, ["l_suppkey", "l_shipdate"])
        labels, pred = scored.select(*_LINE_KEY, "y"), scored.select(*_LINE_KEY, F.col("p").alias("pred"))
        return _as_rows(spark, metrics.evaluate_entity(labels, pred, _LINE_KEY, "y", names))

    return run


BOOK.add("evaluate_multilabel", _evaluated_flags(MULTILABEL), _long(BOOK.sql["metric_multilabel_decisions"], MULTILABEL))
BOOK.add(
    "evaluate_multilabel_ranking", _evaluated_flags(MULTILABEL_RANKING), _long(BOOK.sql["metric_multilabel_ranking"], MULTILABEL_RANKING)
)


# --- statistics ------------------------------------------------------------------------------------------


def _label_sql(name: str) -> tuple[str, str]:
    """The label SQL as a CTE prefix and its final SELECT as CTE ``lab``."""
    return f"lab AS ({LABELS.sql[name]})", "lab"


_LEVELS = """lv AS (SELECT split, timestamp, * EXCLUDE (split, timestamp) FROM lab UNION ALL
  SELECT split, NULL, * EXCLUDE (split, timestamp) FROM lab UNION ALL SELECT 'total', NULL, * EXCLUDE (split, timestamp) FROM lab)"""


@BOOK.query(
    "entity_stats_binary",
    f"""WITH {_label_sql("label_shop_user_churn")[0]}, {_LEVELS} SELECT split, timestamp, count(*) AS num_rows,
    count(DISTINCT customer_id) AS num_unique_entities, count(*) FILTER (churn = 1) AS num_positives,
    count(*) FILTER (churn = 0) AS num_negatives FROM lv GROUP BY ALL""",
)
def entity_stats_binary(spark, sf_dir):
    labels = LABELS.queries["label_shop_user_churn"](spark, sf_dir)
    return stats.entity_stats(labels, "customer_id", "churn", TaskKind.BINARY)


@BOOK.query(
    "entity_stats_regression",
    f"""WITH {_label_sql("label_meetups_user_attendance")[0]}, {_LEVELS} SELECT split, timestamp, count(*) AS num_rows,
    count(DISTINCT "user") AS num_unique_entities, min(target) AS min_target, max(target) AS max_target,
    round(avg(target), 6) AS mean_target, round(quantile_cont(target, 0.25), 6) AS quantile_25_target,
    round(median(target), 6) AS median_target, round(quantile_cont(target, 0.75), 6) AS quantile_75_target FROM lv GROUP BY ALL""",
)
def entity_stats_regression(spark, sf_dir):
    labels = LABELS.queries["label_meetups_user_attendance"](spark, sf_dir)
    out = stats.entity_stats(labels, "user", "target", TaskKind.REGRESSION)
    real = ["mean_target", "quantile_25_target", "median_target", "quantile_75_target"]
    return out.withColumns({c: F.round(c, 6) for c in real})


@BOOK.query(
    "multilabel_stats",
    f"""WITH {_ML}, lab AS (SELECT split, timestamp, y, y[1] + y[2] + y[3] AS n FROM ml), {_LEVELS},
    g AS (SELECT split, timestamp, round(avg(n), 4) AS mean_num_classes_per_entity, max(n)::BIGINT AS max_num_classes_per_entity,
      min(n)::BIGINT AS min_num_classes_per_entity FROM lv GROUP BY ALL),
    c AS (SELECT split, timestamp, k AS c, sum(y[k + 1])::BIGINT AS n FROM lv, (VALUES (0), (1), (2)) AS t(k) GROUP BY ALL),
    b AS (SELECT split, timestamp, arg_min(c, [-n, c]) AS max_num_class_idx, max(n) AS max_num_class_num,
      arg_min(c, [n, c]) AS min_num_class_idx, min(n) AS min_num_class_num FROM c GROUP BY ALL)
    SELECT g.*, b.* EXCLUDE (split, timestamp) FROM g JOIN b ON g.split = b.split AND g.timestamp IS NOT DISTINCT FROM b.timestamp""",
)
def multilabel_stats(spark, sf_dir):
    return stats.multilabel_stats(_multilabel(spark, sf_dir), "y")


@BOOK.query(
    "link_stats",
    f"""WITH {_label_sql("label_shop_user_item_purchase")[0]}, lt AS (SELECT *, split AS s, timestamp AS t FROM lab),
    lv AS (SELECT split, timestamp, customer_id, product_id, s, t FROM lt UNION ALL SELECT split, NULL, customer_id, product_id, s, t FROM lt
      UNION ALL SELECT 'total', NULL, customer_id, product_id, s, t FROM lt)
    SELECT split, timestamp, count(DISTINCT (s, t, customer_id)) AS num_rows, count(DISTINCT customer_id) AS num_unique_src_entities,
    count(DISTINCT product_id) AS num_unique_dst_entities, count(*) AS num_dst_entities FROM lv GROUP BY ALL""",
)
def link_stats(spark, sf_dir):
    return stats.link_stats(LABELS.queries["label_shop_user_item_purchase"](spark, sf_dir), "customer_id", "product_id")


@BOOK.query(
    "train_test_overlap",
    f"""WITH {_label_sql("label_shop_user_churn")[0]}, tr AS (SELECT DISTINCT customer_id FROM lab WHERE split = 'train'),
    te AS (SELECT DISTINCT customer_id FROM lab WHERE split = 'test')
    SELECT round((SELECT count(*) FROM te WHERE customer_id IN (SELECT customer_id FROM tr)) / (SELECT count(*) FROM te), 6)
    AS ratio_train_test_entity_overlap""",
)
def train_test_overlap(spark, sf_dir):
    return _rounded(stats.train_test_overlap(LABELS.queries["label_shop_user_churn"](spark, sf_dir), "customer_id"))


