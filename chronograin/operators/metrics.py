"""Metrics as distributed aggregations over rows that hold truth and prediction.

Additive metrics are plain aggregate columns. Curve metrics count by score, then rank scores over
range partitions (``running_totals``), so they work for any number of distinct scores. Truth and
prediction meet by key (``attach``), never by row position.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronograin.operators.joins import with_constants
from chronograin.operators.running import running_totals
from chronograin.session import cut_lineage

# Thresholds for a positive label
ACCURACY_ABOVE = 0.5
F1_FROM = 0.5
MULTILABEL_ABOVE = 0.5
# keeps logarithms finite
LOSS_EPS = 1e-15


def attach(labels: DataFrame, pred: DataFrame, keys: Sequence[str], pred_col: str = "pred") -> DataFrame:
    """Labels with their predictions by key, as ``_p``; ``_wrong`` marks rows that do not match up.

    Every label row needs exactly one prediction, which is neither NULL nor NaN. The mark is checked in
    the same pass that computes the metrics, so labels and predictions are not counted beforehand.
    """
    keys = list(keys)
    given = pred.groupBy(*keys).agg(F.any_value(pred_col).alias("_p"), F.count(F.lit(1)).alias("_n"))
    both = labels.withColumn("_known", F.lit(True)).join(given, keys, "full")
    wrong = F.col("_known").isNull() | F.col("_n").isNull() | (F.col("_n") != 1) | _void(F.col("_p"), both.schema["_p"].dataType)
    return both.withColumn("_wrong", wrong).drop("_known", "_n")


def _void(p: Column, kind: T.DataType) -> Column:
    """Whether a prediction, or an entry of one, is no number."""
    if isinstance(kind, T.ArrayType):
        return p.isNull() | F.coalesce(F.exists(p, lambda x: _void(x, kind.elementType)), F.lit(False))
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return p.isNull() | F.isnan(p)
    return p.isNull()


# --- additive metrics: Column aggregates -----------------------------------------------------------


def _share(hit: Column) -> Column:
    return F.avg(hit.cast("double"))


def accuracy(y: Column, p: Column) -> Column:
    return _share((p > ACCURACY_ABOVE) == (y == 1))


def argmax(p: Column) -> Column:
    """Position of the largest entry, the first one on ties."""
    return F.array_position(p, F.array_max(p)) - 1


def multiclass_accuracy(y: Column, p: Column) -> Column:
    return _share(argmax(p) == y)


def sigmoid(p: Column) -> Column:
    return 1 / (1 + F.exp(-p))


def log_loss(y: Column, p: Column) -> Column:
    """Binary log loss of raw scores."""
    q = F.least(F.greatest(sigmoid(p), F.lit(LOSS_EPS)), F.lit(1 - LOSS_EPS))
    return -F.avg(y * F.log(q) + (1 - y) * F.log(1 - q))


def multiclass_log_loss(y: Column, p: Column) -> Column:
    """Log loss of raw class scores (softmax)."""
    top = F.array_max(p)
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    q = F.exp(F.get(p, y.cast("int")) - top) / total
    return -F.avg(F.log(F.least(F.greatest(q, F.lit(LOSS_EPS)), F.lit(1.0))))


def _counts(y: Column, hit: Column) -> tuple[Column, Column, Column]:
    true = y == 1
    return F.count_if(true & hit), F.count_if(~true & hit), F.count_if(true & ~hit)


def _zero_safe(top: Column, bottom: Column) -> Column:
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top / bottom)


def f1(y: Column, p: Column) -> Column:
    tp, fp, fn = _counts(y, p >= F1_FROM)
    return _zero_safe(2.0 * tp, 2 * tp + fp + fn)


def mae(y: Column, p: Column) -> Column:
    return F.avg(F.abs(y - p))


def mse(y: Column, p: Column) -> Column:
    return F.avg((y - p) * (y - p))


def rmse(y: Column, p: Column) -> Column:
    return F.sqrt(mse(y, p))


def r2(y: Column, p: Column) -> Column:
    """1 - residual / total variation; 1 (or 0) for constant truth hit exactly (or not)."""
    residual, total = F.sum((y - p) * (y - p)), F.var_pop(y) * F.count(y)
    return F.when(total > 0, 1 - residual / total).when(residual == 0, 1.0).otherwise(0.0)


ADDITIVE: dict[str, Callable[[Column, Column], Column]] = {
    "accuracy": accuracy,
    "multiclass_accuracy": multiclass_accuracy,
    "log_loss": log_loss,
    "multiclass_log_loss": multiclass_log_loss,
    "f1": f1,
    "mae": mae,
    "mse": mse,
    "rmse": rmse,
    "r2": r2,
}


# --- curve metrics --------------------------------------------------------------------------------


def curve_metrics(df: DataFrame, y: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys.., roc_auc, average_precision, auprc), one row per key.

    Scores are visited from high to low; equal scores form one step. NULL where undefined.
    """
    keys = list(keys)
    pos = F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).alias("_pos")
    neg = F.sum(F.when(F.col(y) == 1, 0).otherwise(1)).alias("_neg")
    steps = df.groupBy(*keys, (-F.col(score).cast("double")).alias("_s")).agg(pos, neg)
    ranked = running_totals(steps, keys, ["_s"], {"_tp": F.col("_pos"), "_fp": F.col("_neg")})
    tp, fp, p, n = (F.col(c).cast("double") for c in ("_tp", "_fp", "_pos", "_neg"))
    before = tp + fp - p - n
    precision = tp / (tp + fp)
    precision_before = F.when(before == 0, F.lit(1.0)).otherwise((tp - p) / F.nullif(before, F.lit(0.0)))
    positives, negatives = F.sum(p), F.sum(n)
    return ranked.groupBy(*keys).agg(
        F.try_divide(F.sum(n * (tp - p + p / 2)), positives * negatives).alias("roc_auc"),
        F.try_divide(F.sum(p * precision), positives).alias("average_precision"),
        F.try_divide(F.sum(p * (precision + precision_before) / 2), positives).alias("auprc"),
    )


CURVE = ("roc_auc", "average_precision", "auprc")


# --- multiclass and multilabel ----------------------------------------------------------------------


def class_f1(df: DataFrame, y: str, pred: str) -> DataFrame:
    """(macro_f1, micro_f1) of class scores: counts per class, then one row."""
    voted = df.select(F.col(y).cast("bigint").alias("_y"), argmax(F.col(pred)).alias("_p"))
    per_row = F.explode(
        F.when(F.col("_y") == F.col("_p"), F.array(F.struct(F.col("_y").alias("c"), F.lit("tp").alias("k")))).otherwise(
            F.array(
                F.struct(F.col("_y").alias("c"), F.lit("fn").alias("k")),
                F.struct(F.col("_p").alias("c"), F.lit("fp").alias("k")),
            )
        )
    )
    kinds = voted.select(per_row.alias("e")).groupBy(F.col("e.c").alias("c")).agg(
        *[F.count_if(F.col("e.k") == k).alias(k) for k in ("tp", "fp", "fn")]
    )
    return _f1_of_classes(kinds)


def _f1_of_classes(kinds: DataFrame) -> DataFrame:
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    return kinds.agg(
        F.avg(_zero_safe(2.0 * tp, 2 * tp + fp + fn)).alias("macro_f1"),
        _zero_safe(2.0 * F.sum(tp), 2 * F.sum(tp) + F.sum(fp) + F.sum(fn)).alias("micro_f1"),
    )


def multilabel_rows(df: DataFrame, y: str, pred: str) -> DataFrame:
    """(label, y, p): one row per label of each row."""
    pairs = F.arrays_zip(F.col(y).alias("y"), F.col(pred).alias("p"))
    return df.select(F.posexplode(pairs).alias("label", "_e")).select("label", "_e.y", "_e.p")


def multilabel_ranking(df: DataFrame, y: str, pred: str) -> DataFrame:
    """One row: average precision and area under ROC, over pooled labels and averaged over labels."""
    rows = multilabel_rows(df, y, pred)
    pooled = curve_metrics(rows, "y", "p").select(
        F.col("average_precision").alias("multilabel_auprc_micro"), F.col("roc_auc").alias("multilabel_auroc_micro")
    )
    per_label = curve_metrics(rows, "y", "p", ["label"]).agg(
        F.avg("average_precision").alias("multilabel_auprc_macro"), F.avg("roc_auc").alias("multilabel_auroc_macro")
    )
    return with_constants(pooled, per_label)


def multilabel_decisions(df: DataFrame, y: str, pred: str) -> DataFrame:
    """One row: f1, recall and precision, micro and macro."""
    rows = multilabel_rows(df, y, pred)
    hit = F.col("p") > MULTILABEL_ABOVE
    counted = dict(zip(("tp", "fp", "fn"), _counts(F.col("y"), hit), strict=True))
    per_label = rows.groupBy("label").agg(*[c.alias(n) for n, c in counted.items()])
    tp, fp, fn = (F.col(c) for c in counted)
    out = []
    for how, (t, p, n) in {"macro": (tp, fp, fn), "micro": (F.sum(tp), F.sum(fp), F.sum(fn))}.items():
        wrap = F.avg if how == "macro" else (lambda c: c)
        out += [
            wrap(_zero_safe(2.0 * t, 2 * t + p + n)).alias(f"multilabel_f1_{how}"),
            wrap(_zero_safe(1.0 * t, t + n)).alias(f"multilabel_recall_{how}"),
            wrap(_zero_safe(1.0 * t, t + p)).alias(f"multilabel_precision_{how}"),
        ]
    return per_label.agg(*out)


# --- link metrics -------------------------------------------------------------------------------------


def link_hits(truth: DataFrame, pred: DataFrame, keys: Sequence[str], dst: str, pred_col: str = "pred") -> DataFrame:
    """(keys.., dst_count, hits): hits are the 1-based places of right predictions, in order.

    Truth stays in pair form and meets predictions on (keys, dst), so a source with very many
    true links is spread over tasks; a row collects at most k places. Predicted repeats each count.
    """
    keys = list(keys)
    pairs = truth.select(*keys, dst).distinct()
    counts = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("dst_count"))
    places = pred.select(*keys, F.posexplode(pred_col).alias("_place", dst))
    found = places.join(pairs, [*keys, dst], "left_semi")
    hits = found.groupBy(*keys).agg(F.array_sort(F.collect_list(F.col("_place") + 1)).alias("hits"))
    none = F.array().cast("array<int>")
    rows = pred.select(*keys).join(counts, keys)
    return rows.join(hits, keys, "left").withColumn("hits", F.coalesce("hits", none))


def _link_aggregates(k: int) -> dict[str, Column]:
    """Aggregates over (hits, dst_count); rows without any true link have no part in them."""
    n_hits, n_true = F.size("hits"), F.nullif(F.col("dst_count"), F.lit(0))
    reached = F.least(n_true, F.lit(k))
    # the i-th hit at place h adds i / h
    gains = F.aggregate(
        F.sequence(F.lit(1), F.greatest(n_hits, F.lit(1))), F.lit(0.0),
        lambda a, i: a + F.when(n_hits >= i, i / F.get("hits", i - 1)).otherwise(0.0),
    )
    dcg = F.aggregate("hits", F.lit(0.0), lambda a, h: a + 1 / F.log2(h + 1))
    ideal = F.aggregate(F.sequence(F.lit(1), reached.cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    counted = n_true.isNotNull()
    return {
        "link_precision": F.avg(F.when(counted, n_hits / F.lit(k))),
        "link_recall": F.avg(n_hits / n_true),
        "link_map": F.avg(gains / reached),
        "link_ndcg": F.avg(dcg / ideal),
    }


def link_metrics(hits: DataFrame, k: int) -> DataFrame:
    """One row: precision, recall, MAP and NDCG at k, averaged over rows with any true link."""
    return hits.agg(*[c.alias(n) for n, c in _link_aggregates(k).items()])


# --- evaluation -----------------------------------------------------------------------------------------

Metric = str | Callable[[Column, Column], Column]


# metrics that need more than one aggregate over the rows, by the frame that holds them
FRAMES: dict[str, Callable[[DataFrame], DataFrame]] = {
    **dict.fromkeys(CURVE, lambda rows: curve_metrics(rows, "_y", "_p")),
    **dict.fromkeys(("macro_f1", "micro_f1"), lambda rows: class_f1(rows, "_y", "_p")),
    **dict.fromkeys(
        [f"multilabel_{m}_{h}" for m in ("auprc", "auroc") for h in ("micro", "macro")],
        lambda rows: multilabel_ranking(rows, "_y", "_p"),
    ),
    **dict.fromkeys(
        [f"multilabel_{m}_{h}" for m in ("f1", "recall", "precision") for h in ("micro", "macro")],
        lambda rows: multilabel_decisions(rows, "_y", "_p"),
    ),
}


def evaluate_entity(
    labels: DataFrame,
    pred: DataFrame,
    keys: Sequence[str],
    target: str,
    metrics: Sequence[Metric],
    pred_col: str = "pred",
) -> dict[str, float]:
    """Metrics by name; a metric may also be any function (truth, prediction) -> aggregate column.

    Numbers are scored as doubles, arrays (one flag and one score per label) as they are. Labels and predictions
    meet once; what several jobs read is kept in the shared folder.
    """
    plural = isinstance(labels.schema[target].dataType, T.ArrayType)
    truth = F.col(target) if plural else F.col(target).cast("double")
    rows = attach(labels, pred, keys, pred_col).select(truth.alias("_y"), "_p", "_wrong")
    chosen = {m if isinstance(m, str) else m.__name__: m for m in metrics}
    if unknown := {n for n, m in chosen.items() if isinstance(m, str) and n not in ADDITIVE and n not in FRAMES}:
        raise ValueError(f"unknown metrics {sorted(unknown)}")
    frames = {FRAMES[n] for n, m in chosen.items() if isinstance(m, str) and n in FRAMES}
    if frames:
        rows = cut_lineage(rows)
    y, p = F.col("_y"), F.col("_p")
    additive = {n: ADDITIVE[m] if isinstance(m, str) else m for n, m in chosen.items() if not isinstance(m, str) or n in ADDITIVE}
    wrong = F.count_if("_wrong").alias("_wrong")
    out = rows.agg(*[fn(y, p).alias(n) for n, fn in additive.items()], wrong).first().asDict()
    if out.pop("_wrong"):
        raise ValueError("every label row needs exactly one prediction with its key, and none may be left over")
    for frame in frames:
        out |= {n: v for n, v in frame(rows).first().asDict().items() if n in chosen and n not in additive}
    return {n: out[n] for n in chosen}


def evaluate_link(
    truth: DataFrame,
    pred: DataFrame,
    keys: Sequence[str],
    dst: str,
    k: int,
    metrics: Sequence[str | Callable[[Column, Column, int], Column]],
    pred_col: str = "pred",
) -> dict[str, float]:
    """Link metrics of lists of k predictions, one list per label row.

    A metric may also be any function (hits, dst_count, k) -> aggregate column, where hits are the 1-based places of
    the right predictions. The lists are checked in the pass that averages.
    """
    keys = list(keys)
    hits = link_hits(truth, pred, keys, dst, pred_col)
    # rows of either side that the other lacks, and lists of the wrong length or number
    asked = truth.select(*keys).distinct().withColumn("_asked", F.lit(True))
    bad = F.sum(F.when((F.size(pred_col) == k) & F.col(pred_col).isNotNull(), 0).otherwise(1))
    given = pred.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), bad.alias("_bad"))
    met = asked.join(given, keys, "full").join(hits, keys, "left")
    wrong = F.col("_asked").isNull() | F.col("_n").isNull() | (F.col("_n") != 1) | (F.col("_bad") != 0)
    own = {m.__name__: m for m in metrics if not isinstance(m, str)}
    named = _link_aggregates(k)
    row = met.agg(
        F.count_if(wrong).alias("_wrong"),
        *[named[m].alias(m) for m in metrics if isinstance(m, str)],
        *[fn(F.col("hits"), F.col("dst_count"), k).alias(n) for n, fn in own.items()],
    ).first().asDict()
    if row.pop("_wrong"):
        raise ValueError(f"expected lists of {k} predictions, one for each label row")
    return {m if isinstance(m, str) else m.__name__: row[m if isinstance(m, str) else m.__name__] for m in metrics}
