"""Gradient boosted trees on joined features (``pyspark.ml``), tuned on the validation split."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronograin.functions.text import hash_embedding
from chronograin.model import TaskKind
from chronograin.operators import metrics
from chronograin.operators.columns import CATEGORICAL, MULTI, TEXT, TIME
from chronograin.session import cut_lineage

CATEGORY_BUCKETS = 32
TEXT_WIDTH = 8
# rounds of boosting, as many as boosting libraries take unless told otherwise; the validation split says how many trees stay
ROUNDS = 100


def assemble(df: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """Add ``features``: numbers as they are, times in seconds, categories and texts by hash.

    A missing value becomes 0 and sets a flag, so no statistics have to be collected first.
    """
    parts: list[Column] = []
    for col, kind in kinds.items():
        value: Column
        if kind == TEXT:
            df = hash_embedding(df, col, f"_e_{col}", TEXT_WIDTH)
            parts += [F.col(f"_e_{col}")[i] for i in range(TEXT_WIDTH)]
            continue
        if kind == TIME:
            value = F.unix_seconds(F.col(col).cast("timestamp")).cast("double")
        elif kind == MULTI:
            value = F.size(col).cast("double")
        elif kind == CATEGORICAL and isinstance(df.schema[col].dataType, T.StringType):
            value = F.pmod(F.xxhash64(col), F.lit(CATEGORY_BUCKETS)).cast("double")
        else:
            value = F.col(col).cast("double")
        parts += [F.coalesce(value, F.lit(0.0)), F.col(col).isNull().cast("double")]
    names = [f"_f{i}" for i in range(len(parts))]
    wide = df.withColumns(dict(zip(names, parts, strict=True)))
    assembled = VectorAssembler(inputCols=names, outputCol="features").transform(wide)
    return assembled.drop(*names, *[c for c in df.columns if c.startswith("_e_")])


@dataclass(frozen=True)
class Boosted:
    """Trees of a task: one model, or one for each class (each against the rest) or label."""

    kind: TaskKind
    models: Sequence[Model]


def _targets(train: DataFrame, target: str, kind: TaskKind) -> list[Column]:
    """What each model learns: the target itself, or whether a row is of each class, or has each label."""
    y = F.col(target)
    if kind in (TaskKind.BINARY, TaskKind.REGRESSION):
        return [y.cast("double")]
    if kind is TaskKind.MULTICLASS:
        most = train.agg(F.max(target)).first()[0]
        return [(y == c).cast("double") for c in range(0 if most is None else int(most) + 1)]
    if kind is TaskKind.MULTILABEL:
        width = train.agg(F.max(F.size(target))).first()[0] or 0
        return [F.get(y, F.lit(i)).cast("double") for i in range(width)]
    raise ValueError(f"no boosted trees for {kind.value}: rank scores of pairs instead")


def _predict(model: Boosted, df: DataFrame) -> DataFrame:
    """``pred``: a number, or an array of probabilities, those of classes adding up to 1."""
    if model.kind is TaskKind.REGRESSION:
        return model.models[0].transform(df).withColumnRenamed("prediction", "pred")
    names = [f"_p{i}" for i in range(len(model.models))]
    for name, one in zip(names, model.models, strict=True):
        scored = one.transform(df).withColumn(name, vector_to_array("probability")[1])
        df = scored.drop("rawPrediction", "probability", "prediction")
    if model.kind is TaskKind.BINARY:
        return df.withColumnRenamed(names[0], "pred")
    share = sum((F.col(n) for n in names), F.lit(0.0)) if model.kind is TaskKind.MULTICLASS else F.lit(1.0)
    return df.withColumn("pred", F.array(*[F.col(n) / share for n in names])).drop(*names)


def _goodness(scored: DataFrame, target: str, kind: TaskKind) -> float:
    """ROC AUC (binary), or how small the error or the logarithmic loss is."""
    y, p = F.col(target), F.col("pred")

    def surprise(chance: Column) -> Column:
        return -F.log(F.greatest(F.coalesce(chance, F.lit(0.0)), F.lit(1e-15)))

    if kind is TaskKind.BINARY:
        return metrics.curve_metrics(scored, target, "pred").first()["roc_auc"]
    if kind is TaskKind.REGRESSION:
        loss = metrics.mae(y.cast("double"), p)
    elif kind is TaskKind.MULTICLASS:
        loss = F.avg(surprise(F.get(p, y.cast("int"))))
    else:
        each = F.zip_with(y, p, lambda hit, chance: surprise(F.when(hit.cast("double") > 0, chance).otherwise(1 - chance)))
        loss = F.avg(F.aggregate(each, F.lit(0.0), lambda total, one: total + one))
    return -(scored.agg(loss).first()[0] or 0.0)


def _fit(trainer: GBTClassifier | GBTRegressor, train: DataFrame, val: DataFrame) -> Model:
    """All rounds on ``train``, then as many trees as do best on ``val``; all of them where it has no rows."""
    label = F.col(trainer.getLabelCol())
    train, val = train.where(label.isNotNull()), val.where(label.isNotNull())
    model = trainer.fit(train)
    if val.isEmpty():
        return model
    losses = model.evaluateEachIteration(val, *(["squared"] if isinstance(trainer, GBTRegressor) else []))
    kept = 1 + min(range(len(losses)), key=losses.__getitem__)
    # seeds go by round, so the first trees come out again
    return model if kept == len(losses) else trainer.setMaxIter(kept).fit(train)


def fit_boosted(
    train: DataFrame,
    val: DataFrame,
    target: str,
    kinds: Mapping[str, str],
    kind: TaskKind,
    depths: Sequence[int] = (3, 5),
    rounds: int = ROUNDS,
    seed: int = 42,
) -> tuple[Boosted, dict[int, float]]:
    """The best model on ``val`` and the scores of all depths: ROC AUC (binary), else losses with a minus.

    Each model goes through all ``rounds`` and keeps as many of its first trees as do best on ``val``.
    Classes are numbers from 0, labels arrays of 0 and 1. Tasks over pairs are an error.
    """
    targets = _targets(train, target, kind)
    if not targets:
        raise ValueError(f"no value of {target} to learn from")
    labels = [f"_y{i}" for i in range(len(targets))]
    # every fit passes over its rows several times, so what leads to them runs once
    learned = [t.alias(n) for t, n in zip(targets, labels, strict=True)]
    fit_on = cut_lineage(assemble(train, kinds).select("features", *learned))
    tune_on = cut_lineage(assemble(val, kinds).select(F.col(target), "features", *learned))
    trainer = GBTRegressor if kind is TaskKind.REGRESSION else GBTClassifier
    best, scores = None, {}
    for depth in depths:
        models = [_fit(trainer(labelCol=n, maxDepth=depth, maxIter=rounds, seed=seed), fit_on, tune_on) for n in labels]
        model = Boosted(kind, models)
        scores[depth] = _goodness(_predict(model, tune_on.drop(*labels)), target, kind)
        if best is None or scores[depth] > max(v for d, v in scores.items() if d != depth):
            best = model
    return best, scores


def predict(model: Boosted, df: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    return _predict(model, assemble(df, kinds)).drop("features")
