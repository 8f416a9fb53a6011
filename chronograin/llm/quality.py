"""Quality classifier: document statistics, random Fourier features, ridge regression, isotonic calibration.

The statistics of a text (lengths, shares of character classes, repeated words and lines, ..) are
standardized and mapped to ``FEATURES`` random cosines, which approximate a Gaussian kernel. Ridge
scores come from the normal equations, summed over partitions; a fifth of the training rows calibrates them,
by pool-adjacent-violators over score bins, to the probability of label 1.

The fit takes about ``TRAIN_ROWS`` labelled rows at most, chosen by a hash of the id; every document is scored,
whole. Only the text is an input of the score.

Defined results: NULL and empty texts share one score; a document without id is not held out and
never trains; a repeated label counts by the rounded mean of its rows, NULL labels do not count; without
labels every score is 0.5, with one class it is that class; an empty table gives an empty result;
other columns are ignored, or carried where ``keep`` names them.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronograin.llm.common import held_out, per_batch, raw_texts, remainder, settle, space_words, stored

FOLDS = 5
# labelled rows that the fit may read
TRAIN_ROWS = 50_000
FEATURES = 256
RIDGE = 1e-3
SEED = 10
# partitions whose normal equations are summed
PARTS = 8
BINS = 512
REJECT_BELOW = 0.3

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGITS = bytes(range(48, 58))
_SPACE = bytes([32, *range(9, 14)])
_STOPS = b".,;:'\"-()"
_CRIES = b"!?"
_TABLES = b"|\\/_<>[]{}=+"
_SIGNS = b"#$%&*@^~`"
_HIGH = bytes(range(128, 256))


def statistics(text: bytes | None) -> list[float]:
    """Numbers that describe a text; all zero for an empty one, but for its emptiness."""
    text = text or b""
    words = space_words(text)
    n, k = max(1, len(text)), max(1, len(words))
    lines = [line for line in text.split(b"\n") if line.strip()]
    counts = Counter(words)
    classes = [
        (n - len(text.translate(None, c))) / n if text else 0.0
        for c in (_UPPER, _LOWER, _DIGITS, _SPACE, _STOPS, _CRIES, _TABLES, _SIGNS, _HIGH)
    ]
    top = max(counts.values(), default=0)
    caps = sum(map(bytes.isupper, text.split()))
    return [
        1.0 if not words else 0.0,
        math.log1p(len(text)),
        math.log1p(len(words)),
        *[math.sqrt(c) for c in classes],
        math.log1p(len(text) / k),
        len(counts) / k,
        math.log(max(1, len(counts))) / math.log(k) if k > 1 else 1.0,
        math.sqrt(top / k),
        math.sqrt(sum(map(eq, words, words[1:])) / k),
        caps / k,
        len(set(lines)) / max(1, len(lines)),
        math.log1p(len(words) / max(1, len(lines))),
    ]


N_STATISTICS = len(statistics(None))


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    phase: np.ndarray
    beta: np.ndarray
    # isotonic curve: ridge scores and the probabilities there
    at: np.ndarray
    value: np.ndarray

    def cosines(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale @ self.weights + self.phase
        return np.c_[np.cos(z) * math.sqrt(2 / len(self.phase)), np.ones(len(x))]

    def ridge(self, x: np.ndarray) -> np.ndarray:
        return self.cosines(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probability; a thousandth of it keeps the order of raw scores on flat pieces."""
        raw = self.ridge(x)
        return 0.999 * np.interp(raw, self.at, self.value) + 0.001 / (1 + np.exp(-np.clip(raw, -30, 30)))


def pool_adjacent(at: np.ndarray, ones: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The isotonic regression of ones / rows along ``at`` (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for x, y, n in zip(at.tolist(), ones.tolist(), rows.tolist(), strict=True):
        blocks.append([x * n, y, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def training_labels(labels: DataFrame, column: str, folds: int, max_rows: int) -> DataFrame:
    """(doc_id, label): one row an id outside the held-out fold, about ``max_rows`` at most, by hash."""
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & (remainder("doc_id", folds) != 0))
        .groupBy("doc_id")
        .agg(F.round(F.avg(column)).cast("int").alias("label"))
    )
    n = known.count()
    share = min(1.0, 0.97 * max_rows / max(1, n))
    return known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(math.ceil(share * (1 << 20))))


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality", max_rows: int = TRAIN_ROWS) -> Model:
    """Train on the labelled documents outside the held-out fold."""
    chosen = training_labels(labels, column, FOLDS, max_rows)
    # at most ``max_rows`` ids and labels of 12 bytes
    some = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def measure(batch: pa.RecordBatch) -> dict[str, list]:
        return {"x": [statistics(t) for t in raw_texts(batch)]}

    rows = stored(
        per_batch(some, measure, T.StructType([T.StructField("x", T.ArrayType(T.DoubleType()))]), ["doc_id", "label"])
        .repartition(PARTS, "doc_id"),
        "quality",
    )
    x = [F.col("x")[i] for i in range(N_STATISTICS)]
    seen = rows.agg(
        F.count(F.lit(1)), F.avg("label"),
        *[F.coalesce(F.avg(c), F.lit(0.0)) for c in x], *[F.coalesce(F.stddev_pop(c), F.lit(0.0)) for c in x],
    ).first()
    n, prior = seen[0], seen[1]
    mean, scale = np.array(seen[2 : 2 + N_STATISTICS]), np.array(seen[2 + N_STATISTICS :])
    rng = np.random.default_rng(SEED)
    # Gaussian kernel whose width is the typical distance of two standardized rows
    weights = rng.normal(size=(N_STATISTICS, FEATURES)) / math.sqrt(N_STATISTICS)
    phase = rng.uniform(0, 2 * math.pi, FEATURES)
    scale = np.where(scale > 1e-9, scale, 1.0)
    flat = 0.5 if prior is None else float(prior)
    model = Model(mean, scale, weights, phase, np.zeros(FEATURES + 1), np.array([0.0]), np.array([flat]))
    if not n or prior in (0.0, 1.0):
        return model

    calibrates = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(5)) == 0
    d = FEATURES + 1

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, right = np.zeros((d, d)), np.zeros(d)
        for batch in batches:
            z = model.cosines(np.array(batch.column(0).to_pylist(), dtype=float).reshape(-1, N_STATISTICS))
            gram += z.T @ z
            right += z.T @ batch.column(1).to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([pa.array([gram.tobytes()]), pa.array([right.tobytes()])], ["gram", "right"])

    parts = rows.where(~calibrates).select("x", "label").mapInArrow(equations, "gram binary, right binary").collect()
    gram = sum(np.frombuffer(p["gram"]).reshape(d, d) for p in parts)
    right = sum(np.frombuffer(p["right"]) for p in parts)
    beta = np.linalg.solve(gram + RIDGE * max(1.0, gram[-1, -1]) * np.eye(d) / d, right)
    fitted = Model(mean, scale, weights, phase, beta, model.at, model.value)

    def ridge(batch: pa.RecordBatch) -> dict[str, list]:
        x = np.array(batch.column(0).to_pylist(), dtype=float).reshape(-1, N_STATISTICS)
        return {"bin": np.rint(np.clip(fitted.ridge(x), -1, 2) * BINS).astype(int).tolist()}

    bins = (
        per_batch(rows.where(calibrates).select("x", "label"), ridge, T.StructType([T.StructField("bin", T.IntegerType())]), ["label"])
        .groupBy("bin").agg(F.sum("label").alias("ones"), F.count(F.lit(1)).alias("rows")).orderBy("bin").collect()
    )
    if not bins:
        return Model(mean, scale, weights, phase, beta, np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    at, value = pool_adjacent(*(np.array([b[c] for b in bins], dtype=float) for c in ("bin", "ones", "rows")))
    return Model(mean, scale, weights, phase, beta, at / BINS, value)


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (doc_id by default) of every row with score, the probability of label 1."""
    keep = ["doc_id"] if keep is None else keep
    shared = settle(docs.sparkSession).sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        x = np.array([statistics(t) for t in raw_texts(batch)], dtype=float).reshape(-1, N_STATISTICS)
        return {"score": shared.value.score(x).tolist()}

    wanted = docs.select(*dict.fromkeys([*keep, "text"]))
    return per_batch(wanted, run, T.StructType([T.StructField("score", T.DoubleType())]), keep)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    scored = score(docs, fit(docs, labels))
    return scored.select(
        "doc_id", held_out("doc_id", FOLDS, 0).alias("held_out"), "score",
        (F.col("score") >= REJECT_BELOW).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier does not reject, whole."""
    tagged = docs.select(F.struct(*docs.columns).alias("_row"), "text")
    scored = score(tagged, fit(docs, labels), ["_row"])
    return scored.where(F.col("score") >= REJECT_BELOW).select("_row.*")
