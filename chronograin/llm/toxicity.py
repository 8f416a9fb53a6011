"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word is the mean of the embeddings of its character n-grams and of itself, hashed into ``BUCKETS`` rows; a
window of ``WINDOW`` words is the mean of its words; a softmax over two classes is linear in it. Embeddings and
softmax are trained jointly in numpy, so an unseen misspelling shares the n-grams of what it is made from.

Labels are given for documents, a toxic passage may be one among many windows. Training starts with
every window under its document's label; then windows of toxic documents that look harmless are set
aside, but for the worst of each document, and training goes on. The raw score of a document is the
highest logit of its windows, all of them; a logistic curve, fitted on sampled documents that did not train the
embeddings and weighted to the true shares of the classes, turns it into a probability.

The fit takes about ``TOXIC_ROWS`` toxic documents at most and ``CLEAN_SHARE`` times as many clean ones, chosen by a
hash of the id, and ``TRAIN_WINDOWS`` evenly spread windows of each at most. Scoring covers every window of every document;
there, a word is a single number, as everything behind the embeddings is linear.

Defined results: NULL and empty texts have no window and score as the lowest raw score does (0 where no model
could be fitted for lack of one class, 0.5 without labels); a document without id is not held out and never
trains; a repeated label counts by the rounded mean of its rows, NULL labels do not count; an empty
table gives an empty result; other columns are ignored, or carried where ``keep`` names them.
"""

from __future__ import annotations

from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronograin.llm.common import held_out, per_batch, raw_texts, settle, space_words, stored
from chronograin.llm.quality import training_labels

FOLDS = 5
# toxic documents that the fit may read, and clean ones for each of them
TOXIC_ROWS = 1200
CLEAN_SHARE = 3
WINDOW = 5
TRAIN_WINDOWS = 160
BUCKETS = 1 << 18
DIM = 8
GRAMS = (3, 4, 5)
EPOCHS = (3, 3)
# minibatches that either round of epochs has at least, however few the windows
STEPS = 500
RATE = 0.3
BATCH = 512
# a window of a toxic document below this probability is set aside after the first epochs
HARMLESS = 0.9
SEED = 3
# words that a worker remembers
MEMO = 400_000
LOWEST = -30.0

_STRIP = b"".join(bytes([b]) for b in range(33, 127) if not chr(b).isalnum())


def grams(word: bytes) -> list[int]:
    """Buckets of the word and of its n-grams, with marks for its ends."""
    marked = b"<" + (word.strip(_STRIP) or word) + b">"
    found = [crc32(marked) % BUCKETS]
    for n in GRAMS:
        found += [crc32(marked[i : i + n]) % BUCKETS for i in range(len(marked) - n + 1)]
    return found


@dataclass(frozen=True)
class Model:
    # what each bucket adds to the logit of the toxic class
    buckets: np.ndarray
    bias: float
    # of the logistic curve
    slope: float
    shift: float


class _Words(dict):
    """Logit of each word, computed when first met."""

    def __init__(self, buckets: np.ndarray) -> None:
        self.buckets = buckets.tolist()

    def __missing__(self, word: bytes) -> float:
        ids = grams(word)
        values = self.buckets
        self[word] = value = sum([values[i] for i in ids]) / len(ids)
        return value


def raw_score(text: bytes | None, words: _Words, bias: float) -> float:
    """The highest logit of any window of the text."""
    pieces = space_words(text)
    if not pieces:
        return LOWEST
    total = np.cumsum(np.fromiter(map(words.__getitem__, pieces), dtype=float, count=len(pieces)))
    n = min(WINDOW, len(pieces))
    sums = total[n - 1 :].copy()
    sums[1:] -= total[:-n]
    return max(LOWEST, float(sums.max()) / n + bias)


def windows(text: bytes | None, most: int = TRAIN_WINDOWS) -> list[list[bytes]]:
    """Disjoint windows of the text, ``most`` of them, evenly spread, if there are more."""
    pieces = space_words(text)
    found = [pieces[i : i + WINDOW] for i in range(0, len(pieces), WINDOW)]
    if len(found) <= most:
        return found
    return [found[int(i)] for i in np.linspace(0, len(found) - 1, most)]


class _Trainer:
    """Embeddings and softmax over given windows, by Adagrad on minibatches."""

    def __init__(self, bags: list[list[bytes]]) -> None:
        vocabulary: dict[bytes, int] = {}
        self.sizes = np.array([len(b) for b in bags])
        self.words = np.array([vocabulary.setdefault(w, len(vocabulary)) for b in bags for w in b])
        self.starts = np.r_[0, np.cumsum(self.sizes)]
        made = [grams(w) for w in vocabulary]
        self.counts = np.array([len(m) for m in made])
        self.grams = np.array([g for m in made for g in m])
        self.firsts = np.r_[0, np.cumsum(self.counts)]
        rng = np.random.default_rng(SEED)
        self.rng = rng
        self.table = rng.normal(scale=0.1, size=(BUCKETS, DIM)).astype(np.float32)
        self.out = rng.normal(scale=0.1, size=(DIM, 2)).astype(np.float32)
        self.bias = np.zeros(2, dtype=np.float32)
        self.squares = [np.full(BUCKETS, 1e-6, np.float32), np.full((DIM, 2), 1e-6, np.float32), np.full(2, 1e-6, np.float32)]

    @staticmethod
    def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """All positions of the given runs, one run after the other."""
        return np.repeat(starts - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())

    def _bags(self, rows: np.ndarray) -> tuple[np.ndarray, ...]:
        sizes = self.sizes[rows]
        words, back = np.unique(self.words[self._ranges(self.starts[rows], sizes)], return_inverse=True)
        counts = self.counts[words]
        ids = self.grams[self._ranges(self.firsts[words], counts)]
        vectors = np.add.reduceat(self.table[ids], np.r_[0, np.cumsum(counts)[:-1]], axis=0) / counts[:, None]
        bags = np.add.reduceat(vectors[back], np.r_[0, np.cumsum(sizes)[:-1]], axis=0) / sizes[:, None]
        return bags, sizes, back, counts, ids, words

    def _softmax(self, bags: np.ndarray) -> np.ndarray:
        logits = bags @ self.out + self.bias
        e = np.exp(logits - logits.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def probabilities(self) -> np.ndarray:
        parts = [self._softmax(self._bags(r)[0])[:, 1] for r in np.array_split(np.arange(len(self.sizes)), len(self.sizes) // 4096 + 1)]
        return np.concatenate(parts)

    def epoch(self, rows: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> None:
        rows = self.rng.permutation(rows)
        for at in range(0, len(rows), BATCH):
            some = rows[at : at + BATCH]
            bags, sizes, back, counts, ids, words = self._bags(some)
            error = self._softmax(bags)
            error[np.arange(len(some)), labels[some]] -= 1
            error *= weights[some, None] / len(some)
            to_bags = error @ self.out.T / sizes[:, None]
            spread = np.repeat(to_bags, sizes, axis=0)
            to_words = np.stack([np.bincount(back, spread[:, d], len(words)) for d in range(DIM)], axis=1) / counts[:, None]
            order = np.argsort(ids, kind="stable")
            touched, first = np.unique(ids[order], return_index=True)
            step = np.add.reduceat(np.repeat(to_words, counts, axis=0)[order], first, axis=0)
            self._move(self.out, bags.T @ error, 1)
            self._move(self.bias, error.sum(0), 2)
            self.squares[0][touched] += (step**2).mean(1)
            self.table[touched] -= (RATE * step / np.sqrt(self.squares[0][touched])[:, None]).astype(np.float32)

    def _move(self, values: np.ndarray, step: np.ndarray, which: int) -> None:
        self.squares[which] += step**2
        values -= 0.1 * RATE * step / np.sqrt(self.squares[which])


def train(texts: list[bytes], labels: list[int]) -> tuple[np.ndarray, float]:
    """Logit of every bucket and of the bias, from texts with document labels."""
    bags, owner = [], []
    for i, text in enumerate(texts):
        some = windows(text)
        bags += some
        owner += [i] * len(some)
    if not bags:
        return np.zeros(BUCKETS, np.float32), 0.0
    trainer, owners = _Trainer(bags), np.array(owner)
    of = np.array(labels)[owners]
    rows, weights = np.arange(len(bags)), np.ones(len(bags))
    for epochs in EPOCHS:
        share = max(1e-9, float(of[rows].mean()))
        weights[of == 1] = min(20.0, 0.5 / share)
        weights[of == 0] = 0.5 / max(1e-9, 1 - share)
        for _ in range(max(epochs, -(-STEPS * BATCH // len(rows)))):
            trainer.epoch(rows, of, weights)
        found = trainer.probabilities()
        worst = np.zeros(len(texts))
        np.maximum.at(worst, owners, found)
        rows = np.flatnonzero((of == 0) | (found >= HARMLESS) | (found == worst[owners]))
    toxic = (trainer.out[:, 1] - trainer.out[:, 0]).astype(np.float32)
    return trainer.table @ toxic, float(trainer.bias[1] - trainer.bias[0])


def logistic(raw: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a weighted logistic curve, lightly regularized, by damped Newton steps on standardized scores."""
    middle, width = float(raw.mean()), float(raw.std()) or 1.0
    x = np.c_[(raw - middle) / width, np.ones(len(raw))]
    beta = np.array([1.0, 0.0])

    def loss(b: np.ndarray) -> float:
        z = x @ b
        return float((weights * (np.logaddexp(0, z) - labels * z)).sum() + 5e-3 * b @ b)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        down = x.T @ (weights * (p - labels)) + 1e-2 * beta
        curve = (x * (weights * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        step, now = np.linalg.solve(curve, down), loss(beta)
        while loss(beta - step) > now and np.abs(step).max() > 1e-9:
            step = step / 2
        beta = beta - step
        if np.abs(step).max() < 1e-7:
            break
    slope = max(float(beta[0]), 1e-3) / width
    return slope, float(beta[1]) - slope * middle


def fit(docs: DataFrame, labels: DataFrame, column: str = "toxic", toxic_rows: int = TOXIC_ROWS) -> Model:
    """Train on the labelled documents outside the held-out fold."""
    known = stored(training_labels(labels, column, FOLDS, 1 << 62), "toxicity-labels")
    n = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(n) < 2:
        # no model without both classes, but a constant
        return Model(np.zeros(BUCKETS, np.float32), 0.0, 0.0, 60.0 if 1 in n else -60.0 if 0 in n else 0.0)
    clean_rows = CLEAN_SHARE * min(toxic_rows, n[1])
    share = F.when(F.col("label") == 1, F.lit(0.97 * toxic_rows / n[1])).otherwise(F.lit(0.97 * clean_rows / n[0]))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20))
    # at most ``toxic_rows`` ids of one class and ``CLEAN_SHARE`` times as many of the other
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def cut(batch: pa.RecordBatch) -> dict[str, list]:
        return {"pieces": [b"\n".join(b" ".join(w) for w in windows(t)) for t in raw_texts(batch)]}

    pieces = T.StructType([T.StructField("pieces", T.BinaryType())])
    calibrates = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(5)) == 0
    sample = stored(sample.where(F.col("text").isNotNull()), "toxicity")
    rows = per_batch(sample.where(~calibrates), cut, pieces, ["doc_id", "label"]).orderBy("doc_id").collect()
    values, bias = train([bytes(r["pieces"]) for r in rows], [r["label"] for r in rows])
    draft = Model(values, bias, 1.0, 0.0)
    seen = raw_scores(sample.where(calibrates), draft, ["label"]).collect()
    raw = np.array([r["raw"] for r in seen])
    label = np.array([r["label"] for r in seen])
    if not 0 < label.sum() < len(label):
        return draft
    weights = np.where(label == 1, n[1] / label.sum(), n[0] / (len(label) - label.sum()))
    return Model(values, bias, *logistic(raw, label, weights * len(label) / weights.sum()))


def raw_scores(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep`` columns and the raw score of every row."""
    shared = settle(docs.sparkSession).sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        words = _words(shared)
        found = [raw_score(t, words, shared.value.bias) for t in raw_texts(batch)]
        if len(words) > MEMO:
            words.clear()
        return {"raw": found}

    wanted = docs.select(*dict.fromkeys([*keep, "text"]))
    return per_batch(wanted, run, T.StructType([T.StructField("raw", T.DoubleType())]), keep)


_remembered: tuple[Model | None, _Words | None] = (None, None)


def _words(shared) -> _Words:
    """The words that this worker knows already, of the model at hand."""
    global _remembered
    if _remembered[0] is not shared.value:
        _remembered = (shared.value, _Words(shared.value.buckets))
    return _remembered[1]


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (doc_id by default) of every row with score, the probability of label 1."""
    keep = ["doc_id"] if keep is None else keep
    line = F.lit(model.slope) * F.greatest(F.col("raw"), F.lit(LOWEST)) + F.lit(model.shift)
    curve = 1 / (1 + F.exp(-F.greatest(F.least(line, F.lit(30.0)), F.lit(-30.0))))
    return raw_scores(docs, model, keep).select(*keep, curve.alias("score"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    scored = score(docs, fit(docs, labels))
    return scored.select(
        "doc_id", held_out("doc_id", FOLDS, 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
