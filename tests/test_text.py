"""Text vectors against numpy."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest

from chronograin.functions import text as text_functions

TEXTS = ["the cat sat on the mat", "The dog and the cat", None, "", "rare words appear once", "the the the", "ünïcode Wörter the"] + [
    f"topic{i % 3} word{i} the topic{i % 3}" for i in range(40)
]


def brute(texts, width):
    counts = [Counter(w.lower() for w in re.findall(text_functions.WORDS, t or "")) for t in texts]
    seen = Counter(w for c in counts for w in c)
    out = np.zeros((len(texts), width))
    for i, c in enumerate(counts):
        for w, n in c.items():
            h = hashlib.md5(w.encode()).hexdigest()
            out[i, int(h[:8], 16) % width] += (1 - 2 * (int(h[8], 16) % 2)) * n * (math.log((1 + len(texts)) / (1 + seen[w])) + 1)
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norms > 0, norms, 1)


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id bigint, t string")


@pytest.mark.parametrize("width", [1, 16])
def test_weighted_vectors(spark, width):
    got = {r.id: r.v for r in text_functions.weighted_embedding(frame(spark, TEXTS), "id", "t", "v", width).collect()}
    assert np.allclose([got[i] for i in range(len(TEXTS))], brute(TEXTS, width), atol=1e-9)
    assert text_functions.weighted_embedding(frame(spark, []), "id", "t", "v", width).count() == 0


def test_reduced_vectors_are_those_of_the_singular_value_decomposition(spark):
    vectors = text_functions.weighted_embedding(frame(spark, TEXTS), "id", "t", "v", 16)
    whole = brute(TEXTS, 16)
    u, s, vt = np.linalg.svd(whole, full_matrices=False)
    got = {r.id: r.v for r in text_functions.reduced_embedding(vectors.repartition(5), "v", 4).collect()}
    found = np.array([got[i] for i in range(len(TEXTS))])
    assert np.allclose(np.abs(found), np.abs(u[:, :4] * s[:4]), atol=1e-6)
    assert text_functions.reduced_embedding(vectors.limit(0), "v", 4).count() == 0


def test_texts_on_one_topic_lie_together(spark):
    vectors = text_functions.weighted_embedding(frame(spark, TEXTS), "id", "t", "v", 128)
    got = {r.id: r.v for r in text_functions.reduced_embedding(vectors, "v", 4).collect()}
    rows = np.array([got[i] for i in range(7, len(TEXTS))])
    near = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    same = near @ near.T
    topics = np.arange(7, len(TEXTS)) % 3
    alike = topics[:, None] == topics
    assert same[alike].mean() > same[~alike].mean() + 0.3


def test_counts_of_words_are_shuffled_once_by_term_and_once_by_text(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b c"), (2, "c d"), (3, None)], "id bigint, text string")
    found = text_functions.weighted_embedding(docs, "id", "text", "v", 16)
    plan = found._jdf.queryExecution().executedPlan().toString()
    # the third is that of the keys alone
    assert plan.count("Exchange hashpartitioning") <= 3
    # rows of one key are one text, in which "c" occurs twice
    whole = spark.createDataFrame([(1, "a b a"), (2, "b c c d"), (3, ""), (4, "")], "id bigint, text string")
    once = {r.id: r.v for r in text_functions.weighted_embedding(whole, "id", "text", "v", 16).collect()}
    for r in found.collect():
        assert r.v == pytest.approx(once[r.id])
