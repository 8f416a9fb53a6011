"""Frames and brute-force helpers for the tests of the operators."""

import re
import zlib

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# columns whose names clash with those that the operators add or use
EXTRA = {"fp": "1", "score": "'x'", "size": "2", "_row": "3", "start": "4", "label": "5", "shard": "6", "n_words": "7"}


def docs_of(spark, texts, sources=None, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    sources = [f"s{i % 3}" for i in range(len(texts))] if sources is None else sources
    rows = [(i, t, None, s, None if t is None else len(t)) for i, t, s in zip(ids, texts, sources, strict=True)]
    return spark.createDataFrame(rows, DOCS)


def with_extra(df):
    return df.selectExpr("*", *[f"{v} AS {k}" for k, v in EXTRA.items()])


def odd_docs(spark):
    """NULL in every column, empty and long texts, ties, repeated rows and ids."""
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    texts = ["one two three four", None, "", " \n\t", long, "one two three four", "one two three four", "zwölf Boxkämpfer ñandú", "x"]
    ids = [1, 2, 3, None, 5, 6, 6, None, 9]
    return docs_of(spark, texts, ["a", None, "b", "a", None, "b", "b", "é", "a"], ids)


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def fold(doc_id, n):
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % n


def auc(scored):
    """Area under the curve of (score, label) pairs; ties count half."""
    ranked = sorted(scored)
    ranks, i = {}, 0
    while i < len(ranked):
        j = i
        while j < len(ranked) and ranked[j][0] == ranked[i][0]:
            j += 1
        ranks[ranked[i][0]] = (i + 1 + j) / 2
        i = j
    ones = [s for s, y in scored if y == 1]
    zeros = len(scored) - len(ones)
    return (sum(ranks[s] for s in ones) - len(ones) * (len(ones) + 1) / 2) / (len(ones) * zeros)
