"""The mix word by word, small sources, and near-duplicate removal that keeps columns of any name."""

import random

import numpy as np
import pytest
from helpers import docs_of, odd_docs, with_extra
from pyspark.sql import functions as F

from chronograin.llm import mixing, simhash_dedup


def naive_seats(votes, seats, caps):
    given = [0] * len(votes)
    for _ in range(min(seats, sum(c for c, v in zip(caps, votes, strict=True) if v > 0))):
        best = max((i for i in range(len(votes)) if given[i] < caps[i] and votes[i] > 0), key=lambda i: (votes[i] / (2 * given[i] + 1), -i))
        given[best] += 1
    return given


def brute_taken(rows, shard_rows):
    """Words taken of (doc_id, source, size, order) rows, one word at a time."""
    names = sorted({r[1] for r in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(r[2] for r in rows if r[1] == s) for s in names]
    wanted = mixing.targets(sizes, [(3, 1, 2)[i % 3] for i in range(len(names))])
    words = naive_seats(wanted, round(sum(wanted)), [2 * n for n in sizes])
    taken = []
    for i, name in enumerate(names):
        own = [r for r in rows if r[1] == name]
        shards = -(-len(own) // shard_rows)
        parts = [sorted((r for r in own if r[3] % shards == s), key=lambda r: (r[3], r[0], r[2])) for s in range(shards)]
        held = [(s, p) for s, p in enumerate(parts) if p]
        block = max(1, min(100, sizes[i] // 50))
        lengths = [sum(r[2] for r in p) for _, p in held]
        blocks = [max(1, round(n / block)) if n else 0 for n in lengths]
        quotas = naive_seats(lengths, round(words[i] / block), [2 * b for b in blocks])
        for (shard, part), n, b, quota in zip(held, lengths, blocks, quotas, strict=True):
            times = []
            extra = set(np.random.default_rng([mixing.SEED, i, shard]).permutation(b)[: quota % b].tolist()) if b else set()
            for k in range(b):
                times += [quota // b + (k in extra)] * ((k + 1) * n // b - k * n // b)
            at = 0
            for r in part:
                taken.append((r[0], name, sum(times[at : at + r[2]])))
                at += r[2]
    return taken


@pytest.mark.parametrize("seed", range(3))
def test_taken_words_one_by_one(spark, seed):
    rng = random.Random(seed)
    texts = [" ".join(["w"] * rng.choice([0, 1, 5, 40, 200])) or None for _ in range(90)]
    sources = [rng.choice(["a", "b", "b", "b", "é", None]) for _ in texts]
    docs = docs_of(spark, texts, sources)
    sized = [(r.doc_id, r.source, r["_size"], r["_order"]) for r in mixing._sized(docs).collect()]
    got = [(r.doc_id, r.source, r.taken) for r in mixing.mix_sizes(docs, shard_rows=20).collect()]
    assert sorted(got, key=str) == sorted(brute_taken(sized, 20), key=str)


def test_small_sources_meet_their_targets(spark):
    texts = ["word " * 30] * 60 + ["big " * 4000] * 3
    docs = docs_of(spark, texts, [f"s{i:02}" for i in range(60)] + ["z"] * 3)
    rows = mixing.mix_sizes(docs).collect()
    for name in {r.source for r in rows}:
        part = [r for r in rows if r.source == name]
        assert abs(sum(r.taken for r in part) - part[0].target) <= max(1, 0.02 * part[0].target), name
    assert mixing.mix_sizes(docs_of(spark, ["one", "two words"], ["a", "b"])).agg(F.sum("taken")).first()[0] in (4, 5)


def test_columns_of_any_name_are_kept(spark):
    docs = with_extra(odd_docs(spark)).withColumns(
        {"_id": F.lit("mine"), "root": F.lit(1), "_doc": F.lit("d"), "component_id": F.lit(2), "m": F.create_map(F.lit("k"), F.col("source"))}
    )
    left = simhash_dedup.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    rows = left.collect()
    assert sorted(str(r["doc_id"]) for r in rows) == ["1", "2", "5", "9", "None"]
    assert {(r["_row"], r["fp"], r["_id"], r["root"], r["_doc"], r["component_id"]) for r in rows} == {(3, 1, "mine", 1, "d", 2)}
