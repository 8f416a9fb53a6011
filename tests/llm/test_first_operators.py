"""Decontamination, mixing, token files, SimHash near-dedup, quality classifier, pipeline."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from helpers import alnum, auc, docs_of, empty_docs, fold, odd_docs, spaced, with_extra

import corpus_pipeline
from chronograin.llm import decontaminate, mixing, quality, simhash_dedup, token_files
from chronograin.llm.queries import QUERIES


def brute_contamination(text, items, window=10):
    words = alnum(text)
    hit, found = set(), set()
    for item, item_text in items:
        its = alnum(item_text)
        size = min(window, len(its))
        for s in range(len(its) - size + 1) if its else ():
            for at in range(len(words) - size + 1):
                if words[at : at + size] == its[s : s + size]:
                    hit |= set(range(at, at + size))
                    found.add("" if item is None else str(item))
    digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(words), len(hit), len(found), digest, bool(hit)


@pytest.mark.parametrize("batch_bytes", [1 << 20, 40])
def test_contamination_is_brute_force(spark, batch_bytes):
    rng = random.Random(1)
    vocabulary = ["a", "b", "C", "ñ", "0"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 16)))) for i in range(12)]
    items += [(None, "A b, c"), (3, None), (4, ""), (5, items[5][1]), (5, "b b")]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 80))) for _ in range(60)] + [None, "", "??", "a" * 5000]
    docs = docs_of(spark, texts)
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.find_contamination(with_extra(docs).drop("n_words"), benchmark, batch_bytes=batch_bytes).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == {i: brute_contamination(t, items) for i, t in enumerate(texts)}


def test_contamination_of_odd_tables(spark):
    benchmark = spark.createDataFrame([(1, "two three")], "item_id bigint, text string")
    got = decontaminate.find_contamination(odd_docs(spark), benchmark).collect()
    assert sorted(r["n_hit"] for r in got) == [0] * 6 + [2] * 3
    assert decontaminate.find_contamination(odd_docs(spark), benchmark.limit(0)).where("contaminated").count() == 0
    assert decontaminate.find_contamination(empty_docs(spark), benchmark).count() == 0


def test_targets_and_apportionment():
    assert mixing.targets([100, 100, 100], [3, 1, 2]) == pytest.approx([200, 83.3333333, 166.6666667])
    assert mixing.targets([0, 10], [3, 1]) == [0.0, 15.0]
    assert mixing.targets([], []) == []
    rng = random.Random(2)
    for _ in range(200):
        votes = [rng.randint(0, 40) for _ in range(rng.randint(1, 6))]
        caps = [rng.randint(0, 30) for _ in votes]
        seats = rng.randint(0, 60)
        given = [0] * len(votes)
        for _ in range(seats):
            open_ = [i for i in range(len(votes)) if given[i] < caps[i] and votes[i]]
            if not open_:
                break
            given[max(open_, key=lambda i: (votes[i] / (2 * given[i] + 1), -i))] += 1
        assert mixing.apportion(votes, seats, caps) == given


def test_mix_meets_its_targets(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    rows = mixing.mix_sizes(with_extra(docs), shard_rows=4).collect()
    again = mixing.mix_sizes(docs.repartition(5), shard_rows=4).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    taken = {}
    for r in rows:
        assert r["size"] == len(spaced(text[r["doc_id"]])) and 0 <= r["taken"] <= 2 * r["size"]
        taken.setdefault(r["source"], []).append(r)
    for part in taken.values():
        assert part[0]["source_size"] == sum(r["size"] for r in part)
        assert abs(sum(r["taken"] for r in part) - part[0]["target"]) <= 0.02 * part[0]["target"] + 2 * mixing.BLOCK_WORDS


def test_mixed_texts_hold_what_is_taken(spark):
    docs = with_extra(odd_docs(spark))
    sizes = mixing.mix_sizes(docs, block=3).collect()
    texts = mixing.mix_texts(docs, block=3)
    assert texts.columns == docs.columns
    rows = texts.collect()
    key = lambda r: (str(r["doc_id"]), r["source"])
    for r in sizes:
        same = [x for x in sizes if key(x) == key(r)]
        found = [x for x in rows if key(x) == key(r)]
        assert sum(len(spaced(x["text"])) for x in found) == sum(x["taken"] for x in same)
    assert all(r["n_chars"] == len(r["text"]) for r in rows)
    assert mixing.mix_sizes(empty_docs(spark)).count() == 0
    assert mixing.mix_texts(empty_docs(spark)).count() == 0


def test_blocks_round_trip():
    rng = np.random.default_rng(3)
    for n in (0, 1, 255, 256, 257, 5000):
        for high in (1, 2, 49_408, 1 << 32):
            ids = rng.integers(0, high, n, dtype=np.uint64).astype(np.uint32)
            if n > 100:
                ids[rng.integers(0, n, 9)] = np.uint32((1 << 32) - 1)
            payload = token_files.pack(ids)
            assert (token_files.unpack(payload) == ids).all()
            assert (token_files.unpack(payload, 100, 300) == ids[100:400]).all()


def test_token_files_are_the_tokenizer(spark, small_dir, monkeypatch):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(token_files.tokenizer_path())
    texts = [r["text"] for r in spark.read.parquet(f"{small_dir}/documents.parquet").select("text").collect()]
    texts += [
        None, "", "I'LL don't 'S x'd it's.", "A<|endoftext|>b <|ENDOFTEXT|> a", "é É Å x y\x1cz",
        "a…, b—c… ̈x .̈", "ΣΑΣ ΟΔΟΣ İstanbul ǅ ﬁ", "12a3,4 %%% ab### a''s ab's ab'.", "漢字かな 👍🏽!! \x00\x7f",
    ]
    docs = docs_of(spark, texts).repartition(7)
    got = {r["doc_id"]: r for r in token_files.token_files(with_extra(docs)).collect()}
    start = 0
    for i, text in enumerate(texts):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        raw = np.array(ids, dtype="<u4").tobytes()
        assert tuple(got[i]) == (i, start, len(ids), zlib.crc32(raw)), text
        start += len(ids)


def test_token_ranges_and_odd_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "SEGMENT", 50)
    got = token_files.token_files(odd_docs(spark), path=f"{tmp_path}/t").collect()
    assert sorted(r["n_tokens"] for r in got)[:4] == [1, 1, 1, 2]
    whole = token_files.read_range(spark, f"{tmp_path}/t", 0, 0, 1 << 40)
    assert whole[-1] == token_files.END
    assert token_files.read_range(spark, f"{tmp_path}/t", 0, 2, 3) == whole[2:5]
    assert token_files.token_files(empty_docs(spark)).count() == 0


def brute_fingerprint(text):
    import xxhash

    words = spaced(text)
    if not words:
        return 0
    runs = [words] if len(words) < 3 else [words[i : i + 3] for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(" ".join(r).encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def test_simhash_query_is_brute_force(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").collect()
    fp = {r["doc_id"]: brute_fingerprint(r["text"]) for r in docs}
    comp = brute_components(sorted(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 3)
    got = QUERIES["op9_simhash_dedup"](spark, small_dir).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {i: (f"{fp[i]:016x}", comp[i]) for i in fp}


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5])
def test_bit_sliced_distances(radius):
    rng = np.random.default_rng(radius)
    left = rng.integers(-(1 << 63), (1 << 63) - 1, 5000)
    flips = np.array([sum(1 << int(b) for b in rng.choice(63, k, replace=False)) for k in rng.integers(0, 9, 5000)])
    got = simhash_dedup.within(left, left ^ flips, radius)
    assert got.tolist() == [int(f).bit_count() <= radius for f in flips]


def test_crowded_buckets_lose_no_link(spark):
    rng = random.Random(4)
    base = rng.getrandbits(63)
    fps = {base ^ sum(1 << b for b in rng.sample(range(40), rng.randint(0, 5))) for _ in range(300)}
    fps |= {rng.getrandbits(63) for _ in range(200)}
    df = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    comp = brute_components(sorted(fps), lambda a, b: (a ^ b).bit_count() <= 3)
    found = simhash_dedup.components(simhash_dedup.links(df, 3, slice_rows=20)).collect()
    got = {f: f for f in fps} | {r["node"]: r["root"] for r in found}
    assert got == comp


def test_near_duplicates_of_odd_tables(spark):
    got = simhash_dedup.near_duplicates(with_extra(odd_docs(spark)).drop("fp")).collect()
    groups = sorted(((str(r["doc_id"]), r["component_id"]) for r in got), key=str)
    assert groups == [("1", 1), ("2", 2), ("3", 2), ("5", 5), ("6", 1), ("6", 1), ("9", 9), ("None", 2), ("None", None)]
    left = simhash_dedup.drop_near_duplicates(odd_docs(spark))
    assert sorted(str(r["doc_id"]) for r in left.collect()) == ["1", "2", "5", "9", "None"]
    assert simhash_dedup.drop_near_duplicates(empty_docs(spark)).count() == 0
    twice = docs_of(spark, ["same text here now"] * 4, ids=[7, 7, 7, None])
    assert [r["doc_id"] for r in simhash_dedup.drop_near_duplicates(twice).collect()] == [7]


def test_quality_of_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = QUERIES["op10_quality"](spark, sf_dir).collect()
    assert all(r["held_out"] == (fold(r["doc_id"], 5) == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    held = [(r["score"], labels[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert auc([h[:2] for h in held]) > 0.95
    assert sum(h[1] == h[2] for h in held) / len(held) > 0.93


def test_quality_learns_no_held_out_label(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    labels = spark.read.parquet(f"{small_dir}/labels.parquet")
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(string(doc_id) as binary)) % 5 = 0, 1 - quality, quality) AS quality")
    plain = {r["doc_id"]: r["score"] for r in quality.classify(docs, labels).collect()}
    assert {r["doc_id"]: r["score"] for r in quality.classify(docs, flipped).collect()} == pytest.approx(plain)


def test_quality_of_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {r["score"] > 0.49 for r in quality.classify(odd_docs(spark), none).collect()} == {True}
    some = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (1, 1, 1), (6, 0, None), (None, 1, 1), (9, None, 0)], none.schema)
    got = quality.classify(with_extra(odd_docs(spark)), some).collect()
    assert len(got) == 9 and all(0 <= r["score"] <= 1 for r in got)
    assert quality.classify(empty_docs(spark), some).count() == 0
    kept = quality.keep_good(with_extra(odd_docs(spark)).drop("_row"), none)
    assert kept.count() == 9 and "n_words" in kept.columns


def test_isotonic_curve():
    at, value = quality.pool_adjacent(np.array([0.0, 1, 2, 3]), np.array([0.0, 2, 1, 2]), np.array([2.0, 2, 2, 2]))
    assert value.tolist() == [0.0, 0.75, 1.0] and at.tolist() == [0.0, 1.5, 3.0]


def test_pipeline_stages(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "simhash_near_dedup", "benchmark_decontamination", "source_mixing", "token_output"]
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality_classifier"](spark, docs, small_dir)
    scores = {r["doc_id"]: r["predicted"] for r in QUERIES["op10_quality"](spark, small_dir).collect()}
    assert {r["doc_id"] for r in good.collect()} == {i for i, p in scores.items() if p}
    single = stages["simhash_near_dedup"](spark, docs, small_dir)
    found = QUERIES["op9_simhash_dedup"](spark, small_dir)
    assert {r["doc_id"] for r in single.collect()} == {r["component_id"] for r in found.collect()}
    assert single.count() == found.select("component_id").distinct().count()
    clean = stages["benchmark_decontamination"](spark, docs, small_dir)
    hit = QUERIES["op1_decontaminate"](spark, small_dir).where("NOT contaminated")
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in hit.collect()}
    mixed = stages["source_mixing"](spark, docs, small_dir)
    assert docs.columns == good.columns == single.columns == clean.columns == mixed.columns
    assert docs.schema == mixed.schema
    assert corpus_pipeline.run(spark, small_dir).count() > 0
