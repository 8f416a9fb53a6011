"""Token counts, periodic runs, filter audit, each against a brute-force version."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from helpers import docs_of, empty_docs, odd_docs, with_extra
from hypothesis import given, settings
from hypothesis import strategies as st

from chronograin.llm import filter_audit, periodic_runs, token_counts
from chronograin.llm.queries import QUERIES

MIXED = [
    "Plain text, it's here; don't worry 12345 x2y.", "<|startoftext|>special<|endoftext|> strings <|endoftext|>5", "",
    "tab\tline\nfeed\x0b\x0c\r end  double   spaces ", "Ünïcödé ﬁne ½ 東京都 emoji 👩‍💻 ok", "é café a ́b 1́ 2⃣",
    "ΟΔΥΣΣΕΥΣ Σ", "no break space　wide", "x" * 9000, "12" * 9000, "word7" * 5000, "a'sb'lls 's 've", " " * 40, "İstanbul ǅ",
    "<|start 5oftext|> <| endoftext |>", "!!!???...$$$ #1#2#3 &amp;",
]


def whole(name):
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=token_counts.place(name))
        return lambda text: len(model.encode(text))
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(token_counts.place(name))
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_counts_of_pieces_are_counts_of_whole_texts(name):
    count = whole(name)
    rng = random.Random(5)
    texts = MIXED + ["".join(rng.choice(["ab", " ", "  ", "1", "23", "'s", ".", "é", "\n", "<|endoftext|>", "東", "́"]) for _ in range(rng.randrange(60))) for _ in range(400)]
    found = token_counts.Counter(name).count([t.encode() for t in texts] + [None])
    assert found == [count(t) for t in texts] + [0]


def test_long_texts_are_cut_at_safe_boundaries_only(monkeypatch):
    monkeypatch.setattr(token_counts, "SLICE_BYTES", 40)
    monkeypatch.setattr(token_counts, "PIECE_BYTES", 7)
    monkeypatch.setattr(token_counts, "MEMO_BYTES", 6)
    monkeypatch.setattr(token_counts, "ENCODE_BYTES", 20)
    monkeypatch.setattr(token_counts, "MEMO", 5)
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        count, counter = whole(name), token_counts.Counter(name)
        for text in [*MIXED, " ".join(MIXED)]:
            assert counter.count([text.encode()]) == [count(text)], (name, text[:50])
    cut = token_counts.SAFE["word_bpe_49k.json"].cut
    text = b"alpha beta 12 gamma" * 20
    parts = list(token_counts.slices(text, 8, cut))
    assert b"".join(parts) == text and all(cut.match(p) for p in parts[1:]) and max(map(len, parts)) < 20
    assert [sum(map(len, b)) for b in token_counts.byte_batches([b"aaaa", b"bb", b"c" * 9, b"d"], 5)] == [3, 4, 9]


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=80))
def test_any_text_counts_as_a_whole(text):
    text = text.encode("utf-8", "ignore").decode()
    assert token_counts.counter("word_bpe_49k.json").count([text.encode()]) == [whole_words(text)]


whole_words = whole("word_bpe_49k.json")


def test_token_counts_of_odd_rows(spark):
    docs = odd_docs(spark)
    got = token_counts.count_tokens(with_extra(docs)).collect()
    want = [(r.doc_id, len((r.text or "").encode()), whole_words(r.text or "")) for r in docs.collect()]
    assert sorted(map(str, [(r.doc_id, r.n_bytes, r.n_tokens) for r in got])) == sorted(map(str, want))
    assert all(r.over_limit == (r.n_tokens > 2048) for r in got) and any(r.over_limit for r in got)
    exact = token_counts.count_tokens(docs_of(spark, ["a " * 2048, "a " * 2049]), limit=2048).collect()
    assert sorted((r.n_tokens, r.over_limit) for r in exact) == [(2048, False), (2049, True)]
    kept = token_counts.count_tokens(docs.selectExpr("*", "1 AS n_words"), keep=("doc_id", "n_words", "lang"))
    assert kept.columns == ["doc_id", "n_words", "lang", "n_bytes", "n_tokens", "over_limit"]
    assert token_counts.count_tokens(empty_docs(spark)).count() == 0


def brute_runs(words, shortest=12):
    n, best = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(shortest, 2 * q) and j > i:
                best.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in best.items()), key=lambda r: (r[0], r[2]))


def runs(words, shortest=12):
    return [tuple(r) for r in periodic_runs.runs_of(periodic_runs.word_codes(words), shortest).tolist()]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=70), st.integers(2, 12))
def test_runs_of_few_words(words, shortest):
    assert runs(words, shortest) == brute_runs(words, shortest)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**6))
def test_runs_of_built_texts(seed):
    rng = random.Random(seed)
    words = []
    for _ in range(rng.randrange(1, 6)):
        words += [str(rng.randrange(rng.choice([2, 5, 40, 1000]))) for _ in range(rng.randrange(30))]
        unit = [str(rng.randrange(rng.choice([1, 3, 500]))) for _ in range(rng.randrange(1, 90))]
        words += (unit * 6)[: rng.randrange(1, 4 * len(unit) + 2)]
    assert runs(words) == brute_runs(words)


def test_long_lags_are_extended_by_block_names(monkeypatch):
    monkeypatch.setattr(periodic_runs, "SHORT_LAGS", 2)
    monkeypatch.setattr(periodic_runs, "PAIRS", 7)
    rng = random.Random(3)
    for _ in range(60):
        unit = [rng.choice("abcd") for _ in range(rng.randrange(1, 40))]
        words = [rng.choice("ab") for _ in range(rng.randrange(20))] + unit * rng.randrange(1, 5) + unit[: rng.randrange(len(unit))]
        assert runs(words) == brute_runs(words)
    # Fibonacci words hold about as many runs as they have letters
    a, b = "a", "ab"
    while len(b) < 400:
        a, b = b, b + a
    assert runs(b) == brute_runs(b) and len(runs(b, 2)) > 200


def test_segments_split_to_stability():
    # every word occurs twice, yet taking one word off an end uncovers the next: one segment after another
    chain = [w for i in range(2000) for w in (f"x{i + 1}", f"x{i}")][:-1]
    assert periodic_runs.surviving_segments(periodic_runs.word_codes(chain)) == []
    twice = [f"w{i}" for i in range(300)] * 2
    assert periodic_runs.surviving_segments(periodic_runs.word_codes(["q", *twice, "r", "s"])) == [(1, 601)]
    assert runs(["q", *twice, "r"]) == [(1, 600, 300)]
    one = ["same"] * 60_000
    assert runs(one) == [(0, 60_000, 1)]


def test_run_digests(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["a", "b", "A", "c"]) for _ in range(rng.randrange(80))) for _ in range(60)]
    texts += [None, "", " \t ", "Say it. " * 20, "x y z " * 4, "x y z " * 3 + "x y"]
    docs = docs_of(spark, texts)
    got = {r.doc_id: r for r in periodic_runs.run_digests(with_extra(docs)).collect()}
    plants = 0
    for i, text in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h, n = zlib.crc32(str(i).encode()), len(words)
        if h % 10 == 0 and n > 0:
            plants += 1
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[j] if j < a else words[a + (j - a) % p] for j in range(n)]
        found = brute_runs(words)
        gone = {j for s, length, q in found for j in range(s + q, s + length)}
        kept = " ".join(w for j, w in enumerate(words) if j not in gone)
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        want = (len(found), *best, best[0] is not None and 1000 * best[1] // best[2] or None)
        row = got[i]
        assert (row.n_runs, row.start, row.length, row.period, row.exponent_milli) == want, text
        assert row.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(kept.encode()).hexdigest()
    assert plants >= 3


def test_periodic_runs_of_odd_rows(spark):
    rows = periodic_runs.periodic_runs(odd_docs(spark), keep=("doc_id", "text")).collect()
    assert len(rows) == 9
    for r in rows:
        words = (r.text or "").split()
        assert r.n_words == len(words)
        assert [tuple(x) for x in r.runs] == ([(0, 60_000, 977)] if len(words) == 60_000 else [])
        assert r.collapsed == " ".join(words[:977])
    assert len(periodic_runs.run_digests(odd_docs(spark)).collect()) == 9
    assert periodic_runs.run_digests(empty_docs(spark)).count() == 0 == periodic_runs.periodic_runs(empty_docs(spark)).count()


def brute_measure(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return [len(words), len(set(words)), len(re.findall("[A-Z]", text)), len(text), len(re.findall(r"[#$%&*|]", text))]


ODD_TEXTS = ["", " ", "a", " a b  a ", "É é É x", "$5 & more|", "𝔘nicode 𝔘nicode", "x" * 3000 + " " + "x" * 3000 + " " + "x" * 2999 + "y", "\n\n", "A B C"]


def test_transducer_measures():
    assert filter_audit.measure([t.encode() for t in ODD_TEXTS]).tolist() == [brute_measure(t) for t in ODD_TEXTS]
    long = " ".join(f"w{i % 5000}é" for i in range(40_000))
    for size in (1, 7, 64, 1000, 1 << 20):
        texts = [*ODD_TEXTS, long[: 3000 if size < 64 else None]]
        assert filter_audit.measure([t.encode() for t in texts], size).tolist() == [brute_measure(t) for t in texts], size
    assert filter_audit.measure([]).shape == (0, 5)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="aB é#\n東́", max_size=40), max_size=8), st.sampled_from([1, 5, 50, 1000]))
def test_transducer_on_any_text(texts, size):
    assert filter_audit.measure([t.encode() for t in texts], size).tolist() == [brute_measure(t) for t in texts]


def test_colliding_hashes_do_not_merge_words(monkeypatch):
    monkeypatch.setattr(filter_audit.SpanTable, "_hash", lambda self, starts, ends, owners: np.zeros(len(starts), np.uint64))
    texts = [*ODD_TEXTS, "ab cd ef ab abcdefgh abcdefgi abcdefghi abcdefghj " * 3]
    assert filter_audit.measure([t.encode() for t in texts]).tolist() == [brute_measure(t) for t in texts]


def brute_audit(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    firsts = {}
    for i, text, _ in docs:
        if i is not None:
            firsts[text or ""] = min(i, firsts.get(text or "", i))
    fails, out = [], {}
    for i, text, lang in docs:
        words, distinct, caps, points, symbols = brute_measure(text or "")
        bad = {f for f, b in zip("ABCDE", [words < 200, 100 * distinct < 50 * words, 100 * caps > 3 * points, symbols > 0,
                                           i is not None and firsts[text or ""] < i], strict=True) if b}
        fails.append((lang or "", bad, i in good, i in toxic))
    for part in {f[0] for f in fails}:
        shapley = dict.fromkeys("ABCDE", 0)
        rows = {}
        for order in itertools.permutations("ABCDE"):
            left = [f for f in fails if f[0] == part]
            everyone = left
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                shapley[f] += len(gone)
                rows["".join(order), step] = [
                    len(left), len(gone), sum(f in x[1] for x in everyone) - len(gone), sum(x[1] == {f} for x in everyone),
                    sum(x[2] for x in gone), sum(x[3] for x in gone),
                ]
        for (order, step), row in rows.items():
            out[part, order, step] = (*row, shapley[order[step - 1]])
    return out


def audit_rows(rows):
    return {
        (r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley)
        for r in rows
    }


def test_filter_audit(spark):
    rng = random.Random(9)
    docs = []
    for i in range(80):
        size = rng.choice([0, 3, 199, 200, 260])
        words = [rng.choice(["Word", "wörd", "low", "x$"] if rng.random() < 0.3 else [f"w{k}" for k in range(300)]) for _ in range(size)]
        docs.append((i if i % 9 else None, " ".join(words) or rng.choice([None, "", "same"]), rng.choice(["en", None, ""])))
    docs += [docs[k] for k in (1, 1, 9, 20)] + [(200 + k, docs[k][1], "de") for k in range(30)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 120, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, lang string").selectExpr("*", "'p' AS part", "1 AS mask", "2 AS n", "'f' AS first")
    known = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").selectExpr("*", "1 AS part", "1 AS good")
    got = filter_audit.filter_audit(frame, known).collect()
    want = brute_audit(docs, labels)
    assert audit_rows(got) == want and len(got) == len(want) == 600 * len({d[2] or "" for d in docs})
    assert len({sum(v[1] for k, v in want.items() if k[:2] == o) for o in {k[:2] for k in want}}) > 1


def test_filter_audit_of_odd_rows(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    docs = odd_docs(spark)
    got = filter_audit.filter_audit(with_extra(docs), none).collect()
    assert audit_rows(got) == brute_audit([(r.doc_id, r.text, r.lang) for r in docs.collect()], [])
    assert filter_audit.filter_audit(empty_docs(spark), none).count() == 0


def test_new_queries_read_whole_tables(spark, small_dir):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()}
    counts = QUERIES["op11_token_counts"](spark, small_dir).collect()
    assert {(r.doc_id, r.n_bytes, r.n_tokens) for r in counts} == {(i, len((d.text or "").encode()), whole_words(d.text or "")) for i, d in docs.items()}
    found = QUERIES["op12_periodic_runs"](spark, small_dir).collect()
    assert len(found) == len(docs) and sum(r.n_runs > 0 for r in found) > len(docs) / 20
