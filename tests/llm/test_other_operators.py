"""HTML text, toxicity, language model, fingerprints, license scan."""

import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
from helpers import alnum, auc, docs_of, empty_docs, fold, odd_docs, spaced, with_extra

from chronograin.llm import fingerprints, html_text, language_model, licenses, toxicity
from chronograin.llm.queries import QUERIES

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x}</style><script>var a="<p>no</p>";</script></head><body>
<header><h1>The site</h1></header><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">More</a></li></ul></nav>
<!-- <p>hidden</p> --><div class="cookie-notice"><p>We use cookies on this site, please accept all of them.</p></div>
<div class="ad">Buy this wonderful thing today and save a lot of money.</div>
<article><header><h1>A &amp; B&nbsp;title</h1></header><p>First   paragraph, it has
 <b>bold</b> and <a href="/c">linked</a> words.<p>Second one,<br>after a break &#8212; ends here.</p>
<form><label>Your mail</label><input type="text"></form>
<section id="comments"><h2>Comments</h2><p>Great article, I read all of it twice, thanks.</p></section></article>
<aside><p>A sidebar with a rather long text about something else entirely.</p></aside>
<footer><p>&copy; 2020 The site. All the usual words stand here in the footer.</p></footer></body></html>"""


def test_main_text_of_a_page():
    want = "A & B title\nFirst paragraph, it has bold and linked words.\nSecond one, after a break — ends here."
    assert html_text.main_text(PAGE) == want


def test_main_text_of_plain_markup():
    words = "Some plain words that make up a paragraph of a page without any structure."
    assert html_text.main_text(f"<p>{words}</p><div>{words} a < b</div>") == f"{words}\n{words} a < b"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<div></div><p>") == ""
    assert html_text.main_text("<article><p>" + "x y. " * 50_000) == ("x y. " * 50_000).strip()
    assert html_text.main_text('<p title="a' + "<" * 5000) is not None



def test_only_what_is_hidden_is_left_out():
    words = "Some plain words that make up a paragraph of a page, long enough to be kept."
    shown = (
        'class="overflow-hidden"', 'style="overflow:hidden"', 'aria-hidden="false"', 'data-hidden="0"', 'title="hidden"',
        'hidden="until-found"', 'style="display:none;display:block"', 'data-style="display:none"', "class=is-hidden-mobile",
        'title="a hidden',
    )
    for attributes in shown:
        assert html_text.main_text(f"<body {attributes}><p>{words}</p></body>") == words, attributes
        assert html_text.main_text(f"<article {attributes}><p>{words}</p></article>") == words, attributes
    for attributes in ("hidden", 'HIDDEN=""', 'aria-hidden="true"', "aria-hidden=TRUE", "style='color:red; Display : none !important'"):
        assert html_text.main_text(f"<div {attributes}><p>{words}</p></div><p>{words}</p>") == words, attributes


def test_foreign_elements_close_at_once():
    words = "Some plain words that make up a paragraph of a page, long enough to be kept."
    for tag in ('<svg class="a" width="1"/>', "<svg/>", "<math />", "<SVG a='>'/>"):
        assert html_text.main_text(f"<p>{words}</p>{tag}<p>{words}</p><svg><text>no</text></svg>") == f"{words}\n{words}", tag
    assert html_text.main_text(f"<svg><path d='x'/><text>no</text></svg><p>{words}</p>") == words


def test_articles_of_given_pages(spark):
    import html

    got = {r["page_id"]: r for r in QUERIES["op2_html_text"](spark, "/root/testdata/sf0.01").collect()}
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    assert len(got) == len(pages)
    for r in pages:
        article = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", article)]
        assert got[r["page_id"]]["text"] == "\n".join(p for p in parts if p)
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"])


def test_pages_of_odd_tables(spark):
    schema = "page_id bigint, url string, html string, text string, n_chars int"
    rows = [(1, None, None, "x", 1), (None, "u", "", None, None), (2, "u", PAGE, "", 0), (2, "u", PAGE, "", 0)]
    got = html_text.extract(spark.createDataFrame(rows, schema))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(r["n_chars"] > 0 for r in got.collect()) == [False, False, True, True]
    assert html_text.extract(spark.createDataFrame([], schema)).count() == 0


def test_minimum_cut_is_minimal():
    rng = random.Random(5)
    for _ in range(200):
        n = rng.randint(1, 8)
        source, sink = ([rng.random() * 3 for _ in range(n)] for _ in range(2))
        ties = {(i, j): rng.random() * 2 for i in range(n) for j in range(i + 1, n) if rng.random() < 0.4}

        def cost(side):
            cut = sum(w for (i, j), w in ties.items() if side[i] != side[j])  # noqa: B023
            return cut + sum(sink[i] if side[i] else source[i] for i in range(n))  # noqa: B023

        best = min(map(cost, itertools.product([False, True], repeat=n)))
        assert cost(html_text.minimum_cut(source, sink, ties)) == pytest.approx(best)


def toxic_corpus(seed, n):
    rng = random.Random(seed)
    syllables = ["ba", "ne", "ti", "ro", "lu", "sha", "mon", "ter", "ing", "ly"]
    texts, labels = [], []
    for _ in range(n):
        words = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(rng.randint(20, 150))]
        bad = rng.random() < 0.3
        if bad:
            for _ in range(rng.randint(1, 3)):
                word = rng.choice(["vexgrump", "klodkopf", "zwarfle"])
                cut = rng.randint(1, len(word) - 1)
                words[rng.randrange(len(words))] = rng.choice([word, word, word[:cut] + word[cut - 1] + word[cut:], word + "s", word.upper() + "!"])
        texts.append(" ".join(words).encode())
        labels.append(int(bad))
    return texts, labels


def test_toxicity_finds_unseen_misspellings():
    values, bias = toxicity.train(*toxic_corpus(6, 500))
    words = toxicity._Words(values)
    texts, labels = toxic_corpus(7, 300)
    assert auc([(toxicity.raw_score(t, words, bias), y) for t, y in zip(texts, labels, strict=True)]) > 0.95
    clean = toxicity.raw_score(b"ba ne tiro lusha monter", words, bias)
    assert toxicity.raw_score(b"ba ne tiro vexgrrump lusha", words, bias) > clean
    assert toxicity.raw_score(None, words, bias) == toxicity.LOWEST


def test_logistic_curve_meets_shares():
    rng = np.random.default_rng(11)
    raw = rng.normal(40, 15, 4000)
    labels = (rng.random(4000) < 1 / (1 + np.exp(-(0.3 * raw - 15)))).astype(int)
    slope, shift = toxicity.logistic(raw, labels, np.ones(4000))
    assert slope == pytest.approx(0.3, abs=0.04) and shift == pytest.approx(-15, abs=2)
    # apart from one another: the curve steps between the two sides
    raw, labels = np.r_[np.full(90, 5.0), np.full(10, 60.0)], np.r_[np.zeros(90), np.ones(10)]
    slope, shift = toxicity.logistic(raw, labels, np.ones(100))
    assert slope * 60 + shift > 2 and slope * 5 + shift < -2


def test_toxicity_windows_are_brute_force():
    values = np.random.default_rng(8).normal(size=toxicity.BUCKETS)
    words = toxicity._Words(values)
    pieces = [f"w{i}".encode() for i in range(23)]
    z = [np.mean([values[g] for g in toxicity.grams(p)]) for p in pieces]
    for n in (1, toxicity.WINDOW - 1, toxicity.WINDOW, 23):
        k = min(n, toxicity.WINDOW)
        best = max(np.mean(z[i : i + k]) for i in range(n - k + 1)) + 0.25
        assert toxicity.raw_score(b" ".join(pieces[:n]), words, 0.25) == pytest.approx(best)


def test_toxicity_query(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = QUERIES["op3_toxicity"](spark, sf_dir).collect()
    assert len(rows) == docs.count()
    assert all(r["held_out"] == (fold(r["doc_id"], 5) == 0) and 0 <= r["score"] <= 1 for r in rows)
    assert all(r["predicted"] == (r["score"] >= 0.5) for r in rows)
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(string(doc_id) as binary)) % 5 = 0, 1 - toxic, toxic) AS toxic")
    again = {r["doc_id"]: r["score"] for r in toxicity.classify(docs, flipped).collect()}
    assert {r["doc_id"]: r["score"] for r in rows} == pytest.approx(again)


def test_toxicity_of_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {r["score"] for r in toxicity.classify(odd_docs(spark), none).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1, 0), (6, 1, 0), (None, 1, 1), (9, 1, None)], none.schema)
    assert max(r["score"] for r in toxicity.classify(odd_docs(spark), one).collect()) < 1e-9
    both = one.unionAll(spark.createDataFrame([(2, 1, 1), (5, 1, 1), (5, 1, 0), (5, 1, 1)], none.schema))
    got = toxicity.classify(with_extra(odd_docs(spark)), both).collect()
    assert len(got) == 9 and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.classify(empty_docs(spark), both).count() == 0


def brute_lm(texts, ids):
    """Counts, N, V and the base score of every text."""
    counts = {}
    for i, t in zip(ids, texts, strict=True):
        if fold(i, 7) != 2:
            for w in [*spaced(t), None]:
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    out = {}
    for i, t in zip(ids, texts, strict=True):
        tokens = [*spaced(t), None]
        known = sum(w in counts for w in tokens)
        out[i] = (fold(i, 7) == 2, len(tokens), known, n, sum(math.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in tokens))
    return out


@pytest.mark.parametrize("known_words", [50, 1000])
def test_language_model_base_is_brute_force(spark, small_dir, monkeypatch, known_words):
    monkeypatch.setattr(language_model, "KNOWN_WORDS", known_words)
    monkeypatch.setattr(language_model.frequent_words, "__defaults__", (known_words,))
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").limit(80).collect()
    texts = [r["text"] for r in docs] + [None, "", "UNSEENWORD one é É"]
    ids = [r["doc_id"] for r in docs] + [10_000, 10_001, next(i for i in range(20_000, 30_000) if fold(i, 7) == 2)]
    got = language_model.score_documents(with_extra(docs_of(spark, texts, ids=ids))).collect()
    want = brute_lm(texts, ids)
    assert len(got) == len(want)
    for r in got:
        assert tuple(r)[1:5] == want[r["doc_id"]][:4]
        assert r["base_score"] == pytest.approx(want[r["doc_id"]][4])
        assert r["score"] < 0


def test_class_model_sums_to_one(spark, small_dir):
    """Over all known words, one unseen word a class and the end, after any class."""
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").limit(60)
    counts = language_model.count_words(docs).cache()
    model = language_model.fit(docs, counts)
    words = {bytes(r["word"]): r["n"] for r in counts.collect()}
    codes = language_model._Codes(model.words, model.frequent)
    emitted = np.zeros(language_model.CLASSES)
    for word, n in words.items():
        code = codes[word]
        unit = -1 - code if code < 0 or code >= model.frequent else code
        if code >= model.frequent:
            unit = model.frequent + language_model.shape(word)
        emitted[model.of[unit]] += n + language_model.ALPHA
    emitted[model.of[-1]] += model.ends + language_model.ALPHA
    emitted += language_model.ALPHA
    assert emitted == pytest.approx(10**model.divisors)
    assert (10**model.transitions).sum(1) == pytest.approx(np.ones(language_model.CLASSES), abs=1e-6)
    assert model.tokens == sum(words.values()) + 60


def test_exchange_reaches_a_local_optimum():
    rng = np.random.default_rng(9)
    hidden = np.r_[rng.integers(0, 4, 40), 4]
    pairs = rng.poisson(rng.gamma(0.3, 20, (5, 5))[hidden][:, hidden]).astype(float)
    of = language_model.exchange(pairs, classes=5, rounds=30)

    def likelihood(of):
        member = np.eye(5)[of]
        table = member.T @ pairs @ member
        f = language_model._xlogx
        return f(table).sum() - f(table.sum(0)).sum() - f(table.sum(1)).sum()

    best = likelihood(of)
    for w in range(40):
        for c in range(4):
            moved = of.copy()
            moved[w] = c
            assert likelihood(moved) <= best + 1e-6


def test_language_model_beats_the_base(spark):
    rows = QUERIES["op5_language_model"](spark, "/root/testdata/sf0.01").where("held_out").collect()
    assert sum(r["score"] for r in rows) > 0.99 * sum(r["base_score"] for r in rows)


def test_classes_of_rare_words_come_from_their_neighbours(spark, monkeypatch):
    """Words with the same ending, none of them broadcast, part by what stands around them; the table is exact."""
    rng = random.Random(3)
    sides = [[f"{a}{i}" for i in range(4)] for a in "pq"]
    rare = [[f"{a}{i:02d}xyz" for i in range(30)] for a in "uv"]
    texts = []
    for i in range(600):
        side, own = sides[i % 2], rare[i % 2]
        texts.append(" ".join(w for _ in range(6) for w in (rng.choice(side), rng.choice(own), *([rng.choice(own)] if rng.random() < 0.2 else []), rng.choice(side))))
    for name, size in (("KNOWN_WORDS", 20), ("FREQUENT", 8)):
        monkeypatch.setattr(language_model, name, size)
    monkeypatch.setattr(language_model.frequent_words, "__defaults__", (20,))
    docs = docs_of(spark, texts)
    counts = language_model.count_words(docs).cache()
    model, classes = language_model.cluster(docs, counts)
    of = {bytes(r["word"]).decode(): r["class"] for r in classes.collect()}
    assert len(model.words) + len(of) == counts.count()
    of |= {w.decode(): c for w, c in zip(model.words, model.of, strict=False)}
    assert not {of[w] for w in rare[0]} & {of[w] for w in rare[1]}
    table = np.zeros((language_model.CLASSES, language_model.CLASSES))
    for t in texts:
        line = [model.of[-1], *[of[w] for w in t.split()], model.of[-1]]
        np.add.at(table, (line[:-1], line[1:]), 1)
    share = (table.sum(0) + 1) / (table.sum() + language_model.CLASSES)
    prior = language_model.PRIOR
    want = np.log10((table + prior * share) / (table.sum(1, keepdims=True) + prior))
    assert model.transitions == pytest.approx(want)
    # scores are those of the classes, also where words that are not broadcast follow one another, or are unseen
    n = {bytes(r["word"]).decode(): r["n"] for r in counts.collect()}
    asked = [*texts[:5], "u01xyz u02xyz nowhere v03xyz", "nowhere", ""]
    got = language_model.score(docs_of(spark, asked), counts, model, classes).collect()
    for r in got:
        words = asked[r["doc_id"]].split()
        line = [model.of[-1], *[of.get(w, model.of[model.frequent + language_model.shape(w.encode())]) for w in words], model.of[-1]]
        alpha = [math.log10(n.get(w, 0) + language_model.ALPHA) for w in words] + [math.log10(model.ends + language_model.ALPHA)]
        assert r["logp"] == pytest.approx(sum(alpha) + model.transitions[line[:-1], line[1:]].sum() - model.divisors[line[1:]].sum())


def test_language_model_of_odd_tables(spark):
    got = language_model.score_documents(odd_docs(spark)).collect()
    assert len(got) == 9 and min(r["n_tokens"] for r in got) == 1
    assert language_model.score_documents(empty_docs(spark)).count() == 0


def brute_edits(rows):
    """(edited text, next row) of each row of (doc_id, text, ..), ids distinct."""
    order = sorted(rows, key=lambda r: -r[0])
    for at, (i, text) in enumerate(order):
        follower = order[(at + 1) % len(order)]
        k = len(text) // 3
        yield i, text, text[: len(text) - k] + follower[1][:k], follower[0]


def brute_fingerprint(text):
    import xxhash

    words = re.findall(fingerprints.WORD, text.lower())
    votes, total = [0] * 64, 0
    for a, b in itertools.zip_longest(words, words[1:]):
        h = xxhash.xxh64_intdigest(a.encode(), 42)
        h = h if b is None else xxhash.xxh64_intdigest(b.encode(), h)
        weight = len(a) + len(b or "")
        total += weight
        votes = [v + weight * (h >> j & 1) for j, v in enumerate(votes)]
    return sum(1 << j for j, v in enumerate(votes) if 2 * v > total)


def test_fingerprints_are_brute_force(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").limit(60).collect()
    rows = [(r["doc_id"], r["text"]) for r in docs] + [(100_000, ""), (100_001, "é"), (100_002, "ab cd"), (100_003, "")]
    df = docs_of(spark, [t for _, t in rows], ids=[i for i, _ in rows])
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_edits(with_extra(df)).collect()}
    assert len(got) == len(rows)
    fps = {i: brute_fingerprint(t) for i, t in rows}
    for i, text, edited, follower in brute_edits(rows):
        r = got[i]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        fp, edited_fp = r["fp"] % (1 << 64), r["edited_fp"] % (1 << 64)
        assert (fp, edited_fp) == (fps[i], brute_fingerprint(edited))
        assert r["near_edited"] == 1 - (fp ^ edited_fp).bit_count() / 64
        assert r["near_next"] == 1 - (fp ^ fps[follower]).bit_count() / 64


def test_fingerprints_of_odd_tables(spark):
    got = fingerprints.fingerprint_edits(odd_docs(spark)).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "2", "3", "5", "6", "6", "9", "None", "None"]
    # the first of two copies has the other as its next
    assert 1.0 in [r["near_next"] for r in got if r["doc_id"] == 6]
    assert fingerprints.fingerprint_edits(empty_docs(spark)).count() == 0
    alone = fingerprints.fingerprint_edits(docs_of(spark, ["abcdef"])).first()
    assert alone["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest()


def test_block_tables_find_all_within_the_radius(spark):
    rng = random.Random(10)
    fps = [rng.getrandbits(64) for _ in range(150)]
    fps += [f ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for f in fps for _ in range(2)]
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed] + [(None,)], "fp bigint")
    got = fingerprints.within_radius(df.limit(40), df).collect()
    asked = {r["fp"] for r in df.limit(40).collect()}
    want = {(a, b, ((a ^ b) % (1 << 64)).bit_count()) for a in asked for b in signed if ((a ^ b) % (1 << 64)).bit_count() <= 3}
    assert sorted(map(tuple, got)) == sorted(want)


TEXTS = [
    "Licensed under the Apache License, Version 2.0 (the License).",
    "x\nThis is CC-BY-NC 4.0, and cc  by again. MIT\tLicense! the GNU General Public License",
    "GNU General Public License v3; gnu general public license", "ccby mitlicense Apache-Licence ÉGNU general public license",
    "SPDX-License-Identifier: MPL 2.0 license", "All rights reserved.", None, "", "cc by", "mit license mit license",
    "licensed under the new BSD license, see the BSD license",
]


def brute_base(text):
    words = alnum(text)
    places, labels = [], set()
    for phrase, label in licenses.BASE.items():
        wanted = phrase.split()
        found = [i for i in range(len(words) - len(wanted) + 1) if words[i : i + len(wanted)] == wanted]
        places += found
        labels |= {label} if found else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_license_base_is_brute_force(spark, small_dir):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()] + TEXTS
    got = {r["doc_id"]: tuple(r)[1:6] for r in licenses.scan(with_extra(docs_of(spark, texts)).drop("n_words")).collect()}
    assert got == {i: brute_base(t) for i, t in enumerate(texts)}


def test_license_rules_and_suppression(spark):
    got = [r["labels"] for r in licenses.scan(docs_of(spark, TEXTS)).orderBy("doc_id").collect()]
    assert got == [
        "apache,apache-2.0", "cc-by,cc-by-nc-4.0,gpl,mit", "gpl,gpl-3.0", "gpl", "mpl-2.0", "all-rights-reserved", "", "",
        "cc-by", "mit", "bsd,bsd-3-clause",
    ]
    scores = {r["doc_id"]: r["score"] for r in licenses.scan(docs_of(spark, TEXTS)).collect()}
    assert scores[0] == 0.95 and scores[4] == 1.0 and scores[3] == 0.7 and scores[7] == 0.0
    # a later filter does not undo the order of the steps
    assert licenses.scan(docs_of(spark, TEXTS)).where("labels = 'mit' AND score > 0.5").count() == 1


def test_license_rules_are_reached():
    assert len(licenses.rules()) > 300
    for core, _, pattern, _, _ in licenses.rules():
        key = licenses.keyword(core)
        assert any(root in key for root in licenses.ROOTS) and re.compile(pattern)
    for label, *patterns in licenses.LICENSES:
        # every pattern is one that the words of a text can match
        assert all(p == p.lower() and label for p in patterns)


def test_licenses_of_odd_tables(spark):
    assert {r["labels"] for r in licenses.scan(odd_docs(spark)).collect()} == {""}
    assert licenses.scan(empty_docs(spark)).count() == 0
