"""What document filters do to each other in every order of application.

Texts are measured by a table-driven byte transducer. Two states, between words and within one; ``NEXT`` gives the
state behind a byte, ``EMIT`` what a byte shows in a state: a word begins, a word has ended, a capital, a code point
(any byte but a UTF-8 continuation), a symbol. Each byte alone settles the state behind it, so all states of a slice
are one table look-up, shifted by one place, and the pass runs in numpy over many texts at once; a blank behind each
text closes its last word. The spans of the words of a slice go into an open-addressed hash table of spans: an entry
is equal only if owner, length, hash and then the bytes themselves agree, so a collision never merges two words.
The table holds distinct words only and grows with them; a slice ends where a word ends.

Exact copies are found over the whole table by the SHA-256 of the text. The five conditions of a document are one
number of five bits, and documents meet the orders only as counts by (part, number, label), whatever their number.

Defined results: NULL texts count as empty, NULL parts as the empty string; a NULL id is neither smaller nor larger than
any, so it fails no copy test and makes none fail; rows that share the id and the text of the first copy are all first;
each repeated row counts; of repeated labels of an id any that is 1 counts, an id without labels has none; texts of any
length are measured whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronograin.llm.common import per_batch, raw_texts, settle, stored

# bytes that go through the transducer at once
SLICE_BYTES = 1 << 20
SYMBOLS = b"#$%&*|"
FILTERS = "ABCDE"

BETWEEN, WITHIN = 0, 1
BEGINS, ENDED, CAPITAL, POINT, SYMBOL = 1, 2, 4, 8, 16


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """State behind each byte, and what each byte shows in each state."""
    byte = np.arange(256)
    blank = (byte == 0x20) | ((byte >= 0x09) & (byte <= 0x0D))
    shown = (
        CAPITAL * ((byte >= 0x41) & (byte <= 0x5A))
        + POINT * ((byte & 0xC0) != 0x80)
        + SYMBOL * np.isin(byte, np.frombuffer(SYMBOLS, np.uint8))
    )
    emit = np.stack([shown + BEGINS * ~blank, shown + ENDED * blank])
    return np.where(blank, BETWEEN, WITHIN).astype(np.uint8), emit.astype(np.uint8)


NEXT, EMIT = _tables()

# an odd multiplier and its inverse modulo 2^64, and mixers
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_OWNER = np.uint64(0xC2B2AE3D27D4EB4F)


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(n, base, np.uint64)], dtype=np.uint64)


class SpanTable:
    """A hash table of spans of one buffer, which is padded by eight bytes."""

    def __init__(self, buffer: np.ndarray) -> None:
        self.buffer = buffer
        # unaligned words of eight bytes at every place
        self.words = np.ndarray((len(buffer) - 7,), "<u8", buffer=buffer.data, strides=(1,))
        self.spans = np.empty((0, 3), np.int64)
        self.hashes = np.empty(0, np.uint64)
        self.table = np.full(1 << 10, -1, np.int64)
        self.steps, self.backs = _powers(_STEP, 1 << 10), _powers(_BACK, 1 << 10)

    def _hash(self, starts: np.ndarray, ends: np.ndarray, owners: np.ndarray) -> np.ndarray:
        """Polynomial hashes of spans that lie close together, from prefix sums over them all."""
        low, n = int(starts[0]), int(ends[-1] - starts[0])
        while n >= len(self.steps):
            self.steps, self.backs = _powers(_STEP, 2 * len(self.steps)), _powers(_BACK, 2 * len(self.backs))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((self.buffer[low : low + n].astype(np.uint64) + np.uint64(1)) * self.steps[:n], out=sums[1:])
        hashes = (sums[ends - low] - sums[starts - low]) * self.backs[starts - low]
        hashes = (hashes ^ (hashes >> np.uint64(32))) * _MIX + owners.astype(np.uint64) * _OWNER
        return (hashes ^ (hashes >> np.uint64(29))) * _MIX

    def _equal(self, spans: np.ndarray, hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether spans ``a`` and ``b`` agree in owner, length, hash and every byte."""
        same = (hashes[a] == hashes[b]) & (spans[a, 1] == spans[b, 1]) & (spans[a, 2] == spans[b, 2])
        rows, at = np.flatnonzero(same), 0
        while len(rows):
            rest = spans[a[rows], 1] - at
            if at >= 256:
                # the few long words, each at once
                for i in rows.tolist():
                    x, y, n = spans[a[i], 0], spans[b[i], 0], spans[a[i], 1]
                    same[i] = np.array_equal(self.buffer[x : x + n], self.buffer[y : y + n])
                break
            # of the last word of eight bytes only the bytes of the span count
            unused = (8 * (8 - np.minimum(rest, 8))).astype(np.uint64)
            unlike = ((self.words[spans[a[rows], 0] + at] ^ self.words[spans[b[rows], 0] + at]) << unused) != 0
            same[rows[unlike]] = False
            rows = rows[~unlike & (rest > 8)]
            at += 8
        return same

    def _place(self, spans: np.ndarray, hashes: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Put the spans numbered ``new`` into the table; those that were not there yet, and their places."""
        mask = len(self.table) - 1
        slots = (hashes[new] & np.uint64(mask)).astype(np.int64)
        added, places = [], []
        while len(new):
            free = self.table[slots] < 0
            # of equal places the last writer stays; the others meet it as held
            self.table[slots[free]] = new[free]
            held = self.table[slots]
            mine = held == new
            added.append(new[mine])
            places.append(slots[mine])
            new, slots, held = new[~mine], slots[~mine], held[~mine]
            other = ~self._equal(spans, hashes, new, held)
            new, slots = new[other], (slots[other] + 1) & mask
        return np.concatenate([*added, np.empty(0, np.int64)]), np.concatenate([*places, np.empty(0, np.int64)])

    def insert(self, starts: np.ndarray, ends: np.ndarray, owners: np.ndarray) -> np.ndarray:
        """Owners of the spans that the table did not hold yet, one for each; starts ascend, spans do not overlap."""
        if not len(starts):
            return owners
        known = len(self.spans)
        spans = np.concatenate([self.spans, np.c_[starts, ends - starts, owners]])
        hashes = np.concatenate([self.hashes, self._hash(starts, ends, owners)])
        if 2 * len(spans) > len(self.table):
            self.table = np.full(1 << (4 * len(spans) - 1).bit_length(), -1, np.int64)
            self._place(spans, hashes, np.arange(known))
        added, places = self._place(spans, hashes, np.arange(known, len(spans)))
        self.table[places] = known + np.arange(len(added))
        self.spans = np.concatenate([self.spans, spans[added]])
        self.hashes = np.concatenate([self.hashes, hashes[added]])
        return spans[added, 2]


def _groups(texts: list[bytes], size: int) -> Iterator[list[bytes]]:
    """Neighbouring texts of about ``size`` bytes together; a longer one comes alone."""
    group: list[bytes] = []
    held = 0
    for text in texts:
        if group and held + len(text) > size:
            yield group
            group, held = [], 0
        group.append(text)
        held += len(text) + 1
    if group:
        yield group


def _cuts(buffer: np.ndarray, n: int, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of about ``size`` bytes, each of which ends behind a blank; the last byte of all is one."""
    start = 0
    while start < n:
        end = min(n, start + size)
        while NEXT[buffer[end - 1]] != BETWEEN:
            blanks = np.flatnonzero(NEXT[buffer[end : min(n, end + size)]] == BETWEEN)
            end = end + int(blanks[0]) + 1 if len(blanks) else min(n, end + size)
        yield start, end
        start = end


def measure(texts: list[bytes], slice_bytes: int = SLICE_BYTES) -> np.ndarray:
    """Rows (words, distinct words, capitals, code points, symbols), one for each text."""
    return np.concatenate([np.empty((0, 5), np.int64), *[_measure_group(g, slice_bytes) for g in _groups(texts, slice_bytes)]])


def _measure_group(texts: list[bytes], slice_bytes: int) -> np.ndarray:
    n = sum(map(len, texts)) + len(texts)
    buffer = np.frombuffer(b" ".join([*texts, b" " * 7]), np.uint8)
    begins = np.cumsum([0, *[len(t) + 1 for t in texts]])[:-1]
    out = np.zeros((len(texts), 5), np.int64)
    out[:, 3] = -1  # the blank behind the text
    spans = SpanTable(buffer)
    for low, high in _cuts(buffer, n, slice_bytes):
        part = buffer[low:high]
        states = np.empty(len(part), np.uint8)
        # both a slice and a text begin between words, as a blank stands before them
        states[0] = BETWEEN
        np.take(NEXT, part[:-1], out=states[1:])
        shown = EMIT.ravel()[(states.astype(np.uint16) << 8) | part]
        starts = np.flatnonzero(shown & BEGINS) + low
        ends = np.flatnonzero(shown & ENDED) + low
        # texts with bytes in this slice
        first = int(np.searchsorted(begins, low, "right")) - 1
        last = int(np.searchsorted(begins, high, "left"))
        at = np.maximum(begins[first:last] - low, 0)
        for column, bit in ((2, CAPITAL), (3, POINT), (4, SYMBOL)):
            out[first:last, column] += np.add.reduceat((shown & bit) != 0, at, dtype=np.int64)
        owners = np.searchsorted(begins, starts, "right") - 1
        out[:, 0] += np.bincount(owners, minlength=len(texts))
        out[:, 1] += np.bincount(spans.insert(starts, ends, owners), minlength=len(texts))
    return out


MEASURES = T.StructType([T.StructField(n, T.LongType()) for n in ("n_words", "n_distinct", "n_capitals", "n_points", "n_symbols")])


def measured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns and the measures of every whole text; no shuffle."""
    settle(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        found = measure([t or b"" for t in raw_texts(batch)])
        return {f.name: found[:, i].tolist() for i, f in enumerate(MEASURES.fields)}

    return per_batch(docs.select(*keep, "text"), run, MEASURES, keep)


def conditions() -> dict[str, Column]:
    """When a document fails each filter that looks at its own text."""
    words = F.col("n_words")
    return {
        "A": words < 200,
        "B": 100 * F.col("n_distinct") < 50 * words,
        "C": 100 * F.col("n_capitals") > 3 * F.col("n_points"),
        "D": F.col("n_symbols") > 0,
    }


def own_failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, digest, own) of every row: bit i of ``own`` is set if filter i fails the text by itself."""
    narrow = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce("lang", F.lit("")).alias("part"),
        F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"),
        "text",
    )
    found = measured(narrow, ["doc_id", "part", "digest"])
    bits = sum((F.when(failed, 1 << FILTERS.index(name)).otherwise(0) for name, failed in conditions().items()), F.lit(0))
    return found.select("doc_id", "part", "digest", bits.alias("own"))


def labelled(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """``failed`` with columns good and toxic."""
    known = (
        labels.where("quality = 1 OR toxic = 1")
        .groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
        .agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    )
    found = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    return failed.join(known, "doc_id", "left").select(*failed.columns, *found)


def counts(rows: DataFrame) -> DataFrame:
    """Number of documents, and of good and toxic ones, by (part, mask), copies of smaller ids found on the way.

    All copies of a text fail the same filters of their own, so they are counted, not joined: of a text only the
    rows of its smallest id pass. Rows are combined before each shuffle, so very many copies are a few rows.
    """
    alike = ["digest", "part", "own", "good", "toxic"]
    by_id = rows.groupBy(*alike, "doc_id").agg(F.count(F.lit(1)).alias("n"))
    # of a NULL id no smaller one is known, so its rows stand apart
    groups = by_id.groupBy(*alike, F.col("doc_id").isNull().alias("free")).agg(
        F.sum("n").alias("n"), F.min(F.struct("doc_id", "n")).alias("first")
    )
    # a text has at most eight of these rows for each part
    smallest = F.min("first.doc_id").over(Window.partitionBy("digest"))
    passing = F.when(F.col("free"), F.col("n")).when(F.col("first.doc_id") == F.col("smallest"), F.col("first.n")).otherwise(0)
    told = groups.withColumn("smallest", smallest).withColumn("passing", passing)
    copied = F.col("own") + (1 << FILTERS.index("E"))
    masks = F.array(
        F.struct(F.col("own").alias("mask"), F.col("passing").alias("m")),
        F.struct(copied.alias("mask"), (F.col("n") - F.col("passing")).alias("m")),
    )
    return (
        told.select("part", "good", "toxic", F.inline(masks))
        .where("m > 0")
        .groupBy("part", "mask")
        .agg(
            F.sum("m").alias("n"),
            F.sum(F.when(F.col("good"), F.col("m")).otherwise(0)).alias("n_good"),
            F.sum(F.when(F.col("toxic"), F.col("m")).otherwise(0)).alias("n_toxic"),
        )
    )


def _bit(order: Column, i: Column) -> Column:
    """The bit of the i-th filter (from 1) of an order."""
    return F.pow(F.lit(2), F.ascii(order.substr(i, F.lit(1))) - ord("A")).cast("int")


def audit(masks: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step, from counts by (part, mask)."""
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    steps = F.array(*[F.lit(i) for i in range(1, len(FILTERS) + 1)])
    rows = (
        masks.select("*", F.explode(orders).alias("filter_order"))
        .select("*", F.explode(steps).alias("step"))
        .withColumn("bit", _bit(F.col("filter_order"), F.col("step")))
        .withColumn(
            "earlier",
            sum((F.when(F.col("step") > i, _bit(F.col("filter_order"), F.lit(i))).otherwise(0) for i in range(1, len(FILTERS))), F.lit(0)),
        )
    )
    mask, n = F.col("mask"), F.col("n")
    fails = mask.bitwiseAND(F.col("bit")) != 0
    gone = mask.bitwiseAND(F.col("earlier")) != 0
    here = fails & ~gone

    def total(when: Column, what: Column = n) -> Column:
        return F.sum(F.when(when, what).otherwise(0)).cast("bigint")

    # of all orders, a document is removed by each filter that it fails equally often
    share = F.lit(len(list(permutations(FILTERS)))) / F.greatest(F.bit_count("mask"), F.lit(1))
    return rows.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~gone).alias("kept"),
        total(here).alias("removed"),
        total(fails & gone).alias("redundant"),
        total(mask == F.col("bit")).alias("unique_fails"),
        total(here, F.col("n_good")).alias("good_lost"),
        total(here, F.col("n_toxic")).alias("toxic_lost"),
        total(fails, n * share.cast("bigint")).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of all documents, by their lang."""
    # texts are read once; what follows reads some sixty bytes a document
    return audit(counts(labelled(stored(own_failures(docs), "filters"), labels)))


SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
words AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM docs),
failed AS (
  SELECT doc_id, part,
    CASE WHEN len(w) < 200 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN first < doc_id THEN 16 ELSE 0 END AS mask
  FROM words),
known AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
docs_of AS (
  SELECT part, mask, coalesce(good, FALSE) AS good, coalesce(toxic, FALSE) AS toxic FROM failed LEFT JOIN known USING (doc_id)),
letters(f, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps AS (
  SELECT filter_order, step, l.bit,
    coalesce((SELECT sum(p.bit) FROM letters p WHERE position(p.f IN filter_order) < step), 0)::BIGINT AS earlier
  FROM orders, generate_series(1, 5) s(step) JOIN letters l ON l.f = substr(filter_order, step, 1)),
masks AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic
  FROM docs_of GROUP BY part, mask),
audit AS (
  SELECT part, filter_order, step::INTEGER AS step, bit,
    sum(CASE WHEN mask & bit = 0 AND mask & earlier = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN mask & bit <> 0 AND mask & earlier = 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN mask & bit <> 0 AND mask & earlier <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN mask & bit <> 0 AND mask & earlier = 0 THEN n_good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN mask & bit <> 0 AND mask & earlier = 0 THEN n_toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM masks, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM audit
"""
