"""Benchmark decontamination: Wu-Manber search for word windows of the benchmark in the documents.

A pattern is a window of ``window`` consecutive item words (a shorter item is one window). For the
windows of one length, a shift table over blocks of two words tells how far the search may skip from
where it stands; where it may not skip, a bucket chosen by the last two words lists the windows to
compare directly. Documents are never shuffled: every partition scans its own whole texts.

The benchmark is a stated query set. It is cut into batches of bounded size; each batch is broadcast
and scanned in a pass of its own, and what a document was hit by travels with its row, so neither a
large benchmark nor a hot passage makes a large broadcast, a join or a group.

Defined results: a NULL or empty text has no words and is clean; a NULL item text has no windows;
items with a NULL id count as one item named by the empty string; repeated items count once by id;
repeated documents are judged row by row; an empty benchmark hits nothing. Other columns of either
table are ignored, or carried along untouched where ``keep`` names them.
"""

from __future__ import annotations

import hashlib
from array import array
from collections import defaultdict

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronograin.llm.common import alnum_words, per_batch, raw_texts

WINDOW = 10
# bytes of benchmark text in one broadcast
BATCH_BYTES = 4 << 20


class Lookup:
    """Wu-Manber tables for windows of one length."""

    def __init__(self, length: int) -> None:
        self.length = length
        self.block = min(2, length)
        # how far the search may move when it meets a block that no window holds
        self.skip = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], list[list[bytes]]] = defaultdict(list)
        self.owners: dict[tuple[bytes, ...], set[str]] = defaultdict(set)

    def add(self, words: list[bytes], item: str) -> None:
        owners = self.owners[tuple(words)]
        if not owners:
            self.buckets[tuple(words[-self.block :])].append(words)
            for end in range(self.block, self.length + 1):
                block = tuple(words[end - self.block : end])
                self.shift[block] = min(self.length - end, self.shift.get(block, self.skip))
        owners.add(item)

    def scan(self, words: list[bytes], spans: list[tuple[int, int]], items: set[str]) -> None:
        """Append the (start, end) of every occurring window and add the items it belongs to."""
        length, block, skip, shift = self.length, self.block, self.skip, self.shift
        end, n = length, len(words)
        while end <= n:
            key = (words[end - 2], words[end - 1]) if block == 2 else (words[end - 1],)
            step = shift.get(key, skip)
            if step:
                end += step
                continue
            here = words[end - length : end]
            for window in self.buckets[key]:
                if window == here:
                    spans.append((end - length, end))
                    items |= self.owners[tuple(window)]
            end += 1


def build(items: list[tuple[str, bytes]], window: int) -> list[Lookup]:
    """One set of tables for each window length that occurs."""
    tables: dict[int, Lookup] = {}
    for item, text in items:
        words = alnum_words(text)
        length = min(window, len(words))
        if length:
            lookup = tables.setdefault(length, Lookup(length))
            for start in range(len(words) - length + 1):
                lookup.add(words[start : start + length], item)
    return list(tables.values())


_built: tuple[list, list[Lookup]] = ([], [])


def _tables(items: Broadcast, window: int) -> list[Lookup]:
    """The tables of a broadcast batch, built once in each Python worker; only the last batch's stay."""
    global _built
    if _built[0] is not items.value:
        _built = (items.value, build(items.value, window))
    return _built[1]


def _union_length(spans: list[tuple[int, int]]) -> int:
    total, upto = 0, 0
    for start, end in sorted(spans):
        total += max(0, end - max(start, upto))
        upto = max(upto, end)
    return total


_STATE = T.StructType(
    [T.StructField("_spans", T.BinaryType()), T.StructField("_items", T.ArrayType(T.StringType()))]
)
RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("n_items", T.LongType()),
        T.StructField("items_sha256", T.StringType()),
        T.StructField("contaminated", T.BooleanType()),
    ]
)


def batches(benchmark: DataFrame, batch_bytes: int = BATCH_BYTES) -> list[list[tuple[str, bytes]]]:
    """Item ids (as text) and texts in batches of about ``batch_bytes``, one collected after the other."""
    items = benchmark.where(F.col("text").isNotNull()).select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
        F.col("text").cast("binary").alias("text"),
    )
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(size // batch_bytes) + 1
    batch = F.pmod(F.xxhash64("item", "text"), F.lit(n))
    return [[(r["item"], bytes(r["text"])) for r in items.where(batch == i).collect()] for i in range(n)]


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    batch_bytes: int = BATCH_BYTES,
    keep: list[str] | None = None,
) -> DataFrame:
    """``keep`` columns of each document row with n_words, n_hit, n_items, items_sha256, contaminated."""
    keep = ["doc_id"] if keep is None else keep
    spark = docs.sparkSession
    parts = batches(benchmark, batch_bytes)
    carried = docs.select(*dict.fromkeys([*keep, "text"]))
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        carried = _pass(carried, spark.sparkContext.broadcast(part), window, i == 0, last, keep)
    return carried


def _pass(
    docs: DataFrame, items: Broadcast, window: int, first: bool, last: bool, keep: list[str]
) -> DataFrame:
    def scan(batch: pa.RecordBatch) -> dict[str, list]:
        tables = _tables(items, window)
        before = None if first else batch.select(["_spans", "_items"]).to_pylist()
        out: dict[str, list] = defaultdict(list)
        for i, text in enumerate(raw_texts(batch)):
            words = alnum_words(text)
            flat = array("q", b"" if before is None else before[i]["_spans"])
            spans = list(zip(flat[::2], flat[1::2], strict=True))
            found = set() if before is None else set(before[i]["_items"])
            for lookup in tables:
                lookup.scan(words, spans, found)
            if last:
                n_hit = _union_length(spans)
                out["n_words"].append(len(words))
                out["n_hit"].append(n_hit)
                out["n_items"].append(len(found))
                out["items_sha256"].append(hashlib.sha256(",".join(sorted(found)).encode()).hexdigest())
                out["contaminated"].append(n_hit > 0)
            else:
                out["_spans"].append(array("q", [x for s in spans for x in s]).tobytes())
                out["_items"].append(sorted(found))
        return {f.name: out[f.name] for f in (RESULT if last else _STATE).fields}

    kept = keep if last else list(dict.fromkeys([*keep, "text"]))
    return per_batch(docs, scan, RESULT if last else _STATE, kept)


SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS row_no, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
  FROM documents
),
b AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
  FROM benchmark WHERE text IS NOT NULL
),
w AS (
  SELECT DISTINCT item, least(len(words), {WINDOW}) AS n, array_to_string(words[s : s + least(len(words), {WINDOW}) - 1], ' ') AS win
  FROM (SELECT item, words, unnest(range(1, len(words) - least(len(words), {WINDOW}) + 2)) AS s FROM b WHERE len(words) > 0)
),
p AS (
  SELECT row_no, s, n, array_to_string(words[s : s + n - 1], ' ') AS win
  FROM (SELECT row_no, words, n, unnest(range(1, len(words) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM w) WHERE len(words) >= n)
),
f AS (SELECT row_no, s, p.n, item FROM p JOIN w USING (n, win)),
h AS (SELECT row_no, count(DISTINCT place) AS n_hit FROM (SELECT row_no, unnest(range(s, s + n)) AS place FROM f) GROUP BY row_no),
i AS (SELECT row_no, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row_no, item FROM f) GROUP BY row_no)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (row_no) LEFT JOIN i USING (row_no)
"""
