"""Periodic runs of words: maximal stretches that repeat with a period, found by recursive frequency splitting.

A run is a stretch of consecutive words with smallest period q and length of at least ``max(shortest, 2 * q)`` that no
neighbouring word extends. It holds each of its words at least twice, as every position has an equal word q before
or q behind within the run. So a word that occurs once within a segment belongs to no run of the segment and splits it;
the parts are split again by words that occur once within them, until nothing changes or a part is too short.
The positions of the equal words before and behind decide "once within a segment" in one comparison, and a segment is
searched from both ends at once, so a split costs the smaller part and the whole recursion n log n.

Surviving segments are scanned by lag. Short lags compare the segment with itself. A run of a longer lag q has q
equal pairs in a row, so one of them starts at a multiple of q: only these are looked at (m log m in all), and those
that match are extended to both sides through names of blocks of 2^k words. A stretch found at several lags keeps the
smallest, since by the periodicity lemma the smallest period of a stretch divides every lag it is found at.

Defined results: NULL, empty and blank texts have no words and no runs; a NULL id counts as an id that plants nothing;
rows are taken one by one, so ties, repeated ids and rows are no matter; of runs of equal length the one that starts first is
reported, then the smaller period; a text of any length is scanned whole; an empty table gives no rows; other columns
are ignored unless named in ``keep``, whatever they are called.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from chronograin.llm.common import per_batch, raw_texts, settle

SHORTEST = 12
# lags up to this one, or up to the root of the segment's length, compare the whole segment with itself
SHORT_LAGS = 64
# matching pairs that are extended at once
PAIRS = 1 << 19


def word_codes(words: list[bytes]) -> np.ndarray:
    """A number for each word, equal for equal words."""
    codes: defaultdict[bytes, int] = defaultdict()
    codes.default_factory = codes.__len__
    return np.fromiter(map(codes.__getitem__, words), np.int64, len(words))


def planted(n: int, doc_id: int | None) -> np.ndarray | None:
    """Which original word stands at each of ``n`` places of a document that gets a planted run; None for all others."""
    hashed = 0 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if doc_id is None or hashed % 10 or not n:
        return None
    g = hashed // 10
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    return np.r_[np.arange(a), a + np.arange(n - a) % period]


def surviving_segments(codes: np.ndarray, shortest: int = SHORTEST) -> list[tuple[int, int]]:
    """Segments ``[lo, hi)`` in which every word occurs twice at least; all runs lie within them."""
    n = len(codes)
    if n < shortest:
        return []
    # the first round counts over the whole text
    once = np.flatnonzero(np.bincount(codes)[codes] == 1)
    starts, ends = np.r_[0, once + 1], np.r_[once, n]
    wide = ends - starts >= shortest
    if not wide.any():
        return []
    order = np.argsort(codes, kind="stable")
    alike = codes[order[1:]] == codes[order[:-1]]
    before, behind = np.full(n, -1, np.int64), np.full(n, n, np.int64)
    before[order[1:][alike]] = order[:-1][alike]
    behind[order[:-1][alike]] = order[1:][alike]
    stack = list(zip(starts[wide].tolist(), ends[wide].tolist(), strict=True))
    before, behind = before.tolist(), behind.tolist()
    found = []
    while stack:
        lo, hi = stack.pop()
        left, right = lo, hi - 1
        while left <= right:
            if before[left] < lo and behind[left] >= hi:
                split = left
                break
            if before[right] < lo and behind[right] >= hi:
                split = right
                break
            left += 1
            right -= 1
        else:
            found.append((lo, hi))
            continue
        if split - lo >= shortest:
            stack.append((lo, split))
        if hi - split - 1 >= shortest:
            stack.append((split + 1, hi))
    return found


def _block_names(s: np.ndarray) -> list[np.ndarray]:
    """For each k the names of all blocks of 2^k words: equal names for equal blocks."""
    names = [np.unique(s, return_inverse=True)[1].astype(np.int32)]
    size = 1
    while 2 * size <= len(s):
        last = names[-1]
        pairs = last[:-size].astype(np.int64) * (int(last.max()) + 1) + last[size:]
        names.append(np.unique(pairs, return_inverse=True)[1].astype(np.int32))
        size *= 2
    return names


def _extend(names: list[np.ndarray], at: np.ndarray, lag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the equal pairs in a row around each pair (at, at + lag)."""
    n = len(names[0])
    start, end = at.copy(), at.copy()
    for k in range(len(names) - 1, -1, -1):
        size, name = 1 << k, names[k]
        inside = end + lag + size <= n
        i = np.where(inside, end, 0)
        end += np.where(inside & (name[i] == name[np.where(inside, i + lag, 0)]), size, 0)
        inside = start >= size
        i = np.where(inside, start - size, 0)
        start -= np.where(inside & (name[i] == name[np.where(inside, i + lag, 0)]), size, 0)
    return start, end


def lag_scan(s: np.ndarray, shortest: int = SHORTEST) -> np.ndarray:
    """All runs of a segment as rows (start, length, period), by start and period."""
    m = len(s)
    found: list[np.ndarray] = []
    direct = min(m // 2, max(SHORT_LAGS, math.isqrt(m)))
    for q in range(1, direct + 1):
        unequal = np.flatnonzero(s[q:] != s[:-q])
        ends = np.append(unequal, m - q)
        starts = np.r_[0, unequal + 1]
        long = ends - starts >= max(shortest - q, q)
        if long.any():
            found.append(np.c_[starts[long], ends[long] - starts[long] + q, np.full(long.sum(), q)])
    names = None
    for k in range(m // (direct + 1)):
        # pairs (k * q, k * q + q) of all longer lags
        lags = np.arange(direct + 1, min(m // 2, (m - 1) // (k + 1)) + 1)
        lags = lags[s[k * lags] == s[(k + 1) * lags]]
        for i in range(0, len(lags), PAIRS):
            names = _block_names(s) if names is None else names
            lag = lags[i : i + PAIRS]
            start, end = _extend(names, k * lag, lag)
            length = end - start + lag
            long = (length >= shortest) & (length >= 2 * lag)
            found.append(np.c_[start[long], length[long], lag[long]])
    if not found:
        return np.empty((0, 3), np.int64)
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(1)
    runs = runs[first]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def runs_of(codes: np.ndarray, shortest: int = SHORTEST) -> np.ndarray:
    """All runs of a text's words, given as numbers: rows (start, length, period) by start and period."""
    parts = [lag_scan(codes[lo:hi], shortest) + np.array([lo, 0, 0]) for lo, hi in sorted(surviving_segments(codes, shortest))]
    return np.concatenate(parts) if parts else np.empty((0, 3), np.int64)


def repeated(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of ``n`` words some run holds behind its first period."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
    np.add.at(steps, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(steps[:-1]) > 0


FIELDS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("runs", T.ArrayType(T.ArrayType(T.LongType()))),
        T.StructField("collapsed", T.StringType()),
    ]
)


def _scan(text: bytes | None, doc_id: int | None, plant: bool, shortest: int) -> tuple[int, np.ndarray, bytes]:
    """Number of words, runs, and the text without what runs repeat."""
    words = (text or b"").split()
    codes = word_codes(words)
    source = planted(len(words), doc_id) if plant else None
    if source is not None:
        codes = codes[source]
    runs = runs_of(codes, shortest)
    if source is None and not len(runs):
        return len(words), runs, b" ".join(words)
    kept = np.flatnonzero(~repeated(len(words), runs))
    kept = kept if source is None else source[kept]
    return len(words), runs, b" ".join([words[i] for i in kept.tolist()])


def periodic_runs(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), shortest: int = SHORTEST) -> DataFrame:
    """``keep`` columns, n_words, all runs as [start, length, period], and the text without repetitions; no shuffle."""
    settle(docs.sparkSession)

    def scan(batch: pa.RecordBatch) -> dict[str, list]:
        rows = [_scan(text, None, False, shortest) for text in raw_texts(batch)]
        return {
            "n_words": [n for n, _, _ in rows],
            "runs": [runs.tolist() for _, runs, _ in rows],
            "collapsed": [text.decode() for _, _, text in rows],
        }

    return per_batch(docs.select(*keep, "text"), scan, FIELDS, list(keep))


DIGEST_FIELDS = T.StructType(
    [
        *[T.StructField(name, T.LongType()) for name in ("n_runs", "start", "length", "period", "exponent_milli")],
        *[T.StructField(name, T.StringType()) for name in ("runs_sha256", "collapsed_sha256")],
    ]
)


def run_digests(docs: DataFrame, plant: bool = True, shortest: int = SHORTEST) -> DataFrame:
    """One row per row of ``docs``: number of runs, the longest one, and digests of all runs and of the collapsed text.

    With ``plant`` one document of ten, by its id, is scanned with a run planted into it.
    """
    settle(docs.sparkSession)

    def digest(batch: pa.RecordBatch) -> dict[str, list]:
        made: dict[str, list] = {f.name: [] for f in DIGEST_FIELDS.fields}
        ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
        for doc_id, text in zip(ids, raw_texts(batch), strict=True):
            _, runs, collapsed = _scan(text, doc_id, plant, shortest)
            made["n_runs"].append(len(runs))
            best = [None] * 4
            if len(runs):
                start, length, period = min(runs.tolist(), key=lambda r: (-r[1], r[0], r[2]))
                best = [start, length, period, 1000 * length // period]
            for name, value in zip(("start", "length", "period", "exponent_milli"), best, strict=True):
                made[name].append(value)
            lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs.tolist())
            made["runs_sha256"].append(hashlib.sha256(lines.encode()).hexdigest())
            made["collapsed_sha256"].append(hashlib.sha256(collapsed).hexdigest())
        return made

    return per_batch(docs.select("doc_id", "text"), digest, DIGEST_FIELDS, ["doc_id"])
