"""Brown class-based bigrams: P(word | word before) = P(class | class before) P(word | class).

1. Words of all training documents are counted, without bound.
2. A first clustering in the driver: the ``FREQUENT`` first words are units, every other word belongs to one of
   ``SHAPES`` units by its last three bytes. Exchange clustering moves one unit at a time to the class that gains most
   likelihood, until none moves.
3. Every other word then moves on its own: the classes of the words before and after it are counted over all training
   documents, and it goes to the class that gains most, against the table of class bigrams, in ``REFINED`` rounds at
   most. Words of a round move at once, so the table is counted anew, and a round that lost likelihood is dropped.
4. The end of a document is a class of its own, which also stands before the first word. A document's score is the sum
   of log10 of class transitions and word emissions. Emissions add ``ALPHA`` to every count and keep one slot in each
   class for all unseen words, so they sum to 1; transitions are interpolated with the share of the class. A word that
   no training document holds has no bigrams; it takes the class of its unit of step 2.

A bounded number of the most frequent words is broadcast with counts and classes; the classes and counts of all others
stay in a table, one row a word with its neighbours, and are joined. No word's rows meet in one place, as words beyond
the broadcast ones are rare.

Defined results: NULL and empty texts hold the end token alone; a document without id is not held
out; repeated rows are scored, and trained on, each; with no training document every count and N are 0;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronograin.llm.common import held_out, raw_texts, settle, space_words, stored

FOLDS = 7
HELD_FOLD = 2
# words that are a unit of their own in the first clustering, and units that the other words share there
FREQUENT = 600
SHAPES = 400
CLASSES = 64
ROUNDS = 12
# rounds in which all words move
REFINED = 2
# broadcast words whose neighbours are added up together
BLOCK = 64
ALPHA = 0.5
# weight of a class's share among the transitions
PRIOR = 5.0
# words whose counts are broadcast: about 20 bytes each
KNOWN_WORDS = 150_000
# distinct words that a task counts, or remembers, before it hands them on, or forgets them
HELD_WORDS = 250_000


def shape(word: bytes) -> int:
    return crc32(word[-3:]) % SHAPES


def count_words(train: DataFrame) -> DataFrame:
    """(word, n): counts of all words, lower-cased, of the documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            words, ns = list(found), list(found.values())
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(ns, pa.int64())], ["word", "n"])

        for batch in batches:
            for text in raw_texts(batch):
                found.update(space_words(text))
                if len(found) > HELD_WORDS:
                    yield out()
                    found.clear()
        if found:
            yield out()

    return train.select("text").mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, most: int = KNOWN_WORDS) -> list[tuple[bytes, int]]:
    """At most ``most`` words with their counts, the most frequent ones."""
    # a few hundred bins at most: counts by their logarithm
    bins = counts.groupBy(F.floor(F.log2("n") * 8).alias("bin")).agg(F.count(F.lit(1)).alias("k")).collect()
    total, least = 0, None
    for row in sorted(bins, key=lambda r: -r["bin"]):
        total += row["k"]
        if total > most:
            break
        least = row["bin"]
    if least is None:
        return []
    rows = counts.where(F.floor(F.log2("n") * 8) >= least).collect()
    return sorted(((bytes(r["word"]), r["n"]) for r in rows), key=lambda x: (-x[1], x[0]))


class _Codes(dict):
    """Number of each known word; -1 - unit for the others, remembered up to a bound."""

    def __init__(self, words: list[bytes], frequent: int) -> None:
        super().__init__({w: i for i, w in enumerate(words)})
        self.frequent, self.known = frequent, len(words)

    def __missing__(self, word: bytes) -> int:
        code = -1 - (self.frequent + shape(word))
        if len(self) < self.known + HELD_WORDS:
            self[word] = code
        return code


_LINES = "row bigint, doc_id bigint, held boolean, codes binary, rare array<binary>"


def encode(docs: DataFrame, words: list[bytes]) -> DataFrame:
    """Documents (doc_id, held, text) as numbers, parsed once: int32 ``codes`` in a string of bytes, and the words that
    ``words`` lacks, in order, each standing in the codes as -1 - its unit."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes(shared.value, len(shared.value))
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            lines, rare = [], []
            for text in raw_texts(batch):
                tokens = space_words(text)
                ids = np.fromiter(map(codes.__getitem__, tokens), dtype=np.int32, count=len(tokens))
                lines.append(ids.tobytes())
                rare.append([tokens[i] for i in np.flatnonzero(ids < 0).tolist()])
            rows = pa.array(np.arange(row, row + len(lines)), pa.int64())
            row += len(lines)
            arrays = [rows, batch.column(0), batch.column(1), pa.array(lines, pa.binary()), pa.array(rare, pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in _LINES.split(", ")])

    return stored(docs.select("doc_id", "held", "text").mapInArrow(read, _LINES), "lm-lines")


def _line(codes: pa.Array, end: int) -> np.ndarray:
    """Codes of all documents of a batch; one end stands before the first, between two, and after the last."""
    mark = np.int32(end).tobytes()
    return np.frombuffer(mark + mark.join(codes.to_pylist()) + mark, dtype=np.int32)


def count_bigrams(lines: DataFrame, words: list[bytes], frequent: int) -> np.ndarray:
    """Bigrams of units over all documents, each between two ends; the first ``frequent`` words are units of their own."""
    known, units = len(words), frequent + SHAPES + 1
    of = np.array([*range(frequent), *[frequent + shape(w) for w in words[frequent:]], units - 1], dtype=np.int64)
    shared = lines.sparkSession.sparkContext.broadcast(of)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, found = shared.value, np.zeros(units * units, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                line = _line(batch.column(0), known)
                ids = np.where(line < 0, frequent - 1 - known - line, of[np.maximum(line, 0)])
                np.add.at(found, ids[:-1] * units + ids[1:], np.int64(1))
        pairs = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(found[pairs])], ["pair", "n"])

    rows = lines.select("codes").mapInArrow(count, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(units * units)
    # at most units * units rows
    out[rows.column("pair").to_numpy()] = rows.column("n").to_numpy()
    return out.reshape(units, units)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(pairs: np.ndarray, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """Class of each unit: exchange clustering by the likelihood of class bigrams.

    The last unit, the end, is alone in the last class. Ties go to the lower class, so reruns agree.
    """
    units = len(pairs)
    order = np.argsort(-pairs[:, :-1].sum(0), kind="stable")
    free = classes - 1
    of = np.empty(units, dtype=np.int64)
    of[order] = np.arange(units - 1) % free
    of[-1] = free
    member = np.zeros((units, classes))
    member[np.arange(units), of] = 1
    table = member.T @ pairs @ member
    for _ in range(rounds):
        moved = 0
        for w in order:
            a = of[w]
            member[w, a] = 0
            out, into, own = pairs[w] @ member, pairs[:, w] @ member, pairs[w, w]
            if not out.any() and not into.any() and not own:
                member[w, a] = 1
                continue
            table[a] -= out
            table[:, a] -= into
            table[a, a] -= own
            sides = _xlogx(table)
            gain = (_xlogx(table + out) - sides).sum(1) + (_xlogx(table + into[:, None]) - sides).sum(0)
            diagonal, here = np.diag(table), np.diag(sides)
            gain += _xlogx(diagonal + out + into + own) - _xlogx(diagonal + out) - _xlogx(diagonal + into) + here
            rows, cols = table.sum(1), table.sum(0)
            gain -= _xlogx(rows + out.sum() + own) - _xlogx(rows) + _xlogx(cols + into.sum() + own) - _xlogx(cols)
            # counts of the other classes' sides change alike wherever the unit goes
            b = int(np.argmax(gain[:free]))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            table[b] += out
            table[:, b] += into
            table[b, b] += own
            member[w, b] = 1
            of[w] = b
            moved += b != a
        if not moved:
            break
    return of


def likelihood(table: np.ndarray) -> float:
    """Of class bigrams, up to what no clustering changes."""
    return float(_xlogx(table).sum() - _xlogx(table.sum(0)).sum() - _xlogx(table.sum(1)).sum())


def moves(table: np.ndarray, of: np.ndarray, word: np.ndarray, key: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The best class of each word, against a table that counts it in its class ``of``.

    ``n`` is how often ``word`` has the neighbour class ``key``; keys from ``CLASSES`` on are classes before it.
    """
    words = len(of)
    if not len(word):
        return of
    order = np.argsort(word, kind="stable")
    word, key, n = word[order], key[order], n[order].astype(float)
    # what the class of a row, of a column, has beside each class
    sides = np.vstack([table.T, table])
    base, own = sides[key], of[word]
    at = np.arange(len(word))
    change = _xlogx(base + n[:, None]) - _xlogx(sides)[key]
    here = base[at, own]
    change[at, own] = _xlogx(here) - _xlogx(np.maximum(here - n, 0))
    starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    gain = np.zeros((words, CLASSES))
    gain[word[starts]] = np.add.reduceat(change, starts)
    every = np.arange(words)
    for total, ahead in ((table.sum(1), key < CLASSES), (table.sum(0), key >= CLASSES)):
        mine = np.bincount(word, n * ahead, words)
        change = _xlogx(total + mine[:, None]) - _xlogx(total)
        change[every, of] = _xlogx(total[of]) - _xlogx(np.maximum(total[of] - mine, 0))
        gain -= change
    best = np.argmax(gain[:, : CLASSES - 1], axis=1)
    empty = np.flatnonzero(table[:-1].sum(1) + table[:, :-1].sum(0) == 0)
    if len(empty):
        # empty classes tie: words go to one of them by their most frequent neighbours, not all to the first
        main = np.lexsort((key, -n, word))[starts]
        strongest = np.zeros(words, dtype=np.int64)
        strongest[word[main]] = key[main]
        best = np.where(np.isin(best, empty), empty[strongest % len(empty)], best)
    return np.where(gain[every, best] > gain[every, of] + 1e-9, best, of)


class _Neighbours:
    """How often each broadcast word, and the end, has each class after and before it."""

    def __init__(self, words: int) -> None:
        self.counts = np.zeros((words + 1) * 2 * CLASSES, dtype=np.int32)

    def add(self, words: np.ndarray, classes: np.ndarray, before: bool) -> None:
        np.add.at(self.counts, words.astype(np.int64) * (2 * CLASSES) + (before * CLASSES + classes), np.int32(1))

    def out(self) -> Iterator[pa.RecordBatch]:
        width = BLOCK * 2 * CLASSES
        for first in range(0, len(self.counts), 64 * width):
            found = np.flatnonzero(self.counts[first : first + 64 * width]) + first
            if not len(found):
                continue
            blocks, starts = np.unique(found // width, return_index=True)
            offsets = pa.array(np.r_[starts, len(found)].astype(np.int32))
            lists = [pa.array((found % width).astype(np.int32)), pa.array(self.counts[found].astype(np.int64))]
            arrays = [pa.array(blocks.astype(np.int32)), *[pa.ListArray.from_arrays(offsets, x) for x in lists]]
            yield pa.RecordBatch.from_arrays(arrays, ["block", "keys", "ns"])


_BLOCKS = "block int, keys array<int>, ns array<bigint>"


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and value of each item of a column of lists."""
    return pc.list_parent_indices(column).to_numpy().astype(np.int64), column.flatten().to_numpy().astype(np.int64)


def _add_blocks(batch: pa.Table) -> pa.Table:
    keys, ns = (batch.column(c).combine_chunks().flatten().to_numpy() for c in ("keys", "ns"))
    sums = np.bincount(keys, ns, BLOCK * 2 * CLASSES)
    found = np.flatnonzero(sums)
    block = batch.column("block")[0].as_py()
    return pa.table({
        "block": pa.array([block], pa.int32()), "keys": pa.array([found.astype(np.int32)], pa.list_(pa.int32())),
        "ns": pa.array([sums[found].astype(np.int64)], pa.list_(pa.int64())),
    })


_RARE = "word binary, class int, n bigint, lefts array<int>, rights array<int>, nexts array<binary>"


def rare_words(lines: DataFrame, known: int, shapes: np.ndarray) -> DataFrame:
    """All words that are not broadcast: how often they occur, and the neighbours of all their places.

    ``lefts`` and ``rights`` number the broadcast ones, ``nexts`` are the others after it.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            line, words = _line(batch.column(0), known), batch.column(1).flatten()
            at = np.flatnonzero(line < 0)
            right = np.maximum(line[at + 1], -1)
            follower = pa.array(np.arange(1, len(at) + 1), pa.int64(), mask=right >= 0)
            arrays = [
                words, pa.array(-1 - line[at] - known, pa.int32()), pa.array(np.maximum(line[at - 1], -1), pa.int32()),
                pa.array(right, pa.int32()), words.take(follower),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["word", "shape", "l", "r", "next"])

    def known_only(c: str):
        return F.collect_list(F.when(F.col(c) >= 0, F.col(c)))

    seen = lines.select("codes", "rare").mapInArrow(read, "word binary, shape int, l int, r int, next binary")
    first = F.element_at(F.lit(shapes.tolist()), F.first("shape") + 1).cast("int")
    return stored(
        seen.groupBy("word").agg(
            first.alias("class"), F.count(F.lit(1)).alias("n"), known_only("l").alias("lefts"), known_only("r").alias("rights"),
            F.collect_list("next").alias("nexts"),
        ), "lm-classes",
    )


@dataclass(frozen=True)
class Clusters:
    # classes of the broadcast words and of the end
    of: np.ndarray
    rare: DataFrame
    table: np.ndarray
    blocks: DataFrame
    near: DataFrame


def tally(lines: DataFrame, of: np.ndarray, rare: DataFrame) -> Clusters:
    """Class bigrams of all training documents, and the neighbours of every word."""
    known, shared = len(of) - 1, lines.sparkSession.sparkContext.broadcast(of)

    def of_known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, found = shared.value, _Neighbours(known)
        for batch in batches:
            if batch.num_rows:
                line = _line(batch.column(0), known)
                a, b = line[:-1], line[1:]
                both = (a >= 0) & (b >= 0)
                a, b = a[both], b[both]
                found.add(a, of[b], False)
                found.add(b, of[a], True)
        yield from found.out()

    def of_rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Neighbours(known)
        for batch in batches:
            classes = batch.column(0).to_numpy().astype(np.int64)
            rows, lefts = _flat(batch.column(1))
            found.add(lefts, classes[rows], False)
            rows, rights = _flat(batch.column(2))
            found.add(rights, classes[rows], True)
        yield from found.out()

    sides = rare.select("class", "lefts", "rights")
    parts = lines.select("codes").mapInArrow(of_known, _BLOCKS).unionAll(sides.mapInArrow(of_rare, _BLOCKS))
    blocks = stored(parts.groupBy("block").applyInArrow(_add_blocks, _BLOCKS), "lm-blocks")
    pairs = rare.select("word", F.col("class").alias("a"), F.explode("nexts").alias("next"))
    near = stored(pairs.join(rare.select(F.col("word").alias("next"), F.col("class").alias("b")), "next"), "lm-near")

    def bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What stands before broadcast words."""
        of = shared.value
        table = np.zeros((CLASSES, CLASSES), dtype=np.int64)
        for batch in batches:
            rows, keys = _flat(batch.column(1))
            ns, (at, key) = _flat(batch.column(2))[1], np.divmod(keys, 2 * CLASSES)
            into = key >= CLASSES
            at = batch.column(0).to_numpy()[rows] * BLOCK + at
            np.add.at(table, (key[into] - CLASSES, of[at[into]]), ns[into])
        yield from _cells(table)

    def before_rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value
        table = np.zeros((CLASSES, CLASSES), dtype=np.int64)
        for batch in batches:
            rows, lefts = _flat(batch.column(1))
            np.add.at(table, (of[lefts], batch.column(0).to_numpy()[rows]), 1)
        yield from _cells(table)

    cells = blocks.mapInArrow(bigrams, _CELLS).unionAll(sides.mapInArrow(before_rare, _CELLS))
    cells = cells.unionAll(near.select("a", "b", F.lit(1).cast("bigint"))).groupBy("a", "b").agg(F.sum("n").alias("n"))
    table = np.zeros((CLASSES, CLASSES))
    # a row for each pair of classes at most
    for a, b, n in cells.collect():
        table[a, b] = n
    return Clusters(of, rare, table, blocks, near)


_CELLS = "a int, b int, n bigint"


def _cells(table: np.ndarray) -> Iterator[pa.RecordBatch]:
    a, b = np.nonzero(table)
    arrays = [pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(table[a, b])]
    yield pa.RecordBatch.from_arrays(arrays, ["a", "b", "n"])


def moved(clusters: Clusters) -> tuple[np.ndarray, DataFrame]:
    """All words in their best class."""
    shared = clusters.rare.sparkSession.sparkContext.broadcast((clusters.table, clusters.of))

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, of = shared.value
        for batch in batches:
            for block, keys, ns in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                word, key = np.divmod(np.array(keys), 2 * CLASSES)
                at = slice(block * BLOCK, (block + 1) * BLOCK)
                found = moves(table, of[at], word, key, np.array(ns)).astype(np.int8)
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([found.tobytes()], pa.binary())], ["block", "found"])

    of = clusters.of.copy()
    # a byte for each broadcast word
    for block, found in clusters.blocks.mapInArrow(known, "block int, found binary").collect():
        of[block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(bytes(found), dtype=np.int8)
    # so heavy that they cannot move at once: they keep the class that they found one at a time
    of[:FREQUENT], of[-1] = clusters.of[:FREQUENT], CLASSES - 1

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, of = shared.value
        for batch in batches:
            mine = batch.column(1).to_numpy().astype(np.int64)
            (a, lefts), (b, rights), (c, near) = (_flat(batch.column(i)) for i in (3, 4, 6))
            word, key = np.r_[a, b, c], np.r_[of[lefts] + CLASSES, of[rights], near]
            cells, n = np.unique(word * (2 * CLASSES) + key, return_counts=True)
            best = moves(table, mine, cells // (2 * CLASSES), cells % (2 * CLASSES), n)
            arrays = [batch.column(0), pa.array(best.astype(np.int32)), *[batch.column(i) for i in (2, 3, 4, 5)]]
            yield pa.RecordBatch.from_arrays(arrays, names)

    names = [c.split()[0] for c in _RARE.split(", ")]
    sides = clusters.near.select(F.inline(F.array(
        F.struct(F.col("word"), F.col("b").alias("key")), F.struct(F.col("next").alias("word"), (F.col("a") + CLASSES).alias("key"))
    )))
    near = sides.groupBy("word").agg(F.collect_list("key").alias("near"))
    joined = clusters.rare.join(near, "word", "left").select(*names, F.coalesce("near", F.lit([]).cast("array<int>")).alias("near"))
    return of, stored(joined.mapInArrow(rare, _RARE), "lm-classes")


@dataclass(frozen=True)
class Model:
    # broadcast words; each is a unit
    words: list[bytes]
    counts: np.ndarray
    frequent: int
    # class of each unit, of unseen words by their last bytes, of the end; log10 of transitions; log10 of what a
    # class's emissions are divided by
    of: np.ndarray
    transitions: np.ndarray
    divisors: np.ndarray
    tokens: int
    distinct: int
    ends: int


def cluster(train: DataFrame, counts: DataFrame) -> tuple[Model, DataFrame]:
    """The model of the training documents, whose word counts are given, and (word, class, n) of words not broadcast."""
    known = frequent_words(counts)
    lines = encode(train.select("doc_id", F.lit(False).alias("held"), "text"), [w for w, _ in known])
    return cluster_lines(lines, counts, known)


def cluster_lines(lines: DataFrame, counts: DataFrame, known: list[tuple[bytes, int]]) -> tuple[Model, DataFrame]:
    """As ``cluster``, of documents that are numbers already."""
    words, ns = [w for w, _ in known], np.array([n for _, n in known], dtype=np.int64)
    first = min(FREQUENT, len(words))
    seed = exchange(count_bigrams(lines, words, first))
    shapes = seed[first:-1]
    of = np.array([*seed[:first], *[shapes[shape(w)] for w in words[first:]], seed[-1]], dtype=np.int64)
    best = tally(lines, of, rare_words(lines, len(words), shapes))
    for _ in range(REFINED):
        found = tally(lines, *moved(best))
        if likelihood(found.table) <= likelihood(best.table):
            break
        best = found
    table = best.table
    share = (table.sum(0) + 1) / (table.sum() + CLASSES)
    transitions = np.log10((table + PRIOR * share) / (table.sum(1, keepdims=True) + PRIOR))
    total = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    ends = int(table[-1].sum())
    distinct = np.bincount(best.of[:-1], minlength=CLASSES).astype(float)
    distinct[-1] = 1.0 if ends else 0.0
    for c, v in best.rare.groupBy("class").count().collect():
        distinct[c] += v
    divisors = np.log10(table.sum(0) + ALPHA * (distinct + 1))
    n, v = (total["n"] or 0) + ends, total["v"] + (ends > 0)
    units = np.r_[best.of[:-1], shapes, best.of[-1]]
    return Model(words, ns, len(words), units, transitions, divisors, n, v, ends), best.rare.select("word", "class", "n")


def fit(train: DataFrame, counts: DataFrame) -> Model:
    return cluster(train, counts)[0]


_PARTS = (
    "row bigint, doc_id bigint, held boolean, n_tokens bigint, n_known bigint, plus_one double, plus_alpha double, classes double, "
    "rare array<binary>, at array<bigint>"
)


def score(docs: DataFrame, counts: DataFrame, model: Model, classes: DataFrame) -> DataFrame:
    """As ``score_lines``, of documents and the tables of word counts and of classes."""
    lines = encode(docs.select("doc_id", F.lit(False).alias("held"), "text"), model.words)
    return score_lines(lines, model, classes.select("word", "class").join(counts, "word"))


def score_lines(lines: DataFrame, model: Model, classes: DataFrame) -> DataFrame:
    """(doc_id, held, n_tokens, n_known, plus_one, logp): of every row, with the sum of log10(c + 1) and the model's log10.

    A word that is not broadcast is a number: its place, the class it has if unseen, and the classes before and after it
    (0 for a word that is not broadcast either), until the join adds its class.
    """
    shared = settle(lines.sparkSession).sparkContext.broadcast(model)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        end = len(m.words)
        of = np.r_[m.of[:end], m.of[-1]].astype(np.int64)
        counts = np.r_[m.counts, m.ends]
        plus_one, plus_alpha = np.log10(counts + 1.0), np.log10(counts + ALPHA)
        for batch in batches:
            if not batch.num_rows:
                continue
            line = _line(batch.column(3), end)
            lengths = pc.binary_length(batch.column(3)).to_numpy().astype(np.int64) // 4 + 1
            # places of the first word of each document, or its end, in line[1:]
            starts = np.r_[0, np.cumsum(lengths)[:-1]]
            ids = line[1:]
            seen, place = ids >= 0, np.maximum(ids, 0)
            cls = np.where(line < 0, -1, of[np.maximum(line, 0)])
            both = (cls[:-1] >= 0) & (cls[1:] >= 0)
            inner = np.where(both, m.transitions[cls[:-1], cls[1:]], 0.0) - np.where(seen, m.divisors[cls[1:]], 0.0)
            rare = np.flatnonzero(~seen)
            within = rare - starts[np.searchsorted(starts, rare, side="right") - 1]
            at = within << 26 | m.of[-1 - ids[rare]] << 20 | (cls[rare] + 1) << 13 | (cls[rare + 2] + 1) << 6
            offsets = np.r_[0, np.cumsum(pc.list_value_length(batch.column(4)).to_numpy())].astype(np.int32)
            sums = [np.add.reduceat(np.where(seen, x[place], 0.0), starts) for x in (plus_one, plus_alpha)]
            arrays = [
                *[batch.column(i) for i in range(3)], pa.array(lengths),
                pa.array(np.add.reduceat((seen & ((ids < end) | (m.ends > 0))).astype(np.int64), starts)),
                *[pa.array(x) for x in sums], pa.array(np.add.reduceat(inner, starts)), batch.column(4),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(at.astype(np.int64))),
            ]
            yield pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in _PARTS.split(", ")])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Transitions around the joined words, and what their emissions are divided by."""
        m: Model = shared.value
        for batch in batches:
            sums = []
            for ats in batch.column(1):
                at = np.sort(ats.values.to_numpy())
                mine, right, left = at & 63, (at >> 6 & 127) - 1, (at >> 13 & 127) - 1
                before = np.where(left < 0, np.r_[0, mine[:-1]], left)
                ended = right >= 0
                sums.append(m.transitions[before, mine].sum() + m.transitions[mine[ended], right[ended]].sum() - m.divisors[mine].sum())
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in (0, 2, 3, 4)], pa.array(sums, pa.float64())], names)

    parts = stored(lines.mapInArrow(read, _PARTS), "lm-parts")
    each = parts.select("row", F.inline(F.arrays_zip("rare", "at"))).withColumnRenamed("rare", "word")
    rare = each.join(classes, "word", "left")
    n = F.coalesce("n", F.lit(0))
    unseen = F.shiftright("at", 20).bitwiseAND(63)
    sums = rare.groupBy("row").agg(
        F.collect_list(F.col("at") + F.coalesce(F.col("class").cast("bigint"), unseen)).alias("at"),
        F.count("n").alias("r_known"), F.sum(F.log10(n + 1)).alias("r_one"), F.sum(F.log10(n + ALPHA)).alias("r_alpha"),
    )
    names = ["row", "r_known", "r_one", "r_alpha", "r_classes"]
    sums = sums.mapInArrow(link, "row bigint, r_known bigint, r_one double, r_alpha double, r_classes double")
    zero = F.lit(0.0)
    return parts.drop("rare", "at").join(sums, "row", "left").select(
        "doc_id", "held", "n_tokens", (F.col("n_known") + F.coalesce("r_known", F.lit(0))).alias("n_known"),
        (F.col("plus_one") + F.coalesce("r_one", zero)).alias("plus_one"),
        (F.col("plus_alpha") + F.coalesce("r_alpha", zero) + F.col("classes") + F.coalesce("r_classes", zero)).alias("logp"),
    )


def score_documents(docs: DataFrame) -> DataFrame:
    """Every document under the model of those outside the held-out fold, beside add-one unigrams."""
    settle(docs.sparkSession)
    held = held_out("doc_id", FOLDS, HELD_FOLD)
    counts = stored(count_words(docs.where(~held)), "lm-counts")
    known = frequent_words(counts)
    lines = encode(docs.select("doc_id", held.alias("held"), "text"), [w for w, _ in known])
    model, classes = cluster_lines(lines.where(~F.col("held")), counts, known)
    base = F.col("plus_one") - F.col("n_tokens") * F.log10(F.lit(float(model.tokens + model.distinct + 1)))
    return score_lines(lines, model, classes).select(
        "doc_id", F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("bigint").alias("train_tokens"),
        base.alias("base_score"), F.col("logp").alias("score"),
    )
