"""Exact top-k by dot product over clustered blocks of vectors, most of which are never looked at.

Items are dealt to centres, the means of a bounded sample's clusters, and packed per centre, longest first, into blocks
that know their radius around the centre and their largest norm. By Cauchy-Schwarz no item of a block scores above
``min(q.c + |q| * radius, |q| * largest)``, so a block matters to a query only while that reaches the query's k-th best
score so far. Queries are packed the same way. For a block of queries and a centre two numbers settle it: the least
radius, and the least norm, that a block needs to matter to one of the queries. So pairs of blocks are found by an
equality join on the centre over rows of a few numbers, and vectors are shuffled for the surviving pairs only.

The search runs in rounds that carry the k-th best scores on: first the nearest block of each query, then the few
most promising ones, at last all that still matter. Pairs of blocks meet in cells of a sheet of queries and a sheet of
items: a task holds the queries' side and lets the items' blocks pass, so that few copies of a vector are shuffled even
where nothing can be pruned.

Rows without an id or a vector are left out; vectors of unequal length are an error; equal scores go by the item's id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronograin.functions.draws import draw
from chronograin.operators.links import top_k
from chronograin.session import cut_lineage

# rows of a block of items and of queries
ITEM_ROWS = 2048
QUERY_ROWS = 512
# vectors that the driver clusters, the largest number of centres, and vectors to a centre in a table that fits the sample
SAMPLE_ROWS = 4096
CENTRES = 256
SAMPLE_PER_CENTRE = 128
# pairs that a block of queries visits in the rounds between the first and the last
WAVES = (8,)
# vectors of the queries' side that a task holds, and of the items' side that pass it
SHEET_BYTES = 32 << 20
PASSED_BYTES = 128 << 20

_PACKED = "cluster int, block bigint, n bigint, radius double, largest double, ids array<bigint>, payload binary"
_FOUND = "q_block bigint, query_id bigint, item_id bigint, score double"


def _slack(marks: np.ndarray) -> np.ndarray:
    """Scores slightly below the marks, so that rounding never prunes an equal score."""
    return marks - 1e-9 * (1 + np.abs(np.where(np.isfinite(marks), marks, 0)))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    lengths = np.asarray(column.value_lengths())
    if (lengths != width).any():
        raise ValueError(f"vectors of {width} numbers expected, found {sorted(set(lengths.tolist()))}")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def _named(df: DataFrame) -> DataFrame:
    id_col, vector = df.columns
    return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v")).dropna()


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row, the first of equals."""
    return ((centres**2).sum(1) - 2 * rows @ centres.T).argmin(1)


def find_centres(items: DataFrame, n: int | None = None, steps: int = 8, seed: int = 0) -> np.ndarray:
    """At most ``n`` centres of a bounded sample, drawn by id; by default fewer for a table that fits the sample."""
    id_col, vector = items.columns
    drawn = _named(items).select("v", "id", draw(seed, "id").alias("_d")).orderBy("_d", "id").limit(SAMPLE_ROWS)
    sample = [r["v"] for r in drawn.select("v").collect()]
    if not sample:
        return np.empty((0, 0))
    rows = np.array(sample, dtype=np.float64)
    if n is None:
        n = CENTRES if len(rows) == SAMPLE_ROWS else -(-len(rows) // SAMPLE_PER_CENTRE)
    centres = rows[:n]
    for _ in range(steps):
        own = _nearest(rows, centres)
        sizes = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        # a centre without rows stays where it is
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
    return centres


def pack(vectors: DataFrame, centres: np.ndarray, block_rows: int) -> DataFrame:
    """Blocks of the vectors of one centre each, longest vectors first, with radius and largest norm.

    One shuffle by range: a centre that draws very many vectors is spread over tasks.
    """
    width = centres.shape[1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _matrix(batch.column(1), width)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(list(rows.tobytes()[i : i + 8 * width] for i in range(0, rows.nbytes, 8 * width)), pa.binary()),
                    pa.array(_nearest(rows, centres).astype(np.int32)), pa.array(np.sqrt((rows**2).sum(1))),
                ],
                ["id", "v", "cluster", "norm"],
            )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        cluster, ids, parts = -1, [], []

        def block() -> pa.RecordBatch:
            rows = np.frombuffer(b"".join(parts)).reshape(len(ids), width)
            radius = np.sqrt(((rows - centres[cluster]) ** 2).sum(1).max())
            largest = np.sqrt((rows**2).sum(1).max())
            values = [cluster, number, len(ids), float(radius), float(largest), ids, b"".join(parts)]
            types = [pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.binary()]
            names = ["cluster", "block", "n", "radius", "largest", "ids", "payload"]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names)

        for batch in batches:
            for key, vector, c in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                if ids and (c != cluster or len(ids) == block_rows):
                    yield block()
                    number, ids, parts = number + 1, [], []
                cluster = c
                ids.append(key)
                parts.append(vector)
        if ids:
            yield block()

    by = [F.col("cluster"), F.desc("norm"), F.col("id")]
    dealt = _named(vectors).mapInArrow(assign, "id bigint, v binary, cluster int, norm double")
    placed = dealt.repartitionByRange(*by).sortWithinPartitions(*by).select("id", "v", "cluster")
    # blocks are numbered by place, so they are written once
    return cut_lineage(placed.mapInArrow(cut, _PACKED))


@dataclass(frozen=True)
class Index:
    centres: np.ndarray
    blocks: DataFrame

    @property
    def limits(self) -> DataFrame:
        """(cluster, block, n, radius, largest): what the pruning knows of a block."""
        return self.blocks.select("cluster", "block", "n", "radius", "largest")

    @cached_property
    def cluster_limits(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Radius and largest norm of each centre's items, -1 where it has none, and the numbers of items and of blocks."""
        found = np.full((4, len(self.centres)), -1.0)
        found[2:] = 0
        # one row a centre
        for r in self.limits.groupBy("cluster").agg(F.max("radius"), F.max("largest"), F.sum("n"), F.count("n")).collect():
            found[:, r[0]] = r[1:]
        return found[0], found[1], found[2].astype(np.int64), found[3].astype(np.int64)


def build_index(items: DataFrame, centres: np.ndarray | None = None, block_rows: int = ITEM_ROWS) -> Index:
    """Index of (id, vector)."""
    centres = find_centres(items) if centres is None else centres
    return Index(centres, pack(items, centres, block_rows))


def _marks(ids: list[int], marks: list[dict] | None) -> np.ndarray:
    """The k-th best score so far of each query, minus infinity before it has k."""
    known = {m["query_id"]: m["score"] for m in marks or []}
    return np.array([known.get(i, -np.inf) for i in ids])


def _needs(asks: DataFrame, index: Index) -> DataFrame:
    """(q_block, cluster, radius_needed, norm_needed) for the centres whose items may matter to a block of queries."""
    centres = index.centres
    radius, largest, _, _ = index.cluster_limits

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rows = np.frombuffer(row["q_payload"]).reshape(len(row["q_ids"]), -1)
                norms = np.maximum(np.sqrt((rows**2).sum(1)), 1e-300)
                marks = _slack(_marks(row["q_ids"], row["marks"]))
                by_radius = ((marks[:, None] - rows @ centres.T) / norms[:, None]).min(0)
                by_norm = np.full(len(centres), (marks / norms).min())
                kept = np.flatnonzero((radius >= by_radius) & (largest >= by_norm))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(kept), row["q_block"])), pa.array(kept.astype(np.int32)),
                        pa.array(by_radius[kept]), pa.array(by_norm[kept]),
                    ],
                    ["q_block", "cluster", "radius_needed", "norm_needed"],
                )

    schema = "q_block bigint, cluster int, radius_needed double, norm_needed double"
    return asks.select("q_block", "q_ids", "q_payload", "marks").mapInArrow(find, schema)


def _sheet(col: str, n: int) -> Column:
    """Number of the sheet, of ``n``, that a block is dealt to."""
    return F.pmod(F.xxhash64(F.col(col)), F.lit(n)).cast("int")


def _sheets(blocks: int, vectors: int, width: int, parallelism: int) -> int:
    """How many sheets hold some blocks of vectors: as few as memory allows, and enough to give every core some cells."""
    fit = -(-vectors * width * 8 // SHEET_BYTES)
    return max(min(blocks, max(fit, math.isqrt(3 * parallelism - 1) + 1)), 1)


def _both_sheets(queries: tuple[int, int], items: tuple[int, int], width: int, parallelism: int) -> tuple[int, int]:
    """Sheets of the queries and of the items, of (blocks, vectors) each.

    Items pass and are not held, so theirs are as few as still give every core some cells: each is another copy of all queries.
    """
    held = _sheets(*queries, width, parallelism)
    blocks, vectors = items
    return held, max(min(blocks, max(-(-vectors * width * 8 // PASSED_BYTES), -(-3 * parallelism // held))), 1)


class _Asked:
    """A block of queries in a cell, with the k best items that its queries have met there."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, least: np.ndarray, k: int) -> None:
        self.ids, self.rows, self.least, self.k = ids, rows, least, k
        self.at, self.value, self.item = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)

    def meet(self, items: np.ndarray, vectors: np.ndarray) -> None:
        scores, k = self.rows @ vectors.T, self.k
        least = self.least
        if len(items) > k and np.isneginf(least).any():
            least = np.maximum(least, np.partition(scores, len(items) - k, axis=1)[:, len(items) - k])
        at, of = np.nonzero(scores >= least[:, None])
        if not len(at):
            return
        at = np.concatenate([self.at, at])
        value, item = np.concatenate([self.value, scores[at[len(self.at) :], of]]), np.concatenate([self.item, items[of]])
        order = np.lexsort((item, -value, at))
        at, value, item = at[order], value[order], item[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        # equal scores go by id, so later items must reach the k-th best, not beat it
        kth = np.flatnonzero(rank == k - 1)
        self.least = self.least.copy()
        self.least[at[kth]] = np.maximum(self.least[at[kth]], value[kth])
        self.at, self.value, self.item = at[rank < k], value[rank < k], item[rank < k]


def _cells(pairs: DataFrame, asks: DataFrame, index: Index, sheets: tuple[int, int]) -> DataFrame:
    """What is shuffled for pairs of blocks: (q_sheet, i_sheet, block, ids, payload, marks, wanted), of queries with ``wanted`` NULL.

    Blocks are dealt to sheets. A block of queries is sent once to each sheet of items, and a block of items once to each
    sheet of queries, that it has a pair with; so vectors move once for a sheet, not once for a pair.
    """
    n_q, n_i = sheets
    dealt = pairs.select("q_block", "block", _sheet("q_block", n_q).alias("q_sheet"), _sheet("block", n_i).alias("i_sheet"))
    cell = ["q_sheet", "i_sheet"]
    q_side = dealt.select(*cell, "q_block").distinct().join(asks, "q_block").select(
        *cell, F.col("q_block").alias("block"), F.col("q_ids").alias("ids"), F.col("q_payload").alias("payload"), "marks",
        F.lit(None).cast("array<bigint>").alias("wanted"),
    )
    wanted = dealt.groupBy(*cell, "block").agg(F.collect_list("q_block").alias("wanted"))
    i_side = wanted.join(index.blocks.select("block", "ids", "payload"), "block").select(
        *cell, "block", "ids", "payload", F.lit(None).cast(asks.schema["marks"].dataType).alias("marks"), "wanted"
    )
    return q_side.unionByName(i_side)


def _visit(pairs: DataFrame, asks: DataFrame, index: Index, k: int, sheets: tuple[int, int]) -> DataFrame:
    """The k best items of each query among the pairs of blocks of a cell, none below the query's mark."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, asked = None, {}

        def done() -> Iterator[pa.RecordBatch]:
            for block, q in asked.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(q.at), block)), pa.array(q.ids[q.at]), pa.array(q.item), pa.array(q.value)],
                    ["q_block", "query_id", "item_id", "score"],
                )

        for batch in batches:
            for n in range(batch.num_rows):
                row = batch.slice(n, 1).to_pylist()[0]
                if cell != (row["q_sheet"], row["i_sheet"]):
                    yield from done()
                    cell, asked = (row["q_sheet"], row["i_sheet"]), {}
                ids = np.array(row["ids"], np.int64)
                rows = np.frombuffer(row["payload"]).reshape(len(ids), -1)
                if row["wanted"] is None:
                    asked[row["block"]] = _Asked(ids, rows, _slack(_marks(row["ids"], row["marks"])), k)
                else:
                    for q_block in row["wanted"]:
                        asked[q_block].meet(ids, rows)
        yield from done()

    # the queries of a cell come before its items
    met, cell = _cells(pairs, asks, index, sheets).withColumn("_side", F.col("wanted").isNotNull()), ["q_sheet", "i_sheet"]
    placed = met.repartition(*cell).sortWithinPartitions(*cell, "_side", "block")
    return placed.mapInArrow(score, _FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    return top_k(found, ["q_block", "query_id"], [F.desc("score"), F.asc("item_id")], k)


def search(
    queries: DataFrame, index: Index, k: int, query_rows: int = QUERY_ROWS, waves: Sequence[int] = WAVES
) -> tuple[DataFrame, DataFrame]:
    """The k best items of every query, (query_id, item_id, score, rank), and the pairs of blocks visited."""
    packed = pack(queries, index.centres, query_rows)
    asks = packed.select(
        F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("payload").alias("q_payload"), F.col("cluster").alias("home")
    )
    none = F.lit(None).cast("array<struct<query_id:bigint,score:double>>")
    # the longest items around the centre that is nearest to the queries
    first = top_k(index.limits, ["cluster"], [F.desc("largest"), F.asc("block")], 1).select(F.col("cluster").alias("home"), "block")
    pairs = asks.select("q_block", "home").join(first, "home").select("q_block", "block")
    _, _, items, blocks = (int(found.sum()) for found in index.cluster_limits)
    width, cores = index.centres.shape[1], queries.sparkSession.sparkContext.defaultParallelism
    asked = packed.agg(F.count("n"), F.coalesce(F.sum("n"), F.lit(0))).first()
    sheets = _both_sheets((asked[0], asked[1]), (blocks, items), width, cores)
    best = cut_lineage(_best(_visit(pairs, asks.withColumn("marks", none), index, k, sheets), k))
    visited = pairs
    # a round that could visit a good part of all blocks anyway would only put off the last one
    for wave in [*[w for w in waves if 4 * w < blocks], None]:
        marks = best.where(F.col("rank") == k).groupBy("q_block").agg(F.collect_list(F.struct("query_id", "score")).alias("marks"))
        asked = asks.join(marks, "q_block", "left")
        needs = _needs(asked, index).join(index.limits, "cluster")
        kept = needs.where((F.col("radius") >= F.col("radius_needed")) & (F.col("largest") >= F.col("norm_needed")))
        kept = kept.join(visited, ["q_block", "block"], "left_anti")
        if wave is not None:
            kept = top_k(kept, ["q_block"], [F.desc(F.col("radius") - F.col("radius_needed")), F.asc("block")], wave, "_nr")
        # both sides of the cells, and the rounds to come, read these pairs of numbers
        pairs = cut_lineage(kept.select("q_block", "block"))
        found = best.drop("rank").unionByName(_visit(pairs, asked, index, k, sheets))
        visited = visited.unionByName(pairs)
        best = _best(found, k)
        if wave is not None:
            best = cut_lineage(best)
    return best.select("query_id", "item_id", "score", "rank"), visited


def blockwise_top_k(queries: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """(query_id, item_id, score, rank): the k items with the largest dot product for each query."""
    if k < 1:
        raise ValueError(f"k must be positive, found {k}")
    index = build_index(items)
    if not len(index.centres):
        return queries.sparkSession.createDataFrame([], "query_id bigint, item_id bigint, score double, rank int")
    return search(queries, index, k)[0]


def reachable(queries: DataFrame, index: Index, marks: DataFrame) -> DataFrame:
    """Per query: how many centres, and items around them, its bounds do not rule out at its mark.

    ``marks`` has (query_id, mark), a score that the query has reached already.
    """
    centres = index.centres
    radius, largest, sizes, _ = index.cluster_limits

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _matrix(batch.column(1), centres.shape[1])
            norms = np.sqrt((rows**2).sum(1))[:, None]
            bound = np.minimum(rows @ centres.T + norms * radius, norms * largest)
            kept = (bound >= _slack(np.asarray(batch.column(2)))[:, None]) & (sizes > 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(kept.sum(1)), pa.array(kept @ sizes)], ["query_id", "n_centres", "n_items"]
            )

    asked = _named(queries).join(marks, F.col("id") == F.col("query_id")).select("id", "v", F.col("mark").cast("double"))
    return asked.mapInArrow(find, "query_id bigint, n_centres bigint, n_items bigint")
