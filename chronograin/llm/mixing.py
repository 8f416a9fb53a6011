"""Mixing sources to target weights by Sainte-Laguë apportionment.

Sizes are word counts. Sources in the order of their code points (NULL last) weigh 3, 1, 2, repeating, and
share ``SHARE`` times all words; a target stops at ``MOST`` times the size of its source, and the excess is
reshared by weight until no target is above. Then

1. the words of the mix are apportioned among the sources by highest quotients target / (2 k + 1), and a source's words
   are dealt in equal blocks of its own: ``BLOCK_WORDS``, or a ``LEAST_BLOCKS``-th of its size where it is small;
2. a source's blocks are apportioned likewise among its shards, which hold its rows by a seeded hash, a
   bounded number each, so a source with a third of all rows is spread over many tasks;
3. a shard lays its documents end to end in seeded order and cuts them into blocks of equal length;
   its quota takes every block as often as it goes, and the rest by seeded choice.

A document is taken as far as the chosen blocks cover it. No block is taken more than ``MOST`` times.

Defined results: NULL and empty texts have size 0 and are never taken; a NULL source is a source; repeated
rows are documents of their own; an empty table gives an empty result; other columns are ignored by
``mix_sizes`` and carried by ``mix_texts``. The driver holds one row for each source and shard (about one
in ``SHARD_ROWS`` documents).
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronograin.llm.common import settle, stored

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
BLOCK_WORDS = 100
# blocks that even a small source has, so that it can come near its target
LEAST_BLOCKS = 50
SHARD_ROWS = 1000
SEED = 20


def word_count(text: Column | str = "text") -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text; 0 for NULL."""
    col = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(col, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("bigint")


def targets(sizes: Sequence[int], weights: Sequence[float], share: float = SHARE, most: float = MOST) -> list[float]:
    """Words of each source: ``share`` of all by weight, none above ``most`` times its size."""
    caps = [most * s for s in sizes]
    out = [0.0] * len(sizes)
    open_, left = list(range(len(sizes))), share * sum(sizes)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if unit * weights[i] > caps[i]]
        if not full:
            for i in open_:
                out[i] = unit * weights[i]
            break
        for i in full:
            out[i] = float(caps[i])
            left -= caps[i]
        open_ = [i for i in open_ if i not in set(full)]
    return out


def apportion(votes: Sequence[float], seats: int, caps: Sequence[int]) -> list[int]:
    """Sainte-Laguë: each seat goes to the highest votes / (2 k + 1); none holds more than its cap.

    Ties go to the earlier party. The bulk of the seats is dealt by one division, which never gives a
    party more than its quotients earn; only what is left goes seat by seat.
    """
    total = sum(votes)
    given = [0] * len(votes)
    if total <= 0:
        return given
    if seats > 2 * len(votes):
        unit = total / (seats - len(votes))
        given = [min(c, max(0, int(v / unit - 0.5))) for v, c in zip(votes, caps, strict=True)]
    left = min(seats, sum(caps)) - sum(given)
    heap = [(-v / (2 * g + 1), i) for i, (v, g, c) in enumerate(zip(votes, given, caps, strict=True)) if v > 0 and g < c]
    heapq.heapify(heap)
    while left > 0 and heap:
        _, i = heapq.heappop(heap)
        given[i] += 1
        left -= 1
        if given[i] < caps[i]:
            heapq.heappush(heap, (-votes[i] / (2 * given[i] + 1), i))
    return given


def cut(words: int, block: int = BLOCK_WORDS) -> int:
    """Blocks of equal length that hold ``words``."""
    return max(1, round(words / block)) if words else 0


def block_words(size: int, block: int = BLOCK_WORDS) -> int:
    """Words of a block of a source with ``size`` words."""
    return max(1, min(block, size // LEAST_BLOCKS))


def choose(words: int, quota: int, seed: Sequence[int], block: int = BLOCK_WORDS) -> tuple[int, np.ndarray, np.ndarray]:
    """Times that every block is taken; edges of the blocks; which are taken once more."""
    n = cut(words, block)
    edges = np.arange(n + 1, dtype=np.int64) * words // max(n, 1)
    extra = np.zeros(n, dtype=bool)
    if n:
        extra[np.random.default_rng(list(seed)).permutation(n)[: quota % n]] = True
    return (quota // n if n else 0), edges, extra


def _sized(docs: DataFrame) -> DataFrame:
    order = F.xxhash64("doc_id", "_size", F.lit(SEED))
    return docs.withColumn("_size", word_count()).withColumn("_order", order)


def _plan(sized: DataFrame, narrow: DataFrame, block: int, shard_rows: int) -> DataFrame:
    """``sized`` with source number, shard, quota and the figures of the source; ``narrow`` gives the counts."""
    spark = sized.sparkSession
    per_source = narrow.groupBy("source").agg(F.sum("_size").alias("n"), F.count(F.lit(1)).alias("rows")).collect()
    # Python compares strings by code point
    per_source.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["n"] for r in per_source]
    wanted = targets(sizes, [WEIGHTS[i % len(WEIGHTS)] for i in range(len(sizes))])
    shards = [-(-r["rows"] // shard_rows) for r in per_source]
    blocks = [block_words(n, block) for n in sizes]
    figures = "source string, source_no int, shards int, source_size bigint, target double, block int"
    rows = [(r["source"], i, shards[i], sizes[i], wanted[i], blocks[i]) for i, r in enumerate(per_source)]
    named = spark.createDataFrame(rows, figures)

    def dealt(df: DataFrame) -> DataFrame:
        # one row for each source
        return (
            df.withColumnRenamed("source", "_source")
            .join(F.broadcast(named), F.col("_source").eqNullSafe(F.col("source")))
            .drop("_source")
            .withColumn("shard", F.pmod("_order", "shards").cast("int"))
        )

    held = dealt(narrow).groupBy("source_no", "shard").agg(F.sum("_size").alias("n")).collect()
    by_source: list[list[tuple[int, int]]] = [[] for _ in rows]
    for r in sorted(held, key=lambda r: (r["source_no"], r["shard"])):
        by_source[r["source_no"]].append((r["shard"], r["n"]))
    words = apportion(wanted, round(sum(wanted)), [MOST * n for n in sizes])
    quotas = []
    for i, part in enumerate(by_source):
        most = [MOST * cut(n, blocks[i]) for _, n in part]
        dealt_to = apportion([n for _, n in part], round(words[i] / blocks[i]), most)
        quotas += [(i, shard, quota) for (shard, _), quota in zip(part, dealt_to, strict=True)]
    return dealt(sized).join(spark.createDataFrame(quotas, "source_no int, shard int, quota bigint"), ["source_no", "shard"])


def _laid_out(table: pa.Table) -> tuple[pa.Table, int, np.ndarray, np.ndarray, np.ndarray]:
    """A shard's rows in seeded order, passes over all blocks, block edges, extra blocks, documents' edges."""
    table = table.sort_by([("_order", "ascending"), ("doc_id", "ascending"), ("_size", "ascending")])
    sizes = table.column("_size").to_numpy()
    ends = np.r_[0, np.cumsum(sizes)]
    key = [SEED, table.column("source_no")[0].as_py(), table.column("shard")[0].as_py()]
    quota, block = table.column("quota")[0].as_py(), table.column("block")[0].as_py()
    passes, edges, extra = choose(int(ends[-1]), quota, key, block)
    return table, passes, edges, extra, ends


def _taken_upto(at: np.ndarray, edges: np.ndarray, extra: np.ndarray) -> np.ndarray:
    """Words of extra blocks before each position."""
    if not len(extra):
        return np.zeros(len(at), dtype=np.int64)
    lengths = np.diff(edges) * extra
    before = np.r_[0, np.cumsum(lengths)]
    i = np.minimum(np.searchsorted(edges, at, side="right") - 1, len(extra) - 1)
    return before[i] + (at - edges[i]) * extra[i]


def mix_sizes(docs: DataFrame, block: int = BLOCK_WORDS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken): the words that the mix takes of each document."""
    settle(docs.sparkSession)
    narrow = stored(_sized(docs.select("doc_id", "text", "source")).drop("text"), "sizes")
    planned = _plan(narrow, narrow, block, shard_rows).drop("shards")

    def take(table: pa.Table) -> pa.Table:
        table, passes, edges, extra, ends = _laid_out(table)
        upto = _taken_upto(ends, edges, extra)
        taken = passes * table.column("_size").to_numpy() + np.diff(upto)
        names = ["doc_id", "source", "_size", "source_size", "target"]
        return pa.table([*[table.column(c) for c in names], pa.array(taken, pa.int64())], names=[*names, "taken"])

    schema = "doc_id bigint, source string, _size bigint, source_size bigint, target double, taken bigint"
    return planned.groupBy("source_no", "shard").applyInArrow(take, schema).withColumnRenamed("_size", "size")


def mix_texts(docs: DataFrame, block: int = BLOCK_WORDS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each time that a document is taken whole, and
    one with the chosen words, joined by spaces, where further blocks cover a part of it.
    """
    settle(docs.sparkSession)
    columns = docs.columns
    # columns of other names stay beside the helper columns
    sized = _sized(docs.select("doc_id", "text", "source", F.struct(*columns).alias("_row"))).drop("text")
    narrow = stored(sized.drop("_row"), "sizes")
    planned = _plan(sized, narrow, block, shard_rows).select(
        "doc_id", "_row", "_size", "_order", "source_no", "shard", "quota", "block"
    )
    out = T.StructType([T.StructField("_row", docs.schema), T.StructField("_part", T.StringType())])

    def take(table: pa.Table) -> pa.Table:
        table, passes, edges, extra, ends = _laid_out(table)
        upto = _taken_upto(ends, edges, extra)
        some = np.diff(upto)
        full = passes + (some == np.diff(ends)) * (some > 0)
        rows = np.repeat(np.arange(len(some)), full * (np.diff(ends) > 0))
        parted = np.flatnonzero((some > 0) & (some < np.diff(ends)))
        texts = table.column("_row").combine_chunks().field("text")
        parts = [None] * len(rows)
        for i in parted:
            words = texts[int(i)].as_py().encode().split()
            first = int(np.searchsorted(edges, ends[i], side="right")) - 1
            picked: list[bytes] = []
            while first < len(extra) and edges[first] < ends[i + 1]:
                if extra[first]:
                    picked += words[max(0, edges[first] - ends[i]) : edges[first + 1] - ends[i]]
                first += 1
            parts.append(b" ".join(picked).decode())
        chosen = table.column("_row").take(pa.array(np.r_[rows, parted].astype(np.int64)))
        return pa.table([chosen, pa.array(parts, pa.string())], names=["_row", "_part"])

    mixed = planned.groupBy("source_no", "shard").applyInArrow(take, out)
    text = F.coalesce("_part", "_row.text")
    changed = {"text": text}
    if "n_chars" in columns:
        changed["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return mixed.select(*[changed.get(c, F.col("_row")[c]).alias(c) for c in columns])
