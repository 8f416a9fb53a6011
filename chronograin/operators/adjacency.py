"""Compressed adjacency: the destinations of each source, stored for look-ups by source.

Edges are sorted by (source, destination) over range partitions and packed into rows of one block of sources: the
sources, where each one's destinations begin, its first destination, and the gaps between the others at the fewest bytes
that hold them. A row ends with its block or after ``ROW_EDGES`` edges, so a hub is a run of rows and no row grows
without bound. Files are sorted by block, so a range of sources reads few row groups, and a look-up meets the rows by
equality on the block and decodes only what it asks for.

Edges with a NULL end are left out; repeated edges stay; sources and destinations may be any whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BITS = 10
ROW_EDGES = 1 << 16

_ROWS = "block bigint, srcs array<bigint>, starts array<int>, firsts array<bigint>, width int, gaps binary"
_WIDTHS = (1, 2, 4, 8)


def _packed(block: int, src: np.ndarray, dst: np.ndarray) -> pa.RecordBatch:
    begins = np.flatnonzero(np.r_[True, src[1:] != src[:-1]])
    gaps = np.diff(dst, prepend=dst[0])
    # an unsigned difference is right even where the signed one overflows
    gaps = gaps.astype(np.uint64)
    gaps[begins] = 0
    width = next(w for w in _WIDTHS if w == 8 or int(gaps.max()) < 1 << (8 * w))
    values = [block, src[begins], np.r_[begins, len(src)].astype(np.int32), dst[begins], width, gaps.astype(f"<u{width}").tobytes()]
    types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.int32(), pa.binary()]
    names = ["block", "srcs", "starts", "firsts", "width", "gaps"]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names)


def _unpacked(row: dict, wanted: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(src, dst) of a stored row, of the wanted sources only (all by default)."""
    srcs, starts, firsts = (np.array(row[c], np.int64) for c in ("srcs", "starts", "firsts"))
    at = np.arange(len(srcs)) if wanted is None else np.flatnonzero(np.isin(srcs, wanted))
    width, out_src, out_dst = row["width"], [], []
    for i in at.tolist():
        gaps = np.frombuffer(row["gaps"], f"<u{width}", starts[i + 1] - starts[i], int(starts[i]) * width)
        out_dst.append((np.cumsum(gaps, dtype=np.uint64) + firsts[i].astype(np.uint64)).astype(np.int64))
        out_src.append(np.full(len(gaps), srcs[i]))
    none = np.empty(0, np.int64)
    return np.concatenate([none, *out_src]), np.concatenate([none, *out_dst])


def write_adjacency(edges: DataFrame, path: str, row_edges: int = ROW_EDGES, block_bits: int = BLOCK_BITS) -> None:
    """Store the edges (src, dst) at ``path``."""
    src, dst = edges.columns
    pairs = edges.select(F.col(src).cast("bigint").alias("src"), F.col(dst).cast("bigint").alias("dst")).dropna()
    # the salt splits repeated edges that would otherwise have to share a partition
    by = ["src", "dst", "_salt"]
    placed = pairs.withColumn("_salt", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        src = dst = np.empty(0, np.int64)
        for batch in batches:
            src = np.r_[src, batch.column(0).to_numpy(zero_copy_only=False)]
            dst = np.r_[dst, batch.column(1).to_numpy(zero_copy_only=False)]
            # what may go on in the next batch waits
            while len(src) and (len(src) > row_edges or src[0] >> block_bits != src[-1] >> block_bits):
                n = min(row_edges, int(np.searchsorted(src >> block_bits, src[0] >> block_bits, "right")))
                yield _packed(int(src[0] >> block_bits), src[:n], dst[:n])
                src, dst = src[n:], dst[n:]
        if len(src):
            yield _packed(int(src[0] >> block_bits), src, dst)

    placed.select("src", "dst").mapInArrow(pack, _ROWS).write.parquet(path)


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            wanted = None if row["wanted"] is None else np.array(row["wanted"], np.int64)
            src, dst = _unpacked(row, wanted)
            yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], ["src", "dst"])


def stored_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_ROWS).parquet(path)


def neighbors(spark: SparkSession, path: str, sources: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """(src, dst): the destinations of the sources asked for, each once however often it is asked."""
    asked = sources.select(F.col(sources.columns[0]).cast("bigint").alias("src")).dropna().distinct()
    # a block has at most 2 ** block_bits sources
    wanted = asked.groupBy(F.shiftright("src", block_bits).alias("block")).agg(F.collect_list("src").alias("wanted"))
    return stored_rows(spark, path).join(wanted, "block").mapInArrow(_decoded, "src bigint, dst bigint")


def neighbors_between(spark: SparkSession, path: str, low: int, high: int, block_bits: int = BLOCK_BITS) -> DataFrame:
    """(src, dst) of the sources low .. high, through the blocks that hold them."""
    rows = stored_rows(spark, path).where(F.col("block").between(low >> block_bits, high >> block_bits))
    within = F.filter("srcs", lambda s: s.between(low, high))
    return rows.withColumn("wanted", within).mapInArrow(_decoded, "src bigint, dst bigint")
