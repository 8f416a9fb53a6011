"""Near-duplicate groups by 64-bit SimHash, compared bit-sliced.

A fingerprint is voted by the XXH64 of all word shingles. Fingerprints that differ in at most
``radius`` bits are linked; a component of links is a group. The steps:

1. every partition computes the fingerprints of its own whole texts; copies meet in one distinct
   fingerprint by partial aggregation, so a group of copies of any size is one row from here on;
2. the 64 bits fall into ``radius + 2`` blocks. Two fingerprints within the radius agree in at least two
   blocks, so one table for each pair of blocks, keyed by the bits of both, brings them together. A
   bucket of more than ``SLICE`` fingerprints is dealt into slices by hash, and pairs of slices are compared
   in different tasks;
3. in a bucket, candidate pairs are laid side by side and their differing bits stored as vertical
   planes, one bit per pair. Carry-save counters add up the planes for 64 pairs at a time, and a block of
   pairs is abandoned once all of its pairs exceed the radius. Pairs that are connected already are
   not compared again, so a dense bucket emits a spanning set of links rather than all its pairs;
4. components come from star contraction over the links, in rounds written to the shared folder.

Defined results: a NULL or empty text has fingerprint zero, linked like any other; ``component_id`` is the
smallest non-NULL doc_id of the component, NULL if it has none; repeated rows are kept, each with the
component of its text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronograin.llm.common import per_batch, raw_texts, space_words, stored

SHINGLE = 3
SEED = 42
RADIUS = 3
BITS = 64
# fingerprints of one bucket that meet at once; larger buckets are dealt into slices of about this size
SLICE = 2048
# pairs whose counters are updated together before they may be abandoned
LANES = 1 << 14
# shingle hashes whose votes are counted at once
VOTES = 1 << 16


def shingle_hashes(words: list[bytes], size: int = SHINGLE) -> list[int]:
    """XXH64 of every run of ``size`` words, repeats included; of the whole if there are fewer words."""
    if not words:
        return []
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    pieces = map(slice, starts, (e - 1 for e in ends[size - 1 :]))
    return list(map(xxhash.xxh64_intdigest, map(joined.__getitem__, pieces), repeat(SEED)))


def fingerprint(text: bytes | None) -> int:
    """Bits set in over half the shingle hashes."""
    hashes = np.array(shingle_hashes(space_words(text)), dtype="<u8")
    votes = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), VOTES):
        part = hashes[at : at + VOTES]
        votes += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, BITS).sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns with ``fp``, the fingerprint as a signed bigint."""

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        found = [fingerprint(t) for t in raw_texts(batch)]
        return {"fp": [f - (1 << BITS) if f >> (BITS - 1) else f for f in found]}

    return per_batch(docs, run, T.StructType([T.StructField("fp", T.LongType())]), keep)


def hex_digits(fp: Column | str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def within(left: np.ndarray, right: np.ndarray, radius: int) -> np.ndarray:
    """Which pairs of fingerprints differ in at most ``radius`` bits, by carry-save counters over bit planes."""
    out = np.zeros(len(left), dtype=bool)
    depth = max(1, radius.bit_length())
    for at in range(0, len(left), LANES):
        differ = (left[at : at + LANES] ^ right[at : at + LANES]).view(np.uint8).reshape(-1, 8)
        n = len(differ)
        size = -(-n // 64) * 8
        # row b holds bit b of all pairs; what pads the last word counts as beyond the radius
        planes = np.zeros((BITS, size), dtype=np.uint8)
        packed = np.packbits(np.unpackbits(differ, axis=1).T, axis=1)
        planes[:, : packed.shape[1]] = packed
        planes = planes.view(np.uint64)
        counters = [np.zeros(planes.shape[1], dtype=np.uint64) for _ in range(depth)]
        beyond = np.packbits(np.arange(size * 8) >= n).view(np.uint64)
        for b in range(BITS):
            carry = planes[b]
            for k in range(depth):
                counters[k], carry = counters[k] ^ carry, counters[k] & carry
            beyond |= carry
            if b % 8 == 7 and (~beyond == 0).all():
                break
        else:
            fits = _at_most(counters, beyond, radius)
            out[at : at + n] = np.unpackbits(fits.view(np.uint8))[:n].astype(bool)
    return out


def _at_most(counters: list[np.ndarray], beyond: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose counter is at most ``radius`` and never overflowed, compared from the top bit down."""
    above = beyond.copy()
    equal = ~beyond
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            equal &= counters[k]
        else:
            above |= equal & counters[k]
            equal &= ~counters[k]
    return ~above


def _settle(comp: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the components of linked rows, in place."""
    while True:
        low = np.minimum(comp[a], comp[b])
        np.minimum.at(comp, comp[a], low)
        np.minimum.at(comp, comp[b], low)
        while True:
            up = comp[comp]
            if (up == comp).all():
                break
            comp[:] = up
        if (comp[a] == comp[b]).all():
            return


def bucket_links(bucket: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what lies within the radius in each bucket; rows are sorted by bucket."""
    n = len(fp)
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    ends = np.repeat(np.r_[starts[1:], n], np.diff(np.r_[starts, n]))
    comp, at, found = np.arange(n), np.arange(n), []
    for offset in range(1, n):
        at = at[at + offset < ends[at]]
        if not len(at):
            break
        apart = at[comp[at] != comp[at + offset]]
        linked = apart[within(fp[apart], fp[apart + offset], radius)]
        if len(linked):
            found.append((fp[linked], fp[linked + offset]))
            _settle(comp, linked, linked + offset)
    if not found:
        return fp[:0], fp[:0]
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def block_keys(fp: Column, radius: int) -> Column:
    """One key for each pair of blocks: the table's number and the bits of both blocks."""
    n = radius + 2
    edges = [BITS * i // n for i in range(n + 1)]
    masks = [((1 << edges[i + 1]) - (1 << edges[i])) for i in range(n)]
    keys = []
    for t, (i, j) in enumerate(combinations(range(n), 2)):
        mask = masks[i] | masks[j]
        bits = fp.bitwiseAND(F.lit(mask - (1 << BITS) if mask >> (BITS - 1) else mask).cast("bigint"))
        keys.append(F.struct(F.lit(t).cast("tinyint").alias("t"), bits.alias("bits")))
    return F.array(*keys)


def links(distinct: DataFrame, radius: int = RADIUS, slice_rows: int = SLICE) -> DataFrame:
    """(a, b): links that connect all fingerprints ``fp`` within the radius of one another."""
    keyed = distinct.select("fp", F.explode(block_keys(F.col("fp"), radius)).alias("k")).select("fp", "k.t", "k.bits")
    crowded = (
        keyed.groupBy("t", "bits")
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > 1)
        .select("t", "bits", F.ceil(F.col("_n") / slice_rows).alias("_m"))
    )
    mine = F.pmod(F.xxhash64("fp"), F.col("_m"))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_m") - 1))
    dealt = (
        keyed.join(crowded, ["t", "bits"])
        .select("fp", "t", "bits", mine.alias("_i"), other.alias("_j"))
        .select("fp", F.xxhash64("t", "bits", F.least("_i", "_j"), F.greatest("_i", "_j")).alias("bucket"))
    )
    placed = dealt.repartition("bucket").sortWithinPartitions("bucket", "fp")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: tuple[np.ndarray, np.ndarray] = (np.empty(0, np.int64), np.empty(0, np.int64))
        for batch in _arrays(batches):
            bucket, fp = (np.concatenate([r, x]) for r, x in zip(rest, batch, strict=True))
            # the last bucket may go on in the next batch
            whole = int(np.searchsorted(bucket, bucket[-1])) if len(bucket) else 0
            rest = (bucket[whole:], fp[whole:])
            yield from _linked(bucket[:whole], fp[:whole], radius)
        yield from _linked(*rest, radius)

    return placed.mapInArrow(compare, "a bigint, b bigint").distinct()


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        yield (
            batch.column(batch.schema.get_field_index("bucket")).to_numpy(zero_copy_only=False),
            batch.column(batch.schema.get_field_index("fp")).to_numpy(zero_copy_only=False),
        )


def _linked(bucket: np.ndarray, fp: np.ndarray, radius: int) -> Iterator[pa.RecordBatch]:
    if len(fp) > 1:
        a, b = bucket_links(bucket, fp, radius)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root): the smallest node of the component, for every node of an edge (a, b).

    Star contraction: in turn, the larger neighbours of each node and the node with its smaller
    neighbours are tied to the smallest node seen, until nothing changes. Minima are partially
    aggregated, so a hub never gathers its neighbours in one place.
    """

    def star(links: DataFrame, larger: bool) -> DataFrame:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if not larger:
            both = both.where(F.col("b") < F.col("a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        tied = both.join(low, "a")
        if larger:
            out = tied.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            own = low.select("a", F.col("m").alias("b"))
            out = own.unionByName(tied.select(F.col("b").alias("a"), F.col("m").alias("b")))
        return out.where(F.col("a") != F.col("b")).distinct()

    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    links = stored(down.where(F.col("a") != F.col("b")).distinct(), name)
    state = None
    while True:
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == state or not now[0]:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        state = now
        links = stored(star(star(links, larger=True), larger=False), name)


def near_duplicates(docs: DataFrame, radius: int = RADIUS, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (doc_id by default) of every row with fp, root (a fingerprint) and component_id."""
    keep = ["doc_id"] if keep is None else keep
    wanted = list(dict.fromkeys([*keep, "doc_id"]))
    narrow = stored(fingerprints(docs.select(*wanted, "text"), wanted), "simhash")
    distinct = stored(narrow.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    roots = components(links(distinct, radius), "simhash-links").withColumnRenamed("node", "fp")
    rooted = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.select("fp", "root").join(lowest, "root")
    return narrow.join(named, "fp").select(*keep, "fp", "root", "component_id")


def _has_map(kind: T.DataType) -> bool:
    return "map<" in kind.simpleString() or "variant" in kind.simpleString()


def drop_near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of each group, whole: the one with the smallest doc_id (NULL last; of several the one whose columns
    hash lowest). Columns of any name and type are kept as they are.
    """
    # rows are found again by id and a hash of the whole row; rows alike in both are copies. Maps have no hash
    hashed = [F.to_json(F.struct(f.name)) if _has_map(f.dataType) else F.col(f.name) for f in docs.schema.fields]
    tagged = docs.select(
        "doc_id", "text", F.struct(*docs.columns).alias("_doc"),
        F.coalesce("doc_id", F.lit(0).cast("bigint")).alias("_id"), F.xxhash64(*hashed).alias("_row"),
    )
    found = near_duplicates(tagged.select("doc_id", "text", "_id", "_row"), radius, ["doc_id", "_id", "_row"])
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_id", "_row"))
    winners = found.groupBy("root").agg(first.alias("w")).select("w._id", "w._row")
    kept = tagged.select("_doc", "_id", "_row").join(winners, ["_id", "_row"]).dropDuplicates(["_id", "_row"])
    return kept.select("_doc.*")
