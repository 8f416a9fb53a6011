"""Facts within windows of any place and length, overlapping or not, without a range join.

Time is the leaves of a binary tree. A window is cut into the nodes that exactly cover its whole leaves, at most two a
level, and the one or two leaves that it covers in part; a fact belongs to one node of each level. So facts meet windows by
equality on (keys, node), and only in the leaves at a window's ends are times compared. The nodes of a busy key lie
apart, so one key does not end up in one task.

* ``window_pairs`` gives every (window, fact) pair. Keys of few facts need no tree: each window looks at all of them.
* ``window_aggregate`` adds up, per window, the aggregates of its nodes: no pair of a window and an inner fact is formed.
* ``window_totals`` takes counts and exact sums as differences of running totals at both ends, with no tree at all.

Windows are open-closed: (lo, hi]. Rows with a NULL in a key or a time meet nothing; an empty or reversed window holds
nothing. Keys are named alike on both sides.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronograin.grid import micros
from chronograin.operators.running import running_totals
from chronograin.session import cut_lineage, require_utc

_LEVEL_BITS = 6
_ONE_US = timedelta(microseconds=1)
# levels above the leaves: a window of the longest kind covers about 2 ** LEVELS leaves
LEVELS = 8
# facts of a key that a window of pairs looks at one by one
FEW = 64

_LO, _HI, _AT, _NODE, _PART = "_lo", "_hi", "_at", "_node", "_part"


@dataclass(frozen=True)
class Tree:
    """Leaves of 2 ** ``leaf_bits`` microseconds and ``levels`` levels above them."""

    leaf_bits: int
    levels: int

    @staticmethod
    def of_lengths(shortest: timedelta, longest: timedelta, levels: int = LEVELS, below: int = LEVELS) -> Tree:
        """A tree for windows of these lengths: leaves ``below`` levels below the shortest ones, as far as ``levels`` reach."""
        short, long = max(shortest // _ONE_US, 1).bit_length() - 1, max(longest // _ONE_US, 1).bit_length() - 1
        bits = max(long - levels, short - below, 0)
        return Tree(bits, max(long - bits, 0))

    @staticmethod
    def of_windows(windows: DataFrame, lo: str, hi: str, levels: int = LEVELS, below: int = LEVELS) -> Tree:
        """A tree for the lengths that occur, from one aggregate over two columns."""
        length = micros(F.col(hi)) - micros(F.col(lo))
        row = windows.select(length.alias("n")).where("n > 0").agg(F.min("n"), F.max("n")).first()
        return Tree.of_lengths(row[0] * _ONE_US, row[1] * _ONE_US, levels, below) if row[0] else Tree(0, 0)

    def node(self, at: Column, level: int) -> Column:
        """The node of a level that holds a time."""
        return _node(F.shiftright(at, self.leaf_bits + level), level)

    def inner(self, lo: Column, hi: Column) -> Column:
        """Nodes that cover the whole leaves of (lo, hi]."""
        found = []
        for level in range(self.levels):
            first, end = self._first(lo, level), self._end(hi, level)
            some = first < end
            found.append(F.when(some & (first % 2 != 0), _node(first, level)))
            found.append(F.when(some & (end % 2 != 0), _node(end - 1, level)))
        first, end = self._first(lo, self.levels), self._end(hi, self.levels)
        top = F.when(first < end, F.transform(F.sequence(first, end - 1), lambda i: _node(i, self.levels)))
        none = F.array().cast("array<bigint>")
        return F.concat(F.array_compact(F.array(*found)) if found else none, F.coalesce(top, none))

    def ends(self, lo: Column, hi: Column) -> Column:
        """Leaves that (lo, hi] covers in part."""
        mask = F.lit((1 << self.leaf_bits) - 1).cast("bigint")
        left = F.when((lo + 1).bitwiseAND(mask) != 0, self.node(lo + 1, 0))
        right = F.when((hi + 1).bitwiseAND(mask) != 0, self.node(hi + 1, 0))
        return F.when(lo < hi, F.array_distinct(F.array_compact(F.array(left, right)))).otherwise(F.array().cast("array<bigint>"))

    def _first(self, lo: Column, level: int) -> Column:
        return -F.shiftright(-(lo + 1), self.leaf_bits + level)

    def _end(self, hi: Column, level: int) -> Column:
        return F.shiftright(hi + 1, self.leaf_bits + level)


def _node(index: Column, level: int) -> Column:
    return F.shiftleft(index, _LEVEL_BITS) + F.lit(level)


def _timed(facts: DataFrame, keys: Sequence[str], time_col: str) -> DataFrame:
    require_utc(facts.sparkSession)
    return facts.dropna(subset=[*keys, time_col]).withColumn(_AT, micros(F.col(time_col)))


def _bounded(windows: DataFrame, keys: Sequence[str], lo: str, hi: str) -> DataFrame:
    known = windows.dropna(subset=[*keys, lo, hi])
    return known.withColumns({_LO: micros(F.col(lo)), _HI: micros(F.col(hi))}).where(F.col(_LO) < F.col(_HI))


def _spread(windows: DataFrame, tree: Tree) -> DataFrame:
    """A row for each node of a window, ``_part`` where the node is covered in part."""
    lo, hi = F.col(_LO), F.col(_HI)
    nodes = F.concat(
        F.transform(tree.inner(lo, hi), lambda n: F.struct(n.alias(_NODE), F.lit(False).alias(_PART))),
        F.transform(tree.ends(lo, hi), lambda n: F.struct(n.alias(_NODE), F.lit(True).alias(_PART))),
    )
    return windows.select("*", F.inline(nodes))


def _inside() -> Column:
    return (F.col(_AT) > F.col(_LO)) & (F.col(_AT) <= F.col(_HI))


def window_pairs(
    windows: DataFrame, facts: DataFrame, keys: Sequence[str], lo: str, hi: str, time_col: str, tree: Tree | None = None
) -> DataFrame:
    """Columns of ``windows`` and of ``facts`` (but for its keys) for every fact in (lo, hi] of a window of its keys.

    Without a ``tree``, only the keys of more than ``FEW`` facts take one, so that rows of the others are not copied.
    """
    both = sorted(set(windows.columns) & set(facts.columns) - set(keys))
    if both:
        raise ValueError(f"columns of both sides that are no keys: {both}")
    if tree is None and keys:
        require_utc(facts.sparkSession)
        sizes = facts.dropna(subset=[*keys, time_col]).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        busy = cut_lineage(sizes.where(F.col("_n") > FEW).select(*keys))
        if busy.isEmpty():
            return _pairs_by_key(windows, facts, keys, lo, hi, time_col)
        apart = [df.join(busy, list(keys), "left_anti") for df in (windows, facts)]
        crowded = [df.join(busy, list(keys), "left_semi") for df in (windows, facts)]
        return _pairs_by_key(*apart, keys, lo, hi, time_col).unionByName(_pairs_by_node(*crowded, keys, lo, hi, time_col, tree))
    return _pairs_by_node(windows, facts, keys, lo, hi, time_col, tree)


def _pairs_by_key(windows: DataFrame, facts: DataFrame, keys: Sequence[str], lo: str, hi: str, time_col: str) -> DataFrame:
    at, since, until = (micros(F.col(c)) for c in (time_col, lo, hi))
    asked, known = windows.dropna(subset=[*keys, lo, hi]).where(since < until), facts.dropna(subset=[*keys, time_col])
    met = asked.join(known, list(keys)).where((at > since) & (at <= until))
    return met.select(*windows.columns, *[c for c in facts.columns if c not in keys])


def _pairs_by_node(
    windows: DataFrame, facts: DataFrame, keys: Sequence[str], lo: str, hi: str, time_col: str, tree: Tree | None
) -> DataFrame:
    # every pair is written anyway, so leaves much shorter than the windows would only copy facts
    tree = Tree.of_windows(windows, lo, hi, below=2) if tree is None else tree
    asked = _spread(_bounded(windows, keys, lo, hi), tree)
    own = [tree.node(F.col(_AT), level) for level in range(tree.levels + 1)]
    known = _timed(facts, keys, time_col).select("*", F.explode(F.array(*own)).alias(_NODE))
    # an inner node lies within its window, so the times need no look; of the ends they decide
    met = asked.join(known, [*keys, _NODE]).where(~F.col(_PART) | _inside())
    return met.select(*windows.columns, *[c for c in facts.columns if c not in keys])


# how values, and then the results of nodes, are put together
_KINDS = {"count": (F.count, F.sum), "sum": (F.sum, F.sum), "min": (F.min, F.min), "max": (F.max, F.max)}


def window_aggregate(
    windows: DataFrame,
    facts: DataFrame,
    keys: Sequence[str],
    lo: str,
    hi: str,
    time_col: str,
    aggs: Mapping[str, tuple[str, Column]],
    tree: Tree | None = None,
) -> DataFrame:
    """``windows``, whose rows are distinct, with aggregates of the facts in (lo, hi]; ``aggs`` maps a name to a kind (count,
    sum, min, max) and what it is taken of. A window without facts has count 0 and NULL otherwise.
    """
    tree = Tree.of_windows(windows, lo, hi) if tree is None else tree
    for name, (kind, _) in aggs.items():
        if kind not in _KINDS:
            raise ValueError(f"{name}: {kind} is none of {sorted(_KINDS)}")
    values = {name: f"_v{i}" for i, name in enumerate(aggs)}
    first = [_KINDS[kind][0](values[n]).alias(values[n]) for n, (kind, _) in aggs.items()]
    again = [_KINDS[kind][1](values[n]).alias(values[n]) for n, (kind, _) in aggs.items()]
    known = _timed(facts, keys, time_col).select(*keys, _AT, *[c.alias(values[n]) for n, (_, c) in aggs.items()])
    # from leaves upwards: a leaf's aggregate is copied to the nodes above it and added up there
    leaves = known.groupBy(*keys, F.shiftright(_AT, tree.leaf_bits).alias("_leaf")).agg(*first)
    above = [_node(F.shiftright("_leaf", level), level) for level in range(tree.levels + 1)]
    nodes = leaves.select(*keys, F.explode(F.array(*above)).alias(_NODE), *values.values()).groupBy(*keys, _NODE).agg(*again)
    asked = _spread(_bounded(windows, keys, lo, hi), tree)
    names = [F.col(c).alias(f"_w{i}") for i, c in enumerate(windows.columns)]
    whole = asked.where(~F.col(_PART)).join(nodes, [*keys, _NODE]).select(*names, *values.values())
    in_leaf = known.withColumn(_NODE, tree.node(F.col(_AT), 0))
    part = asked.where(F.col(_PART)).join(in_leaf, [*keys, _NODE]).where(_inside())
    seen = part.select(*names, *[_single(kind, F.col(values[n])).alias(values[n]) for n, (kind, _) in aggs.items()])
    empty = windows.select(*names, *[F.lit(0 if k == "count" else None).cast(nodes.schema[values[n]].dataType).alias(values[n]) for n, (k, _) in aggs.items()])
    met = whole.unionByName(seen).unionByName(empty).groupBy(*[f"_w{i}" for i in range(len(windows.columns))]).agg(*again)
    return met.select(*[F.col(f"_w{i}").alias(c) for i, c in enumerate(windows.columns)], *[F.col(v).alias(n) for n, v in values.items()])


def _single(kind: str, value: Column) -> Column:
    """The aggregate of one value."""
    return F.when(value.isNotNull(), 1).otherwise(0).cast("bigint") if kind == "count" else value


def window_totals(
    windows: DataFrame, facts: DataFrame, keys: Sequence[str], lo: str, hi: str, time_col: str, totals: Mapping[str, Column]
) -> DataFrame:
    """``windows``, whose rows are distinct, with sums over the facts in (lo, hi], 0 where there are none.

    A sum is the difference of two running totals, so the summands should be whole or decimal numbers; a NULL
    counts as 0. Each window costs two rows of one sorted pass, whatever it covers.
    """
    values = {name: f"_v{i}" for i, name in enumerate(totals)}
    known = _timed(facts, keys, time_col).select(
        *keys, _AT, F.lit(0).alias("_ask"), *[F.coalesce(c, F.lit(0)).alias(values[n]) for n, c in totals.items()]
    )
    window = F.struct(*windows.columns).alias("_window")
    ends = F.array(F.struct(F.col(_HI).alias(_AT), F.lit(1).alias("_ask")), F.struct(F.col(_LO).alias(_AT), F.lit(-1).alias("_ask")))
    asked = _bounded(windows, keys, lo, hi).select(*keys, window, F.inline(ends))
    none = known.withColumn("_window", F.lit(None).cast(asked.schema["_window"].dataType)).withColumn("_turn", F.lit(0))
    probes = asked.withColumns({v: F.lit(0).cast(known.schema[v].dataType) for v in values.values()}).withColumn("_turn", F.lit(1))
    # at equal times facts come before the ends of windows, which therefore hold them
    summed = running_totals(none.unionByName(probes), keys, [_AT, "_turn", "_ask"], {f"{v}_upto": F.col(v) for v in values.values()})
    found = summed.where(F.col("_ask") != 0).select("_window", *[(F.col("_ask") * F.col(f"{v}_upto")).alias(v) for v in values.values()])
    # windows that hold nothing by definition still get their row
    bare = windows.select(window, *[F.lit(0).cast(found.schema[v].dataType).alias(v) for v in values.values()])
    met = found.unionByName(bare).groupBy("_window").agg(*[F.sum(v).alias(v) for v in values.values()])
    return met.select("_window.*", *[F.col(v).alias(n) for n, v in values.items()])
