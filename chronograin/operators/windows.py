"""Label windows without range joins.

Anchors form grids, so the anchors whose window holds a fact follow from its time by integer
arithmetic. Facts are tagged in a projection and then grouped by (split, timestamp, entity):
one scan and one shuffle, where a range join would have to compare facts with anchors. Anchors that form
no grid (``Moments``) are looked up by buckets of time instead, also within the projection.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronograin.grid import Anchors, Grid, Moments, floor_div, from_micros, micros
from chronograin.model import ntz
from chronograin.session import require_utc

ANCHOR = ("split", "timestamp")
_US = "_us"
_ONE_US = timedelta(microseconds=1)


def _holds(moment: Column, grid: Grid, shift: int) -> Column:
    """Whether a time lies in the windows of a grid, or (shift 1) in its lookbacks."""
    return (moment > ntz(grid.start - shift * grid.step)) & (moment <= ntz(grid.last + (1 - shift) * grid.step))


def _anchor_time(grid: Grid, shift: int) -> Column:
    """The anchor t with t < time <= t + step, or (shift 1) with t - step < time <= t.

    Counted back from the time in microseconds: no division, no rounding.
    """
    before = F.col(_US) - 1
    offset = F.pmod(before - F.lit(grid.start_us), F.lit(grid.step_us))
    return from_micros(before - offset + F.lit(shift * grid.step_us))


def _irregular(grids: Sequence[Anchors]) -> bool:
    return any(isinstance(g, Moments) for g in grids)


def _disjoint(grids: Sequence[Anchors]) -> bool:
    """Whether no moment lies in windows of two anchors. The three splits of a task are disjoint."""
    if _irregular(grids):
        return False
    ordered = sorted(grids, key=lambda g: g.start)
    return all(a.last + a.step <= b.start for a, b in zip(ordered, ordered[1:], strict=False))


def _anchors(time_col: str, grids: Sequence[Anchors], shift: int = 0) -> list[tuple[Column, Column]]:
    """(split, timestamp) of a time: one pair per grid, or a single pair where the grids are disjoint."""
    moment = F.col(time_col)
    found = [
        (F.when(_holds(moment, g, shift), F.lit(g.split)), F.when(_holds(moment, g, shift), _anchor_time(g, shift)))
        for g in grids
    ]
    if not _disjoint(grids):
        return found
    return [(F.coalesce(*[split for split, _ in found]), F.coalesce(*[at for _, at in found]))]


def _spread(df: DataFrame, time_col: str, pairs: list[tuple[Column, Column, list[Column]]]) -> DataFrame:
    """One row per anchor found, with ``split``, ``timestamp`` and extra columns."""
    timed = df.withColumn(_US, micros(F.col(time_col)))
    if len(pairs) == 1:
        split, at, extra = pairs[0]
        tagged = timed.select("*", split.alias("split"), at.alias("timestamp"), *extra)
        return tagged.where(F.col("split").isNotNull()).drop(_US)
    found = [F.struct(split.alias("split"), at.alias("timestamp"), *extra) for split, at, extra in pairs]
    # empty ones are dropped after the generator: that stays in generated code
    spread = timed.select("*", F.inline(F.array(*found)))
    return spread.where(F.col("split").isNotNull()).drop(_US)


def _covered(df: DataFrame, time_col: str, grids: Sequence[Anchors], before: timedelta, after: timedelta) -> DataFrame:
    """Plain time bounds, which reach the scan as pushed filters."""
    lo = min(g.start for g in grids) - before
    hi = max(g.last for g in grids) + after
    moment = F.col(time_col)
    return df.where((moment > ntz(lo)) & (moment <= ntz(hi)))


def tag_windows(df: DataFrame, time_col: str, grids: Sequence[Anchors]) -> DataFrame:
    """Add ``split`` and ``timestamp`` of every anchor t with time in (t, t + step]."""
    require_utc(df.sparkSession)
    df = _covered(df, time_col, grids, timedelta(0), max(g.step for g in grids))
    if _irregular(grids):
        at = micros(F.col(time_col))
        return df.select("*", F.inline(F.concat(*[F.transform(_hits(g, at, 0, g.step // _ONE_US), g.anchor) for g in grids])))
    return _spread(df, time_col, [(*pair, []) for pair in _anchors(time_col, grids)])


def tag_windows_and_lookback(df: DataFrame, time_col: str, grids: Sequence[Anchors]) -> DataFrame:
    """As ``tag_windows``, plus the anchors with time in (t - step, t].

    ``in_window`` tells the two apart, so that "active before, and what came after" needs one
    pass over the facts.
    """
    require_utc(df.sparkSession)
    step = max(g.step for g in grids)
    df = _covered(df, time_col, grids, step, step)
    if _irregular(grids):
        at, found = micros(F.col(time_col)), []
        for g in grids:
            for window in (True, False):
                ks = _hits(g, at, *((0, g.step // _ONE_US) if window else (g.step // _ONE_US, 0)))
                found.append(F.transform(ks, _flagged(g, window)))
        return df.select("*", F.inline(F.concat(*found)))
    pairs = [
        (*pair, [F.lit(shift == 0).alias("in_window")]) for shift in (0, 1) for pair in _anchors(time_col, grids, shift)
    ]
    return _spread(df, time_col, pairs)


def _flagged(g: Anchors, window: bool):
    return lambda k: F.struct(F.lit(g.split).alias("split"), g.moment(k).alias("timestamp"), F.lit(window).alias("in_window"))


def _hits(g: Anchors, at: Column, lead: int, lag: int) -> Column:
    """Numbers of the anchors t of a grid with ``at`` in (t - lead, t + lag], in microseconds."""
    if isinstance(g, Moments):
        return g.around(at, lead, lag)
    lo = F.greatest(-floor_div(F.lit(g.start_us + lag) - at, g.step_us), F.lit(0))
    hi = F.least(-floor_div(F.lit(g.start_us - lead) - at, g.step_us) - 1, F.lit(g.count - 1))
    return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))


def tag_range(
    df: DataFrame, time_col: str, grids: Sequence[Anchors], before: timedelta, after: timedelta
) -> DataFrame:
    """Anchors t with time in (t - before, t + after], for windows that do not tile the axis.

    A fact meets at most ceil((before + after) / step) anchors of a grid.
    """
    require_utc(df.sparkSession)
    df = _covered(df, time_col, grids, before, after)
    at = micros(F.col(time_col))
    pieces = [F.transform(_hits(g, at, before // _ONE_US, after // _ONE_US), g.anchor) for g in grids]
    return df.select("*", F.inline(F.concat(*pieces)))


def _bases(grids: Sequence[Anchors]) -> list[int]:
    return [sum(g.count for g in grids[:i]) for i in range(len(grids))]


def _number(g: Anchors) -> Column:
    """Number, within its grid, of the anchor in column ``timestamp``."""
    at = micros(F.col("timestamp"))
    if isinstance(g, Moments):
        return F.nullif(F.array_position(g.all_us, at), F.lit(0)) - 1
    return floor_div(at - F.lit(g.start_us), g.step_us)


def anchor_number(grids: Sequence[Anchors]) -> Column:
    """Number of the anchor in columns ``split`` and ``timestamp``, 0 .. n-1 over all grids."""
    pieces = [F.when(F.col("split") == g.split, _number(g) + base) for g, base in zip(grids, _bases(grids), strict=True)]
    return F.coalesce(*pieces)


def anchor_of(nr: str, grids: Sequence[Anchors]) -> list[Column]:
    """Columns ``split`` and ``timestamp`` of an anchor number."""
    k, split, moment = F.col(nr), F.when(F.lit(False), F.lit("")), F.when(F.lit(False), ntz(grids[0].start))
    for g, base in zip(grids, _bases(grids), strict=True):
        inside = k < base + g.count
        split, moment = split.when(inside, F.lit(g.split)), moment.when(inside, g.moment(k - base))
    return [split.alias("split"), moment.alias("timestamp")]


def numbers_since(moment: Column | None, grids: Sequence[Anchors]) -> Column:
    """Numbers of the anchors t with moment <= t, or of all anchors."""
    if moment is None:
        return F.sequence(F.lit(0).cast("bigint"), F.lit(sum(g.count for g in grids) - 1).cast("bigint"))
    pieces = []
    for g, base in zip(grids, _bases(grids), strict=True):
        if isinstance(g, Moments):
            first = F.size(F.filter(g.all_us, lambda t: t < micros(moment))).cast("bigint")
        else:
            first = F.greatest(-floor_div(F.lit(g.start_us) - micros(moment), g.step_us), F.lit(0))
        last = F.lit(base + g.count - 1).cast("bigint")
        found = F.when(first < g.count, F.sequence(first + base, last))
        pieces.append(F.coalesce(found, F.array().cast("array<bigint>")))
    return F.concat(*pieces)


def spread_since(df: DataFrame, grids: Sequence[Anchors], created_col: str | None = None) -> DataFrame:
    """Every row at every anchor from its creation on (or at all anchors)."""
    created = None if created_col is None else F.col(created_col)
    spread = df.select("*", F.explode(numbers_since(created, grids)).alias("_nr"))
    return spread.select(*anchor_of("_nr", grids), *df.columns)


def churn(facts: DataFrame, key: str, time_col: str, grids: Sequence[Anchors], target: str) -> DataFrame:
    """1 if an entity that was active in (t - step, t] has no fact in (t, t + step]."""
    tagged = tag_windows_and_lookback(facts.select(key, time_col).dropna(subset=[key]), time_col, grids)
    return (
        tagged.groupBy(*ANCHOR, key)
        .agg(F.max("in_window").alias("_again"), F.min("in_window").alias("_only_window"))
        .where(~F.col("_only_window"))
        .select(*ANCHOR, key, (~F.col("_again")).cast("int").alias(target))
    )


def value_of_active(
    facts: DataFrame, key: str, time_col: str, value: str, grids: Sequence[Anchors], target: str
) -> DataFrame:
    """Sum of ``value`` in (t, t + step] (0 if none) for entities active in (t - step, t]."""
    tagged = tag_windows_and_lookback(
        facts.select(key, time_col, value).dropna(subset=[key]), time_col, grids
    )
    return (
        tagged.groupBy(*ANCHOR, key)
        .agg(
            F.sum(F.when(F.col("in_window"), F.col(value))).alias("_sum"),
            F.min("in_window").alias("_only_window"),
        )
        .where(~F.col("_only_window"))
        .select(*ANCHOR, key, F.coalesce("_sum", F.lit(0.0)).alias(target))
    )


def aggregate(
    facts: DataFrame, key: str, time_col: str, grids: Sequence[Anchors], **aggs: Column
) -> DataFrame:
    """Any aggregates over the facts of (t, t + step], per entity with at least one fact."""
    tagged = tag_windows(facts.dropna(subset=[key]), time_col, grids)
    return tagged.groupBy(*ANCHOR, key).agg(*[c.alias(n) for n, c in aggs.items()])


def for_each_existing(
    entities: DataFrame,
    key: str,
    hits: DataFrame,
    value: str,
    grids: Sequence[Anchors],
    created_col: str | None,
    default: Column,
) -> DataFrame:
    """A row per anchor for every entity created by then, with its value or ``default``.

    ``hits`` has (split, timestamp, key, value). An entity has at most one hit per anchor, so
    its hits fit a small map; the join runs on entities, before they are spread over anchors.
    """
    given = hits.select(key, anchor_number(grids).alias("nr"), F.col(value).alias("v"))
    by_key = given.groupBy(key).agg(F.collect_list(F.struct("nr", "v")).alias("_hits"))
    created = None if created_col is None else F.col(created_col)
    kept = [key] if created_col is None else [key, created_col]
    joined = entities.select(*kept).join(by_key, key, "left")
    joined = joined.withColumn("_nrs", numbers_since(created, grids))
    v_type = hits.schema[value].dataType
    rest = F.when(F.col("_hits").isNull(), F.col("_nrs")).otherwise(
        F.array_except("_nrs", F.transform("_hits", lambda h: h["nr"]))
    )
    filled = F.transform(rest, lambda n: F.struct(n.alias("nr"), default.cast(v_type).alias("v")))
    seen = F.coalesce("_hits", F.array().cast(by_key.schema["_hits"].dataType))
    if created_col is not None:
        seen = F.filter(seen, lambda h: F.array_contains("_nrs", h["nr"]))
    spread = joined.select(key, F.inline(F.concat(seen, filled)))
    return spread.select(*anchor_of("nr", grids), key, F.col("v").alias(value))


def for_each_since_first(
    facts: DataFrame, key: str, time_col: str, grids: Sequence[Anchors], name: str
) -> DataFrame:
    """From a key's first fact on: a row per anchor t, 1 if (t, t + step] holds a fact, else 0.

    One pass: the first time and the active anchors of a key (at most one row per anchor) come
    from the same aggregation, and anchors are spread over keys without a join.
    """
    require_utc(facts.sparkSession)
    end = max(g.last + g.step for g in grids)
    used = facts.select(key, time_col).dropna().where(F.col(time_col) <= ntz(end))
    if _disjoint(grids):
        # a fact outside all windows still counts for the first time, so it keeps a bare row
        ((split, at),) = _anchors(time_col, grids)
        timed = used.withColumn(_US, micros(F.col(time_col)))
        tagged = timed.select("*", split.alias("split"), at.alias("timestamp")).drop(_US)
    else:
        bare = used.select("*", F.lit(None).cast("string").alias("split"), F.lit(None).cast("timestamp_ntz").alias("timestamp"))
        tagged = tag_windows(used, time_col, grids).unionByName(bare)
    per_anchor = tagged.groupBy(key, *ANCHOR).agg(F.min(time_col).alias("_first"))
    per_key = per_anchor.groupBy(key).agg(
        F.min("_first").alias("_first"),
        F.collect_list(F.when(F.col("split").isNotNull(), anchor_number(grids))).alias("_hits"),
    )
    wanted = numbers_since(F.col("_first"), grids)
    hit, quiet = F.array_intersect("_hits", "_nrs"), F.array_except("_nrs", "_hits")
    flagged = F.concat(
        F.transform(hit, lambda n: F.struct(n.alias("nr"), F.lit(1).alias("v"))),
        F.transform(quiet, lambda n: F.struct(n.alias("nr"), F.lit(0).alias("v"))),
    )
    spread = per_key.withColumn("_nrs", wanted).select(key, F.inline(flagged))
    return spread.select(*anchor_of("nr", grids), key, F.col("v").alias(name))


def distinct_pairs(
    facts: DataFrame, src: str, dst: str, time_col: str, grids: Sequence[Anchors], *carry: str
) -> DataFrame:
    """Distinct (split, timestamp, src, dst) over the facts of each window."""
    known = facts.select(src, dst, time_col, *carry).dropna(subset=[src, dst])
    return tag_windows(known, time_col, grids).drop(time_col).distinct()


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def add_previous_max(
    df: DataFrame, keys: Sequence[str], order: str, value: str, rows: int, name: str
) -> DataFrame:
    """Largest ``value`` of the key's ``rows`` previous rows (rows present, not calendar anchors).

    For grouped labels: a key has at most one row per anchor, so its window stays short.
    """
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(-rows, -1)
    return df.withColumn(name, F.max(value).over(before))
