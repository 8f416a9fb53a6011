"""Anchor grids: start + k * step for k = 0 .. count - 1, and the checks on the splits."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPLITS = ("train", "val", "test")
_EPOCH = datetime(1970, 1, 1)
_ONE_US = timedelta(microseconds=1)


def to_micros(moment: datetime) -> int:
    return (moment - _EPOCH) // _ONE_US


def micros(col: Column) -> Column:
    """Microseconds since the epoch of a zone-free timestamp (session zone UTC)."""
    return F.unix_micros(col.cast("timestamp"))


def from_micros(col: Column) -> Column:
    return F.timestamp_micros(col).cast("timestamp_ntz")


def floor_div(value: Column, step: int) -> Column:
    """Exact integer division towards minus infinity."""
    return ((value - F.pmod(value, F.lit(step))) / F.lit(step)).cast("bigint")


@dataclass(frozen=True)
class Grid:
    split: str
    start: datetime
    step: timedelta
    count: int

    @property
    def start_us(self) -> int:
        return to_micros(self.start)

    @property
    def step_us(self) -> int:
        return self.step // _ONE_US

    @property
    def last(self) -> datetime:
        return self.start + self.step * (self.count - 1)

    def moments(self) -> list[datetime]:
        return [self.start + self.step * k for k in range(self.count)]

    def moment(self, k: Column) -> Column:
        return from_micros(F.lit(self.start_us) + k * F.lit(self.step_us))

    def anchor(self, k: Column) -> Column:
        return F.struct(F.lit(self.split).alias("split"), self.moment(k).alias("timestamp"))


# buckets of time in which irregular anchors are looked up
_BUCKETS = 1024


@dataclass(frozen=True)
class Moments:
    """Anchors at any times, each followed by a window of length ``step``; windows may overlap or leave gaps.

    The times are part of the plan, as those of a grid are: a task has tens or hundreds of them.
    """

    split: str
    times: tuple[datetime, ...]
    step: timedelta

    def __post_init__(self) -> None:
        if not self.times or list(self.times) != sorted(set(self.times)):
            raise ValueError("anchors must be distinct, ascending, and at least one")

    @property
    def count(self) -> int:
        return len(self.times)

    @property
    def start(self) -> datetime:
        return self.times[0]

    @property
    def last(self) -> datetime:
        return self.times[-1]

    def moments(self) -> list[datetime]:
        return list(self.times)

    @property
    def all_us(self) -> Column:
        return F.array(*[F.lit(to_micros(t)).cast("bigint") for t in self.times])

    def moment(self, k: Column) -> Column:
        return from_micros(F.get(self.all_us, k.cast("int")))

    def anchor(self, k: Column) -> Column:
        return F.struct(F.lit(self.split).alias("split"), self.moment(k).alias("timestamp"))

    def around(self, at: Column, before: int, after: int) -> Column:
        """Numbers of the anchors t with ``at`` in (t - before, t + after], all in microseconds.

        Time is cut into buckets as long as that range, or longer, so each anchor concerns two of them and a
        look-up by bucket leaves few anchors to compare.
        """
        times = [to_micros(t) for t in self.times]
        base = times[0] - before + 1
        width = max(before + after, -(-(times[-1] + after - base + 1) // _BUCKETS), 1)
        concerned: list[list[int]] = [[] for _ in range((times[-1] + after - base) // width + 1)]
        for k, t in enumerate(times):
            for b in range((t - before + 1 - base) // width, (t + after - base) // width + 1):
                concerned[b].append(k)
        empty = F.array().cast("array<bigint>")
        known = F.array(*[F.array(*[F.lit(k).cast("bigint") for k in ks]) if ks else empty for ks in concerned])
        bucket = floor_div(at - F.lit(base), width)
        found = F.when(bucket.between(0, len(concerned) - 1), F.get(known, bucket.cast("int")))
        us = self.all_us

        def holds(k: Column) -> Column:
            t = F.get(us, k.cast("int"))
            return (t < at + before) & (t >= at - after)

        return F.coalesce(F.filter(found, holds), empty)


Anchors = Grid | Moments


def anchor_table(spark: SparkSession, grids: Sequence[Anchors]) -> DataFrame:
    """One row per anchor."""
    rows = [
        spark.range(g.count).select(F.lit(g.split).alias("split"), g.moment(F.col("id")).alias("timestamp"))
        for g in grids
    ]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


def check_cutoffs(delta: timedelta, val: datetime, test: datetime) -> None:
    if test - val < delta:
        raise ValueError(f"the window {delta} is longer than the gap between the cut-offs {test - val}")


def split_grid(
    split: str,
    delta: timedelta,
    val: datetime,
    test: datetime,
    first: datetime,
    last: datetime,
    evals: int = 1,
) -> Grid:
    """Anchors of a split. ``first`` and ``last`` bound the times in the database.

    Training anchors step back from the validation cut-off, so their windows tile the past;
    validation and test anchors step forward from their cut-off, at most ``evals`` of them,
    as long as the whole window is covered.
    """
    check_cutoffs(delta, val, test)
    if split == "train":
        latest = val - delta
        count = max(0, (latest - first) // delta + 1)
        if count < 3:
            raise RuntimeError(f"too few training anchors: {count}")
        return Grid(split, latest - delta * (count - 1), delta, count)
    cutoff, end = {"val": (val, test), "test": (test, last)}[split]
    if cutoff + delta > last:
        raise RuntimeError(f"the {split} window ends after the last row ({last})")
    return Grid(split, cutoff, delta, min(evals, (end - cutoff) // delta))
