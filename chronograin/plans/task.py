"""Prediction tasks: a label builder plus the metadata to split, filter, mask, cache and score."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronograin.grid import SPLITS, Anchors, Grid, Moments, check_cutoffs, split_grid
from chronograin.model import Database, Dataset, Table, TaskKind
from chronograin.operators import integrity, lists, stats
from chronograin.operators.metrics import Metric, evaluate_entity, evaluate_link
from chronograin.operators.windows import ANCHOR
from chronograin.session import path_exists

# (database, grids) -> (split, timestamp, keys.., target)
Builder = Callable[[Database, Sequence[Anchors]], DataFrame]


@dataclass(frozen=True)
class Task:
    name: str
    kind: TaskKind
    delta: timedelta
    build: Builder
    metrics: tuple[str, ...]
    evals: int = 1
    time_name: str = "timestamp"

    def key_columns(self) -> list[str]:
        raise NotImplementedError

    def known_only(self, dataset: Dataset, labels: DataFrame) -> DataFrame:
        raise NotImplementedError

    def grids(self, dataset: Dataset, splits: Sequence[str] = SPLITS) -> list[Grid]:
        """Anchor grids. Training and validation see no rows after the test cut-off."""
        check_cutoffs(self.delta, dataset.val_timestamp, dataset.test_timestamp)
        first, last_input, last = dataset.time_bounds
        out = []
        for split in splits:
            end = last if split == "test" else last_input
            out.append(
                split_grid(
                    split, self.delta, dataset.val_timestamp, dataset.test_timestamp, first, end, self.evals
                )
            )
        return out

    def labels(self, dataset: Dataset, splits: Sequence[str] = SPLITS) -> DataFrame:
        """Labels of several splits in one pass: (split, timestamp, keys.., target).

        Windows of training and validation anchors end by the test cut-off, so one pass over
        the full database gives what separate passes over truncated copies would give.
        """
        built = self.build(dataset.full_db, self.grids(dataset, splits))
        return self.known_only(dataset, built)

    def labels_at(self, dataset: Dataset, times: Sequence[datetime], split: str = "train") -> DataFrame:
        """Labels at anchors of the caller's choice, which need not form a grid; windows may overlap.

        Only the test split may look behind the test cut-off.
        """
        anchors = Moments(split, tuple(sorted(set(times))), self.delta)
        if split != "test" and anchors.last + self.delta > dataset.test_timestamp:
            raise ValueError(f"the window after {anchors.last} ends after the test cut-off {dataset.test_timestamp}")
        return self.known_only(dataset, self.build(dataset.full_db, [anchors]))

    def table_at(
        self, dataset: Dataset, times: Sequence[datetime], split: str = "train", *, mask: bool | None = None, keep_dst: bool = False
    ) -> Table:
        """Label table at anchors of the caller's choice, masked like that of its split."""
        df = self.arranged(self.labels_at(dataset, times, split))
        if mask if mask is not None else split == "test":
            df = self.masked(df, keep_dst)
        return Table(df, None, self.time_name, self.fkeys())

    def table(
        self,
        dataset: Dataset,
        split: str,
        *,
        mask: bool | None = None,
        keep_dst: bool = False,
        cache_dir: str | None = None,
    ) -> Table:
        """Label table of one split; the test split is masked unless asked otherwise."""
        df = self._computed_or_loaded(dataset, split, cache_dir)
        if mask if mask is not None else split == "test":
            df = self.masked(df, keep_dst)
        return Table(df, None, self.time_name, self.fkeys())

    def _computed_or_loaded(self, dataset: Dataset, split: str, cache_dir: str | None) -> DataFrame:
        spark = next(iter(dataset.full_db.tables.values())).df.sparkSession
        if cache_dir is None:
            return self.finished(dataset, split)
        path = f"{cache_dir.rstrip('/')}/{self.name}-{split}.parquet"
        # Spark leaves the mark last, so a table without it is unfinished, and is written anew
        if not path_exists(spark, f"{path}/_SUCCESS"):
            self.finished(dataset, split).write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    def finished(self, dataset: Dataset, split: str) -> DataFrame:
        return self.arranged(self.labels(dataset, [split]))

    def arranged(self, labels: DataFrame) -> DataFrame:
        """Labels of one split as the rows of a table."""
        return labels.drop("split").withColumnRenamed("timestamp", self.time_name)

    def masked(self, df: DataFrame, keep_dst: bool = False) -> DataFrame:
        return df.select(*self.input_columns(keep_dst))

    def input_columns(self, keep_dst: bool = False) -> list[str]:
        raise NotImplementedError

    def fkeys(self) -> dict[str, str]:
        raise NotImplementedError


@dataclass(frozen=True)
class EntityTask(Task):
    entity_col: str = ""
    entity_table: str = ""
    target_col: str = ""

    def key_columns(self) -> list[str]:
        return [self.entity_col]

    def known_only(self, dataset: Dataset, labels: DataFrame) -> DataFrame:
        return integrity.keep_known(labels, self.entity_col, dataset.entity_ids(self.entity_table))

    def input_columns(self, keep_dst: bool = False) -> list[str]:
        return [self.time_name, self.entity_col]

    def fkeys(self) -> dict[str, str]:
        return {self.entity_col: self.entity_table}

    def evaluate(
        self, dataset: Dataset, pred: DataFrame, split: str = "test", metrics: Sequence[Metric] | None = None
    ) -> dict[str, float]:
        """Score predictions (time, entity, pred) of a split with the task's or other metrics."""
        keys = [self.time_name, self.entity_col]
        return evaluate_entity(self.finished(dataset, split), pred, keys, self.target_col, metrics or self.metrics)

    def stats(self, dataset: Dataset) -> DataFrame:
        """Statistics per anchor, per split and in total."""
        labels = self.labels(dataset)
        if self.kind is TaskKind.MULTILABEL:
            return stats.multilabel_stats(labels, self.target_col)
        return stats.entity_stats(labels, self.entity_col, self.target_col, self.kind)

    def overlap(self, dataset: Dataset) -> DataFrame:
        """Share of the test entities that also occur in training."""
        return stats.train_test_overlap(self.labels(dataset), self.entity_col)


@dataclass(frozen=True)
class LinkTask(Task):
    """``build`` and ``labels`` give one row per pair; ``table`` gives lists."""

    src_col: str = ""
    src_table: str = ""
    dst_col: str = ""
    dst_table: str = ""
    k: int = 10
    # destinations in one part of a list
    part_rows: int = lists.PART_ROWS

    def __post_init__(self) -> None:
        if self.evals != 1:
            raise NotImplementedError("link tasks have one validation and one test anchor")

    def key_columns(self) -> list[str]:
        return [self.src_col, self.dst_col]

    def known_only(self, dataset: Dataset, labels: DataFrame) -> DataFrame:
        known = integrity.keep_known(labels, self.dst_col, dataset.entity_ids(self.dst_table))
        return integrity.keep_known(known, self.src_col, dataset.entity_ids(self.src_table))

    def arranged(self, labels: DataFrame) -> DataFrame:
        found = lists.pairs_to_lists(labels, ["timestamp", self.src_col], self.dst_col, self.part_rows)
        return found.withColumnRenamed("timestamp", self.time_name)

    def masked(self, df: DataFrame, keep_dst: bool = False) -> DataFrame:
        # a list in several parts is still one row of inputs
        whole = df if keep_dst else df.where(F.col("part") == 0)
        return whole.select(*self.input_columns(keep_dst), *(["part"] if keep_dst else []))

    def input_columns(self, keep_dst: bool = False) -> list[str]:
        # destination lists of the test split are the answer, so they are hidden by default
        return [self.time_name, self.src_col, *([self.dst_col] if keep_dst else [])]

    def fkeys(self) -> dict[str, str]:
        return {self.src_col: self.src_table, self.dst_col: self.dst_table}

    def evaluate(
        self, dataset: Dataset, pred: DataFrame, split: str = "test", metrics: Sequence[str] | None = None
    ) -> dict[str, float]:
        """Score lists of k predictions (time, source, pred) of a split."""
        truth = self.labels(dataset, [split]).withColumnRenamed("timestamp", self.time_name)
        keys = [self.time_name, self.src_col]
        return evaluate_link(truth, pred, keys, self.dst_col, self.k, metrics or self.metrics)

    def stats(self, dataset: Dataset) -> DataFrame:
        """Statistics per anchor, per split and in total."""
        return stats.link_stats(self.labels(dataset), self.src_col, self.dst_col)

    def overlap(self, dataset: Dataset) -> DataFrame:
        """Share of the test sources that also occur in training."""
        return stats.train_test_overlap(self.labels(dataset), self.src_col)


def all_splits(task: Task, dataset: Dataset) -> DataFrame:
    out = task.labels(dataset)
    return out.select(*ANCHOR, *[F.col(c) for c in out.columns if c not in ANCHOR])
