"""Tables with key and time metadata, databases, datasets."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from datetime import datetime
from enum import Enum
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class TaskKind(Enum):
    REGRESSION = "regression"
    BINARY = "binary_classification"
    MULTICLASS = "multiclass_classification"
    MULTILABEL = "multilabel_classification"
    LINK = "link_prediction"


def ntz(moment: datetime | str) -> Column:
    """A zone-free timestamp literal; a plain datetime literal would carry a zone."""
    text = moment if isinstance(moment, str) else moment.isoformat(sep=" ")
    return F.lit(text).cast("timestamp_ntz")


@dataclass(frozen=True)
class Table:
    df: DataFrame
    pkey: str | None = None
    time_col: str | None = None
    fkeys: Mapping[str, str] = field(default_factory=dict)

    def with_df(self, df: DataFrame) -> Table:
        return replace(self, df=df)

    def upto(self, moment: datetime) -> Table:
        """Rows that exist at ``moment`` (inclusive); a table without time always exists."""
        if self.time_col is None:
            return self
        return self.with_df(self.df.where(F.col(self.time_col) <= ntz(moment)))

    def from_(self, moment: datetime) -> Table:
        """Rows from ``moment`` on (inclusive)."""
        if self.time_col is None:
            return self
        return self.with_df(self.df.where(F.col(self.time_col) >= ntz(moment)))

    def time_bounds(self) -> DataFrame:
        """One row: earliest and latest time."""
        if self.time_col is None:
            raise ValueError("the table has no time column")
        moment = F.col(self.time_col).cast("timestamp_ntz")
        return self.df.agg(F.min(moment).alias("min_time"), F.max(moment).alias("max_time"))

    def count(self) -> int:
        return self.df.count()

    @property
    def feature_columns(self) -> list[str]:
        """Columns that are neither primary nor foreign keys."""
        keys = {self.pkey, *self.fkeys}
        return [c for c in self.df.columns if c not in keys]


@dataclass(frozen=True)
class Database:
    tables: Mapping[str, Table]

    def __getitem__(self, name: str) -> Table:
        return self.tables[name]

    def df(self, name: str) -> DataFrame:
        return self.tables[name].df

    def map(self, fn: Callable[[Table], Table]) -> Database:
        return Database({name: fn(table) for name, table in self.tables.items()})

    def upto(self, moment: datetime) -> Database:
        return self.map(lambda t: t.upto(moment))

    def from_(self, moment: datetime) -> Database:
        return self.map(lambda t: t.from_(moment))

    def time_bounds_by_table(self) -> DataFrame:
        parts = [
            t.time_bounds().select(F.lit(name).alias("table_name"), "min_time", "max_time")
            for name, t in self.tables.items()
            if t.time_col is not None
        ]
        return reduce(DataFrame.unionByName, parts)

    @cached_property
    def time_bounds(self) -> tuple[datetime, datetime]:
        """Earliest and latest time of all timed tables, read once in a single job."""
        row = self.time_bounds_by_table().agg(F.min("min_time"), F.max("max_time")).first()
        return row[0], row[1]


@dataclass(frozen=True)
class Dataset:
    """A database with its cut-offs: rows up to and including each cut-off may be used as input."""

    full_db: Database
    val_timestamp: datetime
    test_timestamp: datetime

    @cached_property
    def db(self) -> Database:
        """The database as of the test cut-off, foreign keys without a row set to NULL."""
        from chronograin.operators.integrity import null_dangling_fkeys

        return null_dangling_fkeys(self.full_db.upto(self.test_timestamp))

    @cached_property
    def time_bounds(self) -> tuple[datetime, datetime, datetime]:
        """Earliest time, latest time by the test cut-off, latest time; read once in a single job."""
        parts = []
        for table in self.full_db.tables.values():
            if table.time_col is not None:
                moment = F.col(table.time_col).cast("timestamp_ntz")
                early = F.when(moment <= ntz(self.test_timestamp), moment)
                parts.append(
                    table.df.agg(F.min(moment).alias("a"), F.max(early).alias("b"), F.max(moment).alias("c"))
                )
        row = reduce(DataFrame.unionByName, parts).agg(F.min("a"), F.max("b"), F.max("c")).first()
        return row[0], row[1], row[2]

    def entity_ids(self, table: str) -> DataFrame:
        """Keys of an entity table as of the test cut-off."""
        entity = self.full_db[table].upto(self.test_timestamp)
        return entity.df.select(entity.pkey)
