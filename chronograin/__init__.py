"""Temporal prediction tasks over relational data, as lazy Spark DataFrames."""

from chronograin.model import Database, Dataset, Table, TaskKind

__all__ = ["Database", "Dataset", "Table", "TaskKind"]
