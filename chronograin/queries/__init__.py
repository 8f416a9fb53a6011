"""Registered queries over the given tables, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chronograin.session import prepare

Query = Callable[[SparkSession, str], DataFrame]


class Book:
    """Queries and SQL collected under one name each."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, query: Query, sql: str | None = None) -> None:
        if name in self.queries:
            raise ValueError(f"{name} is already registered")
        self.queries[name] = query
        if sql is not None:
            self.sql[name] = sql

    def query(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def register(fn: Query) -> Query:
            self.add(name, fn, sql)
            return fn

        return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def books() -> list[Book]:
    from chronograin.queries import cleaning, docs, graphs, irregular, keys, labels, learning, relational, storage

    return [m.BOOK for m in (labels, irregular, cleaning, relational, keys, learning, graphs, docs, storage)]
