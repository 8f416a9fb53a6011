"""Tables and databases on disk. Key and time roles travel as column metadata in Parquet."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from chronograin.functions.clean import nan_to_null
from chronograin.model import Database, Table
from chronograin.operators.integrity import reindex
from chronograin.session import path_exists

DONE = "_finished"

# Footer entries of Parquet files written by pandas-based tools
FOOTER_PKEY = b"pkey_col"
FOOTER_TIME = b"time_col"
FOOTER_FKEYS = b"fkey_col_to_pkey_table"


def _with_roles(table: Table) -> DataFrame:
    df = table.df
    for col in df.columns:
        roles: dict[str, object] = {}
        if col == table.pkey:
            roles["pkey"] = True
        if col == table.time_col:
            roles["time"] = True
        if col in table.fkeys:
            roles["fkey"] = table.fkeys[col]
        df = df.withMetadata(col, roles)
    return df


def write_table(table: Table, path: str) -> None:
    _with_roles(table).write.mode("errorifexists").parquet(path)


def read_table(spark: SparkSession, path: str) -> Table:
    df = spark.read.parquet(path)
    fields = df.schema.fields
    pkey = next((f.name for f in fields if f.metadata.get("pkey")), None)
    time_col = next((f.name for f in fields if f.metadata.get("time")), None)
    fkeys = {f.name: f.metadata["fkey"] for f in fields if "fkey" in f.metadata}
    return Table(df, pkey, time_col, fkeys)


def read_foreign_table(spark: SparkSession, path: str) -> Table:
    """A single Parquet file whose roles stand in its footer; only the footer is read here."""
    import pyarrow.parquet as pq

    footer = pq.read_schema(path).metadata or {}
    role = {key: json.loads(footer[key]) for key in (FOOTER_PKEY, FOOTER_TIME, FOOTER_FKEYS) if key in footer}
    return Table(
        nan_to_null(spark.read.parquet(path)), role.get(FOOTER_PKEY), role.get(FOOTER_TIME), role.get(FOOTER_FKEYS, {})
    )


def write_database(db: Database, path: str) -> None:
    for name, table in db.tables.items():
        write_table(table, f"{path.rstrip('/')}/{name}.parquet")


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names below a folder on whatever file system holds it."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(status.getPath().getName() for status in fs.listStatus(folder))


def read_database(spark: SparkSession, path: str) -> Database:
    """Every ``name.parquet`` below ``path``."""
    names = [e.removesuffix(".parquet") for e in list_names(spark, path) if e.endswith(".parquet")]
    return Database({n: read_table(spark, f"{path.rstrip('/')}/{n}.parquet") for n in names})


def reindexed_or_loaded(spark: SparkSession, build: Callable[[], Database], store: str | None) -> Database:
    """Build a database and number its keys in time order, or load it where that was stored before."""
    if store is None:
        return reindex(build())
    if not path_exists(spark, f"{store.rstrip('/')}/{DONE}"):
        write_database(reindex(build()), store)
        # written last: a store without it is unfinished
        spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{store.rstrip('/')}/{DONE}")
    return read_database(spark, store)


def describe(db: Database) -> Mapping[str, tuple[str | None, str | None, Mapping[str, str]]]:
    return {n: (t.pkey, t.time_col, dict(t.fkeys)) for n, t in db.tables.items()}
