"""Compare registered queries with their SQL twins: ``python tests/check.py [sf] [prefix ..]``."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(value):
    """Values as they compare: floats exactly, nested values as tuples."""
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in sorted(value.items()))
    if hasattr(value, "asDict"):
        return plain(value.asDict())
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(query, sql, spark, sf_dir, con) -> str:
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    if sql is None:
        return f"rows {sum(got.values())} (no sql)"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"FAIL columns {sorted(df.columns)} != {sorted(names)}"
    if got != want:
        extra, missing = list((got - want).items())[:2], list((want - got).items())[:2]
        return f"FAIL rows {sum(got.values())} / {sum(want.values())}\n  extra {extra}\n  missing {missing}"
    return f"ok rows {sum(got.values())}" + ("" if got else " EMPTY")


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from chronograin.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
    prefixes = sys.argv[2:]
    sf_dir = f"/root/testdata/{sf}"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con, sql = connect(sf_dir), oracle_sql()
    bad = 0
    for name, query in queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            outcome = compare(query, sql.get(name), spark, sf_dir, con)
        except Exception as error:  # noqa: BLE001 - report and go on
            outcome = f"FAIL {type(error).__name__}: {str(error)[:600]}"
        bad += outcome.startswith("FAIL")
        print(f"{time.time() - start:6.1f}s {name}: {outcome}", flush=True)
    print("failures:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
