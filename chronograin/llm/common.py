"""Small helpers that the operators share: reading, plain ids, words as bytes, tables in the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronograin.session import prepare, work_path

# rows, and bytes, that reach a Python worker at once; a longer text comes alone
BATCH_ROWS = 1000
BATCH_BYTES = 4 << 20

# ASCII letters and digits and all bytes above 0x7f stay (upper case as lower), the rest becomes a space
ALNUM_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def settle(spark: SparkSession) -> SparkSession:
    """Session settings that the operators count on."""
    prepare(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return settle(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the folder that all executors share and read it back."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remainder(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo n; NULL for a NULL id."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(col.cast("string").cast("binary")) % n


def held_out(doc_id: Column | str, n: int, at: int) -> Column:
    """Whether the row belongs to the held-out fold; a row without id does not."""
    return F.coalesce(remainder(doc_id, n) == at, F.lit(False))


def alnum_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text after A-Z is lower-cased; NULL has none."""
    return text.translate(ALNUM_WORDS).split() if text else []


def space_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` after A-Z is lower-cased: bytes know ASCII case and space only."""
    return text.lower().split() if text else []


def raw_texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    return batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary()).to_pylist()


def per_batch(
    df: DataFrame, fn: Callable[[pa.RecordBatch], dict[str, list]], new: T.StructType, keep: list[str]
) -> DataFrame:
    """Add the columns that ``fn`` computes for each batch to the ``keep`` columns of ``df``."""
    schema = T.StructType([*[df.schema[c] for c in keep], *new.fields])
    types = [(f.name, _arrow(f.dataType)) for f in new.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = fn(batch)
            kept = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays(
                [*kept, *[pa.array(made[n], t) for n, t in types]], [*keep, *[n for n, _ in types]]
            )

    return df.mapInArrow(run, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
