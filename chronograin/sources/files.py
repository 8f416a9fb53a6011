"""Text sources and sinks. Schemas are explicit; ``.gz`` input is read as it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

Schema = StructType | str

_QUOTING = {"quote": '"', "escape": '"'}


def read_csv(spark: SparkSession, path: str, schema: Schema, *, multi_line: bool = False) -> DataFrame:
    """Comma separated with a header. Quoted line breaks need ``multi_line`` (one task per file)."""
    return read_delimited(spark, path, schema, ",", multi_line=multi_line)


def read_delimited(
    spark: SparkSession, path: str, schema: Schema, sep: str = "|", *, multi_line: bool = False
) -> DataFrame:
    reader = spark.read.options(header=True, sep=sep, multiLine=multi_line, **_QUOTING)
    return reader.schema(schema).csv(path)


def read_json_lines(spark: SparkSession, path: str, schema: Schema) -> DataFrame:
    """One JSON object per line; fields outside the schema are ignored."""
    return spark.read.schema(schema).json(path)


def read_json_lines_tolerant(spark: SparkSession, path: str, schema: Schema) -> DataFrame:
    """As above, skipping lines that do not parse.

    Every line is parsed with a slot for bad input, because a reader that prunes columns would
    let a broken line pass when only sound fields are asked for.
    """
    text = schema if isinstance(schema, str) else ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields
    )
    parsed = F.from_json("value", f"{text}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    rows = spark.read.text(path).select(parsed.alias("_row")).where(F.col("_row._bad").isNull())
    return rows.select("_row.*").drop("_bad")


def read_parquet_parts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def count_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row: the number of lines."""
    return spark.read.text(path).agg(F.count(F.lit(1)).alias("n_lines"))


def count_documents(spark: SparkSession, path: str, continues: str) -> DataFrame:
    """One row: the number of documents; lines that go on with another document's list do not count."""
    whole = F.get_json_object("value", f"$.{continues}").isNull()
    return spark.read.text(path).agg(F.count_if(whole).alias("n_lines"))


def write_csv(df: DataFrame, path: str, *, sep: str = ",", compression: str | None = None) -> None:
    writer = df.write.mode("errorifexists").options(header=True, sep=sep, **_QUOTING)
    writer.csv(path, compression=compression)


def write_json_lines(df: DataFrame, path: str, *, compression: str | None = None) -> None:
    """One JSON object per line, NULL fields kept."""
    df.write.mode("errorifexists").option("ignoreNullFields", "false").json(path, compression=compression)


def write_text(df: DataFrame, line: Column, path: str) -> None:
    df.select(line.alias("value")).write.mode("errorifexists").text(path)


def to_json_line(*cols: Column) -> Column:
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})
