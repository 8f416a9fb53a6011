"""Fixed-width text vectors: hashed term counts, weighted signed hashing, and its leading directions. No vocabulary, whole texts."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronograin.operators.joins import with_constants

# words, of which upper case counts as lower
WORDS = r"[^\x20\x09-\x0D]+"
# rows whose words are counted before they are handed on
COUNTED_ROWS = 256


def hash_embedding(df: DataFrame, text: str, name: str, width: int = 64) -> DataFrame:
    """Add an array of ``width`` numbers: term counts by hash bucket, scaled to length 1."""
    tokens = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda t: t != "")
    hashed = HashingTF(numFeatures=width, inputCol="_tokens", outputCol="_tf").transform(df.withColumn("_tokens", tokens))
    counts = vector_to_array("_tf")
    norm = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda a, x: a + x * x))
    scaled = F.transform("_v", lambda x: F.when(F.col("_norm") > 0, x / F.col("_norm")).otherwise(0.0))
    return (
        hashed.withColumn("_v", counts).withColumn("_norm", norm).withColumn(name, scaled).drop("_tokens", "_tf", "_v", "_norm")
    )


def _digits(term: Column, first: int, n: int) -> Column:
    """Some hex digits of the term's md5, as a number."""
    return F.conv(F.md5(term.cast("binary")).substr(first, n), 16, 10).cast("bigint")


def _word_counts(texts: DataFrame, key: str) -> DataFrame:
    """(key, _term, _n): how often each word occurs in each row of (key, lower-case text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(WORDS).findall
        for batch in batches:
            for start in range(0, batch.num_rows, COUNTED_ROWS):
                part = batch.slice(start, COUNTED_ROWS)
                found = [Counter(find(text)) for text in part.column(1).to_pylist()]
                rows = np.repeat(np.arange(len(found)), [len(c) for c in found])
                terms = pa.array([t for c in found for t in c], pa.string())
                times = pa.array([n for c in found for n in c.values()], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), terms, times], [key, "_term", "_n"])

    schema = T.StructType([texts.schema[key], T.StructField("_term", T.StringType()), T.StructField("_n", T.LongType())])
    return texts.mapInArrow(count, schema)


def weighted_embedding(docs: DataFrame, key: str, text: str, name: str, width: int = 64) -> DataFrame:
    """(key, name): arrays of ``width`` numbers of length 1, by signed hashing of weighted terms.

    A term counts as often as it occurs times ln((1 + texts) / (1 + texts with it)) + 1, so words of all texts say little;
    its md5 names a place and a sign, so terms that share a place cancel out on average. Texts without words,
    NULL included, are zero. Keys are unique; rows without a key are left out. Words are counted within their row, and
    the counts shuffled once, by term, where its rarity is found.
    """
    known = docs.select(key, text).dropna(subset=[key])
    found = _word_counts(known.select(key, F.lower(F.coalesce(text, F.lit(""))).alias("_text")), key)
    counts = found.repartition("_term").groupBy(key, "_term").agg(F.sum("_n").alias("_n"))
    rows = known.agg(F.count(F.lit(1)).alias("_rows"))
    # rows are dealt by term already; a frequent word's counts are buffered on disk
    seen = counts.withColumn("_df", F.count(F.lit(1)).over(Window.partitionBy("_term")))
    # eight digits for the place, one for the sign
    digits, idf = _digits(F.col("_term"), 1, 9), F.log((1 + F.col("_rows")) / (1 + F.col("_df"))) + 1
    drawn = with_constants(seen, rows).select(key, digits.alias("_hex"), (F.col("_n") * idf).alias("_v"))
    sign = 1 - 2 * (F.col("_hex") % 2)
    placed = drawn.select(key, (F.shiftright("_hex", 4) % width).cast("int").alias("_at"), (sign * F.col("_v")).alias("_v"))
    # a text's terms come from all over, so nothing could be added up before
    sums = placed.repartition(key).groupBy(key, "_at").agg(F.sum("_v").alias("_v"))
    entries = F.map_from_entries(F.collect_list(F.struct("_at", "_v")))
    norm = F.sqrt(F.sum(F.col("_v") * F.col("_v")))
    # a text has at most ``width`` places
    found = sums.groupBy(key).agg(entries.alias("_map"), norm.alias("_norm"))
    at = F.sequence(F.lit(0), F.lit(width - 1))
    whole = F.transform(at, lambda i: F.coalesce(F.try_element_at("_map", i) / F.nullif(F.col("_norm"), F.lit(0.0)), F.lit(0.0)))
    return known.select(key).join(found, key, "left").select(key, whole.alias(name))


def weighted_embedding_sql(table: str, key: str, text: str, name: str, width: int, digits: int) -> str:
    """The same vectors in SQL, rounded."""
    return f"""WITH w AS (SELECT {key}, unnest(regexp_extract_all(lower(coalesce({text}, '')), '{WORDS}')) AS term FROM {table} WHERE {key} IS NOT NULL),
    c AS (SELECT {key}, term, count(*) AS n FROM w GROUP BY ALL),
    d AS (SELECT term, ln((1 + (SELECT count(*) FROM {table} WHERE {key} IS NOT NULL)) / (1 + count(*))) + 1 AS idf FROM c GROUP BY term),
    s AS (SELECT {key}, ('0x' || substr(md5(term), 1, 8))::BIGINT % {width} AS place,
      sum((1 - 2 * (('0x' || substr(md5(term), 9, 1))::BIGINT % 2)) * n * idf) AS v FROM c JOIN d USING (term) GROUP BY ALL),
    g AS (SELECT {key}, map_from_entries(list({{k: place, v: v}})) AS m, sqrt(sum(v * v)) AS norm FROM s GROUP BY {key})
    SELECT {key}, list_transform(range({width}), lambda i: round(coalesce(m[i] / nullif(norm, 0), 0), {digits}) + 0.0) AS {name}
    FROM {table} LEFT JOIN g USING ({key}) WHERE {key} IS NOT NULL"""


def leading_directions(vectors: DataFrame, name: str, rank: int) -> np.ndarray:
    """The ``rank`` leading right singular vectors of the rows, as columns; each one's largest entry is positive.

    Tasks send the sums of the products of their rows, width x width numbers, which are added up before the
    driver takes them apart: the number of rows does not matter.
    """

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                rows = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                total = rows.T @ rows + (0 if total is None else total)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["at", "v"])

    sums = vectors.select(F.col(name).cast("array<double>")).mapInArrow(products, "at bigint, v double").groupBy("at").agg(F.sum("v").alias("v"))
    found = sums.orderBy("at").collect()
    if not found:
        return np.empty((0, 0))
    width = round(len(found) ** 0.5)
    _, directions = np.linalg.eigh(np.array([r["v"] for r in found]).reshape(width, width))
    leading = directions[:, ::-1][:, :rank]
    return leading * np.sign(leading[np.abs(leading).argmax(0), np.arange(leading.shape[1])])


def reduced_embedding(vectors: DataFrame, name: str, rank: int) -> DataFrame:
    """``vectors`` with the array ``name`` in terms of its leading directions over all rows: ``rank`` numbers that keep
    as much of the scalar products between texts as any ``rank`` numbers can.
    """
    leading = leading_directions(vectors, name, rank)
    place = vectors.columns.index(name)
    schema = T.StructType([T.StructField(f.name, T.ArrayType(T.DoubleType())) if f.name == name else f for f in vectors.schema.fields])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(place).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(leading))
            out = list(batch.columns)
            out[place] = pa.array((rows @ leading).tolist(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(out, batch.schema.names)

    return vectors.mapInArrow(project, schema)
