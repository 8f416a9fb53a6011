"""The corpus pipeline: documents in, token files out, stage by stage.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; what a stage returns is written as Parquet and read
again as the ``docs`` of the next. All but the last return the columns of documents. NULLs, repeated
rows and empty tables are treated as the operators in ``chronograin.llm`` define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronograin.llm import decontaminate, mixing, quality, simhash_dedup, token_files
from chronograin.llm.common import settle, stored, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    settle(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id."""
    settle(spark)
    return simhash_dedup.drop_near_duplicates(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    settle(spark)
    tagged = docs.select(F.struct(*docs.columns).alias("_row"), "text")
    found = decontaminate.find_contamination(tagged, table(spark, sf_dir, "benchmark"), keep=["_row"])
    return found.where(~F.col("contaminated")).select("_row.*")


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often, and as far, as their source's quota takes them."""
    return mixing.mix_texts(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, and what they hold of each of its rows."""
    settle(spark)
    return token_files.token_files(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("token_output", token_output),
]

# trained scores and seeded choices are no SQL; tests compare the stages with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, from the table documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
