"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, packing.

``STAGES`` lists the stages; each takes ``(spark, docs, sf_dir)`` and returns a
DataFrame that is written as Parquet and read again as the next stage's ``docs``.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrolens.llm import line_dedup, minhash, packing, quality
from hydrolens.llm.common import byte_bpe_path
from hydrolens.session import scratch_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects, with the columns they came with."""
    return quality.passing(docs)


def boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their columns, without the lines found on many sites; ``n_chars`` follows the text."""
    out = line_dedup.dedup_lines(docs, scratch_path(spark, "pipeline", "lines"), counts=("__lines", "__removed"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(
            docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return minhash.drop_near_duplicates(docs, scratch_path(spark, "pipeline", "near"))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens, with their ids."""
    return packing.pack(docs, byte_bpe_path(), scratch_path(spark, "pipeline", "packing"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", boilerplate_lines),
    ("near_dedup", near_duplicates),
    ("packing", packed_sequences),
]

#: SQL has no tokenizer, so it cannot express the last stage.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, "pipeline", name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
