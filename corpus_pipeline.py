"""The corpus pipeline: documents in, token digests of clean, distinct documents out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from axisframe.llm import decontaminate, exact, near, quality, queries
from axisframe.llm.common import opened
from axisframe.plans.lineage import materialise, new_path, remove, write_table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble accepts, all columns; it learns from the labels of the documents it is given.

    Null texts count as empty, and empty ones get the verdict on an empty text; equal texts get equal verdicts, so
    repeated rows stay or go together; without labels every row stays; an empty table gives an empty one.
    """
    docs = opened(docs)
    return quality.keep_good(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, all columns: that with the largest id.

    Null and empty texts are one text. Null ids come before all others; of rows that repeat text and id one stays. An
    empty table gives an empty one.
    """
    return exact.drop_copies(opened(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, all columns: that with the smallest id.

    Null and wordless texts and rows with a null id are each their own class and stay; of rows that repeat an id one
    stays. An empty table gives an empty one.
    """
    docs = opened(docs)
    return near.kept_rows(docs, near.classes(docs), "doc_id")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark, all columns.

    Null and wordless texts stay, repeated rows stay or go together, null or empty items match nothing; an empty table
    or benchmark is no error.
    """
    return decontaminate.drop_leaks(opened(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of every document that is left: a row a row, null text counting as empty."""
    return queries.encode(opened(docs))


STAGES = [("quality", good_quality), ("exact dedup", exact_dedup), ("near dedup", near_dedup), ("decontamination", decontamination), ("byte bpe", byte_bpe)]

#: The stages are models and searches that SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's rows are written once to the shared folder for the next, then those before are deleted."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-2]:
        path = new_path(spark)
        docs = write_table(stage(spark, docs, sf_dir), path)
        if before:
            remove(spark, before)
        before = path
    docs = materialise(STAGES[-2][1](spark, docs, sf_dir))
    remove(spark, before)
    return STAGES[-1][1](spark, docs, sf_dir)
