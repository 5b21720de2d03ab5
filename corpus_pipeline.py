"""The corpus pipeline: what a crawl goes through before training, one operator a stage.

Each stage takes `(spark, docs, sf_dir)` and returns a DataFrame, which is written as Parquet and read
again as the next stage's `docs`. All but the last keep the columns of `documents`.
Stages that go through Python lower the session's limits of Arrow batches (`small_batches`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillion.llm import decontaminate, ngram_jaccard, packing, pii_crf, quality_rules
from quillion.plans.scratch import Scratch, small_batches


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines cleaned; documents that lose too much are gone."""
    return quality_rules.clean(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return ngram_jaccard.drop_near_duplicates(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages cut out; documents that consist of them are gone."""
    small_batches(spark)
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind."""
    small_batches(spark)
    return pii_crf.mask_documents(docs)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their bin and offset."""
    small_batches(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", apply_quality_rules),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", decontaminate_benchmark),
    ("PII", mask_personal_data),
    ("best-fit packing", pack_documents),
]

#: The field of the PII stage and the rounds of the packing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read by the next."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return docs
