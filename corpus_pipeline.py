"""Corpus pipeline over documents: five stages, each an operator of vigilflow.llm over all rows that came before.

Each stage takes (spark, docs, sf_dir) and returns the rows it keeps with the columns of documents (the last
adds shard, slot and size_bytes). run() writes each stage's rows to the shared folder and reads them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vigilflow.llm import decontaminate, language, mixing, near_dedup, sharding
from vigilflow.llm.common import written


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language that the labels tell of go: without a letter, or unlike the language that is predicted."""
    return language.keep_known(docs, language.fit(docs))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates, the document of the smallest id stays."""
    return near_dedup.representatives(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources reads them."""
    return mixing.mixed(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shards and slots."""
    return sharding.sharded(docs)


STAGES = [
    ("language", known_language),
    ("near_dedup", one_of_each),
    ("decontaminate", without_benchmark),
    ("mix", mixed),
    ("shard", sharded),
]

#: The language model and the signatures can't be put in SQL; tests/llm compares each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
