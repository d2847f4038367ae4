"""Corpus pipeline: documents through quality rules, near-duplicate removal, decontamination, mixing and token output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evidlake.llm import decontam, mixing, neardup, quality, sstable
from evidlake.llm.queries import tokenizer_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, _table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, _table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs, quality=mixing.label_weights(_table(spark, sf_dir, "labels")))


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sstable.token_output(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source mix", source_mix),
    ("token output", token_output),
]

#: The exact bounds, the similarity classes and the tokenizer are beyond SQL; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage on all that the one before kept, written as Parquet in the shared folder between them."""
    from evidlake.llm.shared import new_folder

    docs, folder = _table(spark, sf_dir, "documents"), new_folder(spark, "pipeline")
    for n, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{n}")
        docs = spark.read.parquet(f"{folder}/{n}")
    return STAGES[-1][1](spark, docs, sf_dir)
