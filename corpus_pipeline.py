"""A training corpus from `documents`: good documents, one of each group of near copies, without benchmark passages,
mixed to target weights, as token shards.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame; `run` writes it as Parquet
to the shared folder and reads it back as the next stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import decontam, mix, quality, simhash, tokens
from lodestone.llm.common import materialise, table
from lodestone.llm.queries import tokenizer_path


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier scores below 0.7."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each SimHash component."""
    return simhash.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a window of a benchmark item."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"), "documents")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mix.mixed_rows(docs)


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Written as token shards: where each document's ids lie, how many they are, and their checksum."""
    return tokens.digests(spark, tokens.write(docs, tokenizer_path()))


STAGES = [
    ("quality classifier", good_documents),
    ("SimHash near-dedup", one_of_each),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources to target weights", mixed),
    ("token-ID / binary output", token_shards),
]

#: The quality classifier's scores aren't SQL; tests/llm/test_models.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = materialise(stage(spark, docs, sf_dir), f"stage{number}")
    return docs
