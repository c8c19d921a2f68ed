"""Training-data pipeline over ``documents``: five stages, each written as Parquet and read again before the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import line_dedup, packing, quality_fm, simhash, toxicity, word_tokens
from tidemark.llm.common import scratch_path
from tidemark.llm.queries import END_ID, WORD_VOCABULARY


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the quality classifier scores 0.3 or more."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_fm.accepted(docs, quality_fm.train(docs, labels, learn=quality_fm.learn_fold(5, 0)), threshold=0.3)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the toxicity grammar scores below 0.3."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.accepted(docs, toxicity.train(docs, labels, learn=toxicity.learn_fold(4, 2)), threshold=0.3)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove repeated chunks of lines; every document stays."""
    return line_dedup.remove_repeated_chunks(docs).drop("lines_removed", "lines_kept")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies: near-equal SimHash fingerprints, or five-word shingles alike to 0.8 or more."""
    return simhash.keep_one(docs, jaccard=0.8)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 2048 tokens."""
    vocabulary = word_tokens.read_vocabulary(public_tokenizers.path(WORD_VOCABULARY))
    return packing.pack(docs, vocabulary, END_ID, window=2048, digests=True)


STAGES = [("quality", quality), ("toxicity", toxic), ("line_dedup", lines), ("simhash", near_copies), ("packing", pack)]

#: Trained classifiers, SimHash and tokenisation have no SQL form; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
