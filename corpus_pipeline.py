"""A training corpus from raw documents: quality, lines, near duplicates, benchmark leaks, token sequences.

Every stage takes (spark, docs, sf_dir) and works on all its predecessor kept; its result is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelyard.llm import decontamination, jaccard, lines, packing, quality
from panelyard.session import stored

SHINGLE, PERCENT = 5, 80  # near duplicates: five words, similarity 0.8


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines equal or within one edit to an earlier line go, and so do documents that have words and keep none; documents that were blank stay."""
    return lines.dedup_lines(docs, keep_emptied=False)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return jaccard.one_of_each_group(docs, SHINGLE, PERCENT)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    return decontamination.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of token sequences that hold what is left."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", good_quality),
    ("line_dedup", distinct_lines),
    ("ngram_jaccard_join", distinct_documents),
    ("benchmark_decontamination", without_benchmark),
    ("packing", packed),
]

ORACLE_SQL = None  # a linear model, edit distances and a tokenizer are beyond SQL; tests/llm hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
