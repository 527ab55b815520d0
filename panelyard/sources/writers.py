"""Sinks: partitioned Parquet with repeatable writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


RUN_PARTS = 16  # tasks that write one day's run


def write_panel(panel: DataFrame, path: str) -> None:
    """Panel ordered by date then ticker, one folder per year."""
    rows = panel.withColumn("year", F.year("date"))
    rows.repartitionByRange("year", "date", "ticker").sortWithinPartitions("year", "date", "ticker").write.mode(
        "overwrite").partitionBy("year").parquet(path)


def write_scores(scores: DataFrame, path: str) -> None:
    """One folder per day; writing a day again replaces that day only."""
    scores.repartition("as_of", F.pmod(F.xxhash64("ticker"), F.lit(RUN_PARTS))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "as_of").parquet(path)


def latest_scores(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the newest day; only the partition column is read to find it."""
    rows = spark.read.parquet(path)
    return rows.join(rows.agg(F.max("as_of").alias("as_of")), "as_of", "left_semi")


def write_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("target").parquet(path)


def write_report(rows: DataFrame, path: str) -> None:
    """A report is a table; Parquet's commit makes the replacement atomic for readers."""
    rows.write.mode("overwrite").parquet(path)
