"""Backfill with a work ledger: what is done is written down, so a run that broke off goes on with the rest.

A unit of work is a source and a name.  Open units are those that the ledger lacks, by an anti-join.  A batch of units is one folder of data and then
one append to the ledger; readers take the folders that the ledger names, so data of a batch that broke off before its entry is never read.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

LEDGER = "source STRING, name STRING, rows BIGINT, first_date DATE, last_date DATE, folder STRING"


def ledger(spark: SparkSession, root: str) -> DataFrame:
    try:
        return spark.read.schema(LEDGER).parquet(f"{root}/ledger")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], LEDGER)


def open_names(spark: SparkSession, root: str, source: str, names: DataFrame) -> DataFrame:
    """The names (column ``name``) of a source that are still to do."""
    done = ledger(spark, root).where(F.col("source") == source).select("name")
    return names.select("name").distinct().join(done, "name", "left_anti")


def backfill(spark: SparkSession, root: str, sources: Mapping[str, tuple[DataFrame, DataFrame]], most_batches: int | None = None,
             batches: int = 4) -> int:
    """Do the open units of every source; returns the number of batches done.

    ``sources``: by name its rows (columns ``name``, ``date`` and more) and the names asked for.  A name without rows is done too, with 0 rows.  ``batches``
    is the number of batches a source is dealt in, ``most_batches`` ends a run early.
    """
    done = 0
    for source, (rows, names) in sources.items():
        for number in range(batches):
            part = open_names(spark, root, source, names).where(F.pmod(F.xxhash64("name"), F.lit(batches)) == number)
            if part.isEmpty():
                continue
            if most_batches is not None and done >= most_batches:
                return done
            folder = f"{root}/data/{source}-{uuid.uuid4().hex[:12]}"
            rows.join(part, "name", "left_semi").write.parquet(folder)
            found = spark.read.parquet(folder).groupBy("name").agg(
                F.count("*").alias("rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
            entries = part.join(found, "name", "left").select(
                F.lit(source).alias("source"), "name", F.coalesce("rows", F.lit(0)).cast("bigint").alias("rows"), "first_date", "last_date", F.lit(folder).alias("folder"))
            entries.write.mode("append").parquet(f"{root}/ledger")
            done += 1
    return done


def loaded(spark: SparkSession, root: str, source: str) -> DataFrame:
    """All rows of a source that the ledger vouches for."""
    folders = [r["folder"] for r in ledger(spark, root).where((F.col("source") == source) & (F.col("rows") > 0)).select("folder").distinct().collect()]
    if not folders:
        raise ValueError(f"nothing is loaded of {source!r}")
    return spark.read.parquet(*folders)
