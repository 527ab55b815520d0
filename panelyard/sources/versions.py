"""Panels by version: data first, then one row of a manifest, so a reader sees a whole panel or the one before.

Every commit writes its data to a folder of its own, reads back what it wrote, and appends the identity of that to the manifest.  The manifest's
last row is the pointer that readers follow; a write that fails before it leaves the old version in place.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from panelyard import vocab
from panelyard.functions.text import schema_fingerprint
from panelyard.sources.writers import write_panel

MANIFEST = "version BIGINT, path STRING, panel_id STRING, schema STRING, tickers BIGINT, rows BIGINT, start DATE, end DATE"


class NoVersion(RuntimeError):
    """There is no such version, or it is not what the reader expects."""


def versions(spark: SparkSession, root: str) -> DataFrame:
    """All committed versions; none yet is an empty table."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{root}/manifest")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], MANIFEST)


def commit_panel(panel: DataFrame, root: str, features=vocab.FEATURES) -> int:
    """Write a further version and point readers to it."""
    from panelyard.plans.panel import panel_identity

    spark = panel.sparkSession
    last = versions(spark, root).agg(F.max("version")).first()[0]
    version = 1 if last is None else last + 1
    path = f"{root}/data/v{version}-{uuid.uuid4().hex[:8]}"
    write_panel(panel, path)
    identity = panel_identity(spark.read.parquet(path), features)
    row = identity.select(F.lit(version).cast("bigint").alias("version"), F.lit(path).alias("path"), "panel_id", "schema",
                          *[F.col(c).cast("bigint").alias(c) for c in ("tickers", "rows")], "start", "end")
    row.coalesce(1).write.mode("append").parquet(f"{root}/manifest")  # one row
    return version


def read_panel(spark: SparkSession, root: str, version: int | None = None, panel_id: str | None = None, features=vocab.FEATURES) -> DataFrame:
    """The newest version, or a given one; refused if its panel id or its features are not those expected."""
    known = versions(spark, root)
    wanted = known if version is None else known.where(F.col("version") == version)
    row = wanted.orderBy(F.desc("version")).first()
    if row is None:
        raise NoVersion(f"no version {'' if version is None else version} of a panel in {root}")
    expected = spark.range(1).select(schema_fingerprint(features)).first()[0]
    if row["schema"] != expected:
        raise NoVersion(f"version {row['version']} has features {row['schema']}, not {expected}")
    if panel_id is not None and row["panel_id"] != panel_id:
        raise NoVersion(f"version {row['version']} is panel {row['panel_id']}, not {panel_id}")
    return spark.read.parquet(row["path"])
