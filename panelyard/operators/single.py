"""Put a one-row aggregate (or a handful of rows) beside every row of a large table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def beside(rows: DataFrame, few: DataFrame) -> DataFrame:
    """Add the columns of ``few`` to all rows.

    ``few`` must be a global aggregate (one row) or one row per fold: its size is fixed by
    construction, so it is sent to every task and ``rows`` is not shuffled.
    """
    key = F.lit(0)
    return rows.withColumn("__one", key).join(F.broadcast(few.withColumn("__one", key)), "__one").drop("__one")
