"""Keep-one rules as aggregates.

An aggregate combines on the map side, so a key that holds a third of all rows still reaches its
reducer as one row per task; a ranking window would pull all its rows into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def keep_one(df: DataFrame, keys: list[str], order: list[Column], last: bool = False) -> DataFrame:
    """The first (or last) row of each key in the given order; order must be total to be repeatable."""
    row = F.struct(*[F.col(c) for c in df.columns if c not in keys])
    pick = (F.max_by if last else F.min_by)(row, F.struct(*order)).alias("__row")
    return df.groupBy(*keys).agg(pick).select(*keys, "__row.*").select(*df.columns)
