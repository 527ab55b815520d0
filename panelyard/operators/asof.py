"""As-of joins on the calendar: last known value at or before a day.

Both sides are laid on one timeline per entity (a union) and the last value is carried by a
running window; there is no inequality join and hence no row blow-up.  The right side is first
folded to one row per entity and day, so a window partition is bounded by the calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from panelyard.functions.calendar import day_number
from panelyard.functions.rolling import Trailing


def fold_by_day(df: DataFrame, key: str, day: str, aggregates: dict[str, Column]) -> DataFrame:
    return df.groupBy(key, day).agg(*[a.alias(n) for n, a in aggregates.items()])


def timeline(left: DataFrame, rights: list[tuple[DataFrame, str]], key: str = "ticker", day: str = "date") -> DataFrame:
    """Union of ``left`` rows (marked ``is_row``) with folded right sides, plus the ``day`` number."""
    out = left.withColumn("is_row", F.lit(True))
    for right, right_day in rights:
        side = right.withColumnRenamed(right_day, day).withColumn("is_row", F.lit(False))
        out = out.unionByName(side, allowMissingColumns=True)
    return out.withColumn("day", day_number(day))


def carry(line: DataFrame, columns: list[str], key: str = "ticker") -> DataFrame:
    """Replace each column by its last non-null value so far, the same day included."""
    t = Trailing([key])
    return line.withColumns({c: t.filled(c) for c in columns})


def as_of(left: DataFrame, right: DataFrame, right_day: str, columns: list[str], key: str = "ticker",
          day: str = "date") -> DataFrame:
    """Backward, inclusive as-of join; every column is carried on its own.

    ``right`` must hold one row per key and day (see :func:`fold_by_day`).
    """
    line = timeline(left, [(right.select(key, right_day, *columns), right_day)], key, day)
    return carry(line, columns, key).where("is_row").drop("is_row", "day")
