"""Purged, embargoed walk-forward folds over dates.

Only the distinct dates are numbered (a table bounded by the calendar); rows get their fold by an
equi-join on the date, so every row of a date lands on the same side.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from panelyard.operators.single import beside


@dataclass(frozen=True)
class FoldSpec:
    n_splits: int = 5
    test_size: int = 252
    purge: int = 5
    embargo: int = 10

    def __post_init__(self):
        if self.n_splits < 1 or self.test_size < 1:
            raise ValueError("n_splits and test_size must be at least 1")
        if self.purge < 0 or self.embargo < 0:
            raise ValueError("purge and embargo must not be negative")

    def least_dates(self) -> int:
        return self.n_splits * self.test_size + self.purge + 1

    def rescaled(self, stride: int) -> "FoldSpec":
        """The same windows counted in kept dates when only every ``stride``-th date is kept."""
        return FoldSpec(self.n_splits, max(1, round(self.test_size / stride)),
                        max(1, math.ceil(self.purge / stride)), max(1, math.ceil(self.embargo / stride)))


def numbered_dates(rows: DataFrame, date: str = "date") -> DataFrame:
    """Distinct dates with position (from 0) and their number; one small partition by design."""
    days = rows.select(F.col(date).alias("date")).distinct()
    order = Window.orderBy("date")
    return days.withColumn("pos", F.row_number().over(order) - 1).withColumn(
        "n_dates", F.count("*").over(Window.partitionBy(F.lit(0))).cast("int"))


def fold_dates(rows: DataFrame, spec: FoldSpec, date: str = "date") -> DataFrame:
    """(fold, date, role): role is ``train`` or ``test``; purged and embargoed dates are absent."""
    n, pos, fold = F.col("n_dates"), F.col("pos"), F.col("fold")
    days = numbered_dates(rows, date).withColumn("checked", F.when(
        n < spec.least_dates(),
        F.raise_error(F.concat(F.lit(f"need at least {spec.least_dates()} dates, got "), n.cast("string")))
    ).otherwise(F.lit(True))).where("checked")
    first = n - spec.n_splits * spec.test_size
    start = first + fold * spec.test_size
    each = days.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(spec.n_splits - 1))))
    lingering = F.exists(
        F.sequence(F.lit(1), F.greatest(fold, F.lit(1))),
        lambda g: (g <= fold) & (pos >= first + g * spec.test_size)
        & (pos < F.least(first + g * spec.test_size + spec.embargo, n)),
    )
    role = F.when((pos >= start) & (pos < start + spec.test_size), "test").when(
        (pos < start - spec.purge) & ~lingering, "train")
    return each.withColumn("role", role).where("role IS NOT NULL").select("fold", "date", "role")


def thinned_dates(rows: DataFrame, max_rows: int | None = None, stride: int | None = None,
                  date: str = "date") -> DataFrame:
    """Every stride-th date; the stride follows from the row count unless it is given."""
    days = numbered_dates(rows, date)
    if stride is not None:
        days = days.withColumn("stride", F.lit(max(stride, 1)))
    else:
        total = rows.agg(F.count("*").alias("total"))
        limit = F.when((F.lit(max_rows) <= 0) | (F.col("total") <= max_rows), 1).otherwise(
            F.greatest(F.lit(2), F.ceil(F.col("total") / F.lit(max(max_rows, 1))))).cast("int")
        days = beside(days, total.select(limit.alias("stride")))
    return days.where(F.col("pos") % F.col("stride") == 0).select("date", "stride")


def recent_rows(rows: DataFrame, at_least: int, date: str = "date") -> DataFrame:
    """The rows of the most recent whole dates that hold ``at_least`` rows together; all rows, if there are fewer."""
    if at_least < 1:
        raise ValueError("a tail holds at least one row")
    per_date = rows.groupBy(F.col(date).alias("tail_date")).agg(F.count("*").alias("n"))
    later = F.sum("n").over(Window.orderBy(F.desc("tail_date")).rowsBetween(Window.unboundedPreceding, -1))  # distinct dates only
    kept = per_date.withColumn("later", F.coalesce(later, F.lit(0))).where(F.col("later") < at_least).select("tail_date")
    return rows.join(kept, F.col(date) == F.col("tail_date"), "left_semi")


def inner_validation(dates: DataFrame, test_size: int, horizon: int) -> DataFrame:
    """Split training dates into ``fit`` and the last stretch ``valid``, a horizon apart.

    ``dates`` holds (fold, date) of training dates; bounded by the calendar.
    """
    w = Window.partitionBy("fold").orderBy(F.desc("date"))
    total = F.count("*").over(Window.partitionBy("fold"))
    back = dates.select("fold", "date").distinct().withColumn("back", F.row_number().over(w)).withColumn("n", total)
    tail = F.least(F.lit(test_size), F.greatest(F.floor(F.col("n") / 5), F.lit(1)))
    usable = F.col("n") > tail + horizon + 5
    part = F.when(~usable, "fit").when(F.col("back") <= tail, "valid").when(
        F.col("back") > tail + horizon, "fit")
    return back.withColumn("part", part).where("part IS NOT NULL").select("fold", "date", "part")
