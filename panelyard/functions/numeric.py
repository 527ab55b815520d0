"""Null-safe arithmetic: NaN, infinity and division by zero all become NULL."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """NaN and infinite values as NULL."""
    c = as_col(c).cast("double")
    return F.when(F.abs(c) < F.lit(float("inf")), c)


def ratio(a: Column | str, b: Column | str) -> Column:
    return F.try_divide(as_col(a), as_col(b))


def growth(now: Column | str, before: Column | str) -> Column:
    """Relative change from ``before`` to ``now``."""
    return ratio(now, before) - 1.0


def settle(c: Column | str, digits: int = 6) -> Column:
    """Round with plain double steps, so that every engine gets the same value.

    The border lies a little below one half: sums in another order may differ in their last bits,
    and values that are exactly one half in decimal must still go the same way.
    """
    scale = float(10**digits)
    return F.floor(as_col(c).cast("double") * scale + 0.5001) / scale
