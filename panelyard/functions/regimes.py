"""Market regimes by date and by volatility level."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from panelyard import vocab
from panelyard.functions.numeric import as_col


def named_regime(d: Column | str, regimes=vocab.REGIMES) -> Column:
    """Name of the interval that holds the date; a handful of intervals, so a CASE and no join."""
    d = as_col(d)
    out = F.lit("unknown")
    for name, first, last in regimes:
        out = F.when(d.between(F.lit(first).cast("date"), F.lit(last).cast("date")), F.lit(name)).otherwise(out)
    return out


def recession(d: Column | str, spans=vocab.RECESSIONS) -> Column:
    d = as_col(d)
    hit = F.lit(False)
    for first, last in spans:
        hit = hit | d.between(F.lit(first).cast("date"), F.lit(last).cast("date"))
    return F.when(hit, 1.0).otherwise(0.0)


def volatility_state(v: Column | str) -> Column:
    v = as_col(v)
    out = F.lit("unknown")
    for name, low, high in vocab.VOLATILITY_BANDS:
        inside = (v >= low) & (v < (float("inf") if high is None else high))
        out = F.when(inside, F.lit(name)).otherwise(out)
    return out


def similar_regimes(state: Column | str) -> Column:
    state = as_col(state)
    out = F.array().cast("array<string>")
    for name, names in vocab.SIMILAR_REGIMES.items():
        out = F.when(state == name, F.array(*[F.lit(n) for n in names])).otherwise(out)
    return out
