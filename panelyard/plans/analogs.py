"""Historical situations that look like today's."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from panelyard import vocab
from panelyard.functions.numeric import finite
from panelyard.operators.neighbours import nearest
from panelyard.operators.single import beside
from panelyard.plans.panel import latest_rows


def moments(rows: DataFrame, features) -> DataFrame:
    """One row: arrays of means and population deviations (zero deviations become 1)."""
    filled = [F.coalesce(finite(c), F.lit(0.0)) for c in features]
    return rows.agg(
        F.array(*[F.avg(c) for c in filled]).alias("centre"),
        F.array(*[F.coalesce(F.nullif(F.stddev_pop(c), F.lit(0.0)), F.lit(1.0)) for c in filled]).alias("spread"))


def standardised(rows: DataFrame, features, scale: DataFrame) -> DataFrame:
    """Adds ``vec``: the features, missing as 0, standardised with the given one-row moments."""
    raw = F.array(*[F.coalesce(finite(c), F.lit(0.0)) for c in features])
    joined = beside(rows, scale)
    vec = F.transform(raw, lambda x, i: (x - F.get("centre", i)) / F.get("spread", i))
    return joined.withColumn("vec", vec).drop("centre", "spread")


def find_analogs(panel: DataFrame, k: int = 5, features=vocab.ANALOG_FEATURES) -> DataFrame:
    """For the last row of every ticker, its k nearest earlier rows of other tickers, with outcomes.

    The index holds every row with a resolved 5-day label.
    """
    label = F.col("label_direction_5d")
    outcomes = ["forward_return_5d", "forward_return_20d", "label_direction_5d"]
    index = panel.where(label.isNotNull()).select("ticker", "date", *features, *outcomes)
    scale = moments(index, features)
    key = F.concat_ws("|", F.col("ticker"), F.col("date").cast("string"))
    history = standardised(index, features, scale).select(
        key.alias("id"), F.col("ticker").alias("owner"), F.unix_date("date").alias("day"), "vec")
    queries = standardised(latest_rows(panel, list(features)), features, scale).select(
        F.col("ticker").alias("query_id"), F.col("ticker").alias("owner"), F.unix_date("date").alias("day"), "vec")
    found = nearest(history, queries, k)
    # ids carry the key, so the outcomes come from an equi-join with k rows per ticker
    back = found.select(
        F.col("query_id").alias("ticker"), "place", "distance",
        F.split_part("id", F.lit("|"), F.lit(1)).alias("match_ticker"),
        F.split_part("id", F.lit("|"), F.lit(2)).cast("date").alias("match_date"))
    facts = index.select(F.col("ticker").alias("match_ticker"), F.col("date").alias("match_date"), *outcomes)
    names = F.array(*[F.lit(n) for n in vocab.DIRECTION_NAMES])
    return back.join(facts, ["match_ticker", "match_date"]).withColumn(
        "outcome_5d", F.get(names, F.col("label_direction_5d"))).drop("label_direction_5d")
