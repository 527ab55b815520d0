"""Can a removed name's recovered series be trusted for the window it was a member?"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from panelyard import vocab
from panelyard.functions.calendar import business_days
from panelyard.functions.text import looks_delisted
from panelyard.operators.intervals import removed_names


def membership_windows(spells: DataFrame, floor: str, today: str) -> DataFrame:
    """Per ticker the first start and last end of its spells inside [floor, today]."""
    begin = F.greatest(F.col("start"), F.lit(floor).cast("date"))
    end = F.coalesce("end", F.lit(today).cast("date"))
    return spells.select("ticker", begin.alias("b"), end.alias("e")).where("e > b").groupBy("ticker").agg(
        F.min("b").alias("window_start"), F.max("e").alias("window_end"))


def survey_removed(universe: DataFrame, changes: DataFrame, spells: DataFrame, bars: DataFrame, floor: str,
                   today: str) -> DataFrame:
    """One row per removed name with its coverage and verdict."""
    names = removed_names(universe, changes).join(membership_windows(spells, floor, today), "ticker")
    inside = F.col("date").between(F.col("window_start"), F.col("window_end"))
    seen = bars.join(names.select("ticker", "window_start", "window_end"), "ticker").groupBy("ticker").agg(
        F.count("*").alias("rows"), F.max("date").alias("last_date"), F.count_if(inside).alias("inside"))
    out = names.join(seen, "ticker", "left").withColumns({
        "rows": F.coalesce("rows", F.lit(0)), "delisting": looks_delisted("reason"),
        "coverage": F.coalesce(F.col("inside") / F.greatest(
            business_days("window_start", "window_end"), F.lit(1)), F.lit(0.0)),
    })
    overrun = F.date_diff("last_date", "removal_date")
    status = F.when(F.col("rows") == 0, "no data").when(
        F.col("delisting") & (overrun > vocab.TAIL_DAYS), "ticker reused by another company").when(
        F.col("coverage") < vocab.MIN_COVERAGE, "too little of the membership window").otherwise("ok")
    return out.select("ticker", "removal_date", "delisting", "rows", "last_date", "window_start", "window_end",
                      "coverage", status.alias("status"))
