"""Drift, the retraining decision, and the health of the feedback loop."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from panelyard import vocab
from panelyard.operators.drift import feature_drift
from panelyard.operators.single import beside


def split_by_age(panel: DataFrame, days: int = vocab.LIVE_WINDOW_DAYS) -> DataFrame:
    """Mark the rows of the last ``days`` days as live."""
    rows = beside(panel, panel.agg(F.max("date").alias("last_date")))
    return rows.withColumn("live", F.col("date") >= F.date_sub("last_date", days)).drop("last_date")


def drift_report(panel: DataFrame, features: list[str]) -> DataFrame:
    return feature_drift(split_by_age(panel), features, "live")


def decide(panel: DataFrame, features: list[str], today: str, last_full: str | None, last_incremental: str | None,
           least_reference: int = 1000, least_live: int = 200) -> DataFrame:
    """One row: should a retrain run, of which kind, and why.  Drift beats the calendar."""
    marked = split_by_age(panel)
    counts = marked.agg(F.count_if(~F.col("live")).alias("n_ref"), F.count_if("live").alias("n_live"))
    worst = feature_drift(marked, features, "live").agg(
        F.max("psi").alias("psi"), F.max_by("feature", F.struct("psi", "feature")).alias("feature"))
    one = beside(counts, worst)
    enough = (F.col("n_ref") > least_reference) & (F.col("n_live") > least_live)
    drifted = enough & (F.col("psi") >= vocab.PSI_RETRAIN)

    def age(day):
        return F.date_diff(F.lit(today).cast("date"), F.lit(day).cast("date"))

    full, part = age(last_full), age(last_incremental)
    mode = F.when(drifted, "full").when(full.isNull() | (full >= vocab.FULL_RETRAIN_DAYS), "full").when(
        part.isNull() | (part >= vocab.INCREMENTAL_DAYS), "incremental").otherwise("none")
    reason = F.when(drifted, F.format_string("PSI %.3f on %s exceeds %.1f", "psi", "feature", F.lit(vocab.PSI_RETRAIN))).when(
        full.isNull(), F.lit("no recorded training run")).when(
        full >= vocab.FULL_RETRAIN_DAYS, F.format_string("%d days since the last full retrain", full)).when(
        part.isNull(), F.lit("no recorded incremental update")).when(
        part >= vocab.INCREMENTAL_DAYS, F.format_string("%d days since the last update", part)).otherwise(
        F.lit("nothing is due"))
    return one.select((mode != "none").alias("should_run"), mode.alias("mode"), reason.alias("reason"))


def system_report(health: DataFrame, distribution: DataFrame, live: DataFrame, drift: DataFrame | None = None, worst: int = 10) -> DataFrame:
    """One row: the feedback loop, recent predictions, live skill, and drift with its advice.

    ``health`` is one row; ``distribution`` has a row per target and class, ``live`` a row per target and model, ``drift`` a row per feature.
    """
    def folded(table: DataFrame, name: str) -> DataFrame:
        # maps have no order: as entries they can stand in a sorted list
        plain = [F.sort_array(F.map_entries(c)).alias(c) if kind.startswith("map") else F.col(c) for c, kind in table.dtypes]
        return table.agg(F.sort_array(F.collect_list(F.struct(*plain))).alias(name))

    out = health.select(F.struct(*health.columns).alias("feedback_loop"))
    out = beside(beside(out, folded(distribution, "predictions")), folded(live, "live_skill"))
    if drift is None:
        return out.withColumn("drift", F.lit(None))
    order = F.struct((-F.col("psi")).alias("order"), "feature", "psi", "verdict")
    sums = drift.agg(F.slice(F.sort_array(F.collect_list(order)), 1, worst).alias("ranked"), F.count_if(F.col("verdict") == "significant").alias("significant_count"),
                     F.coalesce(F.max("psi") >= vocab.PSI_RETRAIN, F.lit(False)).alias("retrain_recommended"))
    named = F.transform("ranked", lambda r: F.struct(r["feature"].alias("feature"), r["psi"].alias("psi"), r["verdict"].alias("verdict")))
    return beside(out, sums.select(F.struct(named.alias("worst"), "significant_count", "retrain_recommended").alias("drift")))
