"""Population stability of features between a reference and a live sample."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from panelyard import vocab
from panelyard.operators.quantiles import exact_quantiles

DECILES = [i / 10 for i in range(11)]


def psi_verdict(psi):
    return F.when(psi < vocab.PSI_MODERATE, "stable").when(psi < vocab.PSI_SIGNIFICANT, "moderate").otherwise(
        "significant")


def feature_drift(rows: DataFrame, features: list[str], live: str) -> DataFrame:
    """(feature, psi, verdict).  ``live`` is a boolean column: FALSE rows are the reference.

    Bins are the reference deciles with open ends; missing values are a bin of their own.  All
    features go through one long table, so the number of jobs does not grow with the features.
    A constant reference gives 0; an empty one is left out.
    """
    wide = rows.select(F.col(live).alias("live"), *[F.col(f).cast("double").alias(f) for f in features])
    long = wide.unpivot(["live"], features, "feature", "x")
    cuts = exact_quantiles(long.where(~F.col("live")), ["feature"], "x", DECILES).select(
        "feature", F.array_distinct("q").alias("edges"))
    cuts = F.broadcast(cuts)  # one row per feature
    place = F.size(F.filter(F.slice("edges", 2, F.greatest(F.size("edges") - 2, F.lit(0))), lambda e: e <= F.col("x")))
    counts = long.join(cuts, "feature").groupBy(
        "feature", F.size("edges").alias("n_edges"), F.when(F.col("x").isNotNull(), place).alias("bin")).agg(
        F.count_if(~F.col("live")).alias("ref"), F.count_if("live").alias("now"))
    totals = counts.groupBy("feature").agg(F.sum("ref").alias("n_ref"), F.sum("now").alias("n_now"))
    # every bin takes part, also one that neither sample fills
    slots = cuts.select("feature", F.explode(F.concat(
        F.sequence(F.lit(0), F.greatest(F.size("edges") - 2, F.lit(0))), F.array(F.lit(-1)))).alias("bin"),
        F.size("edges").alias("n_edges"))
    filled = slots.join(counts.select("feature", F.coalesce("bin", F.lit(-1)).alias("bin"), "ref", "now"),
                        ["feature", "bin"], "left").join(totals, "feature").where("n_now > 0")
    floor = F.lit(vocab.PSI_FLOOR)
    a = F.greatest(F.coalesce("ref", F.lit(0)) / F.col("n_ref"), floor)
    b = F.greatest(F.coalesce("now", F.lit(0)) / F.col("n_now"), floor)
    psi = filled.groupBy("feature").agg(
        F.when(F.first("n_edges") < 2, 0.0).otherwise(F.sum((b - a) * F.ln(b / a))).alias("psi"))
    return psi.withColumn("verdict", psi_verdict(F.col("psi")))
