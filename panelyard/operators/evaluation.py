"""Scores of probability forecasts against a base-rate forecast.

Input columns: ``y`` INT, ``p`` ARRAY<DOUBLE>, ``prior`` ARRAY<DOUBLE>; one row per forecast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from panelyard.functions.numeric import ratio
from panelyard.functions.probability import log_penalty, squared_error, top_class
from panelyard.operators.ladder import ranking_metrics, score_ladder

BINS = 10


def class_scores(rows: DataFrame, group: list[str]) -> DataFrame:
    """One row per forecast and class: score, hit flag and class number (binary: class 1 only)."""
    return rows.select(*group, "y", F.size("p").alias("classes"), F.posexplode("p").alias("c", "s")).where(
        (F.col("classes") > 2) | (F.col("c") == 1)
    ).withColumn("hit", (F.col("y") == F.col("c")).cast("int"))


def macro_auc(rows: DataFrame, group: list[str]) -> DataFrame:
    """Binary AUC, or the mean of the one-versus-rest AUCs; NULL when a class is absent."""
    by = [*group, "classes", "c"]
    by_class = ranking_metrics(score_ladder(class_scores(rows, group), by, "s", "hit"), by)
    return by_class.groupBy(*group).agg(
        F.when(F.count("auc") == F.count("*"), F.avg("auc")).alias("macro_auc"),
        F.max_by("average_precision", "c").alias("average_precision"),
        F.max_by("precision_at_k", "c").alias("precision_at_5pct"),
    )


def calibration_bins(rows: DataFrame, group: list[str]) -> DataFrame:
    """Reliability of the last class: per bin its edges, count, mean forecast and observed share."""
    last = F.get("p", F.size("p") - 1)
    place = F.size(F.filter(
        F.transform(F.sequence(F.lit(1), F.lit(BINS - 1)), lambda i: i * 0.1), lambda e: e <= F.col("s")))
    scored = rows.select(*group, last.alias("s"), (F.col("y") == F.size("p") - 1).cast("double").alias("hit"))
    return scored.groupBy(*group, place.alias("bin")).agg(
        F.count("*").alias("n"), F.avg("s").alias("mean_predicted"), F.avg("hit").alias("observed_frequency"),
    ).withColumns({"bin_lower": F.col("bin") * 0.1, "bin_upper": (F.col("bin") + 1) * 0.1})


def calibration_error(bins: DataFrame, group: list[str]) -> DataFrame:
    gap = F.col("n") * F.abs(F.col("mean_predicted") - F.col("observed_frequency"))
    return bins.groupBy(*group).agg((F.sum(gap) / F.sum("n")).alias("calibration_error"))


def pointwise(rows: DataFrame, group: list[str]) -> DataFrame:
    """Everything that is a mean over rows, in one aggregate."""
    y, p, prior = F.col("y"), F.col("p"), F.col("prior")
    last = F.size(p) - 1
    sums = rows.groupBy(*group).agg(
        F.count("*").alias("n"),
        F.avg(log_penalty(p, y)).alias("log_loss"), F.avg(log_penalty(prior, y)).alias("log_loss_baseline"),
        F.avg(squared_error(p, y)).alias("brier"), F.avg(squared_error(prior, y)).alias("brier_baseline"),
        F.avg((y == last).cast("double")).alias("base_rate_positive"),
        F.avg((top_class(p) == y).cast("double")).alias("accuracy"),
        F.avg((top_class(prior) == y).cast("double")).alias("accuracy_baseline"),
        F.avg((y == 0).cast("double")).alias("share_0"), F.avg((y == 1).cast("double")).alias("share_1"),
        F.avg((y == 2).cast("double")).alias("share_2"), F.countDistinct("y").alias("n_classes"),
    )
    return sums.withColumns({
        "log_loss_skill": 1.0 - ratio("log_loss", "log_loss_baseline"),
        "brier_skill": 1.0 - ratio("brier", "brier_baseline"),
    })


def evaluate(rows: DataFrame, group: list[str]) -> DataFrame:
    """All metrics, one row per group."""
    rows = rows.select(*group, "y", "p", "prior")
    out = pointwise(rows, group)
    out = out.join(macro_auc(rows, group), group)
    return out.join(calibration_error(calibration_bins(rows, group), group), group)


def edge(model: str = "brier", reference: str = "brier_reference"):
    """Skill of one Brier score over another; NULL without a positive reference."""
    return F.when(F.col(reference) > 0, 1.0 - F.col(model) / F.col(reference))


def class_priors(train: DataFrame, group: list[str], k: int, y: str = "y") -> DataFrame:
    """Class shares of the training rows, absent classes as zero."""
    shares = [F.avg((F.col(y) == c).cast("double")) for c in range(k)]
    return train.groupBy(*group).agg(F.array(*shares).alias("prior"), F.count("*").alias("n_train"))
