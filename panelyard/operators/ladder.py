"""Ranking metrics without a global sort.

Rows are folded to one per distinct score; running totals over the scores come from two levels of
score slices plus a window inside each slice, so no task ever holds all scores of a group.
Scores are probabilities in [0, 1].
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

WIDE, NARROW = 4096, 4096 * 4096


def score_ladder(scored: DataFrame, group: list[str], score: str, positive: str) -> DataFrame:
    """One row per group and distinct score.

    ``n`` rows and ``pos`` positives at the score, ``n_below`` and ``pos_below`` strictly below it,
    ``n_all`` and ``pos_all`` in the group.  ``positive`` is a 0/1 column.
    """
    steps = (
        scored.where(F.col(score).isNotNull()).groupBy(*group, F.col(score).alias("s"))
        .agg(F.count("*").alias("n"), F.sum(F.col(positive).cast("bigint")).alias("pos"))
        .withColumn("wide", F.least(F.floor(F.col("s") * WIDE), F.lit(WIDE - 1)))
        .withColumn("narrow", F.least(F.floor(F.col("s") * NARROW), F.lit(NARROW - 1)))
    )

    def below(by, order):
        w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return [F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"{c}_b") for c in ("n", "pos")]

    narrow = steps.groupBy(*group, "wide", "narrow").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    wide = narrow.groupBy(*group, "wide").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    whole = Window.partitionBy(*group)
    wide = wide.select(*group, "wide", *below(group, "wide"), F.sum("n").over(whole).alias("n_all"),
                       F.sum("pos").over(whole).alias("pos_all"))
    narrow = narrow.select(*group, "wide", "narrow", *below([*group, "wide"], "narrow"))
    base = narrow.alias("a").join(wide.alias("w"), [*group, "wide"]).select(
        *group, "narrow", (F.col("a.n_b") + F.col("w.n_b")).alias("n_base"),
        (F.col("a.pos_b") + F.col("w.pos_b")).alias("pos_base"), "n_all", "pos_all")
    inside = steps.select(*group, "narrow", "s", "n", "pos", *below([*group, "narrow"], "s"))
    return inside.join(base, [*group, "narrow"]).select(
        *group, F.col("s").alias("score"), "n", "pos", (F.col("n_b") + F.col("n_base")).alias("n_below"),
        (F.col("pos_b") + F.col("pos_base")).alias("pos_below"), "n_all", "pos_all")


def ranking_metrics(ladder: DataFrame, group: list[str], share: float = 0.05) -> DataFrame:
    """AUC, average precision and precision among the top share, one row per group.

    Ties get average ranks (AUC) and one threshold (average precision).  Where the cut of the top
    share falls inside a tie, the tied rows share the remaining places in proportion.
    """
    neg = F.col("n") - F.col("pos")
    neg_below = F.col("n_below") - F.col("pos_below")
    at_or_above = F.col("n_all") - F.col("n_below")
    pos_at_or_above = F.col("pos_all") - F.col("pos_below")
    cut = F.greatest(F.floor(F.col("n_all") * share), F.lit(1))
    taken = F.greatest(F.least(F.col("n"), cut - (at_or_above - F.col("n"))), F.lit(0))
    sums = ladder.groupBy(*group).agg(
        F.first("n_all").alias("n"), F.first("pos_all").alias("positives"),
        F.sum(F.col("pos") * (neg_below + neg / 2.0)).alias("wins"),
        F.sum(F.col("pos") * pos_at_or_above / at_or_above).alias("ap"),
        F.sum(taken * F.col("pos") / F.col("n")).alias("top"),
        F.first(cut).alias("k"),
    )
    mixed = (F.col("positives") > 0) & (F.col("positives") < F.col("n"))
    return sums.select(
        *group, "n", "positives",
        F.when(mixed, F.col("wins") / (F.col("positives") * (F.col("n") - F.col("positives")))).alias("auc"),
        F.when(mixed, F.col("ap") / F.col("positives")).alias("average_precision"),
        (F.col("top") / F.col("k")).alias("precision_at_k"),
    )
