"""Promotion, deployability and regime guard: decisions over small tables of measured skill.

The heavy inputs (scores, bootstraps) are aggregates made elsewhere; here every decision is a
CASE over one row per target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from panelyard import vocab
from panelyard.operators.bootstrap import blocks_of, paired_edges
from panelyard.operators.dedupe import keep_one
from panelyard.operators.single import beside


def shared_rows(candidate: DataFrame, incumbent: DataFrame) -> DataFrame:
    """Rows both models scored: (target, ticker, date, y, y_other, se_model, se_reference)."""
    key = ["target", "ticker", "date"]
    a = keep_one(candidate.select(*key, "y", "se"), key, [F.col("se")])
    b = keep_one(incumbent.select(*key, F.col("y").alias("y_other"), F.col("se").alias("se_reference")), key,
                 [F.col("se_reference")])
    return a.withColumnRenamed("se", "se_model").join(b, key)


def shared_comparison(rows: DataFrame, seed: int = 0, reps: int = vocab.BOOTSTRAP_REPS) -> DataFrame:
    """Per target: edge on shared rows with its date-bootstrap interval, or why there is none."""
    checks = rows.groupBy("target").agg(
        F.count("*").alias("n_shared"), F.count_if(F.col("y") != F.col("y_other")).alias("clashes"))
    edges = paired_edges(blocks_of(rows, ["target"], "date", "se_model", "se_reference"), ["target"], "date",
                         seed=seed, reps=reps)
    reason = F.when(F.col("n_shared") < vocab.MIN_SHARED_ROWS, F.concat(
        F.lit("only "), F.col("n_shared").cast("string"), F.lit(" rows in common"))).when(
        F.col("clashes") > 0, "labels disagree on shared rows")
    return checks.join(edges.drop("n"), "target").select(
        "target", "n_shared", "n_blocks", F.col("pooled").alias("edge"), "ci90_low", "ci90_high", reason.alias("unusable"))


def is_retired(*keys: Column) -> Column:
    return F.coalesce(*[F.when(k.isin(*vocab.RETIRED_PANELS), k) for k in keys])


def promotion(candidates: DataFrame, incumbents: DataFrame, shared: DataFrame, regimes: DataFrame,
              tolerance: float = vocab.REGRESSION_TOLERANCE) -> DataFrame:
    """One verdict per candidate.

    ``candidates`` and ``incumbents``: target, skill, panel_id, schema.  ``shared``: see
    :func:`shared_comparison`.  ``regimes``: target, regime, candidate, incumbent skill.
    """
    drop = F.col("incumbent") - F.col("candidate")
    worst = regimes.where(drop > tolerance).groupBy("target").agg(
        F.count("*").alias("n_regressions"), F.max_by("regime", F.struct(drop, "regime")).alias("worst_regime"))
    inc = incumbents.select("target", F.col("skill").alias("incumbent_skill"), F.coalesce("panel_id", "schema").alias("inc_panel"),
                            is_retired(F.col("panel_id"), F.col("schema")).alias("retired"), F.lit(True).alias("present"))
    rows = candidates.select("target", F.col("skill").alias("candidate_skill"), F.coalesce("panel_id", "schema").alias("cand_panel")).join(
        inc, "target", "left").join(shared, "target", "left").join(worst, "target", "left")
    usable = F.col("n_shared").isNotNull() & F.col("unusable").isNull()
    rows = rows.withColumn("case", F.when(
        F.col("candidate_skill").isNull() | (F.col("candidate_skill") <= 0), "no skill over the base rate").when(
        F.col("retired").isNotNull(), "incumbent's panel is retired").when(
        F.col("present").isNull(), "no incumbent").when(
        F.col("cand_panel") != F.col("inc_panel"), "different panels").when(
        usable & (F.col("edge").isNull() | (F.col("edge") <= 0) | (F.col("ci90_low") <= -tolerance)), "no edge on shared rows").when(
        ~usable & (F.col("candidate_skill") <= F.coalesce("incumbent_skill", F.lit(-9.0))), "pooled skill not better").when(
        F.col("n_regressions") > 0, "regresses in a regime").otherwise("improves with no regression"))
    promote = F.col("case").isin("incumbent's panel is retired", "no incumbent", "improves with no regression")
    return rows.select("target", promote.alias("promote"), F.col("case").alias("reason"), "candidate_skill", "incumbent_skill",
                       "edge", "ci90_low", "ci90_high", "worst_regime")


def retirements(registry: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Registry after the gate: production models on retired panels without a promoted successor are retired."""
    promoted = verdicts.where("promote").select("target", F.lit(True).alias("replaced"))
    bad = is_retired(F.col("panel_id"), F.col("schema")).isNotNull()
    out = registry.join(promoted, "target", "left")
    stage = F.when((F.col("stage") == "production") & bad & F.col("replaced").isNull(), "retired").otherwise(F.col("stage"))
    return out.withColumn("stage", stage).drop("replaced")


def deployability(targets: DataFrame, comparisons: DataFrame,
                  families=("simple baseline", "volatility benchmark")) -> DataFrame:
    """May a model be served?  Not if any family's worst comparison lies wholly below zero.

    ``comparisons``: target, family, name, pooled, ci90_low, ci90_high.  An unmeasured family is
    not a failed one.
    """
    worst = comparisons.where("ci90_high IS NOT NULL").groupBy("target", "family").agg(
        F.min_by(F.struct("name", "pooled", "ci90_low", "ci90_high"), F.struct("ci90_high", "name")).alias("w"))
    per = worst.groupBy("target").agg(
        F.count("*").alias("measured"), F.count_if(F.col("w.ci90_high") < 0).alias("lost"),
        F.min_by("w", F.struct(F.col("w.ci90_high"), F.col("w.name"))).alias("w"))
    out = targets.select("target").join(per, "target", "left")
    lost = F.coalesce("lost", F.lit(0))
    reason = F.when(lost > 0, F.format_string(
        "beaten by %s: edge %+.4f, 90%% interval %+.4f..%+.4f", "w.name", "w.pooled", "w.ci90_low", "w.ci90_high")).when(
        F.col("measured").isNull(), "unmeasured").otherwise("no simpler alternative measurably beats this model")
    return out.select("target", (lost == 0).alias("deployable"), F.coalesce("measured", F.lit(0)).alias("families_measured"),
                      reason.alias("reason"))


def regime_guard(targets: DataFrame, by_regime: DataFrame, context: DataFrame) -> DataFrame:
    """Worst measured skill over the regimes that resemble today; reliable if unmeasured or positive.

    ``by_regime``: target, regime, skill.  ``context``: one row with ``relevant`` regimes (array).
    """
    wanted = context.select(F.explode("relevant").alias("regime"))
    measured = by_regime.where("skill IS NOT NULL").join(wanted, "regime").groupBy("target").agg(
        F.min("skill").alias("worst_skill"), F.min_by("regime", F.struct("skill", "regime")).alias("worst_regime"),
        F.count("*").alias("regimes_measured"))
    out = targets.select("target").join(measured, "target", "left")
    return out.select("target", "worst_regime", "worst_skill", F.coalesce("regimes_measured", F.lit(0)).alias("regimes_measured"),
                      (F.col("worst_skill").isNull() | (F.col("worst_skill") > 0)).alias("reliable_now"))


def quality_verdict(skill: Column, auc: Column) -> Column:
    """Plain words for a measured skill."""
    more = F.when(auc.isNotNull(), F.format_string("; out-of-sample AUC %.3f", auc)).otherwise("")
    return F.when(skill.isNull(), "skill could not be measured").when(
        skill <= 0, "does not beat the base rates").when(
        skill < vocab.SKILL_NOISE_FLOOR, "margin too small to tell from noise").otherwise(
        F.concat(F.format_string("beats the base rates (Brier skill %+.4f)", skill), more))


def model_quality(scores: DataFrame, deployable: DataFrame) -> DataFrame:
    """Per-target verdict, and which deployable target has the most skill."""
    rows = scores.join(deployable.select("target", "deployable"), "target", "left").withColumn(
        "deployable", F.coalesce("deployable", F.lit(True)))
    best = rows.where("deployable AND brier_skill IS NOT NULL").agg(
        F.max_by("target", F.struct("brier_skill", "target")).alias("best_target"))
    return beside(rows, best).select(
        "target", "brier_skill", "macro_auc", "deployable", quality_verdict(F.col("brier_skill"), F.col("macro_auc")).alias("interpretation"),
        F.coalesce(F.col("target") == F.col("best_target"), F.lit(False)).alias("is_best"))


def set_verdict(pooled: Column, low: Column, high: Column, wins: Column, folds: Column) -> Column:
    """Does a feature set earn its place over the reference set?"""
    return F.when((low > 0) & (pooled >= vocab.MIN_EDGE) & (wins >= 0.7 * folds), "earns its place").when(
        low > 0, "small, inconsistent gain").when(high < 0, "hurts").otherwise("no measurable effect")


def baseline_verdict(pooled: Column, low: Column, wins: Column, folds: Column) -> Column:
    """How a model stands against its best simple baseline."""
    return F.when((low > 0) & (wins >= 0.7 * folds), "adds measurable skill").when(
        low > 0, "small edge, not a consistent one").when(pooled > 0, "edge not distinguishable from zero").otherwise(
        "worse than the baseline")


def importance_overlap(left: DataFrame, right: DataFrame, k: int = 10) -> DataFrame:
    """Overlap of two ranked feature lists (feature, place)."""
    a = left.where(F.col("place") <= k).agg(F.collect_set("feature").alias("a"))
    b = right.where(F.col("place") <= k).agg(F.collect_set("feature").alias("b"))
    both = F.array_intersect("a", "b")
    return beside(a, b).select(
        F.size(both).alias("overlap_count"), F.array_sort(both).alias("overlap"),
        F.array_sort(F.array_except("a", "b")).alias("left_only"), F.array_sort(F.array_except("b", "a")).alias("right_only"),
        (F.size(both) / k).alias("agreement"))
