"""Prediction log, outcomes, live skill and post-mortem."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelyard import vocab
from panelyard.functions.numeric import growth, ratio
from panelyard.functions.probability import realised_class
from panelyard.functions.text import short_sha1
from panelyard.operators.asof import timeline
from panelyard.operators.dedupe import keep_one
from panelyard.operators.single import beside
from panelyard.plans.events import has_untagged_item


def log_rows(scored: DataFrame) -> DataFrame:
    """Prediction-log rows with repeatable ids, default target names and direction columns.

    ``scored`` holds ticker, as_of, kind, horizon_days, threshold_sigmas, label_scale, last_close,
    probabilities (map), predicted_class, model_fingerprint and optionally target.
    """
    target = F.concat(F.col("kind"), F.lit("_"), F.col("horizon_days").cast("string"), F.lit("d"))
    if "target" in scored.columns:
        target = F.coalesce(F.nullif(F.col("target"), F.lit("")), target)
    p = F.col("probabilities")
    down, flat, up = vocab.DIRECTION_NAMES
    out = scored.withColumn("target", target)
    return out.withColumns({
        "prediction_id": short_sha1(F.concat_ws("|", "ticker", F.col("as_of").cast("string"), "target",
                                                F.coalesce("model_fingerprint", F.lit(""))), 32),
        "proba_drop": F.try_element_at(p, F.lit(down)), "proba_neutral": F.try_element_at(p, F.lit(flat)),
        "proba_spike": F.try_element_at(p, F.lit(up)),
    })


def append_once(log: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of ``new`` that the log does not hold yet: re-running a day adds nothing."""
    return keep_one(new, ["prediction_id"], [F.col("as_of")]).join(
        log.select("prediction_id"), "prediction_id", "left_anti")


def migrate_log(old: DataFrame) -> DataFrame:
    """Bring log rows of the first schema to the present one; every row is kept."""
    have = set(old.columns)
    fallback_target = F.concat(F.lit("direction_"), F.col("horizon_days").cast("string"), F.lit("d"))
    three = F.map_from_arrays(F.array(*[F.lit(n) for n in vocab.DIRECTION_NAMES]),
                              F.array("proba_drop", "proba_neutral", "proba_spike"))

    def filled(name: str, fallback: Column) -> Column:
        return F.coalesce(F.nullif(F.col(name), F.lit("")), fallback) if name in have else fallback

    added = {
        "target": filled("target", fallback_target),
        "kind": filled("kind", F.lit("direction")),
        "probabilities": F.coalesce("probabilities", three) if "probabilities" in have else three,
        "model_fingerprint": F.col("model_fingerprint") if "model_fingerprint" in have else F.lit(None).cast("string"),
    }
    return old.withColumns(added)


def numbered(bars: DataFrame, key: str = "ticker") -> DataFrame:
    """Bars with their place in the series; horizons count bars, not days."""
    return bars.withColumn("bar_no", F.row_number().over(Window.partitionBy(key).orderBy("date")))


def outcomes(pending: DataFrame, bars: DataFrame, sector_bars: DataFrame | None = None,
             universe: DataFrame | None = None) -> DataFrame:
    """Pending predictions whose window has closed, with return, z-score, class and error type.

    The bar of the day and the bar ``horizon_days`` later are two equi-joins on (ticker, place).
    Relative predictions are judged net of the sector's own move; without it they stay pending.
    """
    seq = numbered(bars.select("ticker", "date", "close"))
    start = seq.select("ticker", F.col("date").alias("as_of"), F.col("close").alias("c0"), "bar_no")
    end = seq.select("ticker", F.col("bar_no").alias("end_no"), F.col("close").alias("c1"), F.col("date").alias("end_date"))
    out = pending.join(start, ["ticker", "as_of"]).withColumn("end_no", F.col("bar_no") + F.col("horizon_days")).join(
        end, ["ticker", "end_no"])
    move = growth("c1", "c0")
    if sector_bars is not None and universe is not None:
        s = numbered(sector_bars.select("sector_etf", "date", F.col("close").alias("s")), "sector_etf")
        s0 = s.select("sector_etf", F.col("date").alias("as_of"), F.col("s").alias("s0"), F.col("bar_no").alias("s_no"))
        s1 = s.select("sector_etf", F.col("bar_no").alias("s_end"), F.col("s").alias("s1"))
        out = out.join(universe.select("ticker", "sector_etf"), "ticker", "left").join(
            s0, ["sector_etf", "as_of"], "left").withColumn("s_end", F.col("s_no") + F.col("horizon_days")).join(
            s1, ["sector_etf", "s_end"], "left")
        relative = F.col("kind") == "rel_direction"
        out = out.where(~relative | F.col("s1").isNotNull())
        move = F.when(relative, move - growth("s1", "s0")).otherwise(move)
    else:
        out = out.where(F.col("kind") != "rel_direction")
    out = out.withColumn("actual_return", move).withColumn("actual_z", ratio("actual_return", "label_scale"))
    out = out.withColumn("actual_class", realised_class("actual_z", "threshold_sigmas", "kind"))
    verdict = F.when(F.col("actual_class").isNotNull(), F.when(
        F.col("actual_class") == F.col("predicted_class"), "correct").otherwise("incorrect"))
    return out.select(*pending.columns, "end_date", "actual_return", "actual_z", "actual_class",
                      verdict.alias("error_type"))


def pending_of(log: DataFrame, resolved: DataFrame) -> DataFrame:
    return log.join(resolved.select("prediction_id"), "prediction_id", "left_anti")


def live_skill(resolved: DataFrame, least: int = vocab.MIN_LIVE_ROWS) -> DataFrame:
    """Brier skill per target and per (target, model), in one pass over grouping sets.

    ``level`` is ``target`` or ``model``.  The base rates are the outcomes' own class shares; the
    baseline score then needs no second pass: its mean is 1 - sum of squared shares.
    """
    rows = resolved.where("actual_class IS NOT NULL").select(
        "target", "kind", "model_fingerprint", "as_of", "predicted_class", "actual_class", "probabilities")
    classes = F.map_entries("probabilities")
    hit_known = F.exists(classes, lambda e: e["key"] == F.col("actual_class"))
    error = F.aggregate(classes, F.lit(0.0), lambda a, e: a + F.pow(
        e["value"] - F.when(e["key"] == F.col("actual_class"), 1.0).otherwise(0.0), F.lit(2.0)))
    error = error + F.when(hit_known, 0.0).otherwise(1.0)
    rows = rows.withColumn("error", error)
    sets = rows.groupingSets(
        [["target", "kind", "actual_class"], ["target", "kind", "model_fingerprint", "actual_class"]],
        "target", "kind", "model_fingerprint", "actual_class",
    ).agg(
        F.count("*").alias("n"), F.sum("error").alias("error"), F.min("as_of").alias("first"), F.max("as_of").alias("last"),
        F.count_if(F.col("predicted_class") == F.col("actual_class")).alias("right"),
        F.grouping("model_fingerprint").alias("whole"))
    total = sets.groupBy("whole", "target", "kind", "model_fingerprint").agg(
        F.sum("n").alias("n"), F.sum("error").alias("error"), F.sum("right").alias("right"), F.min("first").alias("first"),
        F.max("last").alias("last"), F.sum(F.col("n").cast("double") * F.col("n")).alias("squares"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("actual_class", "n")))).alias("class_counts"))
    n = F.col("n").cast("double")
    brier, base = F.col("error") / n, 1.0 - F.col("squares") / (n * n)
    return total.select(
        F.when(F.col("whole") == 1, "target").otherwise("model").alias("level"), "target", "kind", "model_fingerprint",
        "n", "first", "last", brier.alias("brier"), base.alias("brier_baseline"),
        F.when(base > 0, 1.0 - brier / base).alias("brier_skill"), (F.col("right") / n).alias("accuracy"),
        F.transform_values("class_counts", lambda _, c: c / n).alias("base_rates"), (F.col("n") >= least).alias("sufficient"))


def feedback_context(resolved: DataFrame, log: DataFrame, limit: int = 20, missed: int = 5, recent: int = 5,
                     quiet_counts: bool = False) -> DataFrame:
    """Track record per ticker over its last ``limit`` resolved predictions.

    The rank filter becomes a partial top-k before the shuffle, so long histories stay where they are.
    """
    w = Window.partitionBy("ticker").orderBy(F.desc("as_of"), "prediction_id")
    last = resolved.withColumn("k", F.row_number().over(w)).where(F.col("k") <= limit)
    flat = (F.col("predicted_class") == "NEUTRAL") & (F.col("actual_class") != "NEUTRAL")
    if quiet_counts:
        flat = flat | ((F.col("predicted_class") == "QUIET") & (F.col("actual_class") == "LARGE_MOVE"))
    move = F.struct("k", "as_of", F.col("predicted_class").alias("predicted"), F.col("actual_class").alias("actual"),
                    F.round("actual_return", 4).alias("actual_return"))
    record = last.groupBy("ticker").agg(
        F.count("*").alias("resolved_predictions"),
        (F.count_if(F.col("error_type") == "correct") / F.count("*")).alias("hit_rate"),
        F.slice(F.sort_array(F.collect_list(F.when(flat, move))), 1, missed).alias("missed_moves"),
        F.slice(F.sort_array(F.collect_list(move)), 1, recent).alias("recent"))
    open_rows = pending_of(log, resolved).groupBy("ticker").agg(F.count("*").alias("open_predictions"))
    return record.join(open_rows, "ticker", "full_outer").select(
        "ticker", F.coalesce("resolved_predictions", F.lit(0)).alias("resolved_predictions"),
        F.coalesce("open_predictions", F.lit(0)).alias("open_predictions"), "hit_rate", "missed_moves", "recent")


def volatility_moves(macro: DataFrame, days: DataFrame) -> DataFrame:
    """(as_of, horizon_days, vix_move): change from the first quote on or after the day, h quotes on.

    ``days`` are distinct (as_of, horizon_days); both sides are bounded by the calendar.
    """
    quotes = macro.where("vix IS NOT NULL").select(
        F.col("date"), "vix", F.row_number().over(Window.orderBy("date")).alias("no"))
    total = quotes.agg(F.max("no").alias("n"))
    line = timeline(days.select(F.lit(0).alias("k"), F.col("as_of").alias("date"), "horizon_days"),
                    [(quotes.select(F.lit(0).alias("k"), "date", "no"), "date")], key="k")
    ahead = Window.partitionBy("k").orderBy("day").rangeBetween(0, Window.unboundedFollowing)
    first = line.withColumn("no", F.min("no").over(ahead)).where("is_row AND no IS NOT NULL")
    first = beside(first, total).where("no < n")
    first = first.select(F.col("date").alias("as_of"), "horizon_days", "no",
                         F.least(F.col("no") + F.col("horizon_days"), F.col("n")).alias("end_no"))
    a = quotes.select("no", F.col("vix").alias("v0"))
    b = quotes.select(F.col("no").alias("end_no"), F.col("vix").alias("v1"))
    return first.join(a, "no").join(b, "end_no").select("as_of", "horizon_days", growth("v1", "v0").alias("vix_move"))


def untagged_filing_near(days: DataFrame, filings: DataFrame) -> DataFrame:
    """(ticker, as_of, horizon_days, blind): did an 8-K the taxonomy cannot express follow within 2h days?

    Filings are folded to distinct days first; the next such day comes from one backward-running
    window over the timeline, not from a range join.
    """
    odd = filings.where((F.col("form") == "8-K") & has_untagged_item(F.col("items"))).select(
        "ticker", F.col("filing_date").alias("date"), F.unix_date("filing_date").alias("odd_day")).distinct()
    line = timeline(days.select("ticker", F.col("as_of").alias("date"), "horizon_days"), [(odd, "date")])
    ahead = Window.partitionBy("ticker").orderBy("day").rangeBetween(0, Window.unboundedFollowing)
    nearest = line.withColumn("next_odd", F.min("odd_day").over(ahead)).where("is_row")
    return nearest.select("ticker", F.col("date").alias("as_of"), "horizon_days", F.coalesce(
        F.col("next_odd") - F.col("day") <= 2 * F.col("horizon_days"), F.lit(False)).alias("blind"))


def post_mortem(resolved: DataFrame, macro: DataFrame, filings: DataFrame, limit: int | None = None,
                tagger: Callable[[DataFrame], Column] | None = None) -> DataFrame:
    """Tag all wrong, untagged predictions, or the newest ``limit``; near misses are skipped.

    Rules in order: uncertain model, volatility shock, event outside the taxonomy, late sentiment.
    ``tagger`` may name a tag for rows that no rule explains; other answers become UNEXPLAINED.
    """
    wrong = resolved.where("error_type = 'incorrect'")
    if "post_mortem_tag" in resolved.columns:
        wrong = wrong.where("post_mortem_tag IS NULL")
    if limit is not None:
        wrong = wrong.orderBy(F.desc("as_of"), "prediction_id").limit(limit)
    rows = wrong.where(F.col("actual_z").isNull() | (F.abs("actual_z") >= 0.5))
    days = rows.select("ticker", "as_of", "horizon_days").distinct()
    rows = rows.join(volatility_moves(macro, days.select("as_of", "horizon_days").distinct()), ["as_of", "horizon_days"], "left")
    rows = rows.join(untagged_filing_near(days, filings), ["ticker", "as_of", "horizon_days"], "left")
    sentiment = F.col("sentiment_score") if "sentiment_score" in rows.columns else F.lit(None).cast("double")
    rule = F.when(F.array_max(F.map_values("probabilities")) < 0.5, "MODEL_UNCERTAIN").when(
        F.abs("vix_move") >= vocab.VIX_SHOCK, "REGIME_SHIFT").when(F.col("blind"), "EVENT_NOT_IN_TAXONOMY").when(
        (F.abs(sentiment) < 0.1) & (F.abs("actual_z") >= vocab.LARGE_ERROR_SIGMAS), "SENTIMENT_LAGGED")
    rows = rows.withColumn("rule", rule)
    other = F.lit(None).cast("string")
    if tagger is not None:
        answer = F.upper(F.trim(tagger(rows)))
        other = F.when(answer.isin(*vocab.POST_MORTEM_TAGS), answer)
    tag = F.coalesce("rule", F.when(F.col("rule").isNull(), other), F.lit("UNEXPLAINED"))
    return rows.select("prediction_id", "ticker", "as_of", tag.alias("post_mortem_tag"))


def tag_summary(tags: DataFrame, ticker: str | None = None) -> DataFrame:
    chosen = tags if ticker is None else tags.where(F.col("ticker") == ticker)
    return chosen.groupBy("post_mortem_tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "post_mortem_tag")


def health(log: DataFrame, resolved: DataFrame, tags: DataFrame) -> DataFrame:
    """Is the loop closing?  One row of totals, rates and mean days to resolution."""
    done = resolved.select("prediction_id", "error_type", F.date_diff("end_date", "as_of").alias("days"))
    all_rows = log.select("prediction_id").join(done, "prediction_id", "left").join(
        tags.select("prediction_id", "post_mortem_tag"), "prediction_id", "left")
    sums = all_rows.agg(
        F.count("*").alias("predictions_total"), F.count("days").alias("predictions_resolved"),
        F.count_if(F.col("error_type") == "incorrect").alias("errors"), F.count("post_mortem_tag").alias("tagged"),
        F.avg("days").alias("mean_days_to_resolution"))
    rate = ratio("predictions_resolved", "predictions_total")
    return sums.select("predictions_total", "predictions_resolved", rate.alias("resolution_rate"),
                       ratio("tagged", "errors").alias("post_mortem_coverage"), "mean_days_to_resolution",
                       (F.coalesce(rate, F.lit(1.0)) > 0.5).alias("healthy"))


def prediction_distribution(log: DataFrame, days: int = 90) -> DataFrame:
    """Class shares and mean probability per class in the window that ends at the last prediction."""
    last = log.agg(F.max("as_of").alias("last"))
    recent = beside(log, last).where(F.col("as_of") >= F.date_sub("last", days))
    per_class = recent.select("target", "predicted_class", F.explode("probabilities").alias("class", "p")).groupBy(
        "target", "class").agg(F.count("*").alias("n"), F.avg("p").alias("mean_probability"),
                               F.count_if(F.col("class") == F.col("predicted_class")).alias("chosen"))
    return per_class.select("target", "class", "n", (F.col("chosen") / F.col("n")).alias("class_share"), "mean_probability")
