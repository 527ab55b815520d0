"""Prediction log, outcomes, live skill, post-mortem and scores."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from panelyard import vocab
from panelyard.catalog.base import big, query, s6, step
from panelyard.functions.numeric import settle
from panelyard.functions.probability import realised_class
from panelyard.session import stored
from panelyard.plans import feedback, monitoring
from panelyard.plans.scores import board, leaderboard, recent_closes, sector_counts, stale_days, with_sector

step("bar_seq", "SELECT ticker, date, close, row_number() OVER (PARTITION BY ticker ORDER BY date) AS no FROM bars")
step("done_log", """
SELECT p.*, e.date AS end_date, e.close / s.close - 1 AS actual_return, (e.close / s.close - 1) / 0.25 AS actual_z
FROM predictions p JOIN bar_seq s ON s.ticker = p.ticker AND s.date = p.as_of JOIN bar_seq e ON e.ticker = s.ticker AND e.no = s.no + 1
""")
step("done_cls", """
SELECT *, CASE WHEN actual_class = predicted_class THEN 'correct' ELSE 'incorrect' END AS error_type
FROM (SELECT *, CASE WHEN abs(actual_z) >= 1 THEN 'LARGE_MOVE' ELSE 'QUIET' END AS actual_class FROM done_log)
""")
step("rel_done", """
SELECT p.ticker, p.as_of, e.date AS end_date, (e.close / s.close - 1) - (se.close / ss.close - 1) AS actual_return
FROM predictions p JOIN bar_seq s ON s.ticker = p.ticker AND s.date = p.as_of JOIN bar_seq e ON e.ticker = s.ticker AND e.no = s.no + 5
JOIN universe u ON u.ticker = p.ticker
JOIN (SELECT *, row_number() OVER (PARTITION BY sector_etf ORDER BY date) AS no FROM sector_bars) ss ON ss.sector_etf = u.sector_etf AND ss.date = p.as_of
JOIN (SELECT *, row_number() OVER (PARTITION BY sector_etf ORDER BY date) AS no FROM sector_bars) se ON se.sector_etf = ss.sector_etf AND se.no = ss.no + 5
""")


def log_of(t):
    p = F.col("p_large_move")
    return t.predictions.withColumn("probabilities", F.create_map(F.lit("QUIET"), 1 - p, F.lit("LARGE_MOVE"), p))


def resolved_of(t):
    """Outcomes of all predictions, from bars that are derived once per run; written when a run first asks for them."""
    if t.resolved is None:
        t.keep_bars()
        t.resolved = stored(feedback.outcomes(log_of(t), t.bars), "resolved")
    return t.resolved


def tags_of(t):
    return feedback.post_mortem(resolved_of(t), t.macro, t.filings)


@query("j_outcome", f"SELECT ticker, as_of, end_date, {s6('actual_return')} AS actual_return FROM rel_done")
def j_outcome(t):
    """Outcome of sector-relative predictions five bars ahead."""
    rel = log_of(t).withColumns({"kind": F.lit("rel_direction"), "horizon_days": F.lit(5)})
    out = feedback.outcomes(rel, t.bars, t.sector_bars, t.universe)
    return out.select("ticker", "as_of", "end_date", settle("actual_return").alias("actual_return"))


@query("p_resolve", f"SELECT prediction_id, end_date, {s6('actual_return')} AS actual_return, {s6('actual_z')} AS actual_z, actual_class, error_type FROM done_cls")
def p_resolve(t):
    """Close every prediction whose window has ended."""
    return resolved_of(t).select("prediction_id", "end_date", settle("actual_return").alias("actual_return"),
                                 settle("actual_z").alias("actual_z"), "actual_class", "error_type")


@query("cls_class", f"""
SELECT ticker, as_of, actual_class AS magnitude, CASE WHEN actual_z >= 1 THEN 'SPIKE' WHEN actual_z <= -1 THEN 'DROP' ELSE 'NEUTRAL' END AS direction FROM done_cls
""")
def cls_class(t):
    """Realised class in both vocabularies."""
    z, one = F.col("actual_z"), F.lit(1.0)
    return resolved_of(t).select("ticker", "as_of", realised_class(z, one, F.lit("magnitude")).alias("magnitude"),
                                 realised_class(z, one, F.lit("direction")).alias("direction"))


step("live_rows", "SELECT *, (p_large_move - CASE WHEN actual_class = 'LARGE_MOVE' THEN 1 ELSE 0 END) AS d, CASE WHEN actual_class = 'LARGE_MOVE' THEN 1.0 ELSE 0.0 END AS hit FROM done_cls")
_live = """SELECT '{level}' AS level, target, kind, {fp} AS model_fingerprint, count(*) AS n, min(as_of) AS first, max(as_of) AS last, avg(2 * d * d) AS b,
 1 - avg(hit) * avg(hit) - (1 - avg(hit)) * (1 - avg(hit)) AS base, avg(CASE WHEN predicted_class = actual_class THEN 1.0 ELSE 0.0 END) AS acc, avg(hit) AS rate
 FROM live_rows GROUP BY target, kind{grp}"""


@query("ag_live", f"""
SELECT level, target, kind, model_fingerprint, {big('n')} AS n, first, last, {s6('b')} AS brier, {s6('base')} AS brier_baseline, {s6('1 - b / base')} AS brier_skill,
       {s6('acc')} AS accuracy, {s6('rate')} AS large_move_rate, n >= 200 AS sufficient
FROM ({_live.format(level='target', fp='CAST(NULL AS VARCHAR)', grp='')} UNION ALL {_live.format(level='model', fp='model_fingerprint', grp=', model_fingerprint')})
""")
def ag_live(t):
    """Live skill per target and per model version."""
    out = feedback.live_skill(resolved_of(t))
    return out.select("level", "target", "kind", "model_fingerprint", "n", "first", "last",
                      *[settle(c).alias(c) for c in ("brier", "brier_baseline", "brier_skill", "accuracy")],
                      settle(F.col("base_rates")["LARGE_MOVE"]).alias("large_move_rate"), "sufficient")


@query("ag_context", f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY as_of DESC, prediction_id) AS k FROM done_cls),
l AS (SELECT ticker, count(*) AS n, avg(CASE WHEN error_type = 'correct' THEN 1.0 ELSE 0.0 END) AS hit,
      string_agg(CASE WHEN k <= 5 THEN CAST(as_of AS VARCHAR) || ':' || predicted_class || ':' || actual_class END, ';' ORDER BY k) AS recent,
      least(count(CASE WHEN predicted_class = 'QUIET' AND actual_class = 'LARGE_MOVE' THEN 1 END), 5) AS missed FROM r WHERE k <= 20 GROUP BY ticker),
o AS (SELECT ticker, count(*) AS open FROM predictions WHERE prediction_id NOT IN (SELECT prediction_id FROM done_cls) GROUP BY ticker)
SELECT l.ticker, {big('n')} AS resolved_predictions, {big('coalesce(open, 0)')} AS open_predictions, {s6('hit')} AS hit_rate, recent, CAST(missed AS INTEGER) AS missed
FROM l LEFT JOIN o ON o.ticker = l.ticker
""")
def ag_context(t):
    """Track record per ticker."""
    out = feedback.feedback_context(resolved_of(t), log_of(t), quiet_counts=True)
    recent = F.array_join(F.transform("recent", lambda r: F.concat_ws(":", r["as_of"].cast("string"), r["predicted"], r["actual"])), ";")
    return out.select("ticker", "resolved_predictions", "open_predictions", settle("hit_rate").alias("hit_rate"), recent.alias("recent"),
                      F.size("missed_moves").alias("missed"))


step("odd_days", """
SELECT DISTINCT f.ticker, f.filing_date FROM item_list i JOIN filings f ON f.accession = i.accession LEFT JOIN taxonomy x ON x.code = i.code
WHERE coalesce(x.kind, 'UNCLASSIFIED_8K') IN ('DISCLOSURE', 'UNCLASSIFIED_8K')
""")
step("vix_seq", "SELECT date, vix, row_number() OVER (ORDER BY date) AS no, count(*) OVER () AS n FROM macro WHERE vix IS NOT NULL")
step("wrong_rows", """
SELECT * FROM done_cls WHERE error_type = 'incorrect' AND abs(actual_z) >= 0.5
""")
step("pm_checks", """
SELECT w.*, EXISTS (SELECT 1 FROM odd_days o WHERE o.ticker = w.ticker AND o.filing_date >= w.as_of AND o.filing_date <= w.as_of + INTERVAL '2' DAY) AS blind,
       v1.vix / v0.vix - 1 AS vix_move
FROM wrong_rows w ASOF LEFT JOIN vix_seq v0 ON w.as_of <= v0.date LEFT JOIN vix_seq v1 ON v1.no = v0.no + 1
""")
step("pm_tags", """
SELECT prediction_id, ticker, as_of, CASE WHEN greatest(p_large_move, 1 - p_large_move) < 0.5 THEN 'MODEL_UNCERTAIN' WHEN abs(vix_move) >= 0.25 THEN 'REGIME_SHIFT'
  WHEN blind THEN 'EVENT_NOT_IN_TAXONOMY' ELSE 'UNEXPLAINED' END AS post_mortem_tag FROM pm_checks
""")


@query("j_theta_window", """
SELECT p.ticker, p.as_of, EXISTS (SELECT 1 FROM odd_days o WHERE o.ticker = p.ticker AND o.filing_date >= p.as_of AND o.filing_date <= p.as_of + INTERVAL '10' DAY) AS blind
FROM predictions p
""")
def j_theta_window(t):
    """Filings outside the taxonomy within ten days after each prediction."""
    days = t.predictions.select("ticker", "as_of", F.lit(5).alias("horizon_days"))
    return feedback.untagged_filing_near(days, t.filings).drop("horizon_days")


@query("p_postmortem", "SELECT * FROM pm_tags")
def p_postmortem(t):
    """Why wrong predictions were wrong."""
    return tags_of(t)


@query("ag_tags", f"SELECT post_mortem_tag, {big('count(*)')} AS n FROM pm_tags GROUP BY 1")
def ag_tags(t):
    """Counts per tag."""
    return feedback.tag_summary(tags_of(t))


@query("ag_health", f"""
SELECT {big('(SELECT count(*) FROM predictions)')} AS predictions_total, {big('count(*)')} AS predictions_resolved,
       {s6('count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM predictions)')} AS resolution_rate,
       {s6("(SELECT CAST(count(*) AS DOUBLE) FROM pm_tags) / count(CASE WHEN error_type = 'incorrect' THEN 1 END)")} AS post_mortem_coverage,
       {s6("avg(CAST(date_diff('day', as_of, end_date) AS DOUBLE))")} AS mean_days_to_resolution, true AS healthy FROM done_cls
""")
def ag_health(t):
    """Health of the feedback loop."""
    out = feedback.health(log_of(t), resolved_of(t), tags_of(t))
    return out.select("predictions_total", "predictions_resolved", "healthy",
                      *[settle(c).alias(c) for c in ("resolution_rate", "post_mortem_coverage", "mean_days_to_resolution")])


@query("ag_preddist", f"""
WITH r AS (SELECT * FROM predictions WHERE as_of >= (SELECT max(as_of) FROM predictions) - INTERVAL '90' DAY)
SELECT target, 'LARGE_MOVE' AS class, {big('count(*)')} AS n, {s6("avg(CASE WHEN predicted_class = 'LARGE_MOVE' THEN 1.0 ELSE 0.0 END)")} AS class_share, {s6('avg(p_large_move)')} AS mean_probability FROM r GROUP BY target
UNION ALL SELECT target, 'QUIET', {big('count(*)')}, {s6("avg(CASE WHEN predicted_class = 'QUIET' THEN 1.0 ELSE 0.0 END)")}, {s6('avg(1 - p_large_move)')} FROM r GROUP BY target
""")
def ag_preddist(t):
    """Distribution of recent predictions."""
    out = feedback.prediction_distribution(log_of(t))
    return out.select("target", "class", "n", settle("class_share").alias("class_share"), settle("mean_probability").alias("mean_probability"))


@query("p_monitor", f"""
SELECT 'resolved' AS part, target AS name, CAST(count(*) AS DOUBLE) AS value FROM done_cls GROUP BY target
UNION ALL SELECT 'tag', post_mortem_tag, CAST(count(*) AS DOUBLE) FROM pm_tags GROUP BY 2
UNION ALL SELECT 'recent_mean', 'LARGE_MOVE', {s6('avg(p_large_move)')} FROM predictions WHERE as_of >= (SELECT max(as_of) FROM predictions) - INTERVAL '90' DAY
""")
def p_monitor(t):
    """System report as rows: resolved counts, tags and recent mean probability."""
    live = feedback.live_skill(resolved_of(t)).where("level = 'target'").select(
        F.lit("resolved").alias("part"), F.col("target").alias("name"), F.col("n").cast("double").alias("value"))
    tags = feedback.tag_summary(tags_of(t)).select(F.lit("tag").alias("part"), F.col("post_mortem_tag").alias("name"), F.col("n").cast("double").alias("value"))
    dist = feedback.prediction_distribution(log_of(t)).where("class = 'LARGE_MOVE'").select(
        F.lit("recent_mean").alias("part"), F.col("class").alias("name"), settle("mean_probability").alias("value"))
    return live.unionByName(tags).unionByName(dist)


@query("p_system_report", f"""
SELECT {big('(SELECT count(*) FROM predictions)')} AS predictions_total, {big('(SELECT count(DISTINCT target) FROM done_cls)')} AS live_targets,
  {big("(SELECT count(*) FROM drift_all WHERE psi >= 0.25)")} AS significant_count, (SELECT max(psi) >= 0.2 FROM drift_all) AS retrain_recommended,
  (SELECT string_agg(feature, ',' ORDER BY psi DESC, feature) FROM (SELECT * FROM drift_all ORDER BY psi DESC, feature LIMIT 10)) AS worst
""")
def p_system_report(t):
    """Feedback loop, recent predictions, live skill and drift in one nested row; here its main facts."""
    from panelyard.catalog.evaluation import kept_features

    drift = monitoring.drift_report(kept_features(t), list(vocab.FEATURES))
    report = monitoring.system_report(feedback.health(log_of(t), resolved_of(t), tags_of(t)), feedback.prediction_distribution(log_of(t)),
                                      feedback.live_skill(resolved_of(t)), drift)
    targets = F.array_distinct(F.transform(F.filter("live_skill", lambda r: r["level"] == "target"), lambda r: r["target"]))
    return report.select("feedback_loop.predictions_total", F.size(targets).cast("bigint").alias("live_targets"), "drift.significant_count",
                         "drift.retrain_recommended", F.array_join(F.transform("drift.worst", lambda r: r["feature"]), ",").alias("worst"))


# ---------------------------------------------------------------- log shape


@query("snk_log", f"""
SELECT substr(sha1(ticker || '|' || CAST(as_of AS VARCHAR) || '|' || target || '|' || model_fingerprint), 1, 32) AS prediction_id, ticker, as_of, target,
       {s6('p_large_move')} AS p_large_move, CAST(NULL AS DOUBLE) AS proba_drop FROM predictions ORDER BY ticker, as_of
""")
def snk_log(t):
    """Log rows with repeatable ids; appending the same day twice adds nothing."""
    from panelyard.session import new_path
    from panelyard.sources.writers import write_log

    rows = feedback.log_rows(log_of(t).drop("target", "prediction_id"))
    path = new_path(t.spark, "log")
    write_log(rows.where(F.year("as_of") < 1999), path)
    for _ in range(2):  # the second time there is nothing left to append
        write_log(feedback.append_once(t.spark.read.schema(rows.schema).parquet(path), rows), path)
    whole = t.spark.read.schema(rows.schema).parquet(path)
    return whole.select("prediction_id", "ticker", "as_of", "target", settle(F.col("probabilities")["LARGE_MOVE"]).alias("p_large_move"), "proba_drop")


@query("snk_log_migrate", f"""
SELECT prediction_id, CASE WHEN extract(year FROM as_of) % 2 = 0 THEN 'magnitude_1d' ELSE 'direction_1d' END AS target, 'direction' AS kind, {s6('p_large_move / 2')} AS p_spike FROM predictions ORDER BY prediction_id
""")
def snk_log_migrate(t):
    """Old rows get target, kind and probability map; the row count does not change."""
    p = F.col("p_large_move")
    old = t.predictions.select("prediction_id", "ticker", "as_of", "horizon_days", F.when(F.year("as_of") % 2 == 0, F.col("target")).otherwise("").alias("target"),
                               (p / 2).alias("proba_drop"), (1 - p).alias("proba_neutral"), (p / 2).alias("proba_spike"), "predicted_class")
    new = feedback.migrate_log(old)
    return new.select("prediction_id", "target", "kind", settle(F.col("probabilities")["SPIKE"]).alias("p_spike"))


# ---------------------------------------------------------------- scores and boards
step("score_rows", """
SELECT p.ticker, u.sector, p.as_of, p.target, p.p_large_move AS probability FROM predictions p LEFT JOIN universe u ON u.ticker = p.ticker
""")


@query("j_sector_attr", f"SELECT ticker, sector, as_of, target, {s6('probability')} AS probability FROM score_rows ORDER BY ticker, as_of")
def j_sector_attr(t):
    """Sector of each scored row."""
    return with_sector(scores_of(t), t.universe).select("ticker", "sector", "as_of", "target", settle("probability").alias("probability"))


def scores_of(t):
    return t.predictions.select("ticker", "as_of", "target", F.col("p_large_move").alias("probability"))


@query("tk_leaderboard", f"""
SELECT ticker, sector, as_of, {s6('probability')} AS probability, CAST(row_number() OVER (ORDER BY probability DESC, ticker) AS INTEGER) AS place
FROM score_rows WHERE target = 'magnitude_1d' AND as_of = DATE '1999-06-15' AND sector IN ('Sector 1', 'Sector 2') QUALIFY place <= 10
""")
def tk_leaderboard(t):
    """Highest probabilities of one target and day."""
    rows = with_sector(scores_of(t), t.universe).where(F.col("sector").isin("Sector 1", "Sector 2"))
    top = leaderboard(rows, "magnitude_1d", as_of="1999-06-15", limit=10)
    place = F.row_number().over(Window.orderBy(F.desc("probability"), "ticker"))  # at most ten rows
    return top.select("ticker", "sector", "as_of", settle("probability").alias("probability"), place.alias("place"))


@query("tk_board", """
WITH d AS (SELECT * FROM score_rows WHERE as_of = DATE '1999-06-15'), c AS (SELECT DATE '1999-06-18' AS today)
SELECT true AS available, DATE '1999-06-15' AS as_of, CAST((SELECT count(DISTINCT ticker) FROM d) AS BIGINT) AS tickers_scored, (SELECT list_sort(list(DISTINCT target)) FROM d) AS targets,
  (SELECT list_sort(list(DISTINCT sector)) FROM d) AS sectors, CAST(3 AS INTEGER) AS stale_trading_days, true AS stale, CAST(NULL AS BIGINT) AS failures,
  (SELECT string_agg(ticker, ',' ORDER BY probability DESC, ticker) FROM (SELECT * FROM d WHERE target = 'magnitude_1d' ORDER BY probability DESC, ticker LIMIT 25)) AS ranked
""")
def tk_board(t):
    """The leaderboard of a day with its facts: age, names, targets and sectors scored; failures are known for the latest day only."""
    rejects = t.index_changes.select(F.col("removed_ticker").alias("ticker")).distinct()
    out = board(with_sector(scores_of(t), t.universe), "magnitude_1d", "1999-06-18", as_of="1999-06-15", rejects=rejects)
    return out.select("available", "as_of", "tickers_scored", "targets", "sectors", "stale_trading_days", "stale", "failures",
                      F.array_join(F.transform("rows", lambda r: r["ticker"]), ",").alias("ranked"))


@query("tk_stale_days", """
SELECT ticker, CAST(greatest((SELECT count(*) FROM range(last_day, DATE '2001-12-31' + INTERVAL '1' DAY, INTERVAL '1' DAY) r(d) WHERE dayofweek(d) BETWEEN 1 AND 5) - 1, 0) AS INTEGER) AS stale_days
FROM (SELECT ticker, max(as_of) AS last_day FROM predictions GROUP BY ticker)
""")
def tk_stale_days(t):
    """Business days since each ticker was last scored."""
    last = scores_of(t).groupBy("ticker").agg(F.max("as_of").alias("last_day"))
    return last.select("ticker", stale_days("last_day", "2001-12-31").alias("stale_days"))


@query("tk_recent", "SELECT ticker, date, close FROM bars QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) <= 30")
def tk_recent(t):
    """Last 30 closes of every ticker."""
    return recent_closes(t.bars, 30)


@query("ag_universe", f"SELECT sector, {big('count(*)')} AS n FROM universe GROUP BY sector")
def ag_universe(t):
    """Names per sector."""
    return sector_counts(t.universe)


step("month_scores", """
SELECT ticker, last_day(as_of) AS run_day, max_by(probability, as_of) AS probability FROM score_rows GROUP BY ALL
""")


@query("snk_scores", f"SELECT ticker, run_day AS as_of, {s6('probability')} AS probability FROM month_scores WHERE run_day = (SELECT max(run_day) FROM month_scores)")
def snk_scores(t):
    """A scoring run per month end: one folder per run, runs replaced when repeated, the latest read back."""
    from panelyard.session import new_path
    from panelyard.sources.writers import latest_scores, write_scores

    runs = scores_of(t).groupBy("ticker", F.last_day("as_of").alias("run_day")).agg(
        F.max_by("probability", "as_of").alias("probability")).withColumnRenamed("run_day", "as_of")
    path = new_path(t.spark, "scores")
    write_scores(runs.withColumn("probability", F.lit(0.0)), path)
    write_scores(runs, path)  # the same runs again: replaced, not doubled
    return latest_scores(t.spark, path).select("ticker", "as_of", settle("probability").alias("probability"))
