"""Forecast scores, bootstraps, folds and drift."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from panelyard import vocab
from panelyard.catalog.base import big, query, s6, step
from panelyard.catalog.timeline import SHIFTED, full_features
from panelyard.functions.draws import draw_sql
from panelyard.functions.numeric import ratio, settle
from panelyard.functions.probability import as_vector, lift, squared_error, top_class
from panelyard.functions.regimes import named_regime
from panelyard.operators import bootstrap, evaluation, folds
from panelyard.operators.drift import psi_verdict
from panelyard.operators.quantiles import exact_quantiles
from panelyard.operators.single import beside
from panelyard.plans import monitoring
from panelyard.session import stored

# ---------------------------------------------------------------- scored rows
step("oof_ok", "SELECT * FROM oof WHERE y IS NOT NULL")
step("fold_prior", """
SELECT fold, sum(pos) OVER w / sum(n) OVER w AS p1
FROM (SELECT fold, CAST(count(*) AS DOUBLE) AS n, CAST(sum(y) AS DOUBLE) AS pos FROM oof_ok GROUP BY fold)
WINDOW w AS (ORDER BY fold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
""")
step("ev_rows", "SELECT o.*, f.p1, 1 - f.p1 AS p0 FROM oof_ok o JOIN fold_prior f ON f.fold = o.fold WHERE f.p1 IS NOT NULL")
step("oof3", """
SELECT o.ticker, o.date, o.fold, CASE WHEN m >= 0.25 THEN 2 WHEN m <= -0.25 THEN 0 ELSE 1 END AS y,
       p_incumbent / 2 AS q0, 1 - p_candidate / 2 - p_incumbent / 2 AS q1, p_candidate / 2 AS q2
FROM oof o JOIN (SELECT ticker, date, lead(close) OVER (PARTITION BY ticker ORDER BY date) / close - 1 AS m FROM bars) b
ON b.ticker = o.ticker AND b.date = o.date WHERE m IS NOT NULL
""")


def scored(t):
    """Binary forecasts with the class shares of all earlier folds as baseline."""
    rows = t.oof.where("y IS NOT NULL")
    per_fold = rows.groupBy("fold").agg(F.count("*").alias("n"), F.sum("y").alias("pos"))
    earlier = Window.orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)  # a handful of folds
    prior = per_fold.select("fold", (F.sum("pos").over(earlier) / F.sum("n").over(earlier)).alias("p1"))
    return rows.join(prior.where("p1 IS NOT NULL"), "fold").select(
        "ticker", "date", "fold", "y", as_vector("p_candidate").alias("p"), as_vector("p_incumbent").alias("p_ref"),
        as_vector("p1").alias("prior"), "p_candidate", "p_incumbent")


def scored3(t):
    """Three-class forecasts."""
    w = Window.partitionBy("ticker").orderBy("date")
    move = F.lead("close").over(w) / F.col("close") - 1
    rows = t.oof.withColumn("m", move).where("m IS NOT NULL")
    up, down = F.col("p_candidate") / 2, F.col("p_incumbent") / 2
    y = F.when(F.col("m") >= 0.25, 2).when(F.col("m") <= -0.25, 0).otherwise(1)
    return rows.select("ticker", "date", "fold", y.alias("y"), F.array(down, 1 - up - down, up).alias("p"))


_brier = "avg(2 * (p_candidate - y) * (p_candidate - y))"


@query("ag_brier", f"SELECT fold, {s6('avg(pow(q0 - CASE WHEN y = 0 THEN 1 ELSE 0 END, 2) + pow(q1 - CASE WHEN y = 1 THEN 1 ELSE 0 END, 2) + pow(q2 - CASE WHEN y = 2 THEN 1 ELSE 0 END, 2))')} AS brier FROM oof3 GROUP BY fold")
def ag_brier(t):
    """Three-class Brier score."""
    return scored3(t).groupBy("fold").agg(settle(F.avg(squared_error(F.col("p"), F.col("y")))).alias("brier"))


@query("ag_fold_brier", f"SELECT fold, {s6(_brier)} AS brier FROM oof_ok GROUP BY fold")
def ag_fold_brier(t):
    """Binary Brier score per fold."""
    rows = t.oof.where("y IS NOT NULL").select("fold", "y", as_vector("p_candidate").alias("p"))
    return rows.groupBy("fold").agg(settle(F.avg(squared_error(F.col("p"), F.col("y")))).alias("brier"))


@query("ag_logloss", f"SELECT fold, {s6('avg(-ln(greatest(CASE y WHEN 0 THEN q0 WHEN 1 THEN q1 ELSE q2 END, 2.220446049250313e-16)))')} AS log_loss FROM oof3 GROUP BY fold")
def ag_logloss(t):
    """Log loss with clipping."""
    from panelyard.functions.probability import log_penalty

    return scored3(t).groupBy("fold").agg(settle(F.avg(log_penalty(F.col("p"), F.col("y")))).alias("log_loss"))


def _auc_sql(rows, group, score, hit):
    return f"""SELECT {group}, CASE WHEN sum({hit}) BETWEEN 1 AND count(*) - 1 THEN
      (sum(CASE WHEN {hit} = 1 THEN r END) - CAST(sum({hit}) AS DOUBLE) * (sum({hit}) + 1) / 2) / (CAST(sum({hit}) AS DOUBLE) * (count(*) - sum({hit}))) END AS auc
      FROM (SELECT *, rank() OVER (PARTITION BY {group} ORDER BY {score}) + (count(*) OVER (PARTITION BY {group}, {score}) - 1) / 2 AS r FROM {rows}) GROUP BY {group}"""


def _ap_sql(rows, group, score, hit):
    return f"""SELECT {group}, sum(pos * cum_pos / cum_n) / nullif(any_value(all_pos), 0) AS ap,
      sum(greatest(least(n, k - (cum_n - n)), 0) * pos / n) / any_value(k) AS pk FROM (
        SELECT *, sum(n) OVER w AS cum_n, sum(pos) OVER w AS cum_pos, sum(pos) OVER (PARTITION BY {group}) AS all_pos,
               greatest(floor(sum(n) OVER (PARTITION BY {group}) * CAST(0.05 AS DOUBLE)), 1) AS k
        FROM (SELECT {group}, {score} AS s, CAST(count(*) AS DOUBLE) AS n, CAST(sum({hit}) AS DOUBLE) AS pos FROM {rows} GROUP BY {group}, {score})
        WINDOW w AS (PARTITION BY {group} ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) GROUP BY {group}"""


step("auc3_rows", """
SELECT fold, 0 AS c, q0 AS s, CASE WHEN y = 0 THEN 1 ELSE 0 END AS hit FROM oof3 UNION ALL
SELECT fold, 1, q1, CASE WHEN y = 1 THEN 1 ELSE 0 END FROM oof3 UNION ALL
SELECT fold, 2, q2, CASE WHEN y = 2 THEN 1 ELSE 0 END FROM oof3
""")
step("auc3", _auc_sql("auc3_rows", "fold, c", "s", "hit"))
step("auc2", _auc_sql("ev_rows", "fold", "p_candidate", "y"))
step("ap2", _ap_sql("ev_rows", "fold", "p_candidate", "y"))


@query("ag_auc", f"SELECT fold, {s6('CASE WHEN count(auc) = 3 THEN avg(auc) END')} AS macro_auc FROM auc3 GROUP BY fold")
def ag_auc(t):
    """One-versus-rest macro AUC with ties, three classes."""
    return evaluation.macro_auc(scored3(t), ["fold"]).select("fold", settle("macro_auc").alias("macro_auc"))


@query("ag_ap", f"SELECT fold, {s6('ap')} AS average_precision FROM ap2")
def ag_ap(t):
    """Average precision over distinct thresholds."""
    return evaluation.macro_auc(scored(t), ["fold"]).select("fold", settle("average_precision").alias("average_precision"))


@query("ag_pk", f"SELECT fold, {s6('pk')} AS precision_at_5pct FROM ap2")
def ag_pk(t):
    """Precision among the top 5 %; ties at the cut share the remaining places."""
    return evaluation.macro_auc(scored(t), ["fold"]).select("fold", settle("precision_at_5pct").alias("precision_at_5pct"))


step("cal2", """
SELECT fold, CAST(len(list_filter([CAST(i AS DOUBLE) * CAST(0.1 AS DOUBLE) for i in range(1, 10)], lambda e: e <= p_candidate)) AS INTEGER) AS bin,
       count(*) AS n, avg(p_candidate) AS mp, avg(CAST(y AS DOUBLE)) AS ofr FROM ev_rows GROUP BY ALL
""")


@query("ag_calib", f"SELECT fold, bin, {s6('bin * 0.1')} AS bin_lower, {s6('(bin + 1) * 0.1')} AS bin_upper, {big('n')} AS n, {s6('mp')} AS mean_predicted, {s6('ofr')} AS observed_frequency FROM cal2")
def ag_calib(t):
    """Reliability curve."""
    bins = evaluation.calibration_bins(scored(t), ["fold"])
    return bins.select("fold", "bin", *[settle(c).alias(c) for c in ("bin_lower", "bin_upper")], "n",
                       *[settle(c).alias(c) for c in ("mean_predicted", "observed_frequency")])


@query("ag_ece", f"SELECT fold, {s6('sum(n * abs(mp - ofr)) / sum(n)')} AS calibration_error FROM cal2 GROUP BY fold")
def ag_ece(t):
    """Expected calibration error."""
    bins = evaluation.calibration_bins(scored(t), ["fold"])
    return evaluation.calibration_error(bins, ["fold"]).select("fold", settle("calibration_error").alias("calibration_error"))


_EV = ["log_loss", "log_loss_baseline", "log_loss_skill", "brier", "brier_baseline", "brier_skill", "macro_auc", "average_precision",
       "precision_at_5pct", "base_rate_positive", "calibration_error", "accuracy", "accuracy_baseline", "share_0", "share_1"]
step("ev_point", """
SELECT fold, count(*) AS n, avg(-ln(CASE WHEN y = 1 THEN p_candidate ELSE 1 - p_candidate END)) AS log_loss,
       avg(-ln(CASE WHEN y = 1 THEN p1 ELSE p0 END)) AS log_loss_baseline,
       avg(2 * (p_candidate - y) * (p_candidate - y)) AS brier, avg(2 * (p1 - y) * (p1 - y)) AS brier_baseline,
       avg(CAST(y AS DOUBLE)) AS base_rate_positive, avg(CASE WHEN (CASE WHEN p_candidate > 1 - p_candidate THEN 1 ELSE 0 END) = y THEN 1.0 ELSE 0.0 END) AS accuracy,
       avg(CASE WHEN (CASE WHEN p1 > p0 THEN 1 ELSE 0 END) = y THEN 1.0 ELSE 0.0 END) AS accuracy_baseline,
       avg(1 - CAST(y AS DOUBLE)) AS share_0, avg(CAST(y AS DOUBLE)) AS share_1 FROM ev_rows GROUP BY fold
""")
step("ev_all", """
SELECT p.*, 1 - log_loss / log_loss_baseline AS log_loss_skill, 1 - brier / brier_baseline AS brier_skill, a.auc AS macro_auc, ap AS average_precision,
       pk AS precision_at_5pct, e.ece AS calibration_error FROM ev_point p JOIN auc2 a ON a.fold = p.fold JOIN ap2 ON ap2.fold = p.fold
JOIN (SELECT fold, sum(n * abs(mp - ofr)) / sum(n) AS ece FROM cal2 GROUP BY fold) e ON e.fold = p.fold
""")


@query("ag_eval", f"SELECT fold, {big('n')} AS n, {', '.join(f'{s6(c)} AS {c}' for c in _EV)} FROM ev_all")
def ag_eval(t):
    """All metrics per fold against the walk-forward class shares."""
    return evaluation.evaluate(scored(t), ["fold"]).select("fold", "n", *[settle(c).alias(c) for c in _EV])


@query("ag_priors", f"SELECT fold, [{s6('1 - avg(CAST(y AS DOUBLE))')}, {s6('avg(CAST(y AS DOUBLE))')}, CAST(0 AS DOUBLE)] AS prior FROM oof_ok GROUP BY fold")
def ag_priors(t):
    """Class shares per fold; a class that never occurs gets 0."""
    out = evaluation.class_priors(t.oof.where("y IS NOT NULL"), ["fold"], 3)
    return out.select("fold", F.transform("prior", lambda x: settle(x)).alias("prior"))


_regime = "CASE " + " ".join(f"WHEN date BETWEEN DATE '{a}' AND DATE '{b}' THEN '{n}'" for n, a, b in SHIFTED) + " ELSE 'unknown' END"
step("regime_scores", f"""
SELECT {_regime} AS regime, count(*) AS n, avg(2 * (p_candidate - y) * (p_candidate - y)) AS b, avg(2 * (p_incumbent - y) * (p_incumbent - y)) AS br,
       avg(2 * (p1 - y) * (p1 - y)) AS base FROM ev_rows GROUP BY 1 HAVING count(*) >= 250 AND count(DISTINCT y) > 1
""")


def regime_scores(rows):
    """Model, reference and base-rate Brier per regime that has enough rows and classes."""
    y = F.col("y")
    return rows.groupBy(named_regime("date", SHIFTED).alias("regime")).agg(
        F.count("*").alias("n"), F.avg(squared_error(F.col("p"), y)).alias("brier"),
        F.avg(squared_error(F.col("p_ref"), y)).alias("brier_reference"),
        F.avg(squared_error(F.col("prior"), y)).alias("brier_baseline"), F.countDistinct("y").alias("classes"),
    ).where((F.col("n") >= vocab.MIN_REGIME_ROWS) & (F.col("classes") > 1))


@query("ag_regime", f"SELECT regime, {big('n')} AS n, {s6('1 - b / base')} AS model_brier_skill, {s6('1 - br / base')} AS reference_brier_skill FROM regime_scores")
def ag_regime(t):
    """Skill per regime; thin regimes are left out."""
    return regime_scores(scored(t)).select(
        "regime", "n", settle(evaluation.edge("brier", "brier_baseline")).alias("model_brier_skill"),
        settle(evaluation.edge("brier_reference", "brier_baseline")).alias("reference_brier_skill"))


@query("ag_incremental", f"SELECT regime, {s6('1 - b / br')} AS incremental FROM regime_scores")
def ag_incremental(t):
    """Skill over a reference model."""
    return regime_scores(scored(t)).select("regime", settle(evaluation.edge()).alias("incremental"))


# ---------------------------------------------------------------- bootstraps


def _boot_sql(blocks, seed=0, level=0.90):
    tail = (1 - level) / 2
    return f"""
WITH bl AS (SELECT row_number() OVER (ORDER BY b) - 1 AS i, n, m, r, count(*) OVER () AS k FROM ({blocks})),
dr AS (SELECT rep, {draw_sql(seed, 'rep', 'slot', 'k')} AS i FROM range(0, 2000) a(rep), (SELECT i AS slot, k FROM bl)),
bo AS (SELECT rep, 1 - sum(m) / sum(r) AS e FROM dr JOIN bl ON bl.i = dr.i GROUP BY rep),
q AS (SELECT quantile_cont(e, [0.05, 0.95, CAST({tail} AS DOUBLE), CAST({1 - tail} AS DOUBLE)]) AS q FROM bo)
SELECT {big('sum(n)')} AS n, {big('count(*)')} AS n_blocks, {s6('1 - sum(m) / sum(r)')} AS pooled, {big('count(CASE WHEN m < r THEN 1 END)')} AS wins,
       {s6('avg(1 - m / r)')} AS block_mean, {s6('any_value(q[1])')} AS ci90_low, {s6('any_value(q[2])')} AS ci90_high, {s6('any_value(q[3])')} AS ci_low,
       {s6('any_value(q[4])')} AS ci_high FROM bl, q"""


_pair = "SELECT {b} AS b, count(*) AS n, sum(2 * (p_candidate - y) * (p_candidate - y)) AS m, sum(2 * (p_incumbent - y) * (p_incumbent - y)) AS r FROM oof_ok GROUP BY 1"
_BOOT = ["pooled", "block_mean", "ci90_low", "ci90_high", "ci_low", "ci_high"]


def paired_rows(t):
    return t.oof.where("y IS NOT NULL").select(
        F.lit("magnitude_1d").alias("target"), "fold", "date", "ticker", "y",
        squared_error(as_vector("p_candidate"), F.col("y")).alias("se_model"),
        squared_error(as_vector("p_incumbent"), F.col("y")).alias("se_reference"))


def _boot(t, block, level):
    blocks = bootstrap.blocks_of(paired_rows(t), ["target"], block, "se_model", "se_reference")
    out = bootstrap.paired_edges(blocks, ["target"], block, level)
    return out.select("n", "n_blocks", "wins", *[settle(c).alias(c) for c in _BOOT])


@query("ag_boot_folds", _boot_sql(_pair.format(b="fold"), level=0.98))
def ag_boot_folds(t):
    """Bootstrap of the edge over folds."""
    return _boot(t, "fold", 0.98)


@query("ag_boot_dates", _boot_sql(_pair.format(b="date")))
def ag_boot_dates(t):
    """Bootstrap of the edge over dates."""
    return _boot(t, "date", 0.90)


# ---------------------------------------------------------------- folds

SPEC = folds.FoldSpec(n_splits=4, test_size=200, purge=20, embargo=10)
step("day_pos", "SELECT date, CAST(row_number() OVER (ORDER BY date) - 1 AS INTEGER) AS pos, CAST(count(*) OVER () AS INTEGER) AS n FROM (SELECT DISTINCT date FROM bars)")
step("fold_log", """
SELECT CAST(f AS INTEGER) AS fold, date, CASE WHEN pos >= n - (4 - f) * 200 THEN 'test' ELSE 'train' END AS role FROM day_pos, range(0, 4) r(f)
WHERE (pos >= n - (4 - f) * 200 AND pos < n - (4 - f) * 200 + 200) OR (pos < n - (4 - f) * 200 - 20 AND NOT EXISTS (
  SELECT 1 FROM range(0, f) g(e) WHERE pos >= n - (4 - e) * 200 + 200 AND pos < n - (4 - e) * 200 + 210))
""")


@query("w_fold", "SELECT * FROM fold_log")
def w_fold(t):
    """Purged, embargoed walk-forward folds over dates."""
    return folds.fold_dates(t.bars, SPEC)


@query("j_fold", f"SELECT fold, role, {big('count(*)')} AS n, min(b.date) AS first_date, max(b.date) AS last_date FROM bars b JOIN fold_log f ON f.date = b.date GROUP BY fold, role")
def j_fold(t):
    """Rows per fold and role."""
    joined = t.bars.join(folds.fold_dates(t.bars, SPEC), "date")
    return joined.groupBy("fold", "role").agg(F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@query("w_thin", """
WITH s AS (SELECT CAST(CASE WHEN count(*) <= 10000 THEN 1 ELSE greatest(2, ceil(count(*) / 10000.0)) END AS INTEGER) AS stride FROM bars)
SELECT b.ticker, b.date, stride FROM bars b JOIN day_pos d ON d.date = b.date, s WHERE d.pos % stride = 0
""")
def w_thin(t):
    """Whole dates kept at an even stride until about 10 000 rows remain."""
    return t.bars.select("ticker", "date").join(folds.thinned_dates(t.bars, max_rows=10000), "date")


@query("w_inner_valid", """
WITH tr AS (SELECT fold, date, row_number() OVER (PARTITION BY fold ORDER BY date DESC) AS back, count(*) OVER (PARTITION BY fold) AS n FROM fold_log WHERE role = 'train'),
c AS (SELECT *, least(200, greatest(floor(n / 5), 1)) AS tail FROM tr)
SELECT fold, date, CASE WHEN n <= tail + 25 THEN 'fit' WHEN back <= tail THEN 'valid' ELSE 'fit' END AS part FROM c WHERE n <= tail + 25 OR back <= tail OR back > tail + 20
""")
def w_inner_valid(t):
    """Inner split of each fold's training dates for early stopping."""
    train = folds.fold_dates(t.bars, SPEC).where("role = 'train'")
    return folds.inner_validation(train, SPEC.test_size, 20)


TAIL_ROWS = 20_000  # rows of the recent tail that parameters are tuned on


@query("w_tune_tail", f"""
WITH c AS (SELECT date, sum(count(*)) OVER (ORDER BY date DESC) AS later FROM bars GROUP BY date)
SELECT ticker, bars.date FROM bars JOIN c ON c.date = bars.date WHERE later - (SELECT count(*) FROM bars b2 WHERE b2.date = c.date) < {TAIL_ROWS}
""")
def w_tune_tail(t):
    """Most recent whole dates that hold the tuning rows, from per-date counts."""
    return folds.recent_rows(t.bars.select("ticker", "date"), TAIL_ROWS)


@query("p_prior_model", f"""
WITH p AS (SELECT f.fold, avg(CAST(o.y AS DOUBLE)) AS p1 FROM oof_ok o JOIN fold_log f ON f.date = o.date AND f.role = 'train' GROUP BY f.fold)
SELECT o.ticker, o.date, f.fold, o.y, {s6('p1')} AS p1 FROM oof_ok o JOIN fold_log f ON f.date = o.date AND f.role = 'test' JOIN p ON p.fold = f.fold
""")
def p_prior_model(t):
    """The class-share model: every test row gets its fold's training shares."""
    rows = t.oof.where("y IS NOT NULL").select("ticker", "date", "y")
    marked = rows.join(folds.fold_dates(t.bars, SPEC), "date")
    prior = evaluation.class_priors(marked.where("role = 'train'"), ["fold"], 2)
    return marked.where("role = 'test'").join(prior, "fold").select(
        "ticker", "date", "fold", "y", settle(F.get("prior", F.lit(1))).alias("p1"))


# ---------------------------------------------------------------- drift

_dec = "[" + ", ".join(f"CAST({i / 10} AS DOUBLE)" for i in range(11)) + "]"
_long = " UNION ALL ".join(f"SELECT '{c}' AS feature, date, CAST({c} AS DOUBLE) AS x FROM feat_all" for c in vocab.FEATURES)
step("drift_long", f"SELECT *, date >= (SELECT max(date) FROM bars) - INTERVAL '60' DAY AS live FROM ({_long})")
step("drift_edges", f"SELECT feature, list_sort(list_distinct(quantile_cont(x, {_dec}))) AS edges FROM drift_long WHERE NOT live AND x IS NOT NULL GROUP BY feature")
step("drift_bins", """
SELECT d.feature, len(edges) AS ne, CASE WHEN x IS NULL THEN -1 ELSE len(list_filter(edges[2:len(edges) - 1], lambda e: e <= x)) END AS bin,
       count(CASE WHEN NOT live THEN 1 END) AS ref, count(CASE WHEN live THEN 1 END) AS now FROM drift_long d JOIN drift_edges g ON g.feature = d.feature GROUP BY ALL
""")
step("drift_all", """
WITH t AS (SELECT feature, sum(ref) AS nr, sum(now) AS nn FROM drift_bins GROUP BY feature),
s AS (SELECT feature, len(edges) AS ne, unnest(list_concat(range(0, greatest(len(edges) - 1, 1)), [-1])) AS bin FROM drift_edges),
v AS (SELECT s.feature, s.ne, greatest(coalesce(b.ref, 0) / nr, 1e-6) AS a, greatest(coalesce(b.now, 0) / nn, 1e-6) AS z
      FROM s JOIN t ON t.feature = s.feature LEFT JOIN drift_bins b ON b.feature = s.feature AND b.bin = s.bin)
SELECT feature, CASE WHEN any_value(ne) < 2 THEN 0 ELSE sum((z - a) * ln(z / a)) END AS psi FROM v GROUP BY feature
""")
_verdict = "CASE WHEN psi < 0.1 THEN 'stable' WHEN psi < 0.25 THEN 'moderate' ELSE 'significant' END"


def kept_features(t, names=vocab.FEATURES):
    """Drift reads its input several times, so the features are a written table first."""
    return stored(full_features(t).select("ticker", "date", *names), "features")


@query("ag_drift", f"SELECT feature, {s6('psi')} AS psi, {_verdict} AS verdict, psi >= 0.2 AS retrain FROM drift_all")
def ag_drift(t):
    """Stability of all 47 features, last 60 days against everything before."""
    out = monitoring.drift_report(kept_features(t), list(vocab.FEATURES))
    return out.select("feature", settle("psi").alias("psi"), "verdict", (F.col("psi") >= vocab.PSI_RETRAIN).alias("retrain"))


@query("ag_psi", f"SELECT feature, {s6('psi')} AS psi FROM drift_all WHERE feature IN ('vix', 'recession', 'current_ratio', 'event_density_90d')")
def ag_psi(t):
    """Stability of four features of different shapes (continuous, constant, absent, counts)."""
    names = ["vix", "recession", "current_ratio", "event_density_90d"]
    return monitoring.drift_report(kept_features(t, names), names).select("feature", settle("psi").alias("psi"))


@query("psi_verdict", f"SELECT {_verdict} AS verdict, {big('count(*)')} AS n FROM drift_all GROUP BY 1")
def psi_verdict_query(t):
    """Features per verdict."""
    return monitoring.drift_report(kept_features(t), list(vocab.FEATURES)).groupBy(psi_verdict(F.col("psi")).alias("verdict")).agg(F.count("*").alias("n"))


@query("ag_decide", """
WITH w AS (SELECT max(psi) AS psi, max_by(feature, psi) AS feature FROM drift_all)
SELECT true AS should_run, 'full' AS mode, printf('PSI %.3f on %s exceeds 0.2', psi, feature) AS reason FROM w
""")
def ag_decide(t):
    """Retraining decision: drift beats the calendar."""
    return monitoring.decide(kept_features(t), list(vocab.FEATURES), "2002-01-10", "2001-12-20", "2001-12-20")


@query("tk_worst", f"SELECT feature, {s6('psi')} AS psi, CAST(row_number() OVER (ORDER BY psi DESC, feature) AS INTEGER) AS place FROM drift_all QUALIFY place <= 10")
def tk_worst(t):
    """The ten features that moved most."""
    out = monitoring.drift_report(kept_features(t), list(vocab.FEATURES))
    top = out.orderBy(F.desc("psi"), "feature").limit(10)
    return top.select("feature", settle("psi").alias("psi"),
                      F.row_number().over(Window.orderBy(F.desc("psi"), "feature")).alias("place"))


@query("exact_quantiles", f"SELECT ticker, {big('count(close)')} AS n, {s6('quantile_cont(close, 0.25)', 3)} AS q25, {s6('quantile_cont(close, 0.5)', 3)} AS q50, {s6('quantile_cont(close, CAST(0.995 AS DOUBLE))', 3)} AS q995 FROM bars GROUP BY ticker")
def quantiles_query(t):
    """Exact quantiles by rank narrowing."""
    out = exact_quantiles(t.bars, ["ticker"], "close", [0.25, 0.5, 0.995])
    return out.select("ticker", "n", *[settle(F.col("q")[i], 3).alias(c) for i, c in enumerate(("q25", "q50", "q995"))])


# ---------------------------------------------------------------- per-row probability rules


@query("prob_argmax", f"""
SELECT ticker, date, CASE WHEN q0 >= q1 AND q0 >= q2 THEN 0 WHEN q1 >= q2 THEN 1 ELSE 2 END AS top,
       {s6('q2 / 0.25')} AS lift_up FROM oof3
""")
def prob_argmax(t):
    """Most likely class and lift over a prior."""
    prior = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.25))
    return scored3(t).select("ticker", "date", top_class(F.col("p")).alias("top"),
                             settle(F.get(lift(F.col("p"), prior), F.lit(2))).alias("lift_up"))


@query("prob_normalise", f"SELECT ticker, date, [{s6('1 - p_candidate')}, {s6('p_candidate')}] AS p FROM oof")
def prob_normalise(t):
    """Positive probability -> two-class vector."""
    return t.oof.select("ticker", "date", F.transform(as_vector("p_candidate"), lambda x: settle(x)).alias("p"))


@query("ag_earn_window", f"""
WITH r AS (SELECT o.*, s.days_since_earnings_result AS d FROM ev_rows o JOIN since_log s ON s.ticker = o.ticker AND s.date = o.date),
m AS (SELECT CASE WHEN d < 5000 AND d + 1.45 >= 91 THEN 'earnings_expected' ELSE 'quiet_period' END AS part, * FROM r)
SELECT part, {big('count(*)')} AS n, {s6('count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM m)')} AS share,
       CASE WHEN count(*) >= 250 AND count(DISTINCT y) > 1 THEN {s6('1 - avg(2 * (p_candidate - y) * (p_candidate - y)) / avg(2 * (p1 - y) * (p1 - y))')} END AS brier_skill
FROM m GROUP BY part
""")
def ag_earn_window(t):
    """Skill where the next report is due inside the horizon against the rest."""
    from panelyard.catalog.timeline import _event_line

    clock = _event_line(t).select("ticker", "date", F.col("days_since_earnings_result").alias("d"))
    due = (F.col("d") < 5000) & (F.col("d") + 1 * vocab.CALENDAR_PER_BAR >= vocab.EARNINGS_CYCLE_DAYS)
    rows = scored(t).join(clock, ["ticker", "date"], "left").withColumn(
        "part", F.when(due, "earnings_expected").otherwise("quiet_period"))
    y = F.col("y")
    out = rows.groupBy("part").agg(F.count("*").alias("n"), F.avg(squared_error(F.col("p"), y)).alias("b"),
                                   F.avg(squared_error(F.col("prior"), y)).alias("base"), F.countDistinct("y").alias("k"))
    total = out.agg(F.sum("n").alias("total"))
    skill = F.when((F.col("n") >= vocab.MIN_REGIME_ROWS) & (F.col("k") > 1), 1.0 - ratio("b", "base"))
    return beside(out, total).select(
        "part", "n", settle(F.col("n") / F.col("total")).alias("share"), settle(skill).alias("brier_skill"))
