"""Promotion gate, deployability, guard and quality on sector-level targets."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelyard import vocab
from panelyard.catalog.base import big, query, s6, step
from panelyard.catalog.evaluation import SHIFTED, _regime, scored
from panelyard.functions.draws import draw_sql
from panelyard.functions.numeric import settle
from panelyard.functions.probability import squared_error
from panelyard.functions.regimes import named_regime
from panelyard.operators import evaluation
from panelyard.operators.bootstrap import blocks_of, paired_edges
from panelyard.plans import gate
from panelyard.session import stored

PANEL_NOW = "e8fe94da6605"
step("gate_rows", f"""
SELECT u.sector AS target, r.*, {_regime.replace('date', 'r.date')} AS regime, 2 * (p_candidate - y) * (p_candidate - y) AS em,
       2 * (p_incumbent - y) * (p_incumbent - y) AS er, 2 * (p1 - y) * (p1 - y) AS eb
FROM ev_rows r JOIN universe u ON u.ticker = r.ticker
""")
step("gate_skill", "SELECT target, 1 - avg(em) / avg(eb) AS cs, 1 - avg(er) / avg(eb) AS ins FROM gate_rows GROUP BY target")
step("gate_blocks", "SELECT target, date, row_number() OVER (PARTITION BY target ORDER BY date) - 1 AS i, n, m, r, count(*) OVER (PARTITION BY target) AS k "
     "FROM (SELECT target, date, count(*) AS n, sum(em) AS m, sum(er) AS r FROM gate_rows GROUP BY ALL)")
step("gate_boot", f"""
SELECT target, quantile_cont(e, 0.05) AS lo, quantile_cont(e, 0.95) AS hi FROM (
  SELECT d.target, d.rep, 1 - sum(b.m) / sum(b.r) AS e FROM (
    SELECT target, rep, {draw_sql(0, 'rep', 'i', 'k')} AS j FROM gate_blocks, range(0, 2000) x(rep)) d
  JOIN gate_blocks b ON b.target = d.target AND b.i = d.j GROUP BY d.target, d.rep) GROUP BY target
""")
step("gate_edge", "SELECT b.target, sum(n) AS n_shared, count(*) AS n_blocks, 1 - sum(m) / sum(r) AS edge, any_value(lo) AS lo, any_value(hi) AS hi "
     "FROM gate_blocks b JOIN gate_boot q ON q.target = b.target GROUP BY b.target")
step("gate_regime", "SELECT target, regime, 1 - avg(em) / avg(eb) AS cs, 1 - avg(er) / avg(eb) AS ins, count(*) AS n FROM gate_rows GROUP BY ALL HAVING count(*) >= 250 AND count(DISTINCT y) > 1")
step("gate_reg", f"""
SELECT target, CASE WHEN target = 'Sector 3' THEN '3db13f4b530b' WHEN target = 'Sector 4' THEN 'aaaaaaaaaaaa' ELSE '{PANEL_NOW}' END AS inc_panel FROM gate_skill WHERE target <> 'Sector 2'
""")
step("gate_verdict", f"""
WITH w AS (SELECT target, count(*) AS k, max_by(regime, ins - cs) AS worst FROM gate_regime WHERE ins - cs > 0.005 GROUP BY target),
c AS (SELECT s.target, cs, CASE WHEN g.target IS NOT NULL THEN ins END AS ins, g.inc_panel, e.*  EXCLUDE (target), w.k, w.worst FROM gate_skill s LEFT JOIN gate_reg g ON g.target = s.target
      LEFT JOIN gate_edge e ON e.target = s.target LEFT JOIN w ON w.target = s.target)
SELECT *, CASE WHEN cs <= 0 THEN 'no skill over the base rate' WHEN inc_panel = '3db13f4b530b' THEN 'incumbent''s panel is retired' WHEN inc_panel IS NULL THEN 'no incumbent'
  WHEN inc_panel <> '{PANEL_NOW}' THEN 'different panels' WHEN n_shared >= 1000 AND (edge <= 0 OR lo <= -0.005) THEN 'no edge on shared rows'
  WHEN n_shared < 1000 AND cs <= ins THEN 'pooled skill not better' WHEN k > 0 THEN 'regresses in a regime' ELSE 'improves with no regression' END AS reason FROM c
""")


def gate_rows(t):
    y = F.col("y")
    return scored(t).join(t.universe.select("ticker", F.col("sector").alias("target")), "ticker").select(
        "target", "ticker", "date", "fold", "y", "p", "prior", squared_error(F.col("p"), y).alias("se_model"), squared_error(F.col("p_ref"), y).alias("se_reference"),
        squared_error(F.col("prior"), y).alias("se_base"), named_regime("date", SHIFTED).alias("regime"))


def _skill(rows, by):
    return rows.groupBy(*by).agg(
        (1 - F.avg("se_model") / F.avg("se_base")).alias("candidate"), (1 - F.avg("se_reference") / F.avg("se_base")).alias("incumbent"),
        F.count("*").alias("n"), F.countDistinct("y").alias("classes"))


def _by_regime(rows):
    return _skill(rows, ["target", "regime"]).where((F.col("n") >= vocab.MIN_REGIME_ROWS) & (F.col("classes") > 1))


def registry(t):
    """Registry table derived from the universe: one production model per sector but one."""
    panel = F.when(F.col("target") == "Sector 3", "3db13f4b530b").when(F.col("target") == "Sector 4", "aaaaaaaaaaaa").otherwise(PANEL_NOW)
    return t.universe.select(F.col("sector").alias("target")).distinct().where("target <> 'Sector 2'").select(
        "target", F.lit("production").alias("stage"), panel.alias("panel_id"), F.lit(None).cast("string").alias("schema"))


def comparison(t, rows=None):
    rows = gate_rows(t) if rows is None else rows
    cand = rows.select("target", "ticker", "date", "y", F.col("se_model").alias("se"))
    inc = rows.select("target", "ticker", "date", "y", F.col("se_reference").alias("se"))
    return gate.shared_comparison(gate.shared_rows(cand, inc))


def verdicts(t):
    rows = stored(gate_rows(t), "scored")  # skill, shared rows and regimes all read it
    skill = _skill(rows, ["target"])
    cand = skill.select("target", F.col("candidate").alias("skill"), F.lit(PANEL_NOW).alias("panel_id"), F.lit(None).cast("string").alias("schema"))
    inc = registry(t).join(skill.select("target", F.col("incumbent").alias("skill")), "target")
    return gate.promotion(cand, inc, comparison(t, rows), _by_regime(rows))


@query("j_common_rows", f"SELECT target, {big('n_shared')} AS n_shared, {big('n_blocks')} AS n_dates, {s6('edge')} AS edge, {s6('lo')} AS ci90_low, {s6('hi')} AS ci90_high FROM gate_edge")
def j_common_rows(t):
    """Edge of the candidate on the rows both models scored."""
    return comparison(t).select("target", "n_shared", F.col("n_blocks").alias("n_dates"), *[settle(c).alias(c) for c in ("edge", "ci90_low", "ci90_high")])


@query("so_intersect", "SELECT ticker, date FROM oof_ok INTERSECT SELECT ticker, as_of FROM done_cls")
def so_intersect(t):
    """Keys that two tables share."""
    from panelyard.catalog.feedback import resolved_of

    return t.oof.where("y IS NOT NULL").select("ticker", "date").intersect(resolved_of(t).select("ticker", F.col("as_of").alias("date")))


@query("p_promote", f"SELECT target, reason IN ('incumbent''s panel is retired', 'no incumbent', 'improves with no regression') AS promote, reason, {s6('cs')} AS candidate_skill, {s6('ins')} AS incumbent_skill FROM gate_verdict")
def p_promote(t):
    """The promotion gate."""
    return verdicts(t).select("target", "promote", "reason", settle("candidate_skill").alias("candidate_skill"), settle("incumbent_skill").alias("incumbent_skill"))


@query("p_retire", """
SELECT g.target, CASE WHEN g.inc_panel = '3db13f4b530b' AND NOT (v.reason IN ('incumbent''s panel is retired', 'no incumbent', 'improves with no regression')) THEN 'retired' ELSE 'production' END AS stage
FROM gate_reg g JOIN gate_verdict v ON v.target = g.target
""")
def p_retire(t):
    """Registry stages after the gate."""
    return gate.retirements(registry(t), verdicts(t)).select("target", "stage")


@query("j_retired", "SELECT target, CASE WHEN inc_panel = '3db13f4b530b' THEN inc_panel END AS retired, inc_panel AS panel FROM gate_reg")
def j_retired(t):
    """Which production models stand on a retired panel."""
    return registry(t).select("target", gate.is_retired(F.col("panel_id"), F.col("schema")).alias("retired"), F.coalesce("panel_id", "schema").alias("panel"))


@query("src_registry", "SELECT target FROM gate_reg")
def src_registry(t):
    """Targets of a stage."""
    from panelyard.sources.readers import targets_of

    return targets_of(registry(t))


@query("p_guard", """
WITH m AS (SELECT target, min(cs) AS w, min_by(regime, cs) AS r, count(*) AS k FROM gate_regime WHERE regime IN ('late', 'crisis') GROUP BY target)
SELECT s.target, m.r AS worst_regime, """ + s6("m.w") + """ AS worst_skill, CAST(coalesce(k, 0) AS BIGINT) AS regimes_measured, m.w IS NULL OR m.w > 0 AS reliable_now
FROM gate_skill s LEFT JOIN m ON m.target = s.target
""")
def p_guard(t):
    """Is each model's record positive in regimes like today's?"""
    rows = gate_rows(t)
    by = _by_regime(rows).select("target", "regime", F.col("candidate").alias("skill"))
    context = t.macro.agg(F.max("date").alias("d")).select(F.array(F.lit("late"), F.lit("crisis")).alias("relevant"))
    return gate.regime_guard(rows.select("target").distinct(), by, context).withColumn("worst_skill", settle("worst_skill"))


def _comparisons(t, rows):
    folds = paired_edges(blocks_of(rows, ["target"], "fold", "se_model", "se_reference"), ["target"], "fold")
    base = paired_edges(blocks_of(rows, ["target"], "fold", "se_model", "se_base"), ["target"], "fold")
    cols = ["target", "pooled", "ci90_low", "ci90_high"]
    return folds.select(*cols, F.lit("simple baseline").alias("family"), F.lit("incumbent").alias("name")).unionByName(
        base.select(*cols, F.lit("volatility benchmark").alias("family"), F.lit("class shares").alias("name")))


def _fold_boot(col):
    return f"""SELECT target, quantile_cont(e, 0.95) AS hi FROM (
  SELECT d.target, d.rep, 1 - sum(b.m) / sum(b.r) AS e FROM (SELECT target, rep, {draw_sql(0, 'rep', 'i', 'k')} AS j FROM fb_{col}, range(0, 2000) x(rep)) d
  JOIN fb_{col} b ON b.target = d.target AND b.i = d.j GROUP BY d.target, d.rep) GROUP BY target"""


for _c in ("er", "eb"):
    step(f"fb_{_c}", f"SELECT target, row_number() OVER (PARTITION BY target ORDER BY fold) - 1 AS i, m, r, count(*) OVER (PARTITION BY target) AS k FROM (SELECT target, fold, sum(em) AS m, sum({_c}) AS r FROM gate_rows GROUP BY ALL)")
    step(f"fq_{_c}", _fold_boot(_c))
step("deploy_log", "SELECT a.target, NOT (a.hi < 0 OR b.hi < 0) AS deployable FROM fq_er a JOIN fq_eb b ON b.target = a.target")


@query("p_deploy", "SELECT target, deployable, CAST(2 AS BIGINT) AS families_measured FROM deploy_log")
def p_deploy(t):
    """May each model be served?"""
    rows = stored(gate_rows(t), "scored")
    return gate.deployability(rows.select("target").distinct(), _comparisons(t, rows)).select("target", "deployable", "families_measured")


step("auc_gate", """
SELECT target, (sum(CASE WHEN y = 1 THEN r END) - CAST(sum(y) AS DOUBLE) * (sum(y) + 1) / 2) / (CAST(sum(y) AS DOUBLE) * (count(*) - sum(y))) AS auc FROM (
  SELECT *, rank() OVER (PARTITION BY target ORDER BY p_candidate) + (count(*) OVER (PARTITION BY target, p_candidate) - 1) / 2 AS r FROM gate_rows) GROUP BY target
""")
_verdict_sql = """CASE WHEN cs <= 0 THEN 'does not beat the base rates' WHEN cs < 0.01 THEN 'margin too small to tell from noise'
 ELSE printf('beats the base rates (Brier skill %+.4f)', cs) || printf('; out-of-sample AUC %.3f', auc) END"""


@query("q_verdict", f"SELECT s.target, {_verdict_sql} AS interpretation FROM gate_skill s JOIN auc_gate a ON a.target = s.target")
def q_verdict(t):
    """Plain-language verdict per target."""
    rows = gate_rows(t)
    scores = _skill(rows, ["target"]).join(evaluation.macro_auc(rows, ["target"]), "target")
    return scores.select("target", gate.quality_verdict(F.col("candidate"), F.col("macro_auc")).alias("interpretation"))


@query("p_quality", f"""
SELECT s.target, d.deployable, {_verdict_sql} AS interpretation, coalesce(s.target = (SELECT max_by(g.target, g.cs) FROM gate_skill g JOIN deploy_log x ON x.target = g.target WHERE x.deployable), false) AS is_best
FROM gate_skill s JOIN auc_gate a ON a.target = s.target JOIN deploy_log d ON d.target = s.target
""")
def p_quality(t):
    """Verdict per target and the best deployable one."""
    rows = stored(gate_rows(t), "scored")
    scores = _skill(rows, ["target"]).join(evaluation.macro_auc(rows, ["target"]), "target").withColumnRenamed("candidate", "brier_skill")
    deploy = gate.deployability(rows.select("target").distinct(), _comparisons(t, rows))
    return gate.model_quality(scores, deploy).select("target", "deployable", "interpretation", "is_best")


def quality_of(t):
    """Quality, guard and deployability tables of all targets."""
    rows = stored(gate_rows(t), "scored")
    targets = rows.select("target").distinct()
    scores = _skill(rows, ["target"]).join(evaluation.macro_auc(rows, ["target"]), "target").withColumnRenamed("candidate", "brier_skill")
    deploy = gate.deployability(targets, _comparisons(t, rows))
    by = _by_regime(rows).select("target", "regime", F.col("candidate").alias("skill"))
    context = t.macro.agg(F.max("date").alias("d")).select(F.array(F.lit("late"), F.lit("crisis")).alias("relevant"))
    return gate.model_quality(scores, deploy), gate.regime_guard(targets, by, context), deploy


@query("ag_importance", """
WITH a AS (SELECT ticker AS feature, row_number() OVER (ORDER BY sum(volume) DESC, ticker) AS place FROM bars GROUP BY ticker),
b AS (SELECT ticker AS feature, row_number() OVER (ORDER BY avg(close) DESC, ticker) AS place FROM bars GROUP BY ticker)
SELECT CAST(count(*) AS INTEGER) AS overlap_count, list(a.feature ORDER BY a.feature) AS overlap, count(*) / 10 AS agreement FROM a JOIN b ON b.feature = a.feature WHERE a.place <= 10 AND b.place <= 10
""")
def ag_importance(t):
    """Overlap of two rankings: names by volume and by mean price stand for two importance lists."""
    from pyspark.sql import Window

    per = t.bars.groupBy(F.col("ticker").alias("feature")).agg(F.sum("volume").alias("v"), F.avg("close").alias("c"))
    a = per.select("feature", F.row_number().over(Window.orderBy(F.desc("v"), "feature")).alias("place"))
    b = per.select("feature", F.row_number().over(Window.orderBy(F.desc("c"), "feature")).alias("place"))
    return gate.importance_overlap(a, b).select("overlap_count", "overlap", "agreement")
