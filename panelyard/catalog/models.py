"""Model fits, volatility benchmarks and the payload."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Window, functions as F

from panelyard import vocab
from panelyard.catalog.base import query, s6, step
from panelyard.catalog.evaluation import TAIL_ROWS
from panelyard.catalog.timeline import AS_OF, full_features
from panelyard.catalog.windows import _roll
from panelyard.functions.numeric import settle
from panelyard.operators.bootstrap import blocks_of, paired_edges
from panelyard.operators.evaluation import evaluate, pointwise
from panelyard.operators.single import beside
from panelyard.operators.folds import FoldSpec, fold_dates
from panelyard.operators.boosting import Boosting
from panelyard.plans import gate, models, monitoring, training, volatility
from panelyard.plans.labels import TARGETS, label_scales
from panelyard.plans.panel import build_panel, latest_rows, target_rows
from panelyard.session import stored

SPEC = FoldSpec(n_splits=3, test_size=252, purge=5, embargo=10)
SMALL = {"numTrees": 10, "maxDepth": 4, "maxBins": 32}
BOOST = {"maxIter": 10, "maxDepth": 3, "maxBins": 32}
ALL = list(vocab.FEATURES)



def panel_of(t):
    """The stored panel of one run: built once, then read by every step of it."""
    if t.panel is None:
        t.panel = stored(build_panel(t, as_of=AS_OF), "panel")
    return t.panel


def rows_of(t, kind="magnitude", horizon=1, features=ALL):
    """Labelled rows of all dates, and their folds."""
    rows = target_rows(panel_of(t), kind, horizon, features)
    return rows, fold_dates(rows, SPEC)


def _study(t, sets, learner="forest"):
    rows, days = rows_of(t)
    days = stored(days, "folds")
    model = models.walk_forward(rows, days, ALL, 2, learner, SMALL if learner == "forest" else BOOST)
    others = models.fit_sets(rows, days, sets, 2, saved=model, learner="forest", params=SMALL)
    return model, stored(models.paired_errors(model, others), "errors")


def _edges(errors, level=0.90):
    return paired_edges(blocks_of(errors, ["name"], "fold", "se_model", "se_reference"), ["name"], "fold", level)


# ---------------------------------------------------------------- all targets through the folds
STUDY = FoldSpec(n_splits=5, test_size=252, purge=5, embargo=10)
TREES = Boosting(rounds=150, depth=3, rate=0.1, bins=32, patience=10)


def _target_folds(name, kind, horizon):
    purge, label, n = max(STUDY.purge, horizon), f"label_{kind}_{horizon}d", f"n - ({STUDY.n_splits} - f) * {STUDY.test_size}"
    step(f"tf_{name}_day", f"SELECT date, CAST(row_number() OVER (ORDER BY date) - 1 AS INTEGER) AS pos, CAST(count(*) OVER () AS INTEGER) AS n FROM (SELECT DISTINCT date FROM panel_log WHERE {label} IS NOT NULL)")
    return f"""
SELECT '{name}' AS target, CAST(f AS INTEGER) AS fold, date, CASE WHEN pos >= {n} THEN 'test' ELSE 'train' END AS role FROM tf_{name}_day, range(0, {STUDY.n_splits}) r(f)
WHERE (pos >= {n} AND pos < {n} + {STUDY.test_size}) OR (pos < {n} - {purge} AND NOT EXISTS (
  SELECT 1 FROM range(1, f + 1) g(e) WHERE pos >= n - ({STUDY.n_splits} - e) * {STUDY.test_size} AND pos < n - ({STUDY.n_splits} - e) * {STUDY.test_size} + {STUDY.embargo}))"""


step("tf_fold", " UNION ALL ".join(_target_folds(name, kind, h) for name, kind, h, _ in TARGETS))
step("tf_rows", " UNION ALL ".join(f"SELECT '{name}' AS target, {k} AS k, ticker, date, label_{kind}_{h}d AS y FROM panel_log WHERE label_{kind}_{h}d IS NOT NULL"
                                   for name, kind, h, k in TARGETS))


def study_of(t, targets=TARGETS, features=ALL):
    return training.walk_forward_all(panel_of(t), targets, features, STUDY, TREES)


@query("p_walkforward", f"""
WITH tr AS (SELECT r.target, f.fold, count(*) AS n_train, {', '.join(f"avg(CASE WHEN y = {c} THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS s{c}" for c in range(3))} FROM tf_rows r
  JOIN tf_fold f ON f.target = r.target AND f.date = r.date AND f.role = 'train' GROUP BY ALL),
te AS (SELECT r.target, f.fold, any_value(k) AS k, count(*) AS n, count(DISTINCT r.date) AS days, min(r.date) AS first_date, max(r.date) AS last_date,
  {', '.join(f"avg(CASE WHEN y = {c} THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS t{c}" for c in range(3))} FROM tf_rows r JOIN tf_fold f ON f.target = r.target AND f.date = r.date AND f.role = 'test' GROUP BY ALL)
SELECT te.target, te.fold, n, days, first_date, last_date, n_train, {', '.join(s6(f's{c}') + f' AS prior_{c}' for c in range(2))}, {s6('CASE WHEN k = 3 THEN s2 END')} AS prior_2,
  {', '.join(s6(f't{c}') + f' AS share_{c}' for c in range(3))}, true AS sums_to_one, true AS stopped, true AS learned
FROM te JOIN tr ON tr.target = te.target AND tr.fold = te.fold
""")
def p_walkforward(t):
    """Nine targets through five purged folds, fitted in one job: rows, priors and class shares of each fold, and whether probabilities sum to one,
    rounds ended before their limit, and more than the prior was fitted."""
    study = study_of(t)
    prior = [settle(F.get("prior", F.lit(c))).alias(f"prior_{c}") for c in range(3)]
    rows = study.oof.groupBy("target", "fold", "n_train", "prior").agg(
        F.count("*").alias("n"), F.countDistinct("date").alias("days"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        *[settle(F.avg((F.col("y") == c).cast("double"))).alias(f"share_{c}") for c in range(3)],
        (F.max(F.abs(F.aggregate("p", F.lit(0.0), lambda a, x: a + x) - 1)) < 1e-9).alias("sums_to_one"))
    fits = study.models.select("target", "fold", (F.col("rounds_run") < TREES.rounds).alias("stopped"), (F.size("feature") > 0).alias("learned"))
    return rows.join(fits, ["target", "fold"]).select("target", "fold", "n", "days", "first_date", "last_date", "n_train", *prior,
                                                      "share_0", "share_1", "share_2", "sums_to_one", "stopped", "learned")


@query("p_walkforward_scores")
def p_walkforward_scores(t):
    """All metrics of all targets and folds on out-of-fold rows."""
    return evaluate(study_of(t).oof, ["target", "fold"])


@query("p_final_models")
def p_final_models(t):
    """The final model of every target: rounds, rows, class shares and leading features."""
    study = study_of(t)
    final = training.final_models(panel_of(t), study, TARGETS)
    names = F.array(*[F.lit(c) for c in ALL])
    ranked = F.slice(F.sort_array(F.zip_with("gain", names, lambda g, n: F.struct((-g).alias("g"), n.alias("n")))), 1, 5)
    folds = study.models.groupBy("target").agg(F.array_sort(F.collect_list("best_round")).alias("fold_rounds"))  # one number a fold
    return final.join(folds, "target").select("target", "k", F.col("best_round").alias("rounds"), "fold_rounds", "rows",
                                              F.transform(ranked, lambda s: s["n"]).alias("leading_features"))


@query("p_feature_sets")
def p_feature_sets(t):
    """Three feature sets on identical out-of-fold rows."""
    rows, days = rows_of(t)
    sets = models.fit_sets(rows, stored(days, "folds"), vocab.BASELINE_SETS, 2, learner="forest", params=SMALL)
    first = sets["vol"]
    for other in sets.values():
        models.check_aligned(other, first)
    out = None
    for name, oof in sets.items():
        one = pointwise(oof, []).withColumn("name", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query("p_baselines")
def p_baselines(t):
    """The model against three simple baselines, with a verdict for the strongest."""
    _, errors = _study(t, vocab.BASELINE_SETS)
    brier = errors.groupBy("name").agg(F.avg("se_reference").alias("brier_reference"), F.avg("se_model").alias("brier"), F.avg("se_base").alias("base"))
    best = F.col("brier_reference") == F.min("brier_reference").over(Window.partitionBy(F.lit(0)))  # one row per baseline
    return brier.join(_edges(errors), "name").select(
        "name", best.alias("is_reference"), (1 - F.col("brier") / F.col("base")).alias("model_skill"),
        (1 - F.col("brier_reference") / F.col("base")).alias("reference_skill"), "pooled", "ci90_low", "ci90_high", "wins", "n_blocks",
        gate.baseline_verdict(F.col("pooled"), F.col("ci90_low"), F.col("wins"), F.col("n_blocks")).alias("verdict"))


@query("p_ablations")
def p_ablations(t):
    """Each feature group on top of volatility, judged at a family-wise level."""
    vol = list(vocab.VOLATILITY_FEATURES)
    sets = {f"vol+{g}": vol + list(vocab.FEATURE_GROUPS[g]) for g in ("technical", "sector", "events", "macro", "fundamentals")}
    sets["vol+macro-vix_level"] = vol + [f for f in vocab.MACRO_FEATURES if f != "vix"]
    rows, days = rows_of(t)
    days = stored(days, "folds")
    reference = models.walk_forward(rows, days, vol, 2, "forest", SMALL)
    others = models.fit_sets(rows, days, sets, 2, saved=reference, learner="forest", params=SMALL)
    errors = models.paired_errors(reference, others)
    # here the set is the model and volatility alone the reference
    swapped = errors.withColumnRenamed("se_model", "x").withColumnRenamed("se_reference", "se_model").withColumnRenamed("x", "se_reference")
    level = 1 - 0.1 / len(sets)
    return _edges(swapped, level).withColumn("verdict", gate.set_verdict(
        F.col("pooled"), F.col("ci_low"), F.col("ci_high"), F.col("wins"), F.col("n_blocks")))


# ---------------------------------------------------------------- exact small models
step("thin_pos", "SELECT date, CAST(row_number() OVER (ORDER BY date) - 1 AS INTEGER) AS p FROM (SELECT DISTINCT date FROM panel_log WHERE label_magnitude_1d IS NOT NULL)")
step("thin_rows", "SELECT l.*, label_magnitude_1d AS y FROM panel_log l JOIN thin_pos t ON t.date = l.date WHERE label_magnitude_1d IS NOT NULL")
step("thin_days", "SELECT date, CAST(row_number() OVER (ORDER BY date) - 1 AS INTEGER) AS pos, CAST(count(*) OVER () AS INTEGER) AS n FROM (SELECT DISTINCT date FROM thin_rows)")
step("thin_fold", f"""
SELECT CAST(f AS INTEGER) AS fold, date, CASE WHEN pos >= n - ({SPEC.n_splits} - f) * {SPEC.test_size} THEN 'test' ELSE 'train' END AS role FROM thin_days, range(0, {SPEC.n_splits}) r(f)
WHERE (pos >= n - ({SPEC.n_splits} - f) * {SPEC.test_size} AND pos < n - ({SPEC.n_splits - 1} - f) * {SPEC.test_size}) OR (pos < n - ({SPEC.n_splits} - f) * {SPEC.test_size} - {SPEC.purge} AND NOT EXISTS (
  SELECT 1 FROM range(0, f) g(e) WHERE pos >= n - ({SPEC.n_splits - 1} - e) * {SPEC.test_size} AND pos < n - ({SPEC.n_splits - 1} - e) * {SPEC.test_size} + {SPEC.embargo}))
""")
step("bm_rows", "SELECT f.fold, f.role, r.ticker, r.date, r.y, CAST(CAST(r.vol_20 AS FLOAT) AS DOUBLE) AS v FROM thin_rows r JOIN thin_fold f ON f.date = r.date")
_tenths = "[" + ", ".join(f"CAST({i / 10} AS DOUBLE)" for i in range(1, 10)) + "]"
step("bm_placed", f"""
SELECT r.*, CASE WHEN v IS NULL THEN -1 ELSE len(list_filter(q, lambda e: e <= v)) END AS bucket FROM bm_rows r
JOIN (SELECT fold, quantile_cont(v, {_tenths}) AS q FROM bm_rows WHERE role = 'train' AND v IS NOT NULL GROUP BY fold) c ON c.fold = r.fold
""")


@query("p_bucket_model", f"""
SELECT t.fold, t.ticker, t.date, t.y, {s6('coalesce(f.p1, a.p1)')} AS p1 FROM bm_placed t
LEFT JOIN (SELECT fold, bucket, avg(CAST(y AS DOUBLE)) AS p1 FROM bm_placed WHERE role = 'train' GROUP BY ALL) f ON f.fold = t.fold AND f.bucket = t.bucket
JOIN (SELECT fold, avg(CAST(y AS DOUBLE)) AS p1 FROM bm_placed WHERE role = 'train' GROUP BY ALL) a ON a.fold = t.fold WHERE t.role = 'test'
""")
def p_bucket_model(t):
    """Quantile-bucket frequencies of one feature."""
    rows, days = rows_of(t)
    out = models.bucket_model(rows, stored(days, "folds"), "vol_20", 2)
    return out.select("fold", "ticker", "date", "y", settle(F.get("p", F.lit(1))).alias("p1"))


# ---------------------------------------------------------------- volatility benchmarks
_w = "OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN {a} AND {b})"
step("vs_day", "SELECT ticker, date, ret, ret * ret AS rv_d, CASE WHEN high > 0 AND low > 0 AND high >= low THEN pow(ln(high / low), 2) / (4 * ln(2)) END AS pk_d FROM px_ret")
step("vs_all", f"""
SELECT *, {_roll('avg', 'rv_d', 5, 5, 'rv_w')}, {_roll('avg', 'rv_d', 22, 22, 'rv_m')}, {_roll('avg', 'pk_d', 5, 5, 'pk_w')}, {_roll('avg', 'pk_d', 22, 22, 'pk_m')},
       {', '.join(f"CASE WHEN count(rv_d) {_w.format(a='1 FOLLOWING', b=f'{h} FOLLOWING')} >= {h} THEN avg(rv_d) {_w.format(a='1 FOLLOWING', b=f'{h} FOLLOWING')} END AS future_{h}" for h in (1, 5, 20))},
       {_roll('stddev_samp', 'ret', 60, 30, 'sd60')} FROM vs_day
""")


def _series_query(name, cols, doc):
    @query(name, f"SELECT ticker, date, {', '.join(s6('sd60 * sd60' if c == 'trail_var' else c) + ' AS ' + c for c in cols)} FROM vs_all")
    def build(t):
        return volatility.variance_series(t.bars).select("ticker", "date", *[settle(c).alias(c) for c in cols])

    build.__doc__ = doc


_series_query("w_har", ["rv_d", "rv_w", "rv_m"], "Daily, weekly and monthly variance.")
_series_query("w_parkinson", ["pk_d"], "Range-based daily variance.")
_series_query("w_future_var", ["future_1", "future_5", "future_20"], "Mean variance over the next rows.")
_series_query("w_bench_series", ["rv_m", "pk_w", "pk_m", "trail_var"], "All benchmark series.")


@query("j_series_lookup", f"SELECT p.ticker, p.as_of AS date, {s6('v.rv_m')} AS rv_m FROM predictions p LEFT JOIN vs_all v ON v.ticker = p.ticker AND v.date = p.as_of")
def j_series_lookup(t):
    """Bar-derived series beside scored rows."""
    series = volatility.variance_series(t.bars).select("ticker", "date", "rv_m")
    return t.predictions.select("ticker", F.col("as_of").alias("date")).join(series, ["ticker", "date"], "left").select("ticker", "date", settle("rv_m").alias("rv_m"))


@query("j_panel_lookup", f"SELECT o.ticker, o.date, {s6('f.vol_60')} AS vol_60 FROM oof o LEFT JOIN feat_price f ON f.ticker = o.ticker AND f.date = o.date")
def j_panel_lookup(t):
    """One panel feature beside out-of-fold rows."""
    return t.oof.select("ticker", "date").join(full_features(t).select("ticker", "date", "vol_60"), ["ticker", "date"], "left").select(
        "ticker", "date", settle("vol_60").alias("vol_60"))


step("gf_in", "SELECT ticker, row_number() OVER (PARTITION BY ticker ORDER BY date) AS rn, date, ret FROM px_ret WHERE ret IS NOT NULL")
step("gf_all", """
SELECT ticker, rn, CAST(0.001 AS DOUBLE) + CAST(0.05 AS DOUBLE) * ret * ret + CAST(0.9 AS DOUBLE) * CAST(0.04 AS DOUBLE) AS ahead FROM gf_in WHERE rn = 1
UNION ALL SELECT g.ticker, g.rn, CAST(0.001 AS DOUBLE) + CAST(0.05 AS DOUBLE) * g.ret * g.ret + CAST(0.9 AS DOUBLE) * e.ahead FROM gf_all e JOIN gf_in g ON g.ticker = e.ticker AND g.rn = e.rn + 1
""")


@query("w_garch_filter", f"SELECT i.ticker, i.date, {s6('ahead')} AS ahead FROM gf_all a JOIN gf_in i ON i.ticker = a.ticker AND i.rn = a.rn")
def w_garch_filter(t):
    """Conditional variances for given parameters."""
    rows = volatility.variance_series(t.bars).where("ret IS NOT NULL").select(
        "ticker", "date", "day", "ret", F.lit(0.001).alias("omega"), F.lit(0.05).alias("alpha"), F.lit(0.9).alias("beta"), F.lit(0.04).alias("init"))
    return volatility.garch_filter(rows).select("ticker", "date", settle("ahead").alias("ahead"))


def _det(m):
    """Determinant of a 4 x 4 matrix of SQL terms, written out."""
    out = []
    for p in permutations(range(4)):
        odd = sum(p[i] > p[j] for i in range(4) for j in range(i + 1, 4)) % 2
        out.append(("-" if odd else "+") + " * ".join(m[i][p[i]] for i in range(4)))
    return "(" + " ".join(out) + ")"


_hx = ["rv_d", "rv_w", "rv_m"]
step("har_rows", "SELECT f.fold, f.role, r.ticker, r.date, " + ", ".join(f"v.{c} / (v.sd60 * v.sd60) AS {c}" for c in _hx) +
     ", v.future_1 / (v.sd60 * v.sd60) AS tr FROM thin_rows r JOIN thin_fold f ON f.date = r.date JOIN vs_all v ON v.ticker = r.ticker AND v.date = r.date WHERE v.sd60 > 0")
step("har_train", "SELECT * FROM har_rows WHERE role = 'train' AND tr IS NOT NULL AND " + " AND ".join(f"{c} IS NOT NULL" for c in _hx))
step("har_caps", "SELECT fold, " + ", ".join(f"quantile_cont({c}, CAST(0.995 AS DOUBLE)) AS c_{c}" for c in [*_hx, "tr"]) + " FROM har_train GROUP BY fold")
step("har_clip", "SELECT t.fold, CAST(1 AS DOUBLE) AS x0, " + ", ".join(f"least(t.{c}, c_{c}) AS x{i + 1}" for i, c in enumerate(_hx)) + ", least(tr, c_tr) AS t FROM har_train t JOIN har_caps c ON c.fold = t.fold")
step("har_sums", "SELECT fold, count(*) AS n, " + ", ".join(f"avg(x{a} * x{b}) AS m{a}{b}" for a in range(4) for b in range(4)) + ", " + ", ".join(f"avg(x{a} * t) AS v{a}" for a in range(4)) + " FROM har_clip GROUP BY fold")
_m = [[f"m{a}{b}" for b in range(4)] for a in range(4)]
_cols = ["b0", "b_d", "b_w", "b_m"]
_cramer = ", ".join(s6(_det([[f"v{a}" if b == i else _m[a][b] for b in range(4)] for a in range(4)]) + " / " + _det(_m)) + f" AS {_cols[i]}" for i in range(4))


@query("p_har", f"SELECT fold, CAST(n AS BIGINT) AS n, {_cramer} FROM har_sums")
def p_har(t):
    """HAR coefficients per fold."""
    rows, days = rows_of(t)
    series = stored(volatility.variance_series(t.bars), "series")
    coefs, _ = volatility.har(series, rows, stored(days, "folds"), 1)
    return coefs.select("fold", "n", *[settle(c).alias(c) for c in _cols])


@query("p_garch")
def p_garch(t):
    """GARCH(1,1) per fold and ticker on training returns."""
    rows, days = rows_of(t)
    series = stored(volatility.variance_series(t.bars), "series")
    fits, _ = volatility.garch_forecast(series, stored(days, "folds"), 1)
    return fits


step("cal_rows", "SELECT f.fold, f.role, r.ticker, r.date, r.y, CAST(CAST(r.vol_ratio_20_60 AS FLOAT) AS DOUBLE) AS v FROM thin_rows r JOIN thin_fold f ON f.date = r.date")
step("cal_train", """
SELECT r.fold, y, (v - m) / s AS x FROM cal_rows r JOIN (SELECT fold, avg(v) AS m, stddev_samp(v) AS s FROM cal_rows WHERE role = 'train' AND v IS NOT NULL GROUP BY fold) a ON a.fold = r.fold
WHERE role = 'train' AND v IS NOT NULL
""")
step("cal_fit0", "SELECT DISTINCT fold, CAST(0 AS DOUBLE) AS b0, CAST(0 AS DOUBLE) AS b1 FROM cal_train")
for _i in range(1, 9):  # Newton steps of a model with two coefficients, written out
    step(f"cal_sum{_i}", f"""
SELECT fold, any_value(b0) AS b0, any_value(b1) AS b1, sum(p - y) AS g0, sum((p - y) * x) AS g1, sum(p * (1 - p)) AS h0, sum(p * (1 - p) * x) AS h1, sum(p * (1 - p) * x * x) AS h2
FROM (SELECT t.fold, y, x, b0, b1, 1 / (1 + exp(-(b0 + b1 * x))) AS p FROM cal_train t JOIN cal_fit{_i - 1} f ON f.fold = t.fold) GROUP BY fold""")
    step(f"cal_fit{_i}", f"SELECT fold, b0 - (h2 * g0 - h1 * g1) / (h0 * h2 - h1 * h1) AS b0, b1 - (h0 * g1 - h1 * g0) / (h0 * h2 - h1 * h1) AS b1 FROM cal_sum{_i}")


@query("p_calibrate", f"""
SELECT r.fold, r.ticker, r.date, r.y, {s6('coalesce(1 / (1 + exp(-(b0 + b1 * (v - m) / s))), prior)')} AS p1, {s6('prior')} AS prior1 FROM cal_rows r
JOIN (SELECT fold, avg(v) AS m, stddev_samp(v) AS s, avg(CAST(y AS DOUBLE)) AS prior FROM cal_rows WHERE role = 'train' GROUP BY fold) a ON a.fold = r.fold
JOIN cal_fit8 f ON f.fold = r.fold WHERE r.role = 'test'
""")
def p_calibrate(t):
    """Logistic calibration of one feature, all folds in one fit."""
    rows, days = rows_of(t)
    out = models.calibrated(rows, stored(days, "folds"), "vol_ratio_20_60", 2)
    return out.select("fold", "ticker", "date", "y", settle(F.get("p", F.lit(1))).alias("p1"), settle(F.get("prior", F.lit(1))).alias("prior1"))


SINGLE = ("vol_20", "vol_60", "atr_14_pct")  # features that are scored alone beside the volatility forecasts


@query("p_volbench")
def p_volbench(t):
    """HAR, range HAR, GARCH and three single features, calibrated in one fit, against the model on its own rows: coverage, skills, edge and verdict."""
    model, errors, coverage = volbench_of(t)
    skill = errors.groupBy("name").agg((1 - F.avg("se_reference") / F.avg("se_base")).alias("benchmark_skill"), (1 - F.avg("se_model") / F.avg("se_base")).alias("model_skill"))
    best = F.col("benchmark_skill") == F.max("benchmark_skill").over(Window.partitionBy(F.lit(0)))  # one row per benchmark
    return skill.withColumn("is_reference", best).join(coverage, "name").join(_edges(errors), "name").withColumn(
        "verdict", gate.baseline_verdict(F.col("pooled"), F.col("ci90_low"), F.col("wins"), F.col("n_blocks")))


def volbench_of(t):
    """The model's out-of-fold rows, its errors beside those of every benchmark, and the share of test rows that each covers."""
    rows, days = rows_of(t)
    days = stored(days, "folds")
    model = models.walk_forward(rows, days, ALL, 2, "forest", SMALL)
    series = stored(volatility.variance_series(t.bars), "series")
    keys = ["fold", "ticker", "date"]
    forecasts = [x.select(*keys, "x").withColumn("name", F.lit(name)) for name, x in (
        ("har", volatility.har(series, rows, days, 1, "rv")[1]), ("har_range", volatility.har(series, rows, days, 1, "pk")[1]),
        ("garch", volatility.garch_forecast(series, days, 1)[1]))]
    every = rows.join(days.select("fold", "date"), "date")  # a single feature is known in every fold
    forecasts += [every.select(*keys, F.col(f).cast("double").alias("x")).withColumn("name", F.lit(f)) for f in SINGLE]
    x = None
    for one in forecasts:
        x = one if x is None else x.unionByName(one)
    names = F.explode(F.array(*[F.lit(n) for n in ("har", "har_range", "garch", *SINGLE)]))
    asked = rows.select("ticker", "date", "y").join(days.select("fold", "date"), "date").withColumn("name", names)
    asked = stored(asked.join(x, ["name", *keys], "left"), "forecasts")
    fitted = stored(models.calibrated(asked, days, "x", 2, group=("fold", "name")), "benchmarks")
    tests = asked.join(days.where("role = 'test'"), ["fold", "date"])
    coverage = tests.groupBy("name").agg(F.count("*").alias("n_test"), F.avg(F.col("x").isNotNull().cast("double")).alias("coverage"))
    others = {name: fitted.where(F.col("name") == name).drop("name") for name in ("har", "har_range", "garch", *SINGLE)}
    return model, stored(models.paired_errors(model, others), "errors"), coverage


# ---------------------------------------------------------------- studies on fitted models


@query("p_fusion")
def p_fusion(t):
    """Logistic combination of out-of-fold probabilities; adopted only for a clear gain."""
    rows, days = rows_of(t)
    oof = models.walk_forward(rows, stored(days, "folds"), list(vocab.BASELINE_SETS["simple"]), 2, "forest", SMALL)
    inner = fold_dates(oof, FoldSpec(n_splits=2, test_size=100, purge=5, embargo=5))
    return models.fusion_gain(models.fusion(oof, stored(inner, "folds"), 2))


GRID = [Boosting(rounds=r, depth=d, rate=e, bins=32, patience=10, l2=g) for r, e in ((100, 0.1), (150, 0.05)) for d in (2, 3, 4) for g in (2.0, 20.0)]


@query("p_tune", f"""
SELECT CAST(trial AS INTEGER) AS trial, depth, rate, true AS counted FROM (VALUES {', '.join(f"({i}, {g.depth}, CAST({g.rate} AS DOUBLE))" for i, g in enumerate(GRID))}) v(trial, depth, rate)
""")
def p_tune(t):
    """Twelve trials raced over three folds of the recent tail; each has a place, and the winner has run all folds."""
    race = tune_of(t)
    sound = F.when(F.col("place") == 1, (F.col("folds_done") == 3) & F.col("given_up_after").isNull()).otherwise(
        F.coalesce(F.col("given_up_after") == F.col("folds_done"), F.col("folds_done") == 3))
    return race.select("trial", "depth", "rate", (sound & F.col("place").between(1, len(GRID))).alias("counted"))


@query("p_tune_table")
def tune_of(t):
    """The table of the race: mean skill, folds run, and where a trial was given up."""
    spec = FoldSpec(n_splits=3, test_size=100, purge=5, embargo=10)
    return training.tune_race(panel_of(t), TARGETS[[n for n, *_ in TARGETS].index("magnitude_1d")], ALL, spec, GRID, TAIL_ROWS)


def _fitted(t, learner="forest", params=SMALL):
    """A model of the last fold's training rows, and those rows."""
    rows, days = rows_of(t)
    rows = rows.join(days.where((F.col("fold") == SPEC.n_splits - 1) & (F.col("role") == "train")).select("date"), "date")
    ready = models.vectors(rows, ALL).select("y", "x")
    return models.fit(ready, 2, learner, params), rows


@query("p_challenger")
def p_challenger(t):
    """Two learners on the same fold: their importances and the overlap."""
    a, _ = _fitted(t)
    b, _ = _fitted(t, "gbt", BOOST)
    return gate.importance_overlap(models.importances(a, ALL, t.spark), models.importances(b, ALL, t.spark))


def latest_of(t):
    rows = label_scales(full_features(t))
    return latest_rows(rows, ["close", "label_scale", "rel_label_scale", *ALL]).withColumnRenamed("close", "last_close")


@query("p_attrib")
def p_attrib(t):
    """Five features per ticker whose replacement by the median moves the score most."""
    predict, rows = _fitted(t)
    med = rows.agg(*[F.coalesce(F.approx_percentile(F.col(c).cast("double"), 0.5), F.lit(0.0)).alias(c) for c in ALL]).first().asDict()
    return models.attribution(latest_rows(panel_of(t), ALL), ALL, predict, med)


@query("tk_shap_topk", f"""
WITH w AS (SELECT ticker, date, unnest([{', '.join(f"'{c}'" for c in ('ret_5', 'ret_20', 'ret_60', 'vol_20', 'vol_60', 'beta_60', 'rsi_14'))}]) AS feature,
  unnest([{', '.join(c for c in ('ret_5', 'ret_20', 'ret_60', 'vol_20', 'vol_60', 'beta_60', 'rsi_14 / 100 - 0.5'))}]) AS c FROM feat_price WHERE ret_60 IS NOT NULL AND vol_60 IS NOT NULL AND beta_60 IS NOT NULL)
SELECT ticker, date, string_agg(feature, ',' ORDER BY abs(c) DESC, feature DESC) AS top FROM (
  SELECT *, row_number() OVER (PARTITION BY ticker, date ORDER BY abs(c) DESC, feature DESC) AS k FROM w) WHERE k <= 5 GROUP BY ticker, date
""")
def tk_shap_topk(t):
    """Five largest of seven signed values per row."""
    from panelyard.catalog.windows import features_of

    names = ("ret_5", "ret_20", "ret_60", "vol_20", "vol_60", "beta_60", "rsi_14")
    rows = features_of(t).where("ret_60 IS NOT NULL AND vol_60 IS NOT NULL AND beta_60 IS NOT NULL")
    parts = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value"),
                               (F.col(c) / 100 - 0.5 if c == "rsi_14" else F.col(c)).alias("contribution")) for c in names])
    top = models.top_contributions(parts)
    return rows.select("ticker", "date", F.array_join(F.transform(top, lambda c: c["feature"]), ",").alias("top"))


@query("align_schema", f"""
SELECT ticker, date, {', '.join(s6(f'CAST({c} AS FLOAT)', 3) + ' AS ' + c for c in ALL)} FROM feat_all QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1
""")
def align_schema(t):
    """Features in training order, extra columns dropped."""
    from panelyard.plans.features import aligned

    return aligned(latest_of(t), ALL).select("ticker", "date", *[settle(c, 3).alias(c) for c in ALL])


@query("leak_guard", f"SELECT CAST(count(*) AS BIGINT) AS rows, CAST({len(vocab.FEATURES)} AS INTEGER) AS features FROM panel_log")
def leak_guard(t):
    """Feature names that look forward are refused; what passes is counted."""
    from panelyard.plans.features import check_no_leak

    panel = panel_of(t)
    names = [c for c in panel.columns if c not in ("ticker", "date") and not c.startswith(vocab.LABEL_PREFIXES)]
    check_no_leak(names)
    return panel.agg(F.count("*").alias("rows")).withColumn("features", F.lit(len(names)).cast("int"))


NAMES_OF = {"magnitude": vocab.MAGNITUDE_NAMES, "direction": vocab.DIRECTION_NAMES, "rel_direction": vocab.DIRECTION_NAMES}


def fitted_targets(panel, before=None):
    """A model and the class shares of every target, from the rows before a day."""
    predictors, priors = {}, {}
    for target, kind, horizon, k in TARGETS:
        rows = target_rows(panel, kind, horizon, ALL)
        if before is not None:
            rows = rows.where(F.col("date") < before)
        counts = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}  # one row per class
        if len(counts) < k:
            continue  # a class that never occurred: no model yet
        predictors[target] = (kind, horizon, models.fit(models.vectors(rows, ALL).select("y", "x"), k, "forest", SMALL))
        priors[target] = [counts[c] / sum(counts.values()) for c in range(k)]
    return predictors, priors


def checked_of(t):
    """The last row of every name that was ever in the index, with the reason if it cannot be scored."""
    from panelyard.plans.scores import checked

    asked = t.universe.select("ticker").union(t.index_changes.select(F.col("removed_ticker").alias("ticker")))
    return stored(checked(latest_of(t), asked, ALL), "checked")


def scores_of_models(t):
    from panelyard.plans.scores import accepted

    return models.score_latest(accepted(checked_of(t)), *_by_target(panel_of(t)))


def _by_target(panel, before=None):
    predictors, priors = fitted_targets(panel, before)
    return predictors, ALL, NAMES_OF, priors


CUT = "2001-03-15"  # the evening that the nightly job is replayed for


@query("p_nightly")
def p_nightly(t):
    """One evening replayed: nine targets fitted on earlier rows, scored, logged once, resolved by later bars; live skill by target and model."""
    from panelyard.plans import feedback

    day = F.lit(CUT).cast("date")
    features = stored(full_features(t), "features")  # for the panel and the rows to score
    t.panel = stored(build_panel(t, as_of=AS_OF, features=features), "panel")
    known = label_scales(features).where(F.col("date") <= day)
    # one row per ticker, read by every model
    latest = stored(latest_rows(known, ["close", "label_scale", "rel_label_scale", *ALL]).withColumnRenamed("close", "last_close"), "latest")
    # labels look ahead by up to twenty bars: rows of the last two months before the cut are not known that evening
    scored = models.score_latest(latest, *_by_target(panel_of(t), F.date_sub(day, 60)))
    rows = stored(feedback.log_rows(scored), "nightly-log")
    log = rows.unionByName(feedback.append_once(rows, rows))  # the job run twice adds nothing
    done = feedback.outcomes(log, t.bars, t.sector_bars, t.universe)
    return feedback.live_skill(done)


@query("p_rejects", """
WITH a AS (SELECT ticker FROM universe UNION SELECT removed_ticker FROM index_changes),
l AS (SELECT ticker, max(date) AS as_of, max_by(vol_60, date) AS scale FROM feat_price GROUP BY ticker)
SELECT a.ticker, l.as_of, CASE WHEN l.ticker IS NULL THEN 'no price history' WHEN scale IS NULL OR scale <= 0 THEN 'too little history to scale a move' END AS reason,
  l.ticker IS NOT NULL AND scale > 0 AS scored FROM a LEFT JOIN l ON l.ticker = a.ticker
""")
def p_rejects(t):
    """Every name that was ever in the index: scored, or why not."""
    return checked_of(t).select("ticker", F.col("date").alias("as_of"), F.col("reject").alias("reason"), F.col("reject").isNull().alias("scored"))


@query("p_score")
def p_score(t):
    """Last row of every ticker scored, with sector, baseline and lift."""
    from panelyard.plans.scores import with_sector

    return with_sector(scores_of_models(t), t.universe)


@query("p_payload")
def p_payload(t):
    """One nested row per ticker: scores, sentiment, divergence, analogs and track record."""
    from panelyard.catalog.feedback import log_of, resolved_of
    from panelyard.catalog.news import NOW
    from panelyard.plans import feedback, sentiment
    from panelyard.plans.analogs import find_analogs
    from panelyard.plans.payload import build_payload

    news = sentiment.availability(t.universe, sentiment.ticker_sentiment(t.articles, NOW))
    return build_payload(
        t.universe, scores_of_models(t), news, sentiment.divergence(news, sentiment.recent_moves(t.bars)),
        find_analogs(panel_of(t)), feedback.feedback_context(resolved_of(t), log_of(t)), *_gate_blocks(t))


def _gate_blocks(t):
    """Measured skill, regime record and deployability of the gate's targets."""
    from panelyard.catalog.gate import quality_of

    return quality_of(t)


@query("p_retrain")
def p_retrain(t):
    """Decide, refit through the folds when due, and record what was done."""
    panel = panel_of(t)
    decision = stored(monitoring.decide(panel, ALL, "2002-03-31", "2001-12-01", "2001-12-01"), "decision")
    first = decision.first()  # one row
    if not first.should_run:
        return decision.withColumns({"brier_skill": F.lit(None).cast("double"), "executed": F.lit("none")})
    rows, days = rows_of(t)
    oof = models.walk_forward(rows, stored(days, "folds"), list(vocab.BASELINE_SETS["simple"]), 2, "forest", SMALL)
    skill = pointwise(oof, []).select("brier_skill")
    # an incremental update is not available for these learners: it is recorded and done in full
    return beside(decision, skill).withColumn("executed", F.lit("full"))


@query("p_oos_keys", """
SELECT f.fold, r.ticker, r.date, r.y FROM thin_rows r JOIN thin_fold f ON f.date = r.date AND f.role = 'test'
""")
def p_oos_keys(t):
    """Replay the folds and attach tickers to out-of-fold rows; both sides must agree."""
    rows, days = rows_of(t)
    days = stored(days, "folds")
    saved = models.walk_forward(rows, days, ["vol_20"], 2, "forest", SMALL)
    keys = rows.select("ticker", "date", "y").join(days.where("role = 'test'"), "date").select("fold", "ticker", "date", "y")
    models.check_aligned(keys, saved)
    return keys
