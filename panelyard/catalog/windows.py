"""Trailing-window operators: features, labels and volatility series."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelyard import vocab
from panelyard.catalog.base import big, query, s6, step
from panelyard.functions.numeric import settle
from panelyard.plans.features import build_features
from panelyard.plans.labels import add_labels

# ---------------------------------------------------------------- SQL steps for the checks

step("px_ctx", """
SELECT b.*, x.close AS bench_seen, m.vix AS vix_seen, m.curve_slope AS slope_seen, s.close AS sector_seen,
       row_number() OVER (PARTITION BY b.ticker ORDER BY b.date) AS rn
FROM bars b LEFT JOIN benchmark_bars x ON x.date = b.date LEFT JOIN macro m ON m.date = b.date
LEFT JOIN universe u ON u.ticker = b.ticker LEFT JOIN sector_bars s ON s.sector_etf = u.sector_etf AND s.date = b.date
""")
step("px_fill", """
SELECT *, last_value(bench_seen IGNORE NULLS) OVER w AS bench, last_value(vix_seen IGNORE NULLS) OVER w AS vix,
       last_value(slope_seen IGNORE NULLS) OVER w AS curve_slope, last_value(sector_seen IGNORE NULLS) OVER w AS sector
FROM px_ctx WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
""")


def _growth(c, n):
    return f"{c} / lag({c}, {n}) OVER w - 1"


step("px_ret", f"""
SELECT *, {_growth('close', 1)} AS ret, {_growth('bench', 1)} AS bench_ret, {_growth('sector', 1)} AS sector_ret,
       lag(close) OVER w AS prev, ln(1 + volume) AS lv,
       {', '.join(f"{_growth('close', n)} AS ret_{n}" for n in (5, 20, 60, 252))},
       {', '.join(f"{_growth(c, n)} AS {c}_ret_{n}" for c in ('bench', 'sector') for n in (5, 20, 60))},
       vix - lag(vix, 20) OVER w AS vix_chg_20, curve_slope - lag(curve_slope, 60) OVER w AS curve_slope_chg_60
FROM px_fill WINDOW w AS (PARTITION BY ticker ORDER BY date)
""")


def _roll(agg, c, n, mp, out, args=None):
    w = f"OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({c}) {w} >= {mp} THEN {agg}({args or c}) {w} END AS {out}"


step("px_roll", f"""
SELECT *, {_roll('stddev_samp', 'ret', 20, 10, 'vol_20')}, {_roll('stddev_samp', 'ret', 60, 30, 'vol_60')},
       {_roll('stddev_samp', 'sector_ret', 20, 10, 'sector_vol_20')},
       {_roll('avg', 'lv', 60, 30, 'lv_mean')}, {_roll('stddev_samp', 'lv', 60, 30, 'lv_sd')},
       {_roll('avg', 'close', 20, 10, 'sma_20')}, {_roll('stddev_samp', 'close', 20, 10, 'sd_20')},
       {_roll('max', 'close', 252, 60, 'high_252')}, {_roll('min', 'close', 252, 60, 'low_252')},
       {_roll('covar_samp', 'ret * bench_ret', 60, 30, 'cov_60', 'ret, bench_ret')},
       {_roll('var_samp', 'bench_ret', 60, 30, 'bench_var')}
FROM px_ret
""")
step("px_in", """
SELECT ticker, rn, close, greatest(high - low, abs(high - prev), abs(low - prev)) AS tr,
       CASE WHEN prev IS NOT NULL THEN greatest(close - prev, 0) END AS gain,
       CASE WHEN prev IS NOT NULL THEN greatest(prev - close, 0) END AS loss FROM px_ret
""")
A14, F12, S26, S9 = "(CAST(1 AS DOUBLE) / 14)", "(CAST(2 AS DOUBLE) / 13)", "(CAST(2 AS DOUBLE) / 27)", "(CAST(2 AS DOUBLE) / 10)"
step("px_ewm", f"""
SELECT ticker, rn, tr AS atr, gain AS ag, loss AS al, close AS ef, close AS es, CAST(0 AS DOUBLE) AS sig
FROM px_in WHERE rn = 1
UNION ALL
SELECT p.ticker, p.rn, e.atr * (1 - {A14}) + p.tr * {A14},
       CASE WHEN e.ag IS NULL THEN p.gain ELSE e.ag * (1 - {A14}) + p.gain * {A14} END,
       CASE WHEN e.al IS NULL THEN p.loss ELSE e.al * (1 - {A14}) + p.loss * {A14} END,
       e.ef * (1 - {F12}) + p.close * {F12}, e.es * (1 - {S26}) + p.close * {S26},
       e.sig * (1 - {S9}) + {S9} * ((e.ef * (1 - {F12}) + p.close * {F12}) - (e.es * (1 - {S26}) + p.close * {S26}))
FROM px_ewm e JOIN px_in p ON p.ticker = e.ticker AND p.rn = e.rn + 1
""")
step("feat_price", f"""
SELECT r.ticker, r.date, r.rn, r.close, r.ret, r.sector, r.sector_seen, r.sector_ret,
       ret_5, ret_20, ret_60, ret_252, vol_20, vol_60, vol_20 / (vol_60 + 1e-12) AS vol_ratio_20_60,
       CASE WHEN r.rn >= 14 THEN atr END / (r.close + 1e-12) AS atr_14_pct,
       (lv - lv_mean) / (lv_sd + 1e-12) AS volume_z_60,
       CASE WHEN r.rn >= 15 THEN 100 - 100 / (1 + ag / (al + 1e-12)) END AS rsi_14,
       ((ef - es) - sig) / (r.close + 1e-12) AS macd_hist_pct,
       (r.close - sma_20) / (2 * sd_20 + 1e-12) AS bb_position,
       r.close / (high_252 + 1e-12) - 1 AS drawdown_from_252h, r.close / (low_252 + 1e-12) - 1 AS runup_from_252l,
       cov_60 / (bench_var + 1e-12) AS beta_60,
       {', '.join(f"ret_{n} - cov_60 / (bench_var + 1e-12) * bench_ret_{n} AS excess_ret_{n}" for n in (5, 20, 60))},
       {', '.join(f"ret_{n} - sector_ret_{n} AS sector_rel_ret_{n}" for n in (5, 20, 60))},
       sector_vol_20, vol_20 / (sector_vol_20 + 1e-12) AS vol_vs_sector, vix, vix_chg_20, curve_slope, curve_slope_chg_60,
       CASE WHEN r.date BETWEEN DATE '1990-07-01' AND DATE '1991-03-31' OR r.date BETWEEN DATE '2001-03-01' AND DATE '2001-11-30'
              OR r.date BETWEEN DATE '2007-12-01' AND DATE '2009-06-30' OR r.date BETWEEN DATE '2020-02-01' AND DATE '2020-04-30'
            THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS recession
FROM px_roll r JOIN px_ewm e ON e.ticker = r.ticker AND e.rn = r.rn
""")


def _lab(h):
    w = "OVER (PARTITION BY ticker ORDER BY date)"
    fr = f"(lead(close, {h}) {w} / close - 1)"
    rel = f"(lead(close, {h}) {w} / close - lead(sector, {h}) {w} / sector)"
    return f"{fr} AS fr_{h}, CASE WHEN n_sector >= 60 THEN {rel} END AS rfr_{h}"


step("lab_base", f"""
SELECT *, {_roll('stddev_samp', 'ret', 60, 30, 'scale')}, {_roll('stddev_samp', '(ret - sector_ret)', 60, 30, 'rscale')},
       count(sector_seen) OVER (PARTITION BY ticker) AS n_sector
FROM px_ret
""")
step("lab_move", f"SELECT *, {', '.join(_lab(h) for h in (1, 5, 20))} FROM lab_base")
step("lab_z", "SELECT *, " + ", ".join(
    f"fr_{h} / (scale * sqrt({h}) + 1e-12) AS z_{h}, rfr_{h} / (rscale * sqrt({h}) + 1e-12) AS rz_{h}"
    for h in (1, 5, 20)) + " FROM lab_move")


def _three(z):
    return f"CASE WHEN {z} >= 1 THEN 2 WHEN {z} <= -1 THEN 0 WHEN {z} IS NOT NULL THEN 1 END"


def _label_sql(h, f=lambda e: e):
    return (f"{f(f'fr_{h}')} AS forward_return_{h}d, {f(f'z_{h}')} AS forward_z_{h}d, {_three(f'z_{h}')} AS label_direction_{h}d, "
            f"CASE WHEN z_{h} IS NOT NULL THEN CASE WHEN abs(z_{h}) >= 1 THEN 1 ELSE 0 END END AS label_magnitude_{h}d")


def _rel_sql(h, f=lambda e: e):
    return (f"{f(f'rfr_{h}')} AS rel_forward_return_{h}d, {f(f'rz_{h}')} AS rel_forward_z_{h}d, "
            f"{_three(f'rz_{h}')} AS label_rel_direction_{h}d")


step("lab", "SELECT ticker, date, " + ", ".join(f"{_label_sql(h)}, {_rel_sql(h)}" for h in (1, 5, 20)) + " FROM lab_z")


# ---------------------------------------------------------------- queries


def features_of(t):
    t.keep_bars()
    return build_features(t.bars, benchmark=t.benchmark_bars, macro=t.macro, universe=t.universe,
                          sector_bars=t.sector_bars)


def _feature_query(name, columns, doc):
    cols = ", ".join(f"{s6(c)} AS {c}" for c in columns)

    @query(name, f"SELECT ticker, date, {cols} FROM feat_price")
    def build(t):
        return features_of(t).select("ticker", "date", *[settle(c).alias(c) for c in columns])

    build.__doc__ = doc


_feature_query("w_ret", ["ret_5", "ret_20", "ret_60", "ret_252"], "Trailing returns.")
_feature_query("w_vol", ["vol_20", "vol_60"], "Trailing volatility.")
_feature_query("w_volratio", ["vol_ratio_20_60"], "Short over long volatility.")
_feature_query("w_atr", ["atr_14_pct"], "Average true range as a share of price.")
_feature_query("w_rsi", ["rsi_14"], "Relative strength index.")
_feature_query("w_macd", ["macd_hist_pct"], "MACD histogram as a share of price.")
_feature_query("w_volz", ["volume_z_60"], "Volume z-score.")
_feature_query("w_bb", ["bb_position"], "Position in the band around the 20-row mean.")
_feature_query("w_dd", ["drawdown_from_252h", "runup_from_252l"], "Distance to the yearly high and low.")
_feature_query("w_beta", ["beta_60"], "Rolling beta.")
_feature_query("w_excess", ["excess_ret_5", "excess_ret_20", "excess_ret_60"], "Beta-adjusted returns.")
_feature_query("w_sector", list(vocab.SECTOR_FEATURES), "Sector-relative features.")
_feature_query("w_macrochg", ["vix_chg_20", "curve_slope_chg_60"], "Macro changes in ticker rows.")


@query("w_ewm", f"SELECT r.ticker, r.date, {s6('ef')} AS ema_12, {s6('es')} AS ema_26 "
                "FROM px_ret r JOIN px_ewm e ON e.ticker = r.ticker AND e.rn = r.rn")
def w_ewm(t):
    """Exponentially weighted means of the close."""
    from panelyard.functions.calendar import day_number
    from panelyard.functions.rolling import Trailing, decay_of, smooth

    rows = t.bars.select("ticker", "date", "close", day_number("date").alias("day"))
    out = smooth(rows, {"ema_12": ("close", decay_of(span=12), 1), "ema_26": ("close", decay_of(span=26), 1)}, Trailing())
    return out.select("ticker", "date", settle("ema_12").alias("ema_12"), settle("ema_26").alias("ema_26"))


def labelled(t):
    return add_labels(features_of(t))


@query("w_label", "SELECT ticker, date, " + ", ".join(_label_sql(h, s6) for h in (1, 5, 20)) + " FROM lab_z")
def w_label(t):
    """Forward return, its z-score and both class labels for three horizons."""
    cols = []
    for h in vocab.HORIZONS:
        cols += [settle(f"forward_return_{h}d").alias(f"forward_return_{h}d"), settle(f"forward_z_{h}d").alias(f"forward_z_{h}d"),
                 F.col(f"label_direction_{h}d"), F.col(f"label_magnitude_{h}d")]
    return labelled(t).select("ticker", "date", *cols)


@query("w_rel_label", "SELECT ticker, date, " + ", ".join(_rel_sql(h, s6) for h in (1, 5, 20)) + " FROM lab_z")
def w_rel_label(t):
    """Labels of the move relative to the sector."""
    cols = []
    for h in vocab.HORIZONS:
        cols += [settle(f"rel_forward_return_{h}d").alias(f"rel_forward_return_{h}d"),
                 settle(f"rel_forward_z_{h}d").alias(f"rel_forward_z_{h}d"), F.col(f"label_rel_direction_{h}d")]
    return labelled(t).select("ticker", "date", *cols)


@query("target_balance", f"""
WITH long AS (
  SELECT extract(year FROM date) AS year, 'magnitude_5d' AS target, label_magnitude_5d AS y FROM lab WHERE label_magnitude_5d IS NOT NULL
  UNION ALL SELECT extract(year FROM date), 'direction_5d', label_direction_5d FROM lab WHERE label_direction_5d IS NOT NULL),
sh AS (SELECT target, CAST(year AS INTEGER) AS year, y, count(*) AS n FROM long GROUP BY ALL),
tot AS (SELECT target, year, sum(n) AS total, sum(n * n) AS sq FROM sh GROUP BY ALL)
SELECT s.target, s.year, s.y, {big('s.n')} AS n, {s6('CAST(s.n AS DOUBLE) / t.total')} AS share,
       {s6('1 - CAST(t.sq AS DOUBLE) / (CAST(t.total AS DOUBLE) * t.total)')} AS base_rate_brier
FROM sh s JOIN tot t ON t.target = s.target AND t.year = s.year
""")
def target_balance(t):
    """Class balance and base-rate Brier score per target and year."""
    long = labelled(t).select(F.year("date").alias("year"), F.col("label_magnitude_5d").alias("magnitude_5d"),
                              F.col("label_direction_5d").alias("direction_5d")).unpivot(
        ["year"], ["magnitude_5d", "direction_5d"], "target", "y").where("y IS NOT NULL")
    counts = long.groupBy("target", "year", "y").agg(F.count("*").alias("n"))
    total = counts.groupBy("target", "year").agg(
        F.sum("n").alias("total"), F.sum(F.col("n") * F.col("n")).cast("double").alias("squares"))
    return counts.join(total, ["target", "year"]).select(
        "target", "year", "y", "n", settle(F.col("n") / F.col("total")).alias("share"),
        settle(1 - F.col("squares") / (F.col("total").cast("double") * F.col("total"))).alias("base_rate_brier"))
