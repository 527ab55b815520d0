"""The causal feature set: one timeline, one exchange by ticker, trailing windows only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from panelyard import vocab
from panelyard.functions.numeric import finite, growth, ratio
from panelyard.functions.regimes import recession
from panelyard.functions.rolling import Trailing, decay_of, moving_extremes, smooth
from panelyard.operators.asof import timeline
from panelyard.plans.events import events_by_day
from panelyard.plans.fundamentals import fundamentals_by_day

EPS = vocab.EPS
T = Trailing()


def with_context(bars: DataFrame, benchmark: DataFrame | None = None, macro: DataFrame | None = None,
                 universe: DataFrame | None = None, sector_bars: DataFrame | None = None) -> DataFrame:
    """Same-day benchmark, macro and sector values beside each bar (NULL where there is none)."""
    none = F.lit(None).cast("double")
    out = bars
    if benchmark is not None:
        out = out.join(benchmark.select("date", F.col("close").alias("bench")), "date", "left")
    else:
        out = out.withColumn("bench", none)
    if macro is not None:
        out = out.join(macro.select("date", "vix", "curve_slope"), "date", "left")
    else:
        out = out.withColumns({"vix": none, "curve_slope": none})
    if universe is not None and sector_bars is not None:
        out = out.join(universe.select("ticker", "sector_etf"), "ticker", "left").join(
            sector_bars.select("sector_etf", "date", F.col("close").alias("sector")), ["sector_etf", "date"], "left")
        return out.drop("sector_etf")
    return out.withColumn("sector", none)


def event_columns(line: DataFrame) -> DataFrame:
    """Days since the last event per type, and event counts over calendar windows."""
    marks = [f"last_{t.lower()}" for t in vocab.TRACKED_EVENTS] + ["last_any_event"]
    since = {
        m.replace("last_", "days_since_"): F.coalesce(
            (F.col("day") - F.max(m).over(T.so_far())).cast("double"), F.lit(vocab.NEVER)) for m in marks}
    counts = {
        "event_density_90d": F.coalesce(F.sum("n_events").over(T.days(-89)), F.lit(0)).cast("double"),
        "dividend_cuts_365d": F.coalesce(F.sum("n_cuts").over(T.days(-364)), F.lit(0)).cast("double"),
    }
    return line.withColumns({**since, **counts})


def build_features(bars: DataFrame, *, benchmark: DataFrame | None = None, macro: DataFrame | None = None,
                   events: DataFrame | None = None, universe: DataFrame | None = None,
                   sector_bars: DataFrame | None = None, ratios: DataFrame | None = None) -> DataFrame:
    """All features for every (ticker, date) bar; the bar columns are kept for labelling.

    ``bars`` must hold one row per ticker and date.  Optional inputs degrade to NULL (or, for
    events, to "never" and 0).
    """
    spark = bars.sparkSession
    if events is None:
        events = spark.createDataFrame([], "ticker STRING, event_date DATE, event_type STRING")
    rights = [(events_by_day(events), "event_date")]
    none = F.lit(None).cast("double")
    base = with_context(bars, benchmark, macro, universe, sector_bars).withColumn("sector_seen", F.col("sector"))
    if ratios is not None:
        rights.append((fundamentals_by_day(ratios), "filed"))
    # few bytes but much work per row: keep the full number of partitions instead of letting
    # the runtime merge them by size
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    line = timeline(base, rights).repartition(width, "ticker")
    if ratios is None:
        line = line.withColumns({c: none for c in vocab.FUNDAMENTALS})
    carried = ["bench", "sector", "vix", "curve_slope", *vocab.FUNDAMENTALS]
    line = event_columns(line).withColumns({c: T.filled(c) for c in carried})
    return price_features(line.where("is_row").drop("is_row"))


def price_features(rows: DataFrame) -> DataFrame:
    close = F.col("close")
    rows = rows.withColumns({
        "ret": growth(close, T.lag("close")),
        "bench_ret": growth("bench", T.lag("bench")),
        "sector_ret": growth("sector", T.lag("sector")),
        "prev_close": T.lag("close"),
        "log_volume": F.log1p(F.greatest(F.col("volume"), F.lit(0.0))),
        **{f"ret_{n}": growth(close, T.lag("close", n)) for n in (5, 20, 60, 252)},
        **{f"bench_ret_{n}": growth("bench", T.lag("bench", n)) for n in (5, 20, 60)},
        **{f"sector_ret_{n}": growth("sector", T.lag("sector", n)) for n in (5, 20, 60)},
        "vix_chg_20": F.col("vix") - T.lag("vix", 20),
        "curve_slope_chg_60": F.col("curve_slope") - T.lag("curve_slope", 60),
    })
    rows = rows.withColumns({
        "true_range": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("prev_close")),
                                 F.abs(F.col("low") - F.col("prev_close"))),
        "gain": F.when(F.col("prev_close").isNotNull(), F.greatest(close - F.col("prev_close"), F.lit(0.0))),
        "loss": F.when(F.col("prev_close").isNotNull(), F.greatest(F.col("prev_close") - close, F.lit(0.0))),
        "vol_20": T.volatility("ret", 20), "vol_60": T.volatility("ret", 60),
        "sector_vol_20": T.volatility("sector_ret", 20),
        "volume_mean": T.rolling(F.avg, "log_volume", 60, 30), "volume_sd": T.rolling(F.stddev_samp, "log_volume", 60, 30),
        "sma_20": T.rolling(F.avg, "close", 20, 10, gaps=False), "sd_20": T.rolling(F.stddev_samp, "close", 20, 10, gaps=False),
        "cov_60": T.rolling_pair(F.covar_samp, "ret", "bench_ret", 60, 30, gaps=False),
        "bench_var_60": T.rolling(F.var_samp, "bench_ret", 60, 30, gaps=False),
    })
    rows = moving_extremes(rows, {"high_252": (F.max, "close"), "low_252": (F.min, "close")}, 252, 60, T)
    fourteen = 1.0 / 14.0
    rows = smooth(rows, {
        "atr": ("true_range", fourteen, 14), "avg_gain": ("gain", fourteen, 14), "avg_loss": ("loss", fourteen, 14),
        "ema_fast": ("close", decay_of(span=12), 1), "ema_slow": ("close", decay_of(span=26), 1),
    }, T)
    rows = rows.withColumn("macd", F.col("ema_fast") - F.col("ema_slow"))
    rows = smooth(rows, {"macd_signal": ("macd", decay_of(span=9), 1)}, T)
    beta = F.col("cov_60") / (F.col("bench_var_60") + EPS)
    derived = {
        "vol_ratio_20_60": F.col("vol_20") / (F.col("vol_60") + EPS),
        "atr_14_pct": F.col("atr") / (close + EPS),
        "volume_z_60": (F.col("log_volume") - F.col("volume_mean")) / (F.col("volume_sd") + EPS),
        "rsi_14": 100.0 - 100.0 / (1.0 + F.col("avg_gain") / (F.col("avg_loss") + EPS)),
        "macd_hist_pct": (F.col("macd") - F.col("macd_signal")) / (close + EPS),
        "bb_position": (close - F.col("sma_20")) / (2.0 * F.col("sd_20") + EPS),
        "drawdown_from_252h": close / (F.col("high_252") + EPS) - 1.0,
        "runup_from_252l": close / (F.col("low_252") + EPS) - 1.0,
        "beta_60": beta,
        **{f"excess_ret_{n}": F.col(f"ret_{n}") - beta * F.col(f"bench_ret_{n}") for n in (5, 20, 60)},
        **{f"sector_rel_ret_{n}": F.col(f"ret_{n}") - F.col(f"sector_ret_{n}") for n in (5, 20, 60)},
        "vol_vs_sector": F.col("vol_20") / (F.col("sector_vol_20") + EPS),
        "recession": recession("date"),
    }
    rows = rows.withColumns(derived)
    bar = [c for c in ("ticker", "date", "day", "open", "high", "low", "close", "volume", "ret", "sector",
                       "sector_seen", "sector_ret") if c in rows.columns]
    return rows.select(*bar, *[finite(c).alias(c) for c in vocab.FEATURES])


def check_no_leak(names) -> None:
    """Refuse forward-looking names among features."""
    leaked = [n for n in names if n.startswith(vocab.LABEL_PREFIXES) or "forward" in n]
    if leaked:
        raise ValueError(f"forward-looking columns among the features: {leaked}")


def aligned(rows: DataFrame, names, keep=("ticker", "date")) -> DataFrame:
    """Select features in training order; extra columns go, missing ones are an error."""
    missing = sorted(set(names) - set(rows.columns))
    if missing:
        raise ValueError(f"features missing for this model: {missing[:10]}")
    return rows.select(*keep, *[finite(n).cast("float").alias(n) for n in names])
