"""Volatility benchmarks: HAR regressions and GARCH(1,1)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from panelyard import vocab
from panelyard.functions.numeric import growth, ratio
from panelyard.functions.rolling import Trailing, linear_filter
from panelyard.operators.quantiles import exact_quantiles
from panelyard.operators.single import beside

T = Trailing()
PARKINSON = 1.0 / (4.0 * math.log(2.0))
CLIP = 0.995


def variance_series(bars: DataFrame, horizons=vocab.HORIZONS) -> DataFrame:
    """Daily, weekly and monthly variance of returns and of the range, and future mean variances."""
    rows = bars.select("ticker", "date", "close", "high", "low", F.unix_date("date").alias("day")).withColumn(
        "ret", growth("close", T.lag("close")))
    ok = (F.col("high") > 0) & (F.col("low") > 0) & (F.col("high") >= F.col("low"))
    rows = rows.withColumns({
        "rv_d": F.col("ret") * F.col("ret"),
        "pk_d": F.when(ok, F.pow(F.ln(F.when(ok, F.col("high") / F.col("low"))), F.lit(2.0)) * PARKINSON)})
    wide = {f"{p}_{n}": T.rolling(F.avg, f"{p}_d", w, w) for p in ("rv", "pk") for n, w in (("w", 5), ("m", 22))}
    ahead = {f"future_{h}": T.rolling(F.avg, "rv_d", h, h, ahead=True) for h in horizons}
    sd = T.volatility("ret", vocab.VOL_LOOKBACK)
    return rows.withColumns({**wide, **ahead, "trail_var": sd * sd})


def har(series: DataFrame, rows: DataFrame, fold_days: DataFrame, horizon: int, prefix: str = "rv", least: int = 100) -> tuple[DataFrame, DataFrame]:
    """Scale-free pooled HAR per fold: (coefficients, rows with ``x`` = log forecast ratio).

    The regression needs only the sums of products of the training rows: one aggregate per fold,
    then a 4 x 4 system per fold.  ``rows``: ticker, date, y.
    """
    names = [f"{prefix}_d", f"{prefix}_w", f"{prefix}_m"]
    covered = F.col("trail_var") > 0
    x = series.select("ticker", "date", *[F.when(covered, ratio(c, "trail_var")).alias(c) for c in names],
                      F.when(covered, ratio(f"future_{horizon}", "trail_var")).alias("target_ratio"))
    marked = rows.select("ticker", "date").join(x, ["ticker", "date"], "left").join(fold_days, "date")
    whole = F.expr(" AND ".join(f"{c} IS NOT NULL" for c in names))
    train = marked.where(F.expr("role = 'train'") & whole & F.col("target_ratio").isNotNull())
    long = train.unpivot(["fold"], [*names, "target_ratio"], "name", "v")
    tops = exact_quantiles(long, ["fold", "name"], "v", [CLIP]).select("fold", "name", F.col("q")[0].alias("top"))
    caps = tops.groupBy("fold").pivot("name", [*names, "target_ratio"]).agg(F.first("top"))
    caps = caps.select("fold", *[F.col(c).alias(f"top_{c}") for c in [*names, "target_ratio"]])
    clipped = train.join(caps, "fold").select("fold", F.lit(1.0).alias("x0"), *[
        F.least(F.col(c), F.col(f"top_{c}")).alias(f"x{i + 1}") for i, c in enumerate(names)],
        F.least("target_ratio", "top_target_ratio").alias("t"))
    terms = [f"x{i}" for i in range(4)]
    sums = clipped.groupBy("fold").agg(
        F.count("*").alias("n"), F.array(*[F.sum(F.col(a) * F.col(b)) for a in terms for b in terms]).alias("xx"),
        F.array(*[F.sum(F.col(a) * F.col("t")) for a in terms]).alias("xt")).where(F.col("n") >= least)

    def solve(parts):
        for part in parts:
            out = []
            for r in part.itertuples(index=False):
                b, *_ = np.linalg.lstsq(np.asarray(r.xx, dtype=float).reshape(4, 4), np.asarray(r.xt, dtype=float), rcond=None)
                out.append((r.fold, int(r.n), *b.tolist()))
            yield pd.DataFrame(out, columns=["fold", "n", "b0", "b_d", "b_w", "b_m"])

    coefs = sums.mapInPandas(solve, "fold INT, n BIGINT, b0 DOUBLE, b_d DOUBLE, b_w DOUBLE, b_m DOUBLE")
    scored = marked.join(coefs.drop("n"), "fold").join(caps, "fold")
    rho = F.col("b0")
    for c, b in zip(names, ("b_d", "b_w", "b_m")):
        rho = rho + F.col(b) * F.least(F.when(F.col(c).isNotNull(), F.col(f"top_{c}")), F.col(c))
    rho = F.when(whole, rho)
    return coefs, scored.select("fold", "role", "ticker", "date", F.ln(F.when(rho.isNotNull(), F.greatest(rho, F.lit(1e-4)))).alias("x"))


def garch_filter(returns: DataFrame, out: str = "ahead") -> DataFrame:
    """One-step-ahead variances: out[t] = omega + alpha r[t]^2 + beta out[t-1], out[-1] = init.

    ``returns``: ticker (and further keys), day, ret, omega, alpha, beta, init.
    """
    keys = [c for c in ("fold", "ticker") if c in returns.columns]
    shock = F.col("omega") + F.col("alpha") * F.col("ret") * F.col("ret")
    return linear_filter(returns, out, shock, F.col("beta"), F.col("init"), Trailing(keys))


def horizon_variance(ahead, omega, alpha, beta, h: int):
    """Mean variance over the next h days from the one-step forecast (mean-reverting)."""
    p = alpha + beta
    long_run = omega / F.greatest(1 - p, F.lit(1e-9))
    weight = sum((F.pow(p, F.lit(i)) for i in range(1, h)), F.lit(1.0)) / h
    return long_run + (ahead - long_run) * weight


def _loss(r: np.ndarray, var: float, cand: np.ndarray) -> np.ndarray:
    """Gaussian GARCH loss of many parameter sets at once: one sweep over time."""
    omega, alpha, beta = cand.T
    s = np.full(len(cand), var)
    total = np.zeros(len(cand))
    for x in r * r:
        total += np.log(s) + x / s
        s = omega + alpha * x + beta * s
    return np.where((alpha + beta < 0.999) & np.isfinite(total), total, np.inf)


def fit_garch(r: np.ndarray) -> tuple[float, float, float, float]:
    """(omega, alpha, beta, init) by repeated refinement of a parameter grid."""
    r = r - r.mean()
    var = float(np.mean(r * r))
    if not np.isfinite(var) or var <= 0:
        return float("nan"), float("nan"), float("nan"), var
    centre, width = np.array([1.0, 0.10, 0.80]), np.array([0.9, 0.10, 0.20])
    best = None
    for _ in range(6):
        axes = [np.linspace(c - w, c + w, 7) for c, w in zip(centre, width)]
        m, a, b = (g.ravel() for g in np.meshgrid(*axes))
        a, b, m = np.clip(a, 0, 0.5), np.clip(b, 0, 0.998), np.clip(m, 1e-3, 10)
        omega = np.maximum(var * (1 - a - b) * m, var * 1e-6)
        cand = np.column_stack([omega, a, b])
        loss = _loss(r, var, cand)
        i = int(np.argmin(loss))
        best = cand[i]
        centre, width = np.array([m[i], a[i], b[i]]), width * 0.5
    return float(best[0]), float(best[1]), float(best[2]), var


def garch_parameters(returns: DataFrame, least: int = vocab.MIN_GARCH_ROWS) -> DataFrame:
    """Fit per (fold, ticker) on training returns; short series are left out.

    A group is one daily series (bounded by the calendar), so the grouped map is safe to run whole.
    """
    def one(part: pd.DataFrame) -> pd.DataFrame:
        r = part.sort_values("day")["ret"].to_numpy(dtype=float)
        r = r[np.isfinite(r)]
        if len(r) < least:
            return pd.DataFrame(columns=["fold", "ticker", "omega", "alpha", "beta", "init", "mean"])
        omega, alpha, beta, init = fit_garch(r)
        if not np.isfinite(omega):
            return pd.DataFrame(columns=["fold", "ticker", "omega", "alpha", "beta", "init", "mean"])
        return pd.DataFrame([[part["fold"].iloc[0], part["ticker"].iloc[0], omega, alpha, beta, init, float(r.mean())]],
                            columns=["fold", "ticker", "omega", "alpha", "beta", "init", "mean"])

    return returns.where("ret IS NOT NULL").groupBy("fold", "ticker").applyInPandas(
        one, "fold INT, ticker STRING, omega DOUBLE, alpha DOUBLE, beta DOUBLE, init DOUBLE, mean DOUBLE")


def garch_forecast(series: DataFrame, fold_days: DataFrame, horizon: int) -> tuple[DataFrame, DataFrame]:
    """Per fold: parameters from training days, and ``x`` = log ratio of forecast to trailing variance."""
    cut = fold_days.where("role = 'train'").groupBy("fold").agg(F.max("date").alias("last_train"))
    # every fold sees every series once: folds are few and the table is one row per bar
    per = beside(series.select("ticker", "date", "day", "ret", "trail_var"), cut)
    fits = garch_parameters(per.where(F.col("date") <= F.col("last_train")).select("fold", "ticker", "day", "ret"))
    rows = per.join(fits, ["fold", "ticker"]).withColumn("ret", F.coalesce(F.col("ret") - F.col("mean"), F.lit(0.0)))
    ahead = garch_filter(rows)
    v = horizon_variance(F.col("ahead"), F.col("omega"), F.col("alpha"), F.col("beta"), horizon)
    x = F.when(F.col("trail_var") > 0, F.ln(F.greatest(ratio(v, "trail_var"), F.lit(1e-4))))
    return fits, ahead.select("fold", "ticker", "date", x.alias("x"))
