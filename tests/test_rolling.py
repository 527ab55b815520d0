"""Window operators against pandas, and the rule that no value looks ahead."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelyard import vocab
from panelyard.functions.rolling import Trailing, decay_of, linear_filter, moving_extremes, smooth
from panelyard.plans.features import build_features, check_no_leak
from panelyard.plans.labels import add_labels


def walk(n, seed, start=100.0):
    r = np.random.default_rng(seed)
    return start * np.exp(np.cumsum(r.normal(0.0003, 0.015, n)))


@pytest.fixture(scope="module")
def series(spark):
    out = []
    for i, name in enumerate(("A", "B")):
        close = walk(3500, i)
        out.append(pd.DataFrame({"ticker": name, "day": np.arange(3500), "x": close}))
    return pd.concat(out)


def per_ticker(pdf, fn):
    return pd.concat([fn(g["x"]).rename("want") for _, g in pdf.groupby("ticker")])


def test_smooth_equals_pandas_over_block_borders(spark, series):
    got = smooth(spark.createDataFrame(series), {"y": ("x", decay_of(span=9), 1), "z": ("x", 1 / 14, 14)}, Trailing())
    got = got.orderBy("ticker", "day").toPandas()
    want = per_ticker(series, lambda s: s.ewm(span=9, adjust=False).mean())
    np.testing.assert_allclose(got["y"], want, rtol=1e-11)
    want = per_ticker(series, lambda s: s.ewm(alpha=1 / 14, adjust=False, min_periods=14).mean())
    np.testing.assert_allclose(got["z"].astype(float), want, rtol=1e-11)


@pytest.mark.parametrize("decay", [0.0, 0.2, 0.5, 0.9, 0.985])
def test_linear_filter_equals_the_loop(spark, series, decay):
    pdf = series[series.day < 1300].assign(q=decay, y0=2.0)
    got = linear_filter(spark.createDataFrame(pdf), "y", "x", "q", "y0", Trailing()).orderBy("ticker", "day").toPandas()
    for _, g in got.groupby("ticker"):
        y, want = 2.0, []
        for x in g["x"]:
            y = x + decay * y
            want.append(y)
        np.testing.assert_allclose(g["y"], want, rtol=1e-10)


def test_moving_extremes_equal_pandas(spark, series):
    got = moving_extremes(spark.createDataFrame(series), {"hi": (F.max, "x"), "lo": (F.min, "x")}, 252, 60, Trailing())
    got = got.orderBy("ticker", "day").toPandas()
    np.testing.assert_array_equal(got["hi"].astype(float), per_ticker(series, lambda s: s.rolling(252, min_periods=60).max()))
    np.testing.assert_array_equal(got["lo"].astype(float), per_ticker(series, lambda s: s.rolling(252, min_periods=60).min()))


def bars_of(n):
    days = pd.bdate_range("2015-01-01", periods=320)[:n]
    close = walk(320, 0)[:n]
    return pd.DataFrame({"ticker": "T", "date": days.date, "open": close, "high": close * 1.01, "low": close * 0.99,
                         "close": close, "volume": np.linspace(1e6, 2e6, 320)[:n]})


def test_features_do_not_change_when_the_future_is_cut_off(spark):
    bench = pd.DataFrame({"date": pd.bdate_range("2015-01-01", periods=320).date, "close": walk(320, 1, 400.0)})
    events = spark.createDataFrame(pd.DataFrame({
        "ticker": "T", "event_date": pd.to_datetime(["2015-02-03", "2015-06-01", "2016-02-20"]).date,
        "event_type": ["EARNINGS_RESULT", "DIVIDEND_CUT", "EARNINGS_RESULT"]}))
    made = []
    for n in (320, 280):
        rows = build_features(spark.createDataFrame(bars_of(n)), benchmark=spark.createDataFrame(bench), events=events)
        made.append(rows.select("date", *vocab.FEATURES).orderBy("date").limit(280).toPandas())
    for c in vocab.FEATURES:
        np.testing.assert_allclose(made[0][c].astype(float), made[1][c].astype(float), rtol=1e-9, err_msg=c)
    days = made[0]["days_since_earnings_result"]
    assert days.iloc[0] == vocab.NEVER and (days >= 0).all()
    assert made[0]["days_since_executive_change"].eq(vocab.NEVER).all()


def test_labels_are_open_at_the_end_and_null_without_a_sector(spark):
    rows = add_labels(build_features(spark.createDataFrame(bars_of(120)))).orderBy("date").toPandas()
    assert rows["label_direction_5d"].tail(5).isna().all()
    assert rows["label_direction_5d"].iloc[60:-5].notna().all()
    assert rows["label_rel_direction_5d"].isna().all()
    want = rows["close"].shift(-5) / rows["close"] - 1
    np.testing.assert_allclose(rows["forward_return_5d"].astype(float), want)


def test_forward_names_are_refused():
    with pytest.raises(ValueError):
        check_no_leak(["ret_5", "forward_return_1d"])
