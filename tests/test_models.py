"""Models and their helpers: known parameters come back, attributions equal a loop, and what does not fit is refused."""

from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelyard import vocab
from panelyard.catalog import models as queries
from panelyard.plans import models, volatility
from panelyard.plans.features import aligned


def simulated(seed: int, n: int, omega: float, alpha: float, beta: float) -> np.ndarray:
    draw, var = np.random.default_rng(seed), omega / (1 - alpha - beta)
    out = np.empty(n)
    for i in range(n):
        out[i] = np.sqrt(var) * draw.standard_normal()
        var = omega + alpha * out[i] ** 2 + beta * var
    return out


def test_garch_parameters_come_back():
    r = simulated(3, 6000, 2e-6, 0.08, 0.90)
    omega, alpha, beta, init = volatility.fit_garch(r)
    assert abs(alpha - 0.08) < 0.03 and abs(beta - 0.90) < 0.04 and 0.5e-6 < omega < 6e-6
    assert init == pytest.approx(np.mean((r - r.mean()) ** 2))
    assert np.isnan(volatility.fit_garch(np.zeros(50))[0])


def test_garch_table_leaves_short_series_out(spark):
    rows = [(0, "A", i, float(x)) for i, x in enumerate(simulated(1, 900, 2e-6, 0.1, 0.85))] + [(0, "B", i, 0.01) for i in range(5)]
    got = volatility.garch_parameters(spark.createDataFrame(rows, "fold INT, ticker STRING, day INT, ret DOUBLE")).collect()
    assert [r["ticker"] for r in got] == ["A"] and 0 <= got[0]["alpha"] <= 0.5 and got[0]["alpha"] + got[0]["beta"] < 1.2


def test_missing_features_and_other_rows_are_refused(spark):
    rows = spark.createDataFrame([("A", date(2024, 1, 2), 1.0, 2.0)], "ticker STRING, date DATE, f DOUBLE, g DOUBLE")
    assert aligned(rows, ["g", "f"]).columns == ["ticker", "date", "g", "f"]
    with pytest.raises(ValueError, match="'h'"):
        aligned(rows, ["f", "h"])
    oof = spark.createDataFrame([(0, "A", date(2024, 1, 2), 1), (0, "B", date(2024, 1, 2), 0)], "fold INT, ticker STRING, date DATE, y INT")
    models.check_aligned(oof, oof.orderBy(F.desc("ticker")))
    with pytest.raises(models.Misaligned, match="2 out-of-fold rows"):
        models.check_aligned(oof, oof.withColumn("y", F.when(F.col("ticker") == "A", 0).otherwise(F.col("y"))))
    with pytest.raises(ValueError, match="panel lacks"):
        models.fit_sets(rows.withColumn("y", F.lit(1)), None, {"s": ["f", "unknown"]}, 2)


@pytest.fixture(scope="module")
def fitted(spark):
    draw = np.random.default_rng(2)
    frame = pd.DataFrame({"ticker": [f"T{i}" for i in range(300)], "date": [date(2024, 1, 2)] * 300, "a": draw.normal(size=300), "b": draw.normal(size=300), "c": draw.normal(size=300)})
    frame["y"] = ((frame["a"] + 0.5 * frame["b"]) > 0).astype(int)
    rows = spark.createDataFrame(frame)
    return rows, models.fit(models.vectors(rows, ["a", "b", "c"]).select("y", "x"), 2, "forest", {"numTrees": 5, "maxDepth": 3})


def test_attribution_equals_a_loop(fitted):
    rows, predict = fitted
    medians, some = {"a": 0.1, "b": 0.0, "c": -0.2}, rows.limit(12)
    got = {(r["ticker"], r["place"]): (r["feature"], r["delta"], r["direction"]) for r in models.attribution(some, ["a", "b", "c"], predict, medians, top=2).collect()}

    def scores(table):
        return {r["ticker"]: r["p"][1] for r in predict(models.vectors(table, ["a", "b", "c"])).collect()}

    whole = scores(some)
    parts = {f: scores(some.withColumn(f, F.lit(m))) for f, m in medians.items()}
    for ticker, s in whole.items():
        want = sorted(((f, s - parts[f][ticker]) for f in medians), key=lambda x: (-abs(x[1]), x[0]))[:2]
        for place, (f, delta) in enumerate(want, 1):
            name, found, direction = got[ticker, place]
            assert name == f and found == pytest.approx(delta) and direction == ("increases" if delta > 0 else "decreases")


@pytest.fixture(scope="module")
def folds(spark):
    days = [(f, date(2020, 1, 1) + timedelta(days=d), "train" if d < 100 + 20 * f else "test") for f in range(2) for d in range(120 + 20 * f)]
    return spark.createDataFrame(days, "fold INT, date DATE, role STRING")


def test_calibration_falls_back_to_class_shares(spark, folds):
    draw = np.random.default_rng(5)
    rows = [(f"T{t}", date(2020, 1, 1) + timedelta(days=d), int(x + draw.normal() > 0), float(x) if t < 9 else None)
            for d in range(140) for t in range(10) for x in [draw.normal()]]
    table = spark.createDataFrame(rows, "ticker STRING, date DATE, y INT, v DOUBLE")
    out = models.calibrated(table, folds, "v", 2)
    assert out.count() == 2 * 20 * 10 and out.where("ticker = 'T9' AND p <> prior").count() == 0
    gain = out.where("ticker <> 'T9'").agg(F.avg(F.abs(F.get("p", F.lit(1)) - F.col("y"))).alias("p"), F.avg(F.abs(F.get("prior", F.lit(1)) - F.col("y"))).alias("prior")).first()
    assert gain["p"] < gain["prior"] - 0.05
    few = models.calibrated(table, folds, "v", 2, least=10_000)
    assert few.where("p <> prior").count() == 0 and few.count() == out.count()
    by_name = table.withColumn("name", F.explode(F.array(F.lit("u"), F.lit("w"))))
    both = models.calibrated(by_name.join(folds.select("fold", "date"), "date"), folds, "v", 2, group=("fold", "name"))
    one = {(r["fold"], r["ticker"], r["date"]): r["p"][1] for r in out.collect()}
    for r in both.collect():
        assert r["p"][1] == pytest.approx(one[r["fold"], r["ticker"], r["date"]], abs=1e-9)


def test_fusion_mends_overconfident_probabilities(spark, folds):
    draw = np.random.default_rng(6)
    rows = []
    for d in range(140):
        for t in range(10):
            z, mood = draw.normal(), draw.normal()
            y = int(draw.random() < 1 / (1 + np.exp(-(z + mood))))
            p = 1 / (1 + np.exp(-4 * z))
            rows.append((0, f"T{t}", date(2020, 1, 1) + timedelta(days=d), y, [float(1 - p), float(p)], [0.5, 0.5], float(mood)))
    oof = spark.createDataFrame(rows, "fold INT, ticker STRING, date DATE, y INT, p ARRAY<DOUBLE>, prior ARRAY<DOUBLE>, mood DOUBLE")
    plain = models.fusion_gain(models.fusion(oof, folds, 2)).first()
    mooded = models.fusion_gain(models.fusion(oof, folds, 2, "mood")).first()
    assert plain["gain"] > 0.02 and plain["adopt"] and mooded["meta_skill"] > plain["meta_skill"] + 0.02


@pytest.fixture
def given(monkeypatch):
    """The number of rows that each fit gets, with a fit that learns nothing."""
    counts = []

    def fit(train, k, *args):
        counts.append(train.count())
        return lambda rows: rows.withColumn("p", F.array(*[F.lit(1.0 / k)] * k))

    monkeypatch.setattr(models, "fit", fit)
    monkeypatch.setattr(queries, "FIT_ROWS", 50, raising=False)  # the bound there was
    return counts


def test_ablations_are_fitted_on_every_training_row(spark, folds, given, monkeypatch):
    days = spark.range(140).select(F.date_add(F.lit(date(2020, 1, 1)), F.col("id").cast("int")).alias("date"))
    rows = days.join(spark.range(5).select(F.concat(F.lit("T"), F.col("id").cast("string")).alias("ticker"))).withColumn("y", F.day("date") % 2)
    rows = rows.select("ticker", "date", *[F.lit(0.5).alias(c) for c in vocab.FEATURES], "y")
    monkeypatch.setattr(queries, "rows_of", lambda t: (rows, folds))
    queries.p_ablations(None)
    assert given == [500, 600] * 7


def test_targets_are_fitted_on_every_row(spark, given):
    rows = spark.range(400).select(F.concat(F.lit("T"), F.col("id").cast("string")).alias("ticker"), F.lit(date(2020, 1, 1)).alias("date"),
                                   *[F.lit(0.5).alias(c) for c in vocab.FEATURES],
                                   *[(F.col("id") % k).alias(f"label_{kind}_{h}d") for _, kind, h, k in queries.TARGETS])
    predictors, priors = queries.fitted_targets(rows)
    assert given == [400] * len(queries.TARGETS) and len(predictors) == len(priors) == len(given)
