"""Walk-forward training of several targets on a panel with a planted signal."""

from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelyard.operators import boosting
from panelyard.operators.boosting import Boosting
from panelyard.operators.evaluation import pointwise
from panelyard.operators.folds import FoldSpec
from panelyard.plans import training

TARGETS = [("magnitude_1d", "magnitude", 1, 2), ("direction_1d", "direction", 1, 3)]
FEATURES = ["a", "b", "noise"]
SPEC = FoldSpec(n_splits=3, test_size=20, purge=2, embargo=3)
TREES = Boosting(rounds=60, depth=2, bins=16, patience=5)


@pytest.fixture(scope="module")
def panel(spark):
    draw = np.random.default_rng(4)
    n = 150 * 20
    a, b = draw.normal(size=n), draw.normal(size=n)
    frame = pd.DataFrame({
        "ticker": [f"T{i % 20}" for i in range(n)], "date": [date(2020, 1, 1) + timedelta(days=i // 20) for i in range(n)],
        "a": np.where(draw.random(n) < 0.1, np.nan, a), "b": b, "noise": draw.normal(size=n),
        "label_magnitude_1d": (np.abs(a) > 1).astype(float), "label_direction_1d": np.digitize(b + 0.3 * draw.normal(size=n), [-0.5, 0.5]).astype(float)})
    frame.loc[draw.random(n) < 0.05, "label_direction_1d"] = np.nan
    rows = spark.createDataFrame(frame)
    return rows.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("a", "label_magnitude_1d", "label_direction_1d")}).withColumn("date", F.col("date").cast("date"))


@pytest.fixture(scope="module")
def study(panel):
    return training.walk_forward_all(panel, TARGETS, FEATURES, SPEC, TREES)


def test_signal_is_learned_and_rounds_stop(study):
    skill = {r["target"]: r["brier_skill"] for r in pointwise(study.oof, ["target"]).collect()}
    assert skill["magnitude_1d"] > 0.6 and skill["direction_1d"] > 0.4
    fits = study.models.collect()
    assert len(fits) == 6 and any(r["rounds_run"] < TREES.rounds for r in fits)
    for r in fits:
        trees = r["best_round"] * (1 if r["k"] == 2 else 3)
        assert len(r["feature"]) == trees * 3 and len(r["leaf"]) == trees * 4 and r["held_out"] > 0
        assert np.argmax(r["gain"]) == (0 if r["target"] == "magnitude_1d" else 1)


def test_test_rows_are_whole_and_train_rows_are_purged(panel, study):
    dates = sorted({r["date"] for r in panel.select("date").distinct().collect()})
    for name, kind, horizon, _ in TARGETS:
        got = {(r["fold"], r["ticker"], r["date"]) for r in study.of(name).collect()}
        rows = panel.where(F.col(f"label_{kind}_1d").isNotNull()).select("ticker", "date").collect()
        want = {(f, r["ticker"], r["date"]) for f in range(3) for r in rows if r["date"] in dates[len(dates) - 60 + 20 * f:][:20]}
        assert got == want
    spans = study.marked.groupBy("target", "fold").agg(F.max(F.when(F.col("part") == "fit", F.col("date"))).alias("fit"), F.min(F.when(F.col("part") == "valid", F.col("date"))).alias("held"),
                                                       F.max(F.when(F.col("role") == "train", F.col("date"))).alias("train"), F.min(F.when(F.col("role") == "test", F.col("date"))).alias("test"))
    for r in spans.collect():
        assert r["fit"] < r["held"] <= r["train"] < r["test"] - timedelta(days=SPEC.purge)


def test_runs_agree_whatever_the_order_of_rows(panel, study):
    again = training.walk_forward_all(panel.repartition(7), TARGETS, FEATURES, SPEC, TREES)
    order = ["target", "fold", "ticker", "date"]
    one, two = (s.oof.select(*order, "p", "prior").orderBy(*order).collect() for s in (study, again))
    assert one == two


def test_final_models_take_the_median_of_best_rounds(panel, study):
    final = {r["target"]: r for r in training.final_models(panel, study, TARGETS).collect()}
    for name, *_ in TARGETS:
        rounds = sorted(r["best_round"] for r in study.models.collect() if r["target"] == name)
        assert final[name]["best_round"] == final[name]["rounds_run"] == rounds[1] and final[name]["held_out"] == 0


def test_fit_rows_bounds_a_fit_only(panel, study):
    small = training.walk_forward_all(panel, TARGETS, FEATURES, SPEC, TREES, fit_rows=300)
    assert all(r["rows"] + r["held_out"] < 450 for r in small.models.collect())
    assert small.oof.count() == study.oof.count()
    assert small.oof.select("target", "fold", "prior").distinct().orderBy("target", "fold").collect() == \
        study.oof.select("target", "fold", "prior").distinct().orderBy("target", "fold").collect()
    with pytest.raises(ValueError):
        training.walk_forward_all(panel, TARGETS, FEATURES, SPEC, TREES, fit_rows=0)


def test_trees_split_like_a_search_over_all_cuts():
    draw = np.random.default_rng(9)
    x = draw.integers(0, 6, (400, 3)).astype(float)
    x[draw.random((400, 3)) < 0.1] = np.nan
    g, h = draw.normal(size=400), draw.random(400) + 0.1
    how = Boosting(depth=1, bins=32, l2=1.0, least_rows=5)
    edges = boosting.feature_edges(x, 32)
    split, cut, leaf, gain = boosting.grow(boosting.binned(x, edges) + np.arange(3) * 33, 33, g, h, how)
    best = (-1.0, None)
    for f in range(3):
        for edge in [-np.inf, *np.unique(x[~np.isnan(x[:, f]), f])]:
            left = np.isnan(x[:, f]) | (x[:, f] < edge)
            if min(left.sum(), (~left).sum()) < 5:
                continue
            score = sum(g[m].sum() ** 2 / (h[m].sum() + 1) for m in (left, ~left)) - g.sum() ** 2 / (h.sum() + 1)
            best = max(best, (score, (f, left.sum())), key=lambda b: b[0])
    assert gain[0] == pytest.approx(best[0]) and split[0] == best[1][0]
    threshold = edges[split[0]][cut[0] - 1] if cut[0] else -np.inf
    assert boosting.walk(x, split, np.array([threshold]), np.array([1.0, 0.0]), 1).sum() == best[1][1]


def test_one_class_gives_its_prior():
    model = boosting.fit_rows(np.zeros((50, 2)), np.ones(50, np.int64), np.zeros(50, bool), 2, TREES)
    assert model["feature"] == [] and boosting.predict_rows(model, np.zeros((3, 2)))[:, 1].min() > 0.99
    with pytest.raises(ValueError):
        Boosting(depth=0)


def test_race_finds_the_winner_of_the_full_grid(panel):
    grid = [Boosting(rounds=r, depth=d, bins=16, patience=5, rate=e) for r, d, e in ((1, 1, 0.01), (40, 2, 0.1), (40, 1, 0.1), (3, 2, 0.1), (40, 3, 0.3))]
    raced = {r["trial"]: r for r in training.tune_race(panel, TARGETS[0], FEATURES, SPEC, grid, 2500).collect()}
    full = {r["trial"]: r for r in training.tune_race(panel, TARGETS[0], FEATURES, SPEC, grid, 2500, slack=10.0).collect()}
    assert all(r["folds_done"] == 3 and r["given_up_after"] is None for r in full.values())
    best = max(full.values(), key=lambda r: (r["mean_skill"], -r["trial"]))
    winner = next(r for r in raced.values() if r["place"] == 1)
    assert winner["trial"] == best["trial"] and winner["mean_skill"] == best["mean_skill"] and winner["folds_done"] == 3
    assert any(r["given_up_after"] == r["folds_done"] < 3 for r in raced.values()) and raced[0]["given_up_after"] == 1
    assert sorted(r["place"] for r in raced.values()) == [1, 2, 3, 4, 5]


def test_trials_are_given_up_only_when_they_cannot_reach_the_leader():
    def of(*skills):
        return training.Trial(TREES, list(skills))

    assert training.hopeless(of(0.0), of(0.1), 5, 0.02) and not training.hopeless(of(0.0), of(0.1), 5, 0.03)
    assert not training.hopeless(of(0.0, 0.2), of(0.2, 0.1), 3, 0.001)  # it has gained 0.1 in a fold before


def test_recent_rows_are_whole_dates(panel):
    from panelyard.operators.folds import recent_rows

    assert recent_rows(panel, 41).select("date").distinct().count() == 3 and recent_rows(panel, 41).count() == 60
    assert recent_rows(panel, 10**6).count() == panel.count()
    with pytest.raises(ValueError):
        recent_rows(panel, 0)
