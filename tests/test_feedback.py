"""Outcomes, idempotence, live skill, sentiment and readers."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelyard.plans import feedback, sentiment
from panelyard.plans.scores import leaderboard
from panelyard.sources import readers

D = dt.date
PRED = ("prediction_id STRING, ticker STRING, as_of DATE, target STRING, kind STRING, horizon_days INT, threshold_sigmas DOUBLE, "
        "label_scale DOUBLE, predicted_class STRING, model_fingerprint STRING, probabilities MAP<STRING, DOUBLE>")


def bars(spark, closes, ticker="T"):
    days = pd.bdate_range("2024-01-01", periods=len(closes)).date
    return spark.createDataFrame([(ticker, d, float(c)) for d, c in zip(days, closes)], "ticker STRING, date DATE, close DOUBLE")


def prediction(i, as_of, kind="magnitude", h=2, scale=0.1, cls="LARGE_MOVE", p=None, fp="m1"):
    p = p or {"QUIET": 0.4, "LARGE_MOVE": 0.6}
    return (f"p{i}", "T", as_of, f"{kind}_{h}d", kind, h, 1.0, scale, cls, fp, p)


def test_outcomes_wait_for_the_horizon_and_use_the_recorded_scale(spark):
    b = bars(spark, [100, 101, 120, 90, 91])
    log = spark.createDataFrame([
        prediction(0, D(2024, 1, 1)), prediction(1, D(2024, 1, 1), scale=0.5), prediction(2, D(2024, 1, 4)),
        prediction(3, D(2024, 1, 6)), prediction(4, D(2024, 1, 2), scale=None),
        prediction(5, D(2024, 1, 2), kind="direction", cls="DROP")], PRED)
    got = {r.prediction_id: r for r in feedback.outcomes(log, b).collect()}
    assert set(got) == {"p0", "p1", "p4", "p5"}          # p2 still open, p3 no such bar
    assert got["p0"].actual_class == "LARGE_MOVE" and got["p0"].error_type == "correct"
    assert got["p1"].actual_class == "QUIET" and got["p1"].error_type == "incorrect"
    assert got["p4"].actual_z is None and got["p4"].error_type is None
    assert got["p5"].actual_class == "DROP" and got["p5"].actual_return == pytest.approx(90 / 101 - 1)
    resolved = feedback.outcomes(log, b)
    assert feedback.outcomes(feedback.pending_of(log, resolved), b).count() == 0


def test_live_skill_separates_models(spark):
    rows = []
    for i in range(40):
        hit = i % 4 == 0
        fp = "m1" if i < 20 else "m2"
        good = {"QUIET": 0.1, "LARGE_MOVE": 0.9} if hit else {"QUIET": 0.9, "LARGE_MOVE": 0.1}
        p = good if fp == "m1" else {"QUIET": 0.5, "LARGE_MOVE": 0.5}
        rows.append(prediction(i, D(2024, 1, 1), p=p, fp=fp) + ("LARGE_MOVE" if hit else "QUIET",))
    got = {(r.level, r.model_fingerprint): r for r in feedback.live_skill(spark.createDataFrame(rows, PRED + ", actual_class STRING")).collect()}
    assert got[("model", "m1")].brier == pytest.approx(0.02)
    assert got[("model", "m2")].brier_skill == pytest.approx(1 - 0.5 / 0.375)
    assert got[("target", None)].n == 40 and not got[("target", None)].sufficient


def test_log_append_is_idempotent_and_migration_keeps_rows(spark):
    scored = spark.createDataFrame([prediction(0, D(2024, 1, 1)), prediction(1, D(2024, 1, 2))], PRED).drop("prediction_id", "target")
    rows = feedback.log_rows(scored)
    assert {r.target for r in rows.collect()} == {"magnitude_2d"}
    assert feedback.append_once(rows, rows).count() == 0
    assert feedback.append_once(rows.where("as_of = '2024-01-01'"), rows).count() == 1
    old = spark.createDataFrame([("a", 5, 0.2, 0.5, 0.3), ("b", 1, 0.1, 0.8, 0.1)], "prediction_id STRING, horizon_days INT, proba_drop DOUBLE, proba_neutral DOUBLE, proba_spike DOUBLE")
    new = {r.prediction_id: r for r in feedback.migrate_log(old).collect()}
    assert new["a"].target == "direction_5d" and new["a"].probabilities["SPIKE"] == 0.3 and len(new) == 2


def test_post_mortem_rules(spark):
    macro = spark.createDataFrame([(D(2024, 1, d), v) for d, v in ((1, 10.0), (2, 11.0), (3, 20.0), (4, 20.5), (5, 20.0), (8, 20.0), (9, 20.0))], "date DATE, vix DOUBLE")
    filings = spark.createDataFrame([("T", "8-K", D(2024, 1, 9), "8.01")], "ticker STRING, form STRING, filing_date DATE, items STRING")
    rows = [
        prediction(0, D(2024, 1, 1), p={"DROP": 0.3, "NEUTRAL": 0.4, "SPIKE": 0.3}) + (2.0, "incorrect"),
        prediction(1, D(2024, 1, 1)) + (2.0, "incorrect"), prediction(2, D(2024, 1, 5)) + (2.0, "incorrect"),
        prediction(3, D(2024, 1, 4)) + (2.0, "incorrect"), prediction(4, D(2024, 1, 4)) + (0.2, "incorrect"),
        prediction(5, D(2024, 1, 4)) + (2.0, "correct")]
    done = spark.createDataFrame(rows, PRED + ", actual_z DOUBLE, error_type STRING")
    got = {r.prediction_id: r.post_mortem_tag for r in feedback.post_mortem(done, macro, filings).collect()}
    assert got == {"p0": "MODEL_UNCERTAIN", "p1": "REGIME_SHIFT", "p2": "EVENT_NOT_IN_TAXONOMY", "p3": "UNEXPLAINED"}


ARTICLE = "ticker STRING, doc_id BIGINT, title STRING, source STRING, published TIMESTAMP, positive DOUBLE, negative DOUBLE, neutral DOUBLE"


def test_one_vote_per_source_and_stale_is_not_neutral(spark):
    now = dt.datetime(2024, 1, 2, 12, tzinfo=dt.timezone.utc)
    hours = lambda h: now - dt.timedelta(hours=h)
    rows = [("A", i, "t", "Reuters ", hours(1), 0.9, 0.0, 0.1) for i in range(5)] + [("A", 9, "t", "zacks", hours(1), 0.0, 0.9, 0.1)]
    rows += [("B", 20, "t", "reuters", hours(60), 0.9, 0.0, 0.1)]
    news = sentiment.ticker_sentiment(spark.createDataFrame(rows, ARTICLE), "2024-01-02 12:00:00")
    got = {r.ticker: r for r in news.collect()}
    assert got["A"].sources == 2 and got["A"].article_count == 6
    assert got["A"].score == pytest.approx(0.9 * (0.95 - 0.4) / (0.95 + 0.4))
    universe = spark.createDataFrame([("A",), ("B",), ("C",)], "ticker STRING")
    state = {r.ticker: (r.available, r.stale) for r in sentiment.availability(universe, news).collect()}
    assert state == {"A": (True, False), "B": (False, True), "C": (False, True)}


def test_word_scores(spark):
    row = spark.createDataFrame([("Profit beats; shares surge. One miss!",)], "t STRING").select(
        *[c.alias(k) for k, c in sentiment.word_scores(F.col("t")).items()]).first()
    assert (row.positive, row.negative, row.neutral) == (0.5, 0.25, 0.25)


def test_unknown_target_is_an_error(spark):
    scores = spark.createDataFrame([("A", D(2024, 1, 1), "magnitude_1d", 0.5)], "ticker STRING, as_of DATE, target STRING, probability DOUBLE")
    with pytest.raises(ValueError, match="magnitude_1d"):
        leaderboard(scores, "nope")
    assert leaderboard(scores, "magnitude_1d", limit=0).count() == 0


def test_missing_changes_file_is_an_empty_table(spark):
    empty = readers.read_changes(spark, None)
    assert empty.count() == 0 and dict(empty.dtypes)["date"] == "date"
    with pytest.raises(ValueError):
        readers.targets_of(spark.createDataFrame([("a", "production")], "target STRING, stage STRING"), "staging")
