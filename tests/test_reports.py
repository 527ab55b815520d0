"""Reports: rejected names, the board with its facts, the payload's blocks, the system report."""

from datetime import date as D

import pytest
from pyspark.sql import functions as F

from panelyard.plans import monitoring, payload, scores


@pytest.fixture(scope="module")
def latest(spark):
    rows = [("A", D(2024, 1, 2), 10.0, 0.02, 0.01, 1.0, None), ("B", D(2024, 1, 2), 0.0, 0.02, 0.01, 1.0, 2.0), ("C", D(2024, 1, 2), 5.0, None, 0.01, 1.0, 2.0),
            ("D", D(2023, 1, 2), 5.0, 0.02, None, None, float("nan")), ("E", D(2024, 1, 2), float("nan"), 0.02, 0.01, 1.0, 2.0)]
    return spark.createDataFrame(rows, "ticker STRING, date DATE, last_close DOUBLE, label_scale DOUBLE, rel_label_scale DOUBLE, f DOUBLE, g DOUBLE")


def test_one_bad_name_gives_one_reject(spark, latest):
    asked = spark.createDataFrame([(c,) for c in "ABCDEFA"], "ticker STRING")
    rows = scores.checked(latest, asked, ["f", "g"])
    assert {r["ticker"] for r in scores.accepted(rows).collect()} == {"A"}
    assert {(r["ticker"], r["reason"]) for r in scores.rejected(rows).collect()} == {
        ("B", "no usable close"), ("C", "too little history to scale a move"), ("D", "no feature is known"), ("E", "no usable close"), ("F", "no price history")}
    assert set(scores.accepted(rows).columns) == set(latest.columns)


@pytest.fixture(scope="module")
def scored(spark):
    rows = [(t, s, D(2024, 1, d), k, p + d / 100) for d in (2, 3) for t, s, p in (("A", "x", 0.5), ("B", "y", 0.7), ("C", "x", 0.6)) for k in ("magnitude_1d", "direction_5d")]
    return spark.createDataFrame(rows, "ticker STRING, sector STRING, as_of DATE, target STRING, probability DOUBLE")


def test_board_tells_its_facts(spark, scored, latest):
    guard = spark.createDataFrame([("magnitude_1d", "crisis", -0.1, False)], "target STRING, worst_regime STRING, worst_skill DOUBLE, reliable_now BOOLEAN")
    deploy = spark.createDataFrame([("magnitude_1d", True, 2)], "target STRING, deployable BOOLEAN, families_measured INT")
    failed = spark.createDataFrame([("Q",), ("R",)], "ticker STRING")
    r = scores.board(scored, "magnitude_1d", "2024-01-08", limit=2, rejects=failed, guard=guard, deployable=deploy).first()
    assert (r["available"], r["as_of"], r["tickers_scored"], r["failures"], r["stale_trading_days"], r["stale"]) == (True, D(2024, 1, 3), 3, 2, 3, True)
    assert r["targets"] == ["direction_5d", "magnitude_1d"] and r["sectors"] == ["x", "y"] and [x["ticker"] for x in r["rows"]] == ["B", "C"]
    assert r["regime_guard"]["available"] and r["regime_guard"]["reliable_now"] is False and r["deployability"]["deployable"] is True
    older = scores.board(scored, "magnitude_1d", "2024-01-03", sector="x", as_of="2024-01-02", rejects=failed, guard=guard.limit(0), deployable=deploy).first()
    assert older["failures"] is None and older["stale_trading_days"] == 1 and older["stale"] is False and [x["ticker"] for x in older["rows"]] == ["C", "A"]
    assert older["regime_guard"]["available"] is False and "regime record" in older["regime_guard"]["reason"]
    none = scores.board(scored, "magnitude_1d", "2024-01-08", as_of="2020-01-01").first()
    assert none["available"] is False and "2020-01-01" in none["reason"] and none["rows"] is None and none["stale"] is None
    with pytest.raises(ValueError, match="direction_5d"):
        scores.board(scored, "nope", "2024-01-08").first()


def test_payload_blocks_say_whether_they_are_available(spark):
    universe = spark.createDataFrame([("A", "n", "s"), ("B", "n", "s")], "ticker STRING, name STRING, sector STRING")
    s = spark.createDataFrame([("A", D(2024, 1, 2), 1.0, "m", "Q", 0.5, 0.4, 1.2, 0.1)], "ticker STRING, as_of DATE, last_close DOUBLE, target STRING, predicted_class STRING, "
                              "probability DOUBLE, baseline DOUBLE, lift DOUBLE, label_scale DOUBLE")
    news = spark.createDataFrame([("A", True, ["h"])], "ticker STRING, available BOOLEAN, top_headlines ARRAY<STRING>")
    other = spark.createDataFrame([("A", True)], "ticker STRING, available BOOLEAN")
    analogs = spark.createDataFrame([], "ticker STRING, place INT, match_ticker STRING, match_date DATE, distance DOUBLE, forward_return_5d DOUBLE, forward_return_20d DOUBLE, outcome_5d STRING")
    quality = spark.createDataFrame([("m", 0.1, True), ("k", -0.1, False)], "target STRING, brier_skill DOUBLE, deployable BOOLEAN")
    out = {r["ticker"]: r for r in payload.build_payload(universe, s, news, other, analogs, other, quality, quality.limit(0)).collect()}
    for r in out.values():
        assert [x["target"] for x in r["model_quality"]["per_target"]] == ["k", "m"] and r["model_quality"]["available"]
        assert r["regime_guard"]["available"] is False and r["regime_guard"]["reason"] == "no regime record"
        assert r["deployability"]["available"] is False and r["deployability"]["reason"] == "not given"
    assert out["A"]["models"]["available"] and not out["B"]["models"]["available"] and out["B"]["models"]["reason"] == "not scored"


def test_system_report(spark):
    health = spark.createDataFrame([(10, True)], "predictions_total INT, healthy BOOLEAN")
    dist = spark.createDataFrame([("m", "Q", 3)], "target STRING, class STRING, n INT")
    live = spark.createDataFrame([("m", {"Q": 0.5})], "target STRING, base_rates MAP<STRING, DOUBLE>")
    drift = spark.createDataFrame([("a", 0.3, "significant"), ("b", 0.01, "stable"), ("c", 0.15, "moderate")], "feature STRING, psi DOUBLE, verdict STRING")
    r = monitoring.system_report(health, dist, live, drift, worst=2).first()
    assert r["feedback_loop"]["healthy"] and r["predictions"][0]["n"] == 3 and r["live_skill"][0]["target"] == "m"
    assert [x["feature"] for x in r["drift"]["worst"]] == ["a", "c"] and r["drift"]["significant_count"] == 1 and r["drift"]["retrain_recommended"]
    calm = monitoring.system_report(health, dist, live, drift.where("psi < 0.1")).first()
    assert calm["drift"]["retrain_recommended"] is False and monitoring.system_report(health, dist, live).first()["drift"] is None
