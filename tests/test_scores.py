"""Quantiles, ranking metrics, folds, bootstrap, drift, neighbours and gate rules."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from panelyard.operators.bootstrap import paired_edges
from panelyard.operators.drift import feature_drift
from panelyard.operators.folds import FoldSpec, fold_dates, thinned_dates
from panelyard.operators.ladder import ranking_metrics, score_ladder
from panelyard.operators import neighbours
from panelyard.operators.neighbours import nearest
from panelyard.operators.quantiles import exact_quantiles
from panelyard.plans import gate

PROBS = [0.0, 0.1, 0.5, 0.995, 1.0]


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6, allow_nan=False), min_size=1, max_size=200))
def test_quantiles_equal_numpy(spark, values):
    pdf = pd.DataFrame({"k": ["a"] * len(values) + ["b"] * 5000, "v": values + [7.0] * 4000 + list(np.linspace(6.999, 7.001, 1000))})
    got = {r.k: r.q for r in exact_quantiles(spark.createDataFrame(pdf), ["k"], "v", PROBS).collect()}
    for k, g in pdf.groupby("k"):
        np.testing.assert_allclose(got[k], np.quantile(g["v"], PROBS), rtol=1e-12, atol=1e-12)


def test_ranking_metrics_with_ties(spark):
    rng = np.random.default_rng(3)
    s = np.round(rng.random(800), 2)
    y = (rng.random(800) < s).astype(int)
    pdf = pd.DataFrame({"g": "x", "s": s, "y": y})
    got = ranking_metrics(score_ladder(spark.createDataFrame(pdf), ["g"], "s", "y"), ["g"]).first()
    pos, neg = s[y == 1], s[y == 0]
    auc = np.mean((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :]))
    ap, seen = 0.0, 0
    for cut in sorted(set(s), reverse=True):
        now = (s >= cut) & (y == 1)
        ap += (now.sum() - seen) / y.sum() * now.sum() / (s >= cut).sum()
        seen = now.sum()
    assert got.auc == pytest.approx(auc) and got.average_precision == pytest.approx(ap)
    one = ranking_metrics(score_ladder(spark.createDataFrame(pdf.assign(y=1)), ["g"], "s", "y"), ["g"]).first()
    assert one.auc is None


def dates(spark, n, per=3):
    days = pd.bdate_range("2010-01-01", periods=n).date
    return spark.createDataFrame(pd.DataFrame({"date": np.repeat(days, per)})), list(days)


def test_folds_are_purged_embargoed_and_whole(spark):
    rows, days = dates(spark, 120)
    spec = FoldSpec(n_splits=3, test_size=20, purge=5, embargo=4)
    pdf = fold_dates(rows, spec).toPandas()
    for f, g in pdf.groupby("fold"):
        test = sorted(g[g.role == "test"].date)
        train = set(g[g.role == "train"].date)
        assert test == days[120 - (3 - f) * 20:120 - (3 - f) * 20 + 20]
        start = days.index(test[0])
        assert max(days.index(d) for d in train) == start - 6
        for earlier in range(f):
            end = 120 - (3 - earlier) * 20 + 20
            gone = set(days[end:end + 4]) & set(days[:start - 5])
            assert not gone & train
    with pytest.raises(Exception, match="need at least"):
        fold_dates(dates(spark, 30)[0], spec).collect()


def test_thinning_keeps_whole_dates(spark):
    rows, days = dates(spark, 100, per=10)
    got = thinned_dates(rows, max_rows=300).toPandas()
    assert set(got.stride) == {4} and sorted(got.date) == days[::4]


def test_bootstrap_interval_sees_a_clear_edge(spark):
    rng = np.random.default_rng(0)
    base = rng.uniform(10, 20, 15)
    pdf = pd.concat([pd.DataFrame({"name": n, "fold": np.arange(15), "n": 100, "sum_model": base * f, "sum_reference": base})
                     for n, f in (("better", 0.9), ("same", 1.0))])
    rows = {r["name"]: r for r in paired_edges(spark.createDataFrame(pdf), ["name"], "fold", reps=200).collect()}
    assert rows["better"]["ci90_low"] > 0.09 and rows["better"]["wins"] == 15
    assert rows["same"]["ci90_low"] == 0 and rows["same"]["ci90_high"] == 0


def test_a_tie_but_for_rounding_is_no_win(spark):
    # the same three errors, added in two orders
    pdf = pd.DataFrame({"name": "x", "fold": [0, 1], "n": 3, "sum_model": [0.3 + 0.2 + 0.1, 0.5], "sum_reference": [0.1 + 0.2 + 0.3, 0.6]})
    assert pdf.sum_model[0] < pdf.sum_reference[0]
    assert paired_edges(spark.createDataFrame(pdf), ["name"], "fold", reps=10).first()["wins"] == 1


def test_drift_edge_cases(spark):
    rng = np.random.default_rng(1)
    n = 3000
    pdf = pd.DataFrame({"same": rng.normal(size=2 * n), "moved": np.r_[rng.normal(size=n), rng.normal(3, 1, n)],
                        "constant": 1.0, "gone": np.r_[rng.normal(size=n), np.full(n, np.nan)], "live": np.r_[np.zeros(n), np.ones(n)].astype(bool)})
    df = spark.createDataFrame(pdf).withColumn("gone", F.nanvl("gone", F.lit(None).cast("double")))
    got = {r.feature: r for r in feature_drift(df, ["same", "moved", "constant", "gone"], "live").collect()}
    assert got["same"].psi < 0.02 and got["same"].verdict == "stable"
    assert got["moved"].psi > 1 and got["gone"].psi > 1
    assert got["constant"].psi == 0.0


def test_neighbours_equal_brute_force_and_respect_eligibility(spark):
    rng = np.random.default_rng(2)
    pts = rng.normal(size=(300, 4))
    pts[:100] = pts[0]  # a third of all rows are copies
    pdf = pd.DataFrame({"id": [f"{i:03d}" for i in range(300)], "owner": [f"o{i % 7}" for i in range(300)], "day": np.arange(300) % 50, "vec": [p.tolist() for p in pts]})
    q = pdf.iloc[[5, 150, 299]].rename(columns={"id": "query_id"})
    got = nearest(spark.createDataFrame(pdf), spark.createDataFrame(q), 4).orderBy("query_id", "place").toPandas()
    for r in q.itertuples():
        ok = pdf[(pdf.owner != r.owner) & (pdf.day < r.day)].copy()
        ok["d"] = [np.linalg.norm(np.array(v) - np.array(r.vec)) for v in ok.vec]
        want = ok.sort_values(["d", "id"]).head(4)["id"].tolist()
        assert got[got.query_id == r.query_id]["id"].tolist() == want


def test_neighbour_tiles_lose_nothing(spark, monkeypatch):
    for name, size in (("SLICE_ROWS", 150), ("BLOCK_ROWS", 110), ("TILE_QUERIES", 16), ("TILE_ROWS", 32)):
        monkeypatch.setattr(neighbours, name, size)
    rng = np.random.default_rng(5)
    pts = np.round(rng.normal(size=(300, 3)) * 2) + 1e6  # many ties, far from the origin
    pts[7], pts[9] = np.nan, np.inf
    pdf = pd.DataFrame({"id": [f"{i:03d}" for i in range(300)], "owner": [f"o{i % 5}" for i in range(300)], "day": 0, "vec": [p.tolist() for p in pts]})
    q = pdf.rename(columns={"id": "query_id"}).drop(columns="day")
    asked = spark.createDataFrame(q).withColumn("day", F.lit(None).cast("int"))
    got = nearest(spark.createDataFrame(pdf), asked, 3).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("place", "id"))).alias("f")).collect()
    for r in got:
        i = int(r.query_id)
        with np.errstate(invalid="ignore"):
            d = np.sqrt(np.square(pts - pts[i]).sum(axis=1))
        want = [j for j in np.lexsort((np.arange(300), d)) if j % 5 != i % 5][:3]
        assert [int(x.id) for x in r.f] == want
    assert len(got) == 300


def test_neighbours_of_a_table_in_itself(spark, tmp_path):
    # before, both sides had columns of one table, which the cogrouped map lost on the second side
    rng = np.random.default_rng(8)
    pts = np.round(rng.normal(size=(60, 2)), 1)
    pd.DataFrame({"id": [f"{i:02d}" for i in range(60)], "owner": [f"o{i % 3}" for i in range(60)], "day": np.arange(60) % 9, "vec": [p.tolist() for p in pts]}).to_parquet(tmp_path / "t.parquet")
    rows = spark.read.parquet(str(tmp_path / "t.parquet")).withColumn("day", F.col("day").cast("int"))
    for asked in (rows.withColumnRenamed("id", "query_id"), rows.withColumnRenamed("id", "query_id").withColumn("day", F.lit(None).cast("int"))):
        days = {r.query_id: r.day for r in asked.collect()}
        got = nearest(rows, asked, 2).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("place", "id"))).alias("f")).collect()
        found = {r.query_id: [int(x.id) for x in r.f] for r in got}
        for i in range(60):
            d, day = np.sqrt(np.square(pts - pts[i]).sum(axis=1)), days[f"{i:02d}"]
            want = [j for j in np.lexsort((np.arange(60), d)) if j % 3 != i % 3 and (day is None or j % 9 < day)][:2]
            assert found.get(f"{i:02d}", []) == want


def test_neighbours_copy_rows_seldom():
    # before, every history row was copied for each 512 queries
    for n, most in ((50_000, 8), (1_000_000, 20), (4_000_000, 80)):
        slices, blocks = neighbours._cut(n, n)
        assert max(slices, blocks) <= most and n / slices <= neighbours.SLICE_ROWS and n / blocks <= neighbours.BLOCK_ROWS


def test_neighbours_without_a_number_come_last(spark):
    far = [float("nan")] * 2
    history = spark.createDataFrame([("a", "x", 0, [1.0, 1.0]), ("b", "x", 0, far), ("c", "x", 0, far), ("d", None, 0, [0.0, 0.0])], "id STRING, owner STRING, day INT, vec ARRAY<DOUBLE>")
    asked = spark.createDataFrame([("q", "y", None, [0.0, 0.0])], "query_id STRING, owner STRING, day INT, vec ARRAY<DOUBLE>")
    assert [r.id for r in nearest(history, asked, 2).orderBy("place").collect()] == ["a", "b"]


def test_gate_order(spark):
    cand = spark.createDataFrame([(t, s, "p1", "s1") for t, s in (("none", -0.1), ("fresh", 0.02), ("old", 0.02), ("other", 0.02), ("worse", 0.02), ("regress", 0.02), ("good", 0.02))],
                                 "target STRING, skill DOUBLE, panel_id STRING, schema STRING")
    inc = spark.createDataFrame([("old", 0.5, "3db13f4b530b"), ("other", 0.01, "p9"), ("worse", 0.01, "p1"), ("regress", 0.01, "p1"), ("good", 0.01, "p1")],
                                "target STRING, skill DOUBLE, panel_id STRING").withColumn("schema", F.lit(None).cast("string"))
    shared = spark.createDataFrame([("worse", 5000, -0.01, -0.02, 0.0), ("regress", 5000, 0.01, 0.001, 0.02), ("good", 5000, 0.01, -0.001, 0.02)],
                                   "target STRING, n_shared BIGINT, edge DOUBLE, ci90_low DOUBLE, ci90_high DOUBLE").withColumn("unusable", F.lit(None).cast("string"))
    regimes = spark.createDataFrame([("regress", "gfc", 0.0, 0.02), ("good", "gfc", 0.02, 0.02)], "target STRING, regime STRING, candidate DOUBLE, incumbent DOUBLE")
    got = {r.target: (r.promote, r.reason) for r in gate.promotion(cand, inc, shared, regimes).collect()}
    assert got == {
        "none": (False, "no skill over the base rate"), "fresh": (True, "no incumbent"), "old": (True, "incumbent's panel is retired"),
        "other": (False, "different panels"), "worse": (False, "no edge on shared rows"), "regress": (False, "regresses in a regime"),
        "good": (True, "improves with no regression")}


def test_unmeasured_is_not_dominated(spark):
    targets = spark.createDataFrame([("a",), ("b",), ("c",)], "target STRING")
    comps = spark.createDataFrame([("a", "simple baseline", "vol", -0.02, -0.03, -0.01), ("b", "simple baseline", "vol", -0.02, -0.03, 0.01)],
                                  "target STRING, family STRING, name STRING, pooled DOUBLE, ci90_low DOUBLE, ci90_high DOUBLE")
    got = {r.target: (r.deployable, r.families_measured) for r in gate.deployability(targets, comps).collect()}
    assert got == {"a": (False, 1), "b": (True, 1), "c": (True, 0)}
