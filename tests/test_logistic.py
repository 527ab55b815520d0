"""Logistic models of many groups at once against Spark's own fit of each."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from panelyard.operators.logistic import fit_logistic, predict_logistic


@pytest.fixture(scope="module")
def rows(spark):
    draw = np.random.default_rng(3)
    out = []
    for g in range(3):
        for _ in range(600):
            a, b = draw.normal(g, 1 + g), draw.normal()
            z = np.array([0, 0.5 * a - 0.2, (g - 1) * b + 0.1])
            p = np.exp(z) / np.exp(z).sum()
            out.append((f"g{g}", float(a), float(b), int(draw.choice(3, p=p))))
    return spark.createDataFrame(out, "grp STRING, a DOUBLE, b DOUBLE, y INT")


@pytest.mark.parametrize("k", [2, 3])
def test_equals_the_fit_of_each_group(spark, rows, k):
    given = rows.withColumn("y", F.least("y", F.lit(k - 1)))
    got = predict_logistic(given, fit_logistic(given, ["grp"], ["a", "b"], k)).orderBy("grp", "a", "b").collect()
    put = VectorAssembler(inputCols=["a", "b"], outputCol="x")
    want = []
    for g in ("g0", "g1", "g2"):
        own = put.transform(given.where(F.col("grp") == g))
        model = LogisticRegression(featuresCol="x", labelCol="y", family="multinomial", maxIter=500, tol=1e-13, regParam=0.0).fit(own)
        want += [r["probability"].toArray() for r in model.transform(own).orderBy("a", "b").select("probability").collect()]
    assert np.abs(np.array([r["p"] for r in got]) - np.array(want)).max() < 1e-5


def test_gradient_vanishes_at_the_fit(rows):
    """At the maximum the probabilities of each class add up to its rows, also weighted by each feature."""
    fit = predict_logistic(rows, fit_logistic(rows, ["grp"], ["a", "b"], 3))
    for c in range(3):
        gap = F.get("p", F.lit(c)) - (F.col("y") == c).cast("double")
        for r in fit.groupBy("grp").agg(F.sum(gap).alias("one"), F.sum(gap * F.col("a")).alias("a"), F.sum(gap * F.col("b")).alias("b")).collect():
            assert abs(r["one"]) < 1e-4 and abs(r["a"]) < 1e-4 and abs(r["b"]) < 1e-4


def test_edges(spark, rows):
    model = fit_logistic(rows.limit(0), ["grp"], ["a"], 2)
    assert [r["p"] for r in predict_logistic(rows.limit(2), model).collect()] == [None, None]
    parted = spark.createDataFrame([("s", float(i), int(i > 9)) for i in range(20)], "grp STRING, a DOUBLE, y INT")  # separable
    p = [r["p"][1] for r in predict_logistic(parted, fit_logistic(parted, ["grp"], ["a"], 2)).orderBy("a").collect()]
    assert p == sorted(p) and p[9] < 0.05 and p[10] > 0.95
    flat = parted.withColumn("a", F.lit(3.0))
    assert all(abs(r["p"][1] - 0.5) < 1e-9 for r in predict_logistic(flat, fit_logistic(flat, ["grp"], ["a"], 2)).collect())
    gaps = parted.withColumn("a", F.when(F.col("a") != 3, F.col("a")))
    assert predict_logistic(gaps, fit_logistic(parted, ["grp"], ["a"], 2)).where("p IS NULL").count() == 1
