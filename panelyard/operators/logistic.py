"""Logistic models for many groups at once: one aggregate of gradient and Hessian per Newton step.

A group (a fold, a fold and a forecast, ...) has its own coefficients for every class but the first.  A step reads the rows once, adds up
gradient, Hessian and loss of all groups with partial aggregates, and solves the small systems of a few numbers each on the driver.  Features are
standardised by each group's own training moments; a group whose loss would rise takes half the step.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from panelyard.session import stored

RIDGE = 1e-9  # times the rows of a group, on slopes: keeps separable groups finite
STEPS = 25
DONE = 1e-12


@dataclass(frozen=True)
class Logistic:
    """Coefficients by group: ``table`` has the group's columns, the means and scales of the features and the coefficients (by class, then term)."""

    table: DataFrame
    group: tuple[str, ...]
    features: tuple[str, ...]
    k: int


def _terms(features, mean: str = "__mean", scale: str = "__scale") -> list[Column]:
    """1 and the standardised features."""
    out = [F.lit(1.0)]
    for i, f in enumerate(features):
        spread = F.get(scale, F.lit(i))
        out.append(F.when(spread > 0, (F.col(f) - F.get(mean, F.lit(i))) / spread).otherwise(F.lit(0.0)))
    return out


def _probabilities(terms: list[Column], k: int) -> list[Column]:
    """Class probabilities; the first class has no coefficients."""
    n = len(terms)
    scores = [F.lit(0.0)]
    for c in range(k - 1):
        score = F.get("__b", F.lit(c * n)) * terms[0]
        for j in range(1, n):
            score = score + F.get("__b", F.lit(c * n + j)) * terms[j]
        scores.append(score)
    top = F.greatest(*scores)
    raw = [F.exp(s - top) for s in scores]
    total = raw[0]
    for r in raw[1:]:
        total = total + r
    return [r / total for r in raw]


def fit_logistic(train: DataFrame, group: list[str], features, k: int, steps: int = STEPS, ridge: float = RIDGE) -> Logistic:
    """Maximum likelihood of class ``y`` (0 to k - 1) for each group; every feature must be present in every row.

    One row per group goes to the driver in each step: groups are the folds and forecasts of a study.
    """
    features = tuple(features)
    spark, n = train.sparkSession, len(features) + 1
    rows = stored(train.select(*group, F.col("y").cast("int").alias("y"), *[F.col(f).cast("double").alias(f) for f in features]), "logistic")
    moments = rows.groupBy(*group).agg(
        F.count("*").alias("n"), F.array(*[F.avg(f) for f in features]).alias("mean"), F.array(*[F.coalesce(F.stddev_samp(f), F.lit(0.0)) for f in features]).alias("scale"))
    moments = moments.collect()
    keys = [tuple(m[c] for c in group) for m in moments]
    size = {key: m["n"] for key, m in zip(keys, moments)}
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in group)
    width = (k - 1) * n
    b = {key: np.zeros(width) for key in keys}

    def table(values: dict) -> DataFrame:
        data = [(*key, list(map(float, m["mean"])), list(map(float, m["scale"])), values[key].tolist()) for key, m in zip(keys, moments)]
        return spark.createDataFrame(data, f"{kinds}, __mean ARRAY<DOUBLE>, __scale ARRAY<DOUBLE>, __b ARRAY<DOUBLE>")

    if not keys:
        return Logistic(spark.createDataFrame([], f"{kinds}, __mean ARRAY<DOUBLE>, __scale ARRAY<DOUBLE>, __b ARRAY<DOUBLE>"), tuple(group), features, k)

    def sums(values: dict) -> dict:
        """Loss, gradient and Hessian of every group."""
        joined = rows.join(F.broadcast(table(values)), group)  # one row per group
        terms = [f"__t{j}" for j in range(n)]
        joined = joined.withColumns(dict(zip(terms, _terms(features))))
        joined = joined.withColumns({f"__p{c}": p for c, p in enumerate(_probabilities([F.col(t) for t in terms], k))})
        hit = [F.when(F.col("y") == c, 1.0).otherwise(0.0) for c in range(k)]
        out = [F.sum(-F.ln(F.greatest(F.get(F.array(*[F.col(f"__p{c}") for c in range(k)]), F.col("y")), F.lit(1e-300)))).alias("loss")]
        out += [F.sum((F.col(f"__p{c}") - hit[c]) * F.col(t)).alias(f"g{(c - 1) * n + j}") for c in range(1, k) for j, t in enumerate(terms)]
        for i in range(width):
            for m in range(i, width):
                (c, j), (d, q) = divmod(i, n), divmod(m, n)
                weight = F.col(f"__p{c + 1}") * ((1.0 if c == d else 0.0) - F.col(f"__p{d + 1}"))
                out.append(F.sum(weight * F.col(terms[j]) * F.col(terms[q])).alias(f"h{i}_{m}"))
        found = {}
        for r in joined.groupBy(*group).agg(*out).collect():
            hessian = np.zeros((width, width))
            for i in range(width):
                for m in range(i, width):
                    hessian[i, m] = hessian[m, i] = r[f"h{i}_{m}"]
            found[tuple(r[c] for c in group)] = (r["loss"], np.array([r[f"g{i}"] for i in range(width)]), hessian)
        return found

    slopes = np.array([0.0 if i % n == 0 else 1.0 for i in range(width)])

    def loss_of(key, values, loss):
        return loss + 0.5 * ridge * size[key] * float((slopes * values[key] ** 2).sum())

    now = sums(b)
    step = {key: None for key in keys}
    share = {key: 1.0 for key in keys}
    for _ in range(steps):
        tried = {}
        for key in keys:
            if step[key] is None:
                _, gradient, hessian = now[key]
                penalty = ridge * size[key] * slopes
                step[key] = np.linalg.lstsq(hessian + np.diag(penalty), gradient + penalty * b[key], rcond=None)[0]
                share[key] = 1.0
            tried[key] = b[key] - share[key] * step[key]
        then = sums(tried)
        moved = 0.0
        for key in keys:
            if loss_of(key, tried, then[key][0]) <= loss_of(key, b, now[key][0]) * (1 + 1e-14) + 1e-12:
                moved = max(moved, float(np.abs(tried[key] - b[key]).max()))
                b[key], now[key], step[key] = tried[key], then[key], None
            else:
                share[key] /= 2
                moved = max(moved, 1.0) if share[key] > 1e-6 else moved
        if moved < DONE:
            break
    return Logistic(table(b), tuple(group), features, k)


def predict_logistic(rows: DataFrame, model: Logistic, name: str = "p") -> DataFrame:
    """``rows`` with an array of class probabilities; NULL where a feature is missing or the group has no model."""
    own = {c: F.col(c) for c in rows.columns if c != name}
    joined = rows.join(F.broadcast(model.table), list(model.group), "left")  # one row per group
    p = F.array(*_probabilities(_terms(model.features), model.k))
    there = F.col("__b").isNotNull()
    for f in model.features:
        there = there & F.col(f).isNotNull()
    return joined.select(*own.values(), F.when(there, p).alias(name))
