"""Bounded samples of labelled documents, for operators that learn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

GRAIN = 1_000_000


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as no text."""
    return (F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds).cast("int")


def one_label_each(labels: DataFrame, column: str) -> DataFrame:
    """doc_id, label 0 or 1.  Rows without id or label are left out; repeated ids vote, ties are 1."""
    known = labels.select("doc_id", F.col(column).cast("double").alias("label")).dropna()
    return known.groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))


def sample(docs: DataFrame, labels: DataFrame, per_class: tuple[int, int]) -> tuple[DataFrame, dict[int, float]]:
    """doc_id, text, label of about ``per_class`` labelled documents, and the share taken of each class.

    The ids are drawn by a hash threshold that follows from the class counts, so the id table has a
    known bound whatever the input and may be sent to every task; the texts stay where they are.
    """
    counts = {r["label"]: r["count"] for r in labels.groupBy("label").count().collect()}
    share = {c: min(1.0, per_class[c] / n) for c, n in counts.items()}
    drawn = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(GRAIN))
    bound = F.when(F.col("label") == 1, F.lit(int(share.get(1, 0) * GRAIN))).otherwise(F.lit(int(share.get(0, 0) * GRAIN)))
    ids = labels.where(drawn < bound)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")
    return rows, share


def logistic(x, y, weight, rounds: int = 50):
    """Slope and offset of a weighted logistic fit in one variable, by Newton steps with a little shrinkage."""
    import numpy as np

    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = weight * (p - y)
        h = weight * p * (1 - p) + 1e-9
        grad = np.array([(g * x).sum() + 1e-3 * a, g.sum()])
        hess = np.array([[(h * x * x).sum() + 1e-3, (h * x).sum()], [(h * x).sum(), h.sum()]])
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)
