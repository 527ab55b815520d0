"""Boosted trees for many small fits at once: one group of a table is one fit.

A fit gets a bounded number of rows, so it needs no job of its own: all fits of a study are the groups of one grouped map, and Spark runs them side by
side.  Trees are grown on histograms of binned features with a second-order gain; a missing value lies below all others.  The last rows that are marked as
held out only tell when to stop.  A fitted model is a row of arrays, so models are written, read, compared and scored like any table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

MODEL = ("k INT, depth INT, rows BIGINT, held_out BIGINT, best_round INT, rounds_run INT, held_out_loss DOUBLE, base ARRAY<DOUBLE>, feature ARRAY<INT>, "
         "threshold ARRAY<DOUBLE>, leaf ARRAY<DOUBLE>, gain ARRAY<DOUBLE>")


@dataclass(frozen=True)
class Boosting:
    """Rounds at most, tree depth, learning rate, bins of a feature, rounds without gain before the stop, and regularisation."""

    rounds: int = 200
    depth: int = 3
    rate: float = 0.1
    bins: int = 32
    patience: int = 15
    l2: float = 5.0
    least_rows: int = 20

    def __post_init__(self):
        if self.rounds < 1 or not 1 <= self.depth <= 8 or not 2 <= self.bins <= 255 or self.patience < 1 or not 0 < self.rate <= 1:
            raise ValueError(f"unusable parameters {self}")


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def log_loss(p: np.ndarray, y: np.ndarray) -> float:
    return float(-np.log(np.maximum(p[np.arange(len(y)), y], 1e-15)).mean())


def feature_edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Ascending cuts of every feature at even shares of its present values."""
    shares = np.linspace(0, 1, bins)[1:-1]
    out = []
    for column in x.T:
        seen = column[~np.isnan(column)]
        out.append(np.unique(np.quantile(seen, shares)) if len(seen) else np.zeros(0))
    return out


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin of every value: 0 missing, then 1 more than the cuts at or below it."""
    out = np.zeros(x.shape, np.int64)
    for f, cuts in enumerate(edges):
        there = ~np.isnan(x[:, f])
        out[there, f] = 1 + np.searchsorted(cuts, x[there, f], "right")
    return out


def grow(place: np.ndarray, bins: int, g: np.ndarray, h: np.ndarray, how: Boosting) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One complete tree: split feature (-1: none) and bin of every inner node, leaf values, and the gain of each split.

    ``place``: bin of every row and feature, plus ``bins`` times the feature.
    """
    features = place.shape[1]
    inner = 2**how.depth - 1
    split, cut, gain = np.full(inner, -1), np.zeros(inner, np.int64), np.zeros(inner)
    node = np.zeros(len(place), np.int64)  # number within the level
    own = place - np.arange(features) * bins
    for level in range(how.depth):
        width = 2**level
        at = (node[:, None] * (features * bins) + place).ravel()
        size = width * features * bins

        def histogram(weights: np.ndarray | None) -> np.ndarray:
            spread = None if weights is None else np.repeat(weights, features)
            return np.bincount(at, spread, size).reshape(width, features, bins).cumsum(2)

        lg, lh, ln = histogram(g), histogram(h), histogram(None)
        tg, th, tn = lg[:, :, -1:], lh[:, :, -1:], ln[:, :, -1:]
        score = lg**2 / (lh + how.l2) + (tg - lg) ** 2 / (th - lh + how.l2) - tg**2 / (th + how.l2)
        score[(ln < how.least_rows) | (tn - ln < how.least_rows)] = -np.inf
        flat = score.reshape(width, -1)
        best = flat.argmax(1)
        top = flat[np.arange(width), best]
        first = width - 1
        for k in np.flatnonzero(top > 1e-12).tolist():
            split[first + k], cut[first + k], gain[first + k] = best[k] // bins, best[k] % bins, top[k]
        f = split[first + node]
        right = (f >= 0) & (own[np.arange(len(own)), np.maximum(f, 0)] > cut[first + node])
        node = 2 * node + right
    total_g, total_h = np.bincount(node, g, inner + 1), np.bincount(node, h, inner + 1)
    return split, cut, -how.rate * total_g / (total_h + how.l2), gain


def walk(x: np.ndarray, split: np.ndarray, threshold: np.ndarray, leaf: np.ndarray, depth: int) -> np.ndarray:
    """Leaf values of all rows; a missing value goes left."""
    rows, node = np.arange(len(x)), np.zeros(len(x), np.int64)
    for _ in range(depth):
        f = split[node]
        v = x[rows, np.maximum(f, 0)]
        node = 2 * node + 1 + ((f >= 0) & (v >= threshold[node]))
    return leaf[node - (2**depth - 1)]


def fit_rows(x: np.ndarray, y: np.ndarray, held: np.ndarray, k: int, how: Boosting) -> dict:
    """A model from the rows not held out; rounds after the best one on the held-out rows are dropped."""
    train = ~held if (~held).any() else np.ones(len(y), bool)
    xt, yt, xv, yv = x[train], y[train], x[held], y[held]
    edges = feature_edges(xt, how.bins)
    bins = how.bins + 1
    place = binned(xt, edges) + np.arange(x.shape[1]) * bins
    share = (np.bincount(yt, minlength=k) + 1e-3) / (len(yt) + k * 1e-3)
    base = np.log(share)
    z, zv = np.tile(base, (len(yt), 1)), np.tile(base, (len(yv), 1))
    trees, losses = [], []
    target = np.eye(k)[yt]
    classes = [1] if k == 2 else range(k)
    stop_early = len(yv) > 0 and len(np.unique(yt)) > 1
    for _ in range(how.rounds if len(np.unique(yt)) > 1 else 0):
        p = softmax(z)
        for c in classes:
            g, h = p[:, c] - target[:, c], np.maximum(p[:, c] * (1 - p[:, c]), 1e-9)
            split, cut, leaf, gain = grow(place, bins, g, h, how)
            # a row goes left when its bin is at most the cut: below the edge of that number, or missing
            threshold = np.array([edges[f][b - 1] if f >= 0 and b > 0 else -np.inf for f, b in zip(split, cut)])
            trees.append((split, threshold, leaf, gain))
            z[:, c] += walk(xt, split, threshold, leaf, how.depth)
            if stop_early:
                zv[:, c] += walk(xv, split, threshold, leaf, how.depth)
        if stop_early:
            losses.append(log_loss(softmax(zv), yv))
            if len(losses) - 1 - int(np.argmin(losses)) >= how.patience:
                break
    run = len(trees) // len(classes)
    best = int(np.argmin(losses)) + 1 if losses else run
    kept = trees[:best * len(classes)]
    gains = np.zeros(x.shape[1])
    for split, _, _, gain in kept:
        np.add.at(gains, split[split >= 0], gain[split >= 0])

    def joined(i: int) -> list:
        return np.concatenate([t[i] for t in kept]).tolist() if kept else []

    return {"k": k, "depth": how.depth, "rows": int(train.sum()), "held_out": len(yv), "best_round": best, "rounds_run": run, "held_out_loss": losses[best - 1] if losses else None,
            "base": base.tolist(), "feature": joined(0), "threshold": joined(1), "leaf": joined(2), "gain": gains.tolist()}


def predict_rows(model: dict, x: np.ndarray) -> np.ndarray:
    """Class probabilities of all rows."""
    k, depth = model["k"], model["depth"]
    inner = 2**depth - 1
    z = np.tile(np.asarray(model["base"], float), (len(x), 1))
    split, threshold, leaf = (np.asarray(model[c]) for c in ("feature", "threshold", "leaf"))
    classes = [1] if k == 2 else range(k)
    for t in range(len(split) // inner if len(split) else 0):
        nodes, leaves = slice(t * inner, (t + 1) * inner), slice(t * (inner + 1), (t + 1) * (inner + 1))
        z[:, classes[t % len(classes)]] += walk(x, split[nodes].astype(int), threshold[nodes], leaf[leaves], depth)
    return softmax(z)


def fit_groups(rows: DataFrame, group: list[str], features, how: Boosting | list[Boosting], rounds: str | None = None) -> DataFrame:
    """One model row per group.  ``rows``: the group's columns, k, y, held_out, ticker, date and the features; as many as one task can hold per group.

    A list of parameters is numbered by the first column of ``group``.  ``rounds`` names a column with the group's own number of rounds.
    """
    features = list(features)
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in group)

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["date", "ticker"], ignore_index=True)  # the same model whatever the order of rows
        own = how if isinstance(how, Boosting) else how[int(part[group[0]].iloc[0])]
        own = own if rounds is None else replace(own, rounds=max(1, int(part[rounds].iloc[0])))
        model = fit_rows(part[features].to_numpy(np.float64), part["y"].to_numpy(np.int64), part["held_out"].to_numpy(bool), int(part["k"].iloc[0]), own)
        return pd.DataFrame([{**{c: part[c].iloc[0] for c in group}, **model}])

    needed = rows.select(*group, *([rounds] if rounds else []), "k", "y", "held_out", "ticker", "date", *features)
    return needed.groupBy(*group).applyInPandas(fit, f"{kinds}, {MODEL}")


def score_groups(rows: DataFrame, models: DataFrame, group: list[str], features) -> DataFrame:
    """``rows`` with ``p``, by the model of their group; rows of a group without model are left out.

    Models are collected: there is one for each group of a study, of a size that rounds and depth bound.
    """
    features = list(features)
    held = {tuple(r[c] for c in group): r.asDict() for r in models.collect()}
    sent = rows.sparkSession.sparkContext.broadcast(held)
    keep = [c for c in rows.columns if c not in features]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, part in batch.groupby(group, sort=False):
                model = sent.value.get(tuple(x.item() if hasattr(x, "item") else x for x in key))
                if model is not None:
                    p = predict_rows(model, part[features].to_numpy(np.float64))
                    yield part[keep].assign(p=list(p))

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.select(*keep, *[F.col(c).cast("double").alias(c) for c in features]).mapInPandas(score, f"{kinds}, p ARRAY<DOUBLE>")
