"""Quality scores by naive Bayes support vectors.

A text's features are indicators of its byte n-grams and of its runs of three word shapes, hashed to a
fixed number of places.  Each is
scaled by the log ratio of its smoothed counts in the two classes; a linear model with hinge loss is
then fitted by dual coordinate descent, and its margin turned into a probability on rows that the
first fit has not seen.  Counts and fit use a bounded sample of the labelled rows (``FIT_ROWS``) in
one task; scoring reads every text whole, in the tasks of the scan, against one vector of fixed size.

Defined cases: null and empty texts have no features and get the score of the offset alone; rows
without id or label teach nothing, repeated labels vote; without labels of both classes every score
is the smoothed share of class 1; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelyard.llm import flat, labelled

PLACES_LOG2 = 18
GRAM_BYTES = (2, 4)
KIND = np.zeros((256, 3), np.int64)  # small letter, capital or digit, other sign than these
KIND[97:123, 0] = KIND[128:, 0] = KIND[65:91, 1] = KIND[48:58, 1] = 1
KIND[:128, 2] = 1 - KIND[:128, :2].sum(1)
FIT_ROWS = (6_000, 6_000)  # bound of the labelled rows fitted, by class
COST = 1.0
EPOCHS = 12
FOLDS, HELD_FOLD = 3, 1
SCORES = "doc_id BIGINT, held_out BOOLEAN, score DOUBLE, predicted INT"


def word_shapes(texts: pa.Array) -> np.ndarray:
    """Row and place of runs of three words by their shape: repeated, all capitals, with or without letters and digits."""
    words = flat.Words(texts, fold=False)
    n = len(words.key)
    if n < 3:
        return np.zeros(0, np.int64)
    same = np.zeros(n, np.int64)
    same[1:] = (words.key[1:] == words.key[:-1]) & (words.row[1:] == words.row[:-1])
    kinds = np.concatenate([np.zeros((1, 3), np.int64), np.cumsum(KIND[words.data], axis=0)])
    has = kinds[words.end] > kinds[words.start]
    shape = same | has[:, 0] << 1 | has[:, 1] << 2 | has[:, 2] << 3
    run = shape[2:] << 8 | shape[1:-1] << 4 | shape[:-2]
    whole = words.row[2:] == words.row[:-2]
    place = ((run.astype(np.uint32) + np.uint32(1 << 20)) * np.uint32(2654435761)) >> np.uint32(32 - PLACES_LOG2)
    return (words.row[2:][whole] << PLACES_LOG2) | place[whole]


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and place of every distinct feature of every text."""
    data, at = flat.raw(texts)
    found = []
    for size in GRAM_BYTES:
        if len(data) < size:
            continue
        word = np.zeros(len(data) - size + 1, np.uint32)
        for k in range(size):
            word |= data[k:len(data) - size + 1 + k].astype(np.uint32) << np.uint32(8 * k)
        place = ((word * np.uint32(2654435761) ^ np.uint32(size * 40503)) * np.uint32(2246822519)) >> np.uint32(32 - PLACES_LOG2)
        row = np.repeat(np.arange(len(at) - 1), np.diff(at))[:len(word)]
        whole = np.arange(len(word)) + size <= at[row + 1]
        found.append((row[whole] << PLACES_LOG2) | place[whole])
    found.append(word_shapes(texts))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = np.concatenate(found)
    key = np.sort(key.astype(np.int32) if len(at) <= 1 << (31 - PLACES_LOG2) else key)
    key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
    return (key >> PLACES_LOG2).astype(np.int64), (key & ((1 << PLACES_LOG2) - 1)).astype(np.int64)


def descend(features: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Weights of the hinge-loss model by dual coordinate descent; the last one is the offset.

    A row is its scaled indicators over the root of their number, and a constant one.  Its values are made when its turn comes:
    those of all rows would take twice the memory of the rows.
    """
    def values(f: np.ndarray) -> np.ndarray:
        return ratio[f] / np.sqrt(max(1, len(f)))

    w = np.zeros(len(ratio) + 1)
    alpha = np.zeros(len(y))
    norm = np.array([v @ v + 1.0 for v in map(values, features)])
    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        moved = 0.0
        for i in order.permutation(len(y)):
            f = features[i]
            v = values(f)
            gradient = y[i] * (w[f] @ v + w[-1]) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), cost[i])
            step = new - alpha[i]
            if step:
                alpha[i] = new
                w[f] += step * y[i] * v
                w[-1] += step * y[i]
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w


def fit(features: list[np.ndarray], label: np.ndarray, share: dict[int, float]) -> np.ndarray:
    """One value per place (ratio times weight), then offset, slope and shift of the probability."""
    places = 1 << PLACES_LOG2
    ones = int((label == 1).sum())
    if ones == 0 or ones == len(label):
        flat_score = (ones + 1) / (len(label) + 2)
        return np.concatenate([np.zeros(places + 1), [0.0, np.log(flat_score / (1 - flat_score))]])

    def model(use: np.ndarray) -> np.ndarray:
        count = np.ones((2, places))
        for i in use:
            count[label[i], features[i]] += 1
        count /= count.sum(1, keepdims=True)
        ratio = np.log(count[1] / count[0])
        y = np.where(label[use] == 1, 1.0, -1.0)
        balance = len(use) / (2 * np.maximum(1, np.bincount(label[use], minlength=2)))
        w = descend([features[i] for i in use], y, ratio, COST * balance[label[use]])
        return np.append(w[:-1] * ratio, w[-1])

    def margins(v: np.ndarray, use: np.ndarray) -> np.ndarray:
        return np.array([v[features[i]].sum() / np.sqrt(max(1, len(features[i]))) + v[-1] for i in use])

    held = np.arange(len(label)) % 4 == 0
    first = model(np.flatnonzero(~held)) if len(set(label[~held])) == 2 else model(np.arange(len(label)))
    use = np.flatnonzero(held)
    weight = np.array([1 / share[int(c)] for c in label[use]])
    slope, shift = labelled.logistic(margins(first, use), label[use].astype(float), weight / weight.mean())
    return np.concatenate([model(np.arange(len(label))), [slope, shift]])


def train(docs: DataFrame, labels: DataFrame, fit_rows: tuple[int, int] = FIT_ROWS) -> np.ndarray:
    """The fitted vector of fixed size.  ``labels``: doc_id, label."""
    rows, share = labelled.sample(docs, labels, fit_rows)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in flat.blocks(batch, limit=flat.SMALL_BYTES):
                row, place = grams(block.column("text"))
                cuts = np.searchsorted(row, np.arange(block.num_rows + 1))
                own = [place[a:b].astype("<i4").tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
                yield pa.RecordBatch.from_arrays(
                    [block.column("doc_id"), block.column("label"), pa.array(own, pa.binary())], ["doc_id", "label", "places"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(d, l, p) for b in batches for d, l, p in zip(*(c.to_pylist() for c in b.columns))]
        got.sort(key=lambda r: (r[0], r[2]))
        fitted = fit([np.frombuffer(p, "<i4") for _, _, p in got], np.array([l for _, l, _ in got], int), share)
        yield pa.RecordBatch.from_arrays([pa.array([fitted.astype("<f8").tobytes()], pa.binary())], ["fitted"])

    encoded = rows.mapInArrow(encode, "doc_id BIGINT, label INT, places BINARY")
    return np.frombuffer(encoded.repartition(1).mapInArrow(learn, "fitted BINARY").head()[0], "<f8")


def probability(texts: pa.Array, fitted: np.ndarray) -> np.ndarray:
    """Probability of class 1 of every text of a block."""
    *_, offset, slope, shift = fitted
    row, place = grams(texts)
    total = np.bincount(row, fitted[place], len(texts))
    margin = total / np.sqrt(np.maximum(1, np.bincount(row, minlength=len(texts)))) + offset
    return 1 / (1 + np.exp(-np.clip(slope * margin + shift, -700, 700)))


def judged(batches: Iterator[pa.RecordBatch], fitted: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The rows in blocks, and the probability of class 1 of each row."""
    for batch in batches:
        for block in flat.blocks(batch, limit=flat.SMALL_BYTES):
            yield block, probability(block.column("text"), fitted)


def learned(docs: DataFrame, labels: DataFrame, fit_rows: tuple[int, int]) -> np.ndarray:
    held = labelled.fold("doc_id", FOLDS) == HELD_FOLD
    return train(docs, labelled.one_label_each(labels.where(~held), "quality"), fit_rows)


def score_quality(docs: DataFrame, labels: DataFrame, fit_rows: tuple[int, int] = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted class of every row, by a model that has seen no label of the held-out fold."""
    sent = docs.sparkSession.sparkContext.broadcast(learned(docs, labels, fit_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, p in judged(batches, sent.value):
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), block.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       (labelled.fold("doc_id", FOLDS) == HELD_FOLD).alias("held_out"))
    return rows.mapInArrow(run, SCORES)


def keep_good(docs: DataFrame, labels: DataFrame, fit_rows: tuple[int, int] = FIT_ROWS) -> DataFrame:
    """The rows of ``docs`` that the model doesn't reject, with all their columns.

    The decision is taken beside the row, so no join is needed and repeated ids don't matter.
    """
    sent = docs.sparkSession.sparkContext.broadcast(learned(docs, labels, fit_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, p in judged(batches, sent.value):
            yield block.filter(pa.array(p >= 0.5))

    return docs.mapInArrow(run, docs.schema)
