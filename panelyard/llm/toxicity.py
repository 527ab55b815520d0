"""Toxicity scores from the nearest labelled examples by exact TF-IDF cosine.

Examples are a bounded sample of labelled documents (``EXAMPLES`` by class).  Terms are byte n-grams
within words, which also find inflected forms; those of the examples within the document-frequency
bounds form the vocabulary.  A term's weight is (1 + ln tf) ln(N / df) with df counted over
all documents.  The inverted index keeps, per term and block of examples, the postings and their largest
weight.  A query bounds every block by those maxima, reads the blocks with the highest bounds first,
and skips the rest once no bound reaches its k-th cosine, so the neighbours are the exact ones.
Votes weighted by squared cosine become a probability by a logistic fit on the examples' own votes
(each without itself and its exact copies), with each class at its share of the labelled rows.

The index has a fixed bound and is the same in every task; texts are scored in the tasks of the scan.

Defined cases: null and empty texts, and texts that share no term, have no neighbour and vote as the
share of class 1 among the labels; rows without id or label teach nothing; repeated labels vote;
without labels of both classes every score is the smoothed share; ties at the k-th cosine go to the
earlier example of the index; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelyard.llm import flat, labelled

EXAMPLES = (4_096, 4_096)  # bound of the labelled rows in the index, by class
NEAREST = 64
BLOCK = 1_024  # examples in a block of the index
FIRST_BLOCKS = 2
TERM_BYTES = 4
LEAST_SHARE, MOST_SHARE = 0.003, 0.1  # a term must occur in this share of the examples, and may in that share of those of class 0
LEAST_DF = 2
FOLDS, HELD_FOLD = 5, 0
EVIDENCE = 3
SCORES = ("doc_id BIGINT, held_out BOOLEAN, score DOUBLE, predicted INT, "
          "evidence ARRAY<STRUCT<doc_id: BIGINT, label: INT, cosine: DOUBLE>>")


def counted(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and count of every distinct term of every text, by row and term: the byte 4-grams within words, A-Z lower-cased."""
    data, at = flat.raw(texts)
    data = flat.LOWER[data]
    n = len(data) - TERM_BYTES + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = np.ones(n, bool)
    gram = np.zeros(n, np.uint64)
    for k in range(TERM_BYTES):
        part = data[k:n + k]
        inside &= ~flat.SPACE[part]
        gram |= part.astype(np.uint64) << np.uint64(8 * k)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))[:n]
    inside &= np.arange(n) + TERM_BYTES <= at[row + 1]
    key, count = np.unique((row[inside].astype(np.uint64) << np.uint64(32)) | gram[inside], return_counts=True)
    return (key >> np.uint64(32)).astype(np.int64), key & np.uint64(0xFFFFFFFF), count


def ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All numbers of the given ranges, one after another."""
    size = end - start
    total = int(size.sum())
    if not total:
        return np.zeros(0, np.int64)
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(total)


class Index:
    """Block-max inverted index of the examples' unit vectors."""

    def __init__(self, ids: np.ndarray, label: np.ndarray, row: np.ndarray, key: np.ndarray, count: np.ndarray):
        n = len(ids)
        terms, df = np.unique(key, return_counts=True)
        clean = label[row] == 0
        usual = np.bincount(np.searchsorted(terms, key[clean]), minlength=len(terms))
        fits = (df >= max(LEAST_DF, LEAST_SHARE * n)) & (usual <= max(LEAST_DF, MOST_SHARE * np.count_nonzero(label == 0)))
        self.terms = terms[fits]
        self.ids, self.label, self.n = ids, label, n
        self.raw = (row, key, count)
        self.weight = np.zeros(len(self.terms))

    def place(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are in the vocabulary, and where."""
        if not len(self.terms):
            return np.zeros(len(key), bool), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.terms, key), len(self.terms) - 1)
        known = self.terms[at] == key
        return known, at[known]

    def build(self, df: np.ndarray, docs: int) -> Index:
        """Postings, once the documents that hold each term are counted over the whole corpus."""
        self.weight = np.log(max(docs, 1) / np.clip(df, 1, max(docs, 1))) + 1e-9
        row, key, count = self.raw
        known, term = self.place(key)
        row = row[known]
        value = (1 + np.log(count[known])) * self.weight[term]
        length = np.sqrt(np.bincount(row, value * value, self.n))
        value = value / length[row]
        order = np.lexsort((row, term))
        row, term, value = row[order], term[order], value[order]
        self.doc, self.value = row.astype(np.intp), value
        group = term * (self.n // BLOCK + 1) + row // BLOCK
        new = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, np.int64)
        self.entry_at = np.append(new, len(group))  # postings of each (term, block)
        self.entry_block = (row[new] // BLOCK).astype(np.int32)
        self.entry_max = np.maximum.reduceat(value, new) if len(new) else np.zeros(0)
        self.term_at = np.searchsorted(term[new], np.arange(len(self.terms) + 1))
        self.raw = None
        return self

    def nearest(self, term: np.ndarray, weight: np.ndarray, but: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of largest cosine above 0, largest first; ``but``: examples that take no part."""
        if not len(term):
            return np.zeros(0, np.int64), np.zeros(0)
        length = np.sqrt(weight @ weight)
        first, last = self.term_at[term], self.term_at[term + 1]
        entry = ranges(first, last)
        share = np.repeat(weight / length, last - first)
        block = self.entry_block[entry]
        bound = np.bincount(block, share * self.entry_max[entry], self.n // BLOCK + 1)
        order = np.argsort(-bound, kind="stable")
        order = order[:np.count_nonzero(bound)]
        cosine = np.zeros(self.n)
        chosen = np.zeros(len(bound), bool)
        chosen[order[:FIRST_BLOCKS]] = True
        rest = order[FIRST_BLOCKS:]
        floor = 0.0
        for turn in range(2):
            use = chosen[block]
            start, end = self.entry_at[entry[use]], self.entry_at[entry[use] + 1]
            at = ranges(start, end)
            cosine += np.bincount(self.doc[at], np.repeat(share[use], end - start) * self.value[at], self.n)
            if turn or not len(rest):
                break
            if but is not None:
                cosine[but] = 0
            if len(cosine) > NEAREST:
                floor = np.partition(cosine, len(cosine) - NEAREST)[len(cosine) - NEAREST]
            chosen[:] = False
            chosen[rest[bound[rest] >= floor - 1e-12]] = True
            if not chosen.any():
                break
        if but is not None:
            cosine[but] = 0
        if len(cosine) > NEAREST:
            floor = np.partition(cosine, len(cosine) - NEAREST)[len(cosine) - NEAREST]
        near = np.flatnonzero((cosine >= floor) & (cosine > 0))
        near = near[np.lexsort((near, -cosine[near]))][:NEAREST]
        return near, cosine[near]

    def vote(self, near: np.ndarray, cosine: np.ndarray, prior: float) -> float:
        """Share of class 1 among the neighbours by squared cosine, with one tenth of a vote for the prior."""
        w = cosine * cosine
        return float((w @ self.label[near] + 0.1 * prior) / (w.sum() + 0.1)) if len(near) else prior

    def queries(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Term places and weights of every text."""
        row, key, count = counted(texts)
        known, term = self.place(key)
        row, weight = row[known], (1 + np.log(count[known])) * self.weight[term]
        cuts = np.searchsorted(row, np.arange(len(texts) + 1))
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield term[a:b], weight[a:b]


def examples(docs: DataFrame, labels: DataFrame, bound: tuple[int, int]) -> tuple[Index, dict[int, float]]:
    """The index before counting, and the share of each class that it holds."""
    rows, share = labelled.sample(docs, labels, bound)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in flat.blocks(batch):
                row, key, count = counted(block.column("text"))
                cuts = np.searchsorted(row, np.arange(block.num_rows + 1))
                pairs = list(zip(cuts[:-1], cuts[1:]))
                yield pa.RecordBatch.from_arrays(
                    [block.column("doc_id"), block.column("label"), pa.array([key[a:b].tobytes() for a, b in pairs], pa.binary()),
                     pa.array([count[a:b].astype("<i4").tobytes() for a, b in pairs], pa.binary())], ["doc_id", "label", "terms", "counts"])

    got = rows.mapInArrow(encode, "doc_id BIGINT, label INT, terms BINARY, counts BINARY").toArrow()
    ids, label = np.array(got.column("doc_id").to_pylist(), np.int64), np.array(got.column("label").to_pylist(), np.int64)
    terms = [np.frombuffer(t, "<u8") for t in got.column("terms").to_pylist()]
    counts = [np.frombuffer(t, "<i4") for t in got.column("counts").to_pylist()]
    order = np.lexsort((ids, label))  # examples of a class lie together, which tightens the blocks' bounds
    size = [len(terms[i]) for i in order]
    empty = [np.zeros(0, np.uint64)]
    return Index(ids[order], label[order], np.repeat(np.arange(len(order)), size), np.concatenate(empty + [terms[i] for i in order]),
                 np.concatenate([np.zeros(0, np.int32)] + [counts[i] for i in order])), share


def document_frequency(docs: DataFrame, index: Index) -> tuple[np.ndarray, int]:
    """Documents that hold each term of the vocabulary, and documents in all, over the whole corpus."""
    sent = docs.sparkSession.sparkContext.broadcast(index.terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = sent.value
        total, rows = np.zeros(len(terms) + 1, np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for block in flat.blocks(batch):
                _, key, _ = counted(block.column("text"))
                if len(terms):
                    at = np.minimum(np.searchsorted(terms, key), len(terms) - 1)
                    total += np.bincount(at[terms[at] == key], minlength=len(terms) + 1)
        total[-1] = rows
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["term", "n"])

    per_task = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "term BIGINT, n BIGINT")
    got = per_task.groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(len(index.terms) + 1, np.int64)
    total[np.array(got.column("term"), np.int64)] = np.array(got.column("n"), np.int64)
    return total[:-1], int(total[-1])


def logit(v: np.ndarray) -> np.ndarray:
    v = np.clip(v, 1e-4, 1 - 1e-4)
    return np.log(v / (1 - v))


def calibrate(docs: DataFrame, labels: DataFrame, bound: tuple[int, int], index: Index, share: dict[int, float], prior: float):
    """Slope and shift from the votes of the examples, each without itself and its exact copies."""
    rows, _ = labelled.sample(docs, labels, bound)
    sent = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in batches:
            for block in flat.blocks(batch):
                votes = []
                for doc, (term, weight) in zip(block.column("doc_id").to_pylist(), index.queries(block.column("text"))):
                    near, cosine = index.nearest(term, weight, np.flatnonzero(index.ids == doc))
                    apart = cosine < 1 - 1e-9
                    votes.append(index.vote(near[apart], cosine[apart], prior))
                yield pa.RecordBatch.from_arrays([block.column("label"), pa.array(votes, pa.float64())], ["label", "vote"])

    got = rows.mapInArrow(run, "label INT, vote DOUBLE").toArrow()
    label, vote = np.array(got.column("label"), float), np.array(got.column("vote"), float)
    weight = np.array([1 / share[int(c)] for c in label])
    return labelled.logistic(logit(vote), label, weight / weight.mean())


def score_toxicity(docs: DataFrame, labels: DataFrame, bound: tuple[int, int] = EXAMPLES) -> DataFrame:
    """doc_id, held_out, score, predicted class and the nearest examples of every row of ``docs``."""
    held = labelled.fold("doc_id", FOLDS) == HELD_FOLD
    known = labelled.one_label_each(labels.where(~held), "toxic")
    index, share = examples(docs, known, bound)
    n = {c: int((index.label == c).sum()) for c in (0, 1)}
    full = {c: n[c] / share.get(c, 1.0) if share.get(c) else 0.0 for c in n}
    prior = (full[1] + 1) / (full[0] + full[1] + 2)
    index.build(*document_frequency(docs, index))
    both = n[0] > 0 and n[1] > 0
    slope, shift = calibrate(docs, known, bound, index, share, prior) if both else (0.0, float(logit(np.array(prior))))
    sent = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in batches:
            for block in flat.blocks(batch):
                votes, evidence = [], []
                for term, weight in index.queries(block.column("text")):
                    near, cosine = index.nearest(term, weight)
                    votes.append(index.vote(near, cosine, prior))
                    evidence.append([{"doc_id": int(index.ids[i]), "label": int(index.label[i]), "cosine": float(c)}
                                     for i, c in zip(near[:EVIDENCE], cosine[:EVIDENCE])])
                p = 1 / (1 + np.exp(-(slope * logit(np.array(votes, float)) + shift)))
                kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("label", pa.int32()), ("cosine", pa.float64())]))
                yield pa.RecordBatch.from_arrays(
                    [block.column("doc_id"), block.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32)),
                     pa.array(evidence, kind)], ["doc_id", "held_out", "score", "predicted", "evidence"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), held.alias("held_out"))
    return rows.mapInArrow(run, SCORES)
