"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact edit verification.

Texts are sequences of words (letters and digits, A-Z lower-cased).  The CGK random walk reads a window word by word and at each step
emits the current word and moves on or stays, as a random bit of that word and step says; two windows
a few edits apart fall into step again, so their embeddings differ in few places.  A repetition draws one
walk and samples some of its steps; windows that agree in all of them are candidates.  A walk has ``STEPS`` steps and so reads
about ten words: windows are not item-sized, but pieces of the item at all offsets.  Windows of the
documents start at every ``stride``-th word, those of the items at every word, so a leaked passage is met by several aligned windows.
The number of repetitions is set for each class of item lengths: it is raised until the shortest items of the class, with as many words
edited at random as the bound allows, are found at the target recall.  A class that no allowed number serves is searched exactly: its items
are cut into one piece more than there may be edits, and every place that holds a piece unchanged is a candidate.

Each candidate is verified: the item's words against the item-sized window of the document, with the
edit distance of the best substring, must be within a fifth of the item's words (similarity 0.8).

The benchmark is sent to the tasks in parts of bounded size, one pass over the documents each; texts stay where they are.

Defined cases: items with a null or empty text or fewer than five words are not searched; null and empty documents hold no
item; repeated items and documents are reported each; null ids stay null; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelyard.llm import flat

LEAST_WORDS = 5
EDIT_PERCENT = 20
STEPS, SAMPLED = 16, 3
TARGET_RECALL = 0.97
MOST_REPETITIONS = 24
LAST_CLASS = 12  # length class of all items of 60 words and more
COVER = 10  # words that the sampled steps reach as a rule
PART_BYTES = 4_000_000  # bound of the benchmark text sent at once
MASK_BITS = 20
HITS = "doc_id BIGINT, item_id BIGINT, distance INT, item_words INT, first_word BIGINT, end_word BIGINT"


class Walks:
    """The sampled places of the embedding of windows, for each repetition."""

    def __init__(self, repetitions: int, seed: int = 11):
        draw = np.random.default_rng(seed)
        self.salt = draw.integers(1, 1 << 63, MOST_REPETITIONS, dtype=np.uint64)[:repetitions]
        self.steps = [np.sort(draw.choice(STEPS, SAMPLED, replace=False)) for _ in range(MOST_REPETITIONS)][:repetitions]

    def keys(self, words: np.ndarray, start: np.ndarray, repetition: int) -> np.ndarray:
        """Key of the sampled steps of the walk from each start; ``words`` ends in STEPS words of padding."""
        moves = flat.mix(words ^ self.salt[repetition]).astype(np.uint16)  # one bit for each of the STEPS
        at = start.astype(np.int32)
        key = np.full(len(start), self.salt[repetition])
        steps = self.steps[repetition]
        for step in range(int(steps[-1]) + 1):
            if step in steps:
                key = flat.mix(key * flat.STEP + words.take(at))
            at += (moves.take(at) >> np.uint16(step)) & np.uint16(1)
        return key


def padded(words: np.ndarray) -> np.ndarray:
    return np.concatenate([words, np.zeros(STEPS + 1, np.uint64)])


def offsets_of(n: int) -> np.ndarray:
    return np.arange(max(1, n - COVER + 1))


def length_class(n: int) -> int:
    """Lengths of one class bear the same number of edits, so its shortest item is the hardest; long items make one class."""
    return min(n // (100 // EDIT_PERCENT), LAST_CLASS)


def repetitions_for(items: list[np.ndarray], recall: float, stride: int, trials: int = 400) -> int | None:
    """Repetitions at which items with as many random edits as the bound allows are met by a window of theirs at the target recall; None: no number allowed does."""
    draw = np.random.default_rng(5)
    walks = Walks(MOST_REPETITIONS)
    first = []
    for _ in range(trials):
        item = items[draw.integers(len(items))]
        edited = list(item)
        for _ in range(len(item) * EDIT_PERCENT // 100):
            at = draw.integers(len(edited))
            kind = draw.integers(3)
            if kind == 0:
                edited[at] = np.uint64(draw.integers(1, 1 << 62))
            elif kind == 1:
                edited.insert(at, np.uint64(draw.integers(1, 1 << 62)))
            else:
                edited.pop(at)
        lead = draw.integers(stride)
        text = np.concatenate([draw.integers(1, 1 << 62, lead, dtype=np.uint64), np.array(edited, np.uint64),
                               draw.integers(1, 1 << 62, STEPS, dtype=np.uint64)])
        found = MOST_REPETITIONS
        for r in range(MOST_REPETITIONS):
            own = walks.keys(padded(item), offsets_of(len(item)), r)
            met = walks.keys(padded(text), np.arange(0, lead + len(edited), stride), r)
            if np.intersect1d(own, met).size:
                found = r
                break
        first.append(found)
    need = int(np.quantile(first, recall, method="higher")) + 1
    return need if need <= MOST_REPETITIONS else None


def pieces_of(n: int) -> list[tuple[int, int]]:
    """Offset and length of one piece more than there may be edits, so that every place within the bound holds one of them unchanged."""
    cuts = np.linspace(0, n, n * EDIT_PERCENT // 100 + 2).astype(int).tolist()
    return [(a, b - a) for a, b in zip(cuts[:-1], cuts[1:])]


def runs(words: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    """Key of the ``size`` words from each start; ``words`` is padded."""
    key = np.full(len(start), size, np.uint64)
    for k in range(size):
        key = flat.mix(key * flat.STEP + words[start + k])
    return key


def distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Least edit distance of the item to a substring of the text, and where the first best one ends (bit-parallel columns)."""
    n = len(item)
    where: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        where[w] = where.get(w, 0) | (1 << i)
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score = full, 0, n
    best, end = n, 0
    for j, w in enumerate(text.tolist()):
        same = where.get(w, 0)
        x = same | down
        zero = (((x & up) + up) ^ up) | x
        plus, minus = down | (full & ~(zero | up)), up & zero
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus, minus = (plus << 1) & full, (minus << 1) & full
        up, down = minus | (full & ~(zero | plus)), plus & zero
        if score < best:
            best, end = score, j + 1
            if best == 0:
                break
    return best, end


class Items:
    """Benchmark items of one part, with the keys of all their windows."""

    def __init__(self, ids: list[int], texts: list[str | None]):
        words = flat.Words(pa.array(texts, pa.string()), gaps=flat.SIGNS)
        every = [words.key[a:b] for a, b in zip(words.first[:-1], words.first[1:])]
        self.ids = [i for i, w in zip(ids, every) if len(w) >= LEAST_WORDS]
        self.words = [w for w in every if len(w) >= LEAST_WORDS]
        self.sets = [set(w.tolist()) for w in self.words]
        by_class: dict[int, list[np.ndarray]] = {}
        for w in self.words:
            by_class.setdefault(length_class(len(w)), []).append(w)
        shortest = {c: min(map(len, ws)) for c, ws in by_class.items()}
        self.stride = int(np.clip((min(shortest.values(), default=0) - COVER + 1) // 2, 1, 4))
        need = {c: repetitions_for([w for w in ws if len(w) == shortest[c]], TARGET_RECALL, self.stride) for c, ws in by_class.items()}
        self.repetitions = [need[length_class(len(w))] for w in self.words]
        self.walks = Walks(max((n for n in need.values() if n), default=0))
        self.tables = [self.table(r) for r in range(len(self.walks.salt))]
        self.exact = self.exact_tables()

    def table(self, r: int):
        use = [i for i, n in enumerate(self.repetitions) if n and n > r]
        own = [self.words[i] for i in use]
        owner = np.repeat(use, [len(offsets_of(len(w))) for w in own])
        offset = np.concatenate([offsets_of(len(w)) for w in own])
        return self.sorted(np.concatenate([self.walks.keys(padded(w), offsets_of(len(w)), r) for w in own]), owner, offset)

    def exact_tables(self) -> dict[int, tuple]:
        """By length, the pieces of the items for which no number of repetitions reaches the target."""
        pieces: dict[int, list[tuple[int, int]]] = {}
        for i, n in enumerate(self.repetitions):
            for offset, size in pieces_of(len(self.words[i])) if n is None else []:
                pieces.setdefault(size, []).append((i, offset))
        return {size: self.sorted(np.concatenate([runs(self.words[i], np.array([offset]), size) for i, offset in of]),
                                  np.array([i for i, _ in of]), np.array([offset for _, offset in of])) for size, of in pieces.items()}

    @staticmethod
    def sorted(key: np.ndarray, owner: np.ndarray, offset: np.ndarray):
        order = np.argsort(key, kind="stable")
        mask = np.zeros(1 << MASK_BITS, bool)
        mask[(key >> np.uint64(64 - MASK_BITS)).astype(np.int64)] = True
        return key[order], owner[order], offset[order], mask

    def hits(self, texts: pa.Array) -> list[tuple[int, int, int, int, int, int]]:
        """(row, item, distance, words of the item, first word, end word): the best place of every item found in every text."""
        words = flat.Words(texts, gaps=flat.SIGNS)
        if not len(words.key) or not self.words:
            return []
        own = padded(words.key)
        every = np.arange(len(words.key))
        start = np.flatnonzero((every - words.first[words.row]) % self.stride == 0)
        found = []

        def meet(key: np.ndarray, start: np.ndarray, table: tuple) -> None:
            keys, owner, offset, mask = table
            maybe = np.flatnonzero(mask[(key >> np.uint64(64 - MASK_BITS)).astype(np.int64)])
            low, high = np.searchsorted(keys, key[maybe]), np.searchsorted(keys, key[maybe], "right")
            size = high - low
            at = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            begin = np.repeat(start[maybe], size)
            found.append(np.stack([words.row[begin], owner[at], begin - offset[at]], axis=1))

        for r, table in enumerate(self.tables):
            meet(self.walks.keys(own, start, r), start, table)
        for size, table in self.exact.items():
            meet(runs(own, every, size), every, table)
        found = np.unique(np.concatenate(found), axis=0)
        best: dict[tuple[int, int], tuple] = {}
        covered: dict[tuple[int, int], int] = {}
        for row, item, begin in found.tolist():
            n = len(self.words[item])
            most = n * EDIT_PERCENT // 100
            first, last = int(words.first[row]), int(words.first[row + 1])
            if covered.get((row, item), -1) >= begin + n + most or best.get((row, item), (n,))[0] == 0:
                continue  # that region has been compared
            a, b = max(first, begin - most - n // 2), min(last, begin + n + most + n // 2)
            covered[row, item] = b
            if len(self.sets[item].intersection(words.key[a:b].tolist())) < len(self.sets[item]) - most:
                continue  # an edit takes away one word at most
            d, end = distance(self.words[item], words.key[a:b])
            if d <= most and d < best.get((row, item), (n + 1,))[0]:
                _, length = distance(self.words[item][::-1], words.key[a:a + end][::-1])
                best[row, item] = (d, n, a + end - length - first, a + end - first)
        return [(row, item, *what) for (row, item), what in best.items()]


def parts(benchmark: DataFrame) -> Iterator[Items]:
    """The benchmark in parts of bounded size."""
    rows = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    size = rows.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    n = -(-size // PART_BYTES)
    for i in range(n):
        got = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).orderBy("item_id", "text").collect() if n > 1 else rows.orderBy(
            "item_id", "text").collect()
        items = Items([r[0] for r in got], [r[1] for r in got])
        if items.words:
            yield items


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every document and item that it holds within the edit bound, with the best place."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for items in parts(benchmark):
        sent = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names = [part.split()[0] for part in HITS.split(", ")]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            for batch in batches:
                for block in flat.blocks(batch, limit=flat.SMALL_BYTES):
                    ids = block.column("doc_id")
                    hits = sent.value.hits(block.column("text"))
                    columns = list(zip(*((ids[row].as_py(), sent.value.ids[item], *rest) for row, item, *rest in hits))) or [()] * 6
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)

        part = rows.mapInArrow(run, HITS)
        out = part if out is None else out.union(part)
    return spark.createDataFrame([], HITS) if out is None else out


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns."""
    for items in parts(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block in flat.blocks(batch, limit=flat.SMALL_BYTES):
                    clean = np.ones(block.num_rows, bool)
                    clean[[hit[0] for hit in sent.value.hits(block.column("text"))]] = False
                    yield block.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
