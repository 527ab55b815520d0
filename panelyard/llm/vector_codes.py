"""Vector code compression: a vector becomes one byte for each of its parts, the index of the nearest entry in that part's codebook.

Components become integers, vectors are cut into equal consecutive parts, and codebooks are fitted by rounds of assigning parts and moving
entries to the floor of their mean.  All arithmetic is on integers, so results do not depend on the order of rows or tasks.

Nearest entries come from a lexicographic trie over the distinct parts of a run of vectors: a node keeps the squared distances of its prefix to
all entries, which all parts below share; a leaf takes the first least distance, and its number of copies weighs its sums.  The walk is depth first over
subtrees; one with few leaves is finished level by level in numpy.  Vectors never move: a round is one pass over the table whose tasks give one row
for each part and entry, and the codebooks (parts x entries, whatever the table's size) go to the tasks.

Defined cases: rows whose vector is null, or holds null or non-finite components, are dropped; so are vectors of another length than most (ties: the
shorter length) and vectors with integers so large that an error could pass 64 bits.  When the length is no multiple of the parts, part p runs from
p * length // parts on, so parts may be empty (code 00).  Null ids stand last in the order of ids, equal ids are ordered by their vectors; with fewer vectors
than entries all start entries are theirs; repeated rows are coded each; a label's error beyond 64 bits is null; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelyard.session import stored

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
RUN_VALUES = 1 << 20  # components in the vectors that share tries; bounds memory only
SUBTREE = 4096  # leaves below which a subtree is finished level by level
HOT_LABEL = 1000  # a label with more than one in so many rows is hot, so there are fewer hot labels than that


@dataclass(frozen=True)
class Codebooks:
    """``entries[p]`` holds the entries of part p, one row each."""

    entries: tuple[np.ndarray, ...]

    def sha256(self) -> str:
        numbers = (str(int(x)) for book in self.entries for entry in book for x in entry)
        return hashlib.sha256(",".join(numbers).encode()).hexdigest()

    def decode(self, code: str) -> np.ndarray:
        """The integer vector that stands for a code."""
        return np.concatenate([book[int(code[2 * p:2 * p + 2], 16)] for p, book in enumerate(self.entries)])


def bounds(length: int, parts: int) -> list[tuple[int, int]]:
    return [(p * length // parts, (p + 1) * length // parts) for p in range(parts)]


def kept(table: DataFrame) -> tuple[DataFrame, int]:
    """vec_id, label, vec (doubles) of the rows that take part, and the length of their vectors (-1: there are none)."""
    vec = F.transform("embedding", lambda x: x.cast("double"))
    rows = table.select(F.col("vec_id").cast("bigint").alias("vec_id"), "label", vec.alias("vec")).where(F.col("vec").isNotNull())
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(~F.coalesce(bad, F.lit(True)))
    most = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").head()
    if most is None:
        return rows, -1
    length = most["n"]
    limit = math.isqrt((2**63 - 1) // max(length, 1)) // 2 / SCALE
    return rows.where((F.size("vec") == length) & F.forall("vec", lambda x: F.abs(x) < limit)), length


def integers(column: pa.Array, length: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return np.floor(values * SCALE).astype(np.int64).reshape(len(column), length)


def first_vectors(rows: DataFrame, length: int, entries: int, parts: int) -> Codebooks:
    """The codebooks of the rows of smallest id."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vec").limit(entries).select("vec").collect()
    points = np.floor(np.array([r["vec"] for r in first], float).reshape(len(first), length) * SCALE).astype(np.int64)
    return Codebooks(tuple(points[:, a:b] for a, b in bounds(length, parts)))


def distinct_parts(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct rows in lexicographic order, how often each occurs, and where each given row went."""
    order = np.lexsort(parts.T[::-1]) if parts.shape[1] else np.arange(len(parts))
    ranked = parts[order]
    fresh = np.ones(len(parts), bool)
    fresh[1:] = (ranked[1:] != ranked[:-1]).any(1)
    leaf = np.cumsum(fresh) - 1
    where = np.empty(len(parts), np.int64)
    where[order] = leaf
    return ranked[fresh], np.bincount(leaf), where


def walk(leaves: np.ndarray, entries: np.ndarray, subtree: int = SUBTREE) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (the lower of equals) and squared distance of every leaf of the trie over sorted distinct ``leaves``."""
    n, depths = leaves.shape
    index, distance = np.zeros(n, np.int64), np.zeros(n, np.int64)
    branch = np.zeros(n, np.int64)  # the depth at which a leaf leaves the path of the one before it
    branch[1:] = (leaves[1:] != leaves[:-1]).argmax(1) if depths else 0

    def level(heads: np.ndarray, depth: int, shared: np.ndarray) -> np.ndarray:
        return shared + (leaves[heads, depth][:, None] - entries[:, depth]) ** 2

    stack = [(0, n, 0, np.zeros(len(entries), np.int64))]
    while stack:
        low, high, depth, shared = stack.pop()  # leaves low to high share a prefix of this depth
        if high - low <= subtree or depth == depths:
            heads, sums = np.array([low]), shared[None]
            for d in range(depth, depths):
                below = low + np.flatnonzero(branch[low:high] <= d)
                below = below if below[:1] == low else np.concatenate([[low], below])
                sums = level(below, d, sums[np.searchsorted(heads, below, "right") - 1])
                heads = below
            index[low:high], distance[low:high] = sums.argmin(1), sums.min(1)
            continue
        heads = low + np.flatnonzero(branch[low:high] <= depth)
        heads = heads if heads[:1] == low else np.concatenate([[low], heads])
        ends = np.append(heads[1:], high)
        below = level(heads, depth, shared)
        groups, a = [], 0
        while a < len(heads):  # small neighbours go together, still under the shared prefix
            b = max(a + 1, int(np.searchsorted(ends, heads[a] + subtree, "right")))
            one = b == a + 1 and ends[a] - heads[a] > subtree
            groups.append((int(heads[a]), int(ends[b - 1]), depth + 1, below[a]) if one else (int(heads[a]), int(ends[b - 1]), depth, shared))
            a = b
        stack.extend(reversed(groups))
    return index, distance


def runs(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    step = max(1, RUN_VALUES // max(length, 1))
    for batch in batches:
        for a in range(0, batch.num_rows, step):
            run = batch.slice(a, step)
            yield run, integers(run.column("vec"), length)


def moved(rows: DataFrame, length: int, books: Codebooks) -> Codebooks:
    """One round: assign every part, then move each used entry to the floor of its parts' mean."""
    cuts = bounds(length, len(books.entries))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(book.shape, np.int64) for book in books.entries]
        count = [np.zeros(len(book), np.int64) for book in books.entries]
        for _, points in runs(batches, length):
            for p, (a, b) in enumerate(cuts):
                leaves, copies, _ = distinct_parts(points[:, a:b])
                nearest, _ = walk(leaves, books.entries[p])
                np.add.at(total[p], nearest, leaves * copies[:, None])
                np.add.at(count[p], nearest, copies)
        out = [(p, e, int(count[p][e]), total[p][e]) for p in range(len(cuts)) for e in np.flatnonzero(count[p])]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.int64()),
             pa.array([r[3] for r in out], pa.list_(pa.int64()))], names=["part", "entry", "n", "total"])

    found = rows.select("vec").mapInArrow(sums, "part INT, entry INT, n BIGINT, total ARRAY<BIGINT>")
    widest = max(b - a for a, b in cuts)
    found = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(
        F.sum(F.get("total", F.lit(d)).cast("decimal(38,0)")).alias(f"total{d}") for d in range(widest)))
    entries = [book.copy() for book in books.entries]
    for r in found.collect():  # parts x entries at most
        a, b = cuts[r["part"]]
        entries[r["part"]][r["entry"]] = [int(r[f"total{d}"]) // r["n"] for d in range(b - a)]
    return Codebooks(tuple(entries))


def fit_codebooks(rows: DataFrame, length: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    books = first_vectors(rows, length, entries, parts)
    for _ in range(rounds):
        books = moved(rows, length, books)
    return books


def encoded(rows: DataFrame, length: int, books: Codebooks) -> DataFrame:
    """vec_id, label, code, error of every row."""
    cuts = bounds(length, len(books.entries))
    digits = np.array([f"{i:02x}" for i in range(256)])
    label = rows.schema["label"].dataType.simpleString()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run, points in runs(batches, length):
            codes, error = np.full(len(points), "", f"<U{2 * len(cuts)}"), np.zeros(len(points), np.int64)
            for p, (a, b) in enumerate(cuts):
                leaves, _, where = distinct_parts(points[:, a:b])
                nearest, distance = walk(leaves, books.entries[p])
                codes = np.char.add(codes, digits[nearest[where]])
                error += distance[where]
            yield pa.RecordBatch.from_arrays([run.column("vec_id"), run.column("label"), pa.array(codes.tolist(), pa.string()), pa.array(error)],
                                             names=["vec_id", "label", "code", "error"])

    return rows.mapInArrow(code, f"vec_id BIGINT, label {label}, code STRING, error BIGINT")


def with_label_errors(codes: DataFrame) -> DataFrame:
    """``codes`` with ``label_error``, the sum over equal labels.

    Hot labels are few by count, so they are broadcast; the rows of all others, each with a small share, meet their sum by a shuffle.
    """
    sums = codes.groupBy("label").agg(F.try_sum("error").alias("label_error"), F.count("*").alias("n"))
    n = codes.count()
    sums = stored(sums.withColumn("hot", F.col("n") * HOT_LABEL > n).withColumnRenamed("label", "of_label"), "labels")
    same = F.col("label").eqNullSafe(F.col("of_label"))
    met = codes.join(F.broadcast(sums.where("hot")), same, "left")
    hot = met.where("hot").drop("of_label", "n", "hot")
    cold = met.where("hot IS NULL").drop("of_label", "label_error", "n", "hot").join(sums.where("NOT hot"), same).drop("of_label", "n", "hot")
    return hot.unionByName(cold)


def compress(table: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every kept row."""
    if not 1 <= entries <= 256 or parts < 1:
        raise ValueError("a code has two hex digits for each part: 1 to 256 entries, one part at least")
    rows, length = kept(table)
    if length < 0:
        return table.sparkSession.createDataFrame([], "vec_id BIGINT, code STRING, error BIGINT, label_error BIGINT, codebooks_sha256 STRING")
    books = fit_codebooks(rows, length, parts, entries, rounds)
    codes = with_label_errors(stored(encoded(rows, length, books), "codes"))
    return codes.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
