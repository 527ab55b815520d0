"""Whole columns of texts as one byte array: words, hashes of byte ranges, and shingles without a loop over rows.

Everything here works on one bounded block of rows inside a task.  A range hash is a polynomial
over random byte values modulo 2**64, so the hash of any range follows from two running sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_ROWS = 4_096  # rows of a block at most, so that row and key fit one integer
KEY_BITS = 52
BLOCK_BYTES = 2_000_000  # text bytes handled at once; a longer single text is a block of its own
SMALL_BYTES = 500_000  # the same for work that holds some hundred bytes for each byte of text
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
BYTE_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
SIGNS = np.ones(256, bool)  # white space and every other byte below 128 that is no letter or digit
SIGNS[48:58] = SIGNS[65:91] = SIGNS[97:123] = SIGNS[128:] = False

_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1); kept up to the next power of two, because every block needs them."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(1 << max(16, (n - 1).bit_length()), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over all 64 output bits."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def blocks(batch: pa.RecordBatch, column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices whose texts hold at most ``limit`` bytes (one row at least), and at most BLOCK_ROWS rows."""
    size = lengths(batch.column(column))
    start, held = 0, 0
    for i, n in enumerate(size):
        if i > start and (held + n > limit or i - start == BLOCK_ROWS):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def lengths(texts: pa.Array) -> np.ndarray:
    return np.diff(offsets(texts))


def offsets(texts: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    return np.frombuffer(texts.buffers()[1], kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the column and the bounds of each row; null counts as empty."""
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "") if texts.null_count else texts
    at = offsets(texts)
    data = texts.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0]:at[-1]], at - at[0]


class RangeHash:
    """hash(start, end) for arrays of byte ranges of one byte array."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_VALUES[data] * powers(BASE, len(data)), out=self.sums[1:])
        self.back = powers(INVERSE, len(data) + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.back[start]


class Words:
    """The words (runs of other than white space) of every row of a text column.

    ``row``: row of each word; ``key``: its hash; ``first``: index of the first word of each row
    and one past the end.  ``fold`` lower-cases A-Z first; ``gaps`` says which bytes stand between words.
    """

    def __init__(self, texts: pa.Array, fold: bool = True, gaps: np.ndarray = SPACE):
        data, at = raw(texts)
        if fold:
            data = LOWER[data]
        self.data, self.at = data, at
        n = len(data)
        solid = ~gaps[data]
        edge = np.zeros(n + 1, bool)  # a word also ends where its row ends
        edge[at] = True
        before = np.zeros(n, bool)
        before[1:] = solid[:-1]
        after = np.zeros(n, bool)
        after[:-1] = solid[1:]
        self.start = np.flatnonzero(solid & (~before | edge[:n]))
        self.end = np.flatnonzero(solid & (~after | edge[1:])) + 1
        self.key = mix(RangeHash(data)(self.start, self.end) + (self.end - self.start).astype(np.uint64))
        self.first = np.searchsorted(self.start, at)
        self.row = np.repeat(np.arange(len(at) - 1), np.diff(self.first))

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Row and key of each distinct shingle, sorted by row and key; a row with fewer words has one of them all."""
        return distinct(*shingled(self.key, self.first, size))


STEP = np.uint64(0xA24BAED4963EE407)


def shingled(key: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each run of ``size`` keys within a row, in order; short rows give one run of all their keys."""
    count = np.diff(first)
    runs = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    row = np.repeat(np.arange(len(count)), runs)
    head = np.repeat(first[:-1], runs) + (np.arange(len(row)) - np.repeat(np.cumsum(runs) - runs, runs))
    short = count[row] < size
    got = np.zeros(len(row), np.uint64)
    padded = np.concatenate([key, np.zeros(size, np.uint64)])
    last = first[1:][row]
    for k in range(size):
        inside = ~short | (head + k < last)
        got = np.where(inside, mix(got * STEP + padded[np.minimum(head + k, len(key))]), got)
    return row, got


def distinct(row: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each (row, key) once, in order.  Keys are cut to their upper KEY_BITS bits, which name a shingle from here on."""
    joined = np.sort((row.astype(np.uint64) << np.uint64(KEY_BITS)) | (key >> np.uint64(64 - KEY_BITS)))
    joined = joined[np.append(True, joined[1:] != joined[:-1])] if len(joined) else joined
    return (joined >> np.uint64(KEY_BITS)).astype(np.int64), joined & np.uint64((1 << KEY_BITS) - 1)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
