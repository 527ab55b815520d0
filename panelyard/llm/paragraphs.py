"""Repeated paragraphs by MinHash banding, verified on exact Jaccard similarity, and removed by components.

A paragraph is a line; a line of more than ``LONG`` words is cut after its sentences, and a sentence still longer where a hash of two
neighbouring words says so (one place in ``CUT_EVERY``), so that a passage inside a long line is found as well.  A long line is also cut a second time, into units
of ``LEAST`` to 2 * LEAST - 1 words by the words nearby (see ``joined``), which join short sentences and split longer ones; so every word of
it is compared, and a passage that starts in mid-sentence is found.  Units of the two cuttings overlap and are compared only with units of
their own cutting; what to remove of a text is the union of the removed ranges of bytes.  Other paragraphs of fewer than ``LEAST`` words are not compared.  Words are runs of letters and digits, A-Z lower-cased; a paragraph
is the set of its five-word shingles, and two are near when they share at least 80 % of them.

Bands and rows are tuned: the least number of hash values at which a pair at the threshold collides with the
target recall.  Paragraphs that collide in a band make a list; the pairs of short lists are verified one by one, and the paragraphs of
longer lists in blocks of bounded size, as in the Jaccard join, so that a large group of near copies never lists its pairs.  Equal
sets are one class from the start.  In each component the earliest paragraph, by doc_id and place, stays.

Defined cases: null and empty texts have no paragraph; rows without id are not compared; repeated ids with different texts count as
one document whose paragraphs are told apart by place and content; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from panelyard.llm import flat, sieve
from panelyard.llm.components import components
from panelyard.llm.jaccard import PACKED, meetings, packed, searched, shared_lists_packed, star_pairs
from panelyard.session import stored

LONG, LEAST = 40, 8
CUT_EVERY = 12
SHINGLE, PERCENT = 5, 80
TARGET_RECALL = 0.99
PART_POSTINGS = 200_000  # postings of a part of the lists, about; a part is the least that a task takes
STOP = np.zeros(256, bool)
STOP[list(b".!?")] = True
SALTS = np.random.default_rng(17).integers(1, 1 << 63, 256, dtype=np.uint64)


def tuned(percent: int = PERCENT, recall: float = TARGET_RECALL, most: int = 128) -> tuple[int, int]:
    """Bands and rows: of all that reach the recall, those of two rows at least with the fewest hash values."""
    t, best = percent / 100, None
    for rows in range(2, 9):
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - t**rows)))
        if bands * rows <= most and (best is None or bands * rows < best[0] * best[1]):
            best = (bands, rows)
    if best is None:
        raise ValueError("no banding reaches the recall within the number of hash values")
    return best


def joined(new_line: np.ndarray, line: np.ndarray, pair: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Which words begin a unit inside a long line, by the second cutting.

    Places are taken in the order of a hash of the two words beside them, ends of sentences first, unless one taken before, or an end of
    the line, is less than ``LEAST`` words away.  So units have ``LEAST`` to 2 * LEAST - 1 words, and which places are taken depends on the words nearby.
    Places that come before all others near them are taken at once, the few that are left then one by one.
    """
    length, head = np.bincount(line), np.flatnonzero(new_line)
    place = np.arange(len(line)) - head[line]
    may = np.flatnonzero((length[line] > LONG) & (place >= LEAST) & (length[line] - place >= LEAST))
    low = np.uint64(len(line).bit_length())  # of equal pairs the first goes first, so the place stands below the hash
    rank = np.full(len(line) + 2 * LEAST, ~np.uint64(0))  # of place i at i + LEAST
    rank[may + LEAST] = (pair[may - 1] >> (low + np.uint64(1)) << low) | (~stop[may - 1]).astype(np.uint64) << np.uint64(63) | may.astype(np.uint64)
    after = least_after(rank, LEAST)  # of the place and the LEAST - 1 next ones
    at_once = may[np.minimum(after[may + LEAST], after[may + 1]) == rank[may + LEAST]]
    near = np.zeros(len(line) + 1, np.int64)
    near[at_once - LEAST + 1] += 1
    near[at_once + LEAST] -= 1
    near = (np.cumsum(near) > 0).view(np.uint8)
    left = np.sort(rank[may[near[may] == 0] + LEAST]) & ((np.uint64(1) << low) - np.uint64(1))
    taken, near = np.zeros(len(line), bool), bytearray(near)
    taken[at_once] = True
    wide = b"\1" * (2 * LEAST - 1)
    for i in left.tolist():
        if not near[i]:
            taken[i] = True
            near[i - LEAST + 1:i + LEAST] = wide
    return taken


def least_after(x: np.ndarray, width: int) -> np.ndarray:
    """The least of so many values from each place on, as far as there are."""
    x, have = x.copy(), 1
    while have < width:
        step = min(have, width - have)
        x[:-step] = np.minimum(x[:-step], x[step:])
        have += step
    return x


def distinct(unit: np.ndarray, key: np.ndarray, units: int) -> tuple[np.ndarray, np.ndarray]:
    """Each (unit, key) once, in order.  Units come in order and keys have KEY_BITS bits, so both fit one integer for so many units at a time."""
    step, bits = 1 << 64 - flat.KEY_BITS, np.uint64(flat.KEY_BITS)
    cuts = np.searchsorted(unit, np.arange(0, units + step, step))
    out_unit, out_key = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
        both = np.sort((unit[a:b] - k * step).astype(np.uint64) << bits | key[a:b])
        both = both[np.append(True, both[1:] != both[:-1])] if len(both) else both
        out_unit.append((both >> bits).astype(np.int64) + k * step)
        out_key.append(both & np.uint64((1 << flat.KEY_BITS) - 1))
    return np.concatenate(out_unit), np.concatenate(out_key)


def run_keys(key: np.ndarray) -> np.ndarray:
    """The hash of ``SHINGLE`` words from each word on, as ``flat.shingled`` has it."""
    runs = max(0, len(key) - SHINGLE + 1)
    got = np.zeros(runs, np.uint64)
    for k in range(SHINGLE):
        got = flat.mix(got * flat.STEP + key[k:k + runs])
    return got


def keys_of_sets(key: np.ndarray, size: np.ndarray, layer: np.ndarray) -> np.ndarray:
    """The hash of every set of shingles and its cutting; the sets follow one another and none is empty."""
    sums = np.add.reduceat(flat.mix(key + np.uint64(0x2545F491)), np.cumsum(size) - size)
    return flat.signed(flat.mix(sums + size.astype(np.uint64) + layer.astype(np.uint64) * flat.STEP))


class Paragraphs:
    """The paragraphs of a block of texts with their shingle sets.

    ``row``, ``place`` (number within the row, by start), ``layer`` (0: lines and sentences, 1: second cutting of long lines), ``start`` and ``end`` (bytes within the text), ``words``; ``unit`` and ``key``: paragraph
    and shingle of each distinct shingle, in order; ``size`` and ``set_key`` of each set.
    """

    def __init__(self, texts: pa.Array):
        words = flat.Words(texts, gaps=flat.SIGNS)
        n = len(words.key)
        data = words.data
        empty = np.zeros(0, np.int64)
        self.row = self.place = self.start = self.end = self.words = self.layer = self.unit = self.size = empty
        self.key, self.set_key = np.zeros(0, np.uint64), empty
        if not n:
            return
        lines = np.concatenate([[0], np.cumsum(data == 10)])
        stop = np.zeros(len(data), bool)
        stop[:-1] = STOP[data[:-1]] & flat.SPACE[data[1:]]
        stops = np.concatenate([[0], np.cumsum(stop)])
        gap_from, gap_to = words.end[:-1], words.start[1:]
        new_line = np.append(True, (lines[gap_to] > lines[gap_from]) | (words.row[1:] != words.row[:-1]))
        line = np.cumsum(new_line) - 1
        long = np.bincount(line)[line] > LONG
        new = new_line | np.append(False, stops[gap_to] > stops[gap_from]) & long
        piece = np.cumsum(new) - 1
        long = np.bincount(piece)[piece] > LONG
        pair = flat.mix(words.key[:-1] * flat.STEP + words.key[1:])
        new = new | np.append(False, pair % np.uint64(CUT_EVERY) == 0) & long
        first = [np.append(np.flatnonzero(new), n), np.append(np.flatnonzero(new_line | joined(new_line, line, pair, stops[gap_to] > stops[gap_from])), n)]
        head, last = np.concatenate([f[:-1] for f in first]), np.concatenate([f[1:] - 1 for f in first])
        layer = np.repeat([0, 1], [len(f) - 1 for f in first])
        count = last + 1 - head
        row = words.row[head]
        keep = count >= LEAST
        keep[layer == 1] &= np.bincount(line)[line[head[layer == 1]]] > LONG  # a line that isn't cut is compared once
        slot = np.full(len(head), -1)
        slot[keep] = np.arange(np.count_nonzero(keep))
        runs = run_keys(words.key) >> np.uint64(64 - flat.KEY_BITS)  # the same for both cuttings
        many = np.where(keep, count - SHINGLE + 1, 0)  # a paragraph has more words than a shingle
        unit = np.repeat(slot, many)
        key = runs[np.arange(len(unit)) + np.repeat(head - (np.cumsum(many) - many), many)]
        head, last, self.layer, self.row, self.words = head[keep], last[keep], layer[keep], row[keep], count[keep]
        turn = np.lexsort((self.layer, head))
        self.place = np.empty(len(head), np.int64)
        self.place[turn] = np.arange(len(head)) - np.searchsorted(self.row[turn], self.row[turn])
        self.start, self.end = words.start[head] - words.at[self.row], words.end[last] - words.at[self.row]
        self.unit, self.key = distinct(unit, key, len(head))
        self.size = np.bincount(self.unit, minlength=len(head))
        if len(head):
            self.set_key = keys_of_sets(self.key, self.size, self.layer)

    def bands(self, bands: int, rows: int) -> list[np.ndarray]:
        """The key of every paragraph in each band."""
        if not len(self.row):
            return []
        cuts = np.cumsum(self.size) - self.size
        out = []
        for b in range(bands):
            key = SALTS[b] + self.layer.astype(np.uint64)
            for r in range(rows):
                key = flat.mix(key * flat.STEP + np.minimum.reduceat(flat.mix(self.key ^ SALTS[b * rows + r]), cuts))
            out.append(flat.signed(key))
        return out


def listed(docs: DataFrame) -> DataFrame:
    """Every compared paragraph: doc_id, place, first_byte, end_byte, n_words, n, set_key."""
    names = ["doc_id", "place", "first_byte", "end_byte", "n_words", "n", "set_key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in flat.blocks(batch, limit=flat.SMALL_BYTES):
                p = Paragraphs(block.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [block.column("doc_id").take(pa.array(p.row)), *(pa.array(x.astype(np.int32)) for x in (p.place, p.start, p.end, p.words, p.size)),
                     pa.array(p.set_key)], names)

    return docs.mapInArrow(run, "doc_id BIGINT, place INT, first_byte INT, end_byte INT, n_words INT, n INT, set_key BIGINT")


def collisions(docs: DataFrame, bands: int, rows: int, parts: int) -> DataFrame:
    """h, n_late (twice the size: all count alike), set_key of every band of every paragraph, each set once a block, ``packed`` in so many parts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in flat.blocks(batch):
                keys, sizes, sets = [], [], []
                for small in flat.blocks(block, limit=flat.SMALL_BYTES):  # of little memory each, and packed together
                    p = Paragraphs(small.column("text"))
                    if len(p.row):
                        keys.append(np.stack(p.bands(bands, rows)))
                        sizes.append(2 * p.size)
                        sets.append(p.set_key)
                if keys:
                    own, once = np.unique(np.concatenate(sets), return_index=True)
                    keys = np.concatenate(keys, axis=1)[:, once].ravel()
                    yield packed(keys, np.tile(np.concatenate(sizes)[once], bands), np.tile(own, bands), parts)

    return docs.mapInArrow(run, PACKED)


def shingles_of(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """set_key, shingles (packed) of one paragraph of every asked set.  ``asked``: set_key, doc_id and bytes (``ranged``) of a paragraph that has it.

    Only the asked bytes are read again.  A document whose id is repeated with another text may have another set there, which is left out.
    """
    wanted = asked.groupBy("doc_id").agg(F.collect_list(F.struct("set_key", "bytes")).alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in flat.blocks(batch, limit=flat.SMALL_BYTES):
                data, at = flat.raw(block.column("text"))
                lists = block.column("wanted")
                row, (ask, place) = np.repeat(np.arange(block.num_rows), lists.value_lengths().to_numpy()), lists.flatten().flatten()
                ask, place = ask.to_numpy(), place.to_numpy()
                first, end = at[row] + (place >> 32), at[row] + (place & 0xFFFFFFFF)
                inside = end <= at[row + 1]
                texts = pa.array([data[a:b].tobytes() for a, b in zip(first[inside].tolist(), end[inside].tolist())], pa.binary())
                yield asked_sets(texts, ask[inside])

    wanted = stored(wanted, "asked")
    return sieve.likely(docs, "doc_id", wanted).join(wanted, "doc_id").mapInArrow(run, "set_key BIGINT, shingles BINARY").dropDuplicates(["set_key"])


def ranged(first: str, end: str) -> Column:
    """Both bounds as one integer."""
    return F.shiftleft(F.col(first).cast("bigint"), 32).bitwiseOR(F.col(end).cast("bigint"))


def asked_sets(texts: pa.Array, ask: np.ndarray) -> pa.RecordBatch:
    """set_key, shingles of those texts of whole paragraphs that have the set asked for, in either cutting."""
    row, key = flat.Words(texts, gaps=flat.SIGNS).shingles(SHINGLE)
    size = np.bincount(row, minlength=len(texts))
    some = np.flatnonzero(size)
    high = np.cumsum(size)
    if len(some):
        same = [keys_of_sets(key, size[some], np.full(len(some), layer)) == ask[some] for layer in (0, 1)]
        some = some[same[0] | same[1]]
    return pa.RecordBatch.from_arrays(
        [pa.array(ask[some]), pa.array([key[b - n:b].tobytes() for b, n in zip(high[some].tolist(), size[some].tolist())], pa.binary())], ["set_key", "shingles"])


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and key of packed shingles."""
    data, at = flat.raw(column)
    return np.repeat(np.arange(len(column)), np.diff(at) // 8), np.frombuffer(data.tobytes(), np.uint64)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets are similar enough.  ``sets``: set_key, shingles."""
    both = pairs.join(sets.select(F.col("set_key").alias("a"), F.col("shingles").alias("in_a")), "a")
    both = both.join(sets.select(F.col("set_key").alias("b"), F.col("shingles").alias("in_b")), "b").select("a", "b", "in_a", "in_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.uint64(flat.KEY_BITS)
        for batch in batches:
            for block in flat.blocks(batch, "in_a"):
                (ra, ka), (rb, kb) = unpacked(block.column("in_a")), unpacked(block.column("in_b"))
                both = np.concatenate([(ra.astype(np.uint64) << bits) | ka, (rb.astype(np.uint64) << bits) | kb])
                both.sort()
                twice = both[1:][both[1:] == both[:-1]]
                shared = np.bincount((twice >> bits).astype(np.int64), minlength=block.num_rows)
                size = np.bincount(ra, minlength=block.num_rows) + np.bincount(rb, minlength=block.num_rows)
                yield block.filter(pa.array(100 * shared >= percent * (size - shared))).select(["a", "b"])

    return both.mapInArrow(run, "a BIGINT, b BIGINT")


def repeated_paragraphs(docs: DataFrame, percent: int = PERCENT, recall: float = TARGET_RECALL) -> DataFrame:
    """Every paragraph that has a near or equal one elsewhere: doc_id, place, first_byte, end_byte, n_words, class_doc_id, class_place, removed.

    The class is named by its earliest paragraph, which alone is not removed.
    """
    bands, rows = tuned(percent, recall)
    known = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL")
    units = stored(listed(known), "units")
    parts = -(-units.count() * bands // PART_POSTINGS) or 1
    lists = stored(shared_lists_packed(collisions(known, bands, rows, parts), percent), "lists").withColumn("label", F.col("set_key"))
    pairs, long = meetings(lists.where("more"), percent)
    holders = units.groupBy("set_key").agg(
        F.count("*").alias("n_units"), F.min("doc_id").alias("doc_id"), F.min_by(ranged("first_byte", "end_byte"), "doc_id").alias("bytes"))
    holders = holders.join(lists.select("set_key").distinct().withColumn("listed", F.lit(True)), "set_key", "left")
    holders = stored(holders.where("n_units > 1 OR listed"), "holders")  # of the sets, those that may have a class
    sets = stored(shingles_of(known, holders.where("listed")), "sets")
    links = verified(star_pairs(lists).union(pairs).distinct(), sets, percent).union(
        searched(long, sets, "shingles", unpacked, percent).select("a", "b"))  # every set is small enough to be held whole
    labels = stored(components(links), "labels")

    classed = holders.where("n_units > 1").select("set_key").union(labels.select("node"))
    units = stored(units.drop("n").join(classed, "set_key", "left_semi"), "classed")
    by_set = units.groupBy("set_key").agg(F.min(F.struct("doc_id", "place")).alias("o"))
    named = by_set.join(labels, by_set.set_key == labels.node, "left").select("set_key", "o", F.coalesce("label", "set_key").alias("label"))
    classes = named.groupBy("label").agg(F.min("o").alias("o"))
    of_set = named.select("set_key", "label").join(classes, "label").select(
        "set_key", F.col("o.doc_id").alias("class_doc_id"), F.col("o.place").alias("class_place"))
    out = units.join(of_set, "set_key")
    first = (F.col("doc_id") == F.col("class_doc_id")) & (F.col("place") == F.col("class_place"))
    return out.select("doc_id", "place", "first_byte", "end_byte", "n_words", "class_doc_id", "class_place", (~first).alias("removed"))
