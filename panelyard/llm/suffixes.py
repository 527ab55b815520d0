"""Removal of every byte covered by a 200-byte string that starts anywhere else, by a range-partitioned suffix array.

Suffixes are compared on their first ``WINDOW`` bytes.  Each window of that length is led by its anchor, the gram of least hash in it; equal windows have
equal anchors at equal places, so it is enough to order windows by what follows the anchor first.  Neighbouring windows of
one anchor form a segment, named by the leading bytes of the anchor's suffix, a hash of its gram and a hash of the whole segment.

1. Segments are range-partitioned by sampled splitters on those keys, with row and place as the last ones, so that even a key of very many
   rows is split.  Each bucket is put in order by multikey sorting: ties of one key alone are ordered by the next.  Equal neighbours are repeats
   as a whole; anchors alone in their key are none.
2. Segments that share the anchor but differ are fetched as single windows (hashes of their 200 bytes).  Windows whose starts lie within ``PLACES`` places
   before the anchor travel together, under the bytes that all of them hold, so that a passage in very many documents parts where
   their other text begins.  They are range-partitioned and sorted the same way, and equal neighbours are repeats.
3. The first and last key of a bucket may go on in the next one.  Segments there always go to step 2; windows there are compared across the boundaries by a count
   per window, which is partially aggregated, and a join.

Runs of repeated windows of a row are merged, and what they cover is removed.  Strings are judged on the input.

Defined cases: null texts are empty; texts shorter than the window lose nothing; repeated rows are repeats of each other and lose all;
nulls in the id are kept; an empty table gives no rows; further columns are ignored.  Windows and segments are told apart by 64-bit hashes of their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelyard.llm import flat
from panelyard.session import stored

WINDOW = 200
GRAM = 64
LEAD_BYTES = 3
BUCKET_SEGMENTS = 300_000  # rows aimed at in a bucket of segments
BUCKET_REQUESTS = 20_000  # and of asked segments, which hold up to WINDOW - GRAM + 1 windows each
PLACES = 16
PACK = 256  # n and the distance of the anchor from the first window, both less, as one number
SEGMENT = "kind INT, key BIGINT, whole BIGINT, rid BIGINT, start INT, n INT"
FOUND = "kind INT, rid BIGINT, start INT, n INT, key BIGINT"
REPEAT, ASK, KNOWN, OPEN = 0, 1, 2, 3  # kinds of rows: repeated windows; segments to compare; segments, known to be repeated or not


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of every run of ``width`` values, by doubling."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[:len(x) - rest], x[rest:]) if rest else x


def order_by(columns: list[np.ndarray]) -> np.ndarray:
    """Multikey order: by the first column, and each run of ties by the next ones alone."""
    order = np.argsort(columns[0], kind="stable")
    if len(columns) == 1 or len(order) < 2:
        return order
    first = columns[0][order]
    tied = np.zeros(len(order), bool)
    tied[1:] = first[1:] == first[:-1]
    tied[:-1] |= tied[1:]
    at = np.flatnonzero(tied)
    if len(at):
        rows = order[at]
        run = np.cumsum(np.append(True, first[at][1:] != first[at][:-1]))
        order[at] = rows[np.lexsort([c[rows] for c in columns[:0:-1]] + [run])]
    return order


def segments(texts: pa.Array) -> dict[str, np.ndarray]:
    """Row, start, number of windows, key and hash of every segment of every text."""
    data, at = flat.raw(texts)
    n = len(data)
    grams = n - GRAM + 1
    none = {c: np.zeros(0, np.int64) for c in ("row", "start", "n", "ahead", "key", "whole")}
    if n < WINDOW:
        return none
    hashed = flat.RangeHash(data)
    place = np.arange(grams)
    gram = flat.mix(hashed(place, place + GRAM))
    ranked = (gram & np.uint64(0xFFFFFFFF00000000)) | place.astype(np.uint64)
    anchor = (sliding_least(ranked, WINDOW - GRAM + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))[:len(anchor)]
    window = np.flatnonzero(np.arange(len(anchor)) + WINDOW <= at[row + 1])
    if not len(window):
        return none
    row, anchor = row[window], anchor[window]
    new = np.append(True, (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]))
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(window)))
    start, anchor, row = window[head], anchor[head], row[head]
    lead = np.zeros(len(head), np.uint64)
    for k in range(LEAD_BYTES):
        lead = (lead << np.uint64(8)) | data[anchor + k].astype(np.uint64)
    key = (lead << np.uint64(64 - 8 * LEAD_BYTES)) | (flat.mix(gram[anchor]) >> np.uint64(8 * LEAD_BYTES))
    whole = flat.mix(flat.mix(hashed(start, start + count + WINDOW - 1)) ^ ((anchor - start) * 256 + count).astype(np.uint64))
    return {"row": row, "start": start - at[row], "n": count, "ahead": anchor - start, "key": flat.signed(key), "whole": flat.signed(whole)}


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of ranges as ranges in order that don't touch."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.append(True, start[1:] > reach[:-1])
    return start[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(start) - 1)]


def batch_of(schema: str, columns: list[np.ndarray]) -> pa.RecordBatch:
    kinds = {"INT": (pa.int32(), np.int32), "BIGINT": (pa.int64(), np.int64)}
    parts = [part.split() for part in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c.astype(kinds[k][1]), kinds[k][0]) for c, (_, k) in zip(columns, parts)], [name for name, _ in parts])


def all_segments(rows: DataFrame) -> DataFrame:
    """Segments of ``rows`` (rid, text).  Those equal within a block are repeats at once, and one stands for all of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in flat.blocks(batch):
                s = segments(block.column("text"))
                if not len(s["row"]):
                    continue
                rid = block.column("rid").to_numpy()[s["row"]]
                order = order_by([s["key"], s["whole"]])
                key, whole = s["key"][order], s["whole"][order]
                new = np.append(True, (key[1:] != key[:-1]) | (whole[1:] != whole[:-1]))
                many = np.append(~new[1:], False)  # the first of several equal ones
                one = order[new]
                repeated = np.zeros(len(order), bool)
                repeated[order] = ~new | many
                kind = np.where(many[new], KNOWN, OPEN)
                yield batch_of(SEGMENT, [kind, s["key"][one], s["whole"][one], rid[one], s["start"][one], s["n"][one] + PACK * s["ahead"][one]])
                at = np.flatnonzero(repeated)
                if len(at):  # neighbouring repeats of a row as one
                    step = np.int64(1) << 40
                    a, b = merged(s["row"][at] * step + s["start"][at], s["row"][at] * step + s["start"][at] + s["n"][at])
                    rid = block.column("rid").to_numpy()[a >> 40]
                    yield batch_of(SEGMENT, [np.full(len(a), REPEAT), flat.signed(flat.mix(rid.view(np.uint64) + a.astype(np.uint64))), a, rid, a % step, b - a])

    return rows.mapInArrow(run, SEGMENT)


def whole_bucket(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    got = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(got).combine_chunks() if got else None


def compared(listed: DataFrame, buckets: int) -> DataFrame:
    """Repeated segments, and the segments that must be compared window by window."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = whole_bucket(batches)
        if table is None:
            return
        kind, key, whole, rid, start, n = (table.column(c).to_numpy() for c in ("kind", "key", "whole", "rid", "start", "n"))
        done = np.flatnonzero(kind == REPEAT)
        if len(done):
            yield batch_of(FOUND, [kind[done], rid[done], start[done], n[done], key[done]])
        open_ = np.flatnonzero(kind != REPEAT)
        if not len(open_):
            return
        at = open_[order_by([key[open_], whole[open_], rid[open_], start[open_]])]
        kind, key, whole, rid, start, n = kind[at], key[at], whole[at], rid[at], start[at], n[at]
        new_key = np.append(True, key[1:] != key[:-1])
        new = new_key | np.append(True, whole[1:] != whole[:-1])
        group = np.cumsum(new) - 1
        many = np.bincount(group)[group] > 1
        repeated = np.flatnonzero(many & (kind == OPEN))
        yield batch_of(FOUND, [np.full(len(repeated), REPEAT), rid[repeated], start[repeated], n[repeated] % PACK, key[repeated]])
        of_key = np.cumsum(new_key) - 1
        mixed = (np.bincount(of_key[new])[of_key] > 1) | (of_key == 0) | (of_key == of_key[-1])
        ask = np.flatnonzero(mixed & new)
        yield batch_of(FOUND, [np.full(len(ask), ASK), rid[ask], start[ask], n[ask], key[ask]])

    return listed.repartitionByRange(buckets, "key", "whole", "rid", "start").mapInArrow(run, FOUND)


def fetched(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """key, rid, start and the hashes of the windows of every part of an asked segment."""
    per_row = asked.groupBy(F.col("rid").alias("of_rid")).agg(
        F.sort_array(F.collect_list(F.struct("start", "n", "key"))).alias("asked"))
    joined = rows.join(per_row, F.col("rid") == F.col("of_rid")).select("rid", "text", "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in flat.blocks(batch):
                data, at = flat.raw(block.column("text"))
                hashed = flat.RangeHash(data)
                asked = block.column("asked")
                count = np.diff(np.asarray(asked.offsets))
                inner = asked.flatten()
                start, n, key = (inner.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                n, ahead = n.astype(np.int64) % PACK, n.astype(np.int64) // PACK
                first = at[np.repeat(np.arange(block.num_rows), count)] + start
                segment = np.repeat(np.arange(len(n)), n)
                place = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                anchor = (first + ahead)[segment]
                part = (anchor - place) // PLACES
                head = np.flatnonzero(np.append(True, (segment[1:] != segment[:-1]) | (part[1:] != part[:-1]))[:len(place)])
                core = anchor[head] - part[head] * PLACES  # held by every window of the part
                inner = flat.mix(flat.mix(hashed(core, core + WINDOW - PLACES + 1)) + part[head].astype(np.uint64) + key[segment[head]].view(np.uint64))
                lead = np.uint64(64 - 8 * LEAD_BYTES)
                own = (key[segment[head]].view(np.uint64) >> lead << lead) | (inner >> np.uint64(8 * LEAD_BYTES))
                row = np.repeat(np.arange(block.num_rows), count)[segment[head]]
                windows = flat.mix(hashed(place, place + WINDOW)).view(np.int64)
                cuts = np.append(head, len(place)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(flat.signed(own)), block.column("rid").take(pa.array(row)), pa.array((place[head] - at[row]).astype(np.int32)),
                     pa.ListArray.from_arrays(pa.array(cuts), pa.array(windows))], ["key", "rid", "start", "windows"])

    return joined.mapInArrow(run, "key BIGINT, rid BIGINT, start INT, windows ARRAY<BIGINT>")


def windows_compared(asked: DataFrame, buckets: int) -> DataFrame:
    """kind, rid, start, n, key: repeated windows, and as ASK and KNOWN those (key: their hash) that the next bucket may repeat."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = whole_bucket(batches)
        if table is None:
            return
        lists = table.column("windows").combine_chunks() if isinstance(table.column("windows"), pa.ChunkedArray) else table.column("windows")
        lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
        n = np.diff(np.asarray(lists.offsets))
        value = lists.flatten().to_numpy()
        row = np.repeat(np.arange(len(n)), n)
        key = table.column("key").to_numpy()[row]
        rid = table.column("rid").to_numpy()[row]
        place = table.column("start").to_numpy()[row] + (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n))
        order = order_by([value, rid, place])
        value, rid, place, key = value[order], rid[order], place[order], key[order]
        same = np.append(False, (value[1:] == value[:-1]) & (rid[1:] == rid[:-1]) & (place[1:] == place[:-1]))
        value, rid, place, key = value[~same], rid[~same], place[~same], key[~same]
        new = np.append(True, value[1:] != value[:-1])
        group = np.cumsum(new) - 1
        many = np.bincount(group)[group] > 1
        again = np.flatnonzero(many)
        again = again[np.lexsort((place[again], rid[again]))]
        r, p = rid[again], place[again]
        head = np.flatnonzero(np.append(True, (r[1:] != r[:-1]) | (p[1:] != p[:-1] + 1))) if len(r) else np.zeros(0, np.int64)
        yield batch_of(FOUND, [np.full(len(head), REPEAT), r[head], p[head], np.diff(np.append(head, len(r))), r[head]])
        edge = (key == key.min()) | (key == key.max())
        open_ = np.flatnonzero(edge & new)
        yield batch_of(FOUND, [np.where(many[open_], KNOWN, ASK), rid[open_], place[open_], np.ones(len(open_)), value[open_]])

    return asked.repartitionByRange(buckets, "key", "rid", "start").mapInArrow(run, FOUND)


def across(found: DataFrame) -> DataFrame:
    """Windows at the bounds of buckets that another bucket repeats."""
    open_ = found.where(F.col("kind") != REPEAT)
    shared = open_.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    return open_.join(shared, "key", "left_semi").select("rid", "start", "n")


def named(docs: DataFrame) -> DataFrame:
    """doc_id, text and rid, which names a row by its id and text."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.withColumn("rid", F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "text"))


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """rid, ranges: starts and numbers of the repeated windows of every row that has any."""
    rows = named(docs)
    size = rows.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(least, -(-size // ((WINDOW - GRAM + 1) // 2 * BUCKET_SEGMENTS)))
    found = stored(compared(all_segments(rows.select("rid", "text")), buckets), "segments")
    asked = found.where(F.col("kind") == ASK)
    n = asked.count()
    single = stored(windows_compared(fetched(rows.select("rid", "text"), asked), max(least, -(-n // BUCKET_REQUESTS))), "windows")
    runs = [x.where(F.col("kind") == REPEAT).select("rid", "start", "n") for x in (found, single)]
    everything = runs[0].union(runs[1]).union(across(single))
    return everything.groupBy("rid").agg(F.collect_list(F.struct("start", "n")).alias("ranges"))


OUT = "doc_id BIGINT, n_bytes BIGINT, n_removed BIGINT, n_spans BIGINT, kept_sha256 STRING"


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the hash of the bytes that stay, of every row of ``docs``."""
    ranges = repeated_ranges(docs).withColumnRenamed("rid", "of_rid")
    rows = named(docs)
    joined = rows.join(ranges, F.col("rid") == F.col("of_rid"), "left").select("doc_id", "text", "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, own in zip(*(c.to_pylist() if i != 1 else c for i, c in enumerate(batch.columns))):
                data = text.as_buffer()
                if not own:
                    out.append((doc, len(data), 0, 0, hashlib.sha256(data).hexdigest()))
                    continue
                start = np.array([r["start"] for r in own], np.int64)
                a, b = merged(start, start + np.array([r["n"] for r in own], np.int64) + WINDOW - 1)
                kept = hashlib.sha256()
                view = memoryview(data)
                for x, y in zip([0, *b.tolist()], [*a.tolist(), len(data)]):
                    kept.update(view[x:y])
                out.append((doc, len(data), int((b - a).sum()), len(a), kept.hexdigest()))
            kinds = [pa.int64()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out) if out else [()] * 5, kinds)],
                                             [p.split()[0] for p in OUT.split(", ")])

    return joined.mapInArrow(run, OUT)
