"""Jaccard join of documents on word shingles by T-occurrence search over inverted lists.

Two sets of n and m shingles link when they share at least T = ceil(t (n + m) / (1 + t)) of them.  A set's partners therefore
occur in one of the inverted lists of its n - ceil(t n) + 1 rarest shingles; of partners as large or larger the least common shingle is even among its
n - ceil(2 t n / (1 + t)) + 1 rarest, so a posting counts only beside one of a fitting size of which the smaller is among those.  Those short lists are merged, in the order of
their keys, to find candidates, and the remaining long lists are only probed, by binary search for each key of the smaller
set in the other, as DivideSkip does.  Rarity comes from counts of hashed shingles over all documents; any order gives all links.

Equal sets are one class from the start.  First every set meets a representative of each of its lists, one pair each, whatever the
list's length: that joins most of a group of near copies.  Then only sets of different components meet.  Lists of up to ``SHORT`` sets give such
pairs, which counts of shingles by hash class prune without loss, and the rest are verified on their texts.  Longer lists are dealt in blocks of
bounded size; a task holds two blocks, searches them by T-occurrence and gives the links of a spanning forest only, so
neither pairs nor links of a large group of near copies are ever listed.  In such a task large sets are held as signatures, and the few
pairs of theirs that pass, of different components, are verified with the rest.

Defined cases: a document without words or with a null text has an empty set, links with none and is its own component; rows
without id have no component and link none; documents with fewer words than a shingle have one shingle
of all; repeated ids are rows of their own; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelyard.llm import flat, sieve
from panelyard.llm.components import components
from panelyard.session import stored

SHINGLE, PERCENT = 4, 85
SKETCH = 1 << 16  # hashed counters of shingles
SHORT = 64  # lists of more sets are searched in blocks
CLASSES, FINE = 256, 4_096  # hash classes of a set's signature, and of a set of more than FINE_FROM shingles
FINE_FROM = 2_000
BLOCK_SETS, BLOCK_SHINGLES = 1_500, 450_000  # sets and shingles of a block at most
FILE_TEXTS = 2_000  # texts of a file, of sets asked for
LARGE = 1_000  # sets of more shingles are compared by signature first, the others at once
SKIP = 0.01  # weight of a probe against a merge, which sets how many of the longest lists are skipped


def set_keys(row: np.ndarray, key: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and hash of the set of every row."""
    size = np.bincount(row, minlength=rows)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(flat.mix(key + np.uint64(0x51ED270B)))])
    cuts = np.searchsorted(row, np.arange(rows + 1))
    total = sums[cuts[1:]] - sums[cuts[:-1]]
    return size, flat.signed(flat.mix(total + size.astype(np.uint64)))


def signatures(row: np.ndarray, key: np.ndarray, rows: int) -> tuple[list[bytes], list[bytes | None]]:
    """Shingles of every row in each hash class, 255 for as many or more; and in finer classes, for large sets alone."""
    cuts = np.searchsorted(row, np.arange(rows + 1))
    part = ((key >> np.uint64(24)) & np.uint64(FINE - 1)).astype(np.int64)
    def counted(a: int, b: int, classes: int) -> bytes:
        return np.minimum(255, np.bincount(part[a:b] % classes, minlength=classes)).astype(np.uint8).tobytes()

    pairs = list(zip(cuts[:-1], cuts[1:]))
    return [counted(a, b, CLASSES) for a, b in pairs], [counted(a, b, FINE) if b - a > FINE_FROM else None for a, b in pairs]


class Signatures:
    """Signatures of many sets: all in the coarse classes, and those of large sets in the fine ones, where given."""

    def __init__(self, coarse: pa.Array, fine: pa.Array | None = None):
        self.coarse = flat.raw(coarse)[0].reshape(-1, CLASSES)
        self.fine = np.zeros(len(coarse), bool)
        if fine is not None:
            self.data, self.at = flat.raw(fine)
            self.fine = np.diff(self.at) == FINE

    def whole(self, i: int) -> np.ndarray:
        return self.data[self.at[i]:self.at[i] + FINE]


def allowed(x: Signatures, i: np.ndarray, y: Signatures, j: np.ndarray, size: np.ndarray, percent: int) -> np.ndarray:
    """Which of the pairs (i of x, j of y) their signatures don't exclude; ``size``: of both sets together."""
    out = np.zeros(len(i), bool)
    for a in range(0, len(i), 20_000):
        part = slice(a, a + 20_000)
        p, q = x.coarse[i[part]], y.coarse[j[part]]
        most = np.minimum(p, q).sum(1, dtype=np.int64)
        full = ((p == 255) & (q == 255)).any(1)  # such classes may share more
        out[part] = full | (100 * most >= percent * (size[part] - most))
    for k in np.flatnonzero(out & x.fine[i] & y.fine[j]).tolist():
        p, q = x.whole(i[k]), y.whole(j[k])
        most = int(np.minimum(p, q).sum(dtype=np.int64))
        out[k] = bool(((p == 255) & (q == 255)).any()) or 100 * most >= percent * (size[k] - most)
    return out


def digests(docs: DataFrame, shingle: int) -> DataFrame:
    """kind 0: doc_id, mark (hash of the text), n, set, signature of every row; kind 1: counter (n) of each sketch place (set) of a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SKETCH, np.int64)
        names = ["kind", "doc_id", "mark", "n", "set_key", "signature", "fine"]
        for batch in batches:
            for block in flat.blocks(batch, limit=flat.SMALL_BYTES):
                row, key = flat.Words(block.column("text")).shingles(shingle)
                counts += np.bincount((key & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
                size, own = set_keys(row, key, block.num_rows)
                coarse, fine = signatures(row, key, block.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(len(size), np.int32)), block.column("doc_id"), block.column("mark"), pa.array(size), pa.array(own),
                     pa.array(coarse, pa.binary()), pa.array(fine, pa.binary())], names)
        held = np.flatnonzero(counts)
        if len(held):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ones(len(held), np.int32)), pa.nulls(len(held), pa.int64()), pa.nulls(len(held), pa.int64()), pa.array(counts[held]), pa.array(held),
                 pa.nulls(len(held), pa.binary()), pa.nulls(len(held), pa.binary())], names)

    return docs.mapInArrow(run, "kind INT, doc_id BIGINT, mark BIGINT, n BIGINT, set_key BIGINT, signature BINARY, fine BINARY")


def rarity(counts: DataFrame) -> np.ndarray:
    """Excess of every sketch place over what chance explains: 0 for the many rare shingles."""
    got = counts.groupBy("set_key").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(SKETCH, np.int64)
    total[np.array(got.column("set_key"), np.int64)] = np.array(got.column("n"), np.int64)
    usual = np.median(total)
    return np.maximum(0, total - usual - 4 * np.sqrt(usual + 1)).astype(np.int64)


def prefixes(docs: DataFrame, excess: np.ndarray, shingle: int, percent: int) -> DataFrame:
    """h, n_late, set_key: the rarest shingles of every set, each set once a task.  n_late: twice the size, and one more where a larger partner must share a rarer shingle."""
    sent = docs.sparkSession.sparkContext.broadcast(excess)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        excess = sent.value
        seen: set[int] = set()
        for batch in batches:
            for block in flat.blocks(batch, limit=flat.SMALL_BYTES):
                row, key = flat.Words(block.column("text")).shingles(shingle)
                size, own = set_keys(row, key, block.num_rows)
                new = np.zeros(len(own), bool)
                for i, (k, n) in enumerate(zip(own.tolist(), size.tolist())):
                    if n and k not in seen:
                        seen.add(k)
                        new[i] = True
                use = new[row]
                row, key = row[use], key[use]
                order = np.lexsort((key, excess[(key & np.uint64(SKETCH - 1)).astype(np.int64)], row))
                row, key = row[order], key[order]
                first = np.searchsorted(row, row)
                place = np.arange(len(row)) - first
                take = place < size[row] - -(-percent * size[row] // 100) + 1
                row, key, place = row[take], key[take], place[take]
                late = place > size[row] - -(-2 * percent * size[row] // (100 + percent))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(flat.signed(key)), pa.array((2 * size[row] + late).astype(np.int32)), pa.array(own[row])], ["h", "n_late", "set_key"])

    return docs.mapInArrow(run, "h BIGINT, n_late INT, set_key BIGINT")


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of rows sorted by the first one, cut so that a group of equal first values is never torn."""
    rest: list[np.ndarray] | None = None
    for batch in batches:
        now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if rest is not None:
            now = [np.concatenate(x) for x in zip(rest, now)]
        if not len(now[0]):
            continue
        cut = np.searchsorted(now[0], now[0][-1])
        if cut:
            yield [c[:cut] for c in now]
        rest = [c[cut:] for c in now]
    if rest is not None and len(rest[0]):
        yield rest


def representatives(h: np.ndarray, n: np.ndarray, own: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """For every posting a set of its list, the first one by a hash (so that similar lists have the same), of a size that allows a link; and whether the
    list has further pairs.  Postings come by list and size."""
    band = np.floor(np.log(n) / np.log(100 / percent)).astype(np.int64) if percent < 100 else n
    start = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (band[1:] != band[:-1])))
    place = flat.mix(own.view(np.uint64))
    group = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(h))))
    first = np.lexsort((place, group))[start]
    head = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    length = np.diff(np.append(head, len(h)))
    several = np.repeat((length > 2) | (group[head] != group[head + length - 1]), length)
    return own[first][group], several


def partnered(h: np.ndarray, n: np.ndarray, early: np.ndarray, percent: int, label: np.ndarray | None = None) -> np.ndarray:
    """Which of the postings, sorted by list and size, may meet another of their list: the sizes allow a link, and the smaller one is ``early``.

    With labels of components, those whose only such partners have their own label may be left out too.
    """
    head, size, at = np.cumsum(np.append(True, h[1:] != h[:-1])) << 32, n.astype(np.int64), np.arange(len(h))
    least, most = np.searchsorted(head + size, head - -percent * size // 100), np.searchsorted(head + size, head + 100 * size // percent, "right") - 1
    earlier = np.concatenate([[0], np.cumsum(early)])
    above, below = early & (most > at), earlier[at] > earlier[least]
    if label is not None:
        changes = np.cumsum(np.append(False, label[1:] != label[:-1]))
        above, below = above & (changes[most] > changes), below & (changes > changes[least])
    return above | below


def repeated(h: np.ndarray) -> np.ndarray:
    """Which of the sorted values have an equal one."""
    both = np.zeros(len(h), bool)
    both[1:] = h[1:] == h[:-1]
    both[:-1] |= both[1:]
    return both


LISTED = "h BIGINT, n INT, set_key BIGINT, early BOOLEAN, star BIGINT, more BOOLEAN"


def listed(h: np.ndarray, n: np.ndarray, own: np.ndarray, percent: int) -> dict[str, np.ndarray]:
    """The columns of ``LISTED`` for the postings (h, n_late, set_key; sorted by h) that may meet another."""
    both = repeated(h)
    h, n, own = h[both], n[both], own[both]
    order = np.lexsort((own, n, h))
    h, n, own = h[order], n[order], own[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
    h, n, own = h[new], n[new], own[new]
    both = repeated(h)
    h, n, own = h[both], n[both], own[both]
    n, early = n >> 1, n % 2 == 0
    if len(h):
        met = partnered(h, n, early, percent)
        h, n, own, early = h[met], n[met], own[met], early[met]
    star, more = representatives(h, n, own, percent) if len(h) else (own, early)
    return {"h": h, "n": n, "set_key": own, "early": early, "star": star, "more": more}


def shared_lists(postings: DataFrame, percent: int) -> DataFrame:
    """The postings (h, n_late, set_key) that may meet another, in list order, each with a representative of its list and whether the list has pairs without one (``more``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, n, own in grouped(batches):
            yield pa.RecordBatch.from_pydict(listed(h, n, own, percent))

    # one column is sorted by its digits; most postings are alone in their list and need no further order
    return postings.repartition("h").sortWithinPartitions("h").mapInArrow(run, LISTED)


PACKED = "part INT, h BINARY, n_late BINARY, set_key BINARY"


def packed(h: np.ndarray, n: np.ndarray, own: np.ndarray, parts: int) -> pa.RecordBatch:
    """Postings (h, n_late, set_key) by part of the lists, of each part that has some one row with all of them, as whole columns."""
    part = (h.view(np.uint64) % np.uint64(parts)).astype(np.uint16 if parts <= 1 << 16 else np.int32)
    order = np.argsort(part, kind="stable")
    at = np.append(0, np.cumsum(np.bincount(part, minlength=parts)))
    held = np.flatnonzero(np.diff(at))
    at = at[np.append(held, parts)]

    def column(x: np.ndarray) -> pa.Array:
        return pa.Array.from_buffers(pa.binary(), len(held), [None, pa.py_buffer((at * x.itemsize).astype(np.int32)), pa.py_buffer(x[order])])

    return pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), column(h), column(n.astype(np.int32)), column(own)], ["part", "h", "n_late", "set_key"])


def shared_lists_packed(postings: DataFrame, percent: int) -> DataFrame:
    """``shared_lists`` for postings that come ``packed``: most are alone in their list, and never become rows."""
    def run(table: pa.Table) -> pa.Table:
        h, n, own = (np.concatenate([np.frombuffer(flat.raw(c)[0].tobytes(), kind) for c in table.column(name).chunks])
                     for name, kind in (("h", np.int64), ("n_late", np.int32), ("set_key", np.int64)))
        order = np.argsort(h)
        return pa.table(listed(h[order], n[order], own[order], percent))

    return postings.groupBy("part").applyInArrow(run, LISTED)


def star_pairs(lists: DataFrame) -> DataFrame:
    """a, b: every set with the representatives of its lists."""
    met = lists.select("set_key", "star").where("set_key <> star")
    return met.select(F.least("set_key", "star").alias("a"), F.greatest("set_key", "star").alias("b")).distinct()


def meetings(lists: DataFrame, percent: int, short: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Who may still link, from one pass over the lists (h, n, set_key, early, star, label of the component).

    First a, b: the pairs of every list of up to ``short`` sets whose sizes allow a link, of different components, that no representative has met.  Then
    set_key, n, label, component: the sets of each longer list, under the list's key, that have a set of another component there whose size allows a link.
    """
    short = short or SHORT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, n, own, early, star, label in grouped(batches):
            start = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            length = np.diff(np.append(start, len(h)))
            place = np.arange(len(h)) - np.repeat(start, length)
            length = np.repeat(length, length)
            left = [np.flatnonzero((place + d < length) & (length <= short)) for d in range(1, short)]
            right = np.concatenate([x + d for x, d in zip(left, range(1, short))])
            left = np.concatenate(left)
            fits = (100 * n[left].astype(np.int64) >= percent * n[right].astype(np.int64)) & (label[left] != label[right])
            fits &= early[left] & (star[left] != own[right]) & (star[right] != own[left])
            left, right = left[fits], right[fits]
            both = np.unique(np.stack([np.minimum(own[left], own[right]), np.maximum(own[left], own[right])]), axis=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(both[0]), pa.array(both[1]), pa.nulls(both.shape[1], pa.int32()), pa.nulls(both.shape[1], pa.int64())], names)
            long = length > short
            if long.any():
                long &= partnered(h, n, early, percent, label)
                yield pa.RecordBatch.from_arrays([pa.array(x[long]) for x in (own, h, n, label)], names)

    names = ["a", "b", "n", "component"]
    ordered = lists.select("h", "n", "set_key", "early", "star", "label").repartition("h").sortWithinPartitions("h", "n", "set_key")
    found = stored(ordered.mapInArrow(run, "a BIGINT, b BIGINT, n INT, component BIGINT"), "meetings")
    return found.where("n IS NULL").select("a", "b").distinct(), found.where("n IS NOT NULL").select(
        F.col("a").alias("set_key"), "n", F.col("b").alias("label"), "component")


def possible(pairs: DataFrame, signed: DataFrame, percent: int) -> DataFrame:
    """The pairs that their signatures don't exclude.  ``signed``: set_key, n, signature."""
    both = pairs.join(signed.select(F.col("set_key").alias("a"), F.col("n").alias("n_a"), F.col("signature").alias("sig_a")), "a")
    both = both.join(signed.select(F.col("set_key").alias("b"), F.col("n").alias("n_b"), F.col("signature").alias("sig_b")), "b").select(
        "a", "b", "n_a", "n_b", "sig_a", "sig_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.arange(batch.num_rows)
            size = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
            fits = allowed(Signatures(batch.column("sig_a")), at, Signatures(batch.column("sig_b")), at, size, percent)
            yield batch.filter(pa.array(fits)).select(["a", "b"])

    return both.mapInArrow(run, "a BIGINT, b BIGINT")


class Forest:
    """Union-find over numbered sets."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def occurrences(row: np.ndarray, key: np.ndarray, size: np.ndarray, side: np.ndarray, component: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links among the sets (row, key; sorted), between both sides if there are two: the pairs of a forest that spans the components.

    DivideSkip: the longest lists of a set are set aside; the others are merged into counts; sets that could still reach T are
    probed for in the long lists by binary search.
    """
    _, name = np.unique(key, return_inverse=True)
    order = np.argsort(name, kind="stable")
    owner = row[order]
    at = np.searchsorted(name[order], np.arange(int(name.max()) + 2 if len(name) else 1))
    cuts = np.searchsorted(row, np.arange(len(size) + 1))
    forest, found = Forest(len(size)), []
    two = bool(side.any() and not side.all())
    _, first, same = np.unique(component, return_index=True, return_inverse=True)
    for x, one in enumerate(first[same].tolist()):
        forest.join(x, one)
    for x in range(len(size)):
        need = -(-percent * int(size[x]) // 100)  # least overlap with any partner
        own = name[cuts[x]:cuts[x + 1]]
        length = at[own + 1] - at[own]
        own, length = own[length > 1], length[length > 1]
        if len(own) < need:
            continue
        by_length = np.argsort(length, kind="stable")
        own, length = own[by_length], length[by_length]
        skipped = min(need - 1, int(need / (SKIP * np.log2(max(2, int(length[-1]))) + 1)), len(own) // 2)
        short, long = own[:len(own) - skipped], own[len(own) - skipped:]
        merged = np.concatenate([owner[at[s]:at[s + 1]] for s in short.tolist()])
        count = np.bincount(merged[merged > x], minlength=len(size))
        near = np.flatnonzero(count >= max(1, need - skipped))
        near = near[near > x]
        if two:
            near = near[side[near] != side[x]]
        count = count[near]
        for s in long.tolist():
            held = owner[at[s]:at[s + 1]]
            place = np.minimum(np.searchsorted(held, near), len(held) - 1)
            count += held[place] == near
        for y in near[100 * count >= percent * (size[x] + size[near] - count)].tolist():
            if forest.join(x, y):
                found.append((x, y))
    return found


def close_signatures(size: np.ndarray, signed: Signatures, large: np.ndarray, side: np.ndarray, component: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs of different components with at least one large set that sizes and signatures don't exclude.  Sets come by size."""
    two = bool(side.any() and not side.all())
    last = np.searchsorted(percent * size, 100 * size, "right")  # partners of a set are the next ones up to here
    found = []
    for x in range(len(size)):
        y = np.arange(x + 1, last[x])
        if not large[x]:
            y = y[large[y]]
        if two:
            y = y[side[y] != side[x]]
        y = y[component[y] != component[x]]
        near = allowed(signed, np.full(len(y), x), signed, y, size[x] + size[y], percent)
        found += [(x, int(k)) for k in y[near]]
    return found


SEARCHED = "a BIGINT, b BIGINT, sure BOOLEAN"


def searched(lists: DataFrame, contents: DataFrame, column: str, read, percent: int, signed: DataFrame | None = None) -> DataFrame:
    """a, b, sure: within each list, links of a spanning forest (sure), and pairs of large sets that may link.

    ``lists``: set_key, n, label, component; sets of one component need no link.  ``contents``: set_key, a column from which ``read`` gives row and key of the distinct shingles
    of a block, of all sets but large ones.  ``signed``: set_key, signature, fine of the large sets, if there are any, and of those whose size allows a link with one.
    """
    totals = lists.groupBy("label").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("sets") / BLOCK_SETS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    named = lists.groupBy("set_key").agg(F.collect_set("label").alias("among"))  # no longer than the set's prefix
    rows = lists.join(totals.select("label", blocks.alias("blocks")), "label").join(named, "set_key")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("set_key"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("set_key", "n", "label", "component", "among", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    if signed is None:
        rows = rows.join(contents, "set_key").withColumns({c: F.lit(None).cast("binary") for c in ("signature", "fine")})
    else:
        rows = rows.join(contents, "set_key", "left").join(signed, "set_key", "left")
    rows = rows.select("label", "i", "j", "set_key", "n", "component", "among", "own", column, "signature", "fine")

    def search(table: pa.Table) -> pa.Table:
        batch = pa.concat_batches(table.sort_by([("n", "ascending"), ("set_key", "ascending")]).to_batches())
        own, size = batch.column("set_key").to_numpy(), batch.column("n").to_numpy().astype(np.int64)
        side, component = batch.column("own").to_numpy() != batch.column("i")[0].as_py(), batch.column("component").to_numpy()
        large = batch.column(column).is_null().to_numpy(zero_copy_only=False)
        pairs = []
        if large.any():
            at = np.flatnonzero(batch.column("signature").is_valid().to_numpy(zero_copy_only=False))
            part = batch.take(pa.array(at))
            given = Signatures(part.column("signature"), part.column("fine"))
            label, among = batch.column("label")[0].as_py(), [set(x) for x in part.column("among").to_pylist()]
            # a pair that meets in several lists is given by the first of them
            pairs += [(at[x], at[y], False) for x, y in close_signatures(size[at], given, large[at], side[at], component[at], percent) if min(among[x] & among[y]) == label]
        small = np.flatnonzero(~large)
        if len(small) > 1:
            part = batch.take(pa.array(small))
            rows, keys, done = [], [], 0
            for block in flat.blocks(part, column, flat.SMALL_BYTES):
                row, key = read(block.column(column))
                rows.append(row + done)
                keys.append(key)
                done += block.num_rows
            row, key = np.concatenate(rows), np.concatenate(keys)
            pairs += [(small[x], small[y], True) for x, y in occurrences(row, key, np.bincount(row, minlength=done), side[small], component[small], percent)]
        x, y = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
        return pa.table({"a": pa.array(np.minimum(own[x], own[y])), "b": pa.array(np.maximum(own[x], own[y])),
                         "sure": pa.array([p[2] for p in pairs], pa.bool_())})

    return rows.groupBy("label", "i", "j").applyInArrow(search, SEARCHED)


def verified(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs whose sets share enough.  ``texts``: set_key, text."""
    both = pairs.join(texts.select(F.col("set_key").alias("a"), F.col("text").alias("text_a")), "a")
    both = both.join(texts.select(F.col("set_key").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in flat.blocks(batch, "text_a", flat.SMALL_BYTES):
                ra, ka = flat.Words(block.column("text_a")).shingles(shingle)
                rb, kb = flat.Words(block.column("text_b")).shingles(shingle)
                bits = np.uint64(flat.KEY_BITS)
                left, right = (ra.astype(np.uint64) << bits) | ka, (rb.astype(np.uint64) << bits) | kb
                at = np.searchsorted(right, left)  # the binary probe of the long lists
                hit = np.zeros(len(left), bool)
                inside = at < len(right)
                hit[inside] = right[at[inside]] == left[inside]
                shared = np.bincount(ra[hit], minlength=block.num_rows)
                size = np.bincount(ra, minlength=block.num_rows) + np.bincount(rb, minlength=block.num_rows)
                yield block.filter(pa.array((shared > 0) & (100 * shared >= percent * (size - shared)))).select(["a", "b"])

    return both.mapInArrow(run, "a BIGINT, b BIGINT")


def linked(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Digests of all rows (doc_id, n, set_key), and node, label of every set that links with another."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("mark", F.xxhash64("text"))
    known = rows.where("doc_id IS NOT NULL")
    found = stored(digests(rows, shingle), "digests")
    rows_of = found.where("kind = 0").select("doc_id", "n", "set_key")
    excess = rarity(found.where("kind = 1"))
    lists = stored(shared_lists(prefixes(known, excess, shingle, percent), percent), "lists")
    named = found.where("kind = 0 AND doc_id IS NOT NULL AND n > 0")

    def kept(pairs: DataFrame) -> DataFrame:
        """The pairs that signatures leave."""
        signed = named.select("set_key", "n", "signature").dropDuplicates(["set_key"])
        return stored(possible(stored(pairs, "met"), signed, percent), "pairs")

    def rows_with(asked: DataFrame) -> DataFrame:
        """The digests of the sets asked for."""
        return sieve.likely(named, "set_key", asked).join(asked, "set_key", "left_semi")

    def texts_of(asked: DataFrame, most: int | None = None) -> DataFrame:
        """set_key, text: one text of every set asked for.  ``most``: a bound of their number, where one is known."""
        asked = stored(asked.distinct(), "asked", most)
        most = asked.count()
        one = rows_with(asked).groupBy("set_key").agg(F.min(F.struct("doc_id", "mark")).alias("at"))
        one = stored(one.select("set_key", "at.*"), "holders", most)
        held = sieve.likely(known, "doc_id", one).join(one, ["doc_id", "mark"]).dropDuplicates(["doc_id", "mark", "set_key"])  # repeated rows, where the join left them
        return stored(own_text(held.select("set_key", "text"), shingle), "texts", most, FILE_TEXTS)

    def sets(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("set_key")).union(pairs.select("b"))

    # every set with the representatives of its lists
    pairs = kept(star_pairs(lists))
    links = stored(verified(pairs, texts_of(sets(pairs), 2 * pairs.count()), shingle, percent), "links")
    joined = stored(components(links), "labels")

    # sets of different components; texts travel of what is searched whole, and of large sets only if a pair of theirs is left
    lists = lists.where("more").join(joined.withColumnRenamed("node", "set_key"), "set_key", "left").withColumn("label", F.coalesce("label", "set_key"))
    pairs, long = meetings(lists, percent)
    pairs = kept(pairs)
    near_large = stored(long.where(100 * F.col("n") > percent * LARGE).select("set_key").distinct(), "asked")
    signed = rows_with(near_large).groupBy("set_key").agg(F.first("signature").alias("signature"), F.first("fine").alias("fine"))
    whole = texts_of(long.where(F.col("n") <= LARGE).select("set_key"))
    offered = stored(searched(long, whole, "text", lambda column: flat.Words(column).shingles(shingle), percent, signed), "offered")
    offers = offered.where("NOT sure").select("a", "b")
    pairs = stored(pairs.union(offers).distinct(), "pairs", pairs.count() + offers.count())  # of known size: few pairs go to the texts
    further = verified(pairs, texts_of(sets(pairs), 2 * pairs.count()), shingle, percent).union(offered.where("sure").select("a", "b"))
    return rows_of, stored(components(links.union(further)), "labels")


def own_text(texts: DataFrame, shingle: int) -> DataFrame:
    """Those rows of ``texts`` that have the named set: an id may be repeated with another text of the same hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in flat.blocks(batch, limit=flat.SMALL_BYTES):
                row, key = flat.Words(block.column("text")).shingles(shingle)
                _, own = set_keys(row, key, block.num_rows)
                yield block.filter(pa.array(own == block.column("set_key").to_numpy()))

    return texts.mapInArrow(run, "set_key BIGINT, text STRING")


def jaccard_components(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: the smallest id reachable by links, its own included."""
    rows, labels = linked(docs, shingle, percent)
    linkable = (F.col("doc_id").isNotNull()) & (F.col("n") > 0)
    classes = rows.where(linkable).groupBy("set_key").agg(F.min("doc_id").alias("least"))
    named = classes.join(labels, classes.set_key == labels.node, "left").select(
        "set_key", F.coalesce("label", "set_key").alias("label"), "least")
    firsts = named.groupBy("label").agg(F.min("least").alias("component_id"))
    of_set = named.join(firsts, "label").select(F.col("set_key").alias("of_set"), "component_id")
    out = rows.join(of_set, linkable & (F.col("set_key") == F.col("of_set")), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(linkable, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each_group(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that are not linked to a document of a smaller id; of repeated rows one stays.

    Rows without words or id stay, and so do the rows of an id that is repeated with different texts while one of them is not linked.
    """
    ids = jaccard_components(docs, shingle, percent)
    per_id = stored(ids.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.col("component_id") == F.col("doc_id")).alias("first"), F.count("*").alias("rows")), "ids")
    kept = docs.join(per_id.where("NOT first").select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    repeated = per_id.where("rows > 1").select("doc_id")
    if repeated.isEmpty():
        return kept
    again = kept.join(repeated, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"])
    return kept.join(repeated, "doc_id", "left_anti").select(*docs.columns).union(again)
