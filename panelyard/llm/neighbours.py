"""Approximate nearest neighbours by learned partitions.

A bounded sample of the vectors gives a neighbour graph; balanced partitioning cuts the graph into parts of equal size; a small
classifier, fitted on the sample's parts, then routes every vector.  A vector is stored in its most probable
part; a query probes its most probable parts up to a total probability that reaches the target recall on held-out queries against brute
force, so a query with a clear place probes few.  Found vectors are ranked by their exact inner product in double precision.

Equal vectors are kept once with their smallest ids, as many as a query can need, so copies do not crowd a part.
Small parts are bundled and large bundles dealt in slices of bounded size, and queries in blocks; each pair of a slice and a block of the same
bundle is one group, compares a query with the parts it probes and keeps its best.  The number of parts grows with the table as far as the sample supports them (``PART_SAMPLE`` vectors
each: 256 parts of the default sample, enough for 384,000 vectors); larger tables need a larger ``SAMPLE``, or a query compares a fixed share of them.

Defined cases: vectors that are null, empty, zero, of another length than most, or hold null or non-finite components take no
part, neither as query nor as candidate; rows without id take none; a repeated id with different vectors is a candidate with
each of them, and one query that takes the best of all; repeated rows count once; with fewer candidates than asked for all are returned; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelyard.session import stored

NEAREST = 20
QUERY_EVERY = 20
SAMPLE = 12_000  # bound of the vectors that the graph and the classifier are fitted on
SAMPLE_QUERIES = 300
GRAPH_NEIGHBOURS = 10
PART_ROWS = 1_500  # vectors aimed at in a part
PART_SAMPLE = 32  # sampled vectors that a part needs at least, so the sample bounds the number of parts
TARGET_RECALL = 0.94
GRAIN = 1 << 52  # of the hash that draws the sample
SLICE, BLOCK = 20_000, 1_000
OWN_PART = 5e-324  # only the most probable part has no probability before it
FOUND = "query_id BIGINT, vec_id BIGINT, score DOUBLE"


def usable(table: DataFrame) -> DataFrame:
    """vec_id, vec (doubles), of the rows that take part."""
    vec = F.transform("embedding", lambda x: x.cast("double"))
    rows = table.select(F.col("vec_id").cast("bigint").alias("vec_id"), vec.alias("vec")).where(
        F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0))
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(~F.coalesce(bad, F.lit(True)) & F.exists("vec", lambda x: x != 0))
    lengths = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").head()
    return rows.where(F.size("vec") == lengths["n"]) if lengths else rows


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """vec_key, vec, ids: each vector once with its ``keep`` smallest ids."""
    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch.sort_values("vec_id")
            batch["turn"] = batch.groupby("vec_key").cumcount()
            yield batch[batch["turn"] < keep].drop(columns="turn")

    keyed = rows.select(F.xxhash64("vec").alias("vec_key"), "vec_id")
    few = keyed.mapInPandas(first, "vec_key BIGINT, vec_id BIGINT")
    ids = few.groupBy("vec_key").agg(F.slice(F.sort_array(F.collect_set("vec_id")), 1, keep).alias("ids"))
    one = ids.select("vec_key", "ids", F.col("ids")[0].alias("vec_id"))
    return one.join(rows.select("vec_id", "vec", F.xxhash64("vec").alias("of_key")), "vec_id").where(
        F.col("vec_key") == F.col("of_key")).select("vec_key", "vec", "ids").dropDuplicates(["vec_key"])


def graph(points: np.ndarray, k: int) -> np.ndarray:
    """The k rows of largest inner product of every row."""
    out = np.zeros((len(points), k), np.int64)
    for a in range(0, len(points), 1000):
        near = points[a:a + 1000] @ points.T
        near[np.arange(len(near)), np.arange(a, a + len(near))] = -np.inf
        out[a:a + 1000] = np.argpartition(-near, k - 1, axis=1)[:, :k]
    return out


def halves(edges: np.ndarray, members: np.ndarray, draw: np.random.Generator) -> np.ndarray:
    """A balanced cut of the graph among ``members``: smooth a random start over the edges and cut at the middle, then swap to lower the cut."""
    slot = np.full(len(edges), -1)
    slot[members] = np.arange(len(members))
    near = slot[edges[members]]
    inside = near >= 0
    a = np.repeat(np.arange(len(members)), near.shape[1])[inside.ravel()]
    b = near.ravel()[inside.ravel()]
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    degree = np.bincount(a, minlength=len(members)) + 1e-9
    x = draw.standard_normal(len(members))
    for _ in range(60):  # power steps towards the slowest mode that is not constant
        x = x - (x @ degree) / degree.sum()
        x = 0.5 * x + 0.5 * np.bincount(a, x[b], len(members)) / degree
        x /= np.linalg.norm(x) + 1e-12
    side = np.zeros(len(members), bool)
    side[np.argsort(x, kind="stable")[len(members) // 2:]] = True
    for _ in range(6):  # swap equal numbers of those who gain most
        other = np.bincount(a, side[a] != side[b], len(members)) - np.bincount(a, side[a] == side[b], len(members))
        left, right = np.flatnonzero(~side), np.flatnonzero(side)
        left, right = left[np.argsort(-other[left], kind="stable")], right[np.argsort(-other[right], kind="stable")]
        m = min(len(left), len(right))
        n = int(np.count_nonzero(np.cumprod(other[left[:m]] + other[right[:m]] > 0))) // 2
        if not n:
            break
        side[left[:n]], side[right[:n]] = True, False
    return side


def balanced_parts(edges: np.ndarray, parts: int) -> np.ndarray:
    """Part of every row by recursive balanced cuts; ``parts`` is a power of two."""
    part = np.zeros(len(edges), np.int64)
    draw = np.random.default_rng(3)
    size = 1
    while size < parts:
        for p in range(size):
            members = np.flatnonzero(part == p)
            if len(members) > 1:
                part[members[halves(edges, members, draw)]] += size
        size *= 2
    return part


class Router:
    """A network with one hidden layer that gives the probabilities of the parts."""

    def __init__(self, points: np.ndarray, part: np.ndarray, parts: int, hidden: int = 128, epochs: int = 30):
        draw = np.random.default_rng(9)
        self.scale = 1 / (np.sqrt((points**2).mean()) + 1e-12)
        x = points * self.scale
        d = x.shape[1]
        self.w1, self.b1 = draw.standard_normal((d, hidden)) * np.sqrt(2 / d), np.zeros(hidden)
        self.w2, self.b2 = draw.standard_normal((hidden, parts)) * np.sqrt(1 / hidden), np.zeros(parts)
        names = ("w1", "b1", "w2", "b2")
        mean, var = {n: 0.0 for n in names}, {n: 0.0 for n in names}
        step = 0
        for epoch in range(epochs):
            order = draw.permutation(len(x))
            for a in range(0, len(x), 256):
                use = order[a:a + 256]
                h = np.maximum(0, x[use] @ self.w1 + self.b1)
                z = h @ self.w2 + self.b2
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(use)), part[use]] -= 1
                p /= len(use)
                back = (p @ self.w2.T) * (h > 0)
                grad = {"w1": x[use].T @ back, "b1": back.sum(0), "w2": h.T @ p, "b2": p.sum(0)}
                step += 1
                for n in names:
                    mean[n] = 0.9 * mean[n] + 0.1 * grad[n]
                    var[n] = 0.999 * var[n] + 0.001 * grad[n] ** 2
                    rate = 3e-3 * (1 - epoch / epochs) + 1e-4
                    setattr(self, n, getattr(self, n) - rate * (mean[n] / (1 - 0.9**step)) / (np.sqrt(var[n] / (1 - 0.999**step)) + 1e-8))

    def probabilities(self, points: np.ndarray) -> np.ndarray:
        z = np.maximum(0, points * self.scale @ self.w1 + self.b1) @ self.w2 + self.b2
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def ranked(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The parts of every point, most probable first, and the probability of all parts before each."""
        p = self.probabilities(points)
        order = np.argsort(-p, axis=1, kind="stable")
        p = np.take_along_axis(p, order, 1)
        return order, np.cumsum(p, 1) - p


def fitted(points: np.ndarray, rows: int, nearest: int) -> tuple[Router, int, float]:
    """Router, number of parts, and the probability up to which a query probes its parts.

    Queries are held out of the graph and of the router; that probability is the least which lets them meet the target share of
    their true neighbours in the sample.
    """
    parts = 1
    while rows / parts > PART_ROWS and len(points) / (2 * parts) > PART_SAMPLE:
        parts *= 2
    if parts == 1:
        return Router(points, np.zeros(len(points), np.int64), 1, epochs=0), 1, 1.0
    held = np.random.default_rng(4).permutation(len(points))[:min(SAMPLE_QUERIES, len(points) // 10)]
    fit = np.delete(points, held, axis=0)
    router = Router(fit, balanced_parts(graph(fit, min(GRAPH_NEIGHBOURS, len(fit) - 1)), parts), parts)
    lies_in = router.ranked(points)[0][:, 0]
    order, before = router.ranked(points[held])
    near = points[held] @ points.T
    near[np.arange(len(held)), held] = -np.inf
    true = np.argpartition(-near, min(nearest, near.shape[1] - 2), axis=1)[:, :nearest]
    mass = np.empty_like(before)
    np.put_along_axis(mass, order, before, axis=1)
    needed = np.sort(np.take_along_axis(mass, lies_in[true], axis=1).ravel())
    return router, parts, float(np.nextafter(needed[min(len(needed) - 1, int(TARGET_RECALL * len(needed)))], 2))


def bundles(parts: int, size: int) -> np.ndarray:
    """The bundle of every part: up to ``size`` parts that the first cuts left together, so that a task ranks the vectors of several small parts."""
    bits = parts.bit_length() - 1
    place = np.array([int(format(p, f"0{bits}b")[::-1], 2) if bits else 0 for p in range(parts)])
    return place // size


def search(table: DataFrame, nearest: int = NEAREST, every: int = QUERY_EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest found of every query, best first, ties to the smaller id."""
    spark = table.sparkSession
    rows = usable(table)
    vectors = stored(distinct_vectors(rows, nearest + 1), "vectors")
    n = vectors.count()
    queries = rows.where(F.col("vec_id") % every == 0)
    if not n:
        return spark.createDataFrame([], "query_id BIGINT, rank INT, vec_id BIGINT, score DOUBLE")
    share = min(1.0, SAMPLE / n)
    drawn = vectors.where(F.pmod(F.xxhash64(F.lit("sample"), "vec_key"), F.lit(GRAIN)) < int(share * GRAIN)).orderBy("vec_key")
    points = np.array(drawn.select("vec").toArrow().column("vec").combine_chunks().flatten().to_numpy()).reshape(-1, len(vectors.head()["vec"]))
    router, parts, upto = fitted(points, n, nearest)
    sent = spark.sparkContext.broadcast(router)
    bundle_of = bundles(parts, max(1, SLICE * parts // n))

    def matrix(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)

    def placed(upto: float):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    order, before = sent.value.ranked(matrix(batch.column("vec")))
                    probes = [o[b < upto].astype(np.int32) for o, b in zip(order, before)]
                    yield batch.append_column("parts", pa.array(probes, pa.list_(pa.int32())))
        return run

    bundle = F.array(*(F.lit(int(x)) for x in bundle_of))
    here = vectors.mapInArrow(placed(OWN_PART), "vec_key BIGINT, vec ARRAY<DOUBLE>, ids ARRAY<BIGINT>, parts ARRAY<INT>").select(
        "vec_key", "vec", "ids", F.col("parts")[0].alias("part"))
    here = stored(here.withColumn("bundle", F.get(bundle, "part")), "placed")
    slices = here.groupBy("bundle").count().select("bundle", F.ceil(F.col("count") / (2 * SLICE)).cast("int").alias("slices"))
    here = here.join(F.broadcast(slices), "bundle").withColumn("slice", F.pmod(F.col("vec_key"), F.col("slices")).cast("int"))
    asked = queries.mapInArrow(placed(upto), "vec_id BIGINT, vec ARRAY<DOUBLE>, parts ARRAY<INT>").select(
        F.col("vec_id").alias("query_id"), "vec", "parts",
        F.explode(F.array_distinct(F.transform("parts", lambda p: F.get(bundle, p)))).alias("bundle"))
    asked = asked.join(F.broadcast(slices), "bundle").select(
        "query_id", "vec", "parts", "bundle", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    blocks = max(1, -(-rows.count() // (every * BLOCK)))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    # a slice meets the blocks that ask for its bundle
    met = asked.select(F.col("bundle").alias("of_bundle"), F.col("slice").alias("of_slice"), F.col("block").alias("of_block")).distinct()
    here = here.join(met, (F.col("bundle") == F.col("of_bundle")) & (F.col("slice") == F.col("of_slice"))).select(
        "vec", "ids", "part", "bundle", "slice", (F.col("of_block") + F.lit(0)).alias("block"))

    def best(asked: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or near.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        points, part = np.vstack(near["vec"].to_numpy()), near["part"].to_numpy()
        counts = near["ids"].map(len).to_numpy()
        ids = np.concatenate(near["ids"].to_numpy())
        at = np.repeat(np.arange(len(near)), counts)
        members = [(p, np.flatnonzero(part == p)) for p in np.unique(part).tolist()]
        found = []
        for a in range(0, len(asked), 256):
            few = asked.iloc[a:a + 256]
            probed = [set(p.tolist()) for p in few["parts"]]
            given, near_by = np.vstack(few["vec"].to_numpy()), np.full((len(few), len(near)), -np.inf)
            for p, own in members:  # a query meets only the parts that it probes
                who = np.flatnonzero([p in x for x in probed])
                if len(who):
                    near_by[np.ix_(who, own)] = given[who] @ points[own].T
            k = min(nearest + 1, near_by.shape[1])
            floor = np.partition(near_by, near_by.shape[1] - k, axis=1)[:, near_by.shape[1] - k]
            for q, score, least in zip(few["query_id"].to_numpy(), near_by, floor):
                use = np.flatnonzero((score[at] >= least - 1e-9) & (score[at] > -np.inf))
                use = use[ids[use] != q]
                use = use[np.lexsort((ids[use], -score[at[use]]))][:nearest]
                found.append(pd.DataFrame({"query_id": q, "vec_id": ids[use], "score": score[at[use]]}))
        return pd.concat(found)

    keys = ["bundle", "slice", "block"]
    pairs = asked.groupBy(*keys).cogroup(here.groupBy(*keys)).applyInPandas(best, FOUND)
    order = F.sort_array(F.collect_set(F.struct((-F.col("score")).alias("away"), "vec_id")))
    ranked = pairs.groupBy("query_id").agg(F.slice(order, 1, nearest).alias("near"))
    return ranked.select("query_id", F.posexplode("near").alias("at", "found")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("found.vec_id").alias("vec_id"), (-F.col("found.away")).alias("score"))
