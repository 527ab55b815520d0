"""Exact nearest neighbours under an eligibility rule.

History is cut into slices and queries into blocks; every (block, slice) pair is one group of a
cogrouped map that keeps the k best per query and emits nothing else.  Both sides of a group are
bounded by the slice and block sizes, whatever the data looks like, and eligibility is applied
before ranking, so ineligible rows can never crowd out eligible ones.

Inside a group a matrix product of two tiles bounds all distances from below; only pairs that may
still be among the k best are measured exactly.  Slices and blocks are equally large, so that rows
are copied as seldom as a group's memory allows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

SLICE_ROWS = 50_000
BLOCK_ROWS = 50_000
TILE_QUERIES, TILE_ROWS = 512, 2_048
TASKS = 64  # groups that a large job should at least have
PAIR_SCHEMA = "query_id STRING, id STRING, distance DOUBLE"


def _codes(owners: np.ndarray, known: dict) -> np.ndarray:
    return np.array([known.setdefault(o, len(known)) for o in owners], dtype=np.int64)


def _ranked(query: np.ndarray, place: np.ndarray, d: np.ndarray, k: int):
    """The k first pairs of every query by (distance, place)."""
    order = np.lexsort((place, d, query))
    query, place, d = query[order], place[order], d[order]
    nth = np.arange(len(query)) - np.searchsorted(query, query)
    return query[nth < k], place[nth < k], d[nth < k]


def _distances(points: np.ndarray, asked: np.ndarray) -> np.ndarray:
    return np.sqrt(np.square(points - asked).sum(axis=1))


def _block_best(points: np.ndarray, owners: np.ndarray, days: np.ndarray, asked: np.ndarray, asked_owners: np.ndarray,
                asked_days: np.ndarray, k: int):
    """(query, place, distance) of the k nearest eligible ``points`` of every row of ``asked``; ties to the smaller place.

    A missing day of a query allows any day.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        half = np.square(points).sum(axis=1) / 2
        norm = np.square(asked).sum(axis=1)
        usable = np.flatnonzero(np.isfinite(half))  # the others are farther than all of these
        tall = half[usable].max(initial=0.0)
    plain = np.flatnonzero(~np.isfinite(norm))
    out_q, out_p, out_d = [], [], []

    def allowed(q, p):
        return (owners[p] != asked_owners[q]) & (np.isnan(asked_days[q]) | (days[p] < asked_days[q]))

    fast = np.flatnonzero(np.isfinite(norm))
    for start in range(0, len(fast), TILE_QUERIES):
        mine = fast[start:start + TILE_QUERIES]
        x = asked[mine]
        wide = np.hstack([x, np.full((len(mine), 1), -1.0)])
        # what rounding can move an inner product less half a norm by, with room to spare
        slack = 1e-14 * (x.shape[1] + 8) * (norm[mine] + 2 * tall)
        bound = np.full(len(mine), -np.inf)  # a pair below its query's bound cannot be among the k best
        bq, bp, bd = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        for at in range(0, len(usable), TILE_ROWS):
            tile = usable[at:at + TILE_ROWS]
            near = wide @ np.hstack([points[tile], half[tile, None]]).T  # half a norm less: the larger, the nearer
            floor = bound.copy()
            open_ = np.flatnonzero(bound == -np.inf)
            if len(open_) and len(tile) > k:
                ok = allowed(mine[open_][:, None], tile[None, :])
                floor[open_] = np.partition(np.where(ok, near[open_], -np.inf), len(tile) - k, axis=1)[:, len(tile) - k] - 2 * slack[open_]
            q, p = np.divmod(np.flatnonzero(near >= floor[:, None]), len(tile))
            keep = allowed(mine[q], tile[p])
            q, p = q[keep], tile[p[keep]]
            if not len(q):
                continue
            d = np.concatenate([_distances(points[p[i:i + 65_536]], x[q[i:i + 65_536]]) for i in range(0, len(q), 65_536)])
            bq, bp, bd = _ranked(np.concatenate([bq, q]), np.concatenate([bp, p]), np.concatenate([bd, d]), k)
            full = np.flatnonzero(np.bincount(bq, minlength=len(mine)) == k)
            worst = np.zeros(len(mine))
            np.maximum.at(worst, bq, bd)
            bound[full] = (norm[mine[full]] - np.square(worst[full])) / 2 - 2 * slack[full]
        few = np.bincount(bq, minlength=len(mine)) < k
        if len(usable) < len(points) and few.any():  # rows that have no finite length come last, but they come
            plain = np.concatenate([plain, mine[few]])
            bq, bp, bd = bq[~few[bq]], bp[~few[bq]], bd[~few[bq]]
        out_q.append(mine[bq]), out_p.append(bp), out_d.append(bd)
    for q in plain:
        p = np.flatnonzero(allowed(np.full(len(points), q), np.arange(len(points))))
        with np.errstate(over="ignore", invalid="ignore"):
            d = _distances(points[p], asked[q])
        order = np.lexsort((p, d))[:k]
        out_q.append(np.full(len(order), q)), out_p.append(p[order]), out_d.append(d[order])
    return tuple(np.concatenate(parts) if parts else np.empty(0, np.int64) for parts in (out_q, out_p, out_d))


def _cut(n: int, m: int) -> tuple[int, int]:
    """Slices of the history and blocks of the queries: enough groups for all cores where the pairs are many, but none so
    small that copying rows is most of its work."""
    slices, blocks = max(1, -(-n // SLICE_ROWS)), max(1, -(-m // BLOCK_ROWS))
    while slices * blocks < TASKS and max(n // slices, m // blocks) > 2 * TILE_ROWS:
        slices, blocks = (slices * 2, blocks) if n // slices >= m // blocks else (slices, blocks * 2)
    return slices, blocks


def nearest(history: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """k nearest history rows per query by Euclidean distance, closest first.

    ``history``: id STRING, owner STRING, day INT, vec ARRAY<DOUBLE>.
    ``queries``: query_id STRING, owner STRING, day INT, vec ARRAY<DOUBLE>.
    Eligible: history ``day`` before the query's (NULL query day: any), other owner.  Ties go to
    the smaller id; distances that are not a number come last.
    """
    history, queries = (side.where("owner IS NOT NULL") for side in (history, queries))  # an unknown owner is no other owner
    slices, blocks = _cut(history.count(), queries.count())
    left = history.select("id", "owner", "day", "vec").withColumn("slice", F.pmod(F.xxhash64("id"), F.lit(slices)).cast("int"))
    left = left.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    # names of their own: a cogrouped map loses columns of its second side that both sides have from one table
    right = queries.select("query_id", *[F.col(c).alias(f"asked_{c}") for c in ("owner", "day", "vec")]).withColumn(
        "block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    right = right.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    # a group each to its own partition as far as that goes
    width = max(int(history.sparkSession.conf.get("spark.sql.shuffle.partitions")), slices * blocks)
    left, right = (side.repartition(width, "block", "slice") for side in (left, right))

    def best(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or asked.empty:
            return pd.DataFrame({"query_id": [], "id": [], "distance": []})
        rows = rows.sort_values("id")  # a smaller place is a smaller id
        known: dict = {}
        owners, asked_owners = _codes(rows["owner"].to_numpy(), known), _codes(asked["asked_owner"].to_numpy(), known)
        q, p, d = _block_best(
            np.vstack(rows["vec"].to_numpy()).astype(float), owners, rows["day"].to_numpy(dtype=float),
            np.vstack(asked["asked_vec"].to_numpy()).astype(float), asked_owners, asked["asked_day"].to_numpy(dtype=float), k)
        return pd.DataFrame({"query_id": asked["query_id"].to_numpy()[q], "id": rows["id"].to_numpy()[p], "distance": d})

    pairs = left.groupBy("block", "slice").cogroup(right.groupBy("block", "slice")).applyInPandas(best, PAIR_SCHEMA).withColumn(
        "distance", F.coalesce("distance", F.lit(float("nan"))))  # pandas hands NaN over as NULL, which would come first
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    return pairs.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
