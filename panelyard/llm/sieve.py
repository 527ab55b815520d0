"""A bitmap of fixed size that keeps most rows out of a shuffle they would not survive.

Before a large table meets a selective one by a join, rows whose key's bit is not set are left where they are.  A set bit may belong to another key, so the join
still decides; no row it would keep is lost.  The bitmap has ``BITS`` bits whatever the tables' sizes; one that is full only stops saving work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

BITS = 1 << 26


def place_of(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BITS))


def bitmap(keys: DataFrame, key: str) -> np.ndarray:
    """The bits of all values of ``key``: 32 to a word, put together by Spark, one row for each word in use."""
    bits = keys.select(place_of(key).alias("place")).select(
        F.shiftright("place", 5).alias("word"), F.expr("shiftleft(1L, cast(place & 31 as int))").alias("bit"))
    words = bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(BITS // 32, np.uint32)
    out[np.array(words.column("word"), np.int64)] = np.array(words.column("bits"), np.int64).astype(np.uint32)
    return out


def likely(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows of ``rows`` whose ``key`` may be one of ``keys``."""
    sent = rows.sparkSession.sparkContext.broadcast(bitmap(keys, key))
    marked = rows.withColumn("__place", place_of(key))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column("__place").to_numpy()
            hit = sent.value[place >> 5] >> (place & 31).astype(np.uint32) & np.uint32(1)
            kept = batch.filter(pa.array(hit.astype(bool)))
            if kept.num_rows:
                yield kept

    return marked.mapInArrow(run, marked.schema).drop("__place")
