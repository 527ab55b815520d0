"""Connected components of a table of links, by alternating large-star and small-star steps.

Every step is a partial aggregate and a join on the smaller ends, so a node with many links is no
single task's work.  Each step is written to the shared folder, which cuts the lineage and lets a run go on after lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from panelyard.session import stored


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """``pairs`` (a > b).  Large star: every greater neighbour of a node meets the node's least one; small star: the lesser ones do."""
    if large:
        seen = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).union(pairs.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        seen = pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = seen.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    met = seen.join(least, "u")
    if large:
        out = met.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = met.where(F.col("v") != F.col("m")).select(F.col("v").alias("a"), F.col("m").alias("b")).union(
            least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, label: of every node with a link, the least node it can reach.  ``links``: a, b (both orders welcome, BIGINT)."""
    pairs = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    pairs = stored(pairs, "links")
    before = None
    most = pairs.count()  # a step gives no more links than it gets
    while True:
        pairs = stored(_star(_star(pairs, True), False), "star", most)
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        if before == now:
            break
        before, most = now, now[0]
    leaders = pairs.select(F.col("b").alias("node")).distinct()
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("label")).union(leaders.select("node", F.col("node").alias("label")))
