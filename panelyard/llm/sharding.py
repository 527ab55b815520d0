"""Sharding by a weighted hash tree: a row descends region, rack and shard levels by hash draws.

At each level every child draws ``-ln(u) / weight`` from a hash of the key and the child's own name, and
the smallest draw wins, so a child is chosen in proportion to its weight.  A change of weights moves
rows only between the changed child and its siblings; all other subtrees keep their rows.  A new
shard therefore opens a region of its own (one rack, one shard): the only new draw at the top level
is that region's, and rows it wins can only go to the new shard.

Law: ``key`` — the doc_id and the shard count decide.  Defined cases: a null id is the empty key; a
null text has size 1 and the checksum of no bytes; repeated rows share a shard and take neighbouring
slots; an empty table gives no rows; further columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

BASE_SHARDS = 16
RACK_SHARDS = 4
REGION_RACKS = 2
SLOT_DIGITS = 3  # hex digits of the slot bucket: 4,096 buckets in each shard


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def standard_tree(shards: int) -> list[Leaf]:
    """Racks of four and regions of two racks; each shard beyond the first sixteen has its own region."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    per_region = RACK_SHARDS * REGION_RACKS
    base = [Leaf(s // per_region, s // RACK_SHARDS, s) for s in range(min(shards, BASE_SHARDS))]
    past = [Leaf(BASE_SHARDS // per_region + i, BASE_SHARDS // RACK_SHARDS + i, BASE_SHARDS + i)
            for i in range(max(0, shards - BASE_SHARDS))]
    return base + past


def draw(key: Column, level: str, node: int, weight: float) -> Column:
    """An exponential variate of rate ``weight`` that depends on the key and the node alone."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{level}{node}:"), key)), 1, 13)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))
    return -F.ln(u) / F.lit(float(weight))


def choose(key: Column, level: str, weights: dict[int, float]) -> Column:
    nodes = sorted(n for n, w in weights.items() if w > 0)
    if len(nodes) == 1:
        return F.lit(nodes[0])
    best = F.array_min(F.array(*(F.struct(draw(key, level, n, weights[n]).alias("d"), F.lit(n).alias("node")) for n in nodes)))
    return best["node"]


def descend(rows: DataFrame, key: str, leaves: list[Leaf], prefix: str = "") -> DataFrame:
    """``rows`` with columns region, rack and shard (names prefixed) of the weighted tree."""
    regions: dict[int, float] = {}
    racks: dict[int, dict[int, float]] = {}
    shards: dict[int, dict[int, float]] = {}
    for leaf in leaves:
        regions[leaf.region] = regions.get(leaf.region, 0) + leaf.weight
        inner = racks.setdefault(leaf.region, {})
        inner[leaf.rack] = inner.get(leaf.rack, 0) + leaf.weight
        shards.setdefault(leaf.rack, {})[leaf.shard] = leaf.weight

    def below(at: str, level: str, children: dict[int, dict[int, float]]) -> Column:
        out = F
        for parent, nodes in children.items():
            out = out.when(F.col(at) == parent, choose(F.col(key), level, nodes))
        return out

    rows = rows.withColumn(f"{prefix}region", choose(F.col(key), "region", regions))
    rows = rows.withColumn(f"{prefix}rack", below(f"{prefix}region", "rack", racks))
    return rows.withColumn(f"{prefix}shard", below(f"{prefix}rack", "shard", shards))


def slots(rows: DataFrame, group: str, bucket: str, order: list[str]) -> DataFrame:
    """Gapless numbers within each ``group``: counted per bucket first, so no task orders a whole group."""
    counts = rows.groupBy(group, bucket).count()
    before = F.sum("count").over(Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(F.col(group).alias("of_group"), F.col(bucket).alias("of_bucket"), F.coalesce(before, F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy(group, bucket).orderBy(*order))
    numbered = rows.withColumn("inside", inside)
    return numbered.join(starts, (F.col(group) == F.col("of_group")) & (F.col(bucket) == F.col("of_bucket"))).withColumn(
        "slot", F.col("start") + F.col("inside") - 1).drop("of_group", "of_bucket", "start", "inside")


def shard_documents(docs: DataFrame, shards: int = BASE_SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, region, rack of every row of ``docs``."""
    text = F.coalesce(F.encode("text", "UTF-8"), F.lit("").cast("binary"))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = rows.withColumn("key", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = rows.withColumn("bucket", F.substring(F.md5("key"), 1, SLOT_DIGITS))
    rows = descend(rows, "key", standard_tree(shards))
    rows = descend(rows, "key", standard_tree(shards + 1), "grown_")
    rows = slots(rows, "shard", "bucket", ["doc_id", "size", "text_crc32"])
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"),
                       F.col("slot").cast("bigint").alias("slot"), F.col("grown_shard").cast("int").alias("grown_shard"), "region", "rack")
