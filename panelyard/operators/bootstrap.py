"""Block bootstrap of pooled Brier edges.

Rows are folded to one per block (fold or date) before any resampling: the blocks of a group are
bounded by the calendar.  Repetitions are generated from the block count, look their blocks up by
number, and are summed before they are shuffled; panel rows are never replicated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from panelyard import vocab
from panelyard.functions.draws import draw
from panelyard.session import stored

ROUNDING = 1e-12  # two sums of a block that are nearer than this share of them are a tie: only their order of adding differs
BROADCAST_BLOCKS = 1_000_000  # a key and four numbers each: some 50 MB at most


def blocks_of(rows: DataFrame, group: list[str], block: str, model: str, reference: str) -> DataFrame:
    """Sum of squared errors of both sides per block."""
    return rows.groupBy(*group, block).agg(
        F.count("*").alias("n"), F.sum(model).alias("sum_model"), F.sum(reference).alias("sum_reference"))


def paired_edges(blocks: DataFrame, group: list[str], block: str, level: float = 0.90, seed: int = 0,
                 reps: int = vocab.BOOTSTRAP_REPS) -> DataFrame:
    """Pooled edge, block wins and bootstrap intervals, one row per group."""
    spark = blocks.sparkSession
    blocks = stored(blocks, "blocks")  # read by every step below
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbered = blocks.select(
        *group, "n", "sum_model", "sum_reference",
        (F.row_number().over(Window.partitionBy(*group).orderBy(block)) - 1).alias("i"))
    gathered = numbered.groupBy(*group).agg(
        F.sum("n").alias("n"), F.count("*").alias("n_blocks"),
        (1.0 - F.sum("sum_model") / F.sum("sum_reference")).alias("pooled"),
        F.sum((F.col("sum_model") < F.col("sum_reference") * (1.0 - ROUNDING)).cast("bigint")).alias("wins"),
        F.avg(1.0 - F.col("sum_model") / F.col("sum_reference")).alias("block_mean"),
    )
    each = gathered.select(*group, "n_blocks", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep")).repartition(
        width, *group, "rep")
    picks = each.select(*group, "rep", "n_blocks", F.explode(
        F.sequence(F.lit(0), (F.col("n_blocks") - 1).cast("int"))).alias("slot")).select(
        *group, "rep", draw(seed, F.col("rep"), F.col("slot"), F.col("n_blocks")).alias("i"))
    # the draws are generated, so the optimizer cannot see how many they are: say which side is small
    small = blocks.count() <= BROADCAST_BLOCKS
    drawn = picks.join(F.broadcast(numbered) if small else numbered.hint("merge"), [*group, "i"]).groupBy(*group, "rep").agg(
        F.sum("sum_model").alias("m"), F.sum("sum_reference").alias("r"))
    tail = (1.0 - level) / 2.0
    spread = drawn.groupBy(*group).agg(F.percentile(
        F.coalesce(1.0 - F.try_divide("m", "r"), F.lit(0.0)),
        F.array(*[F.lit(x) for x in (0.05, 0.95, tail, 1.0 - tail)])).alias("q"))
    return gathered.join(spread, group).select(
        *group, "n", "n_blocks", "pooled", "wins", "block_mean", F.col("q")[0].alias("ci90_low"),
        F.col("q")[1].alias("ci90_high"), F.col("q")[2].alias("ci_low"), F.col("q")[3].alias("ci_high"))
