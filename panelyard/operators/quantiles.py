"""Exact quantiles of large groups.

The built-in exact percentile gathers all distinct values of a group in one task.  Here the
wanted ranks are narrowed down in three aggregate passes instead: coarse buckets on a logarithmic
scale, then linear slices of the few buckets that hold a wanted rank, then the distinct values of
the few slices that still do.  Every pass combines on the map side; no task sees a whole group.
The wanted buckets are written between passes: a written table has a known size, so Spark sends
it to all tasks when it is small and the values themselves are not shuffled to meet it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelyard.session import stored

COARSE_PER_E = 64      # buckets per factor e
FINEST = 1e-9          # below this magnitude the coarse scale is linear
SLICES = 4096          # linear slices of one coarse bucket


def _coarse(v: Column) -> Column:
    # ln1p is monotone, so bucket order is value order
    return (F.signum(v) * F.floor(F.log1p(F.abs(v) / FINEST) * COARSE_PER_E)).cast("int")


def _slice(v: Column, low: Column, high: Column) -> Column:
    share = F.try_divide(v - low, high - low)
    return F.coalesce(F.floor(share * (SLICES - 1)), F.lit(0)).cast("int")


def _wanted(probs: list[float], total: Column) -> Column:
    """Distinct 0-based ranks that interpolation at the given shares needs."""
    return F.array_distinct(F.flatten(F.transform(
        F.array(*[F.lit(float(p)) for p in probs]),
        lambda p: F.array(F.floor(p * (total - 1)), F.ceil(p * (total - 1))),
    )))


def _holding(ranks: Column, start: Column, n: Column) -> Column:
    return F.filter(ranks, lambda r: (r >= start) & (r < start + n))


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float]) -> DataFrame:
    """One row per key: ``q`` (linear interpolation, one entry per share) and the count ``n``.

    NULL values are ignored; keys without values are absent.
    """
    v = df.select(*keys, F.col(value).cast("double").alias("v")).where("v IS NOT NULL")
    v = v.withColumn("b", _coarse(F.col("v")))

    def running(*by, order):
        return Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)

    coarse = v.groupBy(*keys, "b").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    coarse = (
        coarse.withColumn("start", F.sum("n").over(running(*keys, order="b")) - F.col("n"))
        .withColumn("total", F.sum("n").over(Window.partitionBy(*keys)))
        .withColumn("ranks", _holding(_wanted(probs, F.col("total")), F.col("start"), F.col("n")))
        .where(F.size("ranks") > 0)
        .select(*keys, "b", "low", "high", "start", "total", "ranks")
    )

    coarse = stored(coarse, "ranks")
    sliced = v.join(coarse, [*keys, "b"]).withColumn("s", _slice(F.col("v"), F.col("low"), F.col("high")))
    fine = (
        sliced.groupBy(*keys, "b", "s", "low", "high", "start", "total", "ranks").agg(F.count("*").alias("n"))
        .withColumn("start", F.col("start") + F.sum("n").over(running(*keys, "b", order="s")) - F.col("n"))
        .withColumn("ranks", _holding(F.col("ranks"), F.col("start"), F.col("n")))
        .where(F.size("ranks") > 0)
        .select(*keys, "b", "s", "low", "high", "start", "total", "ranks")
    )

    fine = stored(fine, "ranks")
    exact = (
        v.join(fine, [*keys, "b"])
        .where(_slice(F.col("v"), F.col("low"), F.col("high")) == F.col("s"))
        .groupBy(*keys, "b", "s", "v", "start", "total", "ranks").agg(F.count("*").alias("n"))
        .withColumn("start", F.col("start") + F.sum("n").over(running(*keys, "b", "s", order="v")) - F.col("n"))
        .select(*keys, "total", "v", F.explode(_holding(F.col("ranks"), F.col("start"), F.col("n"))).alias("rank"))
    )
    found = exact.groupBy(*keys, F.col("total").alias("n")).agg(
        F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"))

    def interpolate(p: float) -> Column:
        place = F.lit(float(p)) * (F.col("n") - 1)
        low, high = F.col("at")[F.floor(place)], F.col("at")[F.ceil(place)]
        return low + (high - low) * (place - F.floor(place))

    return found.select(*keys, "n", F.array(*[interpolate(p) for p in probs]).alias("q"))
