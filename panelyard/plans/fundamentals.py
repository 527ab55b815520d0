"""Reported facts -> point-in-time ratios."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from panelyard import vocab
from panelyard.functions.numeric import finite, ratio
from panelyard.operators.dedupe import keep_one

FACT_SCHEMA = (
    "MAP<STRING, STRUCT<units: MAP<STRING, ARRAY<STRUCT<start: DATE, end: DATE, val: DOUBLE, filed: DATE, "
    "form: STRING>>>>>"
)


def facts_from_json(raw: DataFrame, column: str = "facts") -> DataFrame:
    """Nested concept -> unit -> entries JSON as long rows; dollars only."""
    parsed = raw.select("ticker", F.from_json(column, FACT_SCHEMA).alias("tree"))
    units = parsed.select("ticker", F.explode("tree").alias("concept", "node")).select(
        "ticker", "concept", F.explode("node.units").alias("unit", "entries")).where("unit = 'USD'")
    return units.select("ticker", "concept", F.inline("entries")).select(
        "ticker", "concept", F.col("start").alias("period_start"), F.col("end").alias("period_end"), "val", "filed",
        "form")


def first_reported(facts: DataFrame) -> DataFrame:
    """One value per ticker, concept and period: the earliest filing, quarters only for flows."""
    days = F.date_diff("period_end", "period_start")
    quarter = days.between(*vocab.QUARTER_DAYS)
    usable = facts.where(
        F.col("form").isin("10-K", "10-Q") & F.col("filed").isNotNull()
        & (~F.col("concept").isin(*vocab.FLOW_CONCEPTS) | F.coalesce(quarter, F.lit(False))))
    return keep_one(usable.select("ticker", "concept", "period_end", "val", "filed"),
                    ["ticker", "concept", "period_end"], [F.col("filed"), F.col("val")])


def fundamentals(facts: DataFrame) -> DataFrame:
    """(ticker, period_end, filed, six ratios).  A ratio is known once all its period's inputs are."""
    wanted = vocab.FLOW_CONCEPTS + vocab.INSTANT_CONCEPTS
    first = first_reported(facts.where(F.col("concept").isin(*wanted)))
    wide = first.groupBy("ticker", "period_end").agg(
        F.max(F.when(~F.col("concept").isin(*vocab.REVENUE_CONCEPTS), F.col("filed"))).alias("filed_other"),
        *[F.max(F.when(F.col("concept") == c, F.col("val"))).alias(c) for c in wanted],
        *[F.max(F.when(F.col("concept") == c, F.col("filed"))).alias(f"filed_{c}") for c in vocab.REVENUE_CONCEPTS])
    # the first revenue concept that a filer uses at all stands for revenue throughout
    company = Window.partitionBy("ticker")
    revenue, filed_revenue = F.lit(None).cast("double"), F.lit(None).cast("date")
    for concept in reversed(vocab.REVENUE_CONCEPTS):
        used = F.count(concept).over(company) > 0
        revenue = F.when(used, F.col(concept)).otherwise(revenue)
        filed_revenue = F.when(used, F.col(f"filed_{concept}")).otherwise(filed_revenue)
    wide = wide.withColumns({"Revenue": revenue, "filed_revenue": filed_revenue})
    wide = wide.withColumn("filed", F.greatest("filed_other", "filed_revenue")).where(
        F.coalesce(F.col("Revenue"), *[F.col(c) for c in ("NetIncomeLoss", "GrossProfit") + vocab.INSTANT_CONCEPTS])
        .isNotNull())

    order = Window.partitionBy("ticker").orderBy("period_end")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    net = F.col("NetIncomeLoss")
    wide = wide.withColumns({
        "padded": F.last("Revenue", ignorenulls=True).over(so_far),
        "falling": F.coalesce(net < F.lag(net).over(order), F.lit(False)).cast("int"),
        "reports_net": F.count(net).over(company) > 0,
    })
    wide = wide.withColumns({
        "growth_yoy": ratio("padded", F.lag("padded", 4).over(order)) - 1.0,
        "turn": (F.col("falling") != F.coalesce(F.lag("falling").over(order), F.lit(-1))).cast("int"),
    })
    wide = wide.withColumn("run", F.sum("turn").over(so_far))
    run = Window.partitionBy("ticker", "run").orderBy("period_end").rowsBetween(Window.unboundedPreceding, 0)
    return wide.withColumn("streak", F.when(F.col("reports_net"), F.sum("falling").over(run))).where(
        "filed IS NOT NULL").select(
        "ticker", "period_end", "filed",
        finite("growth_yoy").alias("revenue_growth_yoy"),
        finite(ratio("GrossProfit", "Revenue")).alias("gross_margin"),
        finite(ratio("NetIncomeLoss", "Revenue")).alias("net_margin"),
        finite(ratio("Liabilities", "StockholdersEquity")).alias("debt_to_equity"),
        finite(ratio("AssetsCurrent", "LiabilitiesCurrent")).alias("current_ratio"),
        F.col("streak").cast("double").alias("earnings_surprise_streak"))


def fundamentals_by_day(ratios: DataFrame) -> DataFrame:
    """Fold reports filed on one day: each ratio from the latest period that has it."""
    return ratios.groupBy("ticker", "filed").agg(*[
        F.max_by(c, F.when(F.col(c).isNotNull(), F.col("period_end"))).alias(c) for c in vocab.FUNDAMENTALS])
