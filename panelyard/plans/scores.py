"""Scored tables: sectors, leaderboard and staleness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelyard.functions.calendar import business_days
from panelyard.operators.single import beside


def with_sector(scores: DataFrame, universe: DataFrame) -> DataFrame:
    return scores.join(universe.select("ticker", "sector"), "ticker", "left")


def leaderboard(scores: DataFrame, target: str, *, sector: str | None = None, limit: int = 25,
                as_of: str | None = None) -> DataFrame:
    """Top rows of one target on one day (default: the latest), by probability then ticker.

    An unknown target is an error that names the known ones, not an empty board.
    """
    rows = scores.where(F.col("target") == target)
    if rows.isEmpty():
        some = [r.target for r in scores.groupBy("target").count().orderBy("target").head(20)]  # for the message only
        raise ValueError(f"unknown target {target!r}; scored targets: {', '.join(some)}")
    if sector is not None:
        rows = rows.where(F.col("sector") == sector)
    if as_of is None:
        last = scores.agg(F.max("as_of").alias("as_of"))
        rows = rows.join(last, "as_of", "left_semi")
    else:
        rows = rows.where(F.col("as_of") == F.lit(as_of).cast("date"))
    return rows.orderBy(F.desc("probability"), "ticker").limit(limit)


def stale_days(last: Column | str, today: str) -> Column:
    """Business days after ``last`` up to ``today``."""
    return F.greatest(business_days(last, F.lit(today).cast("date")) - 1, F.lit(0)).cast("int")


def recent_closes(bars: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("ticker").orderBy(F.desc("date"))
    return bars.where("close IS NOT NULL").select("ticker", "date", "close", F.row_number().over(w).alias("k")).where(
        F.col("k") <= n).drop("k")


def sector_counts(universe: DataFrame) -> DataFrame:
    return universe.groupBy("sector").agg(F.count("*").alias("n"))


def checked(latest: DataFrame, asked: DataFrame, features) -> DataFrame:
    """One row per asked ticker with ``reject``: NULL for rows that can be scored, else the first reason why not.

    ``latest``: ticker, date, last_close, label_scale, rel_label_scale and the features.  One name that cannot be scored does not stop the others.
    """
    there = latest.withColumn("seen", F.lit(True))
    rows = asked.select("ticker").distinct().join(there, "ticker", "left")

    def unusable(c: str) -> Column:
        return F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf")) | (F.col(c) <= 0)

    known = F.lit(False)
    for c in features:
        known = known | (F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
    reason = F.when(F.col("seen").isNull(), "no price history").when(unusable("last_close"), "no usable close").when(
        unusable("label_scale"), "too little history to scale a move").when(~known, "no feature is known")
    return rows.withColumn("reject", reason).drop("seen")


def accepted(rows: DataFrame) -> DataFrame:
    return rows.where("reject IS NULL").drop("reject")


def rejected(rows: DataFrame) -> DataFrame:
    """(ticker, as_of, reason) of the names that were not scored."""
    return rows.where("reject IS NOT NULL").select("ticker", F.col("date").alias("as_of"), F.col("reject").alias("reason"))


def _block(table: DataFrame | None, target: str, name: str, columns, missing: str) -> DataFrame:
    """One row: a struct of the target's row of ``table``, or why there is none."""
    one = table.where(F.col("target") == target).limit(1) if table is not None else None
    fields = [c for c in columns]
    if one is None:
        return None
    return one.agg(F.max(F.struct(F.lit(True).alias("available"), F.lit(None).cast("string").alias("reason"), *fields)).alias("found")).select(
        F.coalesce("found", F.struct(F.lit(False).alias("available"), F.lit(missing).alias("reason"), *[
            F.lit(None).cast(table.schema[c].dataType).alias(c) for c in fields])).alias(name))


def board(scores: DataFrame, target: str, today: str, *, sector: str | None = None, limit: int = 25, as_of: str | None = None,
          rejects: DataFrame | None = None, guard: DataFrame | None = None, deployable: DataFrame | None = None) -> DataFrame:
    """The leaderboard as one row with the facts that tell how far to trust it.

    Facts describe the day that is shown: its age in business days, tickers, targets and sectors scored, names that failed (latest day only), whether
    the model's record is positive in regimes like today's, and whether anything simpler beats it.  A day without scores is a board that is not available, with a reason.
    """
    latest = beside(scores, scores.agg(F.max("as_of").alias("last_run")))
    chosen = F.lit(as_of).cast("date") if as_of is not None else F.col("last_run")
    day = latest.where(F.col("as_of") == chosen)
    facts = day.agg(
        F.count("*").alias("n"), F.max("as_of").alias("as_of"), F.countDistinct("ticker").alias("tickers_scored"),
        F.array_sort(F.collect_set("target")).alias("targets"), F.array_sort(F.collect_set("sector")).alias("sectors"),
        F.coalesce(F.max(F.col("as_of") == F.col("last_run")), F.lit(False)).alias("is_latest"))
    if not day.isEmpty():
        top = leaderboard(scores, target, sector=sector, limit=limit, as_of=str(facts.first()["as_of"]))
        rows = top.agg(F.sort_array(F.collect_list(F.struct((-F.col("probability")).alias("order"), "ticker", "sector", "probability"))).alias("ranked"))
        facts = beside(facts, rows.select(F.transform("ranked", lambda r: F.struct(r["ticker"].alias("ticker"), r["sector"].alias("sector"),
                                                                                   r["probability"].alias("probability"))).alias("rows")))
    else:
        facts = facts.withColumn("rows", F.lit(None))
    failures = rejects.agg(F.count("*").alias("failures")) if rejects is not None else scores.limit(0).agg(F.count("*").alias("failures"))
    out = beside(facts, failures)
    for table, name, columns, missing in (
            (guard, "regime_guard", ("worst_regime", "worst_skill", "reliable_now"), "no regime record of this target"),
            (deployable, "deployability", ("deployable", "families_measured"), "this target was not compared with simpler models")):
        block = _block(table, target, name, columns, missing)
        out = out.withColumn(name, F.lit(None)) if block is None else beside(out, block)
    old = stale_days("as_of", today)
    there = F.col("n") > 0
    return out.select(
        there.alias("available"), F.when(~there, F.lit(f"no scores stored for {as_of or 'any day'}")).alias("reason"), "as_of", F.lit(target).alias("target"),
        F.lit(sector).cast("string").alias("sector"), "tickers_scored", F.when(F.col("is_latest"), F.col("failures")).alias("failures"), "targets", "sectors",
        F.when(there, old).alias("stale_trading_days"), F.when(there, old > 1).alias("stale"), "regime_guard", "deployability", "rows")
