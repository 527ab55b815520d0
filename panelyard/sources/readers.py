"""Readers: files and feeds to typed tables.  All are lazy; filters and columns reach the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelyard import vocab
from panelyard.functions.calendar import last_business_day
from panelyard.functions.numeric import finite
from panelyard.functions.text import lookup
from panelyard.operators.dedupe import keep_one

UNIVERSE_SCHEMA = "ticker STRING, name STRING, sector STRING, date_added STRING, cik STRING"
CHANGES_SCHEMA = ("date STRING, added_ticker STRING, added_name STRING, removed_ticker STRING, removed_name STRING, "
                  "reason STRING")
BLOCK_SCHEMA = (
    "STRUCT<form: ARRAY<STRING>, filingDate: ARRAY<STRING>, acceptanceDateTime: ARRAY<STRING>, "
    "reportDate: ARRAY<STRING>, items: ARRAY<STRING>, accessionNumber: ARRAY<STRING>>")


def clean_bars(raw: DataFrame, load_order: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars with day dates, one row per ticker and day, closes present.

    The row last in ``load_order`` wins a day; without such a column "last" would mean nothing, so it must be named.
    """
    rows = raw.withColumn("date", F.col("date").cast("date"))
    if start is not None:
        rows = rows.where(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        rows = rows.where(F.col("date") <= F.lit(end).cast("date"))
    return keep_one(rows, ["ticker", "date"], [F.col(load_order)], last=True).where(finite("close").isNotNull())


def upsert_bars(stored: DataFrame, new: DataFrame, sequence: str) -> DataFrame:
    """New bars over stored ones; the newer load wins per ticker and day, and inside the new load the last in ``sequence``."""
    old = stored.withColumn("load_seq", F.struct(F.lit(0).alias("load"), F.lit(None).cast(new.schema[sequence].dataType).alias("place")))
    now = new.withColumn("load_seq", F.struct(F.lit(1).alias("load"), F.col(sequence).alias("place"))).drop(sequence)
    return clean_bars(old.unionByName(now), "load_seq").drop("load_seq")


def stale_tickers(bars: DataFrame, today: str) -> DataFrame:
    """Tickers whose last bar is older than the last expected session, and where their tail starts."""
    expected = last_business_day(F.lit(today).cast("date"))
    last = bars.groupBy("ticker").agg(F.max("date").alias("last_date"))
    return last.where(F.col("last_date") < expected).select(
        "ticker", "last_date", F.date_add("last_date", 1).alias("tail_start"))


def macro_table(vix: DataFrame, ten_year: DataFrame, three_month: DataFrame) -> DataFrame:
    """Outer-aligned macro series (date, value) -> date, vix, curve_slope."""
    legs = [(vix, "vix"), (ten_year, "y10"), (three_month, "y3m")]
    out = None
    for leg, name in legs:
        named = leg.select("date", F.col("value").alias(name))
        out = named if out is None else out.join(named, "date", "full_outer")
    return out.select("date", "vix", (F.col("y10") - F.col("y3m")).alias("curve_slope"))


def read_universe(spark: SparkSession, path: str) -> DataFrame:
    """Constituents file: bad dates and numbers become NULL; the sector names its fund."""
    raw = spark.read.schema(UNIVERSE_SCHEMA).option("header", True).csv(path)
    return raw.select("ticker", "name", "sector", F.try_to_date("date_added").alias("date_added"),
                      F.expr("try_cast(cik AS BIGINT)").alias("cik"),
                      lookup(vocab.SECTOR_FUNDS, F.col("sector")).alias("sector_etf"))


def cik_of(universe: DataFrame, ticker: str) -> DataFrame:
    """Point lookup that forgives case and blanks."""
    return universe.where(F.col("ticker") == ticker.strip().upper()).select("ticker", "cik")


def read_changes(spark: SparkSession, path: str | None) -> DataFrame:
    """Index changes; without a file an empty table of the same shape."""
    if path is None:
        raw = spark.createDataFrame([], CHANGES_SCHEMA)
    else:
        raw = spark.read.schema(CHANGES_SCHEMA).option("header", True).csv(path)

    def tidy(c):
        return F.nullif(F.upper(F.trim(F.col(c))), F.lit("")).alias(c)

    return raw.select(F.try_to_date("date").alias("date"), tidy("added_ticker"), "added_name", tidy("removed_ticker"),
                      "removed_name", "reason")


def filings_from_json(raw: DataFrame, column: str = "block") -> DataFrame:
    """Column-array JSON blocks (cik, ticker, block) -> one row per filing, one per accession.

    Short columns are padded with NULL; blocks without forms vanish.
    """
    b = raw.select("cik", "ticker", F.from_json(column, BLOCK_SCHEMA).alias("b"))
    fields = ("form", "filingDate", "acceptanceDateTime", "reportDate", "items", "accessionNumber")
    # zipping with NULL would give NULL: an absent column counts as an empty one
    columns = [F.coalesce(F.col(f"b.{f}"), F.array().cast("array<string>")).alias(f) for f in fields]
    rows = b.select("cik", "ticker", *columns).select("cik", "ticker", F.inline(F.arrays_zip(*fields)))
    typed = rows.where("form IS NOT NULL").select(
        "cik", "ticker", "form", F.try_to_date("filingDate").alias("filing_date"),
        F.try_to_timestamp("acceptanceDateTime").alias("acceptance_datetime"),
        F.try_to_date("reportDate").alias("report_date"), "items", F.col("accessionNumber").alias("accession"))
    return keep_one(typed, ["accession"], [F.col("filing_date"), F.col("form"), F.col("items")])


def clean_dividends(raw: DataFrame) -> DataFrame:
    """Positive payments by day."""
    return raw.where(F.col("dividend") > 0).select("ticker", F.col("ex_date").cast("date").alias("ex_date"), "dividend")


def out_of_fold(table: DataFrame, target: str, stage: str) -> DataFrame:
    """Stored out-of-fold rows of one target and stage, one per ticker and date."""
    rows = table.where((F.col("target") == target) & (F.col("stage") == stage))
    return keep_one(rows, ["ticker", "date"], [F.col("fold")])


STAGES = ("production", "candidate", "retired")
REPORT_KINDS = ("baselines", "ablations", "vol_benchmarks", "deployability")


def targets_of(registry: DataFrame, stage: str = "production") -> DataFrame:
    if stage not in STAGES:
        raise ValueError(f"unknown stage {stage!r}; use one of {STAGES}")
    return registry.where(F.col("stage") == stage).select("target").distinct()


def report_of(reports: DataFrame, target: str, kind: str, stage: str = "production") -> DataFrame:
    if kind not in REPORT_KINDS:
        raise ValueError(f"unknown report {kind!r}; known: {REPORT_KINDS}")
    return reports.where((F.col("target") == target) & (F.col("kind") == kind) & (F.col("stage") == stage))
