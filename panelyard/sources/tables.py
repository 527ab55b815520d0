"""Panel-shaped tables derived from the shared star-schema files.

Each property is a lazy DataFrame; nothing is cached or collected.  The days that bars, payments and reports
come from, which every feature job reads several times, can be written once first (:meth:`Tables.keep_bars`).
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from panelyard.session import stored

BAR_COLUMNS = ("ticker", "date", "open", "high", "low", "close", "volume")


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._kept = False
        self.resolved: DataFrame | None = None  # likewise the outcomes of the prediction log
        self.panel: DataFrame | None = None  # stored by the first step of a run that needs it

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _lines(self) -> DataFrame:
        part = self.base("part").select("p_partkey", F.col("p_brand").alias("ticker"))
        return self.base("lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).withColumn(
            "date", F.col("l_shipdate").cast("date"))

    @cached_property
    def ticks(self) -> DataFrame:
        """Every trade-like line with its place in the day."""
        return self._lines().where("l_quantity > 0").select(
            "ticker", "date", F.col("l_quantity").alias("qty"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
            F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("place"))

    @cached_property
    def daily(self) -> DataFrame:
        """One row per ticker and day with a line: its bar (of the lines with a quantity), and the sums that payments and reports come from."""
        qty, price, disc, tax = (F.col(f"l_{c}") for c in ("quantity", "extendedprice", "discount", "tax"))
        traded = qty > 0
        paid, place = F.when(traded, price / qty), F.when(traded, F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
        return self._lines().groupBy("ticker", "date").agg(
            F.min_by(paid, place).alias("open"), F.max(paid).alias("high"), F.min(paid).alias("low"),
            F.max_by(paid, place).alias("close"), F.sum(F.when(traded, qty)).alias("volume"),
            F.count(F.when(traded, 1)).alias("n_ticks"), F.count("*").alias("n_lines"), F.sum(price).alias("revenue"),
            F.sum(price * (1 - disc)).alias("gross"), F.sum(price * (F.lit(0.3) - disc - tax)).alias("net"))

    @cached_property
    def bars(self) -> DataFrame:
        return self.daily.where("n_ticks > 0").select(*BAR_COLUMNS)

    def keep_bars(self) -> "Tables":
        """Write the days once, for jobs that read them several times (own, benchmark and sector series, payments, reports)."""
        if not self._kept:
            self.daily = stored(self.daily, "daily")
            for name in ("bars", "dividends", "facts", "sector_bars", "benchmark_bars"):
                self.__dict__.pop(name, None)  # to be derived from the written days
            self._kept = True
        return self

    @cached_property
    def universe(self) -> DataFrame:
        no = F.substring("ticker", 7, 10).cast("int")
        return self.base("part").select(F.col("p_brand").alias("ticker")).distinct().select(
            "ticker", F.concat(F.lit("Company "), F.substring("ticker", 7, 10)).alias("name"),
            F.concat(F.lit("Sector "), (no % 5).cast("string")).alias("sector"),
            F.make_date(1994 + no % 4, F.lit(1), F.lit(15)).alias("date_added"), no.cast("bigint").alias("cik"),
            F.concat(F.lit("XL"), (no % 5).cast("string")).alias("sector_etf"))

    @cached_property
    def sector_bars(self) -> DataFrame:
        return self.bars.join(self.universe.select("ticker", "sector_etf"), "ticker").groupBy(
            "sector_etf", "date").agg(F.avg("close").alias("close"))

    @cached_property
    def benchmark_bars(self) -> DataFrame:
        return self.bars.groupBy("date").agg(F.avg("close").alias("close"))

    @cached_property
    def macro(self) -> DataFrame:
        def share(name):
            return F.avg((F.col("o_orderpriority") == name).cast("double"))

        return self.base("orders").groupBy(F.col("o_orderdate").cast("date").alias("date")).agg(
            (10 + 40 * share("1-URGENT")).alias("vix"), (2 - 8 * share("5-LOW")).alias("curve_slope"))

    @cached_property
    def index_changes(self) -> DataFrame:
        k = F.col("n_nationkey").cast("int")
        other = F.concat(F.lit("Brand#"), (1 + (k + 7) % 25).cast("string"))
        return self.base("nation").select(
            F.make_date(1996 + k % 5, 1 + k % 12, F.lit(15)).alias("date"),
            F.concat(F.lit("Brand#"), (1 + k).cast("string")).alias("added_ticker"),
            F.concat(F.lit("Company "), (1 + k).cast("string")).alias("added_name"),
            F.when(k % 6 == 5, other).otherwise(F.concat(F.lit("Old#"), k.cast("string"))).alias("removed_ticker"),
            F.lit(None).cast("string").alias("removed_name"),
            F.when(k % 2 == 0, "Acquired by another company.").otherwise("Market capitalization changes.")
            .alias("reason"))

    @cached_property
    def filings(self) -> DataFrame:
        key, cust = F.col("o_orderkey"), F.col("o_custkey")
        hour = F.make_dt_interval(hours=(key % 24).cast("int"))
        items = F.lit(None).cast("string")
        for slot, text in enumerate(
                ("2.02,9.01", "5.02", "1.01, 2.03,9.01", "12,7", "8.01,7.01", "4.02", "99.99")):
            items = F.when(key % 8 == slot, F.lit(text)).otherwise(items)
        return self.base("orders").select(
            (1 + cust % 25).alias("cik"), F.concat(F.lit("Brand#"), (1 + cust % 25).cast("string")).alias("ticker"),
            F.when(key % 25 == 1, "10-K").when(key % 5 == 0, "10-Q").otherwise("8-K").alias("form"),
            F.col("o_orderdate").cast("date").alias("filing_date"),
            F.when(key % 17 != 0, (F.col("o_orderdate") + hour).cast("timestamp")).alias("acceptance_datetime"),
            items.alias("items"), F.concat(F.lit("A-"), key.cast("string")).alias("accession"))

    @cached_property
    def dividends(self) -> DataFrame:
        days = self.daily.select("ticker", "date", "n_lines", F.year("date").alias("y"), F.quarter("date").alias("q"))
        paid = days.groupBy("ticker", "y", "q").agg(
            F.min("date").alias("ex_date"), ((25 + F.sum("n_lines") % 40).cast("double") / 100).alias("dividend"))
        no = F.substring("ticker", 7, 10).cast("int")
        return paid.where((no + 4 * F.col("y") + F.col("q")) % 11 > 2).select("ticker", "ex_date", "dividend")

    @cached_property
    def facts(self) -> DataFrame:
        q = self.daily.groupBy("ticker", F.trunc("date", "quarter").alias("period_start")).agg(
            F.sum("revenue").alias("Revenues"), F.sum("gross").alias("GrossProfit"), F.sum("net").alias("NetIncomeLoss"),
            F.sum("n_lines").cast("double").alias("n"))
        end = F.date_sub(F.add_months("period_start", 3), 1)
        q = q.withColumn("period_end", end).withColumns({
            "filed": F.date_add(end, 20 + F.substring("ticker", 7, 10).cast("int")),
            "Liabilities": 3 * F.col("n"), "StockholdersEquity": 1 + F.col("n")})
        concepts = ("Revenues", "GrossProfit", "NetIncomeLoss", "Liabilities", "StockholdersEquity")
        long = q.unpivot(["ticker", "period_start", "period_end", "filed"], list(concepts), "concept", "val")
        instant = F.col("concept").isin("Liabilities", "StockholdersEquity")
        return long.select("ticker", "concept", F.when(~instant, F.col("period_start")).alias("period_start"),
                           "period_end", "val", "filed", F.lit("10-Q").alias("form"))

    @cached_property
    def articles(self) -> DataFrame:
        doc, n = F.col("doc_id"), F.col("n_chars")
        title = F.regexp_extract("text", r"^[^.\n]*", 0)  # up to the first full stop or line end; the rest is the summary
        source = F.col("source")
        for slot, name in enumerate(("Reuters", "SEC EDGAR", "cnbc ", "Zacks", "MarketWatch")):
            source = F.when(doc % 6 == slot, F.lit(name)).otherwise(source)
        published = F.lit("2001-11-04 00:00:00").cast("timestamp") - F.make_dt_interval(hours=(doc % 240).cast("int"))
        pos, neg = (n % 61).cast("double") / 100, (n % 37).cast("double") / 100
        return self.base("documents").select(
            F.concat(F.lit("Brand#"), (1 + doc % 25).cast("string")).alias("ticker"), "doc_id",
            title.alias("title"), F.col("text").substr(F.length(title) + 1, F.length("text")).alias("summary"),
            published.alias("published"), source.alias("source"), pos.alias("positive"), neg.alias("negative"),
            (1 - pos - neg).alias("neutral"))

    @cached_property
    def oof(self) -> DataFrame:
        nxt = F.lead("close").over(Window.partitionBy("ticker").orderBy("date"))
        vol, doy = F.col("volume").cast("bigint"), F.dayofyear("date")

        def p(step):
            return (20 + (vol * step + doy) % 60).cast("double") / 100

        return self.bars.select("ticker", "date", "close", "volume", nxt.alias("next")).select(
            "ticker", "date", (F.year("date") - 1995).cast("bigint").alias("fold"),
            F.when(F.col("next").isNull(), None).when(F.abs(F.col("next") / F.col("close") - 1) >= 0.25, 1)
            .otherwise(0).alias("y"),
            p(7).alias("p_candidate"), p(3).alias("p_incumbent"), "close")

    @cached_property
    def predictions(self) -> DataFrame:
        p = F.col("p_candidate")
        return self.oof.select(
            F.concat(F.col("ticker"), F.lit("|"), F.col("date").cast("string")).alias("prediction_id"),
            "ticker", F.col("date").alias("as_of"), F.lit("magnitude_1d").alias("target"),
            F.lit("magnitude").alias("kind"), F.lit(1).alias("horizon_days"),
            F.lit(1.0).alias("threshold_sigmas"), F.lit(0.25).alias("label_scale"), F.col("close").alias("last_close"),
            p.alias("p_large_move"), F.when(p >= 0.5, "LARGE_MOVE").otherwise("QUIET").alias("predicted_class"),
            F.when(F.year("date") < 1999, "fp_a").otherwise("fp_b").alias("model_fingerprint"))
