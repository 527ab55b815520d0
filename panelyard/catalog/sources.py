"""Readers and sinks, run on data derived from the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelyard.catalog.base import big, query, s6, step
from panelyard.catalog.timeline import AS_OF
from panelyard.functions.numeric import settle
from panelyard.operators.single import beside
from panelyard.plans import sentiment
from panelyard.plans.fundamentals import facts_from_json
from panelyard.plans.panel import build_panel
from panelyard.session import new_path, stored
from panelyard.sources import readers
from panelyard.sources.writers import write_report

step("tick_last", """
SELECT p.p_brand AS ticker, CAST(l.l_shipdate AS DATE) AS date, max_by(l.l_extendedprice / l.l_quantity,
       lpad(CAST(l_orderkey AS VARCHAR), 12, '0') || lpad(CAST(l_linenumber AS VARCHAR), 4, '0') || lpad(CAST(l_partkey AS VARCHAR), 12, '0')
       || lpad(CAST(l_suppkey AS VARCHAR), 12, '0') || lpad(CAST(l_extendedprice AS VARCHAR), 20, '0')) AS close
FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey WHERE l.l_quantity > 0 GROUP BY ALL
""")


@query("src_bars", "SELECT ticker, date, close FROM tick_last WHERE date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'")
def src_bars(t):
    """Raw rows -> one bar per ticker and day inside a date range, the last row of the day wins."""
    raw = t.ticks.select("ticker", "date", F.col("price").alias("close"), "place")
    return readers.clean_bars(raw, "place", "1996-01-01", "2000-12-31").drop("place")


@query("src_bars_upsert", """
SELECT ticker, date, CASE WHEN date >= DATE '2000-01-01' THEN high ELSE close END AS close FROM bars
""")
def src_bars_upsert(t):
    """A refreshed tail over stored bars: the new values win."""
    old = t.bars.where(F.col("date") < "2001-01-01").select("ticker", "date", "close")
    late = t.bars.where(F.col("date") >= "2000-01-01")
    new = late.select("ticker", "date", F.col("open").alias("close"), F.lit(0).alias("seq")).unionByName(
        late.select("ticker", "date", F.col("high").alias("close"), F.lit(1).alias("seq")))
    return readers.upsert_bars(old, new, "seq")


@query("src_stale_bars", "SELECT ticker, max(date) AS last_date, CAST(max(date) + INTERVAL '1' DAY AS DATE) AS tail_start FROM bars GROUP BY ticker HAVING max(date) < DATE '2001-11-02'")
def src_stale_bars(t):
    """Tickers that miss the last session before Sunday 2001-11-04."""
    return readers.stale_tickers(t.bars, "2001-11-04")


@query("src_macro", f"""
WITH v AS (SELECT CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) AS value FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
a AS (SELECT CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) AS value FROM orders WHERE o_orderstatus = 'O' GROUP BY 1),
b AS (SELECT CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) AS value FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
SELECT date, {s6('v.value', 3)} AS vix, {s6('a.value - b.value', 3)} AS curve_slope FROM v FULL JOIN a USING (date) FULL JOIN b USING (date)
""")
def src_macro(t):
    """Three series aligned by date; the spread of two of them."""
    def leg(status):
        return t.base("orders").where(F.col("o_orderstatus") == status).groupBy(F.col("o_orderdate").cast("date").alias("date")).agg(
            F.avg("o_totalprice").alias("value"))

    out = readers.macro_table(leg("F"), leg("O"), leg("P"))
    return out.select("date", settle("vix", 3).alias("vix"), settle("curve_slope", 3).alias("curve_slope"))


@query("src_benchmark", f"SELECT date, {s6('close')} AS close FROM bars WHERE ticker = 'Brand#1'")
def src_benchmark(t):
    """Bars of one ticker: the filter reaches the scan."""
    return t.bars.where("ticker = 'Brand#1'").select("date", settle("close").alias("close"))


_sector_case = "CASE cik % 3 WHEN 0 THEN 'Energy' WHEN 1 THEN 'Utilities' ELSE 'Unlisted' END"


@query("src_universe", f"""
SELECT ticker, name, {_sector_case} AS sector, CASE WHEN cik % 5 = 0 THEN NULL ELSE date_added END AS date_added, CAST(CASE WHEN cik % 7 = 0 THEN NULL ELSE cik END AS BIGINT) AS cik,
       CASE cik % 3 WHEN 0 THEN 'XLE' WHEN 1 THEN 'XLU' END AS sector_etf FROM universe
""")
def src_universe(t):
    """Constituents CSV with bad dates and numbers."""
    path = new_path(t.spark, "universe")
    k = F.col("cik")
    t.universe.select("ticker", "name", F.when(k % 3 == 0, "Energy").when(k % 3 == 1, "Utilities").otherwise("Unlisted").alias("sector"),
                      F.when(k % 5 == 0, "n/a").otherwise(F.col("date_added").cast("string")).alias("date_added"),
                      F.when(k % 7 == 0, "-").otherwise(k.cast("string")).alias("cik")).write.option("header", True).csv(path)
    return readers.read_universe(t.spark, path)


@query("src_changes", "SELECT date, upper(added_ticker) AS added_ticker, upper(removed_ticker) AS removed_ticker, reason FROM index_changes")
def src_changes(t):
    """Changes CSV; tickers trimmed and upper-cased."""
    path = new_path(t.spark, "changes")
    t.index_changes.select(F.col("date").cast("string").alias("date"), F.concat(F.lit(" "), "added_ticker").alias("added_ticker"), "added_name",
                           F.lower("removed_ticker").alias("removed_ticker"), "removed_name", "reason").write.option("header", True).csv(path)
    return readers.read_changes(t.spark, path).select("date", "added_ticker", "removed_ticker", "reason")


@query("src_filings", """
SELECT cik, ticker, form, filing_date, acceptance_datetime, items, accession FROM filings
""")
def src_filings(t):
    """Column-array JSON blocks -> filing rows; a page that repeats filings adds nothing."""
    def arr(c, fmt=None):
        col = F.col(c).cast("string") if fmt is None else F.date_format(c, fmt)
        return F.transform(F.col("rows"), lambda r: r[c].cast("string") if fmt is None else F.date_format(r[c], fmt)), col

    rows = F.sort_array(F.collect_list(F.struct("accession", "form", "filing_date", "acceptance_datetime", "items")))
    # a block is one company's filings of one year: bounded by the page, as the feed delivers them
    blocks = t.filings.groupBy("cik", "ticker", F.year("filing_date").alias("y")).agg(rows.alias("rows"))
    json = F.to_json(F.struct(
        arr("form")[0].alias("form"), arr("filing_date")[0].alias("filingDate"),
        arr("acceptance_datetime", "yyyy-MM-dd'T'HH:mm:ss'Z'")[0].alias("acceptanceDateTime"), arr("items")[0].alias("items"),
        arr("accession")[0].alias("accessionNumber")), {"ignoreNullFields": "false"})
    pages = blocks.select("cik", "ticker", json.alias("block"))
    out = readers.filings_from_json(pages.unionByName(pages.where("cik % 2 = 0")))
    return out.select("cik", "ticker", "form", "filing_date", "acceptance_datetime", "items", "accession")


@query("src_dividends", f"SELECT ticker, ex_date, {s6('dividend')} AS dividend FROM dividends WHERE dividend > 0")
def src_dividends(t):
    """Positive payments."""
    return readers.clean_dividends(t.dividends).select("ticker", "ex_date", settle("dividend").alias("dividend"))


@query("src_facts", f"SELECT ticker, concept, period_start, period_end, {s6('val', 2)} AS val, filed, form FROM facts")
def src_facts(t):
    """Nested concept/unit JSON -> long rows; other units are ignored."""
    entry = F.struct(F.col("period_start").alias("start"), F.col("period_end").alias("end"), "val", "filed", "form")
    # one document per company, as filed: bounded by its number of reports
    per = t.facts.groupBy("ticker", "concept").agg(F.collect_list(entry).alias("e"))
    units = F.create_map(F.lit("USD"), F.col("e"), F.lit("EUR"), F.col("e"))
    docs = per.groupBy("ticker").agg(F.map_from_entries(F.collect_list(F.struct("concept", F.struct(units.alias("units"))))).alias("m"))
    out = facts_from_json(docs.select("ticker", F.to_json("m").alias("facts")))
    return out.select("ticker", "concept", "period_start", "period_end", settle("val", 2).alias("val"), "filed", "form")


@query("src_articles", f"""
SELECT kind, ticker, {big('count(*)')} AS n, max(published) AS newest FROM (
  SELECT 'news' AS kind, ticker, published FROM articles WHERE length(title) > 0 AND doc_id % 10 <> 3
  UNION ALL SELECT 'filing', ticker, coalesce(acceptance_datetime, CAST(filing_date AS TIMESTAMP)) FROM item_list WHERE filing_date >= DATE '2001-07-20') GROUP BY ALL
""")
def src_articles(t):
    """News JSON with fallbacks, and recent 8-K items, as one article table."""
    d = F.col("doc_id")
    when = F.date_format("published", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    feed = t.articles.select("ticker", F.to_json(F.struct(
        "title", F.when(d % 4 == 0, "").otherwise(F.col("summary")).alias("summary"), F.col("summary").alias("description"),
        F.when(d % 10 == 3, "soon").when(d % 3 != 0, when).alias("pubDate"), when.alias("displayTime"),
        F.struct(F.col("source").alias("displayName")).alias("provider"))).alias("payload"))
    news = sentiment.article_rows(feed)
    filed = sentiment.filing_articles(t.filings, "2001-08-03")
    return news.unionByName(filed).groupBy("kind", "ticker").agg(F.count("*").alias("n"), F.max("published").alias("newest"))


@query("src_oof", f"SELECT ticker, date, fold, y, {s6('p_candidate')} AS p FROM oof WHERE y IS NOT NULL")
def src_oof(t):
    """Stored out-of-fold rows of one target and stage."""
    path = new_path(t.spark, "oof")
    rows = t.oof.where("y IS NOT NULL").withColumn("target", F.lit("magnitude_1d"))
    both = rows.select("ticker", "date", "fold", "y", "target", F.lit("candidate").alias("stage"), F.col("p_candidate").alias("p")).unionByName(
        rows.select("ticker", "date", "fold", "y", "target", F.lit("production").alias("stage"), F.col("p_incumbent").alias("p")))
    both.write.partitionBy("target", "stage").parquet(path)
    out = readers.out_of_fold(t.spark.read.parquet(path), "magnitude_1d", "candidate")
    return out.select("ticker", "date", "fold", "y", settle("p").alias("p"))


@query("snk_panel", f"""
SELECT CAST(2 AS BIGINT) AS version, extract(year FROM date)::INTEGER AS year, {big('count(*)')} AS n, {big('count(DISTINCT ticker)')} AS tickers, min(date) AS first_date, max(date) AS last_date,
  {s6('sum(CAST(vol_20 AS FLOAT))', 1)} AS vol_sum, {big('count(label_magnitude_1d)')} AS labels, {big('(SELECT count(*) FROM panel_log)')} AS manifest_rows FROM panel_log GROUP BY 2
""")
def snk_panel(t):
    """Two versions of the panel committed; readers follow the manifest to the second, which is read back by year."""
    from panelyard.sources.versions import commit_panel, read_panel, versions

    root = new_path(t.spark, "panels")
    panel = stored(build_panel(t, as_of=AS_OF), "panel")
    commit_panel(panel.where(F.year("date") < 1999), root)
    commit_panel(panel, root)
    back = read_panel(t.spark, root)
    newest = versions(t.spark, root).orderBy(F.desc("version")).limit(1).select("version", F.col("rows").alias("manifest_rows"))
    years = back.groupBy(F.col("year").cast("int").alias("year")).agg(
        F.count("*").alias("n"), F.countDistinct("ticker").alias("tickers"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        settle(F.sum(F.col("vol_20").cast("double")), 1).alias("vol_sum"), F.count("label_magnitude_1d").alias("labels"))
    return beside(years, newest)


@query("snk_report", f"SELECT sector, {big('count(*)')} AS n FROM universe GROUP BY sector")
def snk_report(t):
    """A report table written twice: the second write replaces the first."""
    from panelyard.plans.scores import sector_counts

    path = new_path(t.spark, "report")
    write_report(sector_counts(t.universe).withColumn("n", F.lit(0).cast("bigint")), path)
    write_report(sector_counts(t.universe), path)
    return t.spark.read.parquet(path)


_delisted = "SELECT DISTINCT removed_ticker AS name FROM index_changes WHERE removed_ticker NOT IN (SELECT ticker FROM universe)"


@query("src_backfill", f"""
SELECT 'prices' AS source, {big('count(*)')} AS rows, {big('count(DISTINCT ticker)')} AS names, {big('0')} AS empty FROM bars UNION ALL
SELECT 'sector_prices', {big('count(*)')}, {big('count(DISTINCT sector_etf)')}, {big('0')} FROM sector_bars UNION ALL
SELECT 'events', {big('count(*)')}, {big('count(DISTINCT ticker)')}, {big('0')} FROM filings UNION ALL
SELECT 'dividends', {big('count(*)')}, {big('count(DISTINCT ticker)')}, {big('(SELECT count(*) FROM universe) - count(DISTINCT ticker)')} FROM dividends UNION ALL
SELECT 'macro', {big('count(*)')}, {big('1')}, {big('0')} FROM macro UNION ALL
SELECT 'benchmark', {big('count(*)')}, {big('1')}, {big('0')} FROM benchmark_bars UNION ALL
SELECT 'delisted', {big('0')}, {big('0')}, {big('count(*)')} FROM ({_delisted})
""")
def src_backfill(t):
    """A backfill of seven sources that breaks off after five batches and is started again: what the ledger says of each source."""
    from panelyard.sources.ledger import backfill, ledger

    t.keep_bars()
    names = t.universe.select(F.col("ticker").alias("name"))
    gone = t.index_changes.select(F.col("removed_ticker").alias("name")).distinct().join(names, "name", "left_anti")

    def one(rows, name, date="date"):
        return rows.withColumns({"name": F.col(name) if name in rows.columns else F.lit(name), "date": F.col(date)})

    def alone(name):
        return t.spark.range(1).select(F.lit(name).alias("name"))

    sources = {
        "prices": (one(t.bars, "ticker"), names), "sector_prices": (one(t.sector_bars, "sector_etf"), t.universe.select(F.col("sector_etf").alias("name"))),
        "events": (one(t.filings, "ticker", "filing_date"), names), "dividends": (one(t.dividends, "ticker", "ex_date"), names),
        "macro": (one(t.macro, "macro"), alone("macro")), "benchmark": (one(t.benchmark_bars, "benchmark"), alone("benchmark")),
        "delisted": (one(t.bars, "ticker"), gone)}
    root = new_path(t.spark, "backfill")
    backfill(t.spark, root, sources, most_batches=5, batches=2)
    backfill(t.spark, root, sources, batches=2)
    return ledger(t.spark, root).groupBy("source").agg(
        F.sum("rows").alias("rows"), F.count_if(F.col("rows") > 0).alias("names"), F.count_if(F.col("rows") == 0).alias("empty"))
