"""Streaming jobs driven to the end of the shared files."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from panelyard.catalog.base import big, query, s6, step
from panelyard.functions.numeric import settle
from panelyard.session import new_path
from panelyard.streaming import jobs

step("ev_mark", "SELECT max(ts) - INTERVAL '1' HOUR AS mark FROM events")


def _ticks(t):
    return jobs.StreamTables(t.spark, t.folder).base("events")


@query("st_dedupe", "SELECT accession, ticker, form, filing_date FROM filings")
def st_dedupe(t):
    """Filings delivered twice, kept once."""
    a, b = (jobs.StreamTables(t.spark, t.folder).filings for _ in range(2))
    return jobs.run_once(jobs.distinct_filings(a.unionByName(b)), "filings").select("accession", "ticker", "form", "filing_date")


@query("st_tumble", f"""
SELECT w AS window_start, w + INTERVAL '15' MINUTE AS window_end, event_type, {big('count(*)')} AS n, {s6('avg(value)')} AS mean_value
FROM (SELECT *, time_bucket(INTERVAL '15' MINUTE, ts) AS w FROM events), ev_mark WHERE w + INTERVAL '15' MINUTE <= mark GROUP BY w, event_type
""")
def st_tumble(t):
    """15-minute windows that the watermark has closed."""
    out = jobs.run_once(jobs.tumbling(_ticks(t), "event_type"), "tumble")
    return out.withColumn("mean_value", settle("mean_value"))


@query("st_slide", f"""
WITH d AS (SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events, ev_mark WHERE date_trunc('day', ts) + INTERVAL '1' DAY <= mark GROUP BY ALL),
w AS (SELECT CAST(day + INTERVAL '1' DAY * k AS TIMESTAMP) AS window_end, event_type, sum(n) AS n FROM d, range(1, 91) r(k) GROUP BY ALL)
SELECT window_end, event_type, {big('n')} AS n FROM w, ev_mark WHERE window_end <= mark
""")
def st_slide(t):
    """Event density over trailing ninety days, from daily counts."""
    return jobs.run_once(jobs.sliding_density(_ticks(t), "event_type", 90), "slide")


@query("st_session", f"""
WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL '48' HOUR THEN 1 ELSE 0 END AS brk FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM g),
x AS (SELECT user_id, no, min(ts) AS session_start, max(ts) + INTERVAL '48' HOUR AS session_end, count(*) AS n FROM s GROUP BY ALL)
SELECT user_id, session_start, session_end, {big('n')} AS n FROM x, ev_mark WHERE session_end <= mark
""")
def st_session(t):
    """Closed 48-hour sessions per user."""
    return jobs.run_once(jobs.quiet_periods(_ticks(t), "user_id"), "session")


@query("st_state", f"SELECT user_id, event_type, max(ts) AS last_ts, {big('count(*)')} AS n FROM events GROUP BY ALL")
def st_state(t):
    """Last event per user and type kept as state."""
    return jobs.run_once(jobs.last_seen(_ticks(t)), "last_seen").select("user_id", "event_type", "last_ts", "n")


def _numbered(t):
    no = F.row_number().over(Window.partitionBy("ticker").orderBy("date"))
    return t.bars.select("ticker", "date", "close", no.alias("bar_seq"))


step("so_rows", "SELECT s.ticker, s.date AS as_of, e.close / s.close - 1 AS r FROM bar_seq s JOIN bar_seq e ON e.ticker = s.ticker AND e.no = s.no + 5 WHERE e.date <= s.date + INTERVAL '60' DAY UNION ALL SELECT s.ticker, s.date, NULL FROM bar_seq s LEFT JOIN bar_seq e ON e.ticker = s.ticker AND e.no = s.no + 5 AND e.date <= s.date + INTERVAL '60' DAY WHERE e.no IS NULL AND s.date + INTERVAL '60' DAY < (SELECT max(date) FROM bar_seq) - INTERVAL '60' DAY")


@query("st_outcome", f"SELECT ticker, as_of, {s6('r')} AS actual_return FROM so_rows")
def st_outcome(t):
    """Predictions and bars as two streams, joined when the horizon ends."""
    left, right = new_path(t.spark, "pred-feed"), new_path(t.spark, "bar-feed")
    rows = _numbered(t)
    rows.select("ticker", F.col("date").alias("as_of"), (F.col("bar_seq") + 5).alias("end_seq"), F.col("close").alias("last_close")).write.parquet(left)
    rows.select("ticker", "bar_seq", F.col("date").cast("timestamp").alias("bar_time"), "close").write.parquet(right)
    out = jobs.outcomes_stream(jobs.folder_stream(t.spark, left), jobs.folder_stream(t.spark, right))
    return jobs.run_once(out, "outcomes").withColumn("actual_return", settle("actual_return"))


@query("st_enrich", "SELECT f.accession, f.ticker, u.sector FROM filings f LEFT JOIN universe u ON u.ticker = f.ticker")
def st_enrich(t):
    """A stream of filings with the sector from a static table."""
    stream = jobs.StreamTables(t.spark, t.folder).filings
    return jobs.run_once(stream.join(t.universe.select("ticker", "sector"), "ticker", "left").select("accession", "ticker", "sector"), "enriched")


@query("st_upsert", f"SELECT ticker, date, {s6('CASE WHEN extract(year FROM date) >= 2000 THEN high ELSE close END', 3)} AS close FROM bars")
def st_upsert(t):
    """Three batches merged into a stored table; the newest values win."""
    table, feed = new_path(t.spark, "bars"), new_path(t.spark, "bar-batches")
    bars = t.bars.select("ticker", "date", "close", "high")
    bars.where(F.year("date") < 2001).select("ticker", "date", "close", F.year("date").alias("year")).write.partitionBy("year").parquet(table)
    late = bars.where(F.year("date") >= 2000).select("ticker", "date", F.col("high").alias("close"), F.lit(1).alias("seq"))
    late = late.unionByName(late.withColumns({"close": F.lit(0.0), "seq": F.lit(0)}))  # an earlier row of the same day and load
    state = new_path(t.spark, "upsert-state")
    for part in (late.where(F.year("date") == 2000), late.where(F.year("date") == 2001), late.where(F.year("date") == 2000)):
        part.write.mode("append").parquet(feed)
        # one run a load: a batch that holds some files of a load only would let its earlier rows win over its last ones
        jobs.upsert_stream(jobs.folder_stream(t.spark, feed), table, "seq", state=state)
    return t.spark.read.parquet(table).select("ticker", "date", settle("close", 3).alias("close"))


@query("st_late", f"""
WITH w AS (SELECT ts, time_bucket(INTERVAL '15' MINUTE, ts) + INTERVAL '15' MINUTE AS stop FROM events)
SELECT 'stream' AS part, {big('count(*)')} AS events, true AS refused FROM w, ev_mark WHERE ts >= TIMESTAMP '2024-01-15' AND stop <= mark
UNION ALL SELECT 'batch', {big('count(*)')}, NULL FROM events
""")
def st_late(t):
    """Late rows are refused and counted by the stream; the batch path takes them in."""
    feed, sink, state = (new_path(t.spark, n) for n in ("late-feed", "late", "late-state"))
    ticks = t.base("events")
    middle = F.lit("2024-01-15").cast("timestamp_ntz")
    # one run a load, so that a load is one batch however many files it has; the second starts from the watermark of the first
    for part in (F.col("ts") >= middle, F.col("ts") < middle):
        ticks.where(part).write.mode("append").parquet(feed)
        out = jobs.tumbling(jobs.folder_stream(t.spark, feed), "event_type")
        q = (out.writeStream.format("parquet").outputMode("append").option("path", sink)
             .option("checkpointLocation", state).trigger(availableNow=True).start())
        jobs.finish(q)
    dropped = jobs.dropped_late(q)
    streamed = t.spark.read.schema(out.schema).parquet(sink).agg(F.sum("n").alias("events")).select(F.lit("stream").alias("part"), "events")
    batch = jobs.tumbling(ticks, "event_type").agg(F.sum("n").alias("events")).select(F.lit("batch").alias("part"), "events")
    return streamed.unionByName(batch).withColumn("refused", F.when(F.col("part") == "stream", F.lit(dropped > 0)))


@query("udf_tagger", """
SELECT prediction_id, CASE WHEN post_mortem_tag <> 'UNEXPLAINED' THEN post_mortem_tag WHEN predicted_class = 'QUIET' THEN 'ANALOG_POOR_MATCH' ELSE 'UNEXPLAINED' END AS post_mortem_tag
FROM pm_tags JOIN (SELECT prediction_id, predicted_class FROM predictions) USING (prediction_id)
""")
def udf_tagger(t):
    """A tagger names what the rules leave open; answers outside the vocabulary do not count."""
    from panelyard.catalog.feedback import resolved_of
    from panelyard.plans.feedback import post_mortem

    def tagger(rows):
        return F.when(rows["predicted_class"] == "QUIET", "analog_poor_match ").otherwise("bad luck")

    return post_mortem(resolved_of(t), t.macro, t.filings, tagger=tagger).select("prediction_id", "post_mortem_tag")


@query("udtf_explode", f"SELECT code, CAST(item_pos AS INTEGER) AS item_pos, {big('count(*)')} AS n FROM item_list GROUP BY ALL")
def udtf_explode(t):
    """Items to rows with their place."""
    from panelyard.plans.events import item_rows

    return item_rows(t.filings).groupBy("code", "item_pos").agg(F.count("*").alias("n"))


@query("udaf_garch")
def udaf_garch(t):
    """Per-ticker fit as a grouped map over whole daily series."""
    from panelyard.plans import volatility

    rows = volatility.variance_series(t.bars).select(F.lit(0).alias("fold"), "ticker", "day", "ret")
    return volatility.garch_parameters(rows)


@query("udf_loader", "SELECT ticker, max(date) AS last_date FROM bars GROUP BY ticker")
def udf_loader(t):
    """Jobs take their inputs as arguments: the same plan over injected bars."""
    from panelyard.plans.features import build_features

    return build_features(t.bars).groupBy("ticker").agg(F.max("date").alias("last_date"))
