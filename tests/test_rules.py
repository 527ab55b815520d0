"""Rules of duplicates, draws, boards and streams over several files."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelyard import catalog
from panelyard.functions.draws import draw
from panelyard.plans.models import bounded
from panelyard.plans.scores import leaderboard
from panelyard.session import new_path
from panelyard.sources import readers
from panelyard.streaming import jobs

D = dt.date


def test_last_loaded_row_of_a_day_wins(spark):
    raw = spark.createDataFrame([("T", D(2024, 1, 2), 9.0, 1), ("T", D(2024, 1, 2), 5.0, 2)], "ticker STRING, date DATE, close DOUBLE, seq INT")
    assert readers.clean_bars(raw, "seq").first().close == 5.0
    old = spark.createDataFrame([("T", D(2024, 1, 2), 1.0), ("T", D(2024, 1, 3), 2.0)], "ticker STRING, date DATE, close DOUBLE")
    got = {r.date: r.close for r in readers.upsert_bars(old, raw, "seq").collect()}
    assert got == {D(2024, 1, 2): 5.0, D(2024, 1, 3): 2.0}


@pytest.mark.parametrize("seed,slot", [(0, 100_000), (20240101, 1), (2**31 - 1, 2**33)])
def test_draws_do_not_overflow(spark, seed, slot):
    got = spark.range(50).select(draw(seed, F.col("id"), F.lit(slot), F.lit(7)).alias("d")).collect()
    assert all(0 <= r.d < 7 for r in got) and len({r.d for r in got}) > 3


def test_unknown_targets_are_named(spark):
    scores = spark.createDataFrame([("T", D(2024, 1, 2), "a", 0.5)], "ticker STRING, as_of DATE, target STRING, probability DOUBLE")
    with pytest.raises(ValueError, match="scored targets: a"):
        leaderboard(scores, "b")
    assert leaderboard(scores, "a", limit=3).count() == 1


def test_fit_rows_are_bounded(spark):
    rows = spark.range(4000).select(F.col("id").cast("string").alias("ticker"), F.lit(D(2024, 1, 2)).alias("date"))
    assert bounded(rows, None).count() == 4000 and 300 < bounded(rows, 400).count() < 500


def test_filings_over_several_files_out_of_order(spark):
    feed = new_path(spark, "filing-feed")
    for day in (20, 3, 11, 3, 28):
        rows = [(f"A-{day}-{i}", D(2024, 1, day)) for i in range(40)] + [("A-3-1", D(2024, 1, 3))]
        spark.createDataFrame(rows, "accession STRING, filing_date DATE").coalesce(1).write.mode("append").parquet(feed)
    got = jobs.run_once(jobs.distinct_filings(jobs.folder_stream(spark, feed, 1)), "filings-once")
    assert got.count() == got.select("accession").distinct().count() == 160


def test_unresolved_predictions_come_out_as_null(spark):
    left, right = new_path(spark, "asked"), new_path(spark, "given")
    asked = [("T", D(2024, 1, 2), 5, 10.0), ("T", D(2024, 1, 3), 99, 10.0), ("T", D(2025, 1, 3), 500, 10.0)]
    spark.createDataFrame(asked, "ticker STRING, as_of DATE, end_seq INT, last_close DOUBLE").write.parquet(left)
    bars = [("T", 5, dt.datetime(2024, 1, 9), 11.0), ("T", 400, dt.datetime(2025, 1, 9), 12.0)]
    spark.createDataFrame(bars, "ticker STRING, bar_seq INT, bar_time TIMESTAMP, close DOUBLE").write.parquet(right)
    out = jobs.run_once(jobs.outcomes_stream(jobs.folder_stream(spark, left), jobs.folder_stream(spark, right)), "outcomes")
    got = {r.as_of: r.actual_return for r in out.collect()}
    assert got[D(2024, 1, 2)] == pytest.approx(0.1) and got[D(2024, 1, 3)] is None and D(2025, 1, 3) not in got


def test_upsert_keeps_the_last_row_of_a_batch(spark):
    table, feed = new_path(spark, "bars-kept"), new_path(spark, "bars-fed")
    spark.createDataFrame([("T", D(2023, 1, 2), 1.0, 2023), ("T", D(2024, 1, 2), 1.0, 2024)],
                          "ticker STRING, date DATE, close DOUBLE, year INT").write.partitionBy("year").parquet(table)
    for n, rows in enumerate([[("T", D(2024, 1, 2), 3.0, 2), ("T", D(2024, 1, 2), 2.0, 1)], [("U", D(2024, 1, 2), 7.0, 0)]]):
        spark.createDataFrame(rows, "ticker STRING, date DATE, close DOUBLE, seq INT").coalesce(1).write.mode("append").parquet(feed)
    jobs.upsert_stream(jobs.folder_stream(spark, feed, 1), table, "seq")
    got = {(r.ticker, r.date.year): r.close for r in spark.read.parquet(table).collect()}
    assert got == {("T", 2023): 1.0, ("T", 2024): 3.0, ("U", 2024): 7.0}


@pytest.fixture
def many_files(spark):
    """Every write gives many files, as large tables do."""
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "40")
    yield "/root/testdata/sf0.001"
    spark.conf.unset("spark.sql.files.maxRecordsPerFile")


def test_late_rows_are_refused_by_load_not_by_file(spark, many_files):
    ticks = spark.read.parquet(f"{many_files}/events.parquet")
    mark = ticks.agg(F.max("ts") - F.expr("INTERVAL 1 HOUR")).first()[0]
    stop = F.window("ts", "15 minutes")["end"]
    want = ticks.where((F.col("ts") >= F.lit("2024-01-15").cast("timestamp_ntz")) & (stop <= F.lit(mark))).count()
    got = {r.part: (r.events, r.refused) for r in catalog.queries()["st_late"](spark, many_files).collect()}
    assert got == {"stream": (want, True), "batch": (ticks.count(), None)}


def test_upsert_of_loads_in_many_files(spark, many_files):
    assert catalog.queries()["st_upsert"](spark, many_files).where("close <= 0").count() == 0
