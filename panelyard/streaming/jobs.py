"""The incremental parts as Structured Streaming jobs over the same functions as the batch plans.

Every job takes and returns streaming DataFrames; :func:`run_once` drives one to the end of what
is available and returns the sink as a table.  Sinks and checkpoints live in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from panelyard.session import new_path, stored
from panelyard.sources.readers import upsert_bars
from panelyard.sources.tables import Tables


class StreamTables(Tables):
    """The projection-only tables as streams over the same files."""

    def base(self, name: str) -> DataFrame:
        schema = self.spark.read.parquet(f"{self.folder}/{name}.parquet").schema
        return self.spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(self.folder)


def finish(query, timeout: int | None = None) -> None:
    """Wait until all that is available is processed; a caller may set a limit in seconds."""
    if timeout is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout):
        query.stop()
        raise TimeoutError(f"stream did not finish within {timeout} s")


def run_once(stream: DataFrame, name: str, timeout: int | None = None) -> DataFrame:
    """Process everything available, append to Parquet, and return the written table."""
    spark = stream.sparkSession
    path = new_path(spark, name)
    query = (stream.writeStream.format("parquet").outputMode("append").option("path", path)
             .option("checkpointLocation", new_path(spark, f"{name}-state")).trigger(availableNow=True).start())
    finish(query, timeout)
    return spark.read.schema(stream.schema).parquet(path)


def folder_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def distinct_filings(filings: DataFrame) -> DataFrame:
    """Each accession once, however often and however late a refresh repeats it.

    The feed is not in date order and repeats come at any time, so no watermark may drop rows: the state holds the accessions
    alone, a short key per filing, spread over the shuffle partitions.
    """
    return filings.dropDuplicates(["accession"])


def timed(ticks: DataFrame, delay: str) -> DataFrame:
    """Event time as TIMESTAMP (zone-less input counts as UTC) with its watermark."""
    return ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def tumbling(ticks: DataFrame, key: str, width: str = "15 minutes", delay: str = "1 hour") -> DataFrame:
    """Counts and means per key and fixed window."""
    return timed(ticks, delay).groupBy(F.window("ts", width), key).agg(
        F.count("*").alias("n"), F.avg("value").alias("mean_value")).select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), key, "n", "mean_value")


def sliding_density(ticks: DataFrame, key: str, days: int = 90, delay: str = "1 hour") -> DataFrame:
    """Events per key in the trailing days.  Daily counts come first, so that a tick is not
    copied into every window it belongs to."""
    daily = timed(ticks, delay).groupBy(F.window("ts", "1 day"), key).agg(F.count("*").alias("n"))
    at = daily.select(F.window_time("window").alias("day_end"), key, "n")
    return at.groupBy(F.window("day_end", f"{days} days", "1 day"), key).agg(F.sum("n").alias("n")).select(
        F.col("window.end").alias("window_end"), key, "n")


def quiet_periods(ticks: DataFrame, key: str, gap: str = "48 hours", delay: str = "1 hour") -> DataFrame:
    """Sessions per key; a closed session says that the feed went stale after it."""
    return timed(ticks, delay).groupBy(F.session_window("ts", gap), key).agg(F.count("*").alias("n")).select(
        key, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


LAST_SCHEMA = "user_id BIGINT, event_type STRING, last_ts TIMESTAMP, n BIGINT, days_before DOUBLE"
LAST_STATE = "last_ts TIMESTAMP, n BIGINT"


def last_seen(ticks: DataFrame) -> DataFrame:
    """Last time and count per (user, type), kept across batches, with the gap to the batch before.

    State expires after ninety quiet days of event time.
    """
    def step(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        before, n = state.get if state.exists else (None, 0)
        first, last = None, before
        for part in parts:
            n += len(part)
            low, high = part["ts"].min(), part["ts"].max()
            first = low if first is None else min(first, low)
            last = high if last is None else max(last, high)
        state.update((last, n))
        state.setTimeoutTimestamp(int(pd.Timestamp(last).timestamp() * 1000) + 90 * 86_400_000)
        gap = None if before is None else (first - before).total_seconds() / 86400
        yield pd.DataFrame({"user_id": [key[0]], "event_type": [key[1]], "last_ts": [last], "n": [n], "days_before": [gap]})

    return timed(ticks.select("user_id", "event_type", "ts"), "1 hour").groupBy("user_id", "event_type").applyInPandasWithState(
        step, LAST_SCHEMA, LAST_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def outcomes_stream(predictions: DataFrame, bars: DataFrame, max_wait: str = "60 days") -> DataFrame:
    """Predictions meet the bar their horizon ends at; both sides are bounded in time.

    ``predictions``: ticker, as_of, end_seq, last_close.  ``bars``: ticker, bar_seq, bar_time, close.  A prediction whose bar has not
    come within ``max_wait`` is given out with a null return, for the batch job to resolve.
    """
    p = predictions.withColumn("as_of_ts", F.col("as_of").cast("timestamp")).withWatermark("as_of_ts", max_wait)
    b = bars.select(F.col("ticker").alias("b_ticker"), "bar_seq", "bar_time", "close").withWatermark("bar_time", "1 day")
    on = (F.col("ticker") == F.col("b_ticker")) & (F.col("end_seq") == F.col("bar_seq")) & (
        F.col("bar_time") >= F.col("as_of_ts")) & (F.col("bar_time") <= F.col("as_of_ts") + F.expr(f"INTERVAL {max_wait}"))
    return p.join(b, on, "left_outer").select("ticker", "as_of", (F.col("close") / F.col("last_close") - 1).alias("actual_return"))


YEAR_PARTS = 16  # tasks that write a year


def upsert_stream(new_bars: DataFrame, path: str, sequence: str, timeout: int | None = None, state: str | None = None) -> None:
    """Merge each batch into a table partitioned by year; only touched years are rewritten.

    ``state``: the folder in which an earlier run kept its progress, to go on from there.

    Newest wins, inside a batch the last in ``sequence``, and a repeated batch changes nothing, so a batch that is replayed
    after a failure leaves the same table.  Only the partitions of the batch's years are read; each year is written by several tasks.
    """
    spark = new_bars.sparkSession

    def merge(batch: DataFrame, batch_id: int) -> None:
        now = batch.withColumn("year", F.year("date"))
        years = [r.year for r in now.select("year").distinct().collect()]  # bounded by the calendar
        kept = [c for c in now.columns if c != sequence]
        old = spark.read.schema(now.select(*kept).schema).parquet(path).where(F.col("year").isin(years)).select(*kept)
        merged = stored(upsert_bars(old, now, sequence), f"merge-{batch_id}")
        merged.repartition("year", F.pmod(F.xxhash64("ticker"), F.lit(YEAR_PARTS))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(path)

    query = new_bars.writeStream.foreachBatch(merge).option(
        "checkpointLocation", state or new_path(spark, "upsert-state")).trigger(availableNow=True).start()
    finish(query, timeout)


def dropped_late(query) -> int:
    """Rows that the finished query refused because they came after the watermark."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
