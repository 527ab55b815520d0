"""Membership spells from a change history, and membership tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

BEGINNING = "0001-01-01"  # stands for "before all records"


def membership_spells(universe: DataFrame, changes: DataFrame) -> DataFrame:
    """(ticker, start, end): half-open spells, ``end`` NULL while the spell is still running.

    Walking backwards in time, an addition closes the running spell at its start and a removal
    opens one that ends there.  A name's state depends on its own changes only, so each name is
    one fold over its few change rows; names never wait for each other.
    """
    added = changes.where("added_ticker IS NOT NULL").select(
        F.col("added_ticker").alias("ticker"), F.col("date").alias("d"), F.lit(1).alias("kind"))
    removed = changes.where("removed_ticker IS NOT NULL").select(
        F.col("removed_ticker").alias("ticker"), F.col("date").alias("d"), F.lit(0).alias("kind"))
    # on one day the addition is met first when walking backwards
    walked = added.unionByName(removed).groupBy("ticker").agg(
        F.sort_array(F.collect_set(F.struct("d", "kind")), asc=False).alias("steps"))
    current = universe.select("ticker", "date_added", F.lit(True).alias("listed"))
    both = current.join(walked, "ticker", "full_outer").withColumns({
        "steps": F.coalesce("steps", F.array().cast("array<struct<d:date,kind:int>>")),
        "listed": F.coalesce("listed", F.lit(False)),
    })
    spell = "struct<start:date,end:date>"
    begin = F.struct(
        F.col("listed").alias("member"), F.lit(None).cast("date").alias("until"),
        F.array().cast(f"array<{spell}>").alias("done"))

    def step(acc, s):
        closes = acc["member"]  # an addition while absent records nothing; so does a first removal
        closed = F.when(closes, F.concat(acc["done"], F.array(
            F.struct(s["d"].alias("start"), acc["until"].alias("end"))))).otherwise(acc["done"])
        return F.struct(
            (s["kind"] == 0).alias("member"),
            F.when(s["kind"] == 0, s["d"]).otherwise(F.lit(None).cast("date")).alias("until"),
            closed.alias("done"))

    walked = both.select("ticker", "date_added", F.aggregate("steps", begin, step).alias("state"))
    until = F.col("state.until")
    first = F.coalesce("date_added", F.lit(BEGINNING).cast("date"))
    first = F.when(until.isNotNull() & (first >= until), F.lit(BEGINNING).cast("date")).otherwise(first)
    earliest = F.when(F.col("state.member"), F.array(F.struct(first.alias("start"), until.alias("end"))))
    spells = F.concat("state.done", F.coalesce(earliest, F.array().cast(f"array<{spell}>")))
    return walked.select("ticker", F.inline(spells))


def members_only(rows: DataFrame, spells: DataFrame, date: str = "date") -> DataFrame:
    """Rows dated inside a spell of their ticker; names without a record are dropped."""
    r, s = rows.alias("r"), spells.alias("s")
    inside = (F.col("r.ticker") == F.col("s.ticker")) & (F.col(f"r.{date}") >= F.col("s.start")) & (
        F.col("s.end").isNull() | (F.col(f"r.{date}") < F.col("s.end")))
    return r.join(s, inside, "left_semi")


def removed_names(universe: DataFrame, changes: DataFrame) -> DataFrame:
    """Names no longer listed with their last removal date and its reason."""
    gone = changes.where("removed_ticker IS NOT NULL").groupBy(F.col("removed_ticker").alias("ticker")).agg(
        F.max("date").alias("removal_date"), F.max_by("reason", F.struct("date", "reason")).alias("reason"))
    return gone.join(universe.select("ticker"), "ticker", "left_anti")
