"""Event table from filings and dividend payments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelyard import vocab
from panelyard.functions.calendar import day_number, effective_date
from panelyard.functions.numeric import growth
from panelyard.functions.text import event_key, item_codes, lookup
from panelyard.operators.dedupe import keep_one

EVENT_COLUMNS = ("event_id", "ticker", "event_date", "event_type", "event_subtype", "source", "confidence")


def classify_item(code: Column) -> tuple[Column, Column]:
    """Era-aware code -> (type, subtype): dotted codes are modern, bare ones legacy."""
    both = {**vocab.MODERN_ITEMS, **vocab.LEGACY_ITEMS}  # the two code sets never overlap
    kinds = lookup({c: t for c, (t, _) in both.items()}, code, vocab.UNCLASSIFIED)
    subtypes = F.coalesce(lookup({c: s for c, (_, s) in both.items()}, code), code)
    return kinds, subtypes


def event_vocabulary() -> list[str]:
    """Every type the filing rules can emit, sorted."""
    tables = (vocab.MODERN_ITEMS, vocab.LEGACY_ITEMS, vocab.PERIODIC_FORMS)
    return sorted({kind for table in tables for kind, _ in table.values()} | {vocab.UNCLASSIFIED})


def item_rows(filings: DataFrame) -> DataFrame:
    """One row per 8-K item code, with its place in the filing."""
    eight_k = filings.where(F.col("form") == "8-K")
    rows = eight_k.select("*", F.posexplode(item_codes("items")).alias("item_pos", "code"))
    kind, subtype = classify_item(F.col("code"))
    return rows.withColumns({"event_type": kind, "event_subtype": subtype})


def reported_events(filings: DataFrame) -> DataFrame:
    """What each filing reports: 8-K items and periodic reports, items of one type not yet joined.

    One scan: each filing carries the array of what it reports, and the array is exploded.
    """
    dated = filings.withColumn("event_date", effective_date("filing_date", "acceptance_datetime"))

    def item(code, pos):
        kind, subtype = classify_item(code)
        return F.struct(kind.alias("event_type"), subtype.alias("event_subtype"),
                        F.concat(F.lit("8-K:"), code).alias("source"), F.lit(1.0).alias("confidence"),
                        pos.alias("item_pos"))

    form = F.col("form")
    periodic = F.array(F.struct(
        lookup({f: t for f, (t, _) in vocab.PERIODIC_FORMS.items()}, form).alias("event_type"),
        lookup({f: s for f, (_, s) in vocab.PERIODIC_FORMS.items()}, form).alias("event_subtype"),
        form.alias("source"), F.lit(0.9).alias("confidence"), F.lit(0).alias("item_pos")))
    reported = F.when(form == "8-K", F.transform(item_codes("items"), item)).when(
        form.isin(*vocab.PERIODIC_FORMS), periodic)
    return dated.select("ticker", "event_date", "accession", F.inline(reported))


def filing_events(filings: DataFrame) -> DataFrame:
    """Event table of filings: 8-K items and periodic reports, one row per event id."""
    rows = reported_events(filings).withColumn("event_id", event_key("ticker", "event_date", "event_type", "accession"))
    # two items of one type in one filing share an id: the first item stands for both
    return keep_one(rows, ["event_id"], [F.col("item_pos"), F.col("source")]).select(*EVENT_COLUMNS)


def dividend_events(dividends: DataFrame, as_of: str | None = None, causal: bool = False) -> DataFrame:
    """Initiations, raises, cuts and suspensions, dated when they could be observed.

    ``as_of`` is the day up to which payments are known (default: today).
    The rhythm is the median gap of the whole series, or with ``causal`` of the gaps so far.  A
    ticker's payments are a handful a year, so its series and its median are small.
    """
    paid = dividends.where(F.col("dividend") > 0).select("ticker", "ex_date", "dividend")
    w = Window.partitionBy("ticker").orderBy("ex_date")
    whole = w.rowsBetween(Window.unboundedPreceding, 0) if causal else Window.partitionBy("ticker")
    steps = paid.withColumns({
        "before": F.lag("dividend").over(w), "last_date": F.lag("ex_date").over(w),
        "next_date": F.lead("ex_date").over(w),
    }).withColumn("gap", F.date_diff("ex_date", "last_date"))
    steps = steps.withColumn("interval", F.when(
        F.count("gap").over(whole) >= 3, F.percentile("gap", F.lit(0.5)).over(whole)
    ).otherwise(vocab.DEFAULT_GAP_DAYS))
    restarted = F.col("gap") > F.col("interval") * vocab.RESTART_FACTOR
    change = growth("dividend", "before")
    up = F.col("dividend") > F.col("before") * (1 + vocab.DIVIDEND_TOLERANCE)
    down = F.col("dividend") < F.col("before") * (1 - vocab.DIVIDEND_TOLERANCE)
    new = F.col("before").isNull() | restarted
    shown = F.format_string("%.1f%%", F.bround(change * 100, 1))  # exact halves go to the even digit
    kind = F.when(new, "DIVIDEND_INITIATE").when(up, "DIVIDEND_RAISE").when(down, "DIVIDEND_CUT")
    why = F.when(F.col("before").isNull(), "first payment").when(restarted, "resumed").otherwise(shown)
    wait = F.bround(F.col("interval") * vocab.MISSED_FACTOR).cast("int")
    horizon = F.current_date() if as_of is None else F.lit(as_of).cast("date")

    def event(day, what, subtype, confidence):
        return F.struct(day.alias("event_date"), what.alias("event_type"), subtype.alias("event_subtype"),
                        F.lit(confidence).alias("confidence"))

    # a payment may stand for up to three events: itself, the gap before it, the end after it
    suspend = F.lit("DIVIDEND_SUSPEND")
    expected = F.date_add("ex_date", wait)
    found = F.array_compact(F.array(
        F.when(kind.isNotNull(), event(F.col("ex_date"), kind, why, 0.9)),
        F.when(restarted, event(F.date_add("last_date", wait), suspend, F.lit("missed expected payment"), 0.7)),
        F.when(F.col("next_date").isNull() & (expected <= horizon),
               event(expected, suspend, F.lit("payments stopped"), 0.7))))
    return steps.select("ticker", F.inline(found)).withColumn("source", F.lit("dividends"))


def all_events(filings: DataFrame, dividends: DataFrame | None = None, as_of: str | None = None) -> DataFrame:
    events = filing_events(filings)
    if dividends is None:
        return events
    return events.unionByName(dividend_events(dividends, as_of), allowMissingColumns=True)


def dated_events(filings: DataFrame, dividends: DataFrame, as_of: str | None = None) -> DataFrame:
    """Ticker, day and type of :func:`all_events`, for jobs that only count them: the columns of an event id tell events apart as well
    as the id does, and without a row to choose per id they are told apart by hashing, with no sort of all events."""
    filed = reported_events(filings).select("ticker", "event_date", "event_type", "accession").distinct().drop("accession")
    return filed.unionByName(dividend_events(dividends, as_of).select("ticker", "event_date", "event_type"))


def events_by_day(events: DataFrame) -> DataFrame:
    """Fold events to one row per ticker and day: counts, and the day number per tracked type."""
    day = day_number("event_date")
    marks = {f"last_{t.lower()}": F.max(F.when(F.col("event_type") == t, day)) for t in vocab.TRACKED_EVENTS}
    return events.groupBy("ticker", "event_date").agg(
        F.count("*").alias("n_events"),
        F.sum((F.col("event_type") == "DIVIDEND_CUT").cast("bigint")).alias("n_cuts"),
        F.max(day).alias("last_any_event"), *[m.alias(n) for n, m in marks.items()])


def has_untagged_item(items: Column) -> Column:
    """Does the item string hold a code that the taxonomy cannot express?"""
    return F.exists(item_codes(items), lambda c: classify_item(c)[0].isin("DISCLOSURE", vocab.UNCLASSIFIED))
