"""Filings, dividends, facts and membership on small hand-made inputs."""

import datetime as dt

import pandas as pd

from panelyard.operators.intervals import members_only, membership_spells, removed_names
from panelyard.plans.events import dividend_events, event_vocabulary, filing_events
from panelyard.plans.fundamentals import fundamentals, fundamentals_by_day

D = dt.date


def filing(spark, **over):
    base = {"cik": 1, "ticker": "T", "form": "8-K", "filing_date": D(2024, 1, 10), "acceptance_datetime": None, "items": "2.02,9.01", "accession": "a"}
    rows = over.pop("rows", [{}])
    return spark.createDataFrame(
        [tuple({**base, **over, **r}.values()) for r in rows],
        "cik INT, ticker STRING, form STRING, filing_date DATE, acceptance_datetime TIMESTAMP, items STRING, accession STRING")


def stamp(text):
    return dt.datetime.fromisoformat(text).replace(tzinfo=dt.timezone.utc)


def test_after_close_rolls_to_the_next_business_day(spark):
    rows = [
        {"accession": "winter", "acceptance_datetime": stamp("2024-01-10T21:00:00")},   # 16:00 in New York
        {"accession": "before", "acceptance_datetime": stamp("2024-01-10T20:59:00")},
        {"accession": "summer", "filing_date": D(2024, 7, 10), "acceptance_datetime": stamp("2024-07-10T20:30:00")},
        {"accession": "friday", "filing_date": D(2024, 1, 12), "acceptance_datetime": stamp("2024-01-12T23:00:00")},
        {"accession": "unknown"},
    ]
    got = filing_events(filing(spark, rows=rows)).select("event_date", "event_id").collect()
    assert sorted(r.event_date for r in got) == [D(2024, 1, 10), D(2024, 1, 10), D(2024, 1, 11), D(2024, 1, 15), D(2024, 7, 11)]


def test_item_eras_and_noise(spark):
    rows = [{"accession": "m", "items": "8.01, 7.01,9.01"}, {"accession": "l", "items": "12,7,5"}, {"accession": "u", "items": "99.99"},
            {"accession": "n", "items": None}, {"accession": "k", "form": "10-K", "items": None}, {"accession": "x", "form": "8-K/A"}]
    got = {(r.source, r.event_type) for r in filing_events(filing(spark, rows=rows)).collect()}
    # 8.01 and 7.01 are one type in one filing: one event, from the first item
    assert got == {("8-K:8.01", "DISCLOSURE"), ("8-K:12", "EARNINGS_RESULT"), ("8-K:5", "DISCLOSURE"),
                   ("8-K:99.99", "UNCLASSIFIED_8K"), ("10-K", "PERIODIC_REPORT")}
    assert event_vocabulary() == sorted(event_vocabulary())


def payments(spark, amounts, skip=()):
    days = [D(2020, 1, 15) + dt.timedelta(days=91 * i) for i in range(len(amounts))]
    rows = [("T", d, float(a)) for i, (d, a) in enumerate(zip(days, amounts)) if i not in skip]
    return spark.createDataFrame(rows, "ticker STRING, ex_date DATE, dividend DOUBLE")


def test_dividend_decisions(spark):
    got = dividend_events(payments(spark, [1, 1, 1.1, 1.1, 0.5, 0.502]), as_of="2021-04-20").orderBy("event_date").collect()
    assert [(r.event_type, r.event_subtype) for r in got] == [
        ("DIVIDEND_INITIATE", "first payment"), ("DIVIDEND_RAISE", "10.0%"), ("DIVIDEND_CUT", "-54.5%")]


def test_dividend_gap_is_a_suspension_dated_when_due(spark):
    got = dividend_events(payments(spark, [1] * 10, skip=(5, 6, 7)), as_of="2030-01-01").orderBy("event_date").collect()
    kinds = [r.event_type for r in got]
    assert kinds == ["DIVIDEND_INITIATE", "DIVIDEND_SUSPEND", "DIVIDEND_INITIATE", "DIVIDEND_SUSPEND"]
    assert got[1].event_date == D(2020, 1, 15) + dt.timedelta(days=91 * 4 + 136)  # 1.5 x 91, half to even


def test_facts_use_the_first_filing_and_carry_on_their_own(spark):
    rows = []
    for end, filed, rev, net in ((D(2024, 3, 31), D(2024, 5, 1), 100.0, 10.0), (D(2024, 6, 30), D(2024, 8, 1), 120.0, 5.0)):
        start = end - dt.timedelta(days=90)
        rows += [("T", "Revenues", start, end, rev, filed, "10-Q"), ("T", "NetIncomeLoss", start, end, net, filed, "10-Q")]
    rows += [("T", "Revenues", D(2024, 1, 1), D(2024, 3, 31), 999.0, D(2025, 5, 1), "10-K"),   # restated later
             ("T", "Revenues", D(2023, 7, 1), D(2024, 6, 30), 400.0, D(2024, 8, 1), "10-K"),   # a year, not a quarter
             ("T", "NetIncomeLoss", D(2024, 1, 1), D(2024, 3, 31), 1.0, None, "10-Q")]
    facts = spark.createDataFrame(rows, "ticker STRING, concept STRING, period_start DATE, period_end DATE, val DOUBLE, filed DATE, form STRING")
    got = fundamentals_by_day(fundamentals(facts)).orderBy("filed").collect()
    assert [(r.filed, round(r.net_margin, 4), r.earnings_surprise_streak) for r in got] == [
        (D(2024, 5, 1), 0.1, 0.0), (D(2024, 8, 1), round(5 / 120, 4), 1.0)]


def test_membership_spells(spark):
    universe = spark.createDataFrame([("NEW", D(2015, 6, 1)), ("BACK", D(2018, 3, 1)), ("OLDTIMER", None)], "ticker STRING, date_added DATE")
    changes = spark.createDataFrame(
        [(D(2010, 5, 1), None, "BACK"), (D(2015, 6, 1), "NEW", "OLD"), (D(2018, 3, 1), "BACK", "OTHER")],
        "date DATE, added_ticker STRING, removed_ticker STRING").selectExpr("*", "'Acquired' AS reason")
    begin = D(1, 1, 1)
    got = {(r.ticker, r.start, r.end) for r in membership_spells(universe, changes).collect()}
    assert got == {("NEW", D(2015, 6, 1), None), ("BACK", D(2018, 3, 1), None), ("BACK", begin, D(2010, 5, 1)),
                   ("OLD", begin, D(2015, 6, 1)), ("OTHER", begin, D(2018, 3, 1)), ("OLDTIMER", begin, None)} - {("NEW", begin, None)}
    rows = spark.createDataFrame([("BACK", D(2012, 1, 1)), ("BACK", D(2018, 3, 1)), ("OLD", D(2015, 6, 1)), ("NOBODY", D(2015, 6, 1))], "ticker STRING, date DATE")
    kept = members_only(rows, membership_spells(universe, changes)).collect()
    assert [(r.ticker, r.date) for r in kept] == [("BACK", D(2018, 3, 1))]
    assert {r.ticker for r in removed_names(universe, changes).collect()} == {"OLD", "OTHER"}


def test_empty_filings_give_an_empty_table(spark):
    empty = filing(spark).limit(0)
    assert filing_events(empty).count() == 0
    assert pd.DataFrame(columns=filing_events(empty).columns).columns.size == 7
