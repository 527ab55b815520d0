"""The driver contract on the smallest data."""

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def test_every_check_has_its_query():
    queries, checks = entry.queries(), entry.oracle_sql()
    assert set(checks) <= set(queries) and len(queries) > 150


def test_flagship_runs(spark):
    assert entry.entry(spark).count() > 0


def test_streams_equal_batch(spark):
    from panelyard.catalog.base import ORACLES  # noqa: F401
    from panelyard.sources.tables import Tables

    got = entry.queries()["st_dedupe"](spark, SMALL)
    assert got.count() == Tables(spark, SMALL).filings.count()
