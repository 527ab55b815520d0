"""Versions of the panel and the backfill's ledger: broken runs leave what was there, and are taken up again."""

from datetime import date as D

import pytest
from pyspark.sql import functions as F

from panelyard.session import new_path
from panelyard.sources import ledger, readers, versions


@pytest.fixture
def panel(spark):
    return spark.createDataFrame([("A", D(2020, 1, 2), 1.0, 2.0), ("B", D(2021, 1, 4), 3.0, None)], "ticker STRING, date DATE, f DOUBLE, g DOUBLE")


def test_readers_follow_the_manifest(spark, panel):
    root = new_path(spark, "versions")
    assert versions.versions(spark, root).count() == 0
    with pytest.raises(versions.NoVersion):
        versions.read_panel(spark, root, features=["f", "g"])
    assert versions.commit_panel(panel.where("ticker = 'A'"), root, ["f", "g"]) == 1
    first = versions.versions(spark, root).first()
    assert versions.commit_panel(panel, root, ["f", "g"]) == 2
    assert versions.read_panel(spark, root, features=["f", "g"]).count() == 2
    assert versions.read_panel(spark, root, version=1, panel_id=first["panel_id"], features=["f", "g"]).count() == 1
    with pytest.raises(versions.NoVersion, match="is panel"):
        versions.read_panel(spark, root, version=2, panel_id=first["panel_id"], features=["f", "g"])
    with pytest.raises(versions.NoVersion, match="features"):
        versions.read_panel(spark, root, features=["f"])


def test_a_failed_write_leaves_the_old_version(spark, panel):
    root = new_path(spark, "versions")
    versions.commit_panel(panel, root, ["f", "g"])
    broken = panel.withColumn("f", F.when(F.col("ticker") == "B", F.raise_error(F.lit("broken row")).cast("double")).otherwise(F.col("f")))
    with pytest.raises(Exception, match="broken row"):
        versions.commit_panel(broken, root, ["f", "g"])
    assert versions.versions(spark, root).count() == 1 and versions.read_panel(spark, root, features=["f", "g"]).count() == 2


def test_backfill_goes_on_where_it_broke_off(spark):
    root = new_path(spark, "ledger")
    rows = spark.createDataFrame([(f"N{i % 6}", D(2020, 1, 1 + i), float(i)) for i in range(18)], "name STRING, date DATE, v DOUBLE")
    names = spark.createDataFrame([(f"N{i}",) for i in range(8)], "name STRING")
    sources = {"prices": (rows, names), "events": (rows.where("v < 6"), names)}
    assert ledger.backfill(spark, root, sources, most_batches=2, batches=3) == 2
    before = {(r["source"], r["name"]): r["folder"] for r in ledger.ledger(spark, root).collect()}
    assert 0 < len(before) < 8 and {s for s, _ in before} == {"prices"}
    rows.write.parquet(f"{root}/data/prices-unfinished")  # data of a batch that broke off before its entry
    assert ledger.backfill(spark, root, sources, batches=3) > 0
    after = {(r["source"], r["name"]): r for r in ledger.ledger(spark, root).collect()}
    assert len(after) == 16 and all(after[k]["folder"] == folder for k, folder in before.items())
    assert after["prices", "N7"]["rows"] == 0 and after["prices", "N0"]["rows"] == 3 and after["events", "N5"]["rows"] == 1
    assert sorted(map(tuple, ledger.loaded(spark, root, "prices").select("name", "date", "v").collect())) == sorted(map(tuple, rows.collect()))
    assert ledger.backfill(spark, root, sources, batches=3) == 0
    with pytest.raises(ValueError):
        ledger.loaded(spark, root, "macro")


def test_registry_reads_refuse_what_they_do_not_know(spark):
    registry = spark.createDataFrame([("a", "production"), ("b", "candidate")], "target STRING, stage STRING")
    assert [r["target"] for r in readers.targets_of(registry).collect()] == ["a"]
    with pytest.raises(ValueError, match="staging"):
        readers.targets_of(registry, "staging")
    reports = spark.createDataFrame([("a", "baselines", "production", 1), ("a", "ablations", "candidate", 2)], "target STRING, kind STRING, stage STRING, v INT")
    assert [r["v"] for r in readers.report_of(reports, "a", "baselines").collect()] == [1] and readers.report_of(reports, "a", "ablations").count() == 0
    with pytest.raises(ValueError, match="unknown report"):
        readers.report_of(reports, "a", "gossip")
    universe = spark.createDataFrame([("BRK", 7)], "ticker STRING, cik BIGINT")
    assert readers.cik_of(universe, " brk ").first()["cik"] == 7 and readers.cik_of(universe, "X").count() == 0


def test_kept_days_serve_payments_and_reports(spark):
    from panelyard.sources.tables import Tables

    raw, kept = Tables(spark, "/root/testdata/sf0.001"), Tables(spark, "/root/testdata/sf0.001").keep_bars()
    for name in ("bars", "dividends", "facts", "sector_bars", "benchmark_bars"):
        assert not [f for f in getattr(kept, name).inputFiles() if "lineitem" in f], name
    assert sorted(map(tuple, kept.dividends.collect())) == sorted(map(tuple, raw.dividends.collect()))


def test_dated_events_count_like_the_event_table(spark):
    from panelyard.plans.events import all_events, dated_events, events_by_day
    from panelyard.sources.tables import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    filings = t.filings.unionByName(t.filings.limit(200))  # delivered twice
    one, other = (sorted(map(str, events_by_day(f(filings, t.dividends, "2002-03-31")).collect())) for f in (all_events, dated_events))
    assert one == other and one
