"""The training panel: features and labels of member rows, and its stored form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from panelyard import vocab
from panelyard.functions.text import schema_fingerprint, short_sha1
from panelyard.operators.intervals import members_only, membership_spells
from panelyard.plans.events import dated_events
from panelyard.plans.features import build_features, check_no_leak
from panelyard.plans.fundamentals import fundamentals
from panelyard.plans.labels import add_labels, label_names


def all_features(tables, as_of: str | None = None) -> DataFrame:
    """Features of every bar, from all inputs."""
    tables.keep_bars()
    return build_features(
        tables.bars, benchmark=tables.benchmark_bars, macro=tables.macro,
        events=dated_events(tables.filings, tables.dividends, as_of), universe=tables.universe,
        sector_bars=tables.sector_bars, ratios=fundamentals(tables.facts))


def build_dataset(tables, *, as_of: str | None = None, features: DataFrame | None = None) -> DataFrame:
    """Features and labels of every bar; ``features``: those of :func:`all_features`, if a job has stored them."""
    rows = all_features(tables, as_of) if features is None else features
    return add_labels(rows).select("ticker", "date", *vocab.FEATURES, *label_names())


def build_panel(tables, *, as_of: str | None = None, features: DataFrame | None = None) -> DataFrame:
    """Dataset rows inside index membership, features as FLOAT."""
    check_no_leak(vocab.FEATURES)
    spells = membership_spells(tables.universe, tables.index_changes)
    rows = members_only(build_dataset(tables, as_of=as_of, features=features), spells)
    return rows.select("ticker", "date", *[F.col(c).cast("float").alias(c) for c in vocab.FEATURES], *label_names())


def panel_identity(panel: DataFrame, features=vocab.FEATURES) -> DataFrame:
    """One row: schema fingerprint, extent and identity of a built panel."""
    extent = panel.agg(
        F.countDistinct("ticker").alias("tickers"), F.count("*").alias("rows"), F.min("date").alias("start"),
        F.max("date").alias("end"))
    parts: list[Column] = [schema_fingerprint(features)] + [
        F.col(c).cast("string") for c in ("tickers", "rows", "start", "end")]
    return extent.select(schema_fingerprint(features).alias("schema"), "tickers", "rows", "start", "end",
                         short_sha1(F.concat_ws("|", *parts), 12).alias("panel_id"))


def target_rows(panel: DataFrame, kind: str, horizon: int, features=vocab.FEATURES) -> DataFrame:
    """Labelled rows of one target with at least one feature present; ``y`` is the class."""
    label = F.col(f"label_{kind}_{horizon}d")
    return panel.where(label.isNotNull() & F.coalesce(*[F.col(c) for c in features]).isNotNull()).select(
        "ticker", "date", *features, label.cast("int").alias("y"))


def latest_rows(panel: DataFrame, columns) -> DataFrame:
    """The last row of every ticker, by one aggregate."""
    return panel.groupBy("ticker").agg(F.max_by(F.struct("date", *columns), "date").alias("__last")).select("ticker", "__last.*")
