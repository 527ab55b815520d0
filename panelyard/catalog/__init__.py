"""All runnable queries, grouped by family."""

from __future__ import annotations

import importlib

from panelyard.catalog import base

FAMILIES = ("windows", "timeline", "evaluation", "feedback", "news", "sources", "gate", "models", "streams")


def _load() -> None:
    for family in FAMILIES:
        importlib.import_module(f"panelyard.catalog.{family}")


def queries():
    _load()
    return dict(base.QUERIES)


def oracle_sql():
    _load()
    return {name: base.full_sql(sql) for name, sql in base.ORACLES.items()}


def flagship(spark, folder):
    _load()
    return base.QUERIES["target_balance"](spark, folder)
