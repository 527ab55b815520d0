"""Registry of runnable queries and of the SQL that checks them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelyard.catalog.fixture_sql import VIEWS
from panelyard.sources.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DERIVED: dict[str, str] = {}  # further named steps that check queries build on


def step(name: str, sql: str) -> None:
    """A named SQL step for oracles; may use the views and earlier steps."""
    DERIVED[name] = sql


def query(name: str, oracle: str | None = None):
    def register(build: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(Tables(spark, folder))

        run.__name__ = name
        run.__doc__ = build.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return build

    return register


def full_sql(body: str) -> str:
    """Prefix ``body`` with the definitions of every view and step it uses."""
    known = {**VIEWS, **DERIVED}
    needed: list[str] = []
    open_names: set[str] = set()

    def visit(text: str) -> None:
        for name, sql in known.items():
            if name not in needed and name not in open_names and re.search(rf"\b{name}\b", text):
                open_names.add(name)
                visit(sql)
                open_names.discard(name)
                needed.append(name)

    visit(body)
    body = body.strip()
    head = ",\n".join(f"{n} AS ({known[n].strip()})" for n in needed)
    match = re.match(r"WITH\s+(RECURSIVE\s+)?", body, re.I)
    if match:
        rest = body[match.end():]
        return f"WITH RECURSIVE {head + ',' if head else ''}\n{rest}"
    if not head:
        return body
    return f"WITH RECURSIVE {head}\n{body}"


def s6(expr: str, digits: int = 6) -> str:
    """The same settling as ``functions.numeric.settle``, as SQL."""
    return f"(floor(CAST({expr} AS DOUBLE) * 1e{digits} + 5001e-4) / 1e{digits})"


def big(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"
