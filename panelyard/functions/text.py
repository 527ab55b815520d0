"""Item codes, identifiers and small text rules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from panelyard import vocab
from panelyard.functions.numeric import as_col


def item_codes(items: Column | str) -> Column:
    """Comma string -> array of codes without blanks and boilerplate; order kept."""
    parts = F.transform(F.split(F.coalesce(as_col(items), F.lit("")), ","), lambda c: F.trim(c))
    return F.filter(
        parts,
        lambda c: (c != "") & (c != vocab.BOILERPLATE_MODERN) & (c != vocab.BOILERPLATE_LEGACY),
    )


def short_sha1(text: Column | str, n: int) -> Column:
    return F.substring(F.sha1(as_col(text)), 1, n)


def event_key(ticker, day, kind, accession) -> Column:
    return short_sha1(F.concat_ws("|", as_col(ticker), as_col(day).cast("string"), as_col(kind), as_col(accession)), 16)


def text_key(text: Column | str) -> Column:
    """Cache key of a text: surrounding white space and case do not count."""
    return short_sha1(F.lower(F.regexp_replace(as_col(text), "^\\s+|\\s+$", "")), 20)


def looks_delisted(reason: Column | str) -> Column:
    return F.lower(F.coalesce(as_col(reason), F.lit(""))).rlike("|".join(vocab.DELISTING_WORDS))


def lookup(mapping: dict, key: Column, default=None) -> Column:
    """Small fixed dictionary as a map literal."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def source_tier(source: Column | str) -> Column:
    name = F.lower(F.trim(F.coalesce(as_col(source), F.lit(""))))
    return lookup(vocab.SOURCE_TIERS, name, vocab.DEFAULT_TIER)


def schema_fingerprint(names) -> Column:
    """Order-free fingerprint of a feature list."""
    return short_sha1(F.lit("|".join(sorted(names))), 12)
