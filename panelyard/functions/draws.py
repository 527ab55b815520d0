"""Repeatable pseudo-random draws from integer arithmetic, equal on every engine."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed multipliers of the generator; the seed, repetition and slot are mixed linearly first.
MIX_SEED, MIX_REP, MIX_SLOT = 1000003, 7919, 104729
STEP_A, STEP_C, MODULUS = 1103515245, 12345, 2147483648


def draw(seed: int, rep: Column, slot: Column, size: Column) -> Column:
    """An integer in [0, size)."""
    # every factor stays below the modulus before it is multiplied, so no product leaves 64 bits
    z = (F.lit(seed % MODULUS * MIX_SEED % MODULUS).cast("bigint") + rep.cast("bigint") % MODULUS * MIX_REP + slot.cast("bigint") % MODULUS * MIX_SLOT)
    x = (z % MODULUS * STEP_A + STEP_C) % MODULUS
    x = ((x + F.floor(x / 65536)) * STEP_A + STEP_C) % MODULUS
    return F.floor(x * size / MODULUS).cast("int")


def draw_sql(seed: int, rep: str, slot: str, size: str) -> str:
    """The same draw as SQL text, for checks on another engine."""
    z = (f"(CAST({seed % MODULUS * MIX_SEED % MODULUS} AS BIGINT) + CAST({rep} AS BIGINT) % {MODULUS} * {MIX_REP} "
         f"+ CAST({slot} AS BIGINT) % {MODULUS} * {MIX_SLOT})")
    x = f"(({z} % {MODULUS} * {STEP_A} + {STEP_C}) % {MODULUS})"
    x = f"((({x} + CAST(floor({x} / 65536.0) AS BIGINT)) * {STEP_A} + {STEP_C}) % {MODULUS})"
    return f"CAST(floor({x} * {size} / {MODULUS}.0) AS INTEGER)"
