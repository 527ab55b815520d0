"""Probability vectors, class names and per-row rules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from panelyard import vocab
from panelyard.functions.numeric import as_col


def as_vector(p: Column | str) -> Column:
    """A positive-class probability as the pair (1 - p, p)."""
    return F.array(1.0 - as_col(p), as_col(p))


def top_class(p: Column) -> Column:
    """0-based position of the largest probability; the first one on a tie."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def lift(p: Column, prior: Column) -> Column:
    return F.zip_with(p, prior, lambda a, b: a / F.greatest(b, F.lit(1e-9)))


def named(names, p: Column) -> Column:
    return F.map_from_arrays(F.array(*[F.lit(n) for n in names]), p)


def class_name(kind: Column | str, code: Column | str) -> Column:
    kind, code = as_col(kind), as_col(code)
    quiet, large = vocab.MAGNITUDE_NAMES
    down, flat, up = vocab.DIRECTION_NAMES
    return F.when(kind == "magnitude", F.when(code == 1, large).when(code == 0, quiet)).otherwise(
        F.when(code == 0, down).when(code == 1, flat).when(code == 2, up))


def realised_class(z: Column | str, threshold: Column | str, kind: Column | str) -> Column:
    """Class of a realised move of ``z`` scale units."""
    z, threshold, kind = as_col(z), as_col(threshold), as_col(kind)
    quiet, large = vocab.MAGNITUDE_NAMES
    down, flat, up = vocab.DIRECTION_NAMES
    return F.when(z.isNull(), None).when(
        kind == "magnitude", F.when(F.abs(z) >= threshold, large).otherwise(quiet)
    ).otherwise(F.when(z >= threshold, up).when(z <= -threshold, down).otherwise(flat))


def squared_error(p: Column, y: Column) -> Column:
    """Sum over classes of (p_c - [y = c])^2."""
    errors = F.transform(p, lambda x, i: F.pow(x - F.when(i == y, 1.0).otherwise(0.0), F.lit(2.0)))
    return F.aggregate(errors, F.lit(0.0), lambda a, e: a + e)


EPS64 = 2.220446049250313e-16  # double precision machine epsilon


def log_penalty(p: Column, y: Column) -> Column:
    chosen = F.get(p, y)
    return -F.ln(F.least(F.greatest(chosen, F.lit(EPS64)), F.lit(1.0 - EPS64)))
