"""Trailing windows per entity.

A window partition is one entity's daily series.  The tables that come here hold one row per
entity and day (duplicates are folded by an aggregate beforehand), so a partition is bounded by
the calendar -- about 250 rows a year -- however skewed the raw feed was.
All windows order by the day number, so Spark plans one exchange and shares the sort.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from panelyard.functions.numeric import as_col


class Trailing:
    """Window builder for one entity key and one order column."""

    def __init__(self, keys=("ticker",), order: str = "day"):
        self.keys = list(keys)
        self.order = order

    def whole(self) -> WindowSpec:
        return Window.partitionBy(*self.keys)

    def ordered(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(self.order)

    def rows(self, first: int, last: int = 0) -> WindowSpec:
        return self.ordered().rowsBetween(first, last)

    def days(self, first: int, last: int = 0) -> WindowSpec:
        return self.ordered().rangeBetween(first, last)

    def so_far(self) -> WindowSpec:
        """Everything up to and including this day (all rows of the day)."""
        return self.ordered().rangeBetween(Window.unboundedPreceding, Window.currentRow)

    def lag(self, c, n: int = 1) -> Column:
        return F.lag(as_col(c), n).over(self.ordered())

    def lead(self, c, n: int = 1) -> Column:
        return F.lead(as_col(c), n).over(self.ordered())

    def rolling(self, how: Callable, c, n: int, at_least: int, *, ahead: bool = False, gaps: bool = True) -> Column:
        """Aggregate over the last ``n`` rows (or the next ``n``), NULL below ``at_least`` values.

        Without ``gaps`` the caller vouches that NULLs only lead the series; the running count
        then replaces a count over the moving frame, which is recounted for every row.
        """
        w = self.rows(1, n) if ahead else self.rows(1 - n, 0)
        c = as_col(c)
        seen = F.count(c).over(w if gaps else self.rows(Window.unboundedPreceding, 0))
        return F.when(seen >= at_least, how(c).over(w))

    def rolling_pair(self, how: Callable, a, b, n: int, at_least: int, *, gaps: bool = True) -> Column:
        w = self.rows(1 - n, 0)
        both = F.when(as_col(b).isNotNull(), as_col(a))
        seen = F.count(both).over(w if gaps else self.rows(Window.unboundedPreceding, 0))
        return F.when(seen >= at_least, how(as_col(a), as_col(b)).over(w))

    def volatility(self, returns, n: int) -> Column:
        """Sample deviation over ``n`` rows, at least half of them present (NULLs only lead)."""
        return self.rolling(F.stddev_samp, returns, n, n // 2, gaps=False)

    def filled(self, c) -> Column:
        """Last non-null value so far."""
        return F.last(as_col(c), ignorenulls=True).over(self.so_far())


def moving_extremes(df: DataFrame, specs: dict[str, tuple[Callable, str]], n: int, at_least: int, t: Trailing) -> DataFrame:
    """Moving maxima and minima over the last ``n`` rows at a cost that does not grow with ``n``.

    Rows are cut into blocks of ``n``.  Any ``n`` consecutive rows are the end of one block and the
    start of the next, so the answer is the better of a running extreme from the right, ``n - 1``
    rows back, and a running extreme from the left, here (van Herk 1992).
    ``specs[out] = (F.max or F.min, input column)``.
    """
    df = df.withColumn("__v", F.floor((F.row_number().over(t.ordered()) - 1) / n).cast("int"))
    left = Window.partitionBy(*t.keys, "__v").orderBy(t.order).rowsBetween(Window.unboundedPreceding, 0)
    right = Window.partitionBy(*t.keys, "__v").orderBy(F.desc(t.order)).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({f"__right_{o}": how(c).over(right) for o, (how, c) in specs.items()})
    df = df.withColumns({f"__left_{o}": how(c).over(left) for o, (how, c) in specs.items()})
    seen = t.rows(Window.unboundedPreceding, 0)
    done = {}
    for o, (how, c) in specs.items():
        better = F.greatest if how is F.max else F.least
        value = better(F.col(f"__left_{o}"), t.lag(f"__right_{o}", n - 1))
        done[o] = F.when(F.count(c).over(seen) >= at_least, value)
    return df.withColumns(done).drop("__v", *[f"__{s}_{o}" for s in ("left", "right") for o in specs])


def decay_of(alpha: float | None = None, span: int | None = None) -> float:
    return alpha if alpha is not None else 2.0 / (span + 1.0)


def smooth(df: DataFrame, specs: dict[str, tuple[str, float, int]], t: Trailing) -> DataFrame:
    """Exponentially weighted means: ``specs[out] = (input column, alpha, least count)``.

    Solves y[0] = x[0], y[t] = alpha x[t] + (1 - alpha) y[t-1] for the non-null part of each
    input (nulls may lead, not interrupt) with plain window sums:
    inside a block of rows, y = q^j * sum(w x q^-j).  The block is short enough that q^-j stays
    below e^600, and so long that what reaches over two block borders is below e^-600 of its
    value; hence one carried value, the end of the block before, is enough.
    """
    rate = max(-math.log1p(-alpha) for _, alpha, _ in specs.values())
    return _recurrence(df, {
        out: (F.col(c), alpha, 1.0 - alpha, least, True) for out, (c, alpha, least) in specs.items()
    }, t, max(int(600 / rate), 1))


def linear_filter(df: DataFrame, out: str, shock, decay, initial, t: Trailing, block: int = 500) -> DataFrame:
    """y[t] = shock[t] + decay * y[t-1], y[-1] = initial; ``decay`` may differ per entity.

    Decays reach close to 1 here, so blocks carry further than one border: block ends are
    chained with a fold over the (few) blocks of an entity.
    """
    keys, order = t.keys, t.order
    numbered = (
        df.withColumn("__x", as_col(shock)).withColumn("__q", as_col(decay)).withColumn("__y0", as_col(initial))
        .withColumn("__r", F.row_number().over(t.ordered()) - 1)
        .withColumn("__b", F.floor(F.col("__r") / block).cast("int"))
        .withColumn("__j", F.col("__r") - F.col("__b") * block)
    )
    w = Window.partitionBy(*keys, "__b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    safe_q = F.greatest(F.col("__q"), F.lit(0.26))  # 0.26^-500 is the largest power that fits
    local = F.when(
        F.col("__q") >= 0.26,
        F.pow(safe_q, F.col("__j")) * F.sum(F.col("__x") * F.pow(safe_q, -F.col("__j"))).over(w),
    ).otherwise(
        # fast decays: forty terms are exact to double precision (0.26^40 < 1e-23)
        sum((F.coalesce(F.lag("__x", n).over(Window.partitionBy(*keys, "__b").orderBy(order)), F.lit(0.0))
             * F.pow(F.col("__q"), F.lit(n)) for n in range(1, 40)), F.col("__x"))
    )
    numbered = numbered.withColumn("__s", local)
    ends = numbered.groupBy(*keys, "__b").agg(
        F.max_by("__s", "__j").alias("s"), (F.max("__j") + 1).alias("n"),
        F.first("__q").alias("q"), F.first("__y0").alias("y0"),
    )
    chain = ends.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(F.col("__b").alias("b"), "s", "n", "q"))).alias("blocks"),
        F.first("y0").alias("y0"),
    )
    step = F.aggregate(
        "blocks", F.array(F.col("y0").cast("double")),
        lambda acc, b: F.concat(acc, F.array(b["s"] + F.pow(b["q"], b["n"]) * F.element_at(acc, -1))),
    )
    carried = chain.select(*keys, F.posexplode(F.slice(step, 1, F.size("blocks"))).alias("__b", "__c"))
    return (
        numbered.join(carried, [*keys, "__b"])
        .withColumn(out, F.col("__s") + F.pow(F.col("__q"), F.col("__j") + 1) * F.col("__c"))
        .drop("__x", "__q", "__y0", "__r", "__b", "__j", "__s", "__c")
    )


def _recurrence(df, specs, t: Trailing, block: int) -> DataFrame:
    df = df.withColumn("__r", F.row_number().over(t.ordered()) - 1)
    df = df.withColumn("__b", F.floor(F.col("__r") / block).cast("int")).withColumn(
        "__j", (F.col("__r") - F.floor(F.col("__r") / block) * block).cast("double"))
    seen = {f"__n_{o}": F.count(x).over(t.rows(Window.unboundedPreceding)) for o, (x, *_ ) in specs.items()}
    df = df.withColumns(seen)
    inside = Window.partitionBy(*t.keys, "__b").orderBy(t.order).rowsBetween(Window.unboundedPreceding, 0)
    local = {}
    for out, (x, alpha, q, _, first_whole) in specs.items():
        weight = F.when(F.col(f"__n_{out}") == 1, F.lit(1.0)).otherwise(F.lit(alpha)) if first_whole else F.lit(1.0)
        term = F.when(x.isNotNull(), weight * x * F.pow(F.lit(q), -F.col("__j")))
        local[f"__s_{out}"] = F.pow(F.lit(q), F.col("__j")) * F.sum(term).over(inside)
    df = df.withColumns(local)
    done = {}
    for out, (_, _, q, least, _) in specs.items():
        before = F.last(F.when(F.col("__j") == block - 1, F.col(f"__s_{out}")), ignorenulls=True).over(
            t.rows(Window.unboundedPreceding, -1))
        value = F.col(f"__s_{out}") + F.coalesce(F.pow(F.lit(q), F.col("__j") + 1) * before, F.lit(0.0))
        done[out] = F.when(F.col(f"__n_{out}") >= least, value)
    return df.withColumns(done).drop("__r", "__b", "__j", *seen, *local)
