"""Mixing sources to target weights by a curriculum that changes over training.

Every source gets a target number of words: a share of all words in proportion to its weight, but never more than a whole number of
passes over the source; what a full source cannot take goes to the others by weight until nobody is above.  Over training (time 0 to 1)
each source follows a piecewise linear weight schedule.  Its integral, scaled to the target, is the source's cumulative demand, and the
inverse of that demand is the time at which a given word of the source is due.  The documents of a source stand in the order of a hash on
its axis of words, one pass after another; each taking of a document is due when its first word is, and the mix is sorted by that time.  The last
taking of a source is cut where the target is reached, so a source gives its target to the word, and no document gives more than the passes.

The axis is numbered in two levels (sizes of hash buckets, then documents inside a bucket), and facts of a source reach its documents
through those buckets, so a source with any share of the rows is spread over thousands of groups.  Column functions only.

Defined cases: a null or empty text, or one of white space, has size 0, is never taken and keeps null times; the null source is a source of
its own, after all others; a source without words has target 0; a null id stands for an empty one in the hash; repeated rows are documents of their own; rows that
agree in id, source and size are told apart by text, and equal rows stand next to each other in any order, which gives the same rows; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelyard.session import stored

WORD = "[^\\x20\\x09-\\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SHARE_PERCENT = 150  # of all words that the mix takes
MOST_PASSES = 2
BUCKET_DIGITS = 3  # hex digits of the hash bucket inside a source


@dataclass(frozen=True)
class Course:
    """Base weight of a source and its course over training: (time, factor) knots from time 0 to 1, linear between."""

    weight: int
    knots: tuple[tuple[float, float], ...]

    def __post_init__(self):
        times = [t for t, _ in self.knots]
        if self.weight < 1 or len(times) < 2 or times[0] != 0 or times[-1] != 1 or times != sorted(set(times)):
            raise ValueError("a course needs a positive weight and rising knots from time 0 to 1")
        if min(f for _, f in self.knots) < 0 or max(f for _, f in self.knots) == 0:
            raise ValueError("factors of a course are zero or more, and not all zero")

    def pieces(self) -> list[tuple[float, float, float, float, float]]:
        """(begin, end, factor at begin, slope, integral before) of every piece between knots, scaled to an integral of one."""
        areas = [(b - a) * (f + g) / 2 for (a, f), (b, g) in zip(self.knots, self.knots[1:])]
        whole, before, out = sum(areas), 0.0, []
        for ((a, f), (b, g)), area in zip(zip(self.knots, self.knots[1:]), areas):
            out.append((a, b, f / whole, (g - f) / (b - a) / whole, before))
            before += area / whole
        return out


#: Sources in code-point order take these courses in turn: heavy ones fade, middle ones peak half-way, light ones grow.
COURSES = (Course(5, ((0, 1.5), (1, 0.5))), Course(2, ((0, 0.5), (0.5, 1.5), (1, 0.5))), Course(1, ((0, 0.5), (1, 1.5))))


def words_of(text: Column) -> Column:
    """Number of words: each word becomes one letter, then white space goes."""
    return F.length(F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "x"), BLANKS, "")).cast("bigint")


def due(demand: Column, course: Course) -> Column:
    """The time at which a share ``demand`` (0 to 1) of a source's words has been asked for: the inverse of the integrated schedule."""
    out = None
    until = 1.0
    for begin, end, factor, slope, before in reversed(course.pieces()):
        rest = demand - F.lit(before)
        root = F.lit(factor) + F.sqrt(F.greatest(F.lit(factor * factor) + F.lit(2 * slope) * rest, F.lit(0.0)))
        time = F.least(F.lit(float(begin)) + F.when(root > 0, F.lit(2.0) * rest / root).otherwise(F.lit(0.0)), F.lit(float(end)))
        out = time if out is None else F.when(demand < F.lit(until), time).otherwise(out)
        until = before
    return out


def numbered_sources(sources: DataFrame) -> DataFrame:
    """``sources`` (no_source, of_source, ...) with ``turn``, their number by code point, null last: ranges first, then rows inside a range."""
    ranged = sources.repartitionByRange("no_source", "of_source").withColumn("range", F.spark_partition_id())
    ranged = stored(ranged, "sources")
    before = F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))  # one row a partition
    starts = ranged.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(before, F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("range").orderBy("no_source", "of_source"))
    return ranged.join(starts, "range").withColumn("turn", F.col("start") + inside - 1).drop("range", "start")


def with_targets(sources: DataFrame, share_percent: int, passes: int) -> DataFrame:
    """``sources`` (source_size, weight) with ``target``.

    A round puts every source that the level would lift above its passes at that bound and shares the rest among the others by weight; the level only
    rises, so rounds end when no further source is full.  A round is an aggregate of one row.
    """
    whole = sources.agg(F.sum("source_size")).head()[0] or 0
    full = (0, 0)  # words in full sources, their number
    level = 0.0
    while True:
        is_full = F.col("source_size") * passes <= F.lit(level) * F.col("weight")
        words, count, weights = sources.agg(F.sum(F.when(is_full, F.col("source_size"))), F.count(F.when(is_full, 1)),
                                            F.sum(F.when(~is_full, F.col("weight")))).head()
        if level and (words or 0, count) == full or not weights:
            break
        full = (words or 0, count)
        level = (share_percent * whole - 100 * passes * full[0]) / (100 * weights)
        if not whole:
            break
    return sources.withColumn("target", F.least(F.col("source_size").cast("double") * passes, F.col("weight") * F.lit(level)))


def schedule(docs: DataFrame, courses: Sequence[Course] = COURSES, share_percent: int = SHARE_PERCENT, passes: int = MOST_PASSES) -> DataFrame:
    """doc_id, size, source_size, target, taken and ``takes``, an array of (due, words) with one entry for each pass that takes the document."""
    if not 0 < share_percent <= 100 * passes:
        raise ValueError("the share must be above 0 and within the passes")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id", words_of(F.col("text")).alias("size"), F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("of_source"),
        F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("place"), F.crc32(F.encode(text, "UTF-8")).alias("mark"))
    rows = stored(rows.withColumn("bucket", F.substring("place", 1, BUCKET_DIGITS)), "sizes")
    group = ["no_source", "of_source"]
    buckets = rows.groupBy(*group, "bucket").agg(F.sum("size").alias("words"))
    sources = numbered_sources(buckets.groupBy(*group).agg(F.sum("words").alias("source_size")))
    kind = F.pmod(F.col("turn"), F.lit(len(courses))).cast("int")
    sources = stored(sources.select(*group, "source_size", kind.alias("kind"),
                                    F.element_at(F.array(*(F.lit(c.weight) for c in courses)), kind + 1).alias("weight")), "sources")
    facts = with_targets(sources, share_percent, passes).drop("weight")
    before = F.sum("words").over(Window.partitionBy(*group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = buckets.select(*group, "bucket", F.coalesce(before, F.lit(0)).alias("bucket_start")).join(facts, group)
    inside = F.sum("size").over(Window.partitionBy(*group, "bucket").orderBy("place", "doc_id", "size", "mark").rowsBetween(Window.unboundedPreceding, -1))
    placed = rows.withColumn("start", F.coalesce(inside, F.lit(0))).join(starts, [*group, "bucket"])
    placed = placed.withColumn("start", F.col("start") + F.col("bucket_start"))
    asked = F.floor("target")
    takes = []
    for turn in range(passes):
        begin = F.col("start") + F.lit(turn) * F.col("source_size")
        words = F.greatest(F.lit(0).cast("bigint"), F.least(F.col("size"), asked - begin))
        share = begin.cast("double") / F.col("target")
        time = None
        for k, course in enumerate(courses):
            time = due(share, course) if time is None else F.when(F.col("kind") == k, due(share, course)).otherwise(time)
        takes.append(F.when(words > 0, F.struct(time.alias("due"), words.alias("words"))))
    placed = placed.withColumn("takes", F.filter(F.array(*takes), lambda t: t.isNotNull()))
    taken = F.aggregate("takes", F.lit(0).cast("bigint"), lambda so_far, t: so_far + t["words"])
    return placed.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "takes")


def mixed(docs: DataFrame, courses: Sequence[Course] = COURSES, share_percent: int = SHARE_PERCENT, passes: int = MOST_PASSES) -> DataFrame:
    """The training order: doc_id, pass, due, words of every taking, sorted by the time it is due."""
    rows = schedule(docs, courses, share_percent, passes).select("doc_id", F.posexplode("takes").alias("pass", "take"))
    return rows.select("doc_id", "pass", F.col("take.due").alias("due"), F.col("take.words").alias("words")).orderBy("due", "doc_id", "pass")


def mix_report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, first_due, last_due; sorted by the time it is first due, unused ones last."""
    rows = schedule(docs)
    n = F.size("takes")
    first, last = F.when(n > 0, F.col("takes")[0]["due"]), F.when(n > 0, F.element_at("takes", n)["due"])
    return rows.select("doc_id", "size", "source_size", "target", "taken", first.alias("first_due"), last.alias("last_due")).orderBy(
        F.col("first_due").asc_nulls_last(), "doc_id")
