"""Curriculum mixing against plain Python."""

import hashlib
import math
import re
import zlib

import pytest
from pyspark.sql import functions as F

from panelyard.llm import mixing
from tests.llm.helpers import SCHEMA, collected, docs, text


def given(spark, rows):
    """Documents from (doc_id, text, source) rows."""
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], SCHEMA)


def targets(sizes, weights, share, passes):
    """Reshare by weight until no source is above its passes."""
    left, open_sources, out = share * sum(sizes.values()) / 100, dict(weights), {}
    while open_sources:
        level = left / sum(open_sources.values())
        full = [s for s, w in open_sources.items() if passes * sizes[s] < level * w]
        if not full:
            return out | {s: level * w for s, w in open_sources.items()}
        for s in full:
            out[s] = passes * sizes[s]
            left -= out[s]
            del open_sources[s]
    return out


def brute(rows, share=mixing.SHARE_PERCENT, passes=mixing.MOST_PASSES):
    size = [len(re.findall("[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    sizes = {s: sum(n for n, r in zip(size, rows) if r[2] == s) for s in names}
    weights = {s: mixing.COURSES[i % 3].weight for i, s in enumerate(names)}
    target = targets(sizes, weights, share, passes)
    out = []
    for s in names:
        mine = [(hashlib.md5(f"mix:{'' if i is None else i}".encode()).hexdigest(), i or 0, n, zlib.crc32((t or "").encode()), i)
                for (i, t, of), n in zip(rows, size) if of == s]
        start = 0
        for _, _, n, _, i in sorted(mine, key=lambda r: r[:4]):
            taken = sum(max(0, min(n, math.floor(target[s] + 1e-9) - start - k * sizes[s])) for k in range(passes))
            out.append((i, n, sizes[s], round(target[s], 6), taken))
            start += n
    return sorted(out, key=str)


def report(df):
    return sorted(((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    out = [(i, text(i, 5 + i % 40), f"s{i % 7}" if i % 3 else "hot") for i in range(400)]
    out += [(400, None, "s1"), (401, "", "s2"), (402, " \t\n\x0b\x0c\r ", "s2"), (403, "a\x00b  c d", "s3"), (404, text(404, 30_000), "long"),
            (405, None, "empty"), (406, text(1, 9), None), (None, text(2, 9), None), (None, text(2, 9), None), (7, text(7, 12), "s0"), (7, text(7, 12), "s0"),
            (7, text(8, 12), "s0"), (408, text(3, 4), ""), (409, text(4, 4), "\U00010000"), (410, text(5, 4), "￿")]
    return out


def test_targets_and_takings(spark, rows):
    table = given(spark, rows).withColumn("taken", F.lit("clash")).withColumn("kind", F.lit("clash")).repartition(3)
    assert report(mixing.mix_report(table)) == brute(rows)


def test_takings_of_the_mix_add_up(spark, rows):
    table = given(spark, rows)
    mix = mixing.mixed(table).collect()
    assert [r["due"] for r in mix] == sorted(r["due"] for r in mix) and all(0 <= r["due"] <= 1 and r["words"] > 0 for r in mix)
    assert sum(r["words"] for r in mix) == sum(r["taken"] for r in mixing.schedule(table).collect())
    again = mixing.mixed(given(spark, rows[::-1]).repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, mix))


def test_demand_follows_the_schedule():
    """The inverse of the integral: a source that fades has used more than half of its words half-way."""
    def integral(course, time):
        return sum(f * (min(time, e) - b) + slope * (min(time, e) - b) ** 2 / 2 for b, e, f, slope, _ in course.pieces() if time > b)

    for course in mixing.COURSES:
        assert integral(course, 1) == pytest.approx(1)
    assert integral(mixing.COURSES[0], 0.5) > 0.6 and integral(mixing.COURSES[2], 0.5) < 0.4


def test_due_inverts_the_integral(spark):
    courses = [*mixing.COURSES, mixing.Course(1, ((0, 0), (0.25, 0), (0.5, 3), (1, 0)))]
    shares = spark.createDataFrame([(i / 40,) for i in range(41)], "share DOUBLE")
    for course in courses:
        for r in shares.select("share", mixing.due(F.col("share"), course).alias("due")).collect():
            got = sum(f * (min(r["due"], e) - b) + slope * (min(r["due"], e) - b) ** 2 / 2 for b, e, f, slope, _ in course.pieces() if r["due"] > b)
            assert got == pytest.approx(r["share"], abs=1e-9)


def test_edges(spark):
    assert collected(mixing.mix_report(docs(spark, []))) == []
    assert report(mixing.mix_report(given(spark, [(1, None, "a"), (2, " ", None)]))) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    one = given(spark, [(1, "a b c d", "a")])
    assert report(mixing.mix_report(one)) == [(1, 4, 4, 6.0, 6)]
    full = [r["taken"] for r in mixing.schedule(one, share_percent=200).collect()]
    assert full == [8]
    with pytest.raises(ValueError):
        mixing.schedule(one, share_percent=250)
    with pytest.raises(ValueError):
        mixing.Course(1, ((0, 1), (0.5, 1)))
