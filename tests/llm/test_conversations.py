"""Conversation repair against a plain search over edits."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from panelyard.llm import conversations, repair

SCHEMA = "conv_id BIGINT, turn BIGINT, role STRING, text STRING"
GIVEN = {0: 2, 1: 2, 2: 3, 3: 2}
NAME = {2: "user", 3: "assistant"}


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fate == 0:
            continue
        if fate == 1:
            text = ""
        if fate == 2:
            text = re.sub("[.!?]", "", text)
        if fate == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if fate == 3 else 1)
    return out


def cheapest(rows):
    """Least cost, edits and lines by a forward table; rows are (role, text, fault)."""
    table = {0: (0, "", ())}

    def inserted():
        for _ in range(4):
            for q, (c, a, r) in list(table.items()):
                n = GIVEN[q]
                better = (c + 3, a + "I", (*r, f"{NAME[n]}:"))
                table[n] = min(table.get(n, better), better)

    inserted()
    for role, text, fault in rows:
        new = {}

        def put(q, *entry):
            new[q] = min(new.get(q, entry), entry)

        for q, (c, a, r) in table.items():
            put(q, c + 4, a + "D", r)
            if fault in ("", "truncated"):
                more = 3 if fault else 0
                kept = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}.get((q, role[:1]))
                if kept:
                    put(kept, c + more, a + "K", (*r, f"{role}:{text}"))
                put(GIVEN[q], c + 3 + more, a + "R", (*r, f"{NAME[GIVEN[q]]}:{text}"))
        table = new
        inserted()
    return min(table[q] for q in (0, 3) if q in table)


def brute(rows):
    groups = {conv: [] for conv, *_ in rows}
    for conv, turn, role, text in damage(rows):
        groups[conv].append((turn is not None, turn or 0, role, text))
    out = []
    for conv, own in groups.items():
        own.sort()
        seen, faults = set(), []
        for _, _, role, text in own:
            words = re.sub("[\x20\x09-\x0D]", "", text)
            faults.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for known, t, _, _ in own if known]
        initials = [r[:1] for _, _, r, _ in own]
        cost, audit, lines = cheapest([(r, t, f) for (_, _, r, t), f in zip(own, faults)])
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                    sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def report(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def some(draw, conv, n, step=1):
    """A conversation with all kinds of faults."""
    out = []
    for turn in range(n):
        role = draw.choice(["user", "assistant"]) if draw.random() < 0.3 else ("user", "assistant")[turn % 2]
        role = draw.choice(["system", "tool", "", None, "USER"]) if draw.random() < 0.1 else role
        text = draw.choice(["Yes.", "no", " \t\n", "", None, "Ünï?  ", "a.b"]) if draw.random() < 0.4 else f"Words {draw.randrange(10**6)}."
        out.append((conv, None if draw.random() < 0.05 else turn * step, role, text))
    return out


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(4)
    out = [row for conv in range(150) for row in some(draw, conv, draw.randrange(1, 9))]
    out += some(draw, None, 6) + [(900, 3, "user", "One."), (900, 3, "user", "One."), (900, 3, "assistant", "Two."), (900, -5, "system", "S.")]
    out += [(901, None, "user", "a."), (902, 2**62, "user", "a."), (902, -5, "assistant", "b."), (903, 1, "user", "long " * 40_000 + ".")]
    out += [(conv, turn, "user", "x.") for conv in range(2000, 2060) for turn in range(1)]  # some lose all their rows
    return out


def test_conversations(spark, rows):
    table = spark.createDataFrame(rows, SCHEMA).withColumn("audit", F.lit("clash")).withColumn("copies", F.lit(7)).repartition(3)
    want = brute(rows)
    assert any(r[7] == "" and r[6] == 0 for r in want)
    assert report(conversations.repaired(table)) == want


def test_conversations_over_many_ranges(spark, rows, monkeypatch):
    """One conversation holds most rows; its pieces lie in several ranges, its texts in several chunks."""
    draw = random.Random(8)
    given = [r for r in rows if r[0] is not None and r[0] < 40] + some(draw, 17_000, 1500, 3) + [(17_000, 10, "user", "Again.")] * 400 + some(draw, None, 700)
    monkeypatch.setattr(conversations, "CHUNK_BYTES", 500)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "9")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = report(conversations.repaired(spark.createDataFrame(given, SCHEMA).repartition(5)))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == brute(given)


def test_no_conversations(spark):
    assert report(conversations.repaired(spark.createDataFrame([], SCHEMA))) == []


def test_block_tables_equal_the_search():
    draw, tables = random.Random(3), repair.tables()
    texts = {0: "system", 1: "user", 2: "assistant", 3: "tool"}
    for _ in range(1500):
        own = bytes(draw.randrange(9) for _ in range(draw.randrange(14)))
        rights, cost = tables.bounds(own)
        letters, state = tables.trace(own, rights)
        rows = [("user" if s == 8 else texts[s % 4], "t", "blank" if s == 8 else "truncated" if s >= 4 else "") for s in own]
        assert (cost + tables.vectors[rights[0]][0], letters + repair.CLOSING[state]) == cheapest(rows)[:2]


def test_steps_of_pieces_compose():
    draw, tables = random.Random(6), repair.tables()
    for _ in range(200):
        a, b = (bytes(draw.randrange(9) for _ in range(draw.randrange(11))) for _ in range(2))
        to, cost = tables.all_steps(b)
        front, more = tables.all_steps(a)
        both, total = tables.all_steps(a + b)
        assert (front[to] == both).all() and (more[to] + cost == total).all()
