"""Vector codes against plain Python."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelyard.llm import vector_codes
from tests.llm.helpers import collected

SCHEMA = "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT"


def table(spark, rows):
    return spark.createDataFrame([(i, v, label) for i, v, label in rows], SCHEMA)


def brute(rows, length, parts=16, entries=64, rounds=2):
    """Integers, parts, rounds and codes by loops over Python ints."""
    ints = [(i, label, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, label in rows
            if v is not None and len(v) == length and all(x is not None and math.isfinite(x) for x in v)]
    cuts = [(p * length // parts, (p + 1) * length // parts) for p in range(parts)]
    first = sorted(ints, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    books = [[r[2][a:b] for r in first] for a, b in cuts]

    def best(book, part):
        return min((sum((x - y) ** 2 for x, y in zip(part, entry)), k) for k, entry in enumerate(book))

    for _ in range(rounds):
        for p, (a, b) in enumerate(cuts):
            mine = {}
            for _, _, v in ints:
                mine.setdefault(best(books[p], v[a:b])[1], []).append(v[a:b])
            books[p] = [[sum(c) // len(mine[k]) for c in zip(*mine[k])] if k in mine else entry for k, entry in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    out, sums = [], {}
    for i, label, v in ints:
        found = [best(books[p], v[a:b]) for p, (a, b) in enumerate(cuts)]
        out.append((i, label, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
        sums[label] = sums.get(label, 0) + out[-1][3]
    return sorted([(i, code, error, sums[label], digest) for i, label, code, error in out], key=str)


@pytest.fixture(scope="module")
def rows():
    draw = np.random.default_rng(5)
    out = [(int(i), [float(x) for x in draw.normal(0, 0.3, 32)], int(i % 5)) for i in draw.permutation(300)]
    out += [(i, list(out[i % 7][1]), None) for i in range(1000, 1040)]  # copies under a null label
    out += [(3, [0.0] * 32, 1), (3, [-0.0] * 31 + [-1e-9], 1), (None, [0.25] * 32, 2), (None, [0.25] * 32, 2)]
    return out + [(2000, None, 1), (2001, [1.0] * 31 + [None], 1), (2002, [float("nan")] * 32, 1), (2003, [float("inf")] * 32, None),
                  (2004, [1.0] * 16, 1), (2005, [], 1)]


def test_codes(spark, rows):
    given = table(spark, rows).withColumn("code", F.lit("clash")).withColumn("vec", F.lit(1)).repartition(3)
    assert sorted(collected(vector_codes.compress(given)), key=str) == brute(rows, 32)


def test_small_tables_odd_lengths_and_doubles(spark):
    few = [(i, [i / 7 - 0.3 * d for d in range(21)], i % 2) for i in range(9)]
    assert sorted(collected(vector_codes.compress(table(spark, few))), key=str) == brute(few, 21)
    short = [(i, [i / 3, 1.5], 1) for i in range(70)]
    doubles = table(spark, short).withColumn("embedding", F.col("embedding").cast("array<double>"))
    assert sorted(collected(vector_codes.compress(doubles)), key=str) == brute([(i, [float(np.float32(x)) for x in v], k) for i, v, k in short], 2)
    assert collected(vector_codes.compress(table(spark, []))) == []
    assert collected(vector_codes.compress(table(spark, [(1, None, 1), (2, [float("nan")], 1)]))) == []
    assert [r["code"] for r in vector_codes.compress(table(spark, [(1, [], None)])).collect()] == ["00" * 16]


def test_hot_labels_and_runs_give_the_same(spark, rows, monkeypatch):
    want = brute(rows, 32)
    monkeypatch.setattr(vector_codes, "HOT_LABEL", 4)
    monkeypatch.setattr(vector_codes, "RUN_VALUES", 32 * 7)
    assert sorted(collected(vector_codes.compress(table(spark, rows))), key=str) == want


def test_trie_finds_the_first_nearest_entry():
    draw = np.random.default_rng(2)
    parts = draw.integers(-6, 6, (3000, 4))
    entries = draw.integers(-6, 6, (30, 4))
    entries[20] = entries[4]
    leaves, copies, where = vector_codes.distinct_parts(parts)
    assert (leaves[where] == parts).all() and copies.sum() == len(parts) and [tuple(x) for x in leaves] == sorted({tuple(x) for x in parts})
    away = ((leaves[:, None, :] - entries[None]) ** 2).sum(2)
    for subtree in (1, 3, 50, 10_000):
        index, distance = vector_codes.walk(leaves, entries, subtree)
        assert (index == away.argmin(1)).all() and (distance == away.min(1)).all()


def test_decoded_vectors_have_the_given_error(spark, rows):
    usable, length = vector_codes.kept(table(spark, rows))
    books = vector_codes.fit_codebooks(usable, length)
    codes = {(r["vec_id"], r["label"]): r for r in vector_codes.encoded(usable, length, books).collect()}
    for i, v, label in rows[:50]:
        ints = np.floor(np.array(v, np.float32).astype(float) * 256)
        r = codes[(i, label)]
        if i != 3:
            assert ((ints - books.decode(r["code"])) ** 2).sum() == r["error"]
