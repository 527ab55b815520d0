"""Repeated strings, lines, paragraphs and near-duplicate documents against brute force."""

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelyard.llm import jaccard, lines, paragraphs, suffixes
from panelyard.llm.components import components
from tests.llm.helpers import collected, docs, text, words


def brute_repeats(rows, window=200):
    data = [(t or "").encode() for _, t in rows]
    seen = {}
    for b in data:
        for p in range(len(b) - window + 1):
            seen[b[p:p + window]] = seen.get(b[p:p + window], 0) + 1
    out = []
    for (i, _), b in zip(rows, data):
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - window + 1):
            if seen[b[p:p + window]] > 1:
                gone[p:p + window] = True
        spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])).hexdigest()))
    return sorted(out, key=str)


def test_repeated_strings(spark):
    passage, other = text(1, 60), text(2, 45)
    rows = [(i, f"{text(100 + i, 30)} {passage if i % 3 else other} {text(200 + i, 25)}") for i in range(30)]
    rows += [(40, passage[:199]), (41, passage[3:203]), (42, "la " * 300), (43, "la " * 300), (44, None), (45, ""), (46, "é" * 400), (None, passage),
             (47, rows[0][1]), (47, rows[0][1]), (48, text(9, 3000) + passage + text(10, 10) + passage)]
    given = docs(spark, rows).withColumn("rid", F.lit("clash")).repartition(3)
    assert sorted(collected(suffixes.without_repeats(given)), key=str) == brute_repeats(rows)
    assert collected(suffixes.without_repeats(docs(spark, []))) == []


def test_repeats_across_bucket_bounds(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "BUCKET_SEGMENTS", 8)
    monkeypatch.setattr(suffixes, "BUCKET_REQUESTS", 3)
    passage = text(1, 60)
    rows = [(i, f"{text(300 + i, 12)} {passage} {text(400 + i, 12)}") for i in range(40)]
    assert sorted(collected(suffixes.without_repeats(docs(spark, rows))), key=str) == brute_repeats(rows)


def within_one(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return a == b
    if len(a) > len(b):
        a, b = b, a
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


def brute_lines(rows, least=lines.LEAST):
    places = [(i if i is not None else lines.LAST_ID, p, x) for i, t in rows if t is not None for p, x in enumerate(t.split("\n")) if x.strip(" \t\r\f\v")]
    first = {}
    for i, p, x in sorted(places):
        first.setdefault(x, (i, p))
    near = {x for x in first if len(x) >= least and any(
        len(y) >= least and first[y] < first[x] and within_one(x, y) for y in first)}
    out = []
    for i, t in rows:
        own = [] if t is None else t.split("\n")
        key = i if i is not None else lines.LAST_ID
        kept = [x for p, x in enumerate(own) if x not in first or x not in near and first[x] == (key, p)]
        n_near = sum(x in near and first[x] == (key, p) for p, x in enumerate(own))
        out.append((i, len(own), len(own) - len(kept), n_near, hashlib.md5("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_lines_within_one_edit(spark):
    base = [text(500 + i, 9) for i in range(6)] + ["short line", "é" * 20 + "ß", "a" * 40, text(600, 700)]
    rng = np.random.default_rng(3)

    def edited(x):
        at, kind = int(rng.integers(len(x))), int(rng.integers(4))
        return [x[:at] + "Z" + x[at + 1:], x[:at] + x[at + 1:], x[:at] + "Z" + x[at:], x][kind]

    rows = [(i, "\n".join([edited(edited(x)) if rng.random() < 0.2 else edited(x) for x in rng.permutation(base)[:4]] + ["", "  ", text(700 + i, 8)]))
            for i in range(40)]
    rows += [(50, None), (51, ""), (None, base[0] + "\n" + base[1]), (52, "\n\n"), (53, base[2] + "\n" + base[2] + "\nshort lime")]
    given = docs(spark, rows).withColumn("line", F.lit("clash"))
    assert sorted(collected(lines.line_report(given)), key=str) == brute_lines(rows)
    kept = lines.dedup_lines(given)
    assert kept.columns == given.columns and kept.count() == len(rows)
    assert all(r["n_chars"] == len(r["text"]) for r in kept.where("text IS NOT NULL").collect())
    assert collected(lines.line_report(docs(spark, []))) == []


def brute_components(rows, size, percent):
    sets = {}
    for i, t in rows:
        w = "".join(c.lower() if c.isascii() else c for c in (t or "")).split()
        sets.setdefault(i, []).append(frozenset(tuple(w[k:k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset())
    nodes = {s for i, own in sets.items() if i is not None for s in own if s}
    up = {s: s for s in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(nodes, 2):
        both = len(a & b)
        if 100 * both >= percent * (len(a) + len(b) - both):
            up[find(a)] = find(b)
    least = {}
    for i, own in sets.items():
        for s in own:
            if i is not None and s:
                least[find(s)] = min(least.get(find(s), i), i)
    return sorted(((i, len(s), i if i is None or not s else least[find(s)]) for i, own in sets.items() for s in own), key=str)


def near_documents(groups, copies, n, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        base = words(800 + g, n)
        for _ in range(copies):
            own = list(base)
            for at in rng.integers(0, n, int(rng.integers(0, 4))):
                own[at] = f"w{rng.integers(1_000_000)}"
            rows.append((len(rows), " ".join(own)))
    return rows


def test_jaccard_components(spark):
    rows = near_documents(4, 12, 70) + near_documents(1, 60, 80, seed=5)
    rows = [(k, t) for k, (_, t) in enumerate(rows)]
    rows += [(900, None), (901, ""), (902, "one two"), (903, "ONE  two"), (904, rows[3][1].upper()), (None, rows[3][1]), (2, text(1, 40)), (905, text(1, 40)),
             (906, "x " * 500), (907, "x " * 700), (908, text(3, 9000)), (908, text(3, 9000))]
    given = docs(spark, rows).withColumn("n", F.lit("clash")).repartition(3)
    assert sorted(collected(jaccard.jaccard_components(given)), key=str) == brute_components(rows, 4, 85)
    kept = jaccard.one_of_each_group(given, 5, 80)
    assert kept.columns == given.columns
    ids = [r["doc_id"] for r in kept.collect()]
    want = [c for i, _, c in brute_components(rows, 5, 80) if c == i and i is not None]
    assert sorted(i for i in ids if i is not None) == sorted(set(want) | {2} if ids.count(2) == 1 else list(set(want)) + [2])
    assert ids.count(None) == 1
    assert collected(jaccard.jaccard_components(docs(spark, []))) == []


def test_groups_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 20)
    monkeypatch.setattr(jaccard, "SHORT", 4)
    rows = near_documents(2, 45, 60, seed=8)
    rows = [(k, t) for k, (_, t) in enumerate(rows)]
    assert sorted(collected(jaccard.jaccard_components(docs(spark, rows))), key=str) == brute_components(rows, 4, 85)


def test_components_of_long_paths_and_stars(spark):
    pairs = [(i, i + 1) for i in range(100, 160)] + [(500, k) for k in range(501, 540)] + [(7, 7), (900, 899)]
    got = dict(collected(components(spark.createDataFrame(pairs, "a BIGINT, b BIGINT"))))
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[k] == 500 for k in range(500, 540)) and got[900] == got[899] == 899
    assert collected(components(spark.createDataFrame([], "a BIGINT, b BIGINT"))) == []


def test_small_tables_are_few_files(spark, monkeypatch, tmp_path):
    names = "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled"
    kept = [spark.conf.get(name) for name in names]
    made = iter(range(1_000))
    monkeypatch.setattr("panelyard.session.new_path", lambda spark, name: f"{tmp_path}/{name}-{next(made)}")
    base = words(3, 80)
    given = [(i, " ".join(base + words(100 + i, 3))) for i in range(30)]
    try:
        for name, value in zip(names, ("23", "false")):
            spark.conf.set(name, value)
        got = collected(jaccard.jaccard_components(docs(spark, given)))
    finally:
        for name, value in zip(names, kept):
            spark.conf.set(name, value)
    assert sorted(r[::2] for r in got) == [(i, 0) for i in range(30)]
    files = {d.name: len(list(d.glob("part-*"))) for d in tmp_path.iterdir()}
    for table in ("star", "holders", "texts"):
        assert max(n for name, n in files.items() if name.startswith(table)) == 1


def test_paragraphs(spark):
    line, passage = text(1, 20), ". ".join(text(20 + k, 13) for k in range(5)) + "."
    near = words(1, 20)
    near[0] = "changed"
    rows = [(i, f"{text(50 + i, 30)}. {text(70 + i, 12)}\n{text(90 + i, 15)}") for i in range(20)]
    rows += [(30, f"{text(31, 9)}\n{line}"), (31, line), (32, " ".join(near)), (33, text(2, 7)), (34, text(2, 7)),
             (40, f"{text(41, 30)} {passage} {text(42, 20)}"), (41, f"{text(43, 25)} {passage} {text(44, 40)}"), (50, None), (51, ""), (None, line), (52, "? ! .")]
    got = collected(paragraphs.repeated_paragraphs(docs(spark, rows).withColumn("place", F.lit("clash"))))
    removed = {(r[0], r[5]) for r in got if r[7]}
    assert {(31, 30), (32, 30)} <= removed and (41, 40) in removed
    assert {r[0] for r in got} == {30, 31, 32, 40, 41}
    by_id = {r[0]: r for r in got}
    data = dict(rows)[31].encode()
    assert data[by_id[31][2]:by_id[31][3]].decode() == line
    assert collected(paragraphs.repeated_paragraphs(docs(spark, []))) == []


def sentences(seed, n, size):
    own = words(seed, n)
    return " ".join(w + "." if k % size == size - 1 else w for k, w in enumerate(own))


@pytest.mark.parametrize("size, lead", [(5, 0), (5, 3), (30, 13), (60, 5)])
def test_passages_inside_long_lines(spark, size, lead):
    """Passages of 50 words of sentences of ``size`` words that start ``lead`` words into a sentence, in long lines of other words."""
    rows, passages = [], {}
    for k in range(40):
        passages[k] = " ".join(sentences(5000 + k, lead + 50, size).split()[lead:])
        for copy in range(2):
            rows.append((100 * copy + k, f"{sentences(6000 + 2 * k + copy, 37, 12)} {passages[k]} {sentences(7000 + 2 * k + copy, 43, 12)}"))
    got = collected(paragraphs.repeated_paragraphs(docs(spark, rows)))
    texts = {i: t.encode() for i, t in rows}
    assert {r[0] for r in got if r[7]} == {100 + k for k in range(40)} and {r[0] for r in got if not r[7]} == set(range(40))
    assert all(r[5] == r[0] % 100 and r[4] >= 8 for r in got) and len({(r[0], r[1]) for r in got}) == len(got)
    share = []
    for k in range(40):
        gone = np.zeros(len(texts[100 + k]), bool)
        for r in got:
            if r[0] == 100 + k:
                gone[r[2]:r[3]] = True
        share.append(gone.sum() / len(passages[k]))
    assert np.mean(share) > 0.6 and max(share) <= 1.3


def test_every_word_of_a_long_line_is_compared():
    texts = [sentences(k, 400, 4) + "\n" + text(k + 50, 41) for k in range(5)] + ["la " * 1000, "Oh. " * 300]
    p = paragraphs.Paragraphs(pa.array(texts))
    second = p.layer == 1
    assert [int(p.words[second & (p.row == r)].sum()) for r in range(7)] == [441] * 5 + [1000, 300]
    assert p.words[second].min() >= 8 and p.words[second].max() <= 15


def test_shingles_of_many_paragraphs_at_once():
    """More units than fit beside a key in one integer: each shingle of each unit once, in order."""
    rng = np.random.default_rng(2)
    unit, key = np.sort(rng.integers(0, 9_500, 60_000)), rng.integers(0, 1 << 52, 900, dtype=np.uint64)[rng.integers(0, 900, 60_000)]
    got = paragraphs.distinct(unit, key, 9_502)
    assert list(zip(*(x.tolist() for x in got))) == sorted(set(zip(unit.tolist(), key.tolist())))
    assert [len(x) for x in paragraphs.distinct(unit[:0], key[:0], 0)] == [0, 0]


def test_band_keys_travel_packed(spark, monkeypatch):
    """A row of the exchange holds all keys that a block has for a part of the lists, and the lists are those of single rows."""
    seen = []
    monkeypatch.setattr(paragraphs, "PART_POSTINGS", 300)
    monkeypatch.setattr(paragraphs, "shared_lists_packed", lambda postings, percent: seen.append(postings) or jaccard.shared_lists_packed(postings, percent))
    rows = [(k, "\n".join([text(k, 20), text(k + 1_000, 12), " ".join([f"first{k % 2}", *words(k // 2 + 5_000, 30)])])) for k in range(120)]
    got = collected(paragraphs.repeated_paragraphs(docs(spark, rows)))
    assert {r[0] for r in got if r[7]} >= {k for k in range(120) if k % 2}
    travelling = seen[0].collect()
    bands, _ = paragraphs.tuned()
    single = [x for r in travelling for x in zip(np.frombuffer(r["h"], np.int64).tolist(), np.frombuffer(r["n_late"], np.int32).tolist(),
                                                 np.frombuffer(r["set_key"], np.int64).tolist())]
    assert len(single) >= bands * 300 and len({r["part"] for r in travelling}) >= 5 and len(travelling) < len(single) / 10
    plain = jaccard.shared_lists(spark.createDataFrame(single, "h BIGINT, n_late INT, set_key BIGINT"), 80)
    together = jaccard.shared_lists_packed(seen[0], 80)
    assert together.count() > 0 and sorted(collected(plain)) == sorted(collected(together))


def test_only_asked_bytes_are_read_again(spark):
    """The shingles come from the bytes of the paragraph, of a text that has the set there."""
    long = sentences(3, 90, 5)
    texts = [(1, f"{text(1, 9)}\n{text(2, 20)}"), (1, text(3, 25)), (1, "Short."), (2, f"\u00e4\u00f6 {text(4, 7)}.\n{long}"), (3, text(5, 30)), (3, text(6, 30))]
    known = docs(spark, texts)
    units = paragraphs.listed(known).collect()
    asked = spark.createDataFrame([(r["set_key"], r["doc_id"], r["first_byte"], r["end_byte"]) for r in units], "set_key BIGINT, doc_id BIGINT, first_byte INT, end_byte INT")
    got = dict(collected(paragraphs.shingles_of(known, asked.select("set_key", "doc_id", paragraphs.ranged("first_byte", "end_byte").alias("bytes")))))
    want = {}
    for _, t in texts:
        p = paragraphs.Paragraphs(pa.array([t]))
        want |= {int(k): p.key[p.unit == u].tobytes() for u, k in enumerate(p.set_key)}
    assert len(want) > 12 and {k: bytes(v) for k, v in got.items()} == want


def test_second_cutting_takes_places_in_order():
    rng = np.random.default_rng(5)
    for values in (2, 40, 100_000):
        new = rng.random(700) < 0.01
        new[0] = True
        line = np.cumsum(new) - 1
        pair, stop = rng.integers(0, 1 << 64, values, dtype=np.uint64)[rng.integers(0, values, 699)], rng.random(699) < 0.1
        length, head = np.bincount(line), np.flatnonzero(new)
        may = [i for i in range(700) if length[line[i]] > 40 and 8 <= i - head[line[i]] <= length[line[i]] - 8]
        taken = []
        for i in sorted(may, key=lambda i: (not stop[i - 1], int(pair[i - 1]) >> 1, i)):
            if all(abs(i - j) >= 8 for j in taken):
                taken.append(i)
        assert np.flatnonzero(paragraphs.joined(new, line, pair, stop)).tolist() == sorted(taken)


def test_paragraph_groups_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = []
    for g in range(3):
        base = words(40 + g, 35)
        for _ in range(25):
            own = list(base)
            for at in rng.integers(0, 35, int(rng.integers(0, 2))):
                own[at] = f"w{rng.integers(100_000)}"
            rows.append((len(rows), " ".join(own)))
    got = {r[0]: r[5] for r in collected(paragraphs.repeated_paragraphs(docs(spark, rows)))}
    want = {i: c for i, _, c in brute_components(rows, 5, 80)}
    grouped = {i: c for i, c in want.items() if list(want.values()).count(c) > 1}
    assert sum(got.get(i) == c for i, c in grouped.items()) >= 0.98 * len(grouped) and set(got) <= set(grouped)


@pytest.mark.parametrize("recall", [0.9, 0.99])
def test_bands_reach_the_recall(recall):
    bands, rows = paragraphs.tuned(80, recall)
    assert 1 - (1 - 0.8**rows) ** bands >= recall


def test_long_lists_of_large_sets(spark, monkeypatch):
    """Chains of near copies whose ends are no near copies: long lists, searched in blocks by signature or at once."""
    monkeypatch.setattr(jaccard, "SHORT", 6)
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 9)
    rng = np.random.default_rng(31)
    rows = []
    for g in range(3):
        base = words(9000 + g, 120)
        for i in range(40):
            base = list(base)
            for at in rng.integers(0, len(base), 2):
                base[at] = f"w{rng.integers(10**6)}"
            rows.append((100 * g + i, " ".join(base)))
    rows += [(i, rows[i - 500][1]) for i in range(500, 505)] + [(0, text(9100, 60)), (0, text(9101, 60)), (0, rows[5][1])]
    for large in (20, 5000):
        monkeypatch.setattr(jaccard, "LARGE", large)
        given = docs(spark, rows).repartition(4)
        got = sorted(collected(jaccard.jaccard_components(given)), key=str)
        assert got == brute_components(rows, 4, 85) and len({r[2] for r in got}) < 60


def test_postings_that_may_meet():
    """Against every pair: sizes that allow a link, and a smaller one that is early; with labels, no pair of two components is lost."""
    rng = np.random.default_rng(12)
    h, n = np.sort(rng.integers(0, 60, 400)), rng.integers(1, 60, 400)
    n = n[np.lexsort((n, h))]
    early, label = rng.random(400) < 0.5, rng.integers(0, 3, 400)
    pairs = [(x, y) for x, y in combinations(range(400), 2) if h[x] == h[y] and 100 * n[x] >= 85 * n[y] and early[x]]
    assert set(np.flatnonzero(jaccard.partnered(h, n, early, 85))) == {k for p in pairs for k in p}
    kept = set(np.flatnonzero(jaccard.partnered(h, n, early, 85, label)))
    assert {k for x, y in pairs if label[x] != label[y] for k in (x, y)} <= kept <= {k for p in pairs for k in p}


def test_pairs_at_the_threshold_meet():
    """The shingle that a pair of the least similarity shares first is early in the smaller set."""
    rng = np.random.default_rng(7)
    sizes = [(a, b) for a in range(1, 80) for b in range(a, 80) if 100 * a >= 85 * b]
    for a, b in sizes:
        least = -(-85 * (a + b) // 185)
        if least > a:
            continue
        keys = rng.permutation(10_000)[:a + b - least]
        x, y = np.sort(np.append(keys[:least], keys[least:a])), np.sort(np.append(keys[:least], keys[a:]))
        place = np.searchsorted(x, keys[:least])
        early = place <= a - -(-170 * a // 185)
        probed = np.searchsorted(y, keys[:least]) < b - -(-85 * b // 100) + 1
        assert (early & probed).any()


def test_sets_of_a_lone_size_are_not_searched(spark):
    """Of a long list only sets go on that have one of another component and a fitting size there."""
    sizes = [10, 11, 12, 40, 90, 91, 200, 201, 500]
    rows = [(1, n, k, n != 90, k, 200 if n in (200, 201) else k) for k, n in enumerate(sizes)] + [(2, 70, 50, True, 50, 50), (2, 71, 51, True, 51, 51), (2, 71, 52, True, 50, 52)]
    pairs, long = jaccard.meetings(spark.createDataFrame(rows, "h BIGINT, n INT, set_key BIGINT, early BOOLEAN, star BIGINT, label BIGINT"), 85, 3)
    assert sorted(collected(long)) == [(0, 10, 1, 0), (1, 11, 1, 1), (2, 12, 1, 2)]
    assert sorted(collected(pairs)) == [(50, 51), (51, 52)]


def test_documents_without_a_line_left(spark):
    a, b = text(1, 9), text(2, 9)
    given = docs(spark, [(1, f"{a}\n{b}"), (2, f"{b}\n\n{a}"), (3, f"{a}\n{text(3, 9)}"), (4, ""), (5, " \n"), (6, None)])
    kept = {r["doc_id"]: r["text"] for r in lines.dedup_lines(given, keep_emptied=False).collect()}
    assert kept == {1: f"{a}\n{b}", 3: text(3, 9), 4: "", 5: " \n", 6: None}
    assert {r["doc_id"] for r in lines.dedup_lines(given).collect()} == {1, 2, 3, 4, 5, 6}
