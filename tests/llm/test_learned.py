"""Quality, toxicity, neighbours and decontamination: held-out accuracy, exact search, recall, edit distances."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from panelyard.llm import decontamination, flat, neighbours, quality, toxicity
from tests.llm.helpers import collected, docs, text, words


def labelled_docs(spark, bad, n=400):
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(n):
        is_bad = bool(rng.random() < 0.3)
        rows.append((i, bad(i) if is_bad else text(i, 60)))
        labels.append((i, int(not is_bad), int(is_bad)))
    rows += [(n, None), (n + 1, ""), (n + 2, "z" * 100_000), (None, text(3, 20)), (5, rows[5][1])]
    labels += [(None, 1, 0), (7, None, None), (8, labels[8][1], labels[8][2])]
    return docs(spark, rows), spark.createDataFrame(labels, "doc_id BIGINT, quality INT, toxic INT"), {i: (q, t) for i, q, t in labels[:n]}


def test_quality_on_held_out_rows(spark):
    given, labels, truth = labelled_docs(spark, lambda i: " ".join(w.upper() + "!!" for w in words(i, 40)))
    rows = quality.score_quality(given.withColumn("score", F.lit("clash")), labels).collect()
    assert len(rows) == 405 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 90 and np.mean([r["predicted"] == truth[r["doc_id"]][0] for r in held]) > 0.97
    kept = quality.keep_good(given, labels)
    assert kept.columns == given.columns
    good = {i for i, (q, _) in truth.items() if q == 1}
    ids = {r["doc_id"] for r in kept.collect()}
    assert len(good - ids) <= 0.02 * len(good) and len(ids & (set(truth) - good)) <= 5


def peak_mb(work) -> float:
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_tasks_hold_small_blocks(monkeypatch):
    texts = [text(k, 400) for k in range(40)]
    batch = pa.RecordBatch.from_pydict({"text": [texts[k % 40] for k in range(1600)]})
    assert batch.nbytes > 3_000_000
    monkeypatch.setattr(flat, "_powers", {})
    fitted = np.random.default_rng(2).normal(size=(1 << quality.PLACES_LOG2) + 3)
    seen = []
    assert peak_mb(lambda: seen.extend((block.num_rows, p) for block, p in quality.judged(iter([batch]), fitted))) < 100
    assert sum(n for n, _ in seen) == 1600
    p = np.concatenate([p for _, p in seen])
    np.testing.assert_array_equal(p, np.concatenate([quality.probability(b.column("text"), fitted) for b in flat.blocks(batch)]))


def test_fit_holds_no_values_of_all_rows():
    draw = np.random.default_rng(4)
    rows = [np.unique(draw.integers(0, 1 << 16, 4_000)).astype("<i4") for _ in range(1_500)]
    y = np.where(draw.random(1_500) < 0.5, 1.0, -1.0)
    ratio = draw.normal(size=1 << 16)
    assert peak_mb(lambda: quality.descend(rows, y, ratio, np.ones(1_500))) < sum(r.nbytes for r in rows) / 4e6


def test_scores_without_labels(spark):
    given = docs(spark, [(1, "a b"), (2, None)])
    none = spark.createDataFrame([], "doc_id BIGINT, quality INT, toxic INT")
    assert {r["score"] for r in quality.score_quality(given, none).collect()} == {0.5}
    assert len(toxicity.score_toxicity(given, none).collect()) == 2
    assert quality.score_quality(docs(spark, []), none).count() == 0
    assert toxicity.score_toxicity(docs(spark, []), none).count() == 0


def test_dual_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(2)
    features = [np.flatnonzero(rng.random(30) < 0.3) for _ in range(80)]
    y = np.where(rng.random(80) < 0.5, 1.0, -1.0)
    ratio, cost = rng.standard_normal(30), np.full(80, 0.5)
    w = quality.descend(features, y, ratio, cost)
    x = np.zeros((80, 31))
    for i, f in enumerate(features):
        x[i, f] = ratio[f] / np.sqrt(max(1, len(f)))
        x[i, 30] = 1

    def loss(v):
        return 0.5 * v @ v + (cost * np.maximum(0, 1 - y * (x @ v))).sum()

    best = np.zeros(31)
    for step in range(1, 20_000):
        best -= (best - ((cost * y * (y * (x @ best) < 1)) @ x)) / (step + 20)
    assert loss(w) <= loss(best) * 1.01


def test_toxicity_on_held_out_rows(spark):
    mark = words(9999, 6)

    def toxic(i):
        own = words(i, 50)
        for k in range(6):
            own[(7 * k + i) % 50] = mark[k]
        return " ".join(own)

    given, labels, truth = labelled_docs(spark, toxic)
    rows = toxicity.score_toxicity(given.withColumn("evidence", F.lit("clash")), labels).collect()
    assert len(rows) == 405 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 50 and np.mean([r["predicted"] == truth[r["doc_id"]][1] for r in held]) > 0.9
    assert all(0 < e["cosine"] <= 1 + 1e-9 for r in rows for e in r["evidence"])


def test_block_max_search_is_exact(monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", 16)
    monkeypatch.setattr(toxicity, "FIRST_BLOCKS", 2)
    monkeypatch.setattr(toxicity, "NEAREST", 7)
    examples = pa.array([text(i % 90, 30) for i in range(150)])
    row, key, count = toxicity.counted(examples)
    index = toxicity.Index(np.arange(150), np.zeros(150, np.int64), row, key, count)
    known, term = index.place(key)
    index.build(np.bincount(term, minlength=len(index.terms)), 150)
    matrix = np.zeros((150, len(index.terms)))
    for i, (t, w) in enumerate(index.queries(examples)):
        matrix[i, t] = w / (np.linalg.norm(w) or 1)
    for i, (t, w) in enumerate(index.queries(pa.array([text(i, 25) for i in range(40)]))):
        q = np.zeros(len(index.terms))
        q[t] = w / (np.linalg.norm(w) or 1)
        true = matrix @ q
        near, cosine = index.nearest(t, w)
        order = [j for j in np.lexsort((np.arange(150), -np.round(true, 12))) if true[j] > 0][:7]
        assert np.allclose(cosine, true[order]) and np.allclose(true[near], cosine)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT")


def test_neighbours_beyond_sample_and_block(spark, monkeypatch):
    """Most vectors are unknown to graph and router, and queries come in several blocks."""
    monkeypatch.setattr(neighbours, "PART_ROWS", 300)
    monkeypatch.setattr(neighbours, "SAMPLE", 900)
    monkeypatch.setattr(neighbours, "BLOCK", 20)
    monkeypatch.setattr(neighbours, "SLICE", 200)
    rng = np.random.default_rng(21)
    centres = rng.standard_normal((40, 24))
    points = centres[rng.integers(0, 40, 4000)] + 0.4 * rng.standard_normal((4000, 24))
    got = {}
    for r in neighbours.search(vectors(spark, [(i, p.tolist(), 0) for i, p in enumerate(points)])).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 4000, 20)) and all(len(v) == 20 for v in got.values())
    hits = 0
    for q, rows in got.items():
        score = np.array([float(np.dot(points[q].astype(np.float32).astype(float), p.astype(np.float32).astype(float))) for p in points])
        score[q] = -np.inf
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 21)) and all(abs(score[v] - s) < 1e-9 for _, v, s in rows)
        assert [r[2] for r in rows] == sorted((r[2] for r in rows), reverse=True)
        hits += len({v for _, v, _ in rows} & set(np.argsort(-score)[:20].tolist()))
    assert hits >= 0.9 * 20 * len(got)


def test_clear_queries_probe_few_parts():
    rng = np.random.default_rng(22)
    centres = 3 * rng.standard_normal((64, 24))
    points = centres[rng.integers(0, 64, 6000)] + 0.4 * rng.standard_normal((6000, 24))
    router, parts, upto = neighbours.fitted(points[:3000], 48_000, 20)
    _, before = router.ranked(points[3000:])
    assert parts == 32 and (before < upto).sum(1).mean() < parts / 4


def test_neighbours_reach_the_recall(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PART_ROWS", 200)
    monkeypatch.setattr(neighbours, "SLICE", 150)
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((30, 16))
    points = (centres[rng.integers(30, size=3000)] + 0.4 * rng.standard_normal((3000, 16))).astype(np.float32)
    points[100:400] = points[100]
    rows = [(i, [float(x) for x in p], 0) for i, p in enumerate(points)]
    bad = [(5000, None, 0), (5020, [0.0] * 16, 0), (5040, [float("nan")] * 16, 0), (5060, [None] * 16, 0), (5080, [1.0], 0), (None, rows[3][1], 0), rows[7]]
    got = neighbours.search(vectors(spark, rows + bad).withColumn("score", F.lit("clash"))).collect()
    assert len(got) == 150 * 20
    exact = points.astype(float) @ points.astype(float).T
    by_query = {}
    for r in got:
        by_query.setdefault(r["query_id"], {})[r["rank"]] = r
        assert abs(r["score"] - exact[r["query_id"], r["vec_id"]]) < 1e-9
    hits = 0
    for q, ranks in by_query.items():
        own = [ranks[k] for k in range(1, 21)]
        assert own == sorted(own, key=lambda r: (-r["score"], r["vec_id"])) and q not in [r["vec_id"] for r in own]
        floor = np.sort(np.delete(exact[q], q))[-20]
        hits += sum(r["score"] >= floor - 1e-9 for r in own)
    assert hits / len(got) >= 0.9
    copies = [by_query[100][k]["vec_id"] for k in range(1, 21) if 100 <= by_query[100][k]["vec_id"] < 400]
    assert copies and copies == list(range(101, 101 + len(copies)))


def test_few_and_no_vectors(spark):
    few = neighbours.search(vectors(spark, [(0, [1.0, 0.0], 0), (20, [0.0, 1.0], 0), (3, [1.0, 1.0], 0)]))
    assert sorted(collected(few)) == [(0, 1, 3, 1.0), (0, 2, 20, 0.0), (20, 1, 3, 1.0), (20, 2, 0, 0.0)]
    assert collected(neighbours.search(vectors(spark, []))) == []
    assert collected(neighbours.search(vectors(spark, [(0, [1.0], 0)]))) == []


def test_parts_are_balanced():
    points = np.random.default_rng(6).standard_normal((1000, 8))
    part = neighbours.balanced_parts(neighbours.graph(points, 10), 8)
    assert set(np.bincount(part, minlength=8)) == {125}


def edit(a, b):
    """Least edit distance of a to a substring of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return min(row)


def test_substring_distance():
    rng = np.random.default_rng(7)
    for _ in range(200):
        a, b = rng.integers(1, 5, rng.integers(1, 70)).astype(np.uint64), rng.integers(1, 5, rng.integers(0, 90)).astype(np.uint64)
        assert decontamination.distance(a, b)[0] == edit(list(a), list(b))


def test_leaks(spark):
    items = {k: words(1000 + k, 15 + 2 * k) for k in range(12)}
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()] + [(50, None), (51, ""), (52, "too short"), (None, text(77, 20))],
                                  "item_id BIGINT, text STRING")
    rng = np.random.default_rng(8)
    rows, truth = [], {}
    for i in range(120):
        own = words(2000 + i, int(rng.integers(20, 200)))
        if i % 3 == 0:
            k = i % 12
            leak = list(items[k])
            for at in rng.integers(0, len(leak), len(leak) // 10 if i % 2 else 0):
                leak[at] = "changed"
            at = int(rng.integers(len(own)))
            own[at:at] = leak
            truth[i] = k
        rows.append((i, " ".join(own)))
    rows += [(200, None), (201, ""), (202, " ".join(items[3]).upper().replace(" ", ", ")), (203, " ".join(items[4][:9])), (204, text(77, 20))]
    given = docs(spark, rows).withColumn("item_id", F.lit("clash"))
    got = {(r["doc_id"], r["item_id"]): r for r in decontamination.leaks(given, bench).collect()}
    want = {(i, k) for i, k in truth.items()} | {(202, 3), (204, None)}
    assert set(got) <= want and len(want - set(got)) <= 2
    for (i, k), r in got.items():
        own = " ".join(dict(rows)[i].lower().replace(",", " ").split()).split()
        item = items[k] if k is not None else words(77, 20)
        assert r["distance"] == edit(item, own)
        assert edit(item, own[r["first_word"]:r["end_word"]]) == r["distance"]
    kept = decontamination.without_leaks(given, bench)
    assert kept.columns == given.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in rows} - {i for i, _ in got}
    assert decontamination.leaks(docs(spark, []), bench).count() == 0
    assert decontamination.leaks(given, bench.limit(0)).count() == 0
    assert decontamination.without_leaks(given, bench.limit(0)).count() == len(rows)


def edited_at_bound(rng, item):
    """The item with a fifth of its words replaced, at different places."""
    out = list(item)
    for at in rng.choice(len(item), len(item) // 5, replace=False):
        out[at] = f"changed{rng.integers(1_000_000)}"
    return out


def test_leaks_edited_up_to_the_bound(spark):
    rng = np.random.default_rng(12)
    items = {k: words(5000 + k, 15 if k < 40 else 59) for k in range(80)}
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id BIGINT, text STRING")
    rows = [(i, " ".join(words(6000 + i, int(rng.integers(5, 40))) + edited_at_bound(rng, items[i % 40]) + words(7000 + i, 20))) for i in range(200)]
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontamination.leaks(docs(spark, rows), bench).collect()}
    want = {(i, i % 40) for i, _ in rows}
    assert set(got) <= want and max(got.values()) <= 3
    assert len(got) >= 0.95 * len(want)
    assert decontamination.without_leaks(docs(spark, rows), bench).count() == len(rows) - len(got)


def test_items_beyond_the_repetitions_are_searched_exactly(spark):
    rng = np.random.default_rng(13)
    items = {k: words(8000 + k, 5 if k < 60 else 30) for k in range(70)}
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id BIGINT, text STRING")
    rows = [(i, " ".join(words(9000 + i, i % 7) + edited_at_bound(rng, items[i % 60]) + words(9500 + i, i % 5))) for i in range(300)]
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(docs(spark, rows), bench).collect()}
    assert got == {(i, i % 60) for i, _ in rows}
    part = decontamination.Items(list(items), [" ".join(w) for w in items.values()])
    assert set(part.exact) == {2, 3} and set(part.repetitions[:60]) == {None} and all(part.repetitions[60:])
