"""The corpus pipeline, stage by stage, on planted documents."""

import corpus_pipeline
from panelyard.session import new_path
from tests.llm.helpers import docs, text, words


def planted(spark):
    """Folder with clean documents, junk, a repeated line, near copies and a leaked item."""
    rows, labels = [], []
    for i in range(240):
        junk = i % 4 == 3
        rows.append((i, " ".join(w.upper() + "!!" for w in words(i, 40)) if junk else f"{text(i, 60)}\n{text(1000 + i, 12)}"))
        labels.append((i, int(not junk), 0))
    line = text(5000, 14)
    rows += [(300, f"{text(301, 40)}\n{line}"), (301, f"{text(302, 40)}\n{line[:5]}Z{line[6:]}")]
    base = words(6000, 120)
    rows += [(310, " ".join(base)), (311, " ".join(base[:50] + ["changed"] + base[51:]))]
    item = text(7000, 30)
    rows += [(320, f"{text(321, 30)} {item} {text(322, 30)}"), (330, None), (331, "")]
    folder = new_path(spark, "planted")
    docs(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id BIGINT, quality INT, toxic INT").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id BIGINT, text STRING").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows


def test_stages_take_effect(spark):
    folder, rows = planted(spark)
    table = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, folder)
        assert out.columns == table.columns and out.dtypes == table.dtypes
        path = new_path(spark, name)
        out.write.parquet(path)
        table = spark.read.parquet(path)
        kept[name] = {r["doc_id"]: r["text"] for r in table.collect()}
    clean = {i for i in range(240) if i % 4 != 3}
    good = set(kept["quality_classifier"])
    assert clean <= good and not good & {i for i in range(240) if i % 4 == 3}
    assert set(kept["line_dedup"]) == good
    assert kept["line_dedup"][301] == text(302, 40) and kept["line_dedup"][300].endswith(text(5000, 14))
    assert good - set(kept["ngram_jaccard_join"]) == {311}
    assert set(kept["ngram_jaccard_join"]) - set(kept["benchmark_decontamination"]) == {320}
    assert all(kept["benchmark_decontamination"][i] == dict(rows)[i] for i in clean)
    pieces = corpus_pipeline.STAGES[-1][1](spark, table, folder).collect()
    assert {r["doc_id"] for r in pieces} == set(kept["benchmark_decontamination"])
    whole = corpus_pipeline.run(spark, folder)
    assert sorted((r["doc_id"], r["start"], r["ids_crc32"]) for r in whole.collect()) == sorted((r["doc_id"], r["start"], r["ids_crc32"]) for r in pieces)


def test_empty_tables(spark):
    folder = new_path(spark, "nothing")
    docs(spark, []).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id BIGINT, quality INT, toxic INT").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id BIGINT, text STRING").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
