"""The bitmap before a join loses no row."""

from pyspark.sql import functions as F

from panelyard.llm import sieve


def test_likely_rows_hold_all_that_join(spark, monkeypatch):
    monkeypatch.setattr(sieve, "BITS", 1 << 10)
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text")).union(spark.sql("SELECT CAST(NULL AS BIGINT), 'n'"))
    keys = rows.where("doc_id % 100 = 7").select("doc_id")
    got = sieve.likely(rows, "doc_id", keys)
    assert got.columns == rows.columns and got.count() < 1500
    assert got.join(keys, "doc_id").count() == 50
    assert sieve.likely(rows, "doc_id", keys.limit(0)).count() == 0
