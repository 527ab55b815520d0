"""Everything known about a ticker in one nested row."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from panelyard.operators.single import beside


def model_block(table: DataFrame | None, name: str, missing: str) -> DataFrame | None:
    """One row: the table of all targets as a block that says whether it is available, and why not."""
    if table is None:
        return None
    rows = table.agg(F.sort_array(F.collect_list(F.struct("target", *[c for c in table.columns if c != "target"]))).alias("per_target"))  # a row a target
    there = F.size("per_target") > 0
    return rows.select(F.struct(there.alias("available"), F.when(~there, F.lit(missing)).alias("reason"), "per_target").alias(name))


def build_payload(universe: DataFrame, scores: DataFrame, news: DataFrame, moves: DataFrame, analogs: DataFrame,
                  record: DataFrame, quality: DataFrame | None = None, guard: DataFrame | None = None,
                  deployable: DataFrame | None = None) -> DataFrame:
    """One row per ticker of the universe; each block says whether it is available.

    ``quality``, ``guard`` and ``deployable`` hold one row per target: measured skill in words, the record in regimes like today's, and whether
    anything simpler beats the model.  They are the same for every ticker; one that is not given is a block that says so.

    Every block is folded to one row per ticker before it is joined; a ticker has as many scores
    as there are models, and k analogs.
    """
    def block(df: DataFrame, name: str) -> DataFrame:
        return df.select("ticker", F.struct(*[c for c in df.columns if c != "ticker"]).alias(name))

    s = scores.groupBy("ticker").agg(
        F.max("as_of").alias("as_of"), F.max_by("last_close", "as_of").alias("last_close"),
        F.sort_array(F.collect_list(F.struct("target", "predicted_class", "probability", "baseline", "lift", "label_scale"))).alias("targets"))
    a = analogs.groupBy("ticker").agg(F.sort_array(F.collect_list(F.struct(
        "place", "match_ticker", "match_date", "distance", "forward_return_5d", "forward_return_20d", "outcome_5d"))).alias("matches"))
    out = universe.select("ticker", "name", "sector").join(s, "ticker", "left")
    for df, name in ((news.drop("top_headlines"), "sentiment"), (moves, "divergence"), (record, "feedback")):
        out = out.join(block(df, name), "ticker", "left")
    out = out.join(a, "ticker", "left")
    headlines = news.select("ticker", "top_headlines")
    out = out.join(headlines, "ticker", "left")
    blocks = []
    for table, name, missing in ((quality, "model_quality", "no skill was measured"), (guard, "regime_guard", "no regime record"),
                                 (deployable, "deployability", "not compared with simpler models")):
        one = model_block(table, name, missing)
        if one is None:
            blocks.append(F.struct(F.lit(False).alias("available"), F.lit("not given").alias("reason")).alias(name))
        else:
            out = beside(out, one)
            blocks.append(F.col(name))
    return out.select(
        "ticker", "name", "sector", "as_of", "last_close",
        F.struct(F.col("targets").isNotNull().alias("available"), F.when(F.col("targets").isNull(), "not scored").alias("reason"), "targets").alias("models"),
        *blocks, "sentiment", "top_headlines",
        "divergence", F.struct(F.col("matches").isNotNull().alias("available"), F.when(
            F.col("matches").isNull(), "no similar earlier situation").alias("reason"), "matches").alias("analogs"), "feedback")
