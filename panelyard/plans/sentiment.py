"""Article scoring, per-ticker sentiment and divergence from the price."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from panelyard import vocab
from panelyard.functions.numeric import growth, ratio
from panelyard.functions.text import source_tier, text_key
from panelyard.operators.dedupe import keep_one
from panelyard.plans.events import item_rows

# Default word lists of the deterministic scorer (fixed values).
GOOD_WORDS = ("beat", "beats", "surge", "surges", "upgrade", "record", "growth", "strong")
BAD_WORDS = ("miss", "misses", "plunge", "plunges", "downgrade", "loss", "weak", "lawsuit")


def word_scores(text: Column, good=GOOD_WORDS, bad=BAD_WORDS) -> dict[str, Column]:
    """Positive, negative and neutral shares from word counts; no Python involved."""
    words = F.split(F.lower(text), "[^\\p{L}]+")

    def hits(names):
        return F.size(F.filter(words, lambda w: w.isin(*names)))

    total = hits(good) + hits(bad) + 1
    return {"positive": hits(good) / total, "negative": hits(bad) / total, "neutral": 1 / total}


def model_scores(texts: DataFrame, factory: Callable[[], Callable[[list[str]], list[tuple]]], batch: int = 16) -> DataFrame:
    """Score with a pluggable model, loaded once per task and fed in small batches.

    ``factory`` builds a function from texts to (positive, negative, neutral) triples.
    """
    schema = "STRUCT<positive: DOUBLE, negative: DOUBLE, neutral: DOUBLE>"

    @F.pandas_udf(schema)
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = factory()
        for part in parts:
            rows: list[tuple] = []
            for start in range(0, len(part), batch):
                rows.extend(model(part.iloc[start:start + batch].tolist()))
            yield pd.DataFrame(rows, columns=["positive", "negative", "neutral"])

    return texts.withColumn("__s", score("text")).select("*", "__s.*").drop("__s")


def score_missing(texts: DataFrame, cache: DataFrame, scorer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Scores by text hash: cached ones are looked up, each distinct missing text is scored once."""
    keyed = texts.withColumn("text_hash", text_key("text"))
    misses = keep_one(keyed.select("text_hash", "text").join(cache, "text_hash", "left_anti"), ["text_hash"], [F.col("text")])
    fresh = scorer(misses).select("text_hash", "positive", "negative", "neutral")
    hits = cache.join(keyed.select("text_hash"), "text_hash", "left_semi").select(*fresh.columns)
    return hits.unionByName(fresh)


def article_rows(feed: DataFrame, column: str = "payload") -> DataFrame:
    """Feed JSON -> articles, with fallbacks; untitled or undatable rows go."""
    schema = ("STRUCT<title: STRING, summary: STRING, description: STRING, pubDate: STRING, displayTime: STRING, "
              "provider: STRUCT<displayName: STRING>, canonicalUrl: STRUCT<url: STRING>>")
    rows = feed.select("ticker", F.from_json(column, schema).alias("a"))

    def some(*names):
        return F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names])

    return rows.select(
        "ticker", F.coalesce("a.title", F.lit("")).alias("title"),
        F.coalesce(some("a.summary", "a.description"), F.lit("")).alias("summary"),
        F.try_to_timestamp(some("a.pubDate", "a.displayTime")).alias("published"),
        F.coalesce("a.provider.displayName", F.lit("")).alias("source"),
        F.coalesce("a.canonicalUrl.url", F.lit("")).alias("url"), F.lit("news").alias("kind"),
    ).where("published IS NOT NULL AND title <> ''")


def filing_articles(filings: DataFrame, now: str, days: int = 14) -> DataFrame:
    """Recent 8-K items as text rows."""
    def plain(c):
        return F.lower(F.replace(F.col(c), F.lit("_"), F.lit(" ")))

    recent = filings.where(F.col("filing_date") >= F.date_sub(F.lit(now).cast("date"), days))
    return item_rows(recent).select(
        "ticker", F.concat(F.col("ticker"), F.lit(" filed an 8-K reporting "), plain("event_type")).alias("title"),
        F.concat(F.lit("SEC Form 8-K, item "), F.col("code"), F.lit(" ("), plain("event_subtype"), F.lit(").")).alias("summary"),
        F.coalesce("acceptance_datetime", F.col("filing_date").cast("timestamp")).alias("published"),
        F.lit("SEC EDGAR").alias("source"), F.lit("").alias("url"), F.lit("filing").alias("kind"))


def age_hours(published: Column, now: str) -> Column:
    return (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(published)) / 3.6e9


def weighted(articles: DataFrame, now: str) -> DataFrame:
    """Polarity and weight = credibility x recency x conviction of each article."""
    recency = F.pow(F.lit(0.5), F.greatest(age_hours(F.col("published"), now), F.lit(0.0)) / vocab.NEWS_HALF_LIFE_HOURS)
    conviction = F.greatest(1 - F.col("neutral"), F.lit(0.05))
    return articles.withColumns({
        "polarity": F.col("positive") - F.col("negative"),
        "weight": source_tier("source") * recency * conviction,
    })


def ticker_sentiment(articles: DataFrame, now: str) -> DataFrame:
    """One row per ticker.  ``articles`` needs a unique ``doc_id`` as tie-break.

    Only the strongest article of a source counts as evidence; that choice is an aggregate, so a
    source with very many articles is combined before it is shuffled.
    """
    rows = weighted(articles, now)
    source = F.coalesce(F.nullif(F.lower(F.trim("source")), F.lit("")), F.lit("unknown"))
    best = rows.groupBy("ticker", source.alias("voice")).agg(
        F.max_by(F.struct("polarity", "weight"), F.struct("weight", -F.col("doc_id"))).alias("b"),
        F.count("*").alias("n"), F.max("published").alias("newest"))
    per = best.groupBy("ticker").agg(
        F.sum("n").alias("article_count"), F.count("*").alias("sources"), F.max("newest").alias("newest"),
        F.sum(F.col("b.weight") * F.col("b.polarity")).alias("ws"), F.sum("b.weight").alias("w"),
        F.var_pop("b.polarity").alias("spread"))
    rank = Window.partitionBy("ticker").orderBy(F.desc("weight"), "doc_id")
    top = rows.withColumn("k", F.row_number().over(rank)).where(F.col("k") <= vocab.TOP_HEADLINES).groupBy("ticker").agg(
        F.sort_array(F.collect_list(F.struct(
            "k", F.substring("title", 1, 200).alias("title"), F.coalesce(F.nullif("source", F.lit("")), F.lit("unknown")).alias("source"),
            "published", F.round("polarity", 3).alias("polarity")))).alias("top_headlines"))
    confidence = (1 / (1 + F.col("spread"))) * (1 - F.exp(-F.col("w")))
    return per.join(top, "ticker").select(
        "ticker", "article_count", "sources", F.coalesce(ratio("ws", "w"), F.lit(0.0)).alias("score"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence)).alias("confidence"),
        F.round(age_hours(F.col("newest"), now), 2).alias("newest_age_hours"), "top_headlines")


def availability(universe: DataFrame, sentiment: DataFrame) -> DataFrame:
    """Every ticker of the universe with its sentiment, or the reason why there is none."""
    out = universe.select("ticker").join(sentiment, "ticker", "left")
    stale = F.col("newest_age_hours").isNull() | (F.col("newest_age_hours") > vocab.STALE_NEWS_HOURS)
    none = F.col("article_count").isNull()
    reason = F.when(none, "no articles from any source").when(stale, "no recent articles; the feed may be broken")
    return out.withColumns({"stale": stale, "available": ~stale, "reason": reason,
                            "article_count": F.coalesce("article_count", F.lit(0))})


def recent_moves(bars: DataFrame) -> DataFrame:
    """Last 5-bar return and its scale per ticker; NULL for histories below 25 bars."""
    w = Window.partitionBy("ticker").orderBy("date")
    rows = bars.select("ticker", "date", "close", growth("close", F.lag("close").over(w)).alias("ret"),
                       growth("close", F.lag("close", 5).over(w)).alias("ret_5"), F.row_number().over(w).alias("no"))
    twenty = w.rowsBetween(-19, 0)
    rows = rows.withColumn("vol", F.when(F.count("ret").over(twenty) >= 20, F.stddev_samp("ret").over(twenty) * F.sqrt(F.lit(5.0))))
    return rows.groupBy("ticker").agg(F.max_by(F.struct("ret_5", "vol", "no"), "date").alias("r")).select(
        "ticker", F.when(F.col("r.no") >= 25, F.col("r.ret_5")).alias("recent_return"),
        F.when(F.col("r.no") >= 25, F.col("r.vol")).alias("vol"))


def divergence(sentiment: DataFrame, moves: DataFrame) -> DataFrame:
    """Flags where news and price disagree, with the move in volatility units."""
    rows = sentiment.join(moves, "ticker", "left")
    s, sigmas = F.col("score"), F.try_divide("recent_return", "vol")
    usable = F.col("available") & F.col("recent_return").isNotNull() & (F.col("vol") > 0)
    flag = ((s <= -0.25) & (sigmas >= 0.5)) | ((s >= 0.25) & (sigmas <= -0.5))
    reason = F.when(~F.col("available"), "needs a sentiment score").when(~F.coalesce(usable, F.lit(False)), "insufficient price history")
    text = F.when(~flag, "sentiment and price action broadly agree").when(s < 0, "negative news, price holding up").otherwise(
        "positive news, price falling")
    ok = F.coalesce(usable, F.lit(False))
    return rows.select("ticker", ok.alias("available"), reason.alias("reason"), F.when(ok, flag).alias("divergence_flag"),
                       F.when(ok, sigmas).alias("recent_move_sigmas"), F.when(ok, text).alias("interpretation"))
