"""Sentiment and nearest neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelyard import vocab
from panelyard.catalog.base import big, query, s6, step
from panelyard.catalog.timeline import AS_OF
from panelyard.functions.numeric import settle
from panelyard.functions.text import source_tier, text_key
from panelyard.operators.neighbours import nearest
from panelyard.plans import sentiment
from panelyard.plans.analogs import find_analogs, moments
from panelyard.plans.panel import build_dataset
from panelyard.session import stored

NOW = "2001-11-04 12:00:00"
_tier = "CASE lower(trim(source)) " + " ".join(
    f"""WHEN '{k.replace("'", "''")}' THEN CAST({v} AS DOUBLE)""" for k, v in vocab.SOURCE_TIERS.items()) + " ELSE CAST(0.3 AS DOUBLE) END"
_age = f"(epoch_us(TIMESTAMP '{NOW}') - epoch_us(published)) / 3.6e9"
step("art_w", f"""
SELECT *, positive - negative AS polarity, {_tier} * pow(CAST(0.5 AS DOUBLE), greatest({_age}, 0) / 8.0) * greatest(1 - neutral, CAST(0.05 AS DOUBLE)) AS weight,
       coalesce(nullif(lower(trim(source)), ''), 'unknown') AS voice FROM articles
""")
step("art_best", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker, voice ORDER BY weight DESC, doc_id) AS k FROM art_w) WHERE k = 1
""")
step("sent_log", f"""
SELECT b.ticker, n AS article_count, count(*) AS sources, sum(weight * polarity) / sum(weight) AS score,
       greatest(0, least(1, (1 / (1 + var_pop(polarity))) * (1 - exp(-sum(weight))))) AS confidence, {_age.replace('published', 'any_value(newest)')} AS age
FROM art_best b JOIN (SELECT ticker, count(*) AS n, max(published) AS newest FROM articles GROUP BY ticker) a ON a.ticker = b.ticker GROUP BY b.ticker, n
""")


@query("sent_polarity", f"SELECT doc_id, {s6('positive - negative')} AS polarity, {s6('1 - neutral')} AS confidence FROM articles")
def sent_polarity(t):
    """Polarity and conviction of each article."""
    return t.articles.select("doc_id", settle(F.col("positive") - F.col("negative")).alias("polarity"),
                             settle(1 - F.col("neutral")).alias("confidence"))


@query("sent_cred", f"SELECT doc_id, {_tier} AS credibility FROM articles")
def sent_cred(t):
    """Credibility tier of each article's source."""
    return t.articles.select("doc_id", source_tier("source").alias("credibility"))


@query("sent_recency", f"SELECT doc_id, {s6(f'pow(CAST(0.5 AS DOUBLE), greatest({_age}, 0) / 8.0)', 9)} AS recency FROM articles")
def sent_recency(t):
    """Recency weight of each article."""
    age = sentiment.age_hours(F.col("published"), NOW)
    return t.articles.select("doc_id", settle(F.pow(F.lit(0.5), F.greatest(age, F.lit(0.0)) / 8.0), 9).alias("recency"))


@query("sent_hash", "SELECT doc_id, substr(sha1(lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g'))), 1, 20) AS text_hash FROM documents")
def sent_hash(t):
    """Cache key of every text."""
    return t.base("documents").select("doc_id", text_key("text").alias("text_hash"))


@query("ag_sentiment", f"SELECT ticker, {big('article_count')} AS article_count, {big('sources')} AS sources, {s6('score')} AS score, {s6('confidence')} AS confidence FROM sent_log")
def ag_sentiment(t):
    """Sentiment per ticker from the strongest article of each source."""
    out = sentiment.ticker_sentiment(t.articles, NOW)
    return out.select("ticker", "article_count", "sources", settle("score").alias("score"), settle("confidence").alias("confidence"))


@query("ag_stale", f"""
SELECT u.ticker, {big('coalesce(article_count, 0)')} AS article_count, coalesce(age > 48, true) AS stale,
       CASE WHEN article_count IS NULL THEN 'no articles from any source' WHEN age > 48 THEN 'no recent articles; the feed may be broken' END AS reason
FROM universe u LEFT JOIN sent_log s ON s.ticker = u.ticker
""")
def ag_stale(t):
    """Availability of sentiment per ticker."""
    out = sentiment.availability(t.universe, sentiment.ticker_sentiment(t.articles, NOW))
    return out.select("ticker", "article_count", "stale", "reason")


step("moves_log", """
WITH r AS (SELECT ticker, date, close, close / lag(close) OVER w - 1 AS ret, close / lag(close, 5) OVER w - 1 AS ret_5, row_number() OVER w AS no
           FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)),
v AS (SELECT *, stddev_samp(ret) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) * sqrt(5) AS vol FROM r)
SELECT ticker, max_by(ret_5, date) AS ret_5, max_by(vol, date) AS vol FROM v GROUP BY ticker
""")


@query("diverge", f"""
WITH x AS (SELECT u.ticker, s.score, coalesce(age <= 48, false) AS ok, ret_5 / vol AS sg FROM universe u LEFT JOIN sent_log s ON s.ticker = u.ticker LEFT JOIN moves_log m ON m.ticker = u.ticker)
SELECT ticker, ok AS available, CASE WHEN ok THEN (score <= -0.25 AND sg >= 0.5) OR (score >= 0.25 AND sg <= -0.5) END AS divergence_flag,
       CASE WHEN ok THEN {s6('sg')} END AS recent_move_sigmas FROM x
""")
def diverge(t):
    """Does the price disagree with the news?"""
    news = sentiment.availability(t.universe, sentiment.ticker_sentiment(t.articles, NOW))
    out = sentiment.divergence(news, sentiment.recent_moves(t.bars))
    return out.select("ticker", "available", "divergence_flag", settle("recent_move_sigmas").alias("recent_move_sigmas"))


@query("j_cache_anti", f"""
WITH k AS (SELECT doc_id, lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS plain FROM documents),
d AS (SELECT DISTINCT substr(sha1(plain), 1, 20) AS text_hash, length(plain) AS n FROM k),
c AS (SELECT DISTINCT substr(sha1(plain), 1, 20) AS text_hash FROM k WHERE doc_id IN (SELECT doc_id FROM labels))
SELECT d.text_hash, CASE WHEN c.text_hash IS NULL THEN CAST(1 AS DOUBLE) / (1 + n % 7) ELSE CAST(0.5 AS DOUBLE) END AS positive
FROM d LEFT JOIN c ON c.text_hash = d.text_hash
""")
def j_cache_anti(t):
    """Only texts that the cache lacks are scored; labelled documents are the cached ones here."""
    docs = t.base("documents").select("doc_id", "text")
    cache = docs.join(t.base("labels").select("doc_id"), "doc_id", "left_semi").select(text_key("text").alias("text_hash")).distinct().withColumns(
        {"positive": F.lit(0.5), "negative": F.lit(0.25), "neutral": F.lit(0.25)})

    def scorer(df):
        size = F.length(F.regexp_replace("text", "^\\s+|\\s+$", ""))
        return df.withColumns({"positive": F.lit(1.0) / (1 + size % 7), "negative": F.lit(0.0), "neutral": F.lit(0.0)})

    return sentiment.score_missing(docs, cache, scorer).select("text_hash", "positive")


_words = ["the", "of", "que", "le"], ["aux", "de", "to", "la"]


def _hits(words):
    names = ", ".join(f"'{w}'" for w in words)
    return f"CAST(len(list_filter(regexp_extract_all(lower(text), '\\p{{L}}+'), lambda w: w IN ({names}))) AS DOUBLE)"


_g, _b = (_hits(w) for w in _words)
_shares = [("positive", "g / (g + b + 1)"), ("negative", "b / (g + b + 1)"), ("neutral", "1 / (g + b + 1)")]


@query("udf_scorer", f"SELECT doc_id, {', '.join(f'{s6(x)} AS {p}{n}' for p in ('', 'sql_') for n, x in _shares)} FROM (SELECT doc_id, {_g} AS g, {_b} AS b FROM documents)")
def udf_scorer(t):
    """Whole documents through the pluggable batch scorer beside the SQL word scorer."""
    good, bad = _words

    def factory():
        import re

        cut = re.compile(r"[^\W\d_]+")

        def score(texts):
            out = []
            for text in texts:
                words = cut.findall(text.lower())
                g, b = sum(w in good for w in words), sum(w in bad for w in words)
                out.append((g / (g + b + 1), b / (g + b + 1), 1 / (g + b + 1)))
            return out

        return score

    docs = t.base("documents").select("doc_id", "text")
    sql = {f"sql_{k}": c for k, c in sentiment.word_scores(F.col("text"), good, bad).items()}
    both = sentiment.model_scores(docs, factory).withColumns(sql).drop("text")
    return both.select("doc_id", *[settle(c).alias(c) for c in both.columns if c != "doc_id"])


_mom = ["ret_5", "vol_20", "vix"]


@query("ag_fit_moments", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {s6(f'avg(coalesce({c}, 0))')} AS centre, {s6(f'coalesce(nullif(stddev_pop(coalesce({c}, 0)), 0), 1)')} AS spread FROM feat_price" for c in _mom))
def ag_fit_moments(t):
    """Mean and population deviation per feature in one aggregate."""
    from panelyard.catalog.windows import features_of

    one = moments(features_of(t), _mom)
    names = F.array(*[F.lit(c) for c in _mom])
    return one.select(F.inline(F.arrays_zip(names.alias("feature"), F.col("centre"), F.col("spread")))).toDF("feature", "centre", "spread").select(
        "feature", settle("centre").alias("centre"), settle("spread").alias("spread"))


_af = list(vocab.ANALOG_FEATURES)
step("ana_index", "SELECT f.ticker, f.date, " + ", ".join(f"coalesce(f.{c}, 0) AS {c}" for c in _af) +
     ", l.forward_return_5d, l.label_direction_5d FROM feat_all f JOIN lab l ON l.ticker = f.ticker AND l.date = f.date WHERE l.label_direction_5d IS NOT NULL")
step("ana_last", "SELECT ticker, date, " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in _af) +
     " FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS kk FROM feat_all) WHERE kk = 1")
step("ana_mom", "SELECT " + ", ".join(f"coalesce(nullif(stddev_pop({c}), 0), 1) AS s_{c}" for c in _af) + " FROM ana_index")
step("ana_rank", "SELECT q.ticker, h.ticker AS match_ticker, h.date AS match_date, sqrt(" + " + ".join(
    f"pow((h.{c} - q.{c}) / s_{c}, 2)" for c in _af) + """) AS distance, h.forward_return_5d, h.label_direction_5d
FROM ana_last q JOIN ana_index h ON h.date < q.date AND h.ticker <> q.ticker, ana_mom
QUALIFY row_number() OVER (PARTITION BY q.ticker ORDER BY distance, h.ticker, h.date) <= 5""")


@query("tk_analogs", f"""
SELECT ticker, match_ticker, match_date, {s6('distance', 3)} AS distance, {s6('forward_return_5d')} AS forward_return_5d,
       CASE label_direction_5d WHEN 0 THEN 'DROP' WHEN 1 THEN 'NEUTRAL' ELSE 'SPIKE' END AS outcome_5d FROM ana_rank
""")
def tk_analogs(t):
    """Five nearest earlier situations of other tickers for every ticker's last row."""
    panel = stored(build_dataset(t, as_of=AS_OF).select("ticker", "date", *_af, "forward_return_5d", "forward_return_20d", "label_direction_5d"), "dataset")
    out = find_analogs(panel)
    return out.select("ticker", "match_ticker", "match_date", settle("distance", 3).alias("distance"),
                      settle("forward_return_5d").alias("forward_return_5d"), "outcome_5d")


@query("j_analog_cross", f"""
WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)
SELECT a.vec_id, b.vec_id AS match_id, {s6('list_distance(a.v, b.v)')} AS distance FROM e a JOIN e b ON a.label <> b.label
QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), CAST(b.vec_id AS VARCHAR)) <= 3
""")
def j_analog_cross(t):
    """Three nearest vectors of another label for every vector."""
    rows = t.base("embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("label").cast("string").alias("owner"),
                                       F.lit(0).alias("day"), F.col("embedding").cast("array<double>").alias("vec"))
    asked = rows.withColumnRenamed("id", "query_id").withColumn("day", F.lit(None).cast("int"))
    out = nearest(rows, asked, 3)
    return out.select(F.col("query_id").cast("bigint").alias("vec_id"), F.col("id").cast("bigint").alias("match_id"), settle("distance").alias("distance"))
