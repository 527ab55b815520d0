"""The panel-shaped tables as plain SQL, for checks on another engine."""

VIEWS = {
    "bars": """
WITH px AS (
  SELECT p.p_brand AS ticker, CAST(l.l_shipdate AS DATE) AS date, l.l_quantity AS qty,
         l.l_extendedprice / l.l_quantity AS price,
         row_number() OVER (PARTITION BY p.p_brand, CAST(l.l_shipdate AS DATE)
           ORDER BY l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice) AS seq
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey WHERE l.l_quantity > 0)
SELECT ticker, date, min_by(price, seq) AS open, max(price) AS high, min(price) AS low,
       max_by(price, seq) AS close, sum(qty) AS volume
FROM px GROUP BY ticker, date
""",
    "universe": """
SELECT DISTINCT p_brand AS ticker, concat('Company ', substr(p_brand, 7)) AS name,
       concat('Sector ', CAST(substr(p_brand, 7) AS INT) % 5) AS sector,
       make_date(1994 + CAST(substr(p_brand, 7) AS INT) % 4, 1, 15) AS date_added,
       CAST(substr(p_brand, 7) AS INT) AS cik,
       concat('XL', CAST(substr(p_brand, 7) AS INT) % 5) AS sector_etf
FROM part
""",
    "sector_bars": """
SELECT u.sector_etf, b.date, avg(b.close) AS close
FROM bars b JOIN universe u ON b.ticker = u.ticker GROUP BY u.sector_etf, b.date
""",
    "benchmark_bars": """
SELECT date, avg(close) AS close FROM bars GROUP BY date
""",
    "macro": """
SELECT CAST(o_orderdate AS DATE) AS date,
       10 + 40 * avg(CASE WHEN o_orderpriority = '1-URGENT' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS vix,
       2 - 8 * avg(CASE WHEN o_orderpriority = '5-LOW' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS curve_slope
FROM orders GROUP BY CAST(o_orderdate AS DATE)
""",
    "index_changes": """
SELECT make_date(1996 + n_nationkey % 5, 1 + n_nationkey % 12, 15) AS date,
       concat('Brand#', 1 + n_nationkey) AS added_ticker, concat('Company ', 1 + n_nationkey) AS added_name,
       CASE WHEN n_nationkey % 6 = 5 THEN concat('Brand#', 1 + (n_nationkey + 7) % 25) ELSE concat('Old#', n_nationkey) END AS removed_ticker,
       CAST(NULL AS VARCHAR(10)) AS removed_name,
       CASE WHEN n_nationkey % 2 = 0 THEN 'Acquired by another company.' ELSE 'Market capitalization changes.' END AS reason
FROM nation
""",
    "filings": """
SELECT 1 + o_custkey % 25 AS cik, concat('Brand#', 1 + o_custkey % 25) AS ticker,
       CASE WHEN o_orderkey % 25 = 1 THEN '10-K' WHEN o_orderkey % 5 = 0 THEN '10-Q' ELSE '8-K' END AS form,
       CAST(o_orderdate AS DATE) AS filing_date,
       CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderdate + INTERVAL '1' HOUR * (o_orderkey % 24) END AS acceptance_datetime,
       CASE o_orderkey % 8 WHEN 0 THEN '2.02,9.01' WHEN 1 THEN '5.02' WHEN 2 THEN '1.01, 2.03,9.01' WHEN 3 THEN '12,7'
            WHEN 4 THEN '8.01,7.01' WHEN 5 THEN '4.02' WHEN 6 THEN '99.99' ELSE NULL END AS items,
       concat('A-', o_orderkey) AS accession
FROM orders
""",
    "dividends": """
SELECT p.p_brand AS ticker, CAST(min(l.l_shipdate) AS DATE) AS ex_date,
       CAST(25 + count(*) % 40 AS DOUBLE) / 100 AS dividend
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
GROUP BY p.p_brand, extract(year FROM l.l_shipdate), extract(quarter FROM l.l_shipdate)
HAVING (CAST(substr(p.p_brand, 7) AS INT) + 4 * extract(year FROM l.l_shipdate) + extract(quarter FROM l.l_shipdate)) % 11 > 2
""",
    "facts": """
WITH q AS (
  SELECT p.p_brand AS ticker, CAST(date_trunc('quarter', l.l_shipdate) AS DATE) AS period_start,
         sum(l.l_extendedprice) AS revenue, sum(l.l_extendedprice * (1 - l.l_discount)) AS gross,
         sum(l.l_extendedprice * (0.3 - l.l_discount - l.l_tax)) AS net, CAST(count(*) AS DOUBLE) AS n
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey GROUP BY p.p_brand, CAST(date_trunc('quarter', l.l_shipdate) AS DATE)),
d AS (SELECT *, CAST(period_start + INTERVAL '3' MONTH - INTERVAL '1' DAY AS DATE) AS period_end FROM q),
f AS (SELECT *, CAST(period_end + INTERVAL '1' DAY * (20 + CAST(substr(ticker, 7) AS INT)) AS DATE) AS filed FROM d)
SELECT ticker, 'Revenues' AS concept, period_start, period_end, revenue AS val, filed, '10-Q' AS form FROM f
UNION ALL SELECT ticker, 'GrossProfit', period_start, period_end, gross, filed, '10-Q' FROM f
UNION ALL SELECT ticker, 'NetIncomeLoss', period_start, period_end, net, filed, '10-Q' FROM f
UNION ALL SELECT ticker, 'Liabilities', NULL, period_end, 3 * n, filed, '10-Q' FROM f
UNION ALL SELECT ticker, 'StockholdersEquity', NULL, period_end, 1 + n, filed, '10-Q' FROM f
""",
    "articles": """
SELECT concat('Brand#', 1 + doc_id % 25) AS ticker, doc_id, regexp_extract(text, '^[^.\n]*') AS title, substr(text, length(regexp_extract(text, '^[^.\n]*')) + 1) AS summary,
       TIMESTAMP '2001-11-04 00:00:00' - INTERVAL '1' HOUR * (doc_id % 240) AS published,
       CASE doc_id % 6 WHEN 0 THEN 'Reuters' WHEN 1 THEN 'SEC EDGAR' WHEN 2 THEN 'cnbc ' WHEN 3 THEN 'Zacks' WHEN 4 THEN 'MarketWatch' ELSE source END AS source,
       CAST(n_chars % 61 AS DOUBLE) / 100 AS positive, CAST(n_chars % 37 AS DOUBLE) / 100 AS negative,
       1 - CAST(n_chars % 61 AS DOUBLE) / 100 - CAST(n_chars % 37 AS DOUBLE) / 100 AS neutral
FROM documents
""",
    "oof": """
SELECT ticker, date, extract(year FROM date) - 1995 AS fold,
       CASE WHEN lead(close, 1) OVER (PARTITION BY ticker ORDER BY date) IS NULL THEN NULL
            WHEN abs(lead(close, 1) OVER (PARTITION BY ticker ORDER BY date) / close - 1) >= 0.25 THEN 1 ELSE 0 END AS y,
       CAST(20 + (CAST(volume AS BIGINT) * 7 + extract(doy FROM date)) % 60 AS DOUBLE) / 100 AS p_candidate,
       CAST(20 + (CAST(volume AS BIGINT) * 3 + extract(doy FROM date)) % 60 AS DOUBLE) / 100 AS p_incumbent
FROM bars
""",
    "predictions": """
SELECT concat(ticker, '|', date) AS prediction_id, ticker, date AS as_of, 'magnitude_1d' AS target, 'magnitude' AS kind,
       1 AS horizon_days, CAST(1 AS DOUBLE) AS threshold_sigmas, CAST(25 AS DOUBLE) / 100 AS label_scale, close AS last_close,
       p_candidate AS p_large_move, CASE WHEN p_candidate >= CAST(50 AS DOUBLE) / 100 THEN 'LARGE_MOVE' ELSE 'QUIET' END AS predicted_class,
       CASE WHEN extract(year FROM date) < 1999 THEN 'fp_a' ELSE 'fp_b' END AS model_fingerprint
FROM (SELECT b.ticker, b.date, b.close, o.p_candidate FROM bars b JOIN oof o ON b.ticker = o.ticker AND b.date = o.date) x
""",
}
