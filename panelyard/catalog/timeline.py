"""Events, facts, membership and as-of operators, and the panel built from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelyard import vocab
from panelyard.catalog.base import big, query, s6, step
from panelyard.catalog.windows import features_of
from panelyard.functions.calendar import effective_date
from panelyard.functions.numeric import finite, settle
from panelyard.functions.regimes import named_regime, recession, similar_regimes, volatility_state
from panelyard.functions.rolling import Trailing
from panelyard.functions.text import event_key, item_codes, looks_delisted
from panelyard.operators.asof import as_of, timeline
from panelyard.operators.intervals import members_only, membership_spells, removed_names
from panelyard.plans import coverage
from panelyard.plans.events import (
    all_events, classify_item, dividend_events, event_vocabulary, events_by_day, filing_events, item_rows,
)
from panelyard.plans.features import build_features, event_columns, with_context
from panelyard.plans.fundamentals import first_reported, fundamentals, fundamentals_by_day
from panelyard.plans.panel import all_features, build_dataset, build_panel, latest_rows, panel_identity, target_rows
from panelyard.plans.labels import label_names

AS_OF = "2002-03-31"  # day up to which the shared payment table is known

# ---------------------------------------------------------------- SQL steps
_codes = ", ".join(f"('{c}', '{t}', '{s}')" for c, (t, s) in {**vocab.MODERN_ITEMS, **vocab.LEGACY_ITEMS}.items())
step("taxonomy", f"SELECT * FROM (VALUES {_codes}) AS t(code, kind, sub)")
step("filed_eff", """
SELECT *, CASE WHEN hour((acceptance_datetime AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York') >= 16
            THEN CAST(filing_date + INTERVAL '1' DAY * (CASE dayofweek(filing_date) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END) AS DATE)
            ELSE filing_date END AS event_date
FROM filings
""")
step("item_list", """
SELECT ticker, accession, form, filing_date, acceptance_datetime, event_date, trim(raw) AS code, CAST(pos - 1 AS INTEGER) AS item_pos
FROM (SELECT *, unnest(string_split(items, ',')) AS raw, unnest(range(1, len(string_split(items, ',')) + 1)) AS pos
      FROM filed_eff WHERE items IS NOT NULL AND form = '8-K')
WHERE trim(raw) NOT IN ('', '9.01', '7')
""")
step("filing_log", """
SELECT event_id, ticker, event_date, event_type, event_subtype, source, confidence FROM (
  SELECT *, substr(sha1(ticker || '|' || CAST(event_date AS VARCHAR) || '|' || event_type || '|' || accession), 1, 16) AS event_id,
         row_number() OVER (PARTITION BY ticker, event_date, event_type, accession ORDER BY item_pos) AS k FROM (
    SELECT i.ticker, i.accession, i.event_date, coalesce(x.kind, 'UNCLASSIFIED_8K') AS event_type, coalesce(x.sub, i.code) AS event_subtype,
           '8-K:' || i.code AS source, CAST(1 AS DOUBLE) AS confidence, item_pos
    FROM item_list i LEFT JOIN taxonomy x ON x.code = i.code
    UNION ALL
    SELECT ticker, accession, event_date, 'PERIODIC_REPORT', CASE form WHEN '10-K' THEN 'ANNUAL' ELSE 'QUARTERLY' END, form,
           CAST(0.9 AS DOUBLE), 0 FROM filed_eff WHERE form IN ('10-K', '10-Q'))) WHERE k = 1
""")
step("div_seq", """
SELECT *, lag(dividend) OVER w AS prev, lag(ex_date) OVER w AS prev_date, lead(ex_date) OVER w AS next_date
FROM dividends WHERE dividend > 0 WINDOW w AS (PARTITION BY ticker ORDER BY ex_date)
""")
step("div_gap", """
SELECT d.*, date_diff('day', prev_date, ex_date) AS gap, g.step FROM div_seq d JOIN (
  SELECT ticker, CASE WHEN count(prev_date) >= 3 THEN quantile_cont(CAST(date_diff('day', prev_date, ex_date) AS DOUBLE), 0.5)
         ELSE 91.0 END AS step FROM div_seq GROUP BY ticker) g ON g.ticker = d.ticker
""")
step("div_log", f"""
SELECT ticker, ex_date AS event_date,
       CASE WHEN prev IS NULL OR gap > step * 2.5 THEN 'DIVIDEND_INITIATE' WHEN dividend > prev * (1 + CAST(0.01 AS DOUBLE)) THEN 'DIVIDEND_RAISE'
            ELSE 'DIVIDEND_CUT' END AS event_type,
       CASE WHEN prev IS NULL THEN 'first payment' WHEN gap > step * 2.5 THEN 'resumed'
            ELSE printf('%.1f%%', (dividend / prev - 1) * 100) END AS event_subtype, 'dividends' AS source, CAST(0.9 AS DOUBLE) AS confidence
FROM div_gap WHERE prev IS NULL OR gap > step * 2.5 OR dividend > prev * (1 + CAST(0.01 AS DOUBLE)) OR dividend < prev * (1 - CAST(0.01 AS DOUBLE))
UNION ALL
SELECT ticker, CAST(prev_date + INTERVAL '1' DAY * CAST(round_even(step * 1.5, 0) AS INTEGER) AS DATE), 'DIVIDEND_SUSPEND', 'missed expected payment',
       'dividends', CAST(0.7 AS DOUBLE) FROM div_gap WHERE gap > step * 2.5
UNION ALL
SELECT ticker, CAST(ex_date + INTERVAL '1' DAY * CAST(round_even(step * 1.5, 0) AS INTEGER) AS DATE), 'DIVIDEND_SUSPEND', 'payments stopped',
       'dividends', CAST(0.7 AS DOUBLE) FROM div_gap
WHERE next_date IS NULL AND ex_date + INTERVAL '1' DAY * CAST(round_even(step * 1.5, 0) AS INTEGER) <= DATE '{AS_OF}'
""")
step("event_log", """
SELECT event_id, ticker, event_date, event_type, event_subtype, source, confidence FROM filing_log
UNION ALL SELECT NULL, ticker, event_date, event_type, event_subtype, source, confidence FROM div_log
""")


def _since(kind, i):
    where = "" if kind == "any_event" else f"WHERE event_type = '{kind.upper()}'"
    return f"ASOF LEFT JOIN (SELECT DISTINCT ticker, event_date FROM event_log {where}) e{i} ON b.ticker = e{i}.ticker AND b.date >= e{i}.event_date"


_kinds = [k.lower() for k in vocab.TRACKED_EVENTS] + ["any_event"]
step("since_log", "SELECT b.ticker, b.date, " + ", ".join(
    f"coalesce(CAST(date_diff('day', e{i}.event_date, b.date) AS DOUBLE), CAST(9999 AS DOUBLE)) AS days_since_{k}"
    for i, k in enumerate(_kinds)) + " FROM bars b " + " ".join(_since(k, i) for i, k in enumerate(_kinds)))
step("density_log", """
SELECT b.ticker, b.date,
       CAST(count(CASE WHEN e.event_date > b.date - INTERVAL '90' DAY THEN 1 END) AS DOUBLE) AS event_density_90d,
       CAST(count(CASE WHEN e.event_type = 'DIVIDEND_CUT' THEN 1 END) AS DOUBLE) AS dividend_cuts_365d
FROM bars b LEFT JOIN event_log e ON e.ticker = b.ticker AND e.event_date <= b.date AND e.event_date > b.date - INTERVAL '365' DAY
GROUP BY b.ticker, b.date
""")
step("first_facts", """
SELECT ticker, concept, period_end, val, filed FROM (
  SELECT *, row_number() OVER (PARTITION BY ticker, concept, period_end ORDER BY filed, val) AS k FROM facts
  WHERE filed IS NOT NULL AND form IN ('10-K', '10-Q') AND (concept NOT IN ('Revenues', 'GrossProfit', 'NetIncomeLoss')
        OR date_diff('day', period_start, period_end) BETWEEN 80 AND 100)) WHERE k = 1
""")
step("fund_wide", """
SELECT ticker, period_end, max(filed) AS filed, max(CASE WHEN concept = 'Revenues' THEN val END) AS rev,
       max(CASE WHEN concept = 'GrossProfit' THEN val END) AS gp, max(CASE WHEN concept = 'NetIncomeLoss' THEN val END) AS ni,
       max(CASE WHEN concept = 'Liabilities' THEN val END) AS li, max(CASE WHEN concept = 'StockholdersEquity' THEN val END) AS eq
FROM first_facts GROUP BY ticker, period_end
""")
step("fund_seq", """
SELECT *, rev_pad / lag(rev_pad, 4) OVER w - 1 AS growth, coalesce(CASE WHEN ni < lag(ni) OVER w THEN 1 END, 0) AS falling,
       row_number() OVER w AS k
FROM (SELECT *, last_value(rev IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY period_end) AS rev_pad FROM fund_wide)
WINDOW w AS (PARTITION BY ticker ORDER BY period_end)
""")
step("fund_log", """
SELECT ticker, period_end, filed, growth AS revenue_growth_yoy, gp / nullif(rev, 0) AS gross_margin, ni / nullif(rev, 0) AS net_margin,
       li / nullif(eq, 0) AS debt_to_equity, CAST(NULL AS DOUBLE) AS current_ratio,
       CAST(k - coalesce(max(CASE WHEN falling = 0 THEN k END) OVER (PARTITION BY ticker ORDER BY period_end), 0) AS DOUBLE) AS earnings_surprise_streak
FROM fund_seq
""")
_funds = list(vocab.FUNDAMENTALS)
step("fund_asof", "SELECT b.ticker, b.date, " + ", ".join(f"f{i}.{c}" for i, c in enumerate(_funds)) + " FROM bars b " + " ".join(
    f"ASOF LEFT JOIN (SELECT ticker, filed, max_by({c}, period_end) AS {c} FROM fund_log WHERE {c} IS NOT NULL GROUP BY ticker, filed) f{i} "
    f"ON f{i}.ticker = b.ticker AND b.date >= f{i}.filed" for i, c in enumerate(_funds)))
step("chg_steps", """
SELECT DISTINCT ticker, d, kind FROM (
  SELECT added_ticker AS ticker, date AS d, 1 AS kind FROM index_changes WHERE added_ticker IS NOT NULL
  UNION ALL SELECT removed_ticker, date, 0 FROM index_changes WHERE removed_ticker IS NOT NULL)
""")
step("chg_walk", """
SELECT s.ticker, s.d, s.kind, lag(s.kind) OVER w AS pk, lag(s.d) OVER w AS pd, u.ticker IS NOT NULL AS listed,
       lead(s.kind) OVER w IS NULL AS is_last, u.date_added
FROM chg_steps s LEFT JOIN universe u ON u.ticker = s.ticker WINDOW w AS (PARTITION BY s.ticker ORDER BY s.d DESC, s.kind DESC)
""")
step("spell_log", """
SELECT ticker, d AS start, CASE WHEN pk = 0 THEN pd END AS "end" FROM chg_walk WHERE pk = 0 OR (pk IS NULL AND listed)
UNION ALL
SELECT ticker, CASE WHEN date_added IS NULL OR date_added >= d THEN DATE '0001-01-01' ELSE date_added END, d FROM chg_walk WHERE is_last AND kind = 0
UNION ALL
SELECT ticker, date_added, NULL FROM universe WHERE ticker NOT IN (SELECT ticker FROM chg_steps)
""")
_feat_cols = list(vocab.FEATURES)
step("feat_all", """
SELECT p.*, s.* EXCLUDE (ticker, date), d.* EXCLUDE (ticker, date), f.* EXCLUDE (ticker, date)
FROM feat_price p JOIN since_log s ON s.ticker = p.ticker AND s.date = p.date
JOIN density_log d ON d.ticker = p.ticker AND d.date = p.date JOIN fund_asof f ON f.ticker = p.ticker AND f.date = p.date
""")
step("panel_log", """
SELECT x.*, l.* EXCLUDE (ticker, date) FROM feat_all x JOIN lab l ON l.ticker = x.ticker AND l.date = x.date
WHERE EXISTS (SELECT 1 FROM spell_log s WHERE s.ticker = x.ticker AND x.date >= s.start AND (s."end" IS NULL OR x.date < s."end"))
""")


def events_of(t):
    return all_events(t.filings, t.dividends, AS_OF)


def full_features(t):
    return all_features(t, AS_OF)


def spells_of(t):
    return membership_spells(t.universe, t.index_changes)


# ---------------------------------------------------------------- filing and item rules


@query("ev_parse_items", "SELECT accession, list(code ORDER BY item_pos) AS codes FROM item_list GROUP BY accession")
def ev_parse_items(t):
    """Item string -> codes without boilerplate."""
    rows = t.filings.where("form = '8-K'").select("accession", item_codes("items").alias("codes"))
    return rows.where(F.size("codes") > 0)


@query("ev_classify_item", f"""
SELECT coalesce(x.kind, 'UNCLASSIFIED_8K') AS event_type, coalesce(x.sub, i.code) AS event_subtype, i.code, {big('count(*)')} AS n
FROM item_list i LEFT JOIN taxonomy x ON x.code = i.code GROUP BY ALL
""")
def ev_classify_item(t):
    """Era-aware item classification, counted per code."""
    return item_rows(t.filings).groupBy("event_type", "event_subtype", "code").agg(F.count("*").alias("n"))


@query("ev_effective_date", "SELECT accession, filing_date, event_date FROM filed_eff")
def ev_effective_date(t):
    """First actionable day of each filing."""
    return t.filings.select("accession", "filing_date",
                            effective_date("filing_date", "acceptance_datetime").alias("event_date"))


@query("ev_id", "SELECT accession, substr(sha1(ticker || '|' || CAST(filing_date AS VARCHAR) || '|' || form || '|' || accession), 1, 16) AS event_id FROM filings")
def ev_id(t):
    """Stable identifiers."""
    return t.filings.select("accession", event_key("ticker", "filing_date", "form", "accession").alias("event_id"))


@query("ev_vocab", f"""
WITH v AS (SELECT kind AS event_type FROM taxonomy UNION SELECT 'PERIODIC_REPORT' UNION SELECT 'UNCLASSIFIED_8K')
SELECT v.event_type, CAST(row_number() OVER (ORDER BY v.event_type) - 1 AS INTEGER) AS code, {big('count(f.event_id)')} AS n
FROM v LEFT JOIN filing_log f ON f.event_type = v.event_type GROUP BY v.event_type
""")
def ev_vocab(t):
    """Sorted vocabulary with its stable codes and how often each type occurs."""
    names = event_vocabulary()
    words = t.spark.createDataFrame([(n, i) for i, n in enumerate(names)], "event_type STRING, code INT")
    seen = filing_events(t.filings).groupBy("event_type").agg(F.count("*").alias("n"))
    return words.join(seen, "event_type", "left").select("event_type", "code", F.coalesce("n", F.lit(0)).alias("n"))


@query("p_events", "SELECT * FROM filing_log")
def p_events(t):
    """Event table of all filings."""
    return filing_events(t.filings)


@query("so_dedupe", "SELECT event_id, source FROM filing_log")
def so_dedupe(t):
    """First item stands for all items of one type in a filing."""
    return filing_events(t.filings).select("event_id", "source")


@query("w_div_events", "SELECT * FROM div_log")
def w_div_events(t):
    """Dividend decisions dated when observable."""
    return dividend_events(t.dividends, AS_OF)


@query("so_union", "SELECT * FROM event_log")
def so_union(t):
    """Union by name of filing and dividend events; absent ids are NULL."""
    return events_of(t)


@query("uni_is_delisting", "SELECT removed_ticker, date, regexp_matches(lower(coalesce(reason, '')), "
       f"'{'|'.join(vocab.DELISTING_WORDS)}') AS delisting FROM index_changes")
def uni_is_delisting(t):
    """Does the removal reason say that the company stopped trading?"""
    return t.index_changes.select("removed_ticker", "date", looks_delisted("reason").alias("delisting"))


# ---------------------------------------------------------------- as-of joins and calendar windows


def _event_line(t):
    line = timeline(t.bars.select("ticker", "date"), [(events_by_day(events_of(t)), "event_date")])
    return event_columns(line).where("is_row")


@query("j_asof_event", "SELECT * FROM since_log")
def j_asof_event(t):
    """Days since the last event of each type; 9999 when there was none."""
    return _event_line(t).select("ticker", "date", *[f"days_since_{k}" for k in _kinds])


@query("w_density", "SELECT * FROM density_log")
def w_density(t):
    """Event counts in trailing calendar windows."""
    return _event_line(t).select("ticker", "date", "event_density_90d", "dividend_cuts_365d")


@query("p_event_features", "SELECT s.*, d.event_density_90d, d.dividend_cuts_365d FROM since_log s JOIN density_log d "
                           "ON d.ticker = s.ticker AND d.date = s.date")
def p_event_features(t):
    """All event features."""
    return _event_line(t).select("ticker", "date", *vocab.EVENT_FEATURES)


_fund_out = ", ".join(f"{s6(c)} AS {c}" for c in _funds)


@query("w_earliest", f"SELECT ticker, concept, period_end, {s6('val', 2)} AS val, filed FROM first_facts")
def w_earliest(t):
    """Earliest filed value per concept and period."""
    return first_reported(t.facts).select("ticker", "concept", "period_end", settle("val", 2).alias("val"), "filed")


@query("w_fund", f"SELECT ticker, period_end, filed, {_fund_out} FROM fund_log")
def w_fund(t):
    """Derived ratios per reported period."""
    return fundamentals(t.facts).select("ticker", "period_end", "filed", *[settle(c).alias(c) for c in _funds])


@query("w_streak", "SELECT ticker, period_end, earnings_surprise_streak FROM fund_log")
def w_streak(t):
    """Length of the current run of falling net income."""
    return fundamentals(t.facts).select("ticker", "period_end", "earnings_surprise_streak")


@query("j_asof_fund", f"SELECT ticker, date, {_fund_out} FROM fund_asof")
def j_asof_fund(t):
    """Ratios known on each day, every ratio carried forward on its own."""
    right = fundamentals_by_day(fundamentals(t.facts))
    return as_of(t.bars.select("ticker", "date"), right, "filed", _funds).select(
        "ticker", "date", *[settle(c).alias(c) for c in _funds])


@query("j_align_ffill", f"SELECT ticker, date, {s6('bench', 3)} AS bench, {s6('vix')} AS vix, {s6('curve_slope')} AS curve_slope FROM px_fill")
def j_align_ffill(t):
    """Same-day join, then forward fill over the ticker's own days."""
    rows = with_context(t.bars, t.benchmark_bars, t.macro).withColumn("day", F.unix_date("date"))
    w = Trailing()
    return rows.select("ticker", "date", settle(w.filled("bench"), 3).alias("bench"), *[settle(w.filled(c)).alias(c) for c in ("vix", "curve_slope")])


@query("j_sector", f"SELECT ticker, date, {s6('sector_seen', 3)} AS sector FROM px_ctx")
def j_sector(t):
    """Sector close beside each bar."""
    rows = with_context(t.bars, universe=t.universe, sector_bars=t.sector_bars)
    return rows.select("ticker", "date", settle("sector", 3).alias("sector"))


# ---------------------------------------------------------------- membership


@query("w_membership", "SELECT * FROM spell_log")
def w_membership(t):
    """Membership spells from the change history."""
    return spells_of(t)


@query("j_member", 'SELECT b.ticker, b.date, b.close FROM bars b WHERE EXISTS (SELECT 1 FROM spell_log s WHERE '
       's.ticker = b.ticker AND b.date >= s.start AND (s."end" IS NULL OR b.date < s."end"))')
def j_member(t):
    """Bars inside a membership spell."""
    return members_only(t.bars, spells_of(t)).select("ticker", "date", "close")


step("gone_log", "SELECT removed_ticker AS ticker, max(date) AS removal_date, max_by(reason, date) AS reason FROM index_changes "
     "WHERE removed_ticker NOT IN (SELECT ticker FROM universe) GROUP BY 1")


@query("so_except", "SELECT ticker, removal_date FROM gone_log")
def so_except(t):
    """Removed names that are not listed today."""
    return removed_names(t.universe, t.index_changes).select("ticker", "removal_date")


FLOOR, TODAY = "1995-01-01", "2001-12-31"
step("mwin_log", f"""SELECT ticker, min(greatest(start, DATE '{FLOOR}')) AS window_start, max(coalesce("end", DATE '{TODAY}')) AS window_end
FROM spell_log WHERE coalesce("end", DATE '{TODAY}') > greatest(start, DATE '{FLOOR}') GROUP BY ticker""")


@query("ag_window_span", "SELECT * FROM mwin_log")
def ag_window_span(t):
    """Span of a name's membership inside the panel."""
    return coverage.membership_windows(spells_of(t), FLOOR, TODAY)


@query("ag_delist_cov", f"""
WITH today AS (SELECT ticker, name, sector, date_added, cik, sector_etf FROM universe WHERE cik % 3 <> 1),
gone AS (SELECT removed_ticker AS ticker, max(date) AS removal_date, max_by(reason, date) AS reason FROM index_changes
         WHERE removed_ticker NOT IN (SELECT ticker FROM today) GROUP BY 1),
walk AS (SELECT s.ticker, s.d, s.kind, lag(s.kind) OVER w AS pk, lag(s.d) OVER w AS pd, u.ticker IS NOT NULL AS listed,
         lead(s.kind) OVER w IS NULL AS is_last, u.date_added FROM chg_steps s LEFT JOIN today u ON u.ticker = s.ticker
         WINDOW w AS (PARTITION BY s.ticker ORDER BY s.d DESC, s.kind DESC)),
sp AS (SELECT ticker, d AS start, CASE WHEN pk = 0 THEN pd END AS e FROM walk WHERE pk = 0 OR (pk IS NULL AND listed)
       UNION ALL SELECT ticker, CASE WHEN date_added IS NULL OR date_added >= d THEN DATE '0001-01-01' ELSE date_added END, d FROM walk WHERE is_last AND kind = 0
       UNION ALL SELECT ticker, date_added, NULL FROM today WHERE ticker NOT IN (SELECT ticker FROM chg_steps)),
win AS (SELECT ticker, min(greatest(start, DATE '{FLOOR}')) AS ws, max(coalesce(e, DATE '{TODAY}')) AS we FROM sp
        WHERE coalesce(e, DATE '{TODAY}') > greatest(start, DATE '{FLOOR}') GROUP BY ticker),
seen AS (SELECT g.ticker, count(b.date) AS n, max(b.date) AS last_date, count(CASE WHEN b.date BETWEEN ws AND we THEN 1 END) AS inside
         FROM gone g JOIN win USING (ticker) LEFT JOIN bars b ON b.ticker = g.ticker GROUP BY g.ticker),
days AS (SELECT w.ticker, (SELECT count(*) FROM range(w.ws, w.we + INTERVAL '1' DAY, INTERVAL '1' DAY) r(d) WHERE dayofweek(d) BETWEEN 1 AND 5) AS bd FROM win w),
res AS (SELECT g.ticker, g.removal_date, g.reason, s.n, s.last_date, w.ws, w.we, s.inside / greatest(d.bd, 1) AS cov,
        regexp_matches(lower(g.reason), 'acquir|merg') AS del
        FROM gone g JOIN win w USING (ticker) JOIN seen s USING (ticker) JOIN days d USING (ticker))
SELECT ticker, removal_date, del AS delisting, {big('n')} AS rows, last_date, ws AS window_start, we AS window_end, {s6('cov')} AS coverage,
       CASE WHEN n = 0 THEN 'no data' WHEN del AND date_diff('day', removal_date, last_date) > 25 THEN 'ticker reused by another company'
            WHEN cov < 0.5 THEN 'too little of the membership window' ELSE 'ok' END AS status FROM res
""")
def ag_delist_cov(t):
    """Coverage survey of removed names; names outside today's list are those with cik % 3 = 1."""
    today = t.universe.where("cik % 3 <> 1")
    spells = membership_spells(today, t.index_changes)
    out = coverage.survey_removed(today, t.index_changes, spells, t.bars, FLOOR, TODAY)
    return out.withColumn("coverage", settle("coverage"))


# ---------------------------------------------------------------- regimes

SHIFTED = (("pre", "1995-01-01", "1996-12-31"), ("expansion", "1997-01-01", "1998-06-30"),
           ("crisis", "1998-07-01", "1998-12-31"), ("boom", "1999-01-01", "2000-03-31"), ("late", "2000-04-01", "2001-06-30"))
_case = " ".join(f"WHEN date BETWEEN DATE '{a}' AND DATE '{b}' THEN '{n}'" for n, a, b in SHIFTED)


@query("reg_for", f"SELECT CASE {_case} ELSE 'unknown' END AS regime, {big('count(*)')} AS n FROM bars GROUP BY 1")
def reg_for(t):
    """Bars per named regime; the regime table is a parameter."""
    return t.bars.groupBy(named_regime("date", SHIFTED).alias("regime")).agg(F.count("*").alias("n"))


@query("reg_recession", "SELECT date, CASE WHEN date BETWEEN DATE '2001-03-01' AND DATE '2001-11-30' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS recession FROM macro")
def reg_recession(t):
    """Recession flag per macro day."""
    return t.macro.select("date", recession("date").alias("recession"))


_state = "CASE WHEN vix >= 0 AND vix < 15 THEN 'calm' WHEN vix >= 15 AND vix < 22 THEN 'normal' WHEN vix >= 22 AND vix < 30 THEN 'stressed' WHEN vix >= 30 THEN 'crisis' ELSE 'unknown' END"


@query("reg_volstate", f"SELECT date, {_state} AS state FROM macro")
def reg_volstate(t):
    """Volatility band per macro day."""
    return t.macro.select("date", volatility_state("vix").alias("state"))


@query("reg_current", f"""
WITH now AS (SELECT max(date) AS date, max_by(vix, date) AS vix FROM macro WHERE vix IS NOT NULL),
c AS (SELECT date, {s6('vix')} AS vix, {_state} AS state, CASE {_case} ELSE 'unknown' END AS calendar FROM now)
SELECT date AS as_of, vix, state, calendar, array_to_string(list_distinct([calendar]) || list_filter(CASE state
   WHEN 'calm' THEN ['recovery', 'covid_recovery', 'recent'] WHEN 'normal' THEN ['recovery', 'recent']
   WHEN 'stressed' THEN ['rate_hikes', 'gfc'] WHEN 'crisis' THEN ['covid_crash', 'gfc'] ELSE [] END, lambda r: r <> calendar), ',') AS relevant FROM c
""")
def reg_current(t):
    """Calendar regime and volatility state of the last macro day, and the regimes that speak for it."""
    now = t.macro.where("vix IS NOT NULL").agg(F.max("date").alias("as_of"), F.max_by("vix", "date").alias("vix"))
    now = now.withColumns({"state": volatility_state("vix"), "calendar": named_regime("as_of", SHIFTED)})
    relevant = F.array_distinct(F.concat(F.array("calendar"), similar_regimes("state")))
    return now.select("as_of", settle("vix").alias("vix"), "state", "calendar", F.array_join(relevant, ",").alias("relevant"))


# ---------------------------------------------------------------- the panel
_f6 = ", ".join(f"{s6(c)} AS {c}" for c in _feat_cols)


@query("p_features", f"SELECT ticker, date, {_f6} FROM feat_all")
def p_features(t):
    """All 47 features of every bar."""
    return full_features(t).select("ticker", "date", *[settle(c).alias(c) for c in _feat_cols])


_lab_meas = [c for c in label_names() if not c.startswith("label_")]
_lab_cls = [c for c in label_names() if c.startswith("label_")]
_l6 = ", ".join([f"{s6(c)} AS {c}" for c in _lab_meas] + _lab_cls)


@query("p_dataset", f"SELECT f.ticker, f.date, {', '.join(s6('f.' + c) + ' AS ' + c for c in _feat_cols)}, "
                    f"{', '.join([s6('l.' + c) + ' AS ' + c for c in _lab_meas] + ['l.' + c for c in _lab_cls])} "
                    "FROM feat_all f JOIN lab l ON l.ticker = f.ticker AND l.date = f.date")
def p_dataset(t):
    """Features and 21 labels of every bar."""
    rows = build_dataset(t, as_of=AS_OF)
    return rows.select("ticker", "date", *[settle(c).alias(c) for c in _feat_cols + _lab_meas], *_lab_cls)


@query("p_panel", f"SELECT ticker, date, {', '.join(s6(f'CAST({c} AS FLOAT)', 3) + ' AS ' + c for c in _feat_cols)}, {_l6} FROM panel_log")
def p_panel(t):
    """Panel of member rows, features stored as FLOAT."""
    panel = build_panel(t, as_of=AS_OF)
    return panel.select("ticker", "date", *[settle(c, 3).alias(c) for c in _feat_cols], *[settle(c).alias(c) for c in _lab_meas], *_lab_cls)


@query("src_panel_pruned", f"SELECT ticker, date, {s6('CAST(vol_20 AS FLOAT)')} AS vol_20, label_magnitude_1d FROM panel_log")
def src_panel_pruned(t):
    """Only the needed columns of the stored panel are read."""
    from panelyard.session import stored

    panel = stored(build_panel(t, as_of=AS_OF), "panel")
    return panel.select("ticker", "date", settle("vol_20").alias("vol_20"), "label_magnitude_1d")


@query("schema_fp", f"""
WITH e AS (SELECT count(DISTINCT ticker) AS tickers, count(*) AS n, min(date) AS a, max(date) AS b FROM panel_log),
s AS (SELECT substr(sha1('{"|".join(sorted(vocab.FEATURES))}'), 1, 12) AS schema)
SELECT schema, {big('tickers')} AS tickers, {big('n')} AS rows, a AS start, b AS "end",
       substr(sha1(schema || '|' || tickers || '|' || n || '|' || a || '|' || b), 1, 12) AS panel_id FROM e, s
""")
def schema_fp(t):
    """Fingerprint of the feature list and identity of the built panel."""
    return panel_identity(build_panel(t, as_of=AS_OF))


@query("tgt_frame", f"""
SELECT 'latest' AS part, ticker, date, {s6('ret_5')} AS ret_5, CAST(NULL AS INTEGER) AS y FROM
  (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM panel_log) WHERE k = 1
UNION ALL SELECT 'trainable', ticker, date, {s6('ret_5')}, label_direction_20d FROM panel_log WHERE label_direction_20d IS NOT NULL
""")
def tgt_frame(t):
    """Labelled rows of one target, and the last row of each ticker."""
    rows = build_dataset(t, as_of=AS_OF)
    panel = members_only(rows, spells_of(t))
    last = latest_rows(panel, ["ret_5"]).select(F.lit("latest").alias("part"), "ticker", "date", settle("ret_5").alias("ret_5"),
                                                F.lit(None).cast("int").alias("y"))
    train = target_rows(panel, "direction", 20).select(F.lit("trainable").alias("part"), "ticker", "date",
                                                       settle("ret_5").alias("ret_5"), "y")
    return last.unionByName(train)


@query("clean_inf", f"SELECT ticker, date, {s6('close / nullif(volume - 50, 0)')} AS noisy FROM bars")
def clean_inf(t):
    """Division by zero never leaves an infinite value behind."""
    gap = F.col("volume") - 50
    wild = F.when(gap == 0, F.lit(float("inf"))).otherwise(F.col("close") / F.when(gap != 0, gap))
    return t.bars.select("ticker", "date", settle(finite(wild)).alias("noisy"))


_groups = ", ".join(f"('{f}', '{g}')" for g, fs in vocab.FEATURE_GROUPS.items() for f in fs)
_present = " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} IS NOT NULL AS present FROM panel_log" for c in _feat_cols)


@query("feat_group", f"""
WITH g AS (SELECT * FROM (VALUES {_groups}) AS v(feature, grp)), x AS ({_present})
SELECT g.grp AS feature_group, {big('count(DISTINCT g.feature)')} AS features, {s6('avg(CASE WHEN present THEN 1.0 ELSE 0.0 END)')} AS coverage
FROM g JOIN x ON x.feature = g.feature GROUP BY g.grp
""")
def feat_group(t):
    """Features by group with the share of values present."""
    rows = _presence(t)
    pairs = [(f, g) for g, names in vocab.FEATURE_GROUPS.items() for f in names]
    groups = t.spark.createDataFrame(pairs, "feature STRING, feature_group STRING")
    return rows.join(groups, "feature").groupBy("feature_group").agg(
        F.count("*").alias("features"), settle(F.sum("present") / F.sum("n")).alias("coverage"))


def _presence(t):
    """(feature, n, present) from one aggregate over the wide panel, then a turn of one row."""
    panel = build_panel(t, as_of=AS_OF)
    wide = panel.agg(F.count("*").alias("n"), *[F.count(c).alias(c) for c in _feat_cols])
    return wide.unpivot(["n"], _feat_cols, "feature", "present")


@query("ag_panelstats", f"""
WITH x AS ({_present}), y AS (
  {' UNION ALL '.join(f"SELECT '{c}' AS name, {c} AS y FROM panel_log WHERE {c} IS NOT NULL" for c in _lab_cls)})
SELECT 'feature' AS part, feature AS name, CAST(NULL AS INTEGER) AS y, {s6('avg(CASE WHEN present THEN 1.0 ELSE 0.0 END)')} AS share FROM x GROUP BY feature
UNION ALL SELECT 'label', name, y, {s6('CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY name)')} FROM y GROUP BY name, y
""")
def ag_panelstats(t):
    """Coverage of every feature and balance of every label."""
    panel = build_panel(t, as_of=AS_OF)
    labels = panel.select(*_lab_cls).unpivot([], _lab_cls, "name", "y").where("y IS NOT NULL").groupBy("name", "y").agg(
        F.count("*").alias("n"))
    total = labels.groupBy("name").agg(F.sum("n").alias("total"))
    balance = labels.join(total, "name").select(F.lit("label").alias("part"), "name", "y", settle(F.col("n") / F.col("total")).alias("share"))
    present = _presence(t).select(F.lit("feature").alias("part"), F.col("feature").alias("name"), F.lit(None).cast("int").alias("y"),
                                  settle(F.col("present") / F.col("n")).alias("share"))
    return present.unionByName(balance)


@query("so_index_union", f"SELECT ticker, date FROM bars UNION SELECT ticker, event_date FROM event_log")
def so_index_union(t):
    """Union of trading days and event days."""
    return t.bars.select("ticker", "date").union(events_of(t).select("ticker", "event_date")).distinct()
