"""Codes, dates, tiers and names that results must agree on.

Everything in this file is data, not logic.  The values have to be exactly these for
event types, regimes, feature groups and thresholds to come out right.
"""

# Horizons (in bars), label rule and target kinds.
HORIZONS = (1, 5, 20)
VOL_LOOKBACK = 60
THRESHOLD_SIGMAS = 1.0
KINDS = ("direction", "magnitude", "rel_direction")
DIRECTION_NAMES = ("DROP", "NEUTRAL", "SPIKE")
MAGNITUDE_NAMES = ("QUIET", "LARGE_MOVE")
EPS = 1e-12

# Modern (dotted) filing item codes -> (event type, subtype).
MODERN_ITEMS = {
    "1.01": ("MA_ANNOUNCED", "MATERIAL_AGREEMENT"),
    "1.02": ("MA_TERMINATED", "AGREEMENT_TERMINATED"),
    "1.03": ("BANKRUPTCY", "BANKRUPTCY_OR_RECEIVERSHIP"),
    "1.04": ("REGULATORY_ACTION", "MINE_SAFETY"),
    "2.01": ("MA_ANNOUNCED", "ACQUISITION_COMPLETED"),
    "2.02": ("EARNINGS_RESULT", "RESULTS_OF_OPERATIONS"),
    "2.03": ("DEBT_OBLIGATION", "OBLIGATION_CREATED"),
    "2.04": ("DEBT_OBLIGATION", "ACCELERATION_TRIGGERED"),
    "2.05": ("RESTRUCTURING", "EXIT_OR_DISPOSAL_COSTS"),
    "2.06": ("ASSET_IMPAIRMENT", "MATERIAL_IMPAIRMENT"),
    "3.01": ("REGULATORY_ACTION", "LISTING_RULE_NOTICE"),
    "3.02": ("EQUITY_ISSUANCE", "UNREGISTERED_SALE"),
    "3.03": ("EQUITY_ISSUANCE", "SECURITY_HOLDER_RIGHTS"),
    "4.01": ("AUDITOR_CHANGE", "ACCOUNTANT_CHANGED"),
    "4.02": ("FRAUD_ACCOUNTING", "NON_RELIANCE_RESTATEMENT"),
    "5.01": ("MA_ANNOUNCED", "CONTROL_CHANGE"),
    "5.02": ("EXECUTIVE_CHANGE", "DIRECTOR_OR_OFFICER"),
    "5.03": ("GOVERNANCE", "BYLAW_AMENDMENT"),
    "5.04": ("GOVERNANCE", "TRADING_SUSPENSION_BLACKOUT"),
    "5.05": ("GOVERNANCE", "ETHICS_CODE_CHANGE"),
    "5.06": ("GOVERNANCE", "SHELL_STATUS_CHANGE"),
    "5.07": ("GOVERNANCE", "SHAREHOLDER_VOTE"),
    "5.08": ("GOVERNANCE", "DIRECTOR_NOMINATION"),
    "6.01": ("REGULATORY_ACTION", "ABS_INFORMATIONAL"),
    "7.01": ("DISCLOSURE", "REG_FD"),
    "8.01": ("DISCLOSURE", "OTHER_EVENTS"),
}
# Item codes used before August 2004: never dotted, different meanings.
LEGACY_ITEMS = {
    "1": ("MA_ANNOUNCED", "CONTROL_CHANGE"),
    "2": ("MA_ANNOUNCED", "ACQUISITION_OR_DISPOSITION"),
    "3": ("BANKRUPTCY", "BANKRUPTCY_OR_RECEIVERSHIP"),
    "4": ("AUDITOR_CHANGE", "ACCOUNTANT_CHANGED"),
    "5": ("DISCLOSURE", "OTHER_EVENTS"),
    "6": ("EXECUTIVE_CHANGE", "DIRECTOR_RESIGNATION"),
    "8": ("GOVERNANCE", "FISCAL_YEAR_CHANGE"),
    "9": ("DISCLOSURE", "REG_FD"),
    "10": ("GOVERNANCE", "ETHICS_CODE_CHANGE"),
    "11": ("GOVERNANCE", "TRADING_SUSPENSION_BLACKOUT"),
    "12": ("EARNINGS_RESULT", "RESULTS_OF_OPERATIONS"),
}
PERIODIC_FORMS = {"10-K": ("PERIODIC_REPORT", "ANNUAL"), "10-Q": ("PERIODIC_REPORT", "QUARTERLY")}
BOILERPLATE_MODERN = "9.01"
BOILERPLATE_LEGACY = "7"
UNCLASSIFIED = "UNCLASSIFIED_8K"
MARKET_ZONE = "America/New_York"
CLOSE_HOUR = 16

# Event types that get their own "days since" feature.
TRACKED_EVENTS = (
    "EARNINGS_RESULT", "DIVIDEND_CUT", "DIVIDEND_RAISE", "EXECUTIVE_CHANGE", "MA_ANNOUNCED",
    "REGULATORY_ACTION", "FRAUD_ACCOUNTING", "AUDITOR_CHANGE", "DISCLOSURE", "PERIODIC_REPORT",
)
NEVER = 9999.0  # "has never happened", on purpose different from null

# Dividend decisions.
DIVIDEND_TOLERANCE = 0.01
MISSED_FACTOR = 1.5
RESTART_FACTOR = 2.5
DEFAULT_GAP_DAYS = 91.0

# Reported facts.
REVENUE_CONCEPTS = ("RevenueFromContractWithCustomerExcludingAssessedTax", "Revenues", "SalesRevenueNet")
FLOW_CONCEPTS = ("NetIncomeLoss", "GrossProfit") + REVENUE_CONCEPTS
INSTANT_CONCEPTS = ("Assets", "Liabilities", "AssetsCurrent", "LiabilitiesCurrent", "StockholdersEquity")
QUARTER_DAYS = (80, 100)
FUNDAMENTALS = (
    "revenue_growth_yoy", "gross_margin", "net_margin", "debt_to_equity", "current_ratio",
    "earnings_surprise_streak",
)

# Words in a removal reason that mean the company stopped trading.
DELISTING_WORDS = (
    "acquir", "merg", "bought", "purchas", "taken private", "buyout", "bankrupt", "delist", "spun off",
    "split into", "dissolv", "liquidat",
)
SECTOR_FUNDS = {
    "Information Technology": "XLK", "Health Care": "XLV", "Financials": "XLF",
    "Consumer Discretionary": "XLY", "Consumer Staples": "XLP", "Industrials": "XLI", "Energy": "XLE",
    "Utilities": "XLU", "Real Estate": "XLRE", "Materials": "XLB", "Communication Services": "XLC",
}
TAIL_DAYS = 25
MIN_COVERAGE = 0.5

# Business-cycle contractions, inclusive, and named market regimes.
RECESSIONS = (
    ("1990-07-01", "1991-03-31"), ("2001-03-01", "2001-11-30"),
    ("2007-12-01", "2009-06-30"), ("2020-02-01", "2020-04-30"),
)
REGIMES = (
    ("pre_gfc", "2005-01-01", "2007-11-30"), ("gfc", "2007-12-01", "2009-06-30"),
    ("recovery", "2009-07-01", "2019-12-31"), ("covid_crash", "2020-01-01", "2020-04-30"),
    ("covid_recovery", "2020-05-01", "2021-12-31"), ("rate_hikes", "2022-01-01", "2023-07-31"),
    ("recent", "2023-08-01", "2100-01-01"),
)
VOLATILITY_BANDS = (("calm", 0.0, 15.0), ("normal", 15.0, 22.0), ("stressed", 22.0, 30.0), ("crisis", 30.0, None))
SIMILAR_REGIMES = {
    "calm": ("recovery", "covid_recovery", "recent"), "normal": ("recovery", "recent"),
    "stressed": ("rate_hikes", "gfc"), "crisis": ("covid_crash", "gfc"),
}

# Source credibility tiers for news.
SOURCE_TIERS = {
    "sec edgar": 1.0, "reuters": 0.95, "bloomberg": 0.95, "associated press": 0.9,
    "the wall street journal": 0.9, "financial times": 0.9, "cnbc": 0.8, "barron's": 0.8,
    "marketwatch": 0.7, "yahoo finance": 0.6, "benzinga": 0.6, "investor's business daily": 0.6,
    "motley fool": 0.4, "simply wall st.": 0.4, "zacks": 0.4,
}
DEFAULT_TIER = 0.3
STALE_NEWS_HOURS = 48
NEWS_HALF_LIFE_HOURS = 8.0
TOP_HEADLINES = 8

# Features by group.
VOLATILITY_FEATURES = ("vol_20", "vol_60", "vol_ratio_20_60", "atr_14_pct")
TECHNICAL_FEATURES = (
    "ret_5", "ret_20", "ret_60", "ret_252", "volume_z_60", "rsi_14", "macd_hist_pct", "bb_position",
    "drawdown_from_252h", "runup_from_252l", "beta_60", "excess_ret_5", "excess_ret_20", "excess_ret_60",
)
SECTOR_FEATURES = (
    "sector_rel_ret_5", "sector_rel_ret_20", "sector_rel_ret_60", "sector_vol_20", "vol_vs_sector",
)
EVENT_FEATURES = tuple(f"days_since_{t.lower()}" for t in TRACKED_EVENTS) + (
    "days_since_any_event", "dividend_cuts_365d", "event_density_90d",
)
MACRO_FEATURES = ("vix", "vix_chg_20", "curve_slope", "curve_slope_chg_60", "recession")
FEATURE_GROUPS = {
    "volatility": VOLATILITY_FEATURES, "technical": TECHNICAL_FEATURES, "sector": SECTOR_FEATURES,
    "events": EVENT_FEATURES, "macro": MACRO_FEATURES, "fundamentals": FUNDAMENTALS,
}
FEATURES = tuple(f for names in FEATURE_GROUPS.values() for f in names)
LABEL_PREFIXES = ("label_", "forward_", "rel_forward_")
ANALOG_FEATURES = (
    "ret_5", "ret_20", "ret_60", "vol_20", "vol_ratio_20_60", "volume_z_60", "rsi_14", "bb_position",
    "drawdown_from_252h", "excess_ret_20", "sector_rel_ret_20", "event_density_90d",
    "days_since_earnings_result", "vix", "debt_to_equity",
)
EARNINGS_FEATURES = ("days_since_earnings_result", "days_since_periodic_report")
BASELINE_SETS = {
    "vol": VOLATILITY_FEATURES,
    "earnings": EARNINGS_FEATURES,
    "simple": VOLATILITY_FEATURES + EARNINGS_FEATURES + ("vix", "vix_chg_20"),
}

# Monitoring, gate and feedback thresholds.
PSI_MODERATE, PSI_SIGNIFICANT, PSI_RETRAIN, PSI_FLOOR = 0.10, 0.25, 0.2, 1e-6
FULL_RETRAIN_DAYS, INCREMENTAL_DAYS, LIVE_WINDOW_DAYS = 91, 30, 60
REGRESSION_TOLERANCE = 0.005
MIN_SHARED_ROWS = 1000
MIN_REGIME_ROWS = 250
MIN_LIVE_ROWS = 200
SKILL_NOISE_FLOOR = 0.01
MIN_EDGE = 0.002
FUSION_MIN_GAIN = 0.005
BOOTSTRAP_REPS = 2000
EARNINGS_CYCLE_DAYS, CALENDAR_PER_BAR = 91, 1.45
MIN_GARCH_ROWS = 500
VIX_SHOCK = 0.25
LARGE_ERROR_SIGMAS = 1.5
POST_MORTEM_TAGS = (
    "EVENT_NOT_IN_TAXONOMY", "REGIME_SHIFT", "SENTIMENT_LAGGED", "ANALOG_POOR_MATCH", "MODEL_UNCERTAIN",
    "UNEXPLAINED",
)
RETIRED_PANELS = ("3db13f4b530b",)
