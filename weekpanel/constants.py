"""Fixed values shared by the operators."""

from __future__ import annotations

# --- fixed values: tickers, assets, calendar lags --------------------------
TRACKED_ASSETS = ("SPY", "TLT", "GLD")
CONTEXT_TICKERS = ("QQQ", "^VIX", "^TNX")
REQUIRED_TICKERS = TRACKED_ASSETS + CONTEXT_TICKERS
ASSET_NAMES = ("SPY", "TLT", "GLD", "CASH")
NEWS_ASSETS = ("SPY", "TLT", "GLD", "VIX", "TNX")
SERIES_PREFIX_ALIASES = {"CPIAUCSL": "cpi"}
RELEASE_LAG_DAYS = {"daily": 0, "weekly": 7}
RELEASE_LAG_MONTHS = {"monthly": 1}

# --- fixed values: lexicons (matched as substrings of lower-cased text) ----
TOPIC_KEYWORDS = {
    "growth_earnings": (
        "earnings", "revenue", "profit", "guidance", "sales",
        "growth", "upgrade", "downgrade", "beat", "miss",
    ),
    "inflation_rates": (
        "inflation", "rates", "rate", "fed", "federal reserve",
        "treasury", "yield", "bond", "cpi", "pce",
    ),
    "recession_slowdown": (
        "recession", "slowdown", "jobless", "unemployment", "layoff",
        "layoffs", "contraction", "weak demand", "economic weakness",
    ),
    "geopolitics_policy": (
        "tariff", "tariffs", "war", "sanction", "sanctions", "policy",
        "election", "geopolitical", "iran", "russia", "china",
    ),
    "market_technical_flow": (
        "selloff", "rally", "flows", "flow", "positioning",
        "momentum", "volatility", "correction", "breakout", "hedge",
    ),
}
POSITIVE_KEYWORDS = (
    "beat", "bullish", "gain", "gains", "growth", "improve", "improved",
    "outperform", "profit", "profits", "rally", "rebound", "recovery",
    "rise", "rises", "strong", "surge",
)
NEGATIVE_KEYWORDS = (
    "bearish", "crash", "cut", "cuts", "decline", "drop", "drops", "fear",
    "loss", "losses", "recession", "risk", "selloff", "slump", "slowdown",
    "stress", "weak", "worst",
)
IMPACT_KEYWORDS = (
    "bond", "cpi", "earnings", "fed", "inflation", "iran", "jobs", "oil",
    "policy", "rates", "recession", "tariff", "treasury", "vix",
    "volatility", "war",
)

# --- fixed values: article search profile per asset (whole-phrase terms) ---
COMMON_BLOCKED = (
    "wolf of wall street", "movie", "film", "box office",
    "obituary", "restaurant", "wedding", "music video",
)
ARTICLE_TERMS = {
    "SPY": ("s p 500", "stock market", "stocks", "equities", "wall street",
            "federal reserve", "fed"),
    "TLT": ("treasury", "treasuries", "yield", "yields", "bond",
            "bond market", "fixed income", "interest rates"),
    "GLD": ("gold", "gold price", "gold prices", "spot gold", "bullion",
            "precious metals"),
    "CASH": ("federal reserve", "fed", "interest rates", "monetary policy",
             "fed funds", "money market"),
    "QQQ": ("technology", "tech", "internet", "software", "semiconductor",
            "chip", "apple", "google", "microsoft", "facebook", "nvidia",
            "intel", "amazon", "nasdaq"),
    "VIX": ("vix", "volatility", "fear gauge", "fear", "volatility index",
            "market volatility"),
    "TNX": ("10 year treasury yield", "treasury yield", "10 year note",
            "benchmark yield", "treasury yields", "bond yields",
            "treasury market", "bond market", "yield curve", "fixed income",
            "interest rates", "mortgage rates"),
}
ARTICLE_BLOCKED = {
    "SPY": (),
    "TLT": ("james bond",),
    "GLD": ("gold coast", "gold medal", "golden globe", "dirty love"),
    "CASH": (),
    "QQQ": ("breast", "bra", "starbucks cards"),
    "VIX": (),
    "TNX": (),
}
ARTICLE_PATH_EXCLUSIONS = (
    "/tag/", "/category/", "/author/", "/topic/", "/topics/", "/about",
    "/contact", "/privacy", "/terms", "/search", "/page/", "/feed",
)
ARTICLE_QUERY_EXCLUSIONS = ("privacy", "terms", "cookies")
ARTICLE_SEARCH_PARAMS = ("s=", "search=", "query=")

# --- fixed values: allocation templates (SPY, TLT, GLD, CASH) --------------
ACTION_TEMPLATES = (
    (0, "cash_only", (0.0, 0.0, 0.0, 1.0)),
    (1, "spy_only", (1.0, 0.0, 0.0, 0.0)),
    (2, "tlt_only", (0.0, 1.0, 0.0, 0.0)),
    (3, "gld_only", (0.0, 0.0, 1.0, 0.0)),
    (4, "spy_80_tlt_20", (0.8, 0.2, 0.0, 0.0)),
    (5, "balanced_60_30_10", (0.6, 0.3, 0.1, 0.0)),
    (6, "defensive_20_60_20", (0.2, 0.6, 0.2, 0.0)),
)
DISPLAY_NAMES = {
    "cash_only": "Cash",
    "spy_only": "SPY",
    "tlt_only": "TLT",
    "gld_only": "GLD",
    "spy_80_tlt_20": "SPY 80 / TLT 20",
    "balanced_60_30_10": "Balanced 60 / 30 / 10",
    "defensive_20_60_20": "Defensive 20 / 60 / 20",
    "equal_weight_spy_tlt_gld": "Equal Weight",
    "momentum_rotation_20d": "Momentum 20D",
    "heuristic_regime_proxy": "Heuristic Regime",
    "rl_rl_finetuned_best": "RL Finetuned Best",
    "rl_dqn": "RL DQN",
    "rl_a2c": "RL A2C",
    "rl_ppo": "RL PPO",
    "rl_attention_dqn": "RL Attention DQN",
}

# --- fixed values: back-test settings --------------------------------------
TRANSACTION_COST = 0.001
RISK_PENALTY = 0.05
RISK_WINDOW = 12
PERIODS_PER_YEAR = 52
INITIAL_CAPITAL = 1.0
NEAR_ZERO = 1e-12

# --- fixed values: column roles --------------------------------------------
TARGET_COLUMNS = (
    "spy_weekly_close", "tlt_weekly_close", "gld_weekly_close",
    "next_return_spy", "next_return_tlt", "next_return_gld", "cash_return",
)
METADATA_COLUMNS = ("week_end", "week_last_trade_date", "source", "eval_split")
PRICE_PREFIXES = ("spy_", "tlt_", "gld_", "qqq_", "vix_", "tnx_")
TEXT_TOKENS = ("headline", "sentiment", "impact", "relevance", "topic_", "news_")
REGIME_TOKENS = ("regime", "posterior", "state_prob", "hmm")
MODEL_EXCLUDED_COLUMNS = (
    "week_end", "week_last_trade_date", "spy_weekly_close", "tlt_weekly_close",
    "gld_weekly_close", "next_return_spy", "next_return_tlt",
    "next_return_gld", "source",
)
FEATURE_PRESETS = {
    "full": None,
    "regime_core": (
        "spy_ret_5d", "spy_ret_20d", "spy_vol_20d", "spy_drawdown_60d",
        "tlt_ret_20d", "gld_ret_20d", "vix_level", "vix_change_5d",
        "tnx_level", "tnx_change_5d", "nfci_level", "dff_level",
        "t10y3m_level", "cpi_yoy", "unrate_level",
    ),
}

# --- fixed values: split windows -------------------------------------------
CONTIGUOUS_SPLITS = (
    ("warmup", "2014-06-30"),
    ("train", "2020-12-31"),
    ("validation", "2022-12-30"),
)
FINAL_SPLIT = "locked_test"
CLOSED_SPLITS = (
    ("warmup", "2014-01-02", "2014-06-30"),
    ("train", "2014-07-01", "2020-12-31"),
    ("validation", "2021-01-01", "2022-12-30"),
    ("locked_test", "2023-01-03", "2026-03-20"),
)

# --- fixed values: model search and candidate filters ----------------------
GRID_STATES = (2, 3, 4)
GRID_COMPONENTS = (8, 10, 12, 14)
GRID_COVARIANCES = ("diag", "full")
GRID_SEEDS = (7, 21, 42, 84, 168)
CLIP_SIGMA = 10.0
FIT_ITERATIONS = 300
FIT_TOLERANCE = 1e-5
MIN_COVARIANCE = 1e-3
STICKY_WEIGHT = 12.0
MAX_STATES = 4
COLLAPSE_PCT = 0.05
FLIP_FLOP_WEEKS = 2.0
IMBALANCE_PCT = 0.85
ONE_SHOT_PCT = 0.15
K4_SMALL_PCT = 0.08
K4_PROFILE_DISTANCE = 0.25
TIER_HIGH = 6
TIER_MEDIUM = 3
SEMANTIC_LABELS = {
    2: ("Risk-off", "Risk-on"),
    3: ("Stress", "Neutral", "Risk-on"),
    4: ("Stress", "Caution", "Neutral", "Risk-on"),
}
TREND_LABELS = ("Downtrend", "Sideways", "Uptrend")
TREND_LOOKBACK = 26
TREND_NEUTRAL_Z = 0.5

# --- fixed values: sentence-label files ------------------------------------
AGREEMENT_FILES = {
    "Sentences_AllAgree.txt": "all_agree",
    "Sentences_75Agree.txt": "agree_75",
    "Sentences_66Agree.txt": "agree_66",
    "Sentences_50Agree.txt": "agree_50",
}

# The macro series (id, category, frequency, description, suggested transform) and the named selections of them.
MACRO_SERIES = (
    ("DFF", "rates", "daily", "Effective Federal Funds Rate", "level, 5d change"),
    ("DGS10", "rates", "daily", "10-Year Treasury Constant Maturity Rate", "level, 5d change"),
    ("DGS30", "rates", "daily", "30-Year Treasury Constant Maturity Rate", "level, 5d change"),
    ("DGS3MO", "rates", "daily", "3-Month Treasury Constant Maturity Rate", "level, 5d change"),
    ("T10Y2Y", "yield_curve", "daily", "10-Year Treasury Constant Maturity Minus 2-Year Treasury Constant Maturity", "level, sign, 5d change"),
    ("T10Y3M", "yield_curve", "daily", "10-Year Treasury Constant Maturity Minus 3-Month Treasury Constant Maturity", "level, sign, 5d change"),
    ("T10YIE", "inflation_expectations", "daily", "10-Year Breakeven Inflation Rate", "level, 5d change"),
    ("T5YIFR", "inflation_expectations", "daily", "5-Year, 5-Year Forward Inflation Expectation Rate", "level, 5d change"),
    ("NFCI", "financial_conditions", "weekly", "Chicago Fed National Financial Conditions Index", "level, 4w change"),
    ("ANFCI", "financial_conditions", "weekly", "Chicago Fed Adjusted National Financial Conditions Index", "level, 4w change"),
    ("STLFSI4", "financial_stress", "weekly", "St. Louis Fed Financial Stress Index", "level, 4w change"),
    ("BAMLH0A0HYM2", "credit_spreads", "daily", "ICE BofA US High Yield Index Option-Adjusted Spread", "level, 5d change"),
    ("BAMLC0A4CBBB", "credit_spreads", "daily", "ICE BofA BBB US Corporate Index Option-Adjusted Spread", "level, 5d change"),
    ("VIXCLS", "market_risk", "daily", "CBOE Volatility Index: VIX", "level, 5d change"),
    ("DTWEXBGS", "dollar", "daily", "Trade Weighted US Dollar Index: Broad, Goods and Services", "level, 5d pct change"),
    ("WRESBAL", "liquidity", "weekly", "Reserve Balances with Federal Reserve Banks", "log level, 4w pct change"),
    ("ICSA", "labor", "weekly", "Initial Claims", "log level, 4w change"),
    ("CC4WSA", "labor", "weekly", "Continued Claims: 4-Week Moving Average", "log level, 4w change"),
    ("CPIAUCSL", "inflation", "monthly", "Consumer Price Index for All Urban Consumers: All Items in U.S. City Average", "12m pct change"),
    ("UNRATE", "labor", "monthly", "Unemployment Rate", "level, 3m change"),
    ("PAYEMS", "labor", "monthly", "All Employees, Total Nonfarm", "12m pct change"),
    ("INDPRO", "activity", "monthly", "Industrial Production: Total Index", "12m pct change"),
    ("CFNAI", "activity", "monthly", "Chicago Fed National Activity Index", "level, 3m average"),
    ("UMCSENT", "sentiment", "monthly", "University of Michigan: Consumer Sentiment", "level, 3m change"),
    ("PERMIT", "housing", "monthly", "New Private Housing Units Authorized by Building Permits", "12m pct change"),
    ("MORTGAGE30US", "housing", "weekly", "30-Year Fixed Rate Mortgage Average in the United States", "level, 4w change"),
)
SERIES_PRESETS = {
    "compact": (
        "DFF", "DGS10", "T10Y2Y", "T10YIE", "NFCI", "ICSA", "CPIAUCSL", "UNRATE", "INDPRO", "UMCSENT",
    ),
    "core": (
        "DFF", "DGS3MO", "DGS10", "T10Y3M", "T10YIE", "NFCI", "BAMLH0A0HYM2", "VIXCLS", "DTWEXBGS", "WRESBAL",
        "ICSA", "UNRATE", "CPIAUCSL", "CFNAI", "UMCSENT", "PERMIT",
    ),
    "core_plus_duration": (
        "DFF", "DGS3MO", "DGS10", "DGS30", "T10Y3M", "T10YIE", "NFCI", "BAMLH0A0HYM2", "VIXCLS", "DTWEXBGS",
        "WRESBAL", "ICSA", "UNRATE", "CPIAUCSL", "CFNAI", "UMCSENT", "PERMIT",
    ),
    "extended": (
        "DFF", "DGS3MO", "DGS10", "DGS30", "T10Y3M", "T10YIE", "T5YIFR", "NFCI", "ANFCI", "STLFSI4", "BAMLH0A0HYM2",
        "BAMLC0A4CBBB", "VIXCLS", "DTWEXBGS", "WRESBAL", "ICSA", "CC4WSA", "CPIAUCSL", "UNRATE", "PAYEMS", "CFNAI",
        "UMCSENT", "PERMIT", "MORTGAGE30US",
    ),
}
