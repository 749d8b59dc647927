"""Shared SQL fragments: derived input views as common table expressions."""

from __future__ import annotations


def r6(expr: str, name: str | None = None) -> str:
    """Rounded to six places, without a negative zero."""
    out = f"CASE WHEN round(CAST({expr} AS DOUBLE), 6) = 0 THEN 0.0 ELSE round(CAST({expr} AS DOUBLE), 6) END"
    return f"{out} AS {name}" if name else out


def week(d: str) -> str:
    return f"CAST(({d}) + CAST((12 - isodow({d})) % 7 AS INTEGER) AS DATE)"


def chain(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"


PRICES = """
px AS (
  SELECT CAST(l_shipdate AS DATE) AS d, l_returnflag AS rf, l_linestatus AS ls,
         (l_orderkey * 8 + l_linenumber) * 1048576 + CAST(round(l_extendedprice * 100) AS BIGINT) % 1048576 AS k,
         l_extendedprice / l_quantity AS p, l_quantity AS q
  FROM lineitem),
sym AS (
  SELECT d, k, p, q, CASE rf WHEN 'A' THEN 'SPY' WHEN 'N' THEN 'TLT' WHEN 'R' THEN 'GLD' END AS symbol FROM px
  UNION ALL SELECT d, k, p, q, CASE ls WHEN 'F' THEN 'QQQ' WHEN 'O' THEN '^VIX' END FROM px
  UNION ALL SELECT d, k, p, q, '^TNX' FROM px),
bars AS (
  SELECT d AS date, symbol, arg_min(p, k) AS o, max(p) AS h, min(p) AS l, arg_max(p, k) AS c, sum(q) AS volume,
         CASE symbol WHEN '^VIX' THEN 0.0 WHEN '^TNX' THEN 0.0 ELSE 100.0 END AS off,
         CASE symbol WHEN 'QQQ' THEN 3.0 WHEN '^VIX' THEN 3.0 WHEN '^TNX' THEN 0.5 ELSE 2.0 END AS sc
  FROM sym GROUP BY d, symbol),
prices AS (
  SELECT 'core' AS panel, date, symbol,
         CAST(off AS DOUBLE) + sc * ln(o) AS open, CAST(off AS DOUBLE) + sc * ln(h) AS high,
         CAST(off AS DOUBLE) + sc * ln(l) AS low, CAST(off AS DOUBLE) + sc * ln(c) AS close,
         CAST(off AS DOUBLE) + sc * ln(c) AS adj_close, volume, 'line_items' AS source
  FROM bars)"""

SERIES_META = """
series_meta(series_id, segment, category, frequency, description, suggested_transform, off, sc) AS (
  VALUES ('DFF','AUTOMOBILE','rates','daily','policy rate','level, 5d change', CAST(0.0 AS DOUBLE), CAST(97000.0 AS DOUBLE)),
         ('T10Y3M','BUILDING','rates','daily','curve slope','level, sign, 5d pct change', -2.5, 97000.0),
         ('NFCI','FURNITURE','conditions','weekly','conditions index','level, 4w change, 4w pct change', -2.0, 97000.0),
         ('CPIAUCSL','HOUSEHOLD','prices','monthly','price index','level, 12m pct change, 3m average', 100.0, 48700.0),
         ('UNRATE','MACHINERY','labour','monthly','unemployment','level, log level, 3m change', 0.0, 48700.0))"""

MACRO = SERIES_META + f""",
macro_obs AS (
  SELECT m.series_id, m.category, m.frequency, m.description, m.suggested_transform, m.off, m.sc,
         CASE m.frequency WHEN 'weekly' THEN {week('CAST(o_orderdate AS DATE)')}
                          WHEN 'monthly' THEN CAST(date_trunc('month', o_orderdate) AS DATE)
                          ELSE CAST(o_orderdate AS DATE) END AS date,
         CAST(round(o_totalprice * 100) AS BIGINT) AS cents
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN series_meta m ON m.segment = c_mktsegment),
macro AS (
  SELECT date, series_id, off + (sum(cents) / count(*) / 100) / sc AS value, category, frequency, description,
         suggested_transform, 'orders' AS source
  FROM macro_obs GROUP BY date, series_id, off, sc, category, frequency, description, suggested_transform)"""

ASSETS = ("spy", "tlt", "gld")


def _rolling(agg: str, c: str, n: int) -> str:
    frame = f"OVER (ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({c}) {frame} = {n} THEN {agg}({c}) {frame} END"


def _corr(a: str, b: str) -> str:
    frame = "OVER (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
    x = f"CASE WHEN {b} IS NOT NULL THEN {a} END"
    y = f"CASE WHEN {a} IS NOT NULL THEN {b} END"
    return f"CASE WHEN count({x}) {frame} = 20 THEN corr({x}, {y}) {frame} END"


def _lag(c: str, n: int) -> str:
    return f"lag({c}, {n}) OVER (ORDER BY date)"


def _daily() -> str:
    picks = ", ".join(
        f"max(CASE WHEN symbol = '{s}' THEN {c} END) AS {p}_{c}"
        for s, p in (("SPY", "spy"), ("TLT", "tlt"), ("GLD", "gld"), ("QQQ", "qqq"), ("^VIX", "vix"), ("^TNX", "tnx"))
        for c in ("adj_close", "close", "high", "low", "volume")
    )
    base = ", ".join(
        f"ln({p}_adj_close / {_lag(f'{p}_adj_close', 1)}) AS {p}_ret_1d, ln(1 + {p}_volume) AS {p}_lv" for p in ASSETS
    )
    cols = []
    for p in ASSETS:
        px = f"{p}_adj_close"
        cols += [
            f"{p}_ret_1d",
            f"ln({px} / {_lag(px, 5)}) AS {p}_ret_5d",
            f"ln({px} / {_lag(px, 20)}) AS {p}_ret_20d",
            f"{_rolling('stddev_samp', f'{p}_ret_1d', 5)} AS {p}_vol_5d",
            f"{_rolling('stddev_samp', f'{p}_ret_1d', 20)} AS {p}_vol_20d",
            f"{px} / ({_rolling('max', px, 60)}) - 1 AS {p}_drawdown_60d",
            f"({_rolling('avg', px, 5)}) / ({_rolling('avg', px, 20)}) - 1 AS {p}_ma_gap_5_20",
            f"({p}_high - {p}_low) / {p}_close AS {p}_intraday_range",
            f"({p}_lv - ({_rolling('avg', f'{p}_lv', 20)})) / nullif(({_rolling('stddev_samp', f'{p}_lv', 20)}), 0) AS {p}_volume_z_20",
        ]
    cols += [
        "qqq_spy_log_ratio",
        f"qqq_spy_log_ratio - {_lag('qqq_spy_log_ratio', 5)} AS qqq_spy_ratio_chg_5d",
        f"{_corr('spy_ret_1d', 'tlt_ret_1d')} AS spy_tlt_corr_20d",
        f"{_corr('spy_ret_1d', 'gld_ret_1d')} AS spy_gld_corr_20d",
        "vix_adj_close AS vix_level",
        f"vix_adj_close - {_lag('vix_adj_close', 5)} AS vix_change_5d",
        "tnx_adj_close AS tnx_level",
        f"tnx_adj_close - {_lag('tnx_adj_close', 5)} AS tnx_change_5d",
    ]
    return f"""
wide AS (SELECT date, {picks} FROM prices GROUP BY date),
base AS (SELECT *, {base}, ln(qqq_adj_close / spy_adj_close) AS qqq_spy_log_ratio FROM wide),
daily AS (SELECT 'core' AS panel, date, {', '.join(cols)} FROM base)"""


FEATURES = [
    f"{p}_{f}"
    for p in ASSETS
    for f in ("ret_1d", "ret_5d", "ret_20d", "vol_5d", "vol_20d", "drawdown_60d", "ma_gap_5_20", "intraday_range", "volume_z_20")
] + [
    "qqq_spy_log_ratio", "qqq_spy_ratio_chg_5d", "spy_tlt_corr_20d", "spy_gld_corr_20d",
    "vix_level", "vix_change_5d", "tnx_level", "tnx_change_5d",
]

DAILY = PRICES + "," + _daily()

SPINE = f"""
spine AS (
  SELECT CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 7 DAY)) AS DATE) AS week_end
  FROM (SELECT min({week('date')}) AS lo, max({week('date')}) AS hi FROM prices)),
anchor AS (
  SELECT {week('date')} AS week_end, max(date) AS week_last_trade_date FROM prices WHERE symbol = 'SPY' GROUP BY 1)"""

WEEKLY = DAILY + "," + SPINE + f""",
weekly0 AS (SELECT {week('date')} AS week_end, {', '.join(f'arg_max({c}, date) AS {c}' for c in FEATURES)} FROM daily GROUP BY 1),
market AS (
  SELECT 'core' AS panel, s.week_end, {', '.join(FEATURES)}, a.week_last_trade_date
  FROM spine s LEFT JOIN weekly0 w ON w.week_end = s.week_end LEFT JOIN anchor a ON a.week_end = s.week_end)"""

_FILL = ", ".join(
    f"last_value({p}_c IGNORE NULLS) OVER (ORDER BY week_end ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {p}_f"
    for p in ASSETS
)
TARGETS = f"""
close_w AS (
  SELECT {week('date')} AS week_end, max(date) AS week_last_trade_date,
         {', '.join(f"arg_max(CASE WHEN symbol = '{p.upper()}' THEN adj_close END, CASE WHEN symbol = '{p.upper()}' THEN date END) AS {p}_c" for p in ASSETS)}
  FROM prices GROUP BY 1),
close_d AS (SELECT s.week_end, week_last_trade_date, spy_c, tlt_c, gld_c FROM spine s LEFT JOIN close_w c ON c.week_end = s.week_end),
close_f AS (SELECT *, {_FILL} FROM close_d),
close_r AS (SELECT *, {', '.join(f'{p}_f / lag({p}_f) OVER (ORDER BY week_end) - 1 AS {p}_r' for p in ASSETS)} FROM close_f),
targets AS (
  SELECT 'core' AS panel, week_end, {', '.join(f'{p}_c AS {p}_weekly_close' for p in ASSETS)}, week_last_trade_date,
         {', '.join(f'lead({p}_r) OVER (ORDER BY week_end) AS next_return_{p}' for p in ASSETS)}
  FROM close_r)"""

_SW = "OVER (PARTITION BY series_id ORDER BY date)"
MACRO_T = f"""
macro_t AS (
  SELECT series_id, date, frequency, suggested_transform,
         CASE frequency WHEN 'monthly' THEN CAST(date + INTERVAL 1 MONTH AS DATE) WHEN 'weekly' THEN date + 7 ELSE date END AS effective_date,
         value AS level, ln(CASE WHEN value > 0 THEN value END) AS log_level, CAST(sign(value) AS DOUBLE) AS sign,
         value - lag(value, 5) {_SW} AS chg_5d, value - lag(value, 4) {_SW} AS chg_4w, value - lag(value, 3) {_SW} AS chg_3m,
         value / nullif(lag(value, 5) {_SW}, 0) - 1 AS pct_chg_5d, value / nullif(lag(value, 4) {_SW}, 0) - 1 AS pct_chg_4w,
         value / nullif(lag(value, 12) {_SW}, 0) - 1 AS yoy,
         CASE WHEN count(value) OVER (PARTITION BY series_id ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 3
              THEN avg(value) OVER (PARTITION BY series_id ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) END AS mean_3m
  FROM macro)"""

MACRO_NAMES = {
    "DFF": ("dff", ("level", "chg_5d")),
    "T10Y3M": ("t10y3m", ("level", "sign", "pct_chg_5d")),
    "NFCI": ("nfci", ("level", "chg_4w", "pct_chg_4w")),
    "CPIAUCSL": ("cpi", ("level", "yoy", "mean_3m")),
    "UNRATE": ("unrate", ("level", "log_level", "chg_3m")),
}
MACRO_COLS = [f"{p}_{s}" for p, ss in MACRO_NAMES.values() for s in ss]


def _macro_weekly() -> str:
    asof = []
    for sid, (prefix, suffixes) in MACRO_NAMES.items():
        cols = ", ".join(f"m.{s} AS {prefix}_{s}" for s in suffixes)
        asof.append(
            f"{prefix}_w AS (SELECT c.week_end, {cols} FROM cal c ASOF LEFT JOIN "
            f"(SELECT * FROM macro_t WHERE series_id = '{sid}') m ON c.week_end >= m.effective_date)"
        )
    joins = " ".join(f"JOIN {p}_w USING (week_end)" for p, _ in MACRO_NAMES.values())
    return (
        "cal AS (SELECT s.week_end, a.week_last_trade_date FROM spine s LEFT JOIN anchor a ON a.week_end = s.week_end),\n"
        + ",\n".join(asof)
        + f",\nmacro_w AS (SELECT 'core' AS panel, week_end, week_last_trade_date, {', '.join(MACRO_COLS)} FROM cal {joins})"
    )


MACRO_WEEKLY = MACRO + "," + MACRO_T + "," + _macro_weekly()
TARGET_COLS = [f"{p}_weekly_close" for p in ASSETS] + [f"next_return_{p}" for p in ASSETS]
ALL_STATE = FEATURES + MACRO_COLS + TARGET_COLS
STATE = WEEKLY + "," + TARGETS + "," + MACRO_WEEKLY + f""",
state AS (
  SELECT m.panel, m.week_end, m.week_last_trade_date, {', '.join(ALL_STATE)}
  FROM market m JOIN macro_w w ON m.week_end = w.week_end AND m.week_last_trade_date = w.week_last_trade_date
  JOIN targets t ON m.week_end = t.week_end AND m.week_last_trade_date = t.week_last_trade_date
  WHERE {' AND '.join(f'{c} IS NOT NULL' for c in ALL_STATE)})"""
