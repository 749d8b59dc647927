"""Market, macro and model-state queries."""

from __future__ import annotations

from oracle.common import (
    ALL_STATE, ASSETS, DAILY, FEATURES, MACRO, MACRO_COLS, MACRO_T, MACRO_WEEKLY, PRICES, SPINE, STATE,
    TARGETS, WEEKLY, chain, r6, week,
)


def rows(cols):
    return ", ".join(r6(c, c) for c in cols)


_LONG = " UNION ALL ".join(
    f"SELECT series_id, date, effective_date, '{p}_{s}' AS feature, {r6(s)} AS value FROM macro_t WHERE series_id = '{sid}'"
    for sid, p, ss in (
        ("DFF", "dff", ("level", "chg_5d")),
        ("T10Y3M", "t10y3m", ("level", "sign", "pct_chg_5d")),
        ("NFCI", "nfci", ("level", "chg_4w", "pct_chg_4w")),
        ("CPIAUCSL", "cpi", ("level", "yoy", "mean_3m")),
        ("UNRATE", "unrate", ("level", "log_level", "chg_3m")),
    )
    for s in ss
)

SQL = {
    "price_daily": chain(PRICES)
    + f"SELECT panel, date, symbol, {rows(('open', 'high', 'low', 'close', 'adj_close', 'volume'))}, source FROM prices",
    "macro_panel": chain(MACRO)
    + f"SELECT date, series_id, {r6('value', 'value')}, category, frequency, description, suggested_transform, source FROM macro",
    "market_features_daily": chain(DAILY)
    + f"SELECT panel, date, {rows(FEATURES)}, 'derived_from_prices_daily' AS source FROM daily",
    "market_features_weekly": chain(WEEKLY)
    + f"SELECT panel, week_end, {rows(FEATURES)}, week_last_trade_date, 'resampled_from_market_features_daily' AS source FROM market",
    "weekly_targets": chain(PRICES, SPINE, TARGETS)
    + f"SELECT panel, week_end, week_last_trade_date, {rows([f'{p}_weekly_close' for p in ASSETS] + [f'next_return_{p}' for p in ASSETS])}, 'resampled_from_prices_daily' AS source FROM targets",
    "rebased_prices": chain(PRICES)
    + f"""SELECT d.date, s.symbol, {r6('p.adj_close', 'adj_close')},
          {r6('p.adj_close / first_value(p.adj_close) OVER (PARTITION BY s.symbol ORDER BY d.date) * 100', 'rebased')}
          FROM (SELECT DISTINCT date FROM prices WHERE symbol IN ('SPY','TLT','GLD')) d
          JOIN (VALUES ('SPY'),('TLT'),('GLD')) s(symbol) ON true
          LEFT JOIN prices p ON p.date = d.date AND p.symbol = s.symbol""",
    "macro_transforms": chain(MACRO, MACRO_T) + _LONG,
    "macro_features_weekly": chain(PRICES, SPINE, MACRO_WEEKLY)
    + f"SELECT panel, week_end, week_last_trade_date, {rows(MACRO_COLS)}, 'release_lag_aligned_from_macro_panel' AS source FROM macro_w",
    "model_state": chain(STATE)
    + f"SELECT panel, week_end, week_last_trade_date, {rows(ALL_STATE)}, 'joined_market_macro_targets' AS source FROM state",
    "dropped_weeks": chain(PRICES, SPINE, TARGETS)
    + """SELECT 'core' AS panel, s.week_end, a.week_last_trade_date AS anchor_date, t.week_last_trade_date AS union_date
         FROM spine s LEFT JOIN anchor a ON a.week_end = s.week_end JOIN targets t ON t.week_end = s.week_end
         WHERE a.week_last_trade_date IS DISTINCT FROM t.week_last_trade_date""",
    "dataset_manifest": chain(WEEKLY, TARGETS, MACRO)
    + f"""SELECT 'market_features_weekly' AS dataset_name, count(*) AS n_rows, {len(FEATURES) + 4} AS n_columns,
            least(min(week_end), min(week_last_trade_date)) AS min_date,
            greatest(max(week_end), max(week_last_trade_date)) AS max_date FROM market
          UNION ALL SELECT 'weekly_asset_targets', count(*), 10, least(min(week_end), min(week_last_trade_date)),
            greatest(max(week_end), max(week_last_trade_date)) FROM targets
          UNION ALL SELECT 'macro_panel', count(*), 8, min(date), max(date) FROM macro
          UNION ALL SELECT 'price_daily', count(*), 10, min(date), max(date) FROM prices""",
    "series_summary": chain(MACRO)
    + "SELECT series_id, min(date) AS min_date, max(date) AS max_date, count(*) AS n_rows FROM macro GROUP BY series_id",
    "source_coverage": chain(PRICES, MACRO)
    + """SELECT 'Price Data' AS label, min(date) AS start_date, max(date) AS end_date FROM prices
         UNION ALL SELECT upper(frequency[1]) || frequency[2:] || ' Macro', min(date), max(date) FROM macro GROUP BY frequency
         UNION ALL SELECT 'News Snapshot', min(DATE '1995-01-02' + CAST((doc_id * 37) % 2400 AS INTEGER)),
            max(DATE '1995-01-02' + CAST((doc_id * 37) % 2400 AS INTEGER)) FROM documents""",
    "week_calendar": f"""SELECT DISTINCT {week('CAST(l_shipdate AS DATE)')} AS week_end FROM lineitem
         WHERE {week('CAST(l_shipdate AS DATE)')} BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'""",
    "forward_filled": chain(PRICES)
    + f""", dense AS (SELECT d.date, s.symbol, p.adj_close
            FROM (SELECT DISTINCT date FROM prices) d
            JOIN (VALUES ('SPY'),('TLT'),('GLD'),('QQQ'),('^VIX'),('^TNX')) s(symbol) ON true
            LEFT JOIN prices p ON p.date = d.date AND p.symbol = s.symbol)
          SELECT symbol, date,
            {r6('last_value(adj_close IGNORE NULLS) OVER w', 'filled')},
            CAST(sum(CASE WHEN adj_close IS NULL THEN 1 ELSE 0 END) OVER w AS BIGINT) AS missing_so_far
          FROM dense WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "trade_calendar_intersection": chain(PRICES)
    + """SELECT date FROM prices WHERE symbol = 'SPY' INTERSECT SELECT date FROM prices WHERE symbol = 'TLT'
         INTERSECT SELECT date FROM prices WHERE symbol = 'GLD'""",
    "missing_tickers": chain(PRICES)
    + """SELECT symbol FROM (VALUES ('SPY'),('TLT'),('GLD'),('QQQ'),('^VIX'),('^TNX'),('DIA')) r(symbol)
         WHERE symbol NOT IN (SELECT symbol FROM prices WHERE symbol IS NOT NULL)""",
}
