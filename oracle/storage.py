"""What the stored tables must hold when read back."""

from __future__ import annotations

from oracle import backtest, ingest, market, model

_CORE = "'DFF', 'DGS3MO', 'DGS10', 'T10Y3M', 'T10YIE', 'NFCI', 'BAMLH0A0HYM2', 'VIXCLS', 'DTWEXBGS', 'WRESBAL', 'ICSA', 'UNRATE', 'CPIAUCSL', 'CFNAI', 'UMCSENT', 'PERMIT'"

SQL = {
    "state_invariants": f"""SELECT count(*) AS rows, count(*) FILTER (NOT abs(filtered_prob_regime_0 + filtered_prob_regime_1 - 1) <= 2e-6) AS bad_probabilities,
       count(*) FILTER (regime_filtered IS NULL OR regime_viterbi IS NULL) AS missing_regimes, 0 AS missing_news,
       count(*) FILTER (regime_viterbi NOT IN (0, 1)) AS unknown_regimes, count(*) AS stored_rows, count(DISTINCT year(week_end)) AS parts
       FROM ({model.SQL['model_state_regimes']}) p""",
    "stored_prices": f"SELECT * EXCLUDE (panel) FROM ({market.SQL['price_daily']}) p",
    "stored_macro": f"SELECT * FROM ({market.SQL['macro_panel']}) p WHERE series_id IN ({_CORE})",
    "stored_actions": "SELECT split AS eval_split, week_end, action_id, action_name, reward, portfolio_return, turnover, transaction_cost "
    f"FROM ({backtest.SQL['env_reward_log']}) p",
    "stored_state": model.SQL["model_state_regimes"],
    "stored_upsert": f"SELECT *, 2 AS commits FROM ({ingest.SQL['upsert_rows']}) p",
}
