"""Explicit schemas of the input tables."""

from __future__ import annotations

PRICE_DAILY = (
    "date date, symbol string, open double, high double, low double, close double, "
    "adj_close double, volume double, source string"
)
MACRO_PANEL = (
    "date date, series_id string, value double, category string, frequency string, "
    "description string, suggested_transform string, source string"
)
SERIES_META = "series_id string, category string, frequency string, description string, suggested_transform string"
NEWS_EVENTS = (
    "requested_symbol string, news_id string, content_type string, title string, summary string, "
    "published_at timestamp, publisher string, canonical_url string, click_url string, "
    "related_tickers string, query_relevance_heuristic int"
)
# `finance` mixes plain strings and objects: as strings, objects arrive as JSON text.
NEWS_RECORD = (
    "id string, content struct<title: string, summary: string, contentType: string, pubDate: string, "
    "provider: struct<displayName: string>, canonicalUrl: struct<url: string>, "
    "clickThroughUrl: struct<url: string>, finance: array<string>>"
)
NEWS_SCORED = (
    "week_end date, asset string, title string, description string, summary string, publisher string, "
    "finbert_text string, finbert_label string, finbert_score double, finbert_positive double, "
    "finbert_neutral double, finbert_negative double, finbert_compound double"
)
ACTION_LOG = (
    "week_end date, eval_split string, action_id int, action_name string, reward double, "
    "portfolio_return double, turnover double, transaction_cost double"
)
