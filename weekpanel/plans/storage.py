"""Queries that write given tables with the sinks and read them back with the readers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekpanel.operators import invariants, joins
from weekpanel.plans import backtest, model
from weekpanel.plans.market import rounded
from weekpanel.plans.news import articles
from weekpanel.session import checkpoint_dir, cut_lineage
from weekpanel.sources import given, readers, sinks, store


def folder(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/tables-{uuid.uuid4().hex}"


def stored_prices(spark: SparkSession, d: str) -> DataFrame:
    """Daily prices written as CSV and read with their schema and required tickers."""
    names = ["date", "symbol", "open", "high", "low", "close", "adj_close", "volume", "source"]
    path = sinks.write_tables({"prices": given.price_daily(spark, d).select(*names)}, folder(spark), csv=True)["prices"]
    return rounded(readers.load_prices(spark, path, given.PRICE_SCALE).select(*names))


def stored_macro(spark: SparkSession, d: str) -> DataFrame:
    """The macro panel written as Parquet, found behind a path that does not exist; series of a named selection."""
    path = sinks.write_tables({"macro": given.macro_panel(spark, d)}, folder(spark))["macro"]
    found = readers.first_existing(spark, [f"{path}-absent", path])
    return rounded(readers.select_series(readers.load_macro(spark, found), "core"))


def stored_actions(spark: SparkSession, d: str) -> DataFrame:
    """The action log in its exchange layout, partitioned by split, read back with its header checked."""
    log = backtest.bt.environment_rewards(backtest.action_log(spark, d)).withColumnRenamed("split", "eval_split")
    path = sinks.write_action_log(log, folder(spark))["action_log"]
    back = readers.strip_headers(spark.read.parquet(path))
    return rounded(back.select("eval_split", "week_end", "action_id", "action_name", "reward", "portfolio_return", "turnover", "transaction_cost"))


def stored_state(spark: SparkSession, d: str) -> DataFrame:
    """News features, regimes and merged state written as one pipeline output; the state read back."""
    state = cut_lineage(model.model_state_regimes(spark, d))  # calendar-sized, written three times, computed once
    news = state.select("week_end", *[c for c in state.columns if c.startswith("news_")])
    regimes = state.select("week_end", "regime_filtered", "regime_viterbi", "filtered_prob_regime_0", "filtered_prob_regime_1")
    paths = sinks.write_pipeline(news, regimes, state, folder(spark))
    return spark.read.parquet(paths["merged_state"])


def stored_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Earliest articles published by year, then upserted with the latest ones, twice; the last commit and its number."""
    columns = ["asset", "week_end", "title", "summary", "url"]
    base = articles(spark, d).select(*columns)
    table, year = folder(spark), F.year("week_end")
    store.publish(joins.keep_first(base, ["asset", "week_end"], ["url"]).select(*columns), table, year)
    new = joins.keep_last(base, ["asset", "week_end"], ["url"]).select(*columns)
    store.upsert(new, table, ["asset", "week_end"], year)
    commit = store.upsert(new, table, ["asset", "week_end"], year)  # changes nothing
    return store.read(spark, table).select(*columns, F.lit(commit.number).alias("commits"))


def state_invariants(spark: SparkSession, d: str) -> DataFrame:
    """What the run that publishes the merged state by year measured of it: rows, and rows that break each invariant."""
    state = model.model_state_regimes(spark, d)
    probabilities = ["filtered_prob_regime_0", "filtered_prob_regime_1"]
    news = [c for c in state.columns if c.startswith("news_")]
    checks = {
        "bad_probabilities": invariants.sums_to_one(probabilities, 2e-6), "missing_regimes": invariants.complete(["regime_filtered", "regime_viterbi"]),
        "missing_news": invariants.complete(news), "unknown_regimes": F.col("regime_viterbi").isin(0, 1),
    }
    table, seen = invariants.observed(state, checks)
    commit = store.publish(table, folder(spark), F.year("week_end"), checks)
    counts = invariants.verify(seen)
    row = [(counts["rows"], *[counts[c] for c in checks], sum(n for _, n, _ in commit.parts.values()), len(commit.parts))]
    return spark.createDataFrame(row, "rows long, " + ", ".join(f"{c} long" for c in checks) + ", stored_rows long, parts int")


QUERIES = {f.__name__: f for f in (state_invariants, stored_prices, stored_macro, stored_actions, stored_state, stored_upsert)}
