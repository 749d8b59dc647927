"""State assembly, coverage checks and table invariants."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekpanel.session import broadcast_checked

STATE_KEYS = ("panel", "week_end", "week_last_trade_date")


def model_state(
    market: DataFrame, macro: DataFrame, targets: DataFrame, keys: Sequence[str] = STATE_KEYS
) -> DataFrame:
    """Market, macro and target weeks that agree on both date keys, complete rows only."""
    parts = [t.drop("source") for t in (market, macro, targets)]
    joined = reduce(lambda a, b: a.join(b, list(keys), "inner"), parts)
    return joined.dropna("any").withColumn("source", F.lit("joined_market_macro_targets"))


def dropped_weeks(market: DataFrame, targets: DataFrame, keys: Sequence[str] = ("panel", "week_end")) -> DataFrame:
    """Weeks whose two definitions of the last trade date disagree."""
    return (
        market.select(*keys, F.col("week_last_trade_date").alias("anchor_date"))
        .join(targets.select(*keys, F.col("week_last_trade_date").alias("union_date")), list(keys))
        .filter(~F.col("anchor_date").eqNullSafe(F.col("union_date")))
    )


def with_news(state: DataFrame, news_weekly: DataFrame) -> DataFrame:
    """Left join of weekly news and the flag that says whether a week has any."""
    news = news_weekly.drop("source")
    news_cols = [c for c in news.columns if c != "week_end"]
    present = F.coalesce(*[F.col(c).cast("string") for c in news_cols]).isNotNull()
    return (
        state.drop("source")
        .join(news, "week_end", "left")
        .withColumn("has_news_features", present.cast("int"))
        .withColumn("source", F.lit("joined_market_macro_targets_news"))
    )


def recent_full(state_full: DataFrame) -> DataFrame:
    return state_full.filter(F.col("has_news_features") == 1)


def coverage(base: DataFrame, features: DataFrame, columns: Sequence[str], key: str = "week_end") -> DataFrame:
    """Missing counts per feature column over the base calendar, and its range."""
    merged = base.select(key).join(features.select(key, *columns), key, "left")
    complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    return merged.agg(
        F.count("*").alias("base_rows"),
        F.count_if(complete).alias("covered_rows"),
        F.min(key).alias("first_week"),
        F.max(key).alias("last_week"),
        *[F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in columns],
    )


def require(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """Row-level guard: the job fails with ``message`` at the first bad row.

    The check is a filter, so it survives column pruning by later operators.
    """
    return df.filter(F.when(condition, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def require_probabilities(df: DataFrame, columns: Sequence[str], tolerance: float = 1e-6) -> DataFrame:
    total = reduce(lambda a, b: a + b, [F.col(c) for c in columns])
    return require(df, F.abs(total - 1.0) <= tolerance, "probabilities do not sum to 1")


def require_members(df: DataFrame, column: str, known: Sequence) -> DataFrame:
    """Fail on values outside a fixed vocabulary."""
    return require(df, F.col(column).isin(*known), f"unknown value in {column}")


def missing_members(df: DataFrame, column: str, required: DataFrame) -> DataFrame:
    """Required values that never occur (anti join)."""
    return required.join(df.select(column).distinct(), column, "left_anti")


def require_coverage(base: DataFrame, features: DataFrame, columns: Sequence[str], key: str = "week_end") -> DataFrame:
    """``base`` with the feature columns; a row of the base calendar without all of them fails the job."""
    merged = base.join(unique_keys(features.select(key, *columns), key), key, "left")
    return require(merged, reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns]), "missing feature values")


def unique_keys(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` of one row per key; a repeated key fails the job (one combinable aggregate)."""
    rest = [c for c in df.columns if c not in keys]
    one = df.groupBy(*keys).agg(F.count("*").alias("_n"), F.first(F.struct(*rest)).alias("_row"))
    return require(one, F.col("_n") == 1, "repeated key").select(*keys, "_row.*")


def assemble_regime_state(
    state: DataFrame, regimes: DataFrame, news: DataFrame, key: str = "week_end"
) -> DataFrame:
    """State + regime labels + news sentiment; a week without either fails the job."""
    regime_cols = [c for c in regimes.columns if c.startswith(("regime_", "filtered_prob_"))]
    news_cols = [c for c in news.columns if c != key]
    # one row per week on the right sides, so the row count of the state is kept
    right = [unique_keys(regimes.select(key, *regime_cols), key), unique_keys(news, key)]
    merged = state.drop("source").join(right[0], key, "left").join(right[1], key, "left")
    complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*regime_cols, *news_cols]])
    return require(merged, complete, "missing regime or news values").withColumn(
        "source", F.lit("joined_market_macro_targets_regimes_news")
    )


def upsert(new: DataFrame, old: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keep the old row when it has a summary and the new one lacks title or summary."""
    values = [c for c in new.columns if c not in keys]
    n, o = new.alias("n"), old.alias("o")

    def empty(c: Column) -> Column:
        return F.coalesce(c, F.lit("")) == ""

    keep_old = ~empty(F.col("o.summary")) & (empty(F.col("n.title")) | empty(F.col("n.summary")))
    joined = n.join(o, list(keys), "left")
    return joined.select(*keys, *[F.when(keep_old, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in values])


def first_source(frames: Sequence[DataFrame], entity: str) -> DataFrame:
    """Fallback chain: per entity, all rows of the first source that has it.

    The winning priority is a small aggregate joined back, so an entity with
    very many rows is never gathered into one window partition.
    """
    tagged = reduce(
        DataFrame.unionByName, [f.withColumn("_priority", F.lit(i)) for i, f in enumerate(frames)]
    )
    best = broadcast_checked(tagged.groupBy(entity).agg(F.min("_priority").alias("_best")))
    return tagged.join(best, entity).filter(F.col("_priority") == F.col("_best")).drop("_priority", "_best")


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the last in ``order`` (a combinable aggregate, not a window)."""
    rest = [c for c in df.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(last).select(*keys, "_row.*")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(first).select(*keys, "_row.*")


def stack_rows(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def common_keys(frames: Sequence[DataFrame], key: str) -> DataFrame:
    """Index intersection of several tables."""
    return reduce(lambda a, b: a.join(b.select(key).distinct(), key, "left_semi"), frames[1:], frames[0].select(key).distinct())
