"""Observation windows: the last rows of a state, padded at the front."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekpanel.functions.semantics import ordered, trailing


def time_token(position: Column, length: int) -> Column:
    """t-3 ... t-0, oldest first."""
    return F.concat(F.lit("t-"), (F.lit(length - 1) - position).cast("string"))


def state_feature_labels(features: Sequence[str], n_regimes: int, allocations: Sequence[str] | None = None) -> list[str]:
    named = allocations or ["prev_alloc_SPY", "prev_alloc_TLT", "prev_alloc_GLD", "prev_alloc_CASH"]
    return [*features, *[f"regime_prob_{i}" for i in range(n_regimes)], *named]


def observation_arrays(
    df: DataFrame, keys: Sequence[str], order: str, features: str, previous: str, length: int, width: int
) -> DataFrame:
    """``observation``: ``length`` x (features + previous allocation), zero rows in front."""
    recent = F.collect_list(features).over(trailing(ordered(keys, order), length))
    rows = F.transform(recent, lambda x: F.concat(x, F.col(previous)))
    zeros = F.array_repeat(F.array_repeat(F.lit(0.0), width), F.lit(length) - F.size(recent))
    return df.select(*keys, order, F.concat(zeros, rows).alias("observation"))


def observation_windows(
    df: DataFrame, keys: Sequence[str], order: str, features: str, previous: str, length: int,
    feature_names: Sequence[str], allocation_names: Sequence[str],
) -> DataFrame:
    """The same windows as a long table, one row per position."""
    names = [*feature_names, *allocation_names]
    arrays = observation_arrays(df, keys, order, features, previous, length, len(names))
    return arrays.select(*keys, order, F.posexplode("observation").alias("pos", "row")).select(
        *keys, order, "pos", time_token(F.col("pos"), length).alias("token"),
        *[F.col("row")[i].alias(n) for i, n in enumerate(names)],
    )
