"""Moving-block bootstrap of a run's excess returns.

Block starts come from an arithmetic hash of (replicate, block, seed), so every
engine draws the same samples.  A run is one array of weekly returns (bounded by
the calendar); replicates are exploded next to it and no samples are shuffled.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekpanel.constants import NEAR_ZERO, PERIODS_PER_YEAR
from weekpanel.functions.semantics import finite
from weekpanel.operators.backtest import RUN, guarded_ratio

# metric functions of this module travel to the workers by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed values of the draw: h = (A*rep + B*block + C*seed + D) mod M.
A, B, C, D, M = 1103515245, 40692, 69621, 12345, 2147483647


def draw_start(rep: Column, block: Column, seed: int, n_starts: Column) -> Column:
    h = (rep * A + block * B + seed * C + D) % M
    return (h * 48271 % M) % n_starts


def run_arrays(history: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """One row per run: its finite excess returns in week order."""
    x = finite("net_return") - finite("cash_return")
    pairs = F.sort_array(F.collect_list(F.struct("week_end", F.col("_x").alias("x"))))
    return (
        history.withColumn("_x", x)
        .filter(F.col("_x").isNotNull())
        .groupBy(*keys)
        .agg(pairs.alias("_p"))
        .select(*keys, F.transform("_p", lambda s: s["x"]).alias("x"))
    )


def _prefix(values: Column) -> Column:
    """[0, v0, v0+v1, ...]"""
    return F.aggregate(
        values, F.array(F.lit(0.0)), lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1) + v))
    )


def bootstrap_sharpe(
    history: DataFrame,
    keys: Sequence[str] = RUN,
    n_boot: int = 500,
    alpha: float = 0.05,
    seed: int = 7,
    block_size: int = 4,
    periods: int = PERIODS_PER_YEAR,
) -> DataFrame:
    """Percentile interval of the Sharpe ratio, computed inside the JVM.

    Prefix sums give each block's sum and sum of squares in constant time.
    """
    runs = run_arrays(history, keys).withColumns(
        {
            "n": F.size("x"),
            "s1": _prefix(F.col("x")),
            "s2": _prefix(F.transform("x", lambda v: v * v)),
        }
    ).withColumn("b", F.greatest(F.lit(1), F.least(F.lit(block_size), "n")))
    reps = runs.withColumn("rep", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_boot - 1).cast("bigint"))))
    n, b = F.col("n"), F.col("b")
    blocks = F.sequence(F.lit(0), (F.ceil(n / b) - 1).cast("int"))

    def add(acc, k):
        start = draw_start(F.col("rep"), k.cast("bigint"), seed, (n - b + 1).cast("bigint")).cast("int")
        size = F.least(b, n - k * b)
        cut = lambda s: F.element_at(s, start + size + 1) - F.element_at(s, start + 1)
        return F.struct((acc["a"] + cut(F.col("s1"))).alias("a"), (acc["q"] + cut(F.col("s2"))).alias("q"))

    def sharpe(m):
        mean = m["a"] / n
        return guarded_ratio(mean, F.sqrt(F.greatest(F.lit(0.0), m["q"] / n - mean * mean)), periods)

    # the finish function sees the finished moments once, not once per use
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("q"))
    values = reps.select(*keys, F.aggregate(blocks, zero, add, sharpe).alias("v"))
    bounds = F.percentile("v", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    return values.groupBy(*keys).agg(bounds.alias("ci")).select(
        *keys, F.col("ci")[0].alias("sharpe_ratio_ci_low"), F.col("ci")[1].alias("sharpe_ratio_ci_high")
    )


def sharpe_rows(samples: np.ndarray, periods: int = PERIODS_PER_YEAR) -> np.ndarray:
    """Row-wise Sharpe of a (replicates, weeks) matrix."""
    mean, spread = samples.mean(axis=1), samples.std(axis=1)
    flat = np.where(np.abs(mean) <= NEAR_ZERO, 0.0, np.nan)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(spread > NEAR_ZERO, mean / spread * np.sqrt(periods), flat)


def bootstrap_metric(
    history: DataFrame,
    metric: Callable[[np.ndarray], np.ndarray] = sharpe_rows,
    keys: Sequence[str] = RUN,
    n_boot: int = 500,
    alpha: float = 0.05,
    seed: int = 7,
    block_size: int = 4,
) -> DataFrame:
    """Interval of a user metric: a function of the replicate matrix of one run."""
    a, b, c, d, m = A, B, C, D, M

    @F.pandas_udf("ci_low double, ci_high double")
    def interval(runs: pd.Series) -> pd.DataFrame:
        out = []
        for x in runs:
            n = len(x)
            size = max(1, min(block_size, n))
            k = np.arange(-(-n // size), dtype=np.int64)
            rep = np.arange(n_boot, dtype=np.int64)[:, None]
            h = (rep * a + k[None, :] * b + seed * c + d) % m
            start = (h * 48271 % m) % (n - size + 1)
            index = (start[:, :, None] + np.arange(size)).reshape(n_boot, -1)[:, :n]
            values = metric(np.asarray(x, dtype=float)[index])
            values = values[np.isfinite(values)]
            out.append(np.quantile(values, [alpha / 2, 1 - alpha / 2]) if len(values) else (np.nan, np.nan))
        return pd.DataFrame(out, columns=["ci_low", "ci_high"])

    return run_arrays(history, keys).select(*keys, interval("x").alias("ci")).select(*keys, "ci.ci_low", "ci.ci_high")
