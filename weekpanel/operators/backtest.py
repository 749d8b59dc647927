"""Policies, weekly back-tests and portfolio metrics as one relational plan.

A policy is a column that yields a decision (action id, weights, name) for each
week; many policies are evaluated by exploding an array of decisions, so no
strategy table is joined.  All windows are keyed by panel, strategy and split:
the rows of one task are bounded by the weeks of the calendar.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekpanel.constants import (
    ACTION_TEMPLATES,
    DISPLAY_NAMES,
    INITIAL_CAPITAL,
    NEAR_ZERO,
    PERIODS_PER_YEAR,
    RISK_PENALTY,
    RISK_WINDOW,
    TRANSACTION_COST,
)
from weekpanel.functions.semantics import col, finite, ordered, ratio, so_far, trailing, whole
from weekpanel.operators.joins import require
from weekpanel.session import broadcast_checked

ASSET_KEYS = ("spy", "tlt", "gld", "cash")
WEIGHTS = tuple(f"w_{a}" for a in ASSET_KEYS)
RETURNS = ("return_spy", "return_tlt", "return_gld", "cash_return")
RUN = ("panel", "strategy", "split")
ACTION_IDS = {name: i for i, name, _ in ACTION_TEMPLATES}


# ---------------------------------------------------------------------------
# decisions


def template_weights(action_id: Column) -> Column:
    table = F.array(*[F.array(*[F.lit(x) for x in w]) for _, _, w in ACTION_TEMPLATES])
    return F.element_at(table, (action_id + 1).cast("int"))


def template_name(action_id: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for _, n, _ in ACTION_TEMPLATES]), (action_id + 1).cast("int"))


def action_name(action_id: Column) -> Column:
    """Name of an action id; unknown ids fail the job."""
    known = action_id.between(0, len(ACTION_TEMPLATES) - 1)
    return F.when(known, template_name(action_id)).otherwise(
        F.raise_error(F.concat(F.lit("unknown action "), F.coalesce(action_id.cast("string"), F.lit("null"))))
    )


def coerce_weights(weights: Column) -> Column:
    """Append zero cash to three weights, reject invalid ones, normalise."""
    n = F.size(weights)
    parts = [F.get(weights, F.lit(i)) for i in range(3)] + [F.when(n == 3, 0.0).otherwise(F.get(weights, F.lit(3)))]
    total = parts[0] + parts[1] + parts[2] + parts[3]
    fail = lambda m: F.raise_error(F.lit(m)).cast("array<double>")
    return (
        F.when(~n.isin(3, 4), fail("weights must have three or four entries"))
        .when(F.least(*parts) < -NEAR_ZERO, fail("weights must be non-negative"))
        .when(total <= 0, fail("weights must sum to a positive number"))
        .otherwise(F.array(*[p / total for p in parts]))
    )


def decide_action(action_id: Column) -> Column:
    a = action_id.cast("int")
    return F.struct(a.alias("action_id"), template_weights(a).alias("weights"), action_name(a).alias("action_name"))


def decide_weights(weights: Column, name: str = "custom_weights") -> Column:
    return F.struct(
        F.lit(None).cast("int").alias("action_id"), coerce_weights(weights).alias("weights"), F.lit(name).alias("action_name")
    )


def resolve(action_id: Column, weights: Column, name: Column) -> Column:
    """Decision resolution: the action wins, else weights, else an error."""
    return (
        F.when(action_id.isNotNull(), decide_action(action_id))
        .when(
            weights.isNotNull(),
            F.struct(
                F.lit(None).cast("int").alias("action_id"), coerce_weights(weights).alias("weights"),
                F.coalesce(name, F.lit("custom_weights")).alias("action_name"),
            ),
        )
        .otherwise(
            F.struct(
                F.lit(None).cast("int").alias("action_id"),
                F.raise_error(F.lit("a decision needs an action or weights")).cast("array<double>").alias("weights"),
                F.lit(None).cast("string").alias("action_name"),
            )
        )
    )


def fixed_action(name: str) -> Column:
    return decide_action(F.lit(ACTION_IDS[name]))


def equal_weight() -> Column:
    return decide_weights(F.array(*[F.lit(1.0 / 3.0)] * 3, F.lit(0.0)))


def momentum_action(spy: Column | str, tlt: Column | str, gld: Column | str) -> Column:
    """Best positive momentum; earlier assets win ties; no SPY value means cash."""
    spy, tlt, gld = finite(spy), finite(tlt), finite(gld)
    low = F.lit(float("-inf"))
    t, g = F.coalesce(tlt, low), F.coalesce(gld, low)
    best = F.greatest(spy, t, g)
    return (
        F.when(spy.isNull() | (best <= 0), ACTION_IDS["cash_only"])
        .when(spy == best, ACTION_IDS["spy_only"])
        .when(t == best, ACTION_IDS["tlt_only"])
        .otherwise(ACTION_IDS["gld_only"])
    )


def heuristic_action(
    vix: Column, curve: Column, spy: Column, tlt: Column, gld: Column, drawdown: Column, qqq_change: Column
) -> Column:
    """Six ordered rules; a comparison with a missing value is false."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    beats = yes(gld > spy) & (tlt.isNull() | yes(gld > tlt))
    return (
        F.when(yes(drawdown <= -0.12) | yes(vix >= 30), ACTION_IDS["defensive_20_60_20"])
        .when(yes(curve < 0) & yes(vix >= 20), ACTION_IDS["tlt_only"])
        .when(beats & yes(vix >= 22), ACTION_IDS["gld_only"])
        .when(yes(spy > 0) & yes(qqq_change >= 0) & yes(vix < 20), ACTION_IDS["spy_80_tlt_20"])
        .when(yes(tlt > spy) & yes(curve <= 0), ACTION_IDS["defensive_20_60_20"])
        .otherwise(ACTION_IDS["balanced_60_30_10"])
    )


def baseline_policies_without_features() -> dict[str, Column]:
    policies = {name: fixed_action(name) for _, name, _ in ACTION_TEMPLATES}
    policies["equal_weight_spy_tlt_gld"] = equal_weight()
    return policies


def baseline_policies() -> dict[str, Column]:
    policies = baseline_policies_without_features()
    policies["momentum_rotation_20d"] = decide_action(momentum_action("spy_ret_20d", "tlt_ret_20d", "gld_ret_20d"))
    policies["heuristic_regime_proxy"] = decide_action(
        heuristic_action(
            F.col("vix_level"), F.col("t10y3m_level"), F.col("spy_ret_20d"), F.col("tlt_ret_20d"),
            F.col("gld_ret_20d"), F.col("spy_drawdown_60d"), F.col(RATIO_CHANGE),
        )
    )
    return policies


RATIO_CHANGE = "qqq_spy_ratio_chg_5d"


def decide(weeks: DataFrame, policies: dict[str, Column]) -> DataFrame:
    """One row per week and policy; an absent ratio change counts as 0."""
    if RATIO_CHANGE not in weeks.columns:
        weeks = weeks.withColumn(RATIO_CHANGE, F.lit(0.0))
    decisions = F.array(
        *[F.struct(F.lit(name).alias("strategy"), d.alias("decision")) for name, d in policies.items()]
    )
    return weeks.select("*", F.inline(decisions)).select(
        "*", "decision.action_id", "decision.action_name", F.col("decision.weights").alias("weights")
    ).drop("decision")


def cash_return(level: Column | str) -> Column:
    return F.coalesce(col(level), F.lit(0.0)) / 100 / PERIODS_PER_YEAR


def evaluation_weeks(state: DataFrame, split: Column) -> DataFrame:
    """Model state with split labels and the four realised returns."""
    return state.select(
        "*",
        split.alias("split"),
        *[F.col(f"next_return_{a}").alias(f"return_{a}") for a in ASSET_KEYS[:3]],
        cash_return("dff_level").alias("cash_return"),
    )


def align_log(weeks: DataFrame, log: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Attach columns of a decision log to its weeks by key; a log and a calendar that do not cover each other exactly, or a
    log with two rows for a week, fail the job instead of shifting rows."""
    tagged_w = weeks.withColumn("_week", F.lit(True))
    one = log.groupBy(*keys).agg(F.count("*").alias("_action"), *[F.any_value(c).alias(c) for c in columns])
    both = tagged_w.join(one, list(keys), "full")
    return require(both, F.col("_week").isNotNull() & F.coalesce(F.col("_action") == 1, F.lit(False)), "decision log does not match the weeks").drop(
        "_week", "_action"
    )


def align_actions(weeks: DataFrame, actions: DataFrame, keys: Sequence[str] = ("split", "week_end")) -> DataFrame:
    """Weeks with the action ids of a log."""
    return align_log(weeks, actions, keys, ["action_id"])


def align_decisions(weeks: DataFrame, log: DataFrame, keys: Sequence[str] = ("split", "week_end")) -> DataFrame:
    """Weeks with the decisions of a log of action ids, weights (arrays of three or four) and names: per row the action
    wins, else the weights, else the job fails."""
    aligned = align_log(weeks, log, keys, ["action_id", "weights", "action_name"])
    decision = resolve(F.col("action_id"), F.col("weights"), F.col("action_name"))
    return aligned.withColumn("_d", decision).select(
        *weeks.columns, "_d.action_id", "_d.action_name", F.col("_d.weights").alias("weights"))


# ---------------------------------------------------------------------------
# history


def backtest_history(
    decided: DataFrame,
    keys: Sequence[str] = RUN,
    cost: float = TRANSACTION_COST,
    penalty: float = RISK_PENALTY,
    window: int = RISK_WINDOW,
    capital: float = INITIAL_CAPITAL,
) -> DataFrame:
    """Weekly profit and loss, equity and drawdown of every run.

    Three dependent window steps share one partitioning and order: one
    exchange, one sort.
    """
    w = ordered(keys, "week_end")
    spread = decided.select(
        *keys, "week_end", "action_id", "action_name", *RETURNS,
        *[F.col("weights")[i].alias(c) for i, c in enumerate(WEIGHTS)],
    )
    start = dict(zip(WEIGHTS, (0.0, 0.0, 0.0, 1.0)))
    moved = sum((F.abs(F.col(c) - F.lag(c, 1, start[c]).over(w)) for c in WEIGHTS), F.lit(0.0))
    gross = sum((F.col(a) * F.col(r) for a, r in zip(WEIGHTS, RETURNS)), F.lit(0.0))
    flows = (
        spread.withColumns({"gross_return": gross, "turnover": moved * 0.5})
        .withColumn("transaction_cost", F.col("turnover") * cost)
        .withColumn("net_return", F.col("gross_return") - F.col("transaction_cost"))
    )
    equity = flows.withColumns(
        {
            "risk_proxy": F.coalesce(F.stddev_pop("net_return").over(trailing(w, window)), F.lit(0.0)),
            "portfolio_value": F.product(1 + F.col("net_return")).over(so_far(w)) * capital,
        }
    )
    return (
        equity.withColumn("reward", F.col("net_return") - F.col("risk_proxy") * penalty)
        .withColumn("peak_value", F.greatest(F.lit(capital), F.max("portfolio_value").over(so_far(w))))
        .withColumn("drawdown", F.col("portfolio_value") / F.col("peak_value") - 1)
    )


def observation_state(history: DataFrame, keys: Sequence[str] = RUN, window: int = RISK_WINDOW) -> DataFrame:
    """What a policy sees before it decides: previous weights, drawdown so far
    and the volatility of past returns without the current week."""
    w = ordered(keys, "week_end")
    start = dict(zip(WEIGHTS, (0.0, 0.0, 0.0, 1.0)))
    past = w.rowsBetween(-window, -1)
    return history.select(
        *keys, "week_end",
        *[F.lag(c, 1, start[c]).over(w).alias(f"prev_weight_{c[2:]}") for c in WEIGHTS],
        F.lag("drawdown", 1, 0.0).over(w).alias("portfolio_drawdown"),
        F.when(F.count("net_return").over(past) > 1, F.stddev_pop("net_return").over(past))
        .otherwise(0.0)
        .alias("portfolio_volatility"),
    )


# ---------------------------------------------------------------------------
# metrics


def guarded_ratio(mean: Column, spread: Column, periods: int) -> Column:
    """Annualised mean over spread; 0/NULL when the spread vanishes."""
    flat = F.when(F.abs(mean) <= NEAR_ZERO, F.lit(0.0))
    return F.when(spread > NEAR_ZERO, mean / spread * F.sqrt(F.lit(float(periods)))).when(mean.isNotNull(), flat)


def portfolio_metrics(history: DataFrame, keys: Sequence[str] = RUN, periods: int = PERIODS_PER_YEAR) -> DataFrame:
    """Fifteen metrics per run in one aggregation over finite values."""
    net, cash = finite("net_return"), finite("cash_return")
    clean = history.select(
        *keys, "week_end",
        net.alias("r"), (net - cash).alias("x"),
        *[finite(c).alias(c) for c in ("reward", "portfolio_value", "drawdown", "turnover", "transaction_cost")],
    )
    sums = clean.groupBy(*keys).agg(
        F.count("*").alias("weeks"),
        F.max_by("portfolio_value", F.when(F.col("portfolio_value").isNotNull(), F.col("week_end"))).alias("_last"),
        F.product(1 + F.col("r")).alias("_growth"),
        F.count("r").alias("_n"),
        F.stddev_pop("r").alias("_vol"),
        F.avg("x").alias("mean_excess_return"),
        F.stddev_pop("x").alias("_xvol"),
        F.stddev_pop(F.when(F.col("x") < 0, F.col("x"))).alias("_down"),
        F.min("drawdown").alias("max_drawdown"),
        F.avg("turnover").alias("average_turnover"),
        F.sum("transaction_cost").alias("total_transaction_cost"),
        F.avg((F.col("r") > 0).cast("int")).alias("win_rate"),
        F.avg("reward").alias("mean_reward"),
    )
    mean = F.col("mean_excess_return")
    root = F.sqrt(F.lit(float(periods)))
    annual = F.when(F.col("_growth") > 0, F.pow("_growth", periods / F.col("_n")) - 1)
    return sums.withColumn("annualized_return", annual).select(
        *keys,
        F.col("weeks").cast("double").alias("weeks"),
        (F.col("_last") - 1).alias("cumulative_return"),
        "annualized_return",
        (F.col("_vol") * root).alias("annualized_volatility"),
        "mean_excess_return",
        (mean * periods).alias("annualized_excess_return"),
        (F.col("_xvol") * root).alias("annualized_excess_volatility"),
        guarded_ratio(mean, F.col("_xvol"), periods).alias("sharpe_ratio"),
        guarded_ratio(mean, F.col("_down"), periods).alias("sortino_ratio"),
        "max_drawdown",
        F.when(F.col("max_drawdown") < 0, F.col("annualized_return") / F.abs("max_drawdown")).alias("calmar_ratio"),
        "average_turnover", "total_transaction_cost", "win_rate", "mean_reward",
    )


def summary_table(metrics: DataFrame) -> DataFrame:
    return metrics.orderBy(F.desc_nulls_last("sharpe_ratio"), F.desc_nulls_last("annualized_return"))


def rank_trials(trials: DataFrame, trial: str = "trial", score: str = "val_reward") -> DataFrame:
    """Trials by falling score (missing ones last, then in trial order), the best flagged: the earliest of equal scores."""
    best = trials.where(F.col(score).isNotNull() & ~F.isnan(score)).agg(F.max_by(F.col(trial), F.struct(F.col(score), -F.col(trial))).alias("t")).first().t
    flagged = trials.withColumn("is_best", F.coalesce(F.col(trial) == F.lit(best), F.lit(False)))
    return flagged.orderBy(F.when(F.isnan(score), None).otherwise(F.col(score)).desc_nulls_last(), trial)


def display_name(strategy: Column) -> Column:
    expr = F.initcap(F.replace(strategy, F.lit("_"), F.lit(" ")))
    for name, shown in DISPLAY_NAMES.items():
        expr = F.when(strategy == name, F.lit(shown)).otherwise(expr)
    return expr


def equity_from_returns(returns: DataFrame, keys: Sequence[str], value: str = "net_return") -> DataFrame:
    """Equity rebuilt from returns; missing returns count as zero."""
    w = so_far(ordered(keys, "week_end"))
    return returns.withColumn("equity", F.product(1 + F.coalesce(F.col(value), F.lit(0.0))).over(w))


def equity_matrix(history: DataFrame, strategies: Sequence[str], keys: Sequence[str] = ("panel", "split")) -> DataFrame:
    """One equity column per strategy, forward filled over the weeks of a split."""
    picks = [F.max(F.when(F.col("strategy") == s, F.col("portfolio_value"))).alias(s) for s in strategies]
    wide = history.groupBy(*keys, "week_end").agg(*picks)
    w = so_far(ordered(keys, "week_end"))
    filled = wide.select(*keys, "week_end", *[F.last(s, ignorenulls=True).over(w).alias(s) for s in strategies])
    return filled.dropna("all", subset=list(strategies))


# ---------------------------------------------------------------------------
# environment rewards and episodes


def environment_rewards(
    log: DataFrame,
    keys: Sequence[str] = ("panel", "split"),
    asset_keys: Sequence[str] = ("panel",),
    cost: float = TRANSACTION_COST,
    incentive: float = 0.0,
    penalty: float = RISK_PENALTY,
    lookback: int = RISK_WINDOW,
) -> DataFrame:
    """Reward of each logged action: return, turnover terms and a diagonal
    volatility penalty over the last ``lookback`` asset rows of any split."""
    assets = ordered(asset_keys, "week_end")
    run = ordered(keys, "week_end")
    vols = {
        f"_v{i}": F.when(F.row_number().over(assets) >= lookback, F.stddev_pop(r).over(trailing(assets, lookback)))
        for i, r in enumerate(RETURNS)
    }
    start = dict(zip(WEIGHTS, (0.0, 0.0, 0.0, 1.0)))
    spread = log.withColumns(vols).withColumn("weights", template_weights(F.col("action_id"))).withColumns(
        {c: F.col("weights")[i] for i, c in enumerate(WEIGHTS)}
    )
    variance = sum((F.pow(F.col(c), 2) * F.pow(F.col(f"_v{i}"), 2) for i, c in enumerate(WEIGHTS)), F.lit(0.0))
    moved = sum((F.abs(F.col(c) - F.lag(c, 1, start[c]).over(run)) for c in WEIGHTS), F.lit(0.0))
    out = spread.withColumns(
        {
            "portfolio_return": sum((F.col(a) * F.col(r) for a, r in zip(WEIGHTS, RETURNS)), F.lit(0.0)),
            "turnover": moved / 2,
            "volatility": F.coalesce(F.sqrt(variance), F.lit(0.0)),
        }
    )
    return out.withColumn("transaction_cost", F.col("turnover") * cost).select(
        *keys, "week_end", "action_id", action_name(F.col("action_id")).alias("action_name"),
        (
            F.col("portfolio_return") - F.col("transaction_cost") + F.col("turnover") * incentive
            - F.col("volatility") * penalty
        ).alias("reward"),
        "portfolio_return", "turnover", "transaction_cost", "volatility",
    )


def episode_metrics(steps: DataFrame, keys: Sequence[str], periods: int = PERIODS_PER_YEAR) -> DataFrame:
    """Episode figures: raw statistics and their log-space, overflow-safe twins."""
    w = so_far(ordered(keys, "week_end"))
    r = finite("portfolio_return")
    clipped = F.greatest(r, F.lit(-0.999999))
    prepared = steps.withColumns({"_r": r, "_c": clipped}).withColumns(
        {"_log": F.sum(F.log1p("_c")).over(w), "_cum": F.product(1 + F.col("_r")).over(w)}
    )
    peaks = prepared.withColumns({"_lpeak": F.max("_log").over(w), "_cpeak": F.max("_cum").over(w)})
    root = F.sqrt(F.lit(float(periods)))
    grouped = peaks.groupBy(*keys).agg(
        F.count("*").alias("length"),
        F.sum("reward").alias("reward"),
        F.avg("reward").alias("avg_reward"),
        F.sum("_r").alias("total_return"),
        F.avg("_r").alias("avg_return"),
        F.stddev_pop("_r").alias("std_return"),
        F.min((F.col("_cum") - F.col("_cpeak")) / (F.col("_cpeak") + 1e-8)).alias("raw_max_drawdown"),
        F.sum(F.log1p("_c")).alias("_total"),
        F.avg("_c").alias("_mean"),
        F.stddev_pop("_c").alias("_std"),
        F.min(F.exp(F.col("_log") - F.col("_lpeak")) - 1).alias("max_drawdown"),
    )
    return grouped.select(
        *keys, "length", "reward", "avg_reward", "total_return", "avg_return", "std_return",
        (F.col("avg_return") / (F.col("std_return") + 1e-8) * root).alias("raw_sharpe_ratio"),
        "raw_max_drawdown",
        F.expm1(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), "_total"))).alias("cumulative_return"),
        "max_drawdown",
        F.when(F.col("_std") > 0, F.col("_mean") / F.col("_std") * root).alias("sharpe_ratio"),
    )


# ---------------------------------------------------------------------------
# action statistics and scores


def action_mix(log: DataFrame, splits: Sequence[str], keys: Sequence[str] = ("strategy",)) -> DataFrame:
    counts = [F.count_if(F.col("split") == s).alias(s) for s in splits]
    return log.groupBy(*keys, "action_name").agg(*counts)


def action_entropy(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    counts = log.groupBy(*keys, "action_name").agg(F.count("*").alias("n"))
    total = F.sum("n").over(whole(keys))
    p = ratio("n", total)
    return counts.withColumn("p", p).groupBy(*keys).agg(
        (-F.sum(F.col("p") * F.ln(F.col("p") + NEAR_ZERO))).alias("action_entropy")
    )


def policy_score(metrics: DataFrame, policy: str = "strategy") -> DataFrame:
    """Weighted score per policy and split, and the best policy of each split."""
    scored = metrics.groupBy(policy, "split").agg(
        *[F.avg(c).alias(c) for c in ("sharpe_ratio", "cumulative_return", "reward", "max_drawdown")]
    ).withColumn(
        "score",
        0.45 * F.col("sharpe_ratio") + 0.35 * F.col("cumulative_return")
        + 0.10 * F.col("reward") + 0.10 * F.col("max_drawdown"),
    )
    order = F.when(F.col("score").isNotNull(), F.struct(-F.col("score"), F.col(policy)))
    best = scored.groupBy("split").agg(F.min_by(policy, order).alias("_best"))
    joined = scored.join(broadcast_checked(best), "split")
    return joined.withColumn("is_best", F.coalesce((F.col(policy) == F.col("_best")).cast("int"), F.lit(0))).drop("_best")


def composite_score(metrics: DataFrame) -> DataFrame:
    score = F.col("sharpe_ratio") + 0.5 * F.col("cumulative_return") - 0.5 * F.abs("max_drawdown")
    return metrics.withColumn("composite_score", score).filter(F.col("composite_score").isNotNull())


def run_comparison(runs: DataFrame, keys: Sequence[str], flag: str) -> DataFrame:
    """Aware against naive runs: reward mean and spread, Sharpe, improvement."""
    aware, naive = F.col(flag), ~F.col(flag)
    out = runs.groupBy(*keys).agg(
        F.avg(F.when(aware, F.col("reward"))).alias("aware_mean_reward"),
        F.stddev_pop(F.when(aware, F.col("reward"))).alias("aware_std_reward"),
        F.avg(F.when(naive, F.col("reward"))).alias("naive_mean_reward"),
        F.stddev_pop(F.when(naive, F.col("reward"))).alias("naive_std_reward"),
        F.avg(F.when(aware, F.col("sharpe_ratio"))).alias("aware_mean_sharpe"),
        F.avg(F.when(naive, F.col("sharpe_ratio"))).alias("naive_mean_sharpe"),
    )
    gain = (F.col("aware_mean_reward") - F.col("naive_mean_reward")) / (F.abs("naive_mean_reward") + 1e-8)
    return out.withColumn("improvement", gain)
