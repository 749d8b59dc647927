"""Split, policy, back-test and bootstrap queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weekpanel.functions.semantics import ordered
from weekpanel.operators import backtest as bt
from weekpanel.operators import features as feat
from weekpanel.operators import policies as pol
from weekpanel.operators import splits as sp
from weekpanel.operators.bootstrap import bootstrap_sharpe as bootstrap
from weekpanel.operators.calendar import week_end
from weekpanel.operators.windows import observation_windows as windows
from weekpanel.plans.market import bars, rounded, state
from weekpanel.session import broadcast_checked, cut_lineage
from weekpanel.sources import given

SPLIT_NAMES = ("warmup", "train", "validation", "locked_test")
SCENARIOS = 1000


def split_of(c: str = "week_end") -> Column:
    return sp.split_label(c, given.SPLITS)


def weeks(spark: SparkSession, d: str) -> DataFrame:
    return bt.evaluation_weeks(state(spark, d), split_of())


def history(spark: SparkSession, d: str) -> DataFrame:
    return bt.backtest_history(bt.decide(weeks(spark, d), bt.baseline_policies()))


def split_labels(spark: SparkSession, d: str) -> DataFrame:
    """Both split systems on every distinct order date."""
    days = given.table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    return days.select(
        "day", split_of("day").alias("split"), sp.split_label_gapped("day", given.GAPPED_SPLITS).alias("gapped_split")
    )


def split_summary(spark: SparkSession, d: str) -> DataFrame:
    lines = given.table(spark, d, "lineitem").select(week_end(F.col("l_shipdate").cast("date")).alias("week_end"))
    return sp.split_summary(lines.withColumn("split", split_of()))


def feature_blocks(spark: SparkSession, d: str) -> DataFrame:
    market = feat.market_features_weekly(bars(spark, d)).drop("panel")
    return sp.feature_blocks(market, sp.infer_feature_groups(market.columns))


def policy_actions(spark: SparkSession, d: str) -> DataFrame:
    """Momentum and heuristic decisions on weekly features, missing values included."""
    market = feat.market_features_weekly(bars(spark, d))
    momentum = bt.momentum_action("spy_ret_20d", "tlt_ret_20d", "gld_ret_20d")
    heuristic = bt.heuristic_action(
        F.col("vix_level"), F.col("tnx_change_5d"), F.col("spy_ret_20d"), F.col("tlt_ret_20d"),
        F.col("gld_ret_20d"), F.col("spy_drawdown_60d"), F.col("qqq_spy_ratio_chg_5d"),
    )
    return market.select(
        "week_end", momentum.alias("momentum_action"), bt.action_name(momentum).alias("momentum_name"),
        heuristic.alias("heuristic_action"), bt.action_name(heuristic).alias("heuristic_name"),
    )


def backtest_history(spark: SparkSession, d: str) -> DataFrame:
    return rounded(history(spark, d))


def backtest_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(bt.portfolio_metrics(history(spark, d)))


def strategy_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Weekly table with momentum features only (rolling columns may be null)."""
    prices = bars(spark, d)
    joined = feat.market_features_weekly(prices).drop("source", "week_last_trade_date").join(
        feat.weekly_targets(prices).drop("source", "week_last_trade_date"), ["panel", "week_end"]
    )
    usable = joined.dropna("any", subset=["next_return_spy", "next_return_tlt", "next_return_gld"])
    evaluated = usable.select(
        "*", split_of().alias("split"),
        *[F.col(f"next_return_{a}").alias(f"return_{a}") for a in bt.ASSET_KEYS[:3]],
        bt.cash_return("tnx_level").alias("cash_return"),
    )
    policies = {n: c for n, c in bt.baseline_policies().items() if n != "heuristic_regime_proxy"}
    metrics = bt.portfolio_metrics(bt.backtest_history(bt.decide(evaluated, policies)))
    shown = metrics.withColumn("display_name", bt.display_name(F.col("strategy")))
    return rounded(bt.summary_table(shown))


def observation_state(spark: SparkSession, d: str) -> DataFrame:
    return rounded(bt.observation_state(history(spark, d)))


def scenario_weights(weeks_df: DataFrame, n: int = SCENARIOS) -> DataFrame:
    """Synthetic strategies: integer weights by an arithmetic rule per scenario and week."""
    wk = F.datediff("week_end", F.lit("1995-01-06").cast("date")) / 7
    s = F.col("scenario")
    raw = [((s * m + wk.cast("int") * k) % 11 + o).cast("double") for m, k, o in ((3, 1, 1), (5, 2, 0), (7, 3, 0), (2, 5, 0))]
    # a few weeks become very many rows: spread chunks of scenarios before expanding them
    size = max(1, n // 64)
    chunks = weeks_df.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit((n - 1) // size)))).repartition("chunk")
    first = F.col("chunk") * size
    expanded = chunks.withColumn("scenario", F.explode(F.sequence(first, F.least(first + size, F.lit(n)) - 1)))
    return expanded.select(
        "panel", "split", "week_end", *bt.RETURNS,
        F.concat(F.lit("scenario_"), F.lpad(s.cast("string"), 4, "0")).alias("strategy"),
        F.lit(None).cast("int").alias("action_id"), F.lit("precomputed_weights").alias("action_name"),
        bt.coerce_weights(F.array(*raw)).alias("weights"),
    )


def scenario_metrics(spark: SparkSession, d: str) -> DataFrame:
    run = bt.backtest_history(scenario_weights(weeks(spark, d)))
    return rounded(bt.portfolio_metrics(run))


def supplier_mix(spark: SparkSession, d: str) -> DataFrame:
    """Weekly returns beside each supplier's quantity shares by return flag."""
    mix = given.supplier_weekly(spark, d).select(
        F.col("entity").alias("strategy"), "week_end",
        F.array(*[F.col(f"qty_{a}").cast("double") for a in bt.ASSET_KEYS[:3]]).alias("mix"),
    )
    targets = feat.weekly_targets(bars(spark, d)).dropna(
        "any", subset=["next_return_spy", "next_return_tlt", "next_return_gld"]
    ).select("week_end", *[F.col(f"next_return_{a}").alias(f"return_{a}") for a in bt.ASSET_KEYS[:3]])
    return mix.join(broadcast_checked(targets), "week_end").select(
        F.lit(given.PANEL_NAME).alias("panel"), "strategy", split_of().alias("split"), "week_end",
        *bt.RETURNS[:3], F.lit(0.001).alias("cash_return"), bt.coerce_weights(F.col("mix")).alias("weights"),
    )


def supplier_mix_metrics(spark: SparkSession, d: str) -> DataFrame:
    """One strategy per supplier: weekly weights are its quantity shares by return
    flag.  The number of runs grows with the data; each run is calendar-bounded."""
    decided = supplier_mix(spark, d).withColumns(
        {"action_id": F.lit(None).cast("int"), "action_name": F.lit("precomputed_weights")})
    return rounded(bt.portfolio_metrics(bt.backtest_history(decided)))


def trial_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Every supplier's weekly mix as a trial, ranked by its reward in the validation weeks."""
    decided = supplier_mix(spark, d).where("split = 'validation'").withColumns(
        {"action_id": F.lit(None).cast("int"), "action_name": F.lit("precomputed_weights")})
    m = bt.portfolio_metrics(bt.backtest_history(decided))
    trials = cut_lineage(rounded(m.select(
        F.col("strategy").alias("trial"), (F.col("mean_reward") * F.col("weeks")).alias("val_reward"),
        F.col("sharpe_ratio").alias("val_sharpe"), F.col("max_drawdown").alias("val_max_drawdown"))))
    return bt.rank_trials(trials)


# given parameters of the state-reading policies
STOP_LOSS = {"limit": 0.02, "pause": 4}
VOLATILITY_TARGET = 0.004
MOST_TURNOVER = 0.05


def stateful_history(spark: SparkSession, d: str) -> DataFrame:
    """Three policies that read their own portfolio, on the weekly mix of every supplier."""
    weeks_df = supplier_mix(spark, d).select(
        "panel", F.col("strategy").alias("entity"), "split", "week_end", *bt.RETURNS,
        *[F.col("weights")[i].alias(f"mix_{a}") for i, a in enumerate(bt.ASSET_KEYS)])
    rules = [
        pol.stop_loss("stop_loss", "mix_", **STOP_LOSS), pol.volatility_target("volatility_target", "mix_", VOLATILITY_TARGET),
        pol.turnover_limit("turnover_limit", "mix_", MOST_TURNOVER),
    ]
    return pol.run_policies(weeks_df, rules, ("panel", "entity", "split"))


def stop_loss_history(spark: SparkSession, d: str) -> DataFrame:
    out = stateful_history(spark, d).where("strategy = 'stop_loss'")
    return rounded(out.select(
        "entity", "split", "week_end", "action_name", *bt.WEIGHTS, "net_return", "turnover", "portfolio_value", "drawdown"))


def stateful_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(bt.portfolio_metrics(stateful_history(spark, d), ("strategy", "entity", "split")))


def decision_log(spark: SparkSession, d: str) -> DataFrame:
    """A log of action ids in some weeks and weights (three or four) in the others, aligned by key and back-tested."""
    w, i = weeks(spark, d), week_index()
    raw = F.array(*[((i * m) % 7 + o).cast("double") for m, o in ((3, 1), (5, 0), (2, 0), (4, 0))])
    log = w.select(
        "panel", "split", "week_end", F.when(i % 3 == 0, i % 7).cast("int").alias("action_id"),
        F.when(i % 3 != 0, F.when(i % 2 == 0, raw).otherwise(F.slice(raw, 1, 3))).alias("weights"),
        F.when(i % 5 == 0, F.lit("candidate_weights")).alias("action_name"))
    decided = bt.align_decisions(w, log, ("panel", "split", "week_end")).withColumn("strategy", F.lit("decision_log"))
    return rounded(bt.backtest_history(decided).select(
        "split", "week_end", "action_id", "action_name", *bt.WEIGHTS, "turnover", "net_return", "reward", "portfolio_value"))


def bootstrap_sharpe(spark: SparkSession, d: str) -> DataFrame:
    return rounded(bootstrap(history(spark, d), n_boot=300))


def week_index() -> Column:
    return (F.datediff("week_end", F.lit("1995-01-06").cast("date")) / 7).cast("int")


def action_log(spark: SparkSession, d: str) -> DataFrame:
    """Action log of the weeks of the price calendar with a complete target."""
    w = weeks(spark, d)
    i = week_index()
    actions = w.select("panel", "split", "week_end", ((i * 5 + F.floor(i / 3)) % 7).cast("int").alias("action_id"))
    return bt.align_actions(w, actions, ("panel", "split", "week_end"))


def env_reward_log(spark: SparkSession, d: str) -> DataFrame:
    return rounded(bt.environment_rewards(action_log(spark, d)))


def episode_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(bt.episode_metrics(bt.environment_rewards(action_log(spark, d)), ("panel", "split")))


def equity_matrix(spark: SparkSession, d: str) -> DataFrame:
    return rounded(bt.equity_matrix(history(spark, d), tuple(bt.baseline_policies())))


def equity_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    """Equity of next-week returns per asset with missing returns as zero."""
    t = feat.weekly_targets(bars(spark, d))
    long = t.unpivot(["panel", "week_end"], [f"next_return_{a}" for a in ("spy", "tlt", "gld")], "asset", "net_return")
    return rounded(bt.equity_from_returns(long, ("panel", "asset")))


def action_mix(spark: SparkSession, d: str) -> DataFrame:
    return bt.action_mix(history(spark, d), SPLIT_NAMES)


def action_entropy(spark: SparkSession, d: str) -> DataFrame:
    return rounded(bt.action_entropy(history(spark, d), ("strategy", "split")))


def policy_score(spark: SparkSession, d: str) -> DataFrame:
    m = bt.portfolio_metrics(history(spark, d)).withColumn("reward", F.col("mean_reward") * F.col("weeks"))
    return rounded(bt.policy_score(m))


def composite_score(spark: SparkSession, d: str) -> DataFrame:
    m = bt.portfolio_metrics(history(spark, d))
    scored = bt.composite_score(m).select(
        "strategy", "split", "composite_score", bt.display_name(F.col("strategy")).alias("display_name")
    )
    rank = F.row_number().over(ordered(["split"], F.desc("composite_score"), "strategy"))
    return rounded(scored.withColumn("rank_in_split", rank))


def run_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Strategies that look at features against fixed allocations, per split."""
    m = bt.portfolio_metrics(history(spark, d)).select(
        "split", "sharpe_ratio", F.col("mean_reward").alias("reward"),
        F.col("strategy").isin("momentum_rotation_20d", "heuristic_regime_proxy").alias("aware"),
    )
    return rounded(bt.run_comparison(m, ["split"], "aware"))


def observation_windows(spark: SparkSession, d: str) -> DataFrame:
    """Last four weeks of features plus the previous allocation, zero padded."""
    w = weeks(spark, d)
    hist = bt.backtest_history(bt.decide(w, {"momentum_rotation_20d": bt.baseline_policies()["momentum_rotation_20d"]}))
    prev = bt.observation_state(hist).select("week_end", F.array(*[f"prev_weight_{a}" for a in bt.ASSET_KEYS]).alias("prev"))
    features = w.select("panel", "week_end", F.array("spy_ret_5d", "vix_level", "dff_level").alias("x")).join(prev, "week_end")
    return rounded(windows(features, ["panel"], "week_end", "x", "prev", 4, ["spy_ret_5d", "vix_level", "dff_level"],
                           [f"prev_alloc_{a}" for a in bt.ASSET_KEYS]))


QUERIES = {
    f.__name__: f
    for f in (
        split_labels, split_summary, feature_blocks, policy_actions, backtest_history, backtest_metrics,
        strategy_ranking, observation_state, scenario_metrics, supplier_mix_metrics, trial_ranking, stop_loss_history, stateful_metrics,
        decision_log, bootstrap_sharpe,
        env_reward_log, episode_metrics, equity_matrix, equity_rebuilt, action_mix, action_entropy,
        policy_score, composite_score, run_comparison, observation_windows,
    )
}
