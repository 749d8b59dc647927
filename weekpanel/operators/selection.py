"""Candidate filters, interpretability scores and model selection.

Everything is per candidate; picking a model is one combinable aggregate over
all candidates, so their number may grow without a global sort.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekpanel.constants import (
    COLLAPSE_PCT,
    FLIP_FLOP_WEEKS,
    IMBALANCE_PCT,
    K4_PROFILE_DISTANCE,
    K4_SMALL_PCT,
    MAX_STATES,
    ONE_SHOT_PCT,
    TIER_HIGH,
    TIER_MEDIUM,
)
from weekpanel.functions.semantics import whole
from weekpanel.operators.joins import require
from weekpanel.operators.sequences import state_diagnostics

STRESS = ("vix_level", "spy_vol_20d", "spy_drawdown_60d")
FORWARD = ("next_return_spy", "next_return_tlt", "next_return_gld")
FLAGS = ("filter_collapse", "filter_flip_flop", "filter_imbalanced", "filter_one_shot", "filter_k4_redundant")


def min_profile_distance(summary: DataFrame, keys: Sequence[str], columns: Sequence[str] = STRESS, state: str = "state") -> DataFrame:
    """Smallest L2 distance between two states' z-normalised profiles."""
    over = whole(keys)

    def norm(c: str) -> Column:
        sd = F.stddev_pop(c).over(over)
        return (F.col(c) - F.avg(c).over(over)) / F.when(sd > 1e-9, sd).otherwise(1.0)

    z = summary.select(*keys, state, *[norm(c).alias(c) for c in columns])
    wide = z.groupBy(*keys).agg(
        *[F.max(F.when(F.col(state) == k, F.col(c))).alias(f"_{k}_{c}") for k in range(MAX_STATES) for c in columns]
    )
    distances = [
        F.sqrt(sum((F.pow(F.col(f"_{i}_{c}") - F.col(f"_{j}_{c}"), 2) for c in columns), F.lit(0.0)))
        for i, j in combinations(range(MAX_STATES), 2)
    ]
    return wide.select(*keys, F.least(*distances).alias("min_profile_dist"))


def hard_filters(candidates: DataFrame) -> DataFrame:
    """Five rejection flags from validation and development diagnostics.

    Needs K, the val_/dev_ diagnostics, s0..s3 dev columns, min_profile_dist.
    """
    k = F.col("K")
    one_shot = F.lit(False)
    for s in range(MAX_STATES):
        hit = (F.col(f"s{s}_dev_n_runs") == 1) & (F.col(f"s{s}_dev_pct") < ONE_SHOT_PCT) & (k > s)
        one_shot = one_shot | F.coalesce(hit, F.lit(False))
    smallest = F.least(*[F.coalesce(F.col(f"s{s}_dev_pct"), F.lit(0.0)) for s in range(MAX_STATES)])
    close = F.coalesce(F.col("min_profile_dist") < K4_PROFILE_DISTANCE, F.lit(False))
    flags = {
        "filter_collapse": F.col("val_min_state_pct") < COLLAPSE_PCT,
        "filter_flip_flop": F.col("val_min_avg_dur_wks") < FLIP_FLOP_WEEKS,
        "filter_imbalanced": F.col("val_max_state_pct") > IMBALANCE_PCT,
        "filter_one_shot": one_shot,
        "filter_k4_redundant": (k == 4) & ((smallest < K4_SMALL_PCT) | close),
    }
    # a failed candidate keeps a full row: every flag set
    failed = F.coalesce(F.col("failed"), F.lit(False))
    out = candidates.withColumns({n: failed | F.coalesce(c, F.lit(False)) for n, c in flags.items()})
    passes = ~F.col(FLAGS[0])
    for n in FLAGS[1:]:
        passes = passes & ~F.col(n)
    return out.withColumns(
        {"k4_min_profile_dist": F.when((k == 4) & ~failed, F.col("min_profile_dist")), "passes_hard_filters": passes}
    ).drop("min_profile_dist")


def naming_label(vix: Column, median: Column, ret: Column, drawdown: Column) -> Column:
    return (
        F.when((vix < median) & (ret >= 0), "calm")
        .when((vix >= median) & ((ret < 0) | (drawdown < -0.03)), "stress")
        .otherwise("transition")
    )


def score_profile(c: str) -> Column:
    """|max| / |min| of a profile column over at least two states (aggregate)."""
    value = F.abs(F.max(c)) / F.greatest(F.abs(F.min(c)), F.lit(1e-6))
    return F.when(F.count(c) >= 2, value).otherwise(0.0)


def spread(c: str) -> Column:
    return F.when(F.count(c) >= 2, F.max(c) - F.min(c)).otherwise(0.0)


def interpretability(
    summary: DataFrame, labels: DataFrame, keys: Sequence[str], n_states: Column, state: str = "state"
) -> DataFrame:
    """Subscores A-D (0..2 each), their total and tier.

    ``summary``: profile means per (keys, state); ``labels``: dev labels;
    ``n_states`` is an expression over columns of ``summary``.
    """
    over = whole(keys)
    named = summary.withColumn("_median", F.percentile("vix_level", F.lit(0.5)).over(over)).withColumn(
        "_name",
        naming_label(
            F.col("vix_level"), F.col("_median"), F.coalesce("spy_ret_20d", F.lit(0.0)),
            F.coalesce("spy_drawdown_60d", F.lit(0.0)),
        ),
    )
    per = named.groupBy(*keys).agg(
        F.max(n_states).alias("_k"),
        F.greatest(score_profile("vix_level"), score_profile("spy_vol_20d")).alias("_ratio"),
        spread("spy_drawdown_60d").alias("_dd"),
        F.count_if(F.col("_name") == "calm").alias("_calm"),
        F.count_if(F.col("_name") == "stress").alias("_stress"),
        F.count_if(F.col("_name") == "transition").alias("_trans"),
        F.greatest(*[spread(c) for c in FORWARD]).alias("_spread"),
    )
    timing = state_diagnostics(labels, keys, state=state).groupBy(*keys).agg(
        F.max(
            ((F.col("n_runs") == 1) & (F.col("first_start") >= F.floor(F.col("total_weeks") / 2)) & (F.col("pct") < 0.25)).cast("int")
        ).alias("_late"),
        F.max((F.col("in_early") + F.col("in_late") == 2).cast("int")).alias("_both"),
        F.max((F.col("n_runs") == 1).cast("int")).alias("_single"),
    )
    best = F.greatest(
        F.col("_ratio"), F.when(F.col("_dd") > 0.05, 1.6).when(F.col("_dd") > 0.025, 1.25).otherwise(0.0)
    )
    calm, stress, trans = F.col("_calm") >= 1, F.col("_stress") >= 1, F.col("_trans") >= 1
    two = F.when(calm & stress, 2).when(calm | stress, 1).otherwise(0)
    more = F.when(calm & stress & trans, 2).when(calm & stress, 1).otherwise(0)
    scored = per.join(timing, list(keys)).select(
        *keys,
        F.when(best >= 1.5, 2).when(best >= 1.2, 1).otherwise(0).alias("score_A_profile_separation"),
        F.when(F.col("_k") == 2, two).otherwise(more).alias("score_B_naming"),
        F.when(F.col("_late") == 1, 0)
        .when((F.col("_both") == 0) & (F.col("_k") >= 2), 0)
        .when(F.col("_single") == 1, 1)
        .otherwise(2)
        .alias("score_C_temporal"),
        F.when(F.col("_spread") > 0.005, 2).when(F.col("_spread") > 0.002, 1).otherwise(0).alias("score_D_downstream"),
    )
    total = sum((F.col(c) for c in scored.columns if c.startswith("score_")), F.lit(0))
    return with_tier(scored.withColumn("interpretability_score", total))


def with_tier(df: DataFrame) -> DataFrame:
    s = F.col("interpretability_score")
    return df.withColumn(
        "interpretability_tier", F.when(s >= TIER_HIGH, "High").when(s >= TIER_MEDIUM, "Medium").otherwise("Low")
    )


SCORES = (
    "score_A_profile_separation", "score_B_naming", "score_C_temporal", "score_D_downstream", "interpretability_score",
)


def survivors_only(candidates: DataFrame, scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Scores count for survivors; everyone else gets zeros and the low tier."""
    ok = F.col("passes_hard_filters")
    joined = candidates.join(scores.drop("interpretability_tier"), list(keys), "left")
    return with_tier(joined.withColumns({c: F.when(ok, F.coalesce(c, F.lit(0))).otherwise(0) for c in SCORES}))


def tier_rank(tier: Column) -> Column:
    return F.when(tier == "High", 2).when(tier == "Medium", 1).otherwise(0)


def rejection_counts(candidates: DataFrame) -> DataFrame:
    return candidates.agg(
        F.count("*").alias("n_candidates"),
        F.count_if("failed").alias("n_failed"),
        F.count_if("passes_hard_filters").alias("n_survivors"),
        *[F.count_if(f).alias(f"n_{f}") for f in FLAGS],
    )


def best_seed(runs: DataFrame, keys: Sequence[str], seed: str, value: str, order: str) -> DataFrame:
    """Best validation likelihood per candidate; the earlier seed wins ties."""
    key = F.struct(F.col(value), -F.col(order))
    return runs.groupBy(*keys).agg(F.max_by(seed, key).alias("selected_seed"), F.max(value).alias(value))


def best_by_bic(candidates: DataFrame, order: Sequence[str]) -> DataFrame:
    """Converged first, then lowest BIC, then longest dwell."""
    return candidates.orderBy(
        F.col("converged").desc(), F.col("bic").asc(), F.col("avg_dwell").desc(), *order
    ).limit(1)


def select_models(candidates: DataFrame, grid_order: str, columns: Sequence[str]) -> DataFrame:
    """Best statistical, interpretable and K=3 candidates and the recommendation.

    Three conditional max_by in one aggregate; on ties the earlier grid row wins.
    """
    ok = F.col("passes_hard_filters") & ~F.coalesce(F.col("failed"), F.lit(False))
    row = F.struct(*columns, grid_order, "val_ll_per_step", "interpretability_score", "interpretability_tier")
    first = -F.col(grid_order)
    by_ll = F.struct("val_ll_per_step", first)
    by_score = F.struct("interpretability_score", "val_ll_per_step", first)
    picked = candidates.agg(
        F.max_by(row, F.when(ok, by_ll)).alias("statistical"),
        F.max_by(row, F.when(ok, by_score)).alias("interpretable"),
        F.max_by(row, F.when(ok & (F.col("K") == 3), by_score)).alias("k3"),
    )
    override = F.coalesce(
        tier_rank(F.col("k3.interpretability_tier")) > tier_rank(F.col("statistical.interpretability_tier")), F.lit(False)
    ) & F.col("k3").isNotNull()
    same = F.col(f"interpretable.{grid_order}") == F.col(f"statistical.{grid_order}")
    return picked.withColumn(
        "recommended", F.when(F.col("interpretable").isNull(), None).when(override, F.col("k3")).otherwise(F.col("interpretable"))
    ).withColumn(
        "reason",
        F.when(F.col("interpretable").isNull(), "no survivors")
        .when(override, "K=3 has a higher tier than the best likelihood")
        .when(same, "best likelihood is also most interpretable")
        .otherwise("most interpretable survivor"),
    )


def choose_pipeline(selected: DataFrame, fallback: DataFrame | None, grid_order: str) -> DataFrame:
    """Recommended, else best statistical, else the first committed fallback row.

    ``fallback`` holds at most one row (a committed configuration).
    """
    own = selected.select(
        F.coalesce("recommended", "statistical").alias("chosen"),
        F.when(F.col("recommended").isNotNull(), "project").when(F.col("statistical").isNotNull(), "statistical").alias("role"),
        F.lit(0).alias("_priority"),
    ).filter(F.col("chosen").isNotNull())
    frames = own if fallback is None else own.unionByName(
        fallback.select("chosen", F.lit("fallback").alias("role"), F.lit(1).alias("_priority"))
    )
    first = frames.orderBy("_priority").limit(1)
    # the grid must yield a configuration: no survivor and no fallback fails the job
    any_row = first.agg(F.first("role").alias("role"), F.first("chosen").alias("chosen"))
    return require(any_row, F.col("role").isNotNull(), "no surviving candidate and no fallback").select("role", "chosen.*")
