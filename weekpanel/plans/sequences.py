"""Regime-sequence queries on the supplier-week panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weekpanel.constants import GRID_COMPONENTS, GRID_COVARIANCES, GRID_SEEDS
from weekpanel.functions.semantics import ratio
from weekpanel.operators import features as feat
from weekpanel.operators import selection as sel
from weekpanel.operators import sequences as seq
from weekpanel.operators.calendar import week_spine
from weekpanel.plans.backtest import week_index
from weekpanel.plans.market import bars, rounded
from weekpanel.session import broadcast_checked, cut_lineage
from weekpanel.sources import given

ENTITY = ("entity",)
STATES = 3
TRAIN_END, DEV_END = "1998-12-31", "2000-12-29"
MEASURES = ("avg_quantity", "avg_discount", "avg_price")


def panel(spark: SparkSession, d: str) -> DataFrame:
    """Supplier weeks with their measures as doubles."""
    return given.supplier_weekly(spark, d).select(
        "entity", "week_end", "state", "n_lines", "discount_points",
        ratio("quantity", "n_lines").alias("avg_quantity"),
        (ratio("discount_points", "n_lines") / 100).alias("avg_discount"),
        (ratio("revenue_cents", "quantity") / 100).alias("avg_price"),
    )


def run_lengths(spark: SparkSession, d: str) -> DataFrame:
    return seq.run_lengths(panel(spark, d), ENTITY)


def segments(spark: SparkSession, d: str) -> DataFrame:
    """On the dense weekly calendar: weeks without lines break a segment."""
    rows = panel(spark, d).select("entity", "week_end", "state")
    dense = week_spine(rows, ENTITY, "week_end").join(rows, ["entity", "week_end"], "left")
    return rounded(seq.segments(dense, ENTITY))


def dwell_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(seq.state_diagnostics(panel(spark, d), ENTITY))


def occupancy(spark: SparkSession, d: str) -> DataFrame:
    return rounded(seq.occupancy(panel(spark, d), ENTITY, STATES))


def transition_matrix(spark: SparkSession, d: str) -> DataFrame:
    return rounded(seq.transition_matrix(panel(spark, d), ENTITY, STATES))


def regime_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(seq.regime_summary(panel(spark, d), ENTITY, MEASURES))


def regime_zprofile(spark: SparkSession, d: str) -> DataFrame:
    return rounded(seq.regime_zprofile(panel(spark, d), MEASURES))


def regime_top_drivers(spark: SparkSession, d: str) -> DataFrame:
    return rounded(seq.top_drivers(seq.regime_zprofile(panel(spark, d), MEASURES)))


def trend_labels(spark: SparkSession, d: str) -> DataFrame:
    out = seq.trend_labels(panel(spark, d), ENTITY, "avg_price")
    return rounded(out.select("entity", "week_end", "trend_score", "trend_rank", "trend_name"))


def regime_naming(spark: SparkSession, d: str) -> DataFrame:
    return rounded(
        seq.regime_names(
            panel(spark, d), ENTITY, STATES, "avg_quantity", ("avg_discount", "avg_price"),
            F.col("week_end") <= F.lit(TRAIN_END).cast("date"),
        )
    )


def action_given_regime(spark: SparkSession, d: str) -> DataFrame:
    """P(action | regime) over supplier weeks, actions by the calendar rule."""
    i = week_index()
    rows = panel(spark, d).select("state", ((i * 5 + F.floor(i / 3)) % 7).cast("int").alias("action_id"))
    return rounded(seq.conditional_share(rows, "state", "action_id"))


def state_shares(spark: SparkSession, d: str) -> DataFrame:
    return rounded(seq.value_shares(panel(spark, d), "state", (0, 1, 2, 3)))


# ---------------------------------------------------------------------------
# candidates: every supplier is one model candidate with K = 2 + supplier mod 3


def n_states() -> Column:
    return (2 + F.col("entity") % 3).cast("int")


def candidate_state() -> Column:
    """Cut points on exact integers, one set per K."""
    p, n, k = F.col("discount_points"), F.col("n_lines"), F.col("K")
    two = F.when(p < 5 * n, 0).otherwise(1)
    three = F.when(p < 4 * n, 0).when(p < 6 * n, 1).otherwise(2)
    four = F.when(2 * p < 7 * n, 0).when(p < 5 * n, 1).when(2 * p < 13 * n, 2).otherwise(3)
    return F.when(k == 2, two).when(k == 3, three).otherwise(four)


def candidate_labels(spark: SparkSession, d: str) -> DataFrame:
    targets = feat.weekly_targets(bars(spark, d)).select(
        "week_end", "next_return_spy", "next_return_tlt", "next_return_gld"
    )
    labelled = (
        panel(spark, d)
        .filter(F.col("week_end") <= F.lit(DEV_END).cast("date"))
        .withColumn("K", n_states())
        .withColumn("state", candidate_state())
        .withColumn("is_val", F.col("week_end") > F.lit(TRAIN_END).cast("date"))
    )
    return labelled.join(broadcast_checked(targets), "week_end", "left").select(
        "entity", "K", "week_end", "state", "is_val", "avg_price",
        F.col("avg_quantity").alias("vix_level"),
        (F.col("avg_price") / 10000).alias("spy_vol_20d"),
        (-F.col("avg_discount")).alias("spy_drawdown_60d"),
        ((F.col("avg_quantity") - 25) / 100).alias("spy_ret_20d"),
        "next_return_spy", "next_return_tlt", "next_return_gld",
    )


PROFILE = ("vix_level", "spy_vol_20d", "spy_drawdown_60d", "spy_ret_20d", *sel.FORWARD)


def candidates(labels: DataFrame) -> DataFrame:
    keys = ("entity", "K")
    k = F.col("K")
    val = seq.wide_diagnostics(labels.filter("is_val"), keys, k, "val_")
    dev = seq.wide_diagnostics(labels, keys, k, "dev_")
    summary = seq.regime_summary(labels, keys, PROFILE)
    distance = sel.min_profile_distance(summary, keys)
    likelihood = labels.groupBy(*keys).agg(
        (-F.avg(F.when(F.col("is_val"), F.col("avg_price"))) / 1000).alias("val_ll_per_step")
    )
    joined = dev.join(val, list(keys), "left").join(distance, list(keys)).join(likelihood, list(keys))
    e = F.col("entity")
    grid = joined.select(
        "*",
        F.element_at(F.array(*[F.lit(x) for x in GRID_COMPONENTS]), (e % 4 + 1).cast("int")).alias("n_pca"),
        F.element_at(F.array(*[F.lit(x) for x in GRID_COVARIANCES]), (e % 2 + 1).cast("int")).alias("cov_type"),
        F.col("val_ll_per_step").isNull().alias("failed"),
        F.when(F.col("val_ll_per_step").isNull(), "no validation weeks").otherwise("").alias("error"),
    )
    flagged = sel.hard_filters(grid)
    scores = sel.interpretability(summary, labels, keys, F.col("K"))
    return sel.survivors_only(flagged, scores, keys)


def grid_table(spark: SparkSession, d: str) -> DataFrame:
    """Labels are materialised once: five aggregates of the candidates read them."""
    return candidates(cut_lineage(candidate_labels(spark, d)))


def label_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    labels = panel(spark, d).withColumn("K", n_states()).withColumn("state", candidate_state())
    return rounded(seq.wide_diagnostics(labels, ("entity", "K"), F.col("K"), "dev_"))


def hard_filters(spark: SparkSession, d: str) -> DataFrame:
    cols = ["entity", "K", *sel.FLAGS, "k4_min_profile_dist", "passes_hard_filters"]
    return rounded(grid_table(spark, d).select(*cols))


def interp_scores(spark: SparkSession, d: str) -> DataFrame:
    return rounded(grid_table(spark, d).select("entity", "K", *sel.SCORES, "interpretability_tier"))


def rejections(spark: SparkSession, d: str) -> DataFrame:
    return sel.rejection_counts(grid_table(spark, d))


def model_selection(spark: SparkSession, d: str) -> DataFrame:
    chosen = sel.select_models(grid_table(spark, d), "entity", ("K", "n_pca", "cov_type"))
    rows = [
        F.struct(F.lit(role).alias("role"), F.col(f"{role}.entity").alias("entity"), F.col(f"{role}.K").alias("K"),
                 F.col(f"{role}.n_pca").alias("n_pca"), F.col(f"{role}.cov_type").alias("cov_type"),
                 F.col(f"{role}.val_ll_per_step").alias("val_ll_per_step"),
                 F.col(f"{role}.interpretability_score").alias("interpretability_score"))
        for role in ("statistical", "interpretable", "k3", "recommended")
    ]
    return rounded(chosen.select(F.inline(F.array(*rows)), "reason"))


def pipeline_choice(spark: SparkSession, d: str) -> DataFrame:
    chosen = sel.select_models(grid_table(spark, d), "entity", ("K", "n_pca", "cov_type"))
    return rounded(sel.choose_pipeline(chosen, None, "entity"))


def seed_runs(spark: SparkSession, d: str) -> DataFrame:
    """Five seed runs per supplier: weeks split by week index mod 5 stand for seeds."""
    seeds = F.array(*[F.lit(s) for s in GRID_SEEDS])
    slot = (week_index() % 5).cast("int")
    return panel(spark, d).groupBy("entity", slot.alias("seed_order")).agg(
        (-F.avg("avg_price") / 1000).alias("val_ll"), F.avg("avg_discount").alias("avg_dwell"),
        (F.max("avg_quantity") > 45).alias("converged"), F.sum("avg_quantity").alias("bic"),
    ).withColumn("seed", F.element_at(seeds, F.col("seed_order") + 1))


def best_seed(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sel.best_seed(seed_runs(spark, d), ENTITY, "seed", "val_ll", "seed_order"))


def best_by_bic(spark: SparkSession, d: str) -> DataFrame:
    runs = seed_runs(spark, d).withColumns({c: F.round(c, 6) for c in ("bic", "avg_dwell", "val_ll")})
    return sel.best_by_bic(runs, ["entity", "seed_order"])


QUERIES = {
    f.__name__: f
    for f in (
        run_lengths, segments, dwell_stats, occupancy, transition_matrix, regime_summary, regime_zprofile,
        regime_top_drivers, trend_labels, regime_naming, action_given_regime, state_shares, label_diagnostics,
        hard_filters, interp_scores, rejections, model_selection, pipeline_choice, best_seed, best_by_bic,
    )
}
