"""The regime chain on the weekly market state: scale, components, fits, selection, labels of the whole sample."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekpanel.constants import GRID_COMPONENTS, GRID_COVARIANCES, GRID_SEEDS, GRID_STATES, MAX_STATES
from weekpanel.operators import features as feat
from weekpanel.operators import hmm, joins, reduction
from weekpanel.operators import selection as sel
from weekpanel.operators import sequences as seq
from weekpanel.operators import stats as st
from weekpanel.plans.market import rounded, state
from weekpanel.plans.sequences import DEV_END, PROFILE, TRAIN_END
from weekpanel.session import cut_lineage

PANEL = ["panel"]
KEYS = ("candidate", "K")
COLUMNS = ("candidate", "K", "n_pca", "cov_type", "seed")


def upto(day: str):
    return F.col("week_end") <= F.lit(day).cast("date")


def prepared(base: DataFrame) -> DataFrame:
    """Components of the state (scaled and fitted on the training weeks only)."""
    names = feat.market_feature_names()
    whole = base.select("panel", "week_end", *names).dropna("any")
    scaled = cut_lineage(st.standardize(whole, names, upto(TRAIN_END)))
    parts = reduction.fit_components(scaled, names, upto(TRAIN_END), max(GRID_COMPONENTS))
    scores = reduction.project(scaled, parts, max(GRID_COMPONENTS))
    return cut_lineage(scores.select("panel", "week_end", *[f"pc{i + 1}" for i in range(max(GRID_COMPONENTS))]))


def sequences_of(scores: DataFrame, rows) -> DataFrame:
    return hmm.to_sequences(scores.where(rows), PANEL, "week_end", [c for c in scores.columns if c.startswith("pc")])


_grids: dict[tuple[str, str], tuple] = {}


def content(df: DataFrame) -> tuple:
    """Rows and two sums of their hashes: the same for the same rows in any order."""
    row = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    return tuple(df.agg(F.count("*"), *[F.sum(F.xxhash64(F.lit(salt), row).cast("decimal(38,0)")) for salt in (0, 1)]).first())


def fitted_grid(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, dict]:
    """(state, component scores, results with the best seed per configuration, fits by name).

    Every call reads the given tables. The grid is fitted once per application, data folder and content of the state: all
    tables lie in the checkpoint folder, parameters with them, and are used again while the state is the same.
    """
    place = (spark.sparkContext.applicationId, d)
    base = cut_lineage(state(spark, d))
    found = content(base)
    if place not in _grids or _grids[place][0] != found:
        scores = prepared(base)
        grid = hmm.grid(GRID_STATES, GRID_COMPONENTS, GRID_COVARIANCES, GRID_SEEDS)
        fitted = hmm.fit(sequences_of(scores, upto(TRAIN_END)), grid)
        validation = hmm.score(sequences_of(scores, ~upto(TRAIN_END) & upto(DEV_END)), fitted)
        results = cut_lineage(hmm.ranked_seeds(hmm.results_table(spark, fitted, validation), grid))
        _grids[place] = found, (base, scores, results, {f.candidate.name: f for f in fitted})
    return _grids[place][1]


def judged(base: DataFrame, scores: DataFrame, results: DataFrame, fits: dict) -> DataFrame:
    """One row per configuration (its best seed): diagnostics, filters and scores of its labels."""
    best = [r.candidate for r in results.where("is_best_seed").select("candidate").collect()]  # bounded by the grid
    labels = hmm.infer_many(sequences_of(scores, upto(DEV_END)), PANEL, [fits[n] for n in best])
    sizes = results.select("candidate", F.col("n_states").alias("K"))
    facts = base.select("panel", "week_end", *PROFILE)
    rows = cut_lineage(
        labels.join(sizes, "candidate").join(facts, ["panel", "week_end"]).select(
            *KEYS, "week_end", F.col("regime_viterbi").alias("state"), (~upto(TRAIN_END)).alias("is_val"), *PROFILE))
    rows = joins.require_members(rows, "state", tuple(range(MAX_STATES)))
    k = F.col("K")
    summary = seq.regime_summary(rows, KEYS, PROFILE)
    table = results.where("is_best_seed").select(
        "candidate", k_of("n_states"), F.col("n_features").alias("n_pca"), F.col("covariance").alias("cov_type"), "seed", "grid_order",
        "n_iterations", "converged", "log_likelihood", "bic", "val_ll_per_step", "failed", "error")
    joined = table
    for part in (seq.wide_diagnostics(rows, KEYS, k, "dev_"), seq.wide_diagnostics(rows.where("is_val"), KEYS, k, "val_"), sel.min_profile_distance(summary, KEYS)):
        joined = joined.join(part, list(KEYS), "left")
    return sel.survivors_only(sel.hard_filters(joined), sel.interpretability(summary, rows, KEYS, k), KEYS)


def k_of(column: str):
    return F.col(column).cast("int").alias("K")


def regime_pipeline_candidates(spark: SparkSession, d: str) -> DataFrame:
    """All configurations of the grid with fit, diagnostics, filters and scores."""
    table = judged(*fitted_grid(spark, d))
    return rounded(table.select(
        *COLUMNS, "n_iterations", "converged", "log_likelihood", "bic", "val_ll_per_step", "failed", *sel.FLAGS, "passes_hard_filters",
        *sel.SCORES, "interpretability_tier"))


def chosen_model(table: DataFrame) -> DataFrame:
    """The choice; without any survivor the likeliest converged fit stands in as the committed configuration."""
    usable = table.where("not failed").select(F.struct(*COLUMNS, "grid_order", "val_ll_per_step", "interpretability_score", "interpretability_tier").alias("chosen"))
    backup = usable.agg(F.max_by("chosen", F.struct("chosen.val_ll_per_step", -F.col("chosen.grid_order"))).alias("chosen"))
    return sel.choose_pipeline(sel.select_models(table, "grid_order", COLUMNS), backup, "grid_order")


def regime_pipeline_choice(spark: SparkSession, d: str) -> DataFrame:
    return rounded(chosen_model(judged(*fitted_grid(spark, d))).drop("grid_order"))


def regime_full_sample(spark: SparkSession, d: str) -> DataFrame:
    """Labels and filtered probabilities of all weeks under the chosen model, with its metadata."""
    base, scores, results, fits = fitted_grid(spark, d)
    choice = chosen_model(judged(base, scores, results, fits)).first()
    fitted = fits[choice.candidate]
    labels = hmm.infer_many(sequences_of(scores, F.lit(True)), PANEL, [fitted])
    wide = labels.select(
        "panel", "week_end", "regime_filtered", "regime_viterbi", *[F.col("filtered")[i].alias(f"filtered_prob_regime_{i}") for i in range(fitted.candidate.n_states)],
        F.array_max("filtered").alias("regime_confidence"))
    return rounded(hmm.with_model_metadata(wide, fitted, choice.role, f"chosen as {choice.role}"))


QUERIES = {f.__name__: f for f in (regime_pipeline_candidates, regime_pipeline_choice, regime_full_sample)}
