"""Component and hidden-Markov queries on the supplier panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekpanel.constants import GRID_COVARIANCES, GRID_SEEDS, GRID_STATES, NEWS_ASSETS
from weekpanel.operators import features as feat
from weekpanel.operators import hmm, hmm_scan, joins, reduction
from weekpanel.operators import news as nw
from weekpanel.operators import stats as st
from weekpanel.plans.market import rounded, state
from weekpanel.plans.news import scored
from weekpanel.plans.sequences import MEASURES, TRAIN_END, panel, seed_runs
from weekpanel.session import cut_lineage
from weekpanel.sources import given

KEYS = ["entity"]
# features the search starts from: the first available one of each group (fixed values)
CURVE = ("t10y3m_level",)
CORE_FEATURES = (("spy_vol_20d",), ("spy_drawdown_60d",), ("vix_level",), ("t10y2y_level", "t10y3m_level", "t10y3m_sign"))
# given parameters of the inference queries
SUPPLIER_MODEL = {
    "start": [0.6, 0.4], "trans": [[0.9, 0.1], [0.2, 0.8]],
    "means": [[4.0, 2.0], [6.0, 3.0]], "covars": [[4.0, 1.5], [5.0, 2.0]],
}
MARKET_MODEL = {
    "start": [0.5, 0.5], "trans": [[0.95, 0.05], [0.1, 0.9]],
    "means": [[0.5, 2.2], [-0.5, 2.6]], "covars": [[4.0, 0.1], [9.0, 0.2]],
}

EVENT_MODEL = {
    "start": [0.5, 0.5], "trans": [[0.98, 0.02], [0.03, 0.97]],
    "means": [[2.0, 1.0], [3.0, 3.0]], "covars": [[1.5, 1.2], [1.0, 0.9]],
}


def supplier_sequences(spark: SparkSession, d: str) -> DataFrame:
    rows = panel(spark, d).select(
        "entity", "week_end", (F.col("avg_discount") * 100).alias("x1"), (F.col("avg_quantity") / 10).alias("x2")
    )
    return hmm.to_sequences(rows, KEYS, "week_end", ["x1", "x2"])


def inferred(spark: SparkSession, d: str) -> DataFrame:
    return hmm.explode_inference(hmm.infer(supplier_sequences(spark, d), KEYS, SUPPLIER_MODEL), KEYS, 2)


def hmm_filter(spark: SparkSession, d: str) -> DataFrame:
    out = inferred(spark, d).select("entity", "week_end", "filtered_prob_regime_0", "filtered_prob_regime_1", "regime_confidence")
    return rounded(out)


def hmm_filter_native(spark: SparkSession, d: str) -> DataFrame:
    seq = hmm.forward_filter_sql(supplier_sequences(spark, d), KEYS, SUPPLIER_MODEL)
    rows = seq.select("entity", F.inline(F.arrays_zip("t", "filtered")))
    return rounded(rows.select(
        "entity", F.col("t").alias("week_end"), *[F.col("filtered")[i].alias(f"filtered_prob_regime_{i}") for i in range(2)]
    ))


def hmm_smooth(spark: SparkSession, d: str) -> DataFrame:
    return rounded(inferred(spark, d).select("entity", "week_end", "smoothed_prob_regime_0", "smoothed_prob_regime_1"))


def hmm_viterbi(spark: SparkSession, d: str) -> DataFrame:
    return inferred(spark, d).select("entity", "week_end", "regime_viterbi")


def hmm_score(spark: SparkSession, d: str) -> DataFrame:
    """Log-likelihood per sequence and per step."""
    out = hmm.infer(supplier_sequences(spark, d), KEYS, SUPPLIER_MODEL)
    return rounded(out.select(
        "entity", F.size("t").alias("n_weeks"), "log_likelihood", (F.col("log_likelihood") / F.size("t")).alias("ll_per_step")
    ))


def long_inference(rows: DataFrame, keys: list[str], order: str, model: dict, bucket) -> DataFrame:
    out = hmm_scan.infer_long(rows, keys, order, ["x1", "x2"], model, bucket)
    return rounded(out.select(
        *keys, order, *[F.col(c)[i].alias(f"{c}_prob_regime_{i}") for c in ("filtered", "smoothed") for i in range(2)],
        F.col("viterbi").alias("regime_viterbi")))


def hmm_chunked(spark: SparkSession, d: str) -> DataFrame:
    """The supplier sequences cut into chunks of two months: filter, smoother and path by the scan."""
    rows = panel(spark, d).select(
        "entity", "week_end", (F.col("avg_discount") * 100).alias("x1"), (F.col("avg_quantity") / 10).alias("x2"))
    return long_inference(rows, KEYS, "week_end", SUPPLIER_MODEL, F.year("week_end") * 6 + F.floor((F.month("week_end") - 1) / 2))


def hmm_long(spark: SparkSession, d: str) -> DataFrame:
    """One sequence per event type: all its events in the order of their ids, however many; 256 ids are one chunk."""
    rows = given.table(spark, d, "events").select(
        "event_type", "event_id", F.log1p("value").alias("x1"), (F.hour("ts") / 6).alias("x2"))
    return long_inference(rows, ["event_type"], "event_id", EVENT_MODEL, F.floor(F.col("event_id") / 256))


def standardized(spark: SparkSession, d: str) -> DataFrame:
    fit = F.col("week_end") <= F.lit(TRAIN_END).cast("date")
    return st.standardize(panel(spark, d).select("entity", "week_end", *MEASURES), MEASURES, fit)


def components(spark: SparkSession, d: str) -> tuple[DataFrame, reduction.Components]:
    z = standardized(spark, d)
    return z, reduction.fit_components(z, MEASURES, F.col("week_end") <= F.lit(TRAIN_END).cast("date"))


def pca_variance(spark: SparkSession, d: str) -> DataFrame:
    return rounded(reduction.variance_table(spark, components(spark, d)[1]))


def pca_loadings(spark: SparkSession, d: str) -> DataFrame:
    return rounded(reduction.loadings_table(spark, components(spark, d)[1]))


def pca_scores(spark: SparkSession, d: str) -> DataFrame:
    z, c = components(spark, d)
    return rounded(reduction.project(z, c, c.choose()).drop(*MEASURES))


def train_validation(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    z, c = components(spark, d)
    scores = reduction.project(z, c, 2)
    train = F.col("week_end") <= F.lit(TRAIN_END).cast("date")
    pick = lambda m: hmm.to_sequences(scores.filter(m), KEYS, "week_end", ["pc1", "pc2"])
    return pick(train), pick(~train)


def hmm_fit(spark: SparkSession, d: str) -> DataFrame:
    train, _ = train_validation(spark, d)
    models = [hmm.Candidate("k2_diag", 2, 2), hmm.Candidate("k3_full", 3, 2, "full", 21, sticky=12.0)]
    return hmm.results_table(spark, hmm.fit(train, models)).drop("error")


def grid_search(spark: SparkSession, d: str) -> DataFrame:
    train, val = train_validation(spark, d)
    found = hmm.grid_search(train, val, hmm.grid(GRID_STATES, (1, 2), GRID_COVARIANCES, GRID_SEEDS))
    return found.drop("startprob", "transmat", "means", "covars", "error")


def greedy_features(spark: SparkSession, d: str) -> DataFrame:
    """Forward selection over the weekly market features that persist, from the core features on, in the training weeks."""
    names = [*feat.market_feature_names(), *CURVE]
    rows = cut_lineage(state(spark, d).select("panel", "week_end", *names).dropna("any").where(F.col("week_end") <= F.lit(TRAIN_END).cast("date")))
    z = cut_lineage(st.standardize(rows, names, F.lit(True)))
    persistent = st.persistent_features(z, ["panel"], names, "week_end")
    _, trace = hmm.greedy_bic(z, ["panel"], "week_end", persistent, CORE_FEATURES)
    return spark.createDataFrame([(i, f, b) for i, (f, b) in enumerate(trace)], "step int, feature string, bic double")


def bic_table(spark: SparkSession, d: str) -> DataFrame:
    """Parameter counts and BIC of the seed runs."""
    runs = seed_runs(spark, d).select(
        "entity", "seed", (2 + F.col("entity") % 3).alias("n_states"), (F.col("seed_order") + 2).alias("n_features"),
        F.when(F.col("entity") % 2 == 0, "diag").otherwise("full").alias("covariance"), (F.col("val_ll") * 100).alias("ll"),
    )
    k = hmm.n_parameters(F.col("n_states"), F.col("n_features"), F.col("covariance")).cast("double")
    return rounded(runs.select("entity", "seed", k.alias("n_parameters"), hmm.bic(F.col("ll"), k, F.lit(300.0)).alias("bic")))


def model_state_regimes(spark: SparkSession, d: str) -> DataFrame:
    """Model state with market regimes and weekly sentiment attached."""
    base = cut_lineage(state(spark, d))  # calendar-sized, used by the labels, the weeks and the join
    rows = base.select("panel", "week_end", (F.col("spy_ret_5d") * 100).alias("x1"), (F.col("vix_level") / 10).alias("x2"))
    seq = hmm.to_sequences(rows, ["panel"], "week_end", ["x1", "x2"])
    regimes = hmm.explode_inference(hmm.infer(seq, ["panel"], MARKET_MODEL), ["panel"], 2)
    labelled = joins.require_probabilities(regimes, ["filtered_prob_regime_0", "filtered_prob_regime_1"])
    weeks = base.select("week_end")
    names = [f"news_finbert_compound_{a.lower()}" for a in NEWS_ASSETS]
    news = weeks.join(nw.compound_pivot(scored(spark, d)), "week_end", "left").fillna(0.0, subset=names)
    merged = joins.assemble_regime_state(base, labelled.drop("regime_confidence"), news)
    return rounded(merged.select(
        "week_end", "spy_ret_5d", "vix_level", "regime_filtered", "regime_viterbi", "filtered_prob_regime_0",
        "filtered_prob_regime_1", *names, "source",
    ))


QUERIES = {
    f.__name__: f
    for f in (
        hmm_filter, hmm_filter_native, hmm_smooth, hmm_viterbi, hmm_score, hmm_chunked, hmm_long, pca_variance, pca_loadings, pca_scores,
        hmm_fit, grid_search, greedy_features, bic_table, model_state_regimes,
    )
}
