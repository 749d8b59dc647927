"""Runs, transitions, naming, candidate filters, scores and selection."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from weekpanel.operators import selection as sel
from weekpanel.operators import sequences as seq

WEEK = lambda i: dt.date(2015, 1, 2) + dt.timedelta(days=7 * i)


def labels(spark, **series):
    rows = [(k, WEEK(i), s) for k, states in series.items() for i, s in enumerate(states)]
    return spark.createDataFrame(rows, "e string, week_end date, state int")


def test_runs_and_segments_break_on_nulls(spark):
    df = labels(spark, a=[0, 0, None, 0, 1, 1, 1], b=[2])
    runs = [(r.e, r.state, r.run_length) for r in seq.run_lengths(df, ["e"]).orderBy("e", "run_id").collect()]
    assert runs == [("a", 0, 2), ("a", 0, 1), ("a", 1, 3), ("b", 2, 1)]
    segs = seq.segments(df, ["e"]).orderBy("e", "run_id").collect()
    assert segs[0].drawn_end == WEEK(2) and segs[0].step_days == 7.0
    assert segs[-1].step_days == 7.0  # one week only: default step


def test_run_lengths_sum_to_the_sequence(spark):
    rng = np.random.default_rng(0)
    states = [int(x) for x in rng.integers(0, 3, 200)]
    df = labels(spark, a=states)
    assert seq.run_lengths(df, ["e"]).agg(F.sum("run_length")).first()[0] == 200
    diag = {r.state: r for r in seq.state_diagnostics(df, ["e"]).collect()}
    runs = sum(1 for i, s in enumerate(states) if s == 1 and (i == 0 or states[i - 1] != 1))
    assert diag[1].n_runs == runs and diag[1].avg_duration_wks == pytest.approx(states.count(1) / runs)


def test_transitions_and_occupancy_include_absent_states(spark):
    df = labels(spark, a=[0, 0, 1, 0], b=[1])
    t = {(r.e, r.from_state, r.to_state): r.probability for r in seq.transition_matrix(df, ["e"], 3).collect()}
    assert t[("a", 0, 0)] == 0.5 and t[("a", 1, 0)] == 1.0 and t[("a", 2, 2)] == 0.0 and t[("b", 1, 1)] == 0.0 and len(t) == 18
    occ = {(r.e, r.state): (r.n_weeks, r.pct) for r in seq.occupancy(df, ["e"], 3).collect()}
    assert occ[("a", 2)] == (0, 0.0) and occ[("a", 0)] == (3, 0.75)
    shares = {r.state: r.n for r in seq.value_shares(df, "state", (0, 1, 2)).collect()}
    assert shares == {0: 3, 1: 2, 2: 0}


def test_wide_diagnostics_count_absent_states_as_zero(spark):
    df = labels(spark, a=[0, 0, 1, 0]).withColumn("K", F.lit(3))
    r = seq.wide_diagnostics(df, ["e", "K"], F.col("K"), "dev_").first()
    assert r.dev_n_active_states == 2 and r.dev_min_state_pct == 0.0 and r.dev_max_state_pct == 0.75
    assert r.dev_min_avg_dur_wks == 1.0 and r.s2_dev_n_runs == 0 and r.s3_dev_pct is None


def test_trend_labels(spark):
    rows = [("a", WEEK(i), float(100 * 1.01 ** (i if i < 20 else 40 - i))) for i in range(40)]
    df = spark.createDataFrame(rows, "e string, week_end date, p double")
    out = seq.trend_labels(df, ["e"], "p", lookback=4).orderBy("week_end").collect()
    assert out[0].trend_name is None and out[0].trend_rank is None
    assert out[10].trend_name == "Uptrend" and out[35].trend_name == "Downtrend"


def test_regime_names_fall_back_for_states_unseen_in_training(spark):
    rows = [("a", WEEK(0), 0, 0.01, 10.0), ("a", WEEK(1), 1, -0.02, 30.0), ("a", WEEK(9), 2, 0.05, 5.0)]
    df = spark.createDataFrame(rows, "e string, week_end date, state int, r double, vix double")
    out = {r.state: (r.regime_rank, r.regime_name) for r in seq.regime_names(df, ["e"], 3, "r", ["vix"], F.col("week_end") < F.lit(WEEK(5))).collect()}
    assert out == {1: (0, "Stress"), 0: (1, "Neutral"), 2: (2, "Risk-on")}


def test_zprofile_and_drivers(spark):
    rows = [(s, float(s * 10 + i), float(i)) for s in (0, 1) for i in range(5)]
    df = spark.createDataFrame(rows, "state int, a double, b double")
    z = {(r.state, r.feature): r.z for r in seq.regime_zprofile(df, ["a", "b"]).collect()}
    a = np.array([r[1] for r in rows])
    assert z[(1, "a")] == pytest.approx((a[5:].mean() - a.mean()) / a.std(ddof=1)) and z[(0, "b")] == pytest.approx(0.0)
    top = {r.state: (r.feature, r.direction) for r in seq.top_drivers(seq.regime_zprofile(df, ["a", "b"])).collect()}
    assert top == {0: ("a", "LOW"), 1: ("a", "HIGH")}


def candidate(**changes):
    row = dict(order=1, K=2, failed=False, val_min_state_pct=0.3, val_max_state_pct=0.7, val_min_avg_dur_wks=4.0, min_profile_dist=1.0,
               val_ll_per_step=-1.0, interpretability_score=5, interpretability_tier="Medium")
    for s in range(4):
        row[f"s{s}_dev_pct"] = 0.5 if s < 2 else None
        row[f"s{s}_dev_n_runs"] = 3 if s < 2 else None
    return row | changes


SCHEMA = (
    "order int, K int, failed boolean, val_min_state_pct double, val_max_state_pct double, val_min_avg_dur_wks double, min_profile_dist double, "
    "val_ll_per_step double, interpretability_score int, interpretability_tier string, "
    + ", ".join(f"s{s}_dev_pct double, s{s}_dev_n_runs int" for s in range(4))
)


def test_hard_filters(spark):
    four = {f"s{s}_dev_pct": 0.25 for s in range(4)} | {f"s{s}_dev_n_runs": 3 for s in range(4)}
    rows = [
        candidate(order=1), candidate(order=2, val_min_state_pct=0.049), candidate(order=3, val_min_avg_dur_wks=1.9),
        candidate(order=4, val_max_state_pct=0.86), candidate(order=5, s1_dev_n_runs=1, s1_dev_pct=0.14),
        candidate(order=6, K=4, **four, min_profile_dist=0.2), candidate(order=7, K=4, **(four | {"s3_dev_pct": 0.07})),
        candidate(order=8, failed=True), candidate(order=9, K=4, **four),
    ]
    out = sel.hard_filters(spark.createDataFrame([tuple(r[c.split()[0]] for c in SCHEMA.split(", ")) for r in rows], SCHEMA)).orderBy("order").collect()
    hit = [[f for f in sel.FLAGS if r[f]] for r in out]
    assert hit[:7] == [[], ["filter_collapse"], ["filter_flip_flop"], ["filter_imbalanced"], ["filter_one_shot"], ["filter_k4_redundant"], ["filter_k4_redundant"]]
    assert len(hit[7]) == 5 and hit[8] == [] and out[8].k4_min_profile_dist == 1.0 and out[0].k4_min_profile_dist is None
    counts = sel.rejection_counts(sel.hard_filters(spark.createDataFrame([tuple(r[c.split()[0]] for c in SCHEMA.split(", ")) for r in rows], SCHEMA))).first()
    assert counts.n_candidates == 9 and counts.n_survivors == 2 and counts.n_failed == 1


def test_min_profile_distance(spark):
    rows = [("c", 0, 1.0, 0.0, 0.0), ("c", 1, 3.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "c string, state int, vix_level double, spy_vol_20d double, spy_drawdown_60d double")
    assert sel.min_profile_distance(df, ["c"]).first().min_profile_dist == pytest.approx(2.0)


def test_interpretability_scores(spark):
    summary = spark.createDataFrame(
        [("c", 2, 0, 10.0, 0.1, -0.01, 0.02, 0.001, 0.0, 0.0), ("c", 2, 1, 30.0, 0.1, -0.02, -0.02, 0.0072, 0.0, 0.0)],
        "e string, K int, state int, vix_level double, spy_vol_20d double, spy_drawdown_60d double, spy_ret_20d double, next_return_spy double, next_return_tlt double, next_return_gld double",
    )
    recurring = labels(spark, c=[0, 1, 0, 1, 0, 1, 0, 1])
    r = sel.interpretability(summary, recurring, ["e"], F.col("K")).first()
    assert (r.score_A_profile_separation, r.score_B_naming, r.score_C_temporal, r.score_D_downstream) == (2, 2, 2, 2)
    assert r.interpretability_tier == "High"
    late = sel.interpretability(summary, labels(spark, c=[0] * 9 + [1] + [0] * 2), ["e"], F.col("K")).first()
    assert late.score_C_temporal == 0
    early_late = sel.interpretability(summary, labels(spark, c=[0] * 6 + [1] * 6), ["e"], F.col("K")).first()
    assert early_late.score_C_temporal == 0
    single = sel.interpretability(summary, labels(spark, c=[0, 0, 0, 1, 1, 1, 1, 0]), ["e"], F.col("K")).first()
    assert single.score_C_temporal == 1


def select(spark, rows):
    schema = "order int, K int, failed boolean, passes_hard_filters boolean, val_ll_per_step double, interpretability_score int, interpretability_tier string"
    return sel.select_models(spark.createDataFrame(rows, schema), "order", ("K",))


def test_selection_ties_override_and_fallback(spark):
    tied = select(spark, [(1, 2, False, True, -1.0, 5, "Medium"), (2, 2, False, True, -1.0, 5, "Medium")]).first()
    assert tied.statistical.order == 1 and tied.recommended.order == 1 and "also most" in tied.reason
    over = select(spark, [(1, 2, False, True, -1.0, 5, "Medium"), (2, 3, False, True, -9.0, 6, "High"), (3, 2, False, True, -8.0, 7, "High")])
    row = over.first()
    assert row.interpretable.order == 3 and row.recommended.order == 2 and row.reason.startswith("K=3")
    assert sel.choose_pipeline(over, None, "order").first().role == "project"
    none = select(spark, [(1, 2, False, False, -1.0, 5, "Medium"), (2, 2, True, True, 0.0, 8, "High")])
    assert none.first().recommended is None and none.first().reason == "no survivors"
    backup = over.select(F.col("statistical").alias("chosen"))
    assert sel.choose_pipeline(none, backup, "order").first().role == "fallback"


def test_best_seed_prefers_the_earlier_on_ties(spark):
    df = spark.createDataFrame([("c", 7, 0, -1.0), ("c", 21, 1, -1.0), ("d", 7, 0, -2.0), ("d", 21, 1, -1.0)], "c string, seed int, o int, ll double")
    assert {r.c: r.selected_seed for r in sel.best_seed(df, ["c"], "seed", "ll", "o").collect()} == {"c": 7, "d": 21}
    runs = spark.createDataFrame([(1, False, 1.0, 9.0), (2, True, 5.0, 1.0), (3, True, 5.0, 2.0)], "i int, converged boolean, bic double, avg_dwell double")
    assert sel.best_by_bic(runs, ["i"]).first().i == 3
