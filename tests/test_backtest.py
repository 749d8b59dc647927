"""Policies, history, metrics, rewards and bootstrap against plain numpy."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from weekpanel.operators import backtest as bt
from weekpanel.operators import splits as sp
from weekpanel.operators.bootstrap import bootstrap_metric, bootstrap_sharpe
from weekpanel.operators.windows import observation_windows, state_feature_labels

D = dt.date
WEEK = lambda i: D(2015, 1, 2) + dt.timedelta(days=7 * i)


def weeks(spark, n=30, seed=0, split="test"):
    rng = np.random.default_rng(seed)
    rows = [("p", split, WEEK(i), *[float(x) for x in rng.normal(0, 0.02, 3)], 0.0005) for i in range(n)]
    return spark.createDataFrame(rows, "panel string, split string, week_end date, return_spy double, return_tlt double, return_gld double, cash_return double")


def numpy_run(pdf, weights):
    prev, value, peak, nets, out = np.array([0, 0, 0, 1.0]), 1.0, 1.0, [], []
    for (_, r), w in zip(pdf.iterrows(), weights):
        gross = float(w @ r[["return_spy", "return_tlt", "return_gld", "cash_return"]].to_numpy(float))
        turnover = 0.5 * np.abs(w - prev).sum()
        net = gross - 0.001 * turnover
        nets.append(net)
        risk = float(np.std(nets[-12:])) if len(nets[-12:]) > 1 else 0.0
        value *= 1 + net
        peak = max(peak, value)
        out.append((gross, turnover, net, risk, net - 0.05 * risk, value, peak, value / peak - 1))
        prev = w
    return np.array(out)


def test_history_matches_a_row_loop(spark):
    w = weeks(spark)
    i = F.datediff("week_end", F.lit("2015-01-02").cast("date")) / 7
    out = bt.backtest_history(bt.decide(w, {"cycle": bt.decide_action((i % 7).cast("int"))})).orderBy("week_end").toPandas()
    table = {a: np.array(x) for a, _, x in bt.ACTION_TEMPLATES}
    want = numpy_run(out, [table[k % 7] for k in range(30)])
    got = out[["gross_return", "turnover", "net_return", "risk_proxy", "reward", "portfolio_value", "peak_value", "drawdown"]].to_numpy(float)
    np.testing.assert_allclose(got, want, atol=1e-12)
    assert out.action_name[1] == "spy_only" and set(out.strategy) == {"cycle"}
    seen = bt.observation_state(bt.backtest_history(bt.decide(w, {"cycle": bt.decide_action((i % 7).cast("int"))}))).orderBy("week_end").toPandas()
    assert seen.prev_weight_cash[0] == 1.0 and seen.portfolio_volatility[1] == 0.0
    np.testing.assert_allclose(seen.portfolio_volatility[20], np.std(want[8:20, 2]), atol=1e-12)
    np.testing.assert_allclose(seen.portfolio_drawdown[1:], want[:-1, 7], atol=1e-12)


def test_metrics_match_numpy_and_guards(spark):
    h = bt.backtest_history(bt.decide(weeks(spark), bt.baseline_policies_without_features()))
    got = {r.strategy: r for r in bt.portfolio_metrics(h).collect()}
    spy = h.filter("strategy = 'spy_only'").orderBy("week_end").toPandas()
    x = (spy.net_return - spy.cash_return).to_numpy()
    m = got["spy_only"]
    assert m.sharpe_ratio == pytest.approx(x.mean() / x.std() * np.sqrt(52))
    assert m.sortino_ratio == pytest.approx(x.mean() / x[x < 0].std() * np.sqrt(52))
    assert m.annualized_return == pytest.approx(np.prod(1 + spy.net_return) ** (52 / 30) - 1)
    assert m.calmar_ratio == pytest.approx(m.annualized_return / abs(spy.drawdown.min()))
    assert m.win_rate == pytest.approx((spy.net_return > 0).mean()) and m.weeks == 30.0
    cash = got["cash_only"]
    assert cash.sharpe_ratio == 0.0 and cash.max_drawdown == 0.0 and cash.calmar_ratio is None


def test_metrics_of_single_week_total_loss_and_gains_only(spark):
    rows = [
        ("p", "one", "s", WEEK(0), 0.01, 0.01, 1.01, 0.0, 0.0, 0.0, 0.0),
        ("p", "gain", "s", WEEK(0), 0.01, 0.01, 1.01, 0.0, 0.0, 0.0, 0.0), ("p", "gain", "s", WEEK(1), 0.02, 0.02, 1.03, 0.0, 0.0, 0.0, 0.0),
        ("p", "loss", "s", WEEK(0), -1.0, -1.0, 0.0, -1.0, 0.0, 0.0, 0.0), ("p", "loss", "s", WEEK(1), 0.5, 0.5, 0.0, -1.0, 0.0, 0.0, 0.0),
        ("p", "nan", "s", WEEK(0), float("nan"), 0.0, 1.0, 0.0, 0.0, 0.0, 0.0),
    ]
    h = spark.createDataFrame(rows, "panel string, strategy string, split string, week_end date, net_return double, reward double, portfolio_value double, drawdown double, turnover double, transaction_cost double, cash_return double")
    got = {r.strategy: r for r in bt.portfolio_metrics(h).collect()}
    assert got["one"].sharpe_ratio is None and got["one"].annualized_volatility == 0.0
    assert got["gain"].sortino_ratio is None
    assert got["loss"].annualized_return is None and got["loss"].calmar_ratio is None and got["loss"].cumulative_return == -1.0
    assert got["nan"].win_rate is None and got["nan"].weeks == 1.0


def test_momentum_ties_and_missing(spark):
    rows = [(1, 0.1, 0.1, 0.0), (2, None, 0.5, 0.5), (3, 0.1, None, 0.2), (4, -0.1, -0.2, -0.3), (5, 0.1, 0.2, 0.2), (6, 0.2, None, None)]
    df = spark.createDataFrame(rows, "i int, s double, t double, g double").orderBy("i")
    assert [r[0] for r in df.select(bt.momentum_action("s", "t", "g")).collect()] == [1, 0, 3, 0, 2, 1]


def test_heuristic_rules_in_order(spark):
    rows = [
        (1, 31.0, 1.0, 0.1, 0.0, 0.0, -0.01, 0.0, 6), (2, None, 1.0, 0.1, 0.0, 0.0, -0.2, 0.0, 6), (3, 21.0, -1.0, 0.1, 0.0, 0.0, 0.0, 0.0, 2),
        (4, 23.0, 1.0, 0.1, 0.0, 0.2, 0.0, 0.0, 3), (5, 23.0, 1.0, 0.1, None, 0.2, 0.0, 0.0, 3), (6, 23.0, 1.0, None, 0.0, 0.2, 0.0, 0.0, 5),
        (7, 15.0, 1.0, 0.1, 0.2, 0.0, 0.0, 0.0, 4), (8, 15.0, 0.0, -0.1, 0.2, 0.0, 0.0, 0.0, 6), (9, 15.0, 1.0, -0.1, 0.2, 0.0, 0.0, None, 5),
    ]
    df = spark.createDataFrame(rows, "i int, v double, c double, s double, t double, g double, d double, q double, want int").orderBy("i")
    got = df.select(bt.heuristic_action(*[F.col(x) for x in "vcstgdq"]).alias("a"), "want").collect()
    assert [r.a for r in got] == [r.want for r in got]


def test_weights_are_coerced_or_rejected(spark):
    df = spark.createDataFrame([([1.0, 1.0, 2.0],)], "w array<double>")
    assert df.select(bt.coerce_weights(F.col("w"))).first()[0] == [0.25, 0.25, 0.5, 0.0]
    for bad, message in (([1.0, 1.0], "three or four"), ([-1.0, 2.0, 0.0], "non-negative"), ([0.0, 0.0, 0.0], "positive number")):
        with pytest.raises(Exception, match=message):
            spark.createDataFrame([(bad,)], "w array<double>").select(bt.coerce_weights(F.col("w"))).collect()
    with pytest.raises(Exception, match="unknown action"):
        spark.range(1).select(bt.action_name(F.lit(9))).collect()
    none = F.lit(None)
    with pytest.raises(Exception, match="needs an action or weights"):
        spark.range(1).select(bt.resolve(none.cast("int"), none.cast("array<double>"), none.cast("string"))["weights"]).collect()


def test_action_logs_must_cover_the_weeks(spark):
    w = weeks(spark, 5)
    log = w.select("split", "week_end", F.lit(1).alias("action_id"))
    assert bt.align_actions(w, log).count() == 5
    with pytest.raises(Exception, match="does not match"):
        bt.align_actions(w, log.filter(F.col("week_end") > WEEK(0))).collect()


def test_environment_rewards_match_numpy(spark):
    w = weeks(spark, 20).withColumn("action_id", (F.dayofmonth("week_end") % 7).cast("int"))
    out = bt.environment_rewards(w, incentive=0.002, lookback=4).orderBy("week_end").toPandas()
    pdf = w.orderBy("week_end").toPandas()
    r = pdf[["return_spy", "return_tlt", "return_gld", "cash_return"]].to_numpy(float)
    table = {a: np.array(x) for a, _, x in bt.ACTION_TEMPLATES}
    prev, want = np.array([0, 0, 0, 1.0]), []
    for t, a in enumerate(pdf.action_id):
        x = table[a]
        turn = np.abs(x - prev).sum() / 2
        vol = np.sqrt(x**2 @ r[t - 3 : t + 1].std(axis=0) ** 2) if t >= 3 else 0.0
        want.append(x @ r[t] - 0.001 * turn + 0.002 * turn - 0.05 * vol)
        prev = x
    np.testing.assert_allclose(out.reward.to_numpy(float), want, atol=1e-12)
    e = bt.episode_metrics(out_frame(spark, out), ["panel"]).first()
    rr = out.portfolio_return.to_numpy(float)
    assert e.cumulative_return == pytest.approx(np.prod(1 + rr) - 1) and e.length == 20
    cum = np.cumprod(1 + rr)
    peak = np.maximum.accumulate(cum)
    assert e.raw_max_drawdown == pytest.approx(np.min((cum - peak) / (peak + 1e-8)))
    assert e.sharpe_ratio == pytest.approx(rr.mean() / rr.std() * np.sqrt(52))


def out_frame(spark, pdf):
    return spark.createDataFrame(pdf[["panel", "week_end", "reward", "portfolio_return"]])


def test_episode_survives_returns_below_minus_one(spark):
    df = spark.createDataFrame([("e", WEEK(0), 0.0, -1.5), ("e", WEEK(1), 0.0, 0.1)], "panel string, week_end date, reward double, portfolio_return double")
    e = bt.episode_metrics(df, ["panel"]).first()
    assert -1.0 < e.cumulative_return < -0.99 and np.isfinite(e.max_drawdown)


def test_bootstrap_paths_agree(spark):
    h = bt.backtest_history(bt.decide(weeks(spark), bt.baseline_policies_without_features()))
    a = {r.strategy: (r[3], r[4]) for r in bootstrap_sharpe(h, n_boot=50).collect()}
    b = {r.strategy: (r[3], r[4]) for r in bootstrap_metric(h, n_boot=50).collect()}
    assert a.keys() == b.keys() and a["cash_only"] == (0.0, 0.0)
    for k in a:
        np.testing.assert_allclose(a[k], b[k], atol=1e-9)
    mean = bootstrap_metric(h, metric=lambda m: m.mean(axis=1), n_boot=20).filter("strategy = 'spy_only'").first()
    assert mean.ci_low <= mean.ci_high
    one = bt.backtest_history(bt.decide(weeks(spark, 1), {"spy": bt.fixed_action("spy_only")}))
    assert bootstrap_sharpe(one, n_boot=5).first()[3] is None


def test_equity_matrix_fills_and_drops(spark):
    rows = [("p", "s", WEEK(0), "b", None), ("p", "s", WEEK(1), "a", 1.1), ("p", "s", WEEK(2), "b", 0.9)]
    h = spark.createDataFrame(rows, "panel string, split string, week_end date, strategy string, portfolio_value double")
    out = [tuple(r)[2:] for r in bt.equity_matrix(h, ("a", "b")).orderBy("week_end").collect()]
    assert out == [(WEEK(1), 1.1, None), (WEEK(2), 1.1, 0.9)]


def test_scores_rank_and_names(spark):
    m = spark.createDataFrame([("a", "v", 1.0, 0.1, 0.0, -0.1), ("b", "v", 2.0, 0.1, 0.0, -0.1), ("c", "v", None, 0.1, 0.0, -0.1)],
                              "strategy string, split string, sharpe_ratio double, cumulative_return double, reward double, max_drawdown double")
    assert [r.strategy for r in bt.policy_score(m).filter("is_best = 1").collect()] == ["b"]
    assert {r.strategy: r.composite_score for r in bt.composite_score(m).collect()} == pytest.approx({"a": 1.0, "b": 2.0})
    assert spark.range(1).select(bt.display_name(F.lit("my_own_run")), bt.display_name(F.lit("spy_only"))).first()[:] == ("My Own Run", "SPY")


def test_split_systems(spark):
    days = [D(2014, 6, 30), D(2014, 7, 1), D(2022, 12, 30), D(2022, 12, 31), D(2023, 1, 2), D(2023, 1, 3), D(2027, 1, 1)]
    df = spark.createDataFrame([(d,) for d in days], "d date").orderBy("d")
    got = [tuple(r) for r in df.select(sp.split_label("d"), sp.split_label_gapped("d")).collect()]
    assert [g[0] for g in got] == ["warmup", "train", "validation", "locked_test", "locked_test", "locked_test", "locked_test"]
    assert [g[1] for g in got] == ["warmup", "train", "validation", None, None, "locked_test", None]
    assert sp.subset(df.withColumn("split", sp.split_label("d")), "train").count() == 1


def test_roles_and_presets(spark):
    g = sp.infer_feature_groups(["week_end", "spy_ret_1d", "vixcls_level", "news_finbert_compound_tlt", "regime_filtered", "next_return_spy", "vix_level", "topic_x_ratio"])
    assert g.text == ("news_finbert_compound_tlt", "topic_x_ratio") and g.macro == ("vixcls_level",) and g.price == ("spy_ret_1d", "vix_level")
    assert g.columns(("macro",), endogenous=True)[-1] == "portfolio_volatility"
    df = spark.createDataFrame([(D(2015, 1, 2), 1.0, "x", 2.0)], "week_end date, a double, source string, next_return_spy double")
    assert sp.select_feature_columns(df) == ["a"]
    for preset in ("regime_core", "nope"):
        with pytest.raises(ValueError):
            sp.select_feature_columns(df, preset)


def test_observation_windows_pad_in_front(spark):
    df = spark.createDataFrame([("p", WEEK(i), [float(i), 10.0], [0.0, 1.0]) for i in range(3)], "panel string, week_end date, x array<double>, prev array<double>")
    rows = observation_windows(df, ["panel"], "week_end", "x", "prev", 2, ["a", "b"], ["c", "d"]).orderBy("week_end", "pos").collect()
    assert [(r.token, r.a, r.b, r.d) for r in rows][:4] == [("t-1", 0.0, 0.0, 0.0), ("t-0", 0.0, 10.0, 1.0), ("t-1", 0.0, 10.0, 1.0), ("t-0", 1.0, 10.0, 1.0)]
    assert state_feature_labels(["f"], 1)[:2] == ["f", "regime_prob_0"]
