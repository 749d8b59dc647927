"""Policies that read their own portfolio: against a plain loop, against the window back-test, and their guards."""

import datetime as dt
import random
import re

import numpy as np
import pytest

from weekpanel.operators import backtest as bt
from weekpanel.operators import policies as pol

SCHEMA = "panel string, split string, week_end date, return_spy double, return_tlt double, return_gld double, cash_return double, mix_spy double, mix_tlt double, mix_gld double, mix_cash double"


def week_rows(seed, lengths):
    rng = random.Random(seed)
    out = []
    for k, n in enumerate(lengths):
        for t in range(n):
            mix = [rng.random() for _ in range(4)]
            out.append((f"p{k}", "train" if t < n // 2 else "test", dt.date(2000, 1, 7) + dt.timedelta(weeks=t), *[rng.gauss(0.0, 0.03) for _ in range(3)], 0.0005,
                        *[m / sum(mix) for m in mix]))
    rng.shuffle(out)
    return out


def plain_run(rows, decide, memory, cost=0.001, penalty=0.05, window=12):
    """One run, week by week, with numbers instead of arrays."""
    previous, value, peak, nets, out = [0.0, 0.0, 0.0, 1.0], 1.0, 1.0, [], []
    state = dict(memory)
    vol = lambda x: float(np.std(x[-window:])) if len(x) > 1 else 0.0
    for r in sorted(rows, key=lambda r: r[2]):
        weights = decide(r, previous, value, value / peak - 1, vol(nets), state)
        gross = sum(a * b for a, b in zip(weights, r[3:7]))
        turnover = 0.5 * sum(abs(a - b) for a, b in zip(weights, previous))
        net = gross - cost * turnover
        nets.append(net)
        value *= 1 + net
        peak = max(peak, value)
        out.append((r[0], r[1], r[2], *weights, turnover, net, net - penalty * vol(nets), value, value / peak - 1))
        previous = weights
    return out


def plain_stop(limit, pause):
    def decide(r, previous, value, drawdown, vol, state):
        if state["wait"] > 0:
            state["wait"] -= 1
            if state["wait"] == 0:
                state["peak"] = 0.0
            return [0.0, 0.0, 0.0, 1.0]
        state["peak"] = max(state["peak"], value)
        if value - state["peak"] <= -limit * state["peak"]:
            state["wait"] = pause - 1
            if pause == 1:
                state["peak"] = 0.0
            return [0.0, 0.0, 0.0, 1.0]
        return list(r[7:11])

    return decide


def plain_target(target):
    def decide(r, previous, value, drawdown, vol, state):
        s = target / vol if vol > target else 1.0
        risky = [x * s for x in r[7:10]]
        return [*risky, 1 - sum(risky)]

    return decide


def plain_move(most):
    def decide(r, previous, value, drawdown, vol, state):
        size = 0.5 * sum(abs(a - b) for a, b in zip(r[7:11], previous))
        s = most / size if size > most else 1.0
        return [b + (a - b) * s for a, b in zip(r[7:11], previous)]

    return decide


COLUMNS = ["panel", "split", "week_end", "w_spy", "w_tlt", "w_gld", "w_cash", "turnover", "net_return", "reward", "portfolio_value", "drawdown"]


@pytest.mark.parametrize("run_rows", [10, 10_000])
@pytest.mark.parametrize("policy,plain", [
    (pol.stop_loss("p", "mix_", 0.04, 3), plain_stop(0.04, 3)), (pol.stop_loss("p", "mix_", 0.01, 1), plain_stop(0.01, 1)),
    (pol.volatility_target("p", "mix_", 0.01), plain_target(0.01)), (pol.turnover_limit("p", "mix_", 0.1), plain_move(0.1)),
])
def test_equals_a_plain_loop(spark, policy, plain, run_rows):
    rows = week_rows(1, [40, 7, 1, 25])
    found = pol.run_policies(spark.createDataFrame(rows, SCHEMA), [policy], run_rows=run_rows).select(*COLUMNS).collect()
    want = []
    for key in {(r[0], r[1]) for r in rows}:
        want += plain_run([r for r in rows if (r[0], r[1]) == key], plain, policy.memory)
    order = lambda r: tuple(r[:3])
    for a, b in zip(sorted(map(tuple, found), key=order), sorted(want, key=order), strict=True):
        assert a[:3] == b[:3] and a[3:] == pytest.approx(b[3:], abs=1e-12)


def test_stateless_policies_equal_the_window_back_test(spark):
    weeks = spark.createDataFrame(week_rows(2, [30, 12]), SCHEMA)
    actions = [pol.StatefulPolicy(name, lambda seen, i=i, w=w: pol.Decisions(np.tile(w, (len(seen.drawdown), 1)), np.full(len(seen.drawdown), i), name))
               for i, name, w in bt.ACTION_TEMPLATES[:3]]
    thirds = pol.fixed_weights("equal_weight_spy_tlt_gld", [1 / 3] * 3)
    columns = {a.name: bt.fixed_action(a.name) for a in actions} | {thirds.name: bt.equal_weight()}
    fields = ["strategy", "action_id", *COLUMNS]
    window = bt.backtest_history(bt.decide(weeks, columns)).select(*fields).collect()
    stepped = pol.run_policies(weeks, [*actions, thirds]).select(*fields).collect()
    order = lambda r: (r[0], r[2], r[3], r[4])
    for a, b in zip(sorted(map(tuple, window), key=order), sorted(map(tuple, stepped), key=order), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], abs=1e-9)


def test_stop_loss_rests_and_returns(spark):
    base = dt.date(2001, 1, 5)
    rows = [("p", "s", base + dt.timedelta(weeks=t), r, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0) for t, r in enumerate([0.1, -0.2, 0.3, 0.3, 0.1, 0.1])]
    found = pol.run_policies(spark.createDataFrame(rows, SCHEMA), [pol.stop_loss("p", "mix_", 0.1, 2)]).orderBy("week_end").collect()
    assert [r.action_name for r in found] == ["invested", "invested", "stopped", "stopped", "invested", "invested"]


def test_policies_are_guarded(spark):
    weeks = spark.createDataFrame(week_rows(3, [4]), SCHEMA)
    for weights in ([[0.5, 0.5]], [[-1.0, 1.0, 1.0]], [[0.0, 0.0, 0.0]], [[float("nan"), 1.0, 1.0]]):
        bad = pol.StatefulPolicy("bad", lambda seen, w=weights: pol.Decisions(np.tile(w, (len(seen.drawdown), 1))))
        with pytest.raises(Exception, match="weights must"):
            pol.run_policies(weeks, [bad]).collect()
    with pytest.raises(ValueError, match="distinct names"):
        pol.run_policies(weeks, [pol.fixed_weights("a", [1, 0, 0]), pol.fixed_weights("a", [0, 1, 0])])
    assert pol.run_policies(weeks.limit(0), [pol.fixed_weights("a", [1, 0, 0])]).count() == 0


def test_decision_log_is_aligned_by_key(spark):
    weeks = spark.createDataFrame(week_rows(4, [6]), SCHEMA).drop("mix_spy", "mix_tlt", "mix_gld", "mix_cash")
    keys = ("panel", "split", "week_end")
    rows = [(*[r[k] for k in keys], 1 if i % 2 else None, None if i % 2 else [2.0, 1.0, 1.0], "mine" if i == 2 else None) for i, r in enumerate(weeks.orderBy(*keys).collect())]
    kind = "panel string, split string, week_end date, action_id int, weights array<double>, action_name string"
    log = spark.createDataFrame(rows[::-1], kind)
    found = bt.align_decisions(weeks, log, keys).orderBy(*keys).collect()
    assert [r.action_name for r in found] == ["custom_weights", "spy_only", "mine", "spy_only", "custom_weights", "spy_only"]
    assert found[0].weights == [0.5, 0.25, 0.25, 0.0] and found[1].weights == [1.0, 0.0, 0.0, 0.0]
    for wrong in (rows[1:], [*rows, rows[0]], [*rows, ("p9", *rows[0][1:])]):
        with pytest.raises(Exception, match="does not match"):
            bt.align_decisions(weeks, spark.createDataFrame(wrong, kind), keys).collect()
    empty = [(*rows[0][:3], None, None, None), *rows[1:]]
    with pytest.raises(Exception, match="needs an action or weights"):
        bt.align_decisions(weeks, spark.createDataFrame(empty, kind), keys).collect()


def test_leaving_for_cash_turns_over_exactly_once(spark):
    """Normalised weights stay as they are, so that a cost equal to the cash return leaves exactly nothing, and no win."""
    mix = [46 / 60, 12 / 60, 2 / 60, 0.0]
    rows = [("p", "train", dt.date(2000, 1, 7) + dt.timedelta(weeks=t), -0.05, -0.05, -0.05, 0.001, *mix) for t in range(2)]
    last = pol.run_policies(spark.createDataFrame(rows, SCHEMA), [pol.stop_loss("p", "mix_", 0.02, 4)]).orderBy("week_end").collect()[1]
    assert last.action_name == "stopped" and last.turnover == 1.0 and last.net_return == 0.0
    odd = np.array([[2.0, 1.0, 1.0, 0.0], mix])
    assert pol.normalized_weights(odd).tolist() == [[0.5, 0.25, 0.25, 0.0], mix]


def test_groups_of_runs_stay_small(spark):
    """A group is what a worker holds at once, several times over: 120,000 weeks are three groups at least."""
    numbers = ", ".join(f"0.25D AS {c}" for c in (*pol.RETURNS, "mix_spy", "mix_tlt", "mix_gld", "mix_cash"))
    weeks = spark.range(120_000).selectExpr("CAST(id AS string) AS panel", "'train' AS split", "date '2000-01-07' AS week_end", *numbers.split(", "))
    out = pol.run_policies(weeks, [pol.stop_loss("p", "mix_", 0.02, 4)])
    groups = int(re.search(r"pmod\(xxhash64\([^)]*\), (?:cast\()?(\d+)", out._jdf.queryExecution().analyzed().toString())[1])
    assert groups >= 3
