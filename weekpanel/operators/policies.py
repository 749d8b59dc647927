"""Back-tests of policies that read the state of their own portfolio.

A policy that looks at its last weights, drawdown, volatility or a memory of its own cannot be a column: each decision
depends on the one before.  Runs are dealt over tasks by a hash of their keys; a task steps through the weeks of all its
runs side by side, in arrays with one entry per run, so the Python loop is as long as the calendar and not as the table.
The rows of a task are bounded by ``RUN_ROWS`` and the calendar length of one run.  The history has the columns of
``backtest.backtest_history`` and equals it for policies that read no state.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekpanel.constants import INITIAL_CAPITAL, NEAR_ZERO, RISK_PENALTY, RISK_WINDOW, TRANSACTION_COST

# policies and kernels of this module travel to the workers by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ASSETS = ("spy", "tlt", "gld", "cash")
RETURNS = ("return_spy", "return_tlt", "return_gld", "cash_return")
#: Weeks that one group of runs holds on average: about 100 MB in a worker, copies for sorting and the history included.
RUN_ROWS = 50_000


@dataclass
class Observation:
    """What a policy sees before it decides a week: one entry per run.

    ``features`` are the week's columns; ``memory`` is the policy's own, kept from week to week (arrays per run).
    """

    features: dict[str, np.ndarray]
    previous_weights: np.ndarray
    portfolio_value: np.ndarray
    drawdown: np.ndarray
    rolling_volatility: np.ndarray
    memory: dict[str, np.ndarray]


@dataclass
class Decisions:
    """Weights (runs x 4, or x 3 without cash) and, for action policies, action ids (-1: none)."""

    weights: np.ndarray
    action_id: np.ndarray | None = None
    action_name: str | np.ndarray = "custom_weights"


@dataclass(frozen=True)
class StatefulPolicy:
    """A decision rule over observations, the columns it reads and its memory at the start of a run."""

    name: str
    decide: Callable[[Observation], Decisions]
    features: tuple[str, ...] = ()
    memory: dict[str, float] = field(default_factory=dict)


def normalized_weights(weights: np.ndarray) -> np.ndarray:
    """Zero cash added to three weights, divided by their sum; negative, missing or vanishing weights fail the job."""
    if weights.ndim != 2 or weights.shape[1] not in (3, 4):
        raise ValueError("weights must have three or four entries")
    if weights.shape[1] == 3:
        weights = np.hstack([weights, np.zeros((len(weights), 1))])
    total = weights.sum(1)
    if not (weights >= -NEAR_ZERO).all():
        raise ValueError("weights must be non-negative")
    if not (total > 0).all():
        raise ValueError("weights must sum to a positive number")
    # weights that sum to one within rounding stay as they are: dividing again moves last digits, and with them the sign of a net return of zero
    return np.where(np.abs(total - 1.0)[:, None] <= NEAR_ZERO, weights, weights / total[:, None])


def weights_of(prefix: str) -> Callable[[Observation], np.ndarray]:
    """Reads the four weight columns that begin with ``prefix``."""
    return lambda seen: np.stack([seen.features[f"{prefix}{a}"] for a in ASSETS], 1)


def fixed_weights(name: str, weights: Sequence[float]) -> StatefulPolicy:
    return StatefulPolicy(name, lambda seen: Decisions(np.tile(np.asarray(weights, float), (len(seen.drawdown), 1))))


def stop_loss(name: str, base: str, limit: float, pause: int) -> StatefulPolicy:
    """Follows the weights in columns ``{base}*`` until the portfolio lies ``limit`` below its highest value since it last
    entered; then holds cash for ``pause`` weeks and enters anew."""
    read = weights_of(base)

    def decide(seen: Observation) -> Decisions:
        peak, wait, value = seen.memory["peak"], seen.memory["wait"], seen.portfolio_value
        resting = wait > 0
        back = wait == 1  # the last week of a pause: the next week enters with today's value as its peak
        wait[resting] -= 1
        peak[~resting] = np.maximum(peak[~resting], value[~resting])
        stopped = ~resting & (value - peak <= -limit * peak)
        wait[stopped] = pause - 1
        if pause == 1:
            peak[stopped] = 0.0
        peak[back] = 0.0
        out = resting | stopped
        weights = read(seen)
        weights[out] = (0.0, 0.0, 0.0, 1.0)
        return Decisions(weights, None, np.where(out, "stopped", "invested"))

    return StatefulPolicy(name, decide, tuple(f"{base}{a}" for a in ASSETS), {"peak": 0.0, "wait": 0.0})


def volatility_target(name: str, base: str, target: float) -> StatefulPolicy:
    """Scales the risky weights of columns ``{base}*`` by target over the portfolio's rolling volatility (at most 1); the
    rest is cash."""
    read = weights_of(base)

    def decide(seen: Observation) -> Decisions:
        weights = normalized_weights(read(seen))
        vol = seen.rolling_volatility
        scale = np.where(vol > target, target / np.where(vol > 0, vol, 1.0), 1.0)
        risky = weights[:, :3] * scale[:, None]
        return Decisions(np.hstack([risky, (1.0 - risky.sum(1))[:, None]]), None, np.where(scale < 1, "scaled", "full"))

    return StatefulPolicy(name, decide, tuple(f"{base}{a}" for a in ASSETS))


def turnover_limit(name: str, base: str, most: float) -> StatefulPolicy:
    """Moves from the last weights towards those of columns ``{base}*``, by at most ``most`` turnover a week."""
    read = weights_of(base)

    def decide(seen: Observation) -> Decisions:
        goal = normalized_weights(read(seen))
        gap = goal - seen.previous_weights
        size = 0.5 * np.abs(gap).sum(1)
        part = np.where(size > most, most / np.where(size > 0, size, 1.0), 1.0)
        return Decisions(seen.previous_weights + gap * part[:, None], None, np.where(part < 1, "moving", "arrived"))

    return StatefulPolicy(name, decide, tuple(f"{base}{a}" for a in ASSETS))


def _volatility(past: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Population deviation of the last returns of each run; ``past`` (runs x window) holds the newest ``seen`` ones."""
    held = np.minimum(seen, past.shape[1])
    there = np.arange(past.shape[1])[None] < held[:, None]
    n = np.maximum(held, 1)
    mean = np.where(there, past, 0.0).sum(1) / n
    spread = np.where(there, (past - mean[:, None]) ** 2, 0.0).sum(1) / n
    return np.where(held > 1, np.sqrt(spread), 0.0)


def step_runs(pdf: pd.DataFrame, run: np.ndarray, policy: StatefulPolicy, cost: float, penalty: float, window: int, capital: float) -> dict[str, np.ndarray]:
    """All runs of a frame (sorted by run, then week) stepped side by side; one value per row for every history column."""
    starts = np.flatnonzero(np.diff(run, prepend=run[0] - 1) != 0)
    lengths = np.diff(np.append(starts, len(run)))
    n = len(starts)
    returns = pdf[list(RETURNS)].to_numpy(float)
    features = {c: pdf[c].to_numpy() for c in policy.features}
    names = ("gross_return", "turnover", "transaction_cost", "net_return", "risk_proxy", "portfolio_value", "reward", "peak_value", "drawdown")
    out = {c: np.zeros(len(run)) for c in names}
    out |= {f"w_{a}": np.zeros(len(run)) for a in ASSETS}
    out["action_id"], out["action_name"] = np.full(len(run), -1), np.empty(len(run), object)
    previous = np.tile([0.0, 0.0, 0.0, 1.0], (n, 1))
    value, peak = np.full(n, float(capital)), np.full(n, float(capital))
    past, seen = np.zeros((n, window)), np.zeros(n, np.int64)
    memory = {k: np.full(n, float(v)) for k, v in policy.memory.items()}
    for t in range(int(lengths.max())):
        on = np.flatnonzero(lengths > t)
        rows = starts[on] + t
        own = {k: v[on] for k, v in memory.items()}
        observed = Observation({c: v[rows] for c, v in features.items()}, previous[on].copy(), value[on].copy(), value[on] / peak[on] - 1,
                               _volatility(past[on], seen[on]), own)
        made = policy.decide(observed)
        for k, v in own.items():
            memory[k][on] = v
        weights = normalized_weights(np.asarray(made.weights, float))
        gross = np.zeros(len(on))
        for i in range(4):
            gross = gross + weights[:, i] * returns[rows, i]
        turnover = 0.5 * np.abs(weights - previous[on]).sum(1)
        net = gross - cost * turnover
        past[on, seen[on] % window] = net
        seen[on] += 1
        risk = _volatility(past[on], seen[on])
        value[on] *= 1.0 + net
        peak[on] = np.maximum(peak[on], value[on])
        previous[on] = weights
        for c, v in zip(names, (gross, turnover, cost * turnover, net, risk, value[on], net - penalty * risk, peak[on], value[on] / peak[on] - 1)):
            out[c][rows] = v
        for i, a in enumerate(ASSETS):
            out[f"w_{a}"][rows] = weights[:, i]
        if made.action_id is not None:
            out["action_id"][rows] = made.action_id
        out["action_name"][rows] = made.action_name
    return out


def run_policies(
    weeks: DataFrame,
    policies: Sequence[StatefulPolicy],
    keys: Sequence[str] = ("panel", "split"),
    cost: float = TRANSACTION_COST,
    penalty: float = RISK_PENALTY,
    window: int = RISK_WINDOW,
    capital: float = INITIAL_CAPITAL,
    run_rows: int = RUN_ROWS,
) -> DataFrame:
    """History of every policy on every run (``keys``) of ``weeks``; ``strategy`` is the policy's name.

    A run begins with cash, the capital and the policy's memory, and never sees another run.
    """
    held = {p.name: p for p in policies}
    if len(held) != len(policies):
        raise ValueError("policies need distinct names")
    features = sorted({c for p in policies for c in p.features})
    run = ["strategy", *keys]
    kinds = dict(weeks.dtypes)
    strategies = F.explode(F.array(*[F.lit(p.name) for p in policies])).alias("strategy")
    rows = weeks.select(*keys, "week_end", *RETURNS, *features, strategies)
    groups = max(1, math.ceil(weeks.count() * len(policies) / run_rows))
    history = ["action_id", "action_name", *RETURNS, *[f"w_{a}" for a in ASSETS], "gross_return", "turnover", "transaction_cost",
               "net_return", "risk_proxy", "portfolio_value", "reward", "peak_value", "drawdown"]
    schema = ", ".join([f"{k} string" if k == "strategy" else f"{k} {kinds[k]}" for k in run] + [f"week_end {kinds['week_end']}"] + [
        f"{c} {'int' if c == 'action_id' else 'string' if c == 'action_name' else 'double'}" for c in history])

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([*run, "week_end"], kind="stable", ignore_index=True)
        parts = []
        for name, own in pdf.groupby("strategy", sort=False):
            own = own.reset_index(drop=True)
            number = own.groupby(run, sort=False, dropna=False).ngroup().to_numpy()
            made = step_runs(own, number, held[name], cost, penalty, window, capital)
            made["action_id"] = pd.array(np.where(made["action_id"] < 0, None, made["action_id"]), dtype="Int32")
            parts.append(own[[*run, "week_end", *RETURNS]].assign(**made))
        return pd.concat(parts, ignore_index=True)[[*run, "week_end", *history]]

    dealt = rows.withColumn("_group", F.pmod(F.xxhash64(*run), F.lit(groups)))
    return dealt.groupBy("_group").applyInPandas(step, schema)
