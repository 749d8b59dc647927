"""Split, policy, back-test and bootstrap queries."""

from __future__ import annotations

from oracle.common import ASSETS, FEATURES, PRICES, SPINE, STATE, TARGETS, WEEKLY, chain, r6, week

DISPLAY = """CASE strategy WHEN 'cash_only' THEN 'Cash' WHEN 'spy_only' THEN 'SPY' WHEN 'tlt_only' THEN 'TLT'
  WHEN 'gld_only' THEN 'GLD' WHEN 'spy_80_tlt_20' THEN 'SPY 80 / TLT 20'
  WHEN 'balanced_60_30_10' THEN 'Balanced 60 / 30 / 10' WHEN 'defensive_20_60_20' THEN 'Defensive 20 / 60 / 20'
  WHEN 'equal_weight_spy_tlt_gld' THEN 'Equal Weight' WHEN 'momentum_rotation_20d' THEN 'Momentum 20D'
  WHEN 'heuristic_regime_proxy' THEN 'Heuristic Regime' END"""


def split(d: str) -> str:
    return (
        f"CASE WHEN {d} <= DATE '1995-06-30' THEN 'warmup' WHEN {d} <= DATE '1999-12-31' THEN 'train' "
        f"WHEN {d} <= DATE '2000-12-29' THEN 'validation' ELSE 'locked_test' END"
    )


TEMPLATES = """
templates(action_id, action_name, w_spy, w_tlt, w_gld, w_cash) AS (VALUES
  (0,'cash_only',CAST(0.0 AS DOUBLE),CAST(0.0 AS DOUBLE),CAST(0.0 AS DOUBLE),CAST(1.0 AS DOUBLE)),
  (1,'spy_only',1.0,0.0,0.0,0.0),(2,'tlt_only',0.0,1.0,0.0,0.0),(3,'gld_only',0.0,0.0,1.0,0.0),
  (4,'spy_80_tlt_20',0.8,0.2,0.0,0.0),(5,'balanced_60_30_10',0.6,0.3,0.1,0.0),(6,'defensive_20_60_20',0.2,0.6,0.2,0.0))"""

EV = STATE + "," + TEMPLATES + f""",
ev AS (SELECT *, {split('week_end')} AS split, next_return_spy AS return_spy, next_return_tlt AS return_tlt,
  next_return_gld AS return_gld, coalesce(dff_level, 0) / 100 / 52 AS cash_return FROM state)"""


def momentum(spy="spy_ret_20d", tlt="tlt_ret_20d", gld="gld_ret_20d") -> str:
    return (
        f"CASE WHEN {spy} IS NULL THEN 0 WHEN greatest({spy}, {tlt}, {gld}) <= 0 THEN 0 "
        f"WHEN {spy} = greatest({spy}, {tlt}, {gld}) THEN 1 WHEN {tlt} = greatest({spy}, {tlt}, {gld}) THEN 2 ELSE 3 END"
    )


def heuristic(curve: str) -> str:
    return f"""CASE WHEN spy_drawdown_60d <= -0.12 OR vix_level >= 30 THEN 6
      WHEN {curve} < 0 AND vix_level >= 20 THEN 2
      WHEN gld_ret_20d > spy_ret_20d AND (tlt_ret_20d IS NULL OR gld_ret_20d > tlt_ret_20d) AND vix_level >= 22 THEN 3
      WHEN spy_ret_20d > 0 AND qqq_spy_ratio_chg_5d >= 0 AND vix_level < 20 THEN 4
      WHEN tlt_ret_20d > spy_ret_20d AND {curve} <= 0 THEN 6 ELSE 5 END"""


def decided(src: str, with_heuristic: bool) -> str:
    keep = "panel, split, week_end, return_spy, return_tlt, return_gld, cash_return"
    parts = [
        f"SELECT {', '.join('e.' + c for c in keep.split(', '))}, t.action_name AS strategy, t.action_id, t.action_name, "
        f"w_spy, w_tlt, w_gld, w_cash FROM {src} e JOIN templates t ON true",
        f"SELECT {keep}, 'equal_weight_spy_tlt_gld', NULL, 'custom_weights', CAST(1 AS DOUBLE)/3, CAST(1 AS DOUBLE)/3, CAST(1 AS DOUBLE)/3, 0.0 FROM {src}",
        f"SELECT {', '.join('e.' + c for c in keep.split(', '))}, 'momentum_rotation_20d', t.action_id, t.action_name, w_spy, w_tlt, w_gld, w_cash "
        f"FROM (SELECT *, {momentum()} AS a FROM {src}) e JOIN templates t ON t.action_id = e.a",
    ]
    if with_heuristic:
        parts.append(
            f"SELECT {', '.join('e.' + c for c in keep.split(', '))}, 'heuristic_regime_proxy', t.action_id, t.action_name, w_spy, w_tlt, w_gld, w_cash "
            f"FROM (SELECT *, {heuristic('t10y3m_level')} AS a FROM {src}) e JOIN templates t ON t.action_id = e.a"
        )
    return "decided AS (" + " UNION ALL ".join(parts) + ")"


HIST = """
flows AS (
  SELECT *, gross_return - turnover * 0.001 AS net_return, turnover * 0.001 AS transaction_cost FROM (
    SELECT *, w_spy * return_spy + w_tlt * return_tlt + w_gld * return_gld + w_cash * cash_return AS gross_return,
      0.5 * (abs(w_spy - lag(w_spy, 1, 0.0) OVER w) + abs(w_tlt - lag(w_tlt, 1, 0.0) OVER w)
           + abs(w_gld - lag(w_gld, 1, 0.0) OVER w) + abs(w_cash - lag(w_cash, 1, 1.0) OVER w)) AS turnover
    FROM decided WINDOW w AS (PARTITION BY panel, strategy, split ORDER BY week_end))),
equity AS (
  SELECT *, coalesce(stddev_pop(net_return) OVER (w ROWS BETWEEN 11 PRECEDING AND CURRENT ROW), 0) AS risk_proxy,
    product(1 + net_return) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS portfolio_value
  FROM flows WINDOW w AS (PARTITION BY panel, strategy, split ORDER BY week_end)),
peaked AS (
  SELECT *, net_return - 0.05 * risk_proxy AS reward,
    greatest(1.0, max(portfolio_value) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS peak_value
  FROM equity WINDOW w AS (PARTITION BY panel, strategy, split ORDER BY week_end)),
hist AS (SELECT *, portfolio_value / peak_value - 1 AS drawdown FROM peaked)"""


def guarded(mean: str, spread: str) -> str:
    return f"CASE WHEN {spread} > 1e-12 THEN {mean} / {spread} * sqrt(52.0) WHEN abs({mean}) <= 1e-12 THEN 0.0 END"


METRICS = f"""
sums AS (
  SELECT panel, strategy, split, CAST(count(*) AS DOUBLE) AS weeks, arg_max(portfolio_value, week_end) AS last_value,
    product(1 + net_return) AS growth, count(net_return) AS n, stddev_pop(net_return) AS vol,
    avg(net_return - cash_return) AS mx, stddev_pop(net_return - cash_return) AS xvol,
    stddev_pop(net_return - cash_return) FILTER (WHERE net_return - cash_return < 0) AS down,
    min(drawdown) AS max_drawdown, avg(turnover) AS average_turnover, sum(transaction_cost) AS total_transaction_cost,
    avg(CASE WHEN net_return > 0 THEN 1 ELSE 0 END) AS win_rate, avg(reward) AS mean_reward
  FROM hist GROUP BY panel, strategy, split),
metrics AS (
  SELECT panel, strategy, split, weeks, last_value - 1 AS cumulative_return,
    CASE WHEN growth > 0 THEN pow(growth, 52.0 / n) - 1 END AS annualized_return,
    vol * sqrt(52.0) AS annualized_volatility, mx AS mean_excess_return, mx * 52 AS annualized_excess_return,
    xvol * sqrt(52.0) AS annualized_excess_volatility, {guarded('mx', 'xvol')} AS sharpe_ratio,
    {guarded('mx', 'down')} AS sortino_ratio, max_drawdown,
    CASE WHEN max_drawdown < 0 AND growth > 0 THEN (pow(growth, 52.0 / n) - 1) / abs(max_drawdown) END AS calmar_ratio,
    average_turnover, total_transaction_cost, win_rate, mean_reward
  FROM sums)"""

METRIC_COLS = (
    "weeks", "cumulative_return", "annualized_return", "annualized_volatility", "mean_excess_return",
    "annualized_excess_return", "annualized_excess_volatility", "sharpe_ratio", "sortino_ratio", "max_drawdown",
    "calmar_ratio", "average_turnover", "total_transaction_cost", "win_rate", "mean_reward",
)


def rows(cols):
    return ", ".join(r6(c, c) for c in cols)


RUNS = EV + "," + decided("ev", True) + "," + HIST
RUN_METRICS = RUNS + "," + METRICS
ROWS_METRICS = f"SELECT panel, strategy, split, {rows(METRIC_COLS)} FROM metrics"

WEEK_INDEX = "CAST((week_end - DATE '1995-01-06') / 7 AS INTEGER)"
ENV = EV + f""",
log AS (SELECT *, ({WEEK_INDEX} * 5 + {WEEK_INDEX} // 3) % 7 AS action_id FROM ev),
vols AS (SELECT *, row_number() OVER w AS rn, {', '.join(f'stddev_pop({c}) OVER (w ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS v_{c}' for c in ('return_spy', 'return_tlt', 'return_gld', 'cash_return'))}
  FROM log WINDOW w AS (PARTITION BY panel ORDER BY week_end)),
steps0 AS (SELECT v.*, t.action_name, w_spy, w_tlt, w_gld, w_cash FROM vols v JOIN templates t USING (action_id)),
steps1 AS (SELECT *, w_spy * return_spy + w_tlt * return_tlt + w_gld * return_gld + w_cash * cash_return AS portfolio_return,
    0.5 * (abs(w_spy - lag(w_spy, 1, 0.0) OVER w) + abs(w_tlt - lag(w_tlt, 1, 0.0) OVER w)
           + abs(w_gld - lag(w_gld, 1, 0.0) OVER w) + abs(w_cash - lag(w_cash, 1, 1.0) OVER w)) AS turnover,
    CASE WHEN rn >= 12 THEN sqrt(w_spy*w_spy*v_return_spy*v_return_spy + w_tlt*w_tlt*v_return_tlt*v_return_tlt
      + w_gld*w_gld*v_return_gld*v_return_gld + w_cash*w_cash*v_cash_return*v_cash_return) ELSE 0 END AS volatility
  FROM steps0 WINDOW w AS (PARTITION BY panel, split ORDER BY week_end)),
steps AS (SELECT *, turnover * 0.001 AS transaction_cost, portfolio_return - turnover * 0.001 - 0.05 * volatility AS reward FROM steps1)"""

# replicate draws: identical arithmetic on both engines
BOOT = f"""
runs AS (SELECT panel, strategy, split, list(net_return - cash_return ORDER BY week_end) AS x, count(*) AS n FROM hist GROUP BY ALL),
sized AS (SELECT *, least(4, n) AS b FROM runs),
reps AS (SELECT *, unnest(range(300)) AS rep FROM sized),
blocks AS (SELECT *, unnest(range(CAST(ceil(n / b) AS BIGINT))) AS k FROM reps),
starts AS (SELECT *, ((rep * 1103515245 + k * 40692 + 7 * 69621 + 12345) % 2147483647 * 48271 % 2147483647) % (n - b + 1) AS s FROM blocks),
draws AS (SELECT panel, strategy, split, rep, n, x[CAST(s + j.o + 1 AS BIGINT)] AS v FROM starts
  JOIN (SELECT unnest(range(4)) AS o) j ON j.o < b AND k * b + j.o < n),
boot AS (SELECT panel, strategy, split, rep, avg(v) AS m, stddev_pop(v) AS sd FROM draws GROUP BY ALL),
vals AS (SELECT panel, strategy, split, {guarded('m', 'sd')} AS v FROM boot)"""

# runs of policies that read their own portfolio, one recursion step per week
MIX = f"""
mix AS (SELECT l_suppkey AS entity, {week('CAST(l_shipdate AS DATE)')} AS week_end,
  sum(CASE l_returnflag WHEN 'A' THEN l_quantity ELSE 0 END) AS a, sum(CASE l_returnflag WHEN 'N' THEN l_quantity ELSE 0 END) AS b,
  sum(CASE l_returnflag WHEN 'R' THEN l_quantity ELSE 0 END) AS c, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2),
src AS (SELECT entity, {split('m.week_end')} AS split, m.week_end, next_return_spy AS r0, next_return_tlt AS r1, next_return_gld AS r2,
  a / q AS b0, b / q AS b1, c / q AS b2, row_number() OVER (PARTITION BY entity, {split('m.week_end')} ORDER BY m.week_end) AS t
  FROM mix m JOIN targets t ON m.week_end = t.week_end
  WHERE next_return_spy IS NOT NULL AND next_return_tlt IS NOT NULL AND next_return_gld IS NOT NULL)"""


def stateful(name: str, ready: str, chosen: str, memory: str) -> str:
    """CTE ``name``: ``ready`` and ``chosen`` are select lists over (last state, week), the second with n0..n3, the new
    weights, and ``label``; ``memory`` gives the new a (peak) and w (wait)."""
    return f"""
{name} AS (
  SELECT DISTINCT entity, split, CAST(NULL AS DATE) AS week_end, 0 AS t, CAST(0 AS DOUBLE) AS w0, CAST(0 AS DOUBLE) AS w1, CAST(0 AS DOUBLE) AS w2,
    CAST(1 AS DOUBLE) AS w3, CAST(1 AS DOUBLE) AS v, CAST(1 AS DOUBLE) AS p, CAST([] AS DOUBLE[]) AS past, CAST(0 AS DOUBLE) AS a, 0 AS w,
    '' AS label, CAST(0 AS DOUBLE) AS net, CAST(0 AS DOUBLE) AS turnover FROM src
  UNION ALL
  SELECT entity, split, week_end, t, n0, n1, n2, n3, v * (1 + net), greatest(p, v * (1 + net)),
    CASE WHEN len(past) < 12 THEN list_append(past, net) ELSE list_append(past[2:], net) END, {memory}, label, net, turnover
  FROM (SELECT *, n0 * r0 + n1 * r1 + n2 * r2 + n3 * 0.001 - 0.001 * turnover AS net
    FROM (SELECT *, 0.5 * (abs(n0 - w0) + abs(n1 - w1) + abs(n2 - w2) + abs(n3 - w3)) AS turnover
      FROM (SELECT *, {chosen} FROM (SELECT *, {ready}
        FROM (SELECT f.entity, f.split, s.week_end, s.t, r0, r1, r2, b0, b1, b2, w0, w1, w2, w3, v, p, past, a, w
          FROM {name} f JOIN src s ON s.entity = f.entity AND s.split = f.split AND s.t = f.t + 1))))))"""


_STOP = stateful(
    "stop_loss", "CASE WHEN w > 0 THEN a ELSE greatest(a, v) END AS hi",
    ", ".join(f"CASE WHEN w > 0 OR v - hi <= -0.02 * hi THEN 0.0 ELSE b{k} END AS n{k}" for k in range(3))
    + ", CASE WHEN w > 0 OR v - hi <= -0.02 * hi THEN 1.0 ELSE 0.0 END AS n3, "
    "CASE WHEN w > 0 OR v - hi <= -0.02 * hi THEN 'stopped' ELSE 'invested' END AS label",
    "CASE WHEN w = 1 THEN 0.0 ELSE hi END, CASE WHEN w > 0 THEN w - 1 WHEN label = 'stopped' THEN 3 ELSE 0 END",
)
_VOL = stateful(
    "volatility_target", "CASE WHEN len(past) > 1 AND list_aggregate(past, 'stddev_pop') > 0.004 THEN 0.004 / list_aggregate(past, 'stddev_pop') ELSE 1.0 END AS s",
    "b0 * s AS n0, b1 * s AS n1, b2 * s AS n2, 1.0 - (b0 * s + b1 * s + b2 * s) AS n3, CASE WHEN s < 1 THEN 'scaled' ELSE 'full' END AS label", "a, w",
)
_GAP = "(0.5 * (abs(b0 - w0) + abs(b1 - w1) + abs(b2 - w2) + abs(w3)))"
_MOVE = stateful(
    "turnover_limit", f"CASE WHEN {_GAP} > 0.05 THEN 0.05 / {_GAP} ELSE 1.0 END AS s",
    "w0 + (b0 - w0) * s AS n0, w1 + (b1 - w1) * s AS n1, w2 + (b2 - w2) * s AS n2, w3 - w3 * s AS n3, CASE WHEN s < 1 THEN 'moving' ELSE 'arrived' END AS label", "a, w",
)
STATEFUL_METRICS = METRICS.replace("panel, strategy, split", "strategy, entity, split")

# a log of actions and weights
LOG = EV + "," + TEMPLATES.replace("templates(", "shown(") + f""",
logged AS (SELECT *, {WEEK_INDEX} AS i, CAST(({WEEK_INDEX} * 3) % 7 + 1 AS DOUBLE) AS x0, CAST(({WEEK_INDEX} * 5) % 7 AS DOUBLE) AS x1,
  CAST(({WEEK_INDEX} * 2) % 7 AS DOUBLE) AS x2, CASE WHEN {WEEK_INDEX} % 2 = 0 THEN CAST(({WEEK_INDEX} * 4) % 7 AS DOUBLE) ELSE 0.0 END AS x3 FROM ev),
decided AS (
  SELECT panel, 'decision_log' AS strategy, split, week_end, return_spy, return_tlt, return_gld, cash_return, t.action_id, t.action_name, w_spy, w_tlt, w_gld, w_cash
  FROM logged JOIN shown t ON t.action_id = i % 7 WHERE i % 3 = 0
  UNION ALL SELECT panel, 'decision_log', split, week_end, return_spy, return_tlt, return_gld, cash_return, NULL,
    CASE WHEN i % 5 = 0 THEN 'candidate_weights' ELSE 'custom_weights' END, x0 / (x0 + x1 + x2 + x3), x1 / (x0 + x1 + x2 + x3), x2 / (x0 + x1 + x2 + x3), x3 / (x0 + x1 + x2 + x3)
  FROM logged WHERE i % 3 <> 0)"""

_OBS_FEATURES = ("spy_ret_5d", "vix_level", "dff_level")
SQL = {
    "split_labels": f"""SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, {split('CAST(o_orderdate AS DATE)')} AS split,
       CASE WHEN CAST(o_orderdate AS DATE) BETWEEN DATE '1995-01-02' AND DATE '1995-06-30' THEN 'warmup'
            WHEN CAST(o_orderdate AS DATE) BETWEEN DATE '1995-07-01' AND DATE '1999-12-31' THEN 'train'
            WHEN CAST(o_orderdate AS DATE) BETWEEN DATE '2000-01-10' AND DATE '2000-12-29' THEN 'validation'
            WHEN CAST(o_orderdate AS DATE) BETWEEN DATE '2001-01-03' AND DATE '2001-11-30' THEN 'locked_test' END AS gapped_split
       FROM orders""",
    "split_summary": f"""SELECT {split('w')} AS split, count(*) AS n_rows, min(w) AS start_week, max(w) AS end_week
       FROM (SELECT {week('CAST(l_shipdate AS DATE)')} AS w FROM lineitem) GROUP BY 1""",
    "feature_blocks": chain(WEEKLY)
    + f"""SELECT 'price' AS block, {len(FEATURES)} AS n_columns, '{", ".join(FEATURES[:5])}' AS example_columns,
         CAST({' + '.join(f'count({c})' for c in FEATURES)} AS BIGINT) AS filled_cells FROM market
       UNION ALL SELECT 'macro', 0, '(none)', 0 FROM market UNION ALL SELECT DISTINCT 'regime', 0, '(none)', 0 FROM market
       UNION SELECT 'text', 0, '(none)', 0 FROM market""",
    "policy_actions": chain(WEEKLY, TEMPLATES)
    + f"""SELECT week_end, m AS momentum_action, tm.action_name AS momentum_name, h AS heuristic_action, th.action_name AS heuristic_name
       FROM (SELECT week_end, {momentum()} AS m, {heuristic('tnx_change_5d')} AS h FROM market) x
       JOIN templates tm ON tm.action_id = m JOIN templates th ON th.action_id = h""",
    "backtest_history": chain(RUNS)
    + f"""SELECT panel, strategy, split, week_end, action_id, action_name,
       {rows(('return_spy', 'return_tlt', 'return_gld', 'cash_return', 'w_spy', 'w_tlt', 'w_gld', 'w_cash', 'gross_return', 'turnover', 'transaction_cost', 'net_return', 'risk_proxy', 'portfolio_value', 'reward', 'peak_value', 'drawdown'))} FROM hist""",
    "backtest_metrics": chain(RUN_METRICS) + ROWS_METRICS,
    "strategy_ranking": chain(WEEKLY, TARGETS, TEMPLATES)
    + f""", ev AS (SELECT m.*, {split('m.week_end')} AS split, next_return_spy AS return_spy, next_return_tlt AS return_tlt,
         next_return_gld AS return_gld, coalesce(tnx_level, 0) / 100 / 52 AS cash_return
         FROM market m JOIN targets t ON m.week_end = t.week_end
         WHERE next_return_spy IS NOT NULL AND next_return_tlt IS NOT NULL AND next_return_gld IS NOT NULL),
       {decided('ev', False)}, {HIST}, {METRICS}
       SELECT panel, strategy, split, {rows(METRIC_COLS)}, {DISPLAY} AS display_name FROM metrics""",
    "observation_state": chain(RUNS)
    + f"""SELECT panel, strategy, split, week_end,
       {r6('lag(w_spy, 1, 0.0) OVER w', 'prev_weight_spy')}, {r6('lag(w_tlt, 1, 0.0) OVER w', 'prev_weight_tlt')},
       {r6('lag(w_gld, 1, 0.0) OVER w', 'prev_weight_gld')}, {r6('lag(w_cash, 1, 1.0) OVER w', 'prev_weight_cash')},
       {r6('lag(drawdown, 1, 0.0) OVER w', 'portfolio_drawdown')},
       {r6('coalesce(CASE WHEN count(net_return) OVER (w ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) > 1 THEN stddev_pop(net_return) OVER (w ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) END, 0)', 'portfolio_volatility')}
       FROM hist WINDOW w AS (PARTITION BY panel, strategy, split ORDER BY week_end)""",
    "scenario_metrics": chain(EV)
    + f""", raw AS (SELECT ev.*, s.scenario, {WEEK_INDEX} AS wk FROM ev JOIN (SELECT unnest(range(1000)) AS scenario) s ON true),
       weighted AS (SELECT *, CAST((scenario * 3 + wk * 1) % 11 + 1 AS DOUBLE) AS a, CAST((scenario * 5 + wk * 2) % 11 AS DOUBLE) AS b,
         CAST((scenario * 7 + wk * 3) % 11 AS DOUBLE) AS c, CAST((scenario * 2 + wk * 5) % 11 AS DOUBLE) AS e FROM raw),
       decided AS (SELECT panel, split, week_end, return_spy, return_tlt, return_gld, cash_return,
         'scenario_' || lpad(CAST(scenario AS VARCHAR), 4, '0') AS strategy,
         a / (a + b + c + e) AS w_spy, b / (a + b + c + e) AS w_tlt, c / (a + b + c + e) AS w_gld, e / (a + b + c + e) AS w_cash FROM weighted),
       {HIST}, {METRICS} """ + ROWS_METRICS,
    "supplier_mix_metrics": chain(PRICES, SPINE, TARGETS)
    + f""", mix AS (SELECT l_suppkey AS strategy, {week('CAST(l_shipdate AS DATE)')} AS week_end,
         sum(CASE l_returnflag WHEN 'A' THEN l_quantity ELSE 0 END) AS a, sum(CASE l_returnflag WHEN 'N' THEN l_quantity ELSE 0 END) AS b,
         sum(CASE l_returnflag WHEN 'R' THEN l_quantity ELSE 0 END) AS c, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2),
       decided AS (SELECT 'core' AS panel, strategy, {split('m.week_end')} AS split, m.week_end, next_return_spy AS return_spy,
         next_return_tlt AS return_tlt, next_return_gld AS return_gld, CAST(0.001 AS DOUBLE) AS cash_return,
         a / q AS w_spy, b / q AS w_tlt, c / q AS w_gld, CAST(0.0 AS DOUBLE) AS w_cash
         FROM mix m JOIN targets t ON m.week_end = t.week_end
         WHERE next_return_spy IS NOT NULL AND next_return_tlt IS NOT NULL AND next_return_gld IS NOT NULL),
       {HIST}, {METRICS} """ + ROWS_METRICS,
    "stop_loss_history": chain(PRICES, SPINE, TARGETS, MIX, _STOP)
    + f"""SELECT entity, split, week_end, label AS action_name, {r6('w0', 'w_spy')}, {r6('w1', 'w_tlt')}, {r6('w2', 'w_gld')}, {r6('w3', 'w_cash')},
       {r6('net', 'net_return')}, {r6('turnover', 'turnover')}, {r6('v', 'portfolio_value')}, {r6('v / p - 1', 'drawdown')} FROM stop_loss WHERE t > 0""",
    "stateful_metrics": chain(PRICES, SPINE, TARGETS, MIX, _STOP, _VOL, _MOVE)
    + """, runs AS (SELECT 'stop_loss' AS strategy, * FROM stop_loss UNION ALL SELECT 'volatility_target', * FROM volatility_target
         UNION ALL SELECT 'turnover_limit', * FROM turnover_limit),
       hist AS (SELECT strategy, entity, split, week_end, net AS net_return, 0.001 AS cash_return, v AS portfolio_value, v / p - 1 AS drawdown,
         turnover, turnover * 0.001 AS transaction_cost, net - 0.05 * CASE WHEN len(past) > 1 THEN list_aggregate(past, 'stddev_pop') ELSE 0 END AS reward
         FROM runs WHERE t > 0),""" + STATEFUL_METRICS + f"SELECT strategy, entity, split, {rows(METRIC_COLS)} FROM metrics",
    "decision_log": chain(LOG, HIST)
    + f"""SELECT split, week_end, action_id, action_name, {rows(('w_spy', 'w_tlt', 'w_gld', 'w_cash', 'turnover', 'net_return', 'reward', 'portfolio_value'))} FROM hist""",
    "trial_ranking": chain(PRICES, SPINE, TARGETS, MIX)
    + f""", decided AS (SELECT 'core' AS panel, entity AS strategy, split, week_end, r0 AS return_spy, r1 AS return_tlt, r2 AS return_gld,
         CAST(0.001 AS DOUBLE) AS cash_return, b0 AS w_spy, b1 AS w_tlt, b2 AS w_gld, CAST(0.0 AS DOUBLE) AS w_cash FROM src WHERE split = 'validation'),
       {HIST}, {METRICS}, tr AS (SELECT strategy AS trial, {r6('mean_reward * weeks', 'val_reward')}, {r6('sharpe_ratio', 'val_sharpe')}, {r6('max_drawdown', 'val_max_drawdown')} FROM metrics)
       SELECT *, trial = (SELECT arg_max(trial, row(val_reward, -trial)) FROM tr) AS is_best FROM tr""",
    "bootstrap_sharpe": chain(RUNS, BOOT)
    + f"""SELECT panel, strategy, split, {r6('quantile_cont(v, 0.025)', 'sharpe_ratio_ci_low')}, {r6('quantile_cont(v, 0.975)', 'sharpe_ratio_ci_high')}
       FROM vals GROUP BY panel, strategy, split""",
    "env_reward_log": chain(ENV)
    + f"SELECT panel, split, week_end, action_id, action_name, {rows(('reward', 'portfolio_return', 'turnover', 'transaction_cost', 'volatility'))} FROM steps",
    "episode_metrics": chain(ENV)
    + f""", e1 AS (SELECT panel, split, week_end, reward, portfolio_return AS r, greatest(portfolio_return, -0.999999) AS c,
         sum(ln(1 + greatest(portfolio_return, -0.999999))) OVER (PARTITION BY panel, split ORDER BY week_end) AS lg,
         product(1 + portfolio_return) OVER (PARTITION BY panel, split ORDER BY week_end) AS cum FROM steps),
       e2 AS (SELECT *, max(lg) OVER (PARTITION BY panel, split ORDER BY week_end) AS lpeak,
         max(cum) OVER (PARTITION BY panel, split ORDER BY week_end) AS cpeak FROM e1)
       SELECT panel, split, count(*) AS length, {r6('sum(reward)', 'reward')}, {r6('avg(reward)', 'avg_reward')},
         {r6('sum(r)', 'total_return')}, {r6('avg(r)', 'avg_return')}, {r6('stddev_pop(r)', 'std_return')},
         {r6('avg(r) / (stddev_pop(r) + 1e-8) * sqrt(52.0)', 'raw_sharpe_ratio')},
         {r6('min((cum - cpeak) / (cpeak + 1e-8))', 'raw_max_drawdown')},
         {r6('exp(greatest(-700, least(700, sum(ln(1 + c))))) - 1', 'cumulative_return')},
         {r6('min(exp(lg - lpeak) - 1)', 'max_drawdown')},
         {r6('CASE WHEN stddev_pop(c) > 0 THEN avg(c) / stddev_pop(c) * sqrt(52.0) END', 'sharpe_ratio')}
       FROM e2 GROUP BY panel, split""",
    "equity_matrix": chain(RUNS)
    + "SELECT panel, split, week_end, "
    + ", ".join(
        r6(f"max(CASE WHEN strategy = '{s}' THEN portfolio_value END)", s)
        for s in ("cash_only", "spy_only", "tlt_only", "gld_only", "spy_80_tlt_20", "balanced_60_30_10",
                  "defensive_20_60_20", "equal_weight_spy_tlt_gld", "momentum_rotation_20d", "heuristic_regime_proxy")
    )
    + " FROM hist GROUP BY panel, split, week_end",
    "equity_rebuilt": chain(PRICES, SPINE, TARGETS)
    + ", long AS (" + " UNION ALL ".join(
        f"SELECT panel, week_end, 'next_return_{a}' AS asset, next_return_{a} AS net_return FROM targets" for a in ASSETS
    )
    + f""") SELECT panel, week_end, asset, {r6('net_return', 'net_return')},
        {r6('product(1 + coalesce(net_return, 0)) OVER (PARTITION BY panel, asset ORDER BY week_end)', 'equity')} FROM long""",
    "action_mix": chain(RUNS)
    + "SELECT strategy, action_name, "
    + ", ".join(f"count(*) FILTER (WHERE split = '{s}') AS {s}" for s in ("warmup", "train", "validation", "locked_test"))
    + " FROM hist GROUP BY strategy, action_name",
    "action_entropy": chain(RUNS)
    + f""", c AS (SELECT strategy, split, action_name, count(*) AS n FROM hist GROUP BY ALL),
       p AS (SELECT strategy, split, n / sum(n) OVER (PARTITION BY strategy, split) AS p FROM c)
       SELECT strategy, split, {r6('-sum(p * ln(p + 1e-12))', 'action_entropy')} FROM p GROUP BY strategy, split""",
    "policy_score": chain(RUN_METRICS)
    + f""", s AS (SELECT strategy, split, avg(sharpe_ratio) AS sharpe_ratio, avg(cumulative_return) AS cumulative_return,
         avg(mean_reward * weeks) AS reward, avg(max_drawdown) AS max_drawdown FROM metrics GROUP BY strategy, split),
       sc AS (SELECT *, 0.45 * sharpe_ratio + 0.35 * cumulative_return + 0.10 * reward + 0.10 * max_drawdown AS score FROM s)
       SELECT strategy, split, {rows(('sharpe_ratio', 'cumulative_return', 'reward', 'max_drawdown', 'score'))},
         CASE WHEN row_number() OVER (PARTITION BY split ORDER BY score DESC NULLS LAST, strategy) = 1 THEN 1 ELSE 0 END AS is_best FROM sc""",
    "composite_score": chain(RUN_METRICS)
    + f""", s AS (SELECT strategy, split, sharpe_ratio + 0.5 * cumulative_return - 0.5 * abs(max_drawdown) AS composite_score FROM metrics)
       SELECT strategy, split, {r6('composite_score', 'composite_score')}, {DISPLAY} AS display_name,
         row_number() OVER (PARTITION BY split ORDER BY composite_score DESC, strategy) AS rank_in_split
       FROM s WHERE composite_score IS NOT NULL""",
    "run_comparison": chain(RUN_METRICS)
    + f""", r AS (SELECT split, sharpe_ratio, mean_reward AS reward, strategy IN ('momentum_rotation_20d', 'heuristic_regime_proxy') AS aware FROM metrics)
       SELECT split, {r6('avg(reward) FILTER (WHERE aware)', 'aware_mean_reward')}, {r6('stddev_pop(reward) FILTER (WHERE aware)', 'aware_std_reward')},
        {r6('avg(reward) FILTER (WHERE NOT aware)', 'naive_mean_reward')}, {r6('stddev_pop(reward) FILTER (WHERE NOT aware)', 'naive_std_reward')},
        {r6('avg(sharpe_ratio) FILTER (WHERE aware)', 'aware_mean_sharpe')}, {r6('avg(sharpe_ratio) FILTER (WHERE NOT aware)', 'naive_mean_sharpe')},
        {r6('(avg(reward) FILTER (WHERE aware) - avg(reward) FILTER (WHERE NOT aware)) / (abs(avg(reward) FILTER (WHERE NOT aware)) + 1e-8)', 'improvement')}
       FROM r GROUP BY split""",
    "observation_windows": chain(EV)
    + f""", act AS (SELECT e.*, w_spy, w_tlt, w_gld, w_cash FROM (SELECT *, {momentum()} AS a FROM ev) e JOIN templates t ON t.action_id = e.a),
       prev AS (SELECT panel, week_end, {', '.join(_OBS_FEATURES)}, row_number() OVER (PARTITION BY panel ORDER BY week_end) AS rn,
         lag(w_spy, 1, 0.0) OVER w AS p_spy, lag(w_tlt, 1, 0.0) OVER w AS p_tlt, lag(w_gld, 1, 0.0) OVER w AS p_gld, lag(w_cash, 1, 1.0) OVER w AS p_cash
         FROM act WINDOW w AS (PARTITION BY panel, split ORDER BY week_end))
       SELECT a.panel, a.week_end, CAST(o.pos AS INTEGER) AS pos, 't-' || CAST(3 - o.pos AS VARCHAR) AS token,
         {', '.join(r6(f'coalesce(b.{c}, 0)', c) for c in _OBS_FEATURES)},
         {', '.join(r6(f'CASE WHEN b.rn IS NULL THEN 0 ELSE a.p_{c} END', f'prev_alloc_{c}') for c in ('spy', 'tlt', 'gld', 'cash'))}
       FROM prev a JOIN (SELECT unnest(range(4)) AS pos) o ON true LEFT JOIN prev b ON b.panel = a.panel AND b.rn = a.rn - (3 - o.pos)""",
}
