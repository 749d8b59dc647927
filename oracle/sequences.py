"""Regime-sequence, candidate and selection queries."""

from __future__ import annotations

from itertools import combinations

from oracle.common import PRICES, SPINE, TARGETS, chain, r6, week

PANEL = f"""
sw AS (SELECT l_suppkey AS entity, {week('CAST(l_shipdate AS DATE)')} AS week_end, count(*) AS n_lines,
    CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS points, CAST(sum(CAST(round(l_quantity) AS BIGINT)) AS BIGINT) AS qty,
    CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM lineitem GROUP BY 1, 2),
panel AS (SELECT entity, week_end, n_lines, points, CASE WHEN points < 4 * n_lines THEN 0 WHEN points < 6 * n_lines THEN 1 ELSE 2 END AS state,
    qty / n_lines AS avg_quantity, points / n_lines / 100 AS avg_discount, cents / qty / 100 AS avg_price FROM sw)"""


def runs(src: str, keys: str, name: str) -> str:
    w = f"(PARTITION BY {keys} ORDER BY week_end)"
    return f"""
{name}_f AS (SELECT *, CASE WHEN row_number() OVER {w} = 1 OR state IS DISTINCT FROM lag(state) OVER {w} THEN 1 ELSE 0 END AS starts FROM {src}),
{name} AS (SELECT *, CAST(sum(starts) OVER (PARTITION BY {keys} ORDER BY week_end ROWS UNBOUNDED PRECEDING) AS INTEGER) AS run_id,
  row_number() OVER {w} - 1 AS pos, count(*) OVER (PARTITION BY {keys}) AS total FROM {name}_f)"""


def diag(src: str, keys: str, name: str) -> str:
    return runs(src, keys, f"{name}_r") + f""",
{name} AS (SELECT {keys}, state, count(*) AS n_weeks, max(total) AS total_weeks, CAST(sum(starts) AS BIGINT) AS n_runs,
  min(CASE WHEN starts = 1 THEN pos END) AS first_start, max(CASE WHEN pos < total // 2 THEN 1 ELSE 0 END) AS in_early,
  max(CASE WHEN pos >= total // 2 THEN 1 ELSE 0 END) AS in_late, count(*) / max(total) AS pct, count(*) / sum(starts) AS avg_dur
  FROM {name}_r GROUP BY {keys}, state)"""


def wide(src: str, keys: str, prefix: str, name: str) -> str:
    cols = []
    for s in range(4):
        for c, e in (("pct", "pct"), ("avg_dur_wks", "avg_dur"), ("n_runs", "n_runs")):
            cols.append(f"CASE WHEN K > {s} THEN coalesce(max(CASE WHEN state = {s} THEN {e} END), 0) END AS s{s}_{prefix}{c}")
    return diag(src, keys, f"{name}_d") + f""",
{name} AS (SELECT {keys}, count(*) AS {prefix}n_active_states, CASE WHEN count(*) < K THEN 0.0 ELSE min(pct) END AS {prefix}min_state_pct,
  max(pct) AS {prefix}max_state_pct, min(avg_dur) AS {prefix}min_avg_dur_wks, {', '.join(cols)} FROM {name}_d GROUP BY {keys})"""


WIDE_COLS = lambda p: [f"s{s}_{p}{c}" for s in range(4) for c in ("pct", "avg_dur_wks", "n_runs")]

CAND_STATE = """CASE K WHEN 2 THEN CASE WHEN points < 5 * n_lines THEN 0 ELSE 1 END
  WHEN 3 THEN CASE WHEN points < 4 * n_lines THEN 0 WHEN points < 6 * n_lines THEN 1 ELSE 2 END
  ELSE CASE WHEN 2 * points < 7 * n_lines THEN 0 WHEN points < 5 * n_lines THEN 1 WHEN 2 * points < 13 * n_lines THEN 2 ELSE 3 END END"""
CANDS = PANEL + f""",
pk AS (SELECT entity, week_end, n_lines, points, avg_quantity, avg_discount, avg_price, CAST(2 + entity % 3 AS INTEGER) AS K FROM panel)"""
LABELS = CANDS + f""",
lab AS (SELECT p.entity, K, p.week_end, {CAND_STATE} AS state, p.week_end > DATE '1998-12-31' AS is_val, avg_price,
  avg_quantity AS vix_level, avg_price / 10000 AS spy_vol_20d, -avg_discount AS spy_drawdown_60d, (avg_quantity - 25) / 100 AS spy_ret_20d,
  next_return_spy, next_return_tlt, next_return_gld
  FROM pk p LEFT JOIN targets t ON t.week_end = p.week_end WHERE p.week_end <= DATE '2000-12-29'),
labv AS (SELECT * FROM lab WHERE is_val)"""
_STRESS = ("vix_level", "spy_vol_20d", "spy_drawdown_60d")
_FWD = ("next_return_spy", "next_return_tlt", "next_return_gld")
_DIST = ", ".join(
    "sqrt(" + " + ".join(
        f"pow(max(CASE WHEN state = {i} THEN z_{c} END) - max(CASE WHEN state = {j} THEN z_{c} END), 2)" for c in _STRESS
    ) + ")"
    for i, j in combinations(range(4), 2)
)
_ONE_SHOT = " OR ".join(f"coalesce(K > {s} AND s{s}_dev_n_runs = 1 AND s{s}_dev_pct < 0.15, false)" for s in range(4))
_SPREAD = lambda c: f"CASE WHEN count({c}) >= 2 THEN max({c}) - min({c}) ELSE 0 END"
_RATIO = lambda c: f"CASE WHEN count({c}) >= 2 THEN abs(max({c})) / greatest(abs(min({c})), 1e-6) ELSE 0 END"

GRID = (
    PRICES + "," + SPINE + "," + TARGETS + "," + LABELS + "," + wide("labv", "entity, K", "val_", "vw") + ","
    + wide("lab", "entity, K", "dev_", "dw")
    + f""",
summ AS (SELECT entity, K, state, {', '.join(f'avg({c}) AS {c}' for c in (*_STRESS, 'spy_ret_20d', *_FWD))} FROM lab GROUP BY entity, K, state),
znorm AS (SELECT *, {', '.join(f"({c} - avg({c}) OVER k) / CASE WHEN stddev_pop({c}) OVER k > 1e-9 THEN stddev_pop({c}) OVER k ELSE 1 END AS z_{c}" for c in _STRESS)}
  FROM summ WINDOW k AS (PARTITION BY entity, K)),
dist AS (SELECT entity, K, least({_DIST}) AS min_profile_dist FROM znorm GROUP BY entity, K),
ll AS (SELECT entity, K, -avg(avg_price) FILTER (WHERE is_val) / 1000 AS val_ll_per_step FROM lab GROUP BY entity, K),
flags AS (SELECT d.*, v.* EXCLUDE (entity, K), min_profile_dist, val_ll_per_step, val_ll_per_step IS NULL AS failed,
  [8, 10, 12, 14][d.entity % 4 + 1] AS n_pca, ['diag', 'full'][d.entity % 2 + 1] AS cov_type
  FROM dw d LEFT JOIN vw v ON v.entity = d.entity AND v.K = d.K JOIN dist x ON x.entity = d.entity AND x.K = d.K JOIN ll ON ll.entity = d.entity AND ll.K = d.K),
flagged AS (SELECT *, failed OR coalesce(val_min_state_pct < 0.05, false) AS filter_collapse,
  failed OR coalesce(val_min_avg_dur_wks < 2, false) AS filter_flip_flop, failed OR coalesce(val_max_state_pct > 0.85, false) AS filter_imbalanced,
  failed OR {_ONE_SHOT} AS filter_one_shot,
  failed OR (K = 4 AND (least({', '.join(f'coalesce(s{s}_dev_pct, 0)' for s in range(4))}) < 0.08 OR coalesce(min_profile_dist < 0.25, false))) AS filter_k4_redundant,
  CASE WHEN K = 4 AND NOT failed THEN min_profile_dist END AS k4_min_profile_dist FROM flags),
passed AS (SELECT *, NOT (filter_collapse OR filter_flip_flop OR filter_imbalanced OR filter_one_shot OR filter_k4_redundant) AS passes_hard_filters FROM flagged),
med AS (SELECT *, quantile_cont(vix_level, 0.5) OVER (PARTITION BY entity, K) AS m FROM summ),
nam AS (SELECT *, CASE WHEN vix_level < m AND spy_ret_20d >= 0 THEN 'calm'
   WHEN vix_level >= m AND (spy_ret_20d < 0 OR spy_drawdown_60d < -0.03) THEN 'stress' ELSE 'transition' END AS nm FROM med),
per AS (SELECT entity, K, greatest({_RATIO('vix_level')}, {_RATIO('spy_vol_20d')}) AS ratio, {_SPREAD('spy_drawdown_60d')} AS dd,
  count(*) FILTER (WHERE nm = 'calm') AS calm, count(*) FILTER (WHERE nm = 'stress') AS stress, count(*) FILTER (WHERE nm = 'transition') AS trans,
  greatest({', '.join(_SPREAD(c) for c in _FWD)}) AS spread FROM nam GROUP BY entity, K),
timing AS (SELECT entity, K, max(CASE WHEN n_runs = 1 AND first_start >= total_weeks // 2 AND pct < 0.25 THEN 1 ELSE 0 END) AS late,
  max(CASE WHEN in_early + in_late = 2 THEN 1 ELSE 0 END) AS both_halves, max(CASE WHEN n_runs = 1 THEN 1 ELSE 0 END) AS single FROM dw_d GROUP BY entity, K),
best AS (SELECT *, greatest(ratio, CASE WHEN dd > 0.05 THEN 1.6 WHEN dd > 0.025 THEN 1.25 ELSE 0 END) AS b FROM per JOIN timing USING (entity, K)),
sc AS (SELECT entity, K, CASE WHEN b >= 1.5 THEN 2 WHEN b >= 1.2 THEN 1 ELSE 0 END AS a,
  CASE WHEN K = 2 THEN CASE WHEN calm >= 1 AND stress >= 1 THEN 2 WHEN calm >= 1 OR stress >= 1 THEN 1 ELSE 0 END
       ELSE CASE WHEN calm >= 1 AND stress >= 1 AND trans >= 1 THEN 2 WHEN calm >= 1 AND stress >= 1 THEN 1 ELSE 0 END END AS bb,
  CASE WHEN late = 1 THEN 0 WHEN both_halves = 0 AND K >= 2 THEN 0 WHEN single = 1 THEN 1 ELSE 2 END AS c,
  CASE WHEN spread > 0.005 THEN 2 WHEN spread > 0.002 THEN 1 ELSE 0 END AS d FROM best),
grid AS (SELECT p.*, CASE WHEN passes_hard_filters THEN a ELSE 0 END AS score_A_profile_separation, CASE WHEN passes_hard_filters THEN bb ELSE 0 END AS score_B_naming,
  CASE WHEN passes_hard_filters THEN c ELSE 0 END AS score_C_temporal, CASE WHEN passes_hard_filters THEN d ELSE 0 END AS score_D_downstream,
  CASE WHEN passes_hard_filters THEN a + bb + c + d ELSE 0 END AS interpretability_score FROM passed p JOIN sc ON sc.entity = p.entity AND sc.K = p.K),
tiered AS (SELECT *, CASE WHEN interpretability_score >= 6 THEN 'High' WHEN interpretability_score >= 3 THEN 'Medium' ELSE 'Low' END AS interpretability_tier FROM grid),
surv AS (SELECT * FROM tiered WHERE passes_hard_filters AND NOT failed),
stat AS (SELECT 'statistical' AS role, * FROM surv ORDER BY val_ll_per_step DESC, entity LIMIT 1),
intp AS (SELECT 'interpretable' AS role, * FROM surv ORDER BY interpretability_score DESC, val_ll_per_step DESC, entity LIMIT 1),
k3 AS (SELECT 'k3' AS role, * FROM surv WHERE K = 3 ORDER BY interpretability_score DESC, val_ll_per_step DESC, entity LIMIT 1),
ovr AS (SELECT coalesce((SELECT CASE interpretability_tier WHEN 'High' THEN 2 WHEN 'Medium' THEN 1 ELSE 0 END FROM k3)
   > (SELECT CASE interpretability_tier WHEN 'High' THEN 2 WHEN 'Medium' THEN 1 ELSE 0 END FROM stat), false) AS o),
rec AS (SELECT 'recommended' AS role, * EXCLUDE (role, o) FROM (SELECT k3.*, o FROM k3, ovr WHERE o UNION ALL SELECT intp.*, o FROM intp, ovr WHERE NOT o)),
why AS (SELECT CASE WHEN (SELECT count(*) FROM intp) = 0 THEN 'no survivors' WHEN o THEN 'K=3 has a higher tier than the best likelihood'
   WHEN (SELECT entity FROM intp) = (SELECT entity FROM stat) THEN 'best likelihood is also most interpretable' ELSE 'most interpretable survivor' END AS reason FROM ovr)"""
)

MEASURES = ("avg_quantity", "avg_discount", "avg_price")
WK = "CAST((week_end - DATE '1995-01-06') / 7 AS INTEGER)"
SEEDS = PANEL + f""",
seeds AS (SELECT entity, {WK} % 5 AS seed_order, -avg(avg_price) / 1000 AS val_ll, avg(avg_discount) AS avg_dwell,
  max(avg_quantity) > 45 AS converged, sum(avg_quantity) AS bic, [7, 21, 42, 84, 168][{WK} % 5 + 1] AS seed FROM panel GROUP BY entity, {WK} % 5)"""
_FLAGS = ("filter_collapse", "filter_flip_flop", "filter_imbalanced", "filter_one_shot", "filter_k4_redundant")
_SCORES = ("score_A_profile_separation", "score_B_naming", "score_C_temporal", "score_D_downstream", "interpretability_score")
_ROLE = f"SELECT r.role, s.entity, s.K, s.n_pca, s.cov_type, {r6('s.val_ll_per_step', 'val_ll_per_step')}, s.interpretability_score, why.reason"
_Z = " UNION ALL ".join(
    f"SELECT state, '{c}' AS feature, (avg({c}) - (SELECT avg({c}) FROM panel)) / (SELECT stddev_samp({c}) FROM panel) AS z FROM panel GROUP BY state"
    for c in MEASURES
)

SQL = {
    "run_lengths": chain(PANEL, runs("panel", "entity", "r"))
    + "SELECT entity, run_id, state, min(week_end) AS start_week, max(week_end) AS end_week, count(*) AS run_length FROM r GROUP BY entity, run_id, state",
    "segments": chain(PANEL)
    + f""", sp AS (SELECT entity, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 7 DAY)) AS DATE) AS week_end
         FROM (SELECT entity, min(week_end) AS lo, max(week_end) AS hi FROM panel GROUP BY entity)),
       dense AS (SELECT sp.entity, sp.week_end, p.state FROM sp LEFT JOIN panel p ON p.entity = sp.entity AND p.week_end = sp.week_end),
       {runs('dense', 'entity', 'r')},
       st AS (SELECT entity, quantile_cont(s, 0.5) AS m FROM (SELECT entity, week_end - lag(week_end) OVER (PARTITION BY entity ORDER BY week_end) AS s FROM dense) GROUP BY entity)
       SELECT r.entity, run_id, state, min(week_end) AS start_week, max(week_end) AS end_week, CAST(coalesce(max(m), 7) AS DOUBLE) AS step_days,
         max(week_end) + CAST(ceil(coalesce(max(m), 7)) AS INTEGER) AS drawn_end
       FROM r JOIN st ON st.entity = r.entity WHERE state IS NOT NULL GROUP BY r.entity, run_id, state""",
    "dwell_stats": chain(PANEL, diag("panel", "entity", "d"))
    + f"SELECT entity, state, n_weeks, total_weeks, n_runs, first_start, in_early, in_late, {r6('pct', 'pct')}, {r6('avg_dur', 'avg_duration_wks')} FROM d",
    "occupancy": chain(PANEL)
    + f"""SELECT entity, s.state, count(*) FILTER (WHERE p.state = s.state) AS n_weeks, {r6('count(*) FILTER (WHERE p.state = s.state) / count(*)', 'pct')}
       FROM panel p JOIN (VALUES (0),(1),(2)) s(state) ON true GROUP BY entity, s.state""",
    "transition_matrix": chain(PANEL)
    + f""", nx AS (SELECT entity, state, lead(state) OVER (PARTITION BY entity ORDER BY week_end) AS nxt FROM panel),
       c AS (SELECT entity, i.v AS from_state, j.v AS to_state, count(*) FILTER (WHERE state = i.v AND nxt = j.v) AS n
         FROM nx JOIN (VALUES (0),(1),(2)) i(v) ON true JOIN (VALUES (0),(1),(2)) j(v) ON true GROUP BY 1, 2, 3)
       SELECT entity, from_state, to_state, n, {r6('coalesce(n / nullif(sum(n) OVER (PARTITION BY entity, from_state), 0), 0)', 'probability')} FROM c""",
    "regime_summary": chain(PANEL, runs("panel", "entity", "r"))
    + f"SELECT entity, state, count(*) AS n_weeks, {', '.join(r6(f'avg({c})', c) for c in MEASURES)}, {r6('count(*) / sum(starts)', 'avg_duration_wks')} FROM r GROUP BY entity, state",
    "regime_zprofile": chain(PANEL) + f"SELECT state, feature, {r6('z', 'z')} FROM ({_Z})",
    "regime_top_drivers": chain(PANEL)
    + f""", z AS ({_Z}), r AS (SELECT *, row_number() OVER (PARTITION BY state ORDER BY abs(z) DESC, feature DESC) AS k FROM z)
       SELECT state, feature, {r6('z', 'z')}, CASE WHEN z > 0 THEN 'HIGH' ELSE 'LOW' END AS direction FROM r WHERE k = 1""",
    "trend_labels": chain(PANEL)
    + f""", m AS (SELECT entity, week_end, ln(avg_price) - lag(ln(avg_price), 26) OVER (PARTITION BY entity ORDER BY week_end) AS m FROM panel),
       s AS (SELECT entity, week_end, CASE WHEN coalesce(stddev_samp(m) OVER (PARTITION BY entity), 0) = 0 THEN 0
          ELSE (m - avg(m) OVER (PARTITION BY entity)) / stddev_samp(m) OVER (PARTITION BY entity) END AS t FROM m)
       SELECT entity, week_end, {r6('t', 'trend_score')}, CASE WHEN t <= -0.5 THEN 0 WHEN t < 0.5 THEN 1 WHEN t >= 0.5 THEN 2 END AS trend_rank,
         CASE WHEN t <= -0.5 THEN 'Downtrend' WHEN t < 0.5 THEN 'Sideways' WHEN t >= 0.5 THEN 'Uptrend' END AS trend_name FROM s""",
    "regime_naming": chain(PANEL)
    + f""", g AS (SELECT entity, s.state, {', '.join(f"avg({c}) FILTER (WHERE p.state = s.state AND week_end <= DATE '1998-12-31') AS f_{c}, avg({c}) FILTER (WHERE p.state = s.state) AS a_{c}" for c in MEASURES)}
         FROM panel p JOIN (VALUES (0),(1),(2)) s(state) ON true GROUP BY entity, s.state),
       h AS (SELECT entity, state, {', '.join(f"CASE WHEN coalesce(f_avg_quantity, f_avg_discount, f_avg_price) IS NULL THEN a_{c} ELSE f_{c} END AS {c}" for c in MEASURES)} FROM g),
       i AS (SELECT entity, state, max(CASE WHEN coalesce(avg_quantity, avg_discount, avg_price) IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY entity) AS miss, avg_quantity, avg_discount, avg_price FROM h),
       j AS (SELECT entity, state, {', '.join(f"CASE WHEN miss = 1 THEN coalesce({c}, 0) ELSE {c} END AS {c}" for c in MEASURES)} FROM i),
       z AS (SELECT entity, state, {', '.join(f"CASE WHEN coalesce(stddev_samp({c}) OVER k, 0) = 0 THEN 0 ELSE ({c} - avg({c}) OVER k) / stddev_samp({c}) OVER k END AS z_{c}" for c in MEASURES)}
         FROM j WINDOW k AS (PARTITION BY entity)),
       s AS (SELECT entity, state, z_avg_quantity - (z_avg_discount + z_avg_price) / 2 AS sc FROM z),
       r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY sc NULLS LAST, state) - 1 AS rk FROM s)
       SELECT entity, state, {r6('sc', 'semantic_score')}, rk AS regime_rank, ['Stress', 'Neutral', 'Risk-on'][rk + 1] AS regime_name FROM r""",
    "action_given_regime": chain(PANEL)
    + f""", a AS (SELECT state, ({WK} * 5 + {WK} // 3) % 7 AS action_id, count(*) AS n FROM panel GROUP BY 1, 2)
       SELECT state, action_id, n, {r6('n / (sum(n) OVER (PARTITION BY state) + 1e-12)', 'share')} FROM a""",
    "state_shares": chain(PANEL)
    + f"""SELECT s.state, count(*) FILTER (WHERE p.state = s.state) AS n, {r6('count(*) FILTER (WHERE p.state = s.state) / count(*)', 'share')}
       FROM panel p JOIN (VALUES (0),(1),(2),(3)) s(state) ON true GROUP BY s.state""",
    "label_diagnostics": chain(CANDS)
    + f""", lab AS (SELECT entity, K, week_end, {CAND_STATE} AS state FROM pk), {wide('lab', 'entity, K', 'dev_', 'w')}
       SELECT entity, K, dev_n_active_states, {r6('dev_min_state_pct', 'dev_min_state_pct')}, {r6('dev_max_state_pct', 'dev_max_state_pct')},
         {r6('dev_min_avg_dur_wks', 'dev_min_avg_dur_wks')}, {', '.join(r6(c, c) for c in WIDE_COLS('dev_'))} FROM w""",
    "hard_filters": chain(GRID) + f"SELECT entity, K, {', '.join(_FLAGS)}, {r6('k4_min_profile_dist', 'k4_min_profile_dist')}, passes_hard_filters FROM tiered",
    "interp_scores": chain(GRID) + f"SELECT entity, K, {', '.join(_SCORES)}, interpretability_tier FROM tiered",
    "rejections": chain(GRID)
    + "SELECT count(*) AS n_candidates, count(*) FILTER (WHERE failed) AS n_failed, count(*) FILTER (WHERE passes_hard_filters) AS n_survivors, "
    + ", ".join(f"count(*) FILTER (WHERE {f}) AS n_{f}" for f in _FLAGS) + " FROM tiered",
    "model_selection": chain(GRID)
    + f""", allr AS (SELECT * FROM stat UNION ALL SELECT * FROM intp UNION ALL SELECT * FROM k3 UNION ALL SELECT * FROM rec)
       {_ROLE} FROM (VALUES ('statistical'), ('interpretable'), ('k3'), ('recommended')) r(role) JOIN why ON true LEFT JOIN allr s ON s.role = r.role""",
    "pipeline_choice": chain(GRID)
    + f""", c AS (SELECT 'project' AS chosen_role, 0 AS pr, * FROM rec UNION ALL SELECT 'statistical', 1, * FROM stat)
       SELECT chosen_role AS role, K, n_pca, cov_type, entity, {r6('val_ll_per_step', 'val_ll_per_step')}, interpretability_score, interpretability_tier FROM c ORDER BY pr LIMIT 1""",
    "best_seed": chain(SEEDS)
    + f"""SELECT entity, selected_seed, {r6('val_ll', 'val_ll')} FROM (SELECT entity, seed AS selected_seed, val_ll,
       row_number() OVER (PARTITION BY entity ORDER BY val_ll DESC, seed_order) AS k FROM seeds) WHERE k = 1""",
    "best_by_bic": chain(SEEDS)
    + f"""SELECT entity, seed_order, {r6('val_ll', 'val_ll')}, {r6('avg_dwell', 'avg_dwell')}, converged, {r6('bic', 'bic')}, seed FROM seeds
       ORDER BY converged DESC, round(bic, 6), round(avg_dwell, 6) DESC, entity, seed_order LIMIT 1""",
}
