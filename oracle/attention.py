"""Attention and attribution queries."""

from __future__ import annotations

from oracle.common import chain, r6

NAMES = "['price_a', 'macro_a', 'text_a', 'prev_alloc_spy']"
V = "v AS (SELECT vec_id AS step, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)"


def argmax(i: int, n: int) -> str:
    """Zero-based position of the maximum of e[i..i+n-1], first on ties."""
    return f"list_position(e[{i + 1}:{i + n}], list_max(e[{i + 1}:{i + n}])) - 1"


W = V + f""",
reg AS (SELECT step, e, [{', '.join(argmax(16 + 3 * p, 3) for p in range(4))}] AS regimes, {argmax(53, 7)} AS action_id FROM v),
w AS (SELECT step, CAST(q AS INTEGER) AS query_pos, CAST(k AS INTEGER) AS key_pos, CAST(action_id AS INTEGER) AS action_id,
  CAST(regimes[q + 1] AS INTEGER) AS qr, CAST(regimes[k + 1] AS INTEGER) AS kr,
  abs(e[4 * q + k + 1]) / (abs(e[4 * q + 1]) + abs(e[4 * q + 2]) + abs(e[4 * q + 3]) + abs(e[4 * q + 4])) AS weight
  FROM reg JOIN (SELECT unnest(range(4)) AS q) ON true JOIN (SELECT unnest(range(4)) AS k) ON true),
latest AS (SELECT * FROM w WHERE query_pos = 3)"""
G = V + """,
g AS (SELECT step, i, CAST(i // 4 AS INTEGER) AS timestep_pos, """ + NAMES + """[i % 4 + 1] AS feature, abs(e[28 + i + 1]) AS grad,
  abs(e[28 + i + 1] * e[44 + i + 1]) AS gx FROM v JOIN (SELECT unnest(range(16)) AS i) ON true),
att AS (SELECT timestep_pos, feature, avg(gx) AS attribution FROM g GROUP BY 1, 2),
sal AS (SELECT timestep_pos, feature, avg(share) AS saliency FROM (SELECT *, grad / (sum(grad) OVER (PARTITION BY step) + 1e-12) AS share FROM g) GROUP BY 1, 2)"""
H = W + """,
s0 AS (SELECT step, t, abs(e[28 + 4*t + 1]) + abs(e[28 + 4*t + 2]) + abs(e[28 + 4*t + 3]) + abs(e[28 + 4*t + 4]) AS m FROM v JOIN (SELECT unnest(range(4)) AS t) ON true),
sl AS (SELECT step, t, m / (sum(m) OVER (PARTITION BY step) + 1e-12) AS sal FROM s0),
b AS (SELECT l.step, l.key_pos AS pos, l.weight AS aw, s.sal AS sw, l.action_id, kr FROM latest l JOIN sl s ON s.step = l.step AND s.t = l.key_pos),
h0 AS (SELECT step, pos, 'trend' AS head, aw * (1.30 + (0.70 - 1.30) * pos / 3) AS x FROM b
  UNION ALL SELECT step, pos, 'risk', sw * (0.70 + (1.35 - 0.70) * pos / 3) FROM b
  UNION ALL SELECT step, pos, 'local', 0.55 * aw + 0.45 * sw FROM b),
h AS (SELECT step, pos, head, x / (sum(x) OVER (PARTITION BY step, head) + 1e-12) AS w FROM h0)"""

SQL = {
    "attention_mean": chain(W) + f"SELECT query_pos, key_pos, {r6('avg(weight)', 'weight')} FROM w GROUP BY query_pos, key_pos",
    "attention_importance": chain(W) + f"SELECT key_pos, {r6('avg(m)', 'importance')} FROM (SELECT query_pos, key_pos, avg(weight) AS m FROM w GROUP BY 1, 2) GROUP BY key_pos",
    "attention_regime_pairs": chain(W)
    + f"""SELECT CAST(i AS INTEGER) AS query_regime, CAST(j AS INTEGER) AS key_regime, {r6('coalesce(avg(weight), 0)', 'weight')}
       FROM (SELECT unnest(range(3)) AS i) JOIN (SELECT unnest(range(3)) AS j) ON true LEFT JOIN w ON qr = i AND kr = j GROUP BY i, j""",
    "attention_latest_regime": chain(W) + f"SELECT kr AS key_regime, {r6('avg(weight)', 'attention')} FROM latest GROUP BY kr",
    "attention_by_action": chain(W) + f"SELECT action_id, key_pos, {r6('avg(weight)', 'attention')} FROM w GROUP BY action_id, key_pos",
    "attention_concentration": chain(W)
    + f""", p AS (SELECT step, sum(abs(weight - 0.25)) AS l1, -sum(weight * ln(weight + 1e-12)) / ln(4.0) AS ent, max(weight) AS top1 FROM latest GROUP BY step)
       SELECT {r6('min(weight)', 'min_weight')}, {r6('max(weight)', 'max_weight')}, {r6('avg(weight)', 'mean_weight')}, {r6('stddev_pop(weight)', 'std_weight')},
         CAST(0.25 AS DOUBLE) AS uniform_weight, {r6('(SELECT avg(l1) FROM p)', 'avg_l1_to_uniform')}, {r6('(SELECT avg(ent) FROM p)', 'avg_norm_entropy')},
         {r6('(SELECT avg(top1) FROM p)', 'avg_top1_share')},
         CASE WHEN (SELECT avg(ent) FROM p) > 0.95 THEN 'very diffuse' WHEN (SELECT avg(ent) FROM p) > 0.85 THEN 'moderately diffuse' ELSE 'concentrated' END AS verdict FROM latest""",
    "attribution_features": chain(G) + f"SELECT timestep_pos, feature, {r6('attribution', 'attribution')} FROM att",
    "attribution_groups": chain(G)
    + f""", p AS (SELECT timestep_pos, CASE feature WHEN 'price_a' THEN 'price' WHEN 'macro_a' THEN 'macro' WHEN 'text_a' THEN 'text' ELSE 'prev_alloc' END AS grp, attribution FROM att)
       SELECT timestep_pos, grp AS "group", {r6('sum(attribution)', 'attribution')}, {r6('avg(sum(attribution)) OVER (PARTITION BY grp)', 'group_mean')} FROM p GROUP BY timestep_pos, grp""",
    "attribution_top": chain(G) + f"SELECT timestep_pos, feature, {r6('attribution', 'attribution')} FROM att WHERE timestep_pos = 3 ORDER BY att.attribution DESC, feature LIMIT 3",
    "saliency_features": chain(G) + f"SELECT timestep_pos, feature, {r6('saliency', 'saliency')} FROM sal",
    "saliency_importance": chain(G) + f"SELECT feature, {r6('sum(saliency) / (SELECT sum(saliency) FROM sal)', 'importance')} FROM sal GROUP BY feature",
    "named_heads": chain(H) + f"SELECT head, CAST(pos AS INTEGER) AS pos, {r6('avg(w)', 'mean_weight')}, 't-' || CAST(3 - pos AS VARCHAR) AS token FROM h GROUP BY head, pos",
    "head_focus": chain(H) + f"SELECT step, head, {r6('w', 'recent_focus')} FROM h WHERE pos = 3",
    "q_confidence": chain(V)
    + f"""SELECT step, CAST({argmax(53, 7)} AS INTEGER) AS action_id, {r6('list_sort(e[54:60])[7] - list_sort(e[54:60])[6]', 'confidence_gap')},
       {r6('list_max(e[54:60])', 'q_max')} FROM v""",
    "explain_table": chain(H)
    + f""", r AS (SELECT step, step // 52 AS episode, e[61] * 0.05 AS weekly_return FROM v),
       c AS (SELECT *, product(1 + weekly_return) OVER (PARTITION BY episode ORDER BY step ROWS UNBOUNDED PRECEDING) - 1 AS cum_return FROM r),
       p AS (SELECT step, max(action_id) AS action_id, max(CASE WHEN pos = 3 THEN aw END) AS ar, max(CASE WHEN pos = 3 THEN sw END) AS sr,
         -sum(aw * ln(aw + 1e-12)) AS ent, arg_max(pos, aw) AS lag, max(CASE WHEN pos = 3 THEN kr END) AS kr FROM b GROUP BY step)
       SELECT episode, c.step, action_id, {r6('weekly_return', 'weekly_return')}, {r6('cum_return', 'cum_return')}, {r6('ar', 'attn_recent')}, {r6('sr', 'sal_recent')},
         {r6('ent', 'attn_entropy')}, CAST(lag AS INTEGER) AS dominant_lag, 't-' || CAST(3 - lag AS VARCHAR) AS dominant_token, 'Regime_' || CAST(kr AS VARCHAR) AS regime_name
       FROM c JOIN p ON p.step = c.step""",
}
