"""Hidden-Markov inference as recursive SQL, and BIC."""

from __future__ import annotations

from oracle.common import STATE, chain, r6
from oracle.news import CHOSEN, PIV
from oracle.sequences import PANEL, SEEDS

PI2 = "6.283185307179586"


def hmm(src: str, model: dict) -> str:
    """CTEs over ``src`` (entity, week_end, x1, x2): filtered, smoothed and best path."""
    def emission(k):
        m, v = model["means"][k], model["covars"][k]
        const = " + ".join(f"ln({PI2} * {x})" for x in v)
        return f"-0.5 * ({const} + pow(x1 - ({m[0]}), 2) / {v[0]} + pow(x2 - ({m[1]}), 2) / {v[1]})"

    s, a = model["start"], model["trans"]
    to = lambda k: f"(f.a0 * {a[0][k]} + f.a1 * {a[1][k]}) * exp(e.e{k})"
    back = lambda j: f"({a[j][0]} * exp(e.e0) * b.b0 + {a[j][1]} * exp(e.e1) * b.b1)"
    both = f"({back(0)} + {back(1)})"
    d = lambda k: f"greatest(v.d0 + ln({a[0][k]}), v.d1 + ln({a[1][k]})) + e.e{k}"
    bp = lambda k: f"CASE WHEN v.d0 + ln({a[0][k]}) >= v.d1 + ln({a[1][k]}) THEN 0 ELSE 1 END"
    return f"""
em AS (SELECT entity, week_end, row_number() OVER (PARTITION BY entity ORDER BY week_end) AS t, count(*) OVER (PARTITION BY entity) AS n,
  CAST({emission(0)} AS DOUBLE) AS e0, CAST({emission(1)} AS DOUBLE) AS e1 FROM {src}),
fw AS (SELECT entity, t, {s[0]} * exp(e0) / ({s[0]} * exp(e0) + {s[1]} * exp(e1)) AS a0, {s[1]} * exp(e1) / ({s[0]} * exp(e0) + {s[1]} * exp(e1)) AS a1,
    ln({s[0]} * exp(e0) + {s[1]} * exp(e1)) AS c FROM em WHERE t = 1
  UNION ALL SELECT e.entity, e.t, {to(0)} / ({to(0)} + {to(1)}), {to(1)} / ({to(0)} + {to(1)}), ln({to(0)} + {to(1)})
  FROM fw f JOIN em e ON e.entity = f.entity AND e.t = f.t + 1),
bw AS (SELECT entity, t, CAST(1 AS DOUBLE) AS b0, CAST(1 AS DOUBLE) AS b1 FROM em WHERE t = n
  UNION ALL SELECT b.entity, b.t - 1, {back(0)} / {both}, {back(1)} / {both} FROM bw b JOIN em e ON e.entity = b.entity AND e.t = b.t WHERE b.t > 1),
vt AS (SELECT entity, t, ln({s[0]}) + e0 AS d0, ln({s[1]}) + e1 AS d1, 0 AS p0, 0 AS p1 FROM em WHERE t = 1
  UNION ALL SELECT e.entity, e.t, {d(0)}, {d(1)}, {bp(0)}, {bp(1)} FROM vt v JOIN em e ON e.entity = v.entity AND e.t = v.t + 1),
pt AS (SELECT v.entity, v.t, CASE WHEN v.d0 >= v.d1 THEN 0 ELSE 1 END AS s FROM vt v JOIN em e ON e.entity = v.entity AND e.t = v.t WHERE e.t = e.n
  UNION ALL SELECT p.entity, p.t - 1, CASE WHEN p.s = 0 THEN v.p0 ELSE v.p1 END FROM pt p JOIN vt v ON v.entity = p.entity AND v.t = p.t WHERE p.t > 1)"""


SUPPLIER = {
    "start": [0.6, 0.4], "trans": [[0.9, 0.1], [0.2, 0.8]],
    "means": [[4.0, 2.0], [6.0, 3.0]], "covars": [[4.0, 1.5], [5.0, 2.0]],
}
MARKET = {
    "start": [0.5, 0.5], "trans": [[0.95, 0.05], [0.1, 0.9]],
    "means": [[0.5, 2.2], [-0.5, 2.6]], "covars": [[4.0, 0.1], [9.0, 0.2]],
}
EVENTS = {
    "start": [0.5, 0.5], "trans": [[0.98, 0.02], [0.03, 0.97]],
    "means": [[2.0, 1.0], [3.0, 3.0]], "covars": [[1.5, 1.2], [1.0, 0.9]],
}
LONG = chain("src AS (SELECT event_type AS entity, event_id AS week_end, ln(1 + value) AS x1, hour(ts) / 6 AS x2 FROM events)", hmm("src", EVENTS))


def posteriors(key: str, order: str) -> str:
    """Filtered, smoothed and best path of every row."""
    return f"""SELECT f.entity AS {key}, week_end AS {order}, {_FILTERED},
       {r6('a0 * b0 / (a0 * b0 + a1 * b1)', 'smoothed_prob_regime_0')}, {r6('a1 * b1 / (a0 * b0 + a1 * b1)', 'smoothed_prob_regime_1')}, p.s AS regime_viterbi
       FROM fw f JOIN em e ON e.entity = f.entity AND e.t = f.t JOIN bw b ON b.entity = f.entity AND b.t = f.t JOIN pt p ON p.entity = f.entity AND p.t = f.t"""


SRC = PANEL + ", src AS (SELECT entity, week_end, avg_discount * 100 AS x1, avg_quantity / 10 AS x2 FROM panel)"
BASE = chain(SRC, hmm("src", SUPPLIER))
_FILTERED = f"{r6('a0', 'filtered_prob_regime_0')}, {r6('a1', 'filtered_prob_regime_1')}"
_N = "((2 + entity % 3) - 1) + (2 + entity % 3) * ((2 + entity % 3) - 1) + (2 + entity % 3) * (seed_order + 2)"
_COV = "CASE WHEN entity % 2 = 0 THEN (seed_order + 2) ELSE (seed_order + 2) * (seed_order + 3) / 2 END"
_K = f"({_N} + (2 + entity % 3) * {_COV})"

# eigenvalues of the 3 x 3 covariance in closed form
_M = ("avg_quantity", "avg_discount", "avg_price")
_Z = lambda c: f"greatest(-10, least(10, ({c} - (SELECT avg({c}) FROM fit)) / (SELECT stddev_pop({c}) FROM fit)))"
PCA = PANEL + f""",
fit AS (SELECT * FROM panel WHERE week_end <= DATE '1998-12-31'),
z AS (SELECT {', '.join(f'{_Z(c)} AS {v}' for c, v in zip(_M, 'xyz'))} FROM fit),
cv AS (SELECT var_samp(x) AS a, var_samp(y) AS b, var_samp(z) AS c, covar_samp(x, y) AS d, covar_samp(x, z) AS e, covar_samp(y, z) AS f FROM z),
q AS (SELECT *, (a + b + c) / 3 AS q, sqrt((pow(a - (a + b + c) / 3, 2) + pow(b - (a + b + c) / 3, 2) + pow(c - (a + b + c) / 3, 2) + 2 * (d*d + e*e + f*f)) / 6) AS p FROM cv),
ph AS (SELECT *, acos(greatest(-1, least(1, ((a-q)*((b-q)*(c-q) - f*f) - d*(d*(c-q) - f*e) + e*(d*f - (b-q)*e)) / (p*p*p) / 2))) / 3 AS phi FROM q),
ev AS (SELECT q, q + 2 * p * cos(phi) AS l1, q + 2 * p * cos(phi + 2.0943951023931953) AS l3 FROM ph),
ex AS (SELECT l1 / (3 * q) AS r1, (3 * q - l1 - l3) / (3 * q) AS r2, l3 / (3 * q) AS r3 FROM ev)"""

SQL = {
    "pca_variance": chain(PCA)
    + f"""SELECT 1 AS component, {r6('r1', 'explained')}, {r6('r1', 'cumulative')}, true AS retained FROM ex
       UNION ALL SELECT 2, {r6('r2')}, {r6('r1 + r2')}, true FROM ex
       UNION ALL SELECT 3, {r6('r3')}, {r6('r1 + r2 + r3')}, r1 + r2 < 0.90 FROM ex""",
    "hmm_filter": BASE + f"SELECT f.entity, week_end, {_FILTERED}, {r6('greatest(a0, a1)', 'regime_confidence')} FROM fw f JOIN em e ON e.entity = f.entity AND e.t = f.t",
    "hmm_filter_native": BASE + f"SELECT f.entity, week_end, {_FILTERED} FROM fw f JOIN em e ON e.entity = f.entity AND e.t = f.t",
    "hmm_chunked": BASE + posteriors("entity", "week_end"),
    "hmm_long": LONG + posteriors("event_type", "event_id"),
    "hmm_smooth": BASE
    + f"""SELECT f.entity, week_end, {r6('a0 * b0 / (a0 * b0 + a1 * b1)', 'smoothed_prob_regime_0')}, {r6('a1 * b1 / (a0 * b0 + a1 * b1)', 'smoothed_prob_regime_1')}
       FROM fw f JOIN em e ON e.entity = f.entity AND e.t = f.t JOIN bw b ON b.entity = f.entity AND b.t = f.t""",
    "hmm_viterbi": BASE + "SELECT p.entity, week_end, p.s AS regime_viterbi FROM pt p JOIN em e ON e.entity = p.entity AND e.t = p.t",
    "hmm_score": BASE + f"SELECT entity, CAST(count(*) AS INTEGER) AS n_weeks, {r6('sum(c)', 'log_likelihood')}, {r6('sum(c) / count(*)', 'll_per_step')} FROM fw GROUP BY entity",
    "bic_table": chain(SEEDS)
    + f"SELECT entity, seed, CAST({_K} AS DOUBLE) AS n_parameters, {r6(f'-2 * (val_ll * 100) + {_K} * ln(300.0)', 'bic')} FROM seeds",
    "model_state_regimes": chain(STATE)
    + f""", src AS (SELECT 'core' AS entity, week_end, spy_ret_5d * 100 AS x1, vix_level / 10 AS x2 FROM state), {hmm('src', MARKET)}, {CHOSEN}
       SELECT s.week_end, {r6('spy_ret_5d', 'spy_ret_5d')}, {r6('vix_level', 'vix_level')}, CASE WHEN a0 >= a1 THEN 0 ELSE 1 END AS regime_filtered,
         pt.s AS regime_viterbi, {_FILTERED}, {', '.join(r6(f'coalesce({c}, 0)', c) for c in PIV)}, 'joined_market_macro_targets_regimes_news' AS source
       FROM state s JOIN em e ON e.week_end = s.week_end JOIN fw f ON f.t = e.t JOIN pt ON pt.t = e.t LEFT JOIN piv ON piv.week_end = s.week_end""",
}
