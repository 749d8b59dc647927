"""Data-profiling queries."""

from __future__ import annotations

from itertools import combinations, combinations_with_replacement

from oracle.common import FEATURES, WEEKLY, chain, r6
from oracle.sequences import MEASURES, PANEL

LINE = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def union(template, columns, sep=" UNION ALL "):
    return sep.join(template(c) for c in columns)


def skew(c):
    return f"CASE WHEN stddev_pop({c}) > 0 THEN avg(pow({c} - m_{c}, 3)) / pow(stddev_pop({c}), 3) END"


def kurt(c):
    return f"CASE WHEN stddev_pop({c}) > 0 THEN avg(pow({c} - m_{c}, 4)) / pow(stddev_pop({c}), 4) - 3 END"


def centred(src, columns, key):
    return f"cen AS (SELECT *, {', '.join(f'avg({c}) OVER (PARTITION BY {key}) AS m_{c}' for c in columns)} FROM {src})"


def moment_row(c, key, extra=""):
    return (
        f"SELECT {key}, '{c}' AS feature, count({c}) AS n, {r6(f'avg({c})', 'mean')}, {r6(f'stddev_samp({c})', 'std')}, {r6(f'min({c})', 'min')}, "
        f"{r6(f'max({c})', 'max')}, {r6(f'max({c}) - min({c})', 'range')}, {r6(skew(c), 'skewness')}, {r6(kurt(c), 'kurtosis')}{extra} FROM cen GROUP BY {key}"
    )


def corr(a, b):
    return f"corr(CASE WHEN {b} IS NOT NULL THEN {a} END, CASE WHEN {a} IS NOT NULL THEN {b} END)"


_BOX = """SELECT {key}'{c}' AS feature, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS med, quantile_cont({c}, 0.75) AS q3 FROM panel {group}"""
_LAGS = ", ".join(f"lag(c, {k}) OVER w AS l{k}" for k in range(1, 21))
_STD = lambda c: f"greatest(-10, least(10, ({c} - (SELECT avg({c}) FROM fit)) / (SELECT stddev_pop({c}) FROM fit)))"
_RAW = lambda c: f"({c} - (SELECT avg({c}) FROM fit)) / (SELECT stddev_pop({c}) FROM fit)"
_FIT = PANEL + ", fit AS (SELECT * FROM panel WHERE week_end <= DATE '1998-12-31')"

SQL = {
    "percentiles": union(
        lambda c: " UNION ALL ".join(
            f"SELECT '{c}' AS feature, CAST({p} AS DOUBLE) AS p, {r6(f'quantile_cont({c}, {p})', 'value')} FROM lineitem" for p in (0.01, 0.25, 0.5, 0.75, 0.99)
        ), LINE),
    "profile": chain(centred("lineitem", LINE, "l_returnflag"))
    + union(lambda c: moment_row(c, "l_returnflag", "".join(f", {r6(f'quantile_cont({c}, {p / 100})', f'p{p}')}" for p in (25, 50, 75))), LINE),
    "moments": chain(PANEL, centred("panel", MEASURES, "state")) + union(lambda c: moment_row(c, "state"), MEASURES),
    "iqr_outliers": chain(PANEL)
    + union(lambda c: f"""SELECT '{c}' AS feature, {r6('max(q1 - 1.5 * (q3 - q1))', 'lower_bound')}, {r6('max(q3 + 1.5 * (q3 - q1))', 'upper_bound')},
        count(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS n_outliers,
        {r6(f'count(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) / count(*) * 100', 'outlier_pct')}
        FROM panel, ({_BOX.format(key='', c=c, group='')}) b""", MEASURES),
    "box_stats": chain(PANEL)
    + union(lambda c: f"""SELECT p.state, '{c}' AS feature, {r6('max(q1)', 'q1')}, {r6('max(med)', 'median')}, {r6('max(q3)', 'q3')}, count(*) AS n,
        {r6(f'least(min({c}) FILTER (WHERE {c} >= q1 - 1.5 * (q3 - q1)), max(q1))', 'whisker_low')},
        {r6(f'greatest(max({c}) FILTER (WHERE {c} <= q3 + 1.5 * (q3 - q1)), max(q3))', 'whisker_high')}
        FROM panel p JOIN ({_BOX.format(key='state, ', c=c, group='GROUP BY state')}) b ON b.state = p.state GROUP BY p.state""", MEASURES),
    "missingness": chain(WEEKLY)
    + union(lambda c: f"SELECT '{c}' AS feature, count(*) FILTER (WHERE {c} IS NULL) AS n_missing, {r6(f'count(*) FILTER (WHERE {c} IS NULL) / count(*) * 100', 'missing_pct')} FROM market", FEATURES),
    "duplicate_rows": """SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(n - 1) AS BIGINT) AS n_duplicates FROM (
       SELECT count(*) AS n FROM lineitem GROUP BY l_quantity, l_discount, l_tax, l_returnflag, l_suppkey)""",
    "corr_matrix": " UNION ALL ".join(
        f"SELECT l_returnflag, '{a}' AS feature_a, '{b}' AS feature_b, {r6(corr(a, b), 'r')} FROM lineitem GROUP BY l_returnflag"
        for a, b in combinations_with_replacement(LINE, 2)
    ),
    "corr_pairs": chain(WEEKLY)
    + ", one AS (SELECT " + ", ".join(f"{corr(a, b)} AS c{i}" for i, (a, b) in enumerate(combinations(FEATURES, 2))) + " FROM market)"
    + " SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {r6(f'c{i}', 'r')} FROM one" for i, (a, b) in enumerate(combinations(FEATURES, 2))
    ) + ") WHERE abs(r) > 0.8",
    "histogram": union(
        lambda c: f"""SELECT '{c}' AS feature, CAST(least(floor(({c} - lo) / (hi - lo) * 50), 49) AS INTEGER) AS bin, count(*) AS n,
        {r6(f'max(lo) + CAST(least(floor(({c} - lo) / (hi - lo) * 50), 49) AS INTEGER) * (max(hi) - max(lo)) / 50', 'bin_start')},
        {r6('count(*) / max(total) / ((max(hi) - max(lo)) / 50)', 'density')}
        FROM lineitem, (SELECT min({c}) AS lo, max({c}) AS hi, count(*) AS total FROM lineitem) b
        GROUP BY CAST(least(floor(({c} - lo) / (hi - lo) * 50), 49) AS INTEGER)""", LINE),
    "acf": chain(PANEL)
    + f""", c AS (SELECT entity, week_end, avg_price - avg(avg_price) OVER (PARTITION BY entity) AS c FROM panel),
       l AS (SELECT *, c AS l0, {_LAGS} FROM c WINDOW w AS (PARTITION BY entity ORDER BY week_end)) """
    + union(lambda k: f"SELECT entity, {k} AS lag, {r6(f'sum(c * l{k}) / nullif(sum(c * c), 0)', 'acf')} FROM l GROUP BY entity", range(21)),
    "acf_filter": chain(PANEL)
    + f", l AS (SELECT *, {', '.join(f'lag({c}) OVER w AS p_{c}' for c in MEASURES)} FROM panel WINDOW w AS (PARTITION BY entity ORDER BY week_end)) "
    + union(lambda c: f"SELECT entity, '{c}' AS feature, {r6(f'CASE WHEN count(p_{c}) >= 2 THEN {corr(c, f'p_{c}')} END', 'acf_1')}, coalesce(CASE WHEN count(p_{c}) >= 2 THEN abs({corr(c, f'p_{c}')}) >= 0.3 END, false) AS persistent FROM l GROUP BY entity", MEASURES),
    "standardize": chain(_FIT) + f"SELECT entity, week_end, {', '.join(r6(_STD(c), c) for c in MEASURES)} FROM panel",
    "scaling_checks": chain(_FIT)
    + f", z AS (SELECT {', '.join(f'{_RAW(c)} AS {c}' for c in MEASURES)} FROM fit) SELECT {r6('greatest(' + ', '.join(f'abs(avg({c}))' for c in MEASURES) + ')', 'mean_abs_max')}, "
    + f"{r6('least(' + ', '.join(f'stddev_pop({c})' for c in MEASURES) + ')', 'std_min')}, {r6('greatest(' + ', '.join(f'stddev_pop({c})' for c in MEASURES) + ')', 'std_max')} FROM z",
    "min_max_scaled": chain(PANEL)
    + f"""SELECT entity, week_end,
       {r6('(avg_price - min(avg_price) OVER (PARTITION BY entity)) / (max(avg_price) OVER (PARTITION BY entity) - min(avg_price) OVER (PARTITION BY entity) + 1e-12)', 'scaled')} FROM panel""",
    "cumulative_returns": chain(WEEKLY)
    + ", long AS (" + union(lambda a: f"SELECT panel, week_end, '{a}_ret_20d' AS feature, {a}_ret_20d AS value FROM market", ("spy", "tlt", "gld"))
    + f") SELECT panel, week_end, feature, {r6('value', 'value')}, {r6('sum(value) OVER (PARTITION BY feature ORDER BY week_end)', 'cumulative')} FROM long WHERE value IS NOT NULL",
}
