"""Ingestion and parsing queries."""

from __future__ import annotations

from oracle.common import MACRO, SERIES_META, chain, r6
from oracle.news import ARTICLES, clean, normalize
from weekpanel.constants import ARTICLE_PATH_EXCLUSIONS

SERIES = """CASE o_orderpriority WHEN '1-URGENT' THEN 'DFF' WHEN '2-HIGH' THEN 'T10Y3M' WHEN '3-MEDIUM' THEN 'NFCI'
  WHEN '4-NOT SPECIFIED' THEN 'CPIAUCSL' WHEN '5-LOW' THEN 'UNRATE' END"""
_TAG = """'(?is)<a\\s(?:[^>]*?\\s)?href\\s*=\\s*"([^"]*)"[^>]*>(.*?)</a>'"""
ANCHORS = f"""
anc AS (SELECT page_id, url, html, unnest(regexp_extract_all(html, {_TAG}, 1)) AS href, unnest(regexp_extract_all(html, {_TAG}, 2)) AS raw,
  unnest(range(len(regexp_extract_all(html, {_TAG}, 1)))) AS pos FROM pages)"""
_PATH = " OR ".join(f"contains(path, '{p}')" for p in ARTICLE_PATH_EXCLUSIONS)

_HEAD = "regexp_extract(html, '(?is)<h1(?:\\s[^>]*)?>(.*?)</h1\\s*>', 1)"
# matching blocks: maximal common runs per diagonal, the longest of a segment first, then the segments left and right of it
LINKS = f"""
pg AS (SELECT page_id, url, regexp_extract(url, '^([a-z]+://[^/]*)/([a-z]+)', 1) AS root, regexp_extract(url, '^[a-z]+://[^/]*/([a-z]+)', 1) AS lang,
  regexp_extract(url, '^[^?#]*') AS bare, {clean(f"regexp_replace({_HEAD}, '(?s)<[^>]*>', ' ', 'g')")} AS title FROM pages),
en AS (SELECT t.page_id, s.page_id - t.page_id AS step, t.title, s.page_id AS k, t.root, s.lang, t.bare, CASE WHEN ends_with(t.bare, '/') THEN t.lang || '/' ELSE '' END AS above,
  {clean("""regexp_replace(CASE WHEN s.page_id = t.page_id THEN list_aggregate([w for w, i in string_split(s.title, ' ') if (i - 1 + s.page_id) % 5 <> 0], 'string_agg', ' ')
     ELSE substr(s.title, 1, 120) END, '[<>&]', ' ', 'g')""")} AS label
  FROM pg t JOIN pg s ON s.page_id BETWEEN t.page_id - 2 AND t.page_id + 2),
ln AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY step DESC) - 1 AS pos, title, label, CASE k % 4 WHEN 0 THEN root || '/' || lang || '/' || k
  WHEN 1 THEN root || '/' || above || lang || '/story-' || k WHEN 2 THEN root || '/deep/' || k || '.html' ELSE bare || '?post_type=news&p=' || k END AS link FROM en),
nm AS (SELECT *, {normalize('title')} AS t, coalesce({normalize('label')}, '') AS l, {normalize('label', 'link')} AS a FROM ln WHERE label <> ''),
chars AS (SELECT page_id, pos, i, j, i - j AS g FROM (SELECT page_id, pos, t, l, unnest(range(length(t))) AS i FROM nm) x, LATERAL (SELECT unnest(range(length(x.l))) AS j) y
  WHERE t[i + 1] = l[j + 1]),
isles AS (SELECT page_id, pos, g, i, i - row_number() OVER (PARTITION BY page_id, pos, g ORDER BY i) AS isle FROM chars),
runs AS (SELECT page_id, pos, min(i) AS ri, min(i) - g AS rj, count(*) AS n FROM isles GROUP BY page_id, pos, g, isle),
blocks AS (
  SELECT page_id, pos, 0 AS alo, length(t) AS ahi, 0 AS blo, length(l) AS bhi, 0 AS size FROM nm
  UNION ALL
  SELECT page_id, pos, CASE side WHEN 0 THEN alo ELSE bi + n END, CASE side WHEN 0 THEN bi ELSE ahi END,
    CASE side WHEN 0 THEN blo ELSE bj + n END, CASE side WHEN 0 THEN bj ELSE bhi END, CASE side WHEN 0 THEN n ELSE 0 END
  FROM (SELECT *, row_number() OVER (PARTITION BY page_id, pos, alo, ahi, blo, bhi ORDER BY n DESC, bi, bj) AS place
    FROM (SELECT s.page_id, s.pos, alo, ahi, blo, bhi, greatest(ri, alo, blo + ri - rj) AS bi, greatest(ri, alo, blo + ri - rj) - (ri - rj) AS bj,
        least(ri + r.n, ahi, bhi + ri - rj) - greatest(ri, alo, blo + ri - rj) AS n
      FROM blocks s JOIN runs r ON r.page_id = s.page_id AND r.pos = s.pos WHERE alo < ahi AND blo < bhi) WHERE n > 0) best, (SELECT unnest([0, 1]) AS side)
  WHERE place = 1),
matched AS (SELECT page_id, pos, sum(size) AS m FROM blocks GROUP BY ALL),
scored AS (SELECT nm.page_id, nm.pos, link, CASE WHEN length(t) + length(l) = 0 THEN 10.0 ELSE 20.0 * m / (length(t) + length(l)) END
    + len(list_filter(list_filter(string_split(t, ' '), lambda w: length(w) >= 4)[1:6], lambda w: contains(' ' || a || ' ', ' ' || w || ' '))) AS score
  FROM nm JOIN matched USING (page_id, pos)
  WHERE NOT ({_PATH.replace('path', "lower(regexp_extract(link, '^[a-z]+://[^/?#]*([^?#]*)', 1))")}))"""

# fixed values, stated here once more: the named selections and the series
_PRESETS = """('compact', 'DFF'), ('compact', 'DGS10'), ('compact', 'T10Y2Y'), ('compact', 'T10YIE'), ('compact', 'NFCI'), ('compact', 'ICSA'), ('compact', 'CPIAUCSL'), ('compact', 'UNRATE'), ('compact', 'INDPRO'), ('compact', 'UMCSENT'),
  ('core', 'DFF'), ('core', 'DGS3MO'), ('core', 'DGS10'), ('core', 'T10Y3M'), ('core', 'T10YIE'), ('core', 'NFCI'), ('core', 'BAMLH0A0HYM2'), ('core', 'VIXCLS'), ('core', 'DTWEXBGS'), ('core', 'WRESBAL'), ('core', 'ICSA'), ('core', 'UNRATE'), ('core', 'CPIAUCSL'), ('core', 'CFNAI'), ('core', 'UMCSENT'), ('core', 'PERMIT'),
  ('core_plus_duration', 'DFF'), ('core_plus_duration', 'DGS3MO'), ('core_plus_duration', 'DGS10'), ('core_plus_duration', 'DGS30'), ('core_plus_duration', 'T10Y3M'), ('core_plus_duration', 'T10YIE'), ('core_plus_duration', 'NFCI'), ('core_plus_duration', 'BAMLH0A0HYM2'), ('core_plus_duration', 'VIXCLS'), ('core_plus_duration', 'DTWEXBGS'), ('core_plus_duration', 'WRESBAL'), ('core_plus_duration', 'ICSA'), ('core_plus_duration', 'UNRATE'), ('core_plus_duration', 'CPIAUCSL'), ('core_plus_duration', 'CFNAI'), ('core_plus_duration', 'UMCSENT'), ('core_plus_duration', 'PERMIT'),
  ('extended', 'DFF'), ('extended', 'DGS3MO'), ('extended', 'DGS10'), ('extended', 'DGS30'), ('extended', 'T10Y3M'), ('extended', 'T10YIE'), ('extended', 'T5YIFR'), ('extended', 'NFCI'), ('extended', 'ANFCI'), ('extended', 'STLFSI4'), ('extended', 'BAMLH0A0HYM2'), ('extended', 'BAMLC0A4CBBB'), ('extended', 'VIXCLS'), ('extended', 'DTWEXBGS'), ('extended', 'WRESBAL'), ('extended', 'ICSA'), ('extended', 'CC4WSA'), ('extended', 'CPIAUCSL'), ('extended', 'UNRATE'), ('extended', 'PAYEMS'), ('extended', 'CFNAI'), ('extended', 'UMCSENT'), ('extended', 'PERMIT'), ('extended', 'MORTGAGE30US')"""
_META = """('DFF', 'rates', 'daily', 'Effective Federal Funds Rate', 'level, 5d change'),
  ('DGS10', 'rates', 'daily', '10-Year Treasury Constant Maturity Rate', 'level, 5d change'),
  ('DGS30', 'rates', 'daily', '30-Year Treasury Constant Maturity Rate', 'level, 5d change'),
  ('DGS3MO', 'rates', 'daily', '3-Month Treasury Constant Maturity Rate', 'level, 5d change'),
  ('T10Y2Y', 'yield_curve', 'daily', '10-Year Treasury Constant Maturity Minus 2-Year Treasury Constant Maturity', 'level, sign, 5d change'),
  ('T10Y3M', 'yield_curve', 'daily', '10-Year Treasury Constant Maturity Minus 3-Month Treasury Constant Maturity', 'level, sign, 5d change'),
  ('T10YIE', 'inflation_expectations', 'daily', '10-Year Breakeven Inflation Rate', 'level, 5d change'),
  ('T5YIFR', 'inflation_expectations', 'daily', '5-Year, 5-Year Forward Inflation Expectation Rate', 'level, 5d change'),
  ('NFCI', 'financial_conditions', 'weekly', 'Chicago Fed National Financial Conditions Index', 'level, 4w change'),
  ('ANFCI', 'financial_conditions', 'weekly', 'Chicago Fed Adjusted National Financial Conditions Index', 'level, 4w change'),
  ('STLFSI4', 'financial_stress', 'weekly', 'St. Louis Fed Financial Stress Index', 'level, 4w change'),
  ('BAMLH0A0HYM2', 'credit_spreads', 'daily', 'ICE BofA US High Yield Index Option-Adjusted Spread', 'level, 5d change'),
  ('BAMLC0A4CBBB', 'credit_spreads', 'daily', 'ICE BofA BBB US Corporate Index Option-Adjusted Spread', 'level, 5d change'),
  ('VIXCLS', 'market_risk', 'daily', 'CBOE Volatility Index: VIX', 'level, 5d change'),
  ('DTWEXBGS', 'dollar', 'daily', 'Trade Weighted US Dollar Index: Broad, Goods and Services', 'level, 5d pct change'),
  ('WRESBAL', 'liquidity', 'weekly', 'Reserve Balances with Federal Reserve Banks', 'log level, 4w pct change'),
  ('ICSA', 'labor', 'weekly', 'Initial Claims', 'log level, 4w change'),
  ('CC4WSA', 'labor', 'weekly', 'Continued Claims: 4-Week Moving Average', 'log level, 4w change'),
  ('CPIAUCSL', 'inflation', 'monthly', 'Consumer Price Index for All Urban Consumers: All Items in U.S. City Average', '12m pct change'),
  ('UNRATE', 'labor', 'monthly', 'Unemployment Rate', 'level, 3m change'),
  ('PAYEMS', 'labor', 'monthly', 'All Employees, Total Nonfarm', '12m pct change'),
  ('INDPRO', 'activity', 'monthly', 'Industrial Production: Total Index', '12m pct change'),
  ('CFNAI', 'activity', 'monthly', 'Chicago Fed National Activity Index', 'level, 3m average'),
  ('UMCSENT', 'sentiment', 'monthly', 'University of Michigan: Consumer Sentiment', 'level, 3m change'),
  ('PERMIT', 'housing', 'monthly', 'New Private Housing Units Authorized by Building Permits', '12m pct change'),
  ('MORTGAGE30US', 'housing', 'weekly', '30-Year Fixed Rate Mortgage Average in the United States', 'level, 4w change')"""

SQL = {
    "series_cleanup": chain(SERIES_META)
    + f""", raw AS (SELECT {SERIES} AS series_id, o_orderkey, CAST(o_orderdate AS DATE) AS date, o_totalprice AS value FROM orders WHERE o_orderstatus <> 'P'),
       lastr AS (SELECT date, series_id, arg_max(value, o_orderkey) AS value FROM raw GROUP BY 1, 2)
       SELECT date, l.series_id, {r6('value', 'value')}, category, frequency, description, suggested_transform, 'raw_orders' AS source
       FROM lastr l JOIN series_meta m ON m.series_id = l.series_id""",
    # what must go: every pending order, one value of it or (low priority) two
    "series_rejects": """SELECT o_orderkey AS loaded, column, reason, raw FROM orders JOIN (VALUES
         ('1-URGENT', 'date', 'unreadable', 'n/a'), ('2-HIGH', 'value', 'unreadable', '.'), ('3-MEDIUM', 'value', 'missing', ' '),
         ('4-NOT SPECIFIED', 'series_id', 'unknown', 'XRATE'), ('5-LOW', 'date', 'unreadable', 'n/a'), ('5-LOW', 'value', 'unreadable', '.')
       ) AS bad(priority, "column", reason, raw) ON priority = o_orderpriority WHERE o_orderstatus = 'P'""".replace("loaded, column,", 'loaded, "column",'),
    "source_fallback": f"""WITH o AS (SELECT {SERIES} AS series_id, o_orderkey, o_orderstatus, round(o_totalprice, 2) AS value FROM orders),
       s AS (SELECT *, 'primary' AS source, 0 AS p FROM o WHERE o_orderstatus = 'F' AND series_id IN ('DFF', 'NFCI')
         UNION ALL SELECT *, 'mirror', 1 FROM o WHERE o_orderstatus = 'O' AND series_id IN ('DFF', 'T10Y3M', 'UNRATE')
         UNION ALL SELECT *, 'archive', 2 FROM o WHERE o_orderstatus = 'P'),
       b AS (SELECT *, min(p) OVER (PARTITION BY series_id) AS best FROM s)
       SELECT series_id, o_orderkey, o_orderstatus, value, source FROM b WHERE p = best""",
    "upsert_rows": chain(ARTICLES)
    + """, n AS (SELECT * FROM (SELECT asset, week_end, title, summary, url, row_number() OVER (PARTITION BY asset, week_end ORDER BY url DESC) AS k FROM art) WHERE k = 1),
       o AS (SELECT * FROM (SELECT asset, week_end, title, summary, url, row_number() OVER (PARTITION BY asset, week_end ORDER BY url) AS k FROM art) WHERE k = 1),
       j AS (SELECT n.asset, n.week_end, coalesce(o.summary, '') <> '' AND (coalesce(n.title, '') = '' OR coalesce(n.summary, '') = '') AS keep,
         n.title AS nt, n.summary AS ns, n.url AS nu, o.title AS ot, o.summary AS os, o.url AS ou FROM n LEFT JOIN o ON o.asset = n.asset AND o.week_end = n.week_end)
       SELECT asset, week_end, CASE WHEN keep THEN ot ELSE nt END AS title, CASE WHEN keep THEN os ELSE ns END AS summary, CASE WHEN keep THEN ou ELSE nu END AS url FROM j""",
    "label_lines": """WITH l AS (SELECT d.doc_id, quality, string_split(text, chr(10)) AS ls FROM documents d JOIN labels b ON b.doc_id = d.doc_id),
       e AS (SELECT doc_id, quality, unnest(range(len(ls))) AS line_no, unnest(ls) AS line FROM l)
       SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CASE doc_id % 4 WHEN 0 THEN 'all_agree' WHEN 1 THEN 'agree_75' WHEN 2 THEN 'agree_66' ELSE 'agree_50' END AS agreement_level,
         trim(regexp_replace(line, '^\\s+|\\s+$', '', 'g')) AS sentence, CASE WHEN quality = 1 THEN 'positive' ELSE 'negative' END AS label
       FROM e WHERE trim(regexp_replace(line, '[\\s\\x{00A0}]+', ' ', 'g')) <> ''""",
    "html_pairs": chain(ANCHORS) + f"SELECT page_id, CAST(pos AS INTEGER) AS pos, href, {clean('raw')} AS label FROM anc",
    "table_pairs": f"""SELECT o_orderkey, 0 AS pos, CAST(o_orderdate AS DATE) AS date, {r6('o_totalprice', 'value')} FROM orders
       UNION ALL SELECT o_orderkey, 1, CAST(o_orderdate AS DATE) + 1, -1.5 FROM orders""",
    "article_links": chain(LINKS)
    + f"""SELECT page_id, arg_max(link, row(score, -pos)) AS link, {r6('max(score)', 'score')} FROM scored WHERE score >= 8 GROUP BY page_id""",
    "flatten_news": """SELECT CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'TLT' END AS requested_symbol, CAST(event_id AS VARCHAR) AS news_id,
       'STORY' AS content_type, 'Report on ' || event_type AS title, CASE WHEN event_id % 3 <> 0 THEN 'user ' || CAST(user_id AS VARCHAR) ELSE '' END AS summary,
       strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS published_at, 'desk' AS publisher, 'https://x.example/a' AS canonical_url, CAST(NULL AS VARCHAR) AS click_url,
       'SPY,' || upper(event_type) AS related_tickers, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS query_relevance_heuristic, 'news_json' AS source FROM events""",
    "news_dedupe": """SELECT upper(event_type) AS requested_symbol, event_id // 3 AS news_id, min(event_id) AS event_id,
       arg_min(row(CASE WHEN user_id % 7 <> 0 AND user_id % 11 <> 0 THEN date_trunc('second', ts) END), event_id)[1] AS published_at FROM events GROUP BY 1, 2""",
    "news_time_rejects": """SELECT event_id, 'published_at' AS "column", CASE WHEN user_id % 11 = 0 THEN 'missing' ELSE 'unreadable' END AS reason,
       CASE WHEN user_id % 11 = 0 THEN '' ELSE 'yesterday' END AS raw FROM events WHERE user_id % 7 = 0 OR user_id % 11 = 0""",
    "preset_coverage": chain(MACRO)
    + f""", presets(preset, series_id) AS (VALUES {_PRESETS}), meta(series_id, category, frequency, description, suggested_transform) AS (VALUES {_META}),
       held AS (SELECT series_id, count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date FROM macro GROUP BY series_id)
       SELECT preset, p.series_id, category, frequency, description, suggested_transform, coalesce(n_rows, 0) AS n_rows, first_date, last_date
       FROM presets p JOIN meta USING (series_id) LEFT JOIN held USING (series_id)""",
    "period_dates": """SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN CAST(date_trunc('month', o_orderdate) AS DATE) END AS period_start,
       CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS DATE) END AS header_date, CAST(o_orderdate AS DATE) AS cell_date
       FROM orders""",
}
