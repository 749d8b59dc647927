"""The secret scan in SQL."""

from __future__ import annotations

_ASSIGN = (
    "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    """["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
)


def _matches(rank: int, pattern: str, group: int) -> str:
    return f"""SELECT id, {rank} AS rank, unnest(string_split_regex(body, '{pattern}')) AS gap,
        unnest(regexp_extract_all(body, '{pattern}')) AS whole, unnest(regexp_extract_all(body, '{pattern}', {group})) AS value,
        generate_subscripts(string_split_regex(body, '{pattern}'), 1) AS k FROM texts"""


STATEMENT = f"""
WITH texts AS (
    SELECT row_number() OVER () AS id, doc_id, coalesce(source, chr(1)) AS owner, coalesce(lang, chr(1)) AS lang, coalesce(text, '') AS body
    FROM documents
), matches AS (
    {_matches(0, _ASSIGN, 2)}
    UNION ALL {_matches(1, "AKIA[A-Z0-9]+", 0)}
    UNION ALL {_matches(2, "[0-9a-f]+", 0)}
    UNION ALL {_matches(3, "[A-Za-z0-9+/_=-]+", 0)}
), placed AS (
    SELECT id, rank, value, length(whole) AS size,
           sum(length(gap) + coalesce(length(whole), 0)) OVER (PARTITION BY id, rank ORDER BY k) AS last
    FROM matches
), fit AS (
    SELECT id, rank, value, last - size AS first, last FROM placed
    WHERE length(value) >= CASE rank WHEN 0 THEN 6 WHEN 1 THEN 20 WHEN 2 THEN 24 ELSE 16 END
      AND (rank < 3 OR (regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')))
), candidates AS (
    SELECT * FROM fit AS a WHERE rank < 3 OR NOT EXISTS (
        SELECT 1 FROM fit AS b WHERE b.rank < 3 AND a.id = b.id AND b.first < a.last AND a.first < b.last)
), counts AS (
    SELECT value, count(DISTINCT owner) AS owners FROM candidates JOIN texts USING (id) GROUP BY value
), judged AS (
    SELECT c.*, owners > 2 AS copied, owners <= 2 AND len(list_distinct(string_split(value, ''))) >= 8 AS owned,
           CASE rank WHEN 0 THEN 'assign' WHEN 1 THEN 'access' WHEN 2 THEN 'hex' ELSE 'owned' END || ':' ||
           CAST(first AS VARCHAR) || ':' || CAST(last AS VARCHAR) AS shown
    FROM candidates c JOIN counts USING (value)
), listed AS (
    SELECT id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
           string_agg(shown, ',' ORDER BY first, rank) FILTER (rank < 3) AS base,
           string_agg(shown, ',' ORDER BY first, rank) FILTER (rank < 3 OR owned) AS spans,
           count(*) FILTER (owned) AS n_owned, count(*) FILTER (rank < 3 AND copied) AS n_copied
    FROM judged GROUP BY id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(n_owned, 0) AS n_owned, coalesce(n_copied, 0) AS n_copied
FROM texts LEFT JOIN listed USING (id)
"""
