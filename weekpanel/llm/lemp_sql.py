"""The ranked lexical search in SQL: every document that shares a term with an item, scored."""

from __future__ import annotations

_TERMS = r"""unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term"""

STATEMENT = f"""
WITH doc_rows AS (SELECT row_number() OVER () AS id, doc_id, text FROM documents),
item_rows AS (SELECT row_number() OVER () AS item, item_id, text FROM benchmark),
doc_terms AS (SELECT id, {_TERMS} FROM doc_rows),
item_terms AS (SELECT item, {_TERMS} FROM item_rows),
tf AS (SELECT id, term, count(*) AS tf FROM doc_terms GROUP BY ALL),
lengths AS (SELECT id, count(*) AS n FROM doc_terms GROUP BY id),
total AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM lengths),
rarity AS (
    SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
    FROM tf, total GROUP BY term, n_docs
),
factor AS (SELECT id, 100 - 75 + (75 * n * n_docs) // n_terms AS m FROM lengths, total),
asked AS (SELECT item, term, count(*) AS times FROM item_terms GROUP BY ALL),
scored AS (
    SELECT item, id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
    FROM asked JOIN rarity USING (term) JOIN tf USING (term) JOIN factor USING (id) GROUP BY item, id
),
ranked AS (
    SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS FIRST) AS rank
    FROM scored JOIN doc_rows USING (id) JOIN item_rows USING (item) WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
