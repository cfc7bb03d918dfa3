"""DuckDB statements for the trie, the manifest and the MinHash query, straight
from their definitions: prefixes as texts, trees level by level, all pairs
that share a shingle."""

from __future__ import annotations

# CRC-32 of a decimal number's text: bytes folded over a table made by the polynomial.
_CRC = """
crc_table AS (
  SELECT list(list_reduce([i] || range(8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(256)) AS i)
)"""


def _crc(number: str) -> str:
    text = f"CAST({number} AS VARCHAR)"
    codes = f"[ord({text}[i]) FOR i IN range(1, length({text}) + 1)]"
    return f"xor(list_reduce([4294967295] || {codes}, lambda c, b: xor(c >> 8, t[CAST((xor(c, b) & 255) + 1 AS BIGINT)])), 4294967295)"


OP11_SQL = f"""
WITH {_CRC}, turns AS (
  SELECT conv_id, COALESCE(role, '') AS role, COALESCE(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, COALESCE(role, ''), COALESCE(text, '')) - 1 AS idx
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, {_crc('conv_id')} % 6 AS h FROM (SELECT DISTINCT conv_id FROM turns), crc_table
), rebuilt AS (
  SELECT c.conv_id, 0 AS own, t.idx, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.idx < c.h
  UNION ALL
  SELECT c.conv_id, 1, t.idx, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.idx >= c.h
), placed AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, idx) AS depth, sha256(length(role) || ':' || role || text) AS turn, length(text) AS size
  FROM rebuilt
), paths AS (
  SELECT conv_id, depth, size, string_agg(turn, '') OVER (PARTITION BY conv_id ORDER BY depth) AS name,
         COALESCE(string_agg(turn, '') OVER (PARTITION BY conv_id ORDER BY depth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS parent
  FROM placed
  UNION ALL SELECT conv_id, 0, 0, '', NULL FROM convs
), lasts AS (SELECT conv_id, max(depth) AS d FROM paths GROUP BY conv_id
), nodes AS (
  SELECT p.name, any_value(p.parent) AS parent, any_value(p.depth) AS depth, any_value(p.size) AS size, count(*) AS n, min(p.conv_id) AS conv_id,
         sha256(COALESCE(string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id) FILTER (p.depth = l.d), '')) AS ends
  FROM paths p JOIN lasts l USING (conv_id) GROUP BY p.name
), children AS (SELECT parent AS name, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent
), sums AS (
  SELECT a.name, sum(CASE WHEN c.n IS NULL THEN 1 ELSE 0 END) AS leaves, sum((u.n - 1) * u.size) AS saved
  FROM nodes u LEFT JOIN children c ON c.name = u.name JOIN paths a ON a.conv_id = u.conv_id AND a.depth <= u.depth GROUP BY a.name
)
SELECT v.conv_id, CAST(v.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, v.n AS n_convs, COALESCE(c.n, 0) AS n_children,
       CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, v.ends AS ends_sha256
FROM nodes v JOIN sums s ON s.name = v.name LEFT JOIN children c ON c.name = v.name LEFT JOIN nodes p ON p.name = v.parent
"""


def _part(value: str) -> str:
    text = f"CAST({value} AS VARCHAR)"
    return f"COALESCE(strlen({text}) || ':' || {text}, '-')"


def _leaf(n_chars: str) -> str:
    return f"sha256({' || '.join(_part(c) for c in ('doc_id', 'source', 'lang', n_chars, 'text'))})"


OP12_SQL = f"""
WITH RECURSIVE {_CRC}, docs AS (
  SELECT doc_id, COALESCE('=' || lang, '') AS grp, {_leaf('n_chars')} AS leaf,
         CASE WHEN {_crc('doc_id')} % 7 = 0 THEN {_leaf('CAST(n_chars AS HUGEINT) + 1')} END AS claim
  FROM documents, crc_table
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n FROM docs
), tree AS (
  SELECT grp, 0 AS level, pos, n, leaf AS h FROM leaves
  UNION ALL
  SELECT grp, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM tree WHERE n > 1 GROUP BY grp, level, pos // 2, n
), subroots AS (SELECT grp, h, row_number() OVER (ORDER BY encode(grp)) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1
), top AS (
  SELECT 0 AS level, pos, n, h FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY level, pos // 2, n
), low_steps AS (
  SELECT l.grp, l.pos, list(CASE WHEN s.h IS NULL THEN '-' WHEN s.pos < a.pos THEN 'L' || s.h ELSE 'R' || s.h END ORDER BY a.level) AS steps
  FROM leaves l JOIN tree a ON a.grp = l.grp AND a.n > 1 AND a.pos = l.pos >> a.level
  LEFT JOIN tree s ON s.grp = a.grp AND s.level = a.level AND s.pos = xor(a.pos, 1) GROUP BY l.grp, l.pos
), top_steps AS (
  SELECT l.grp, list(CASE WHEN s.h IS NULL THEN '-' WHEN s.pos < a.pos THEN 'L' || s.h ELSE 'R' || s.h END ORDER BY a.level) AS steps
  FROM subroots l JOIN top a ON a.n > 1 AND a.pos = l.pos >> a.level LEFT JOIN top s ON s.level = a.level AND s.pos = xor(a.pos, 1) GROUP BY l.grp
), whole AS (
  SELECT l.doc_id, l.leaf, COALESCE(l.claim, l.leaf) AS claim, r.h AS subroot, (SELECT h FROM top WHERE n = 1) AS root,
         COALESCE(a.steps, CAST([] AS VARCHAR[])) || COALESCE(b.steps, CAST([] AS VARCHAR[])) AS steps
  FROM leaves l JOIN subroots r ON r.grp = l.grp LEFT JOIN low_steps a ON a.grp = l.grp AND a.pos = l.pos LEFT JOIN top_steps b ON b.grp = l.grp
), folded AS (
  SELECT *, sha256(list_aggregate([''] || [s[2:] FOR s IN steps IF s <> '-'], 'string_agg', '')) AS proof_sha256,
         list_reduce([claim] || steps, lambda acc, s: sha256(CASE s[1] WHEN 'L' THEN s[2:] || acc WHEN 'R' THEN acc || s[2:] ELSE acc END)) AS folded_root
  FROM whole
)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""

OP13_SQL = r"""
WITH RECURSIVE texts AS (
  SELECT row_number() OVER () AS id, doc_id,
         [w FOR w IN string_split_regex(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0b\f\r]+') IF w <> ''] AS w
  FROM documents
), sets AS (
  SELECT id, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) <= 4 THEN [array_to_string(w, ' ')]
                          ELSE list_distinct([array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)]) END AS s FROM texts
), items AS (SELECT id, unnest(s) AS x FROM sets
), pairs AS (
  SELECT a.id AS a, b.id AS b, count(*) AS common FROM items a JOIN items b ON a.x = b.x AND a.id <> b.id GROUP BY a.id, b.id
), links AS (
  SELECT a, b FROM pairs JOIN sets p ON p.id = a JOIN sets q ON q.id = b WHERE 100 * common >= 80 * (len(p.s) + len(q.s) - common)
), reach AS (SELECT id AS a, id AS b FROM sets UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.component_id, COALESCE(s.doc_id = m.component_id, false) AS kept
FROM sets s JOIN (SELECT reach.a, min(t.doc_id) AS component_id FROM reach JOIN sets t ON t.id = reach.b GROUP BY reach.a) m ON m.a = s.id
"""
