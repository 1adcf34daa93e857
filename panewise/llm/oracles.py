"""DuckDB statements of the queries that SQL can express on whole tables."""

from __future__ import annotations

_SPACES = r"'[\x20\x09-\x0D]+'"
_UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _shingles(table: str, key: str, lowered: str) -> str:
    """(key, row, g): the distinct runs of five words of each row, or its words if they are fewer."""
    return f"""(SELECT DISTINCT {key}, row_no, unnest(CASE
      WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
      WHEN len(ws) > 0 THEN ['\n' || array_to_string(ws, ' ')] ELSE [] END) AS g
    FROM (SELECT {key}, row_number() OVER () AS row_no,
        list_filter(regexp_split_to_array({lowered}, {_SPACES}), lambda x: x <> '') AS ws FROM {table}))"""


_REACH = """reach(a, b) AS (SELECT id, id FROM nodes UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
parts AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY a)"""

#: CRC-32 of an ASCII string, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_transform(range(1, length({0}) + 1), lambda i: ascii(substr({0}, i, 1))::BIGINT),
  lambda c, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END,
    xor(c, b)), 4294967295::BIGINT))"""
_SPACE = r"\x20\x09-\x0D"

ORACLES = {
    "op5_parity_join": f"""
WITH RECURSIVE s AS (SELECT doc_id, g FROM {_shingles("documents", "doc_id", f"translate(text, {_UPPER})")}),
n AS (SELECT d.doc_id, count(g) AS n FROM documents d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id),
nodes AS (SELECT doc_id AS id FROM n),
links AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y USING (g) GROUP BY ALL)
  JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE a <> b AND 100 * c >= 75 * (p.n + q.n - c)),
{_REACH}
SELECT doc_id, n AS n_shingles, component_id FROM n JOIN parts ON id = doc_id""",
    "op6_cover_tree": f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
nodes AS (SELECT vec_id AS id FROM embeddings),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
  WHERE list_cosine_similarity(x.e, y.e) >= 0.9),
{_REACH}
SELECT id AS vec_id, coalesce(n, 0) AS n_links, component_id, id = component_id AS kept
FROM parts LEFT JOIN (SELECT a AS id, count(*) AS n FROM links GROUP BY a) USING (id)""",
    "op10_containment": f"""
WITH d AS {_shingles("documents", "doc_id", "lower(text)")},
i AS (SELECT DISTINCT item_id, g FROM {_shingles("benchmark", "item_id", "lower(text)")}),
n AS (SELECT item_id, count(*) AS n_item FROM i GROUP BY item_id)
SELECT doc_id, item_id, max(c) AS n_common, n_item, max(c) / n_item AS containment
FROM (SELECT doc_id, row_no, item_id, count(*) AS c FROM d JOIN i USING (g) GROUP BY ALL) JOIN n USING (item_id)
WHERE c >= 0.75 * n_item GROUP BY doc_id, item_id, n_item""",
    "op13_conversation_repair": f"""
WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
kinds AS (SELECT *, {_CRC.format("k")} % 20 AS kind FROM keyed),
damaged AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM kinds WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged),
judged AS (SELECT *, left(role, 1) AS f, CASE WHEN NOT regexp_matches(text, '[^{_SPACE}]') THEN 'blank' WHEN seen > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][{_SPACE}]*$') THEN 'truncated' ELSE '' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM placed),
ids AS (SELECT conv_id, row_number() OVER () AS n FROM (SELECT DISTINCT conv_id FROM conversations)),
facts AS (SELECT ids.n, ids.conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(role) AS rows
  FROM ids LEFT JOIN judged ON judged.conv_id IS NOT DISTINCT FROM ids.conv_id GROUP BY ALL),
turns AS (SELECT n, i, role, text, f, fault FROM judged JOIN ids ON judged.conv_id IS NOT DISTINCT FROM ids.conv_id),
steps(q, f, p) AS (VALUES ('-', 's', 's'), ('-', 'u', 'u'), ('s', 'u', 'u'), ('u', 'a', 'a'), ('a', 'u', 'u')),
inserts(q, f, p, cost, initials, put) AS (
  SELECT q, '', q, 0, '', '' FROM (VALUES ('-'), ('s'), ('u'), ('a')) x(q) UNION ALL
  SELECT q, f, p, 3, 'I', CASE f WHEN 'u' THEN chr(10) || 'user:' ELSE chr(10) || 'assistant:' END FROM steps WHERE f <> 's' UNION ALL
  SELECT x.q, '', y.p, 6, 'II', CASE x.f WHEN 'u' THEN chr(10) || 'user:' || chr(10) || 'assistant:' ELSE chr(10) || 'assistant:' || chr(10) || 'user:' END
  FROM steps x JOIN steps y ON x.p = y.q WHERE x.f <> 's' AND y.f <> 's'),
best(n, i, q, x) AS (
  SELECT n, 0::BIGINT, '-', {{'c': 0::BIGINT, 'a': '', 'r': ''}} FROM ids UNION ALL
  SELECT n, i, q, min(x) FROM (
    SELECT b.n, t.i, e.q, {{'c': (b.x.c + s.cost + e.cost)::BIGINT, 'a': b.x.a || s.initials || e.initial, 'r': b.x.r || s.put || e.put}} AS x
    FROM best b JOIN turns t ON t.n = b.n AND t.i = b.i + 1 JOIN inserts s ON s.q = b.q, LATERAL (
      SELECT s.p AS q, 4 AS cost, 'D' AS initial, '' AS put UNION ALL
      SELECT p, CASE t.fault WHEN 'truncated' THEN 3 ELSE 0 END, 'K', chr(10) || t.role || ':' || t.text FROM steps
        WHERE steps.q = s.p AND steps.f = t.f AND t.fault NOT IN ('blank', 'duplicate') UNION ALL
      SELECT s.p, CASE t.fault WHEN 'truncated' THEN 3 ELSE 0 END, 'K', chr(10) || t.role || ':' || t.text
        WHERE t.f = '' AND t.fault NOT IN ('blank', 'duplicate') UNION ALL
      SELECT p, CASE t.fault WHEN 'truncated' THEN 6 ELSE 3 END, 'R', chr(10) || CASE f WHEN 'u' THEN 'user:' ELSE 'assistant:' END || t.text
        FROM steps WHERE steps.q = s.p AND f <> 's' AND t.fault NOT IN ('blank', 'duplicate')) e) GROUP BY n, i, q),
ends AS (SELECT n, min({{'c': (b.x.c + s.cost)::BIGINT, 'a': b.x.a || s.initials, 'r': b.x.r || s.put}}) AS x
  FROM best b JOIN facts USING (n) JOIN inserts s ON s.q = b.q WHERE b.i = facts.rows AND s.p IN ('-', 'a') GROUP BY n)
SELECT conv_id, gaps::BIGINT AS gaps, blank, duplicate, truncated, illegal, x.c AS cost, x.a AS audit, sha256(substr(x.r, 2)) AS repaired_sha256
FROM facts JOIN ends USING (n)""",
    "op12_zone_negatives": """
WITH q AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r, a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM q a JOIN q b ON a.r <> b.r AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM (
  SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.r, p.id ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON s.r = p.r AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score) WHERE rank <= 5""",
}
