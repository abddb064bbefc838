"""SQL of the operators whose whole result SQL can give: conversation repair and vector codes."""

#: The checksum is spelled out by its polynomial; states of the pattern carry (cost, audit, repaired text), of which the first two decide.
OP11_SQL = r"""
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
h AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT))),
      lambda c, b: xor(t.t[CAST((xor(c, b) & 255) + 1 AS BIGINT)], c >> 8))) % 20 AS k FROM conversations, t),
r AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM h JOIN (SELECT unnest([1, 2]) AS copy) ON copy = 1 OR k = 3 WHERE k <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, right(regexp_replace(text, '[\x20\x09-\x0D]+$', ''), 1) AS mark FROM r),
f AS (SELECT *, left(role, 1) AS c, CASE WHEN mark = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN mark IN ('.', '!', '?') THEN 'f' ELSE 't' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS p FROM o),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (i > 1 AND p || c NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM f GROUP BY conv_id),
z AS (SELECT {'c': 1000000000, 'a': '', 't': ''} AS no),
w AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, {'c': 0, 'a': '', 't': ''} AS s0, no AS s1, no AS s2, no AS s3 FROM n, z
  UNION ALL
  SELECT conv_id, i, list_min([d0]), list_min([d1, k1]), list_min([d2, k2, r2]), list_min([d3, k3, r3]) FROM (
    SELECT conv_id, i,
      {'c': e0.c + 4, 'a': e0.a || 'D', 't': e0.t} AS d0, {'c': e1.c + 4, 'a': e1.a || 'D', 't': e1.t} AS d1, {'c': e2.c + 4, 'a': e2.a || 'D', 't': e2.t} AS d2, {'c': e3.c + 4, 'a': e3.a || 'D', 't': e3.t} AS d3,
      CASE WHEN stay AND c = 's' THEN {'c': e0.c + more, 'a': e0.a || 'K', 't': e0.t || line} ELSE no END AS k1,
      CASE WHEN stay AND c = 'u' THEN {'c': u.c + more, 'a': u.a || 'K', 't': u.t || line} ELSE no END AS k2,
      CASE WHEN stay AND c = 'a' THEN {'c': e2.c + more, 'a': e2.a || 'K', 't': e2.t || line} ELSE no END AS k3,
      CASE WHEN stay THEN {'c': u.c + more + 3, 'a': u.a || 'R', 't': u.t || chr(10) || 'user:' || text} ELSE no END AS r2,
      CASE WHEN stay THEN {'c': e2.c + more + 3, 'a': e2.a || 'R', 't': e2.t || chr(10) || 'assistant:' || text} ELSE no END AS r3, no
    FROM (SELECT *, list_min([e0, e1, e3]) AS u FROM (
      SELECT w.conv_id, f.i, f.c, f.text, chr(10) || f.role || ':' || f.text AS line, f.fault IN ('f', 't') AS stay, CASE WHEN f.fault = 't' THEN 3 ELSE 0 END AS more, no, s0 AS e0, s1 AS e1,
        list_min([s2, {'c': s0.c + 3, 'a': s0.a || 'I', 't': s0.t || chr(10) || 'user:'}, {'c': s1.c + 3, 'a': s1.a || 'I', 't': s1.t || chr(10) || 'user:'}, {'c': s3.c + 3, 'a': s3.a || 'I', 't': s3.t || chr(10) || 'user:'}]) AS e2,
        list_min([s3, {'c': s2.c + 3, 'a': s2.a || 'I', 't': s2.t || chr(10) || 'assistant:'}, {'c': s0.c + 6, 'a': s0.a || 'II', 't': s0.t || chr(10) || 'user:' || chr(10) || 'assistant:'},
          {'c': s1.c + 6, 'a': s1.a || 'II', 't': s1.t || chr(10) || 'user:' || chr(10) || 'assistant:'}]) AS e3
      FROM w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1, z)))),
e AS (SELECT w.conv_id, list_min([s0, s3, {'c': s1.c + 6, 'a': s1.a || 'II', 't': s1.t || chr(10) || 'user:' || chr(10) || 'assistant:'}, {'c': s2.c + 3, 'a': s2.a || 'I', 't': s2.t || chr(10) || 'assistant:'}]) AS s
    FROM w JOIN n ON n.conv_id IS NOT DISTINCT FROM w.conv_id AND w.i = n.n)
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
    CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(s.c, 0) AS BIGINT) AS cost, coalesce(s.a, '') AS audit, sha256(coalesce(substr(s.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM a.conv_id
"""

_ASSIGN = """
D{n} AS MATERIALIZED (SELECT p.r, p.part, min({{'d': list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - b.x[i]) * (p.x[i] - b.x[i]))), 'e': b.e}}) AS m FROM P p JOIN B{n} b USING (part) GROUP BY p.r, p.part)"""
_MOVE = """,
C{n} AS (SELECT part, e, i, CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS BIGINT) AS v FROM (SELECT D{n}.part, m.e AS e, unnest(P.x) AS x, generate_subscripts(P.x, 1) AS i FROM D{n} JOIN P USING (r, part)) GROUP BY part, e, i),
B{k} AS MATERIALIZED (SELECT b.part, b.e, coalesce(c.x, b.x) AS x FROM B{n} b LEFT JOIN (SELECT part, e, list(v ORDER BY i) AS x FROM C{n} GROUP BY part, e) c ON c.part = b.part AND c.e = b.e),"""
OP13_SQL = (
    r"""
WITH V AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
P AS MATERIALIZED (SELECT r, part, v[part * (len(v) // 16) + 1:(part + 1) * (len(v) // 16)] AS x FROM V, (SELECT unnest(range(16)) AS part)),
B0 AS MATERIALIZED (SELECT part, r - 1 AS e, x FROM P WHERE r <= 64),"""
    + _ASSIGN.format(n=0) + _MOVE.format(n=0, k=1) + _ASSIGN.format(n=1) + _MOVE.format(n=1, k=2) + _ASSIGN.format(n=2)
    + r""",
S AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM B2),
R AS (SELECT r, string_agg(printf('%02x', m.e), '' ORDER BY part) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM D2 GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM R JOIN V USING (r), S
"""
)
