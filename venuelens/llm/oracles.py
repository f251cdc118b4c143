"""SQL of the registered queries whose results SQL can state."""

from __future__ import annotations

#: Equal five-word windows q words apart, in a row, are a stretch of period q. CRC-32 is worked out bit by bit.
PERIODIC_RUNS = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
    list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT) AS bytes
  FROM documents),
h AS (
  SELECT r, doc_id, ws, len(ws) AS n,
    xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, b:
      list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                  lambda x, y: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT) AS h
  FROM d),
g AS (
  SELECT r, doc_id, ws, n, h % 10 = 0 AND n > 0 AS planted, (h // 10) % nullif(n, 0) AS a,
    1 + (n - (h // 10) % nullif(n, 0)) // (3 + (h // 10) % 8) AS p
  FROM h),
o AS (SELECT r, unnest(range(n)) AS i, planted, a, p, ws FROM g WHERE n > 0),
w AS MATERIALIZED (SELECT r, i, CASE WHEN planted AND i >= a THEN ws[a + (i - a) % p + 1] ELSE ws[i + 1] END AS v FROM o),
f AS (
  SELECT r, i, v, lead(v) OVER t AS v1, lead(v, 2) OVER t AS v2, lead(v, 3) OVER t AS v3, lead(v, 4) OVER t AS v4,
    count(*) OVER (PARTITION BY r) AS n
  FROM w WINDOW t AS (PARTITION BY r ORDER BY i)),
pairs AS (
  SELECT x.r, x.i, y.i - x.i AS q FROM f x JOIN f y
    ON x.r = y.r AND x.v = y.v AND x.v1 = y.v1 AND x.v2 = y.v2 AND x.v3 = y.v3 AND x.v4 = y.v4
    AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
places AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k FROM pairs),
rows_of AS (SELECT r, q, min(i) AS s, count(*) + 4 + q AS len FROM places GROUP BY r, q, k HAVING count(*) + 4 + q >= 4 * q),
runs AS MATERIALIZED (SELECT r, s, len, min(q) AS q FROM rows_of GROUP BY r, s, len),
best AS (
  SELECT r, count(*) AS n_runs, arg_min({'s': s, 'len': len, 'q': q}, (-len, s, q)) AS top,
    string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS listed
  FROM runs GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(s + q, s + len)) AS i FROM runs),
left_over AS (
  SELECT r, string_agg(v, ' ' ORDER BY i) AS text FROM (SELECT w.* FROM w ANTI JOIN gone USING (r, i)) z GROUP BY r)
SELECT g.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, top.s::BIGINT AS start, top.len::BIGINT AS length, top.q::BIGINT AS period,
  (1000 * top.len // top.q)::BIGINT AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256,
  sha256(coalesce(left_over.text, '')) AS collapsed_sha256
FROM g LEFT JOIN best USING (r) LEFT JOIN left_over USING (r)
"""

COLLOCATIONS = r"""
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS r,
    string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces
  FROM documents),
p AS (SELECT lang, r, unnest(range(len(pieces))) AS piece, unnest(pieces) AS body FROM t),
q AS (SELECT lang, r, piece, regexp_extract_all(body, '[^\x20\x09]+') AS ws FROM p),
w AS MATERIALIZED (SELECT lang, r, piece, unnest(range(len(ws))) AS i, unnest(ws) AS w FROM q),
o AS (SELECT lang, w AS w1, lead(w) OVER k AS w2, lead(w, 2) OVER k AS w3 FROM w WINDOW k AS (PARTITION BY r, piece ORDER BY i)),
f1 AS MATERIALIZED (SELECT lang, w1 AS w, count(*) AS f FROM o GROUP BY ALL),
f2 AS MATERIALIZED (SELECT lang, w1, w2, count(*) AS f FROM o WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
f3 AS MATERIALIZED (SELECT lang, w1, w2, w3, count(*) AS f FROM o WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
cuts AS (
  SELECT f2.lang, f2.w1 || ' ' || f2.w2 AS phrase, f2.f AS a, 1 AS k, x.f AS l, y.f AS r
  FROM f2 JOIN f1 x ON x.lang = f2.lang AND x.w = f2.w1 JOIN f1 y ON y.lang = f2.lang AND y.w = f2.w2
  WHERE NOT EXISTS (SELECT 1 FROM f3 WHERE f3.lang = f2.lang AND f3.w1 = f2.w1 AND f3.w2 = f2.w2 AND 100 * f3.f >= 50 * f2.f)
    AND NOT EXISTS (SELECT 1 FROM f3 WHERE f3.lang = f2.lang AND f3.w2 = f2.w1 AND f3.w3 = f2.w2 AND 100 * f3.f >= 50 * f2.f)
  UNION ALL
  SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3, f3.f, 1, x.f, y.f
  FROM f3 JOIN f1 x ON x.lang = f3.lang AND x.w = f3.w1 JOIN f2 y ON y.lang = f3.lang AND y.w1 = f3.w2 AND y.w2 = f3.w3
  UNION ALL
  SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3, f3.f, 2, x.f, y.f
  FROM f3 JOIN f2 x ON x.lang = f3.lang AND x.w1 = f3.w1 AND x.w2 = f3.w2 JOIN f1 y ON y.lang = f3.lang AND y.w = f3.w3),
scored AS (SELECT *, (1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS score FROM cuts),
least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM least),
n AS (SELECT lang, sum(f) AS n FROM f1 GROUP BY lang)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
