"""What the queries of passages, near duplicates and quality measures give, in DuckDB's SQL."""

from __future__ import annotations

_WORDS = r"'[^\x20\x09-\x0D]+'"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Every 200-byte string of every text, two hexadecimal digits a byte; the starts
#: of those that occur again, joined to runs; the bytes between the runs.
PASSAGES = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, i, md5(h[2 * i + 1 : 2 * i + 400]) AS m FROM (SELECT r, h, unnest(range(length(h) // 2 - 199)) AS i FROM d)),
s AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY m) AS c FROM w) WHERE c > 1),
g AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 200 THEN 0 ELSE 1 END AS fresh FROM s),
runs AS (SELECT r, min(i) AS a, max(i) + 200 AS z FROM (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS k FROM g) GROUP BY r, k),
parts AS (
  SELECT r, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS a, a AS z FROM runs
  UNION ALL SELECT d.r, coalesce(max(z), 0), any_value(length(h) // 2) FROM d LEFT JOIN runs ON runs.r = d.r GROUP BY d.r
), kept AS (SELECT d.r, string_agg(h[2 * a + 1 : 2 * z], '' ORDER BY a) AS k FROM d JOIN parts ON parts.r = d.r GROUP BY d.r)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST((length(h) - length(k)) // 2 AS BIGINT) AS n_removed,
  CAST(coalesce((SELECT count(*) FROM runs WHERE runs.r = d.r), 0) AS BIGINT) AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM d JOIN kept ON kept.r = d.r
"""

#: Pairs that share a shingle, those that reach 0.75, and what each document reaches.
NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, {_WORDS}), []) AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
reach(x, y) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w JOIN least ON least.x = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id
"""

QUALITY_MEASURES = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w FROM documents),
v AS (SELECT r, i, array_to_string(w[i : i + 4], ' ') AS k FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM v) WHERE c > 1),
covered AS (SELECT r, count(DISTINCT i + j) AS c FROM again, (SELECT unnest(range(5)) AS j) GROUP BY r),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {_WORDS})) AS lines, CAST(coalesce(c, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN covered ON covered.r = d.r)
SELECT doc_id, n_words, word_chars, n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m
"""
