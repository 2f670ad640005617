"""DuckDB SQL that gives the rows of those named queries that SQL can express."""

from __future__ import annotations

EXACT_DEDUP = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

IMATCH = r"""
WITH rows AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n,
         coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id), first_value(coalesce(text, '')) OVER (ORDER BY doc_id)) AS next_text,
         coalesce(lead(doc_id) OVER (ORDER BY doc_id), first_value(doc_id) OVER (ORDER BY doc_id)) AS next_id
  FROM documents),
edited AS (
  SELECT *, substring(text, 1, n - n // 2) || substring(next_text, 1, n // 2) AS edited FROM rows),
versions AS (
  SELECT doc_id, FALSE AS is_edited, text FROM edited UNION ALL SELECT doc_id, TRUE, edited FROM edited),
terms AS (
  SELECT doc_id, is_edited, unnest(list_distinct(string_split_regex(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term
  FROM versions),
lexicon AS (
  SELECT term FROM terms WHERE NOT is_edited AND term <> '' GROUP BY term
  HAVING count(*) >= 0.01 * (SELECT count(*) FROM rows) AND count(*) <= 0.2 * (SELECT count(*) FROM rows)),
drawn AS (
  SELECT term, k, printf('%02d', k) || term AS key FROM lexicon, range(48) AS numbers(k)
  WHERE ('0x' || substr(md5(printf('%02d ', k) || term), 1, 4))::INT < [4096, 1024, 256][k // 16 + 1]),
hashes AS (
  SELECT doc_id, is_edited, k, substr(md5(string_agg(key, ' ' ORDER BY key)), 1, 8) AS hash
  FROM terms JOIN drawn USING (term) GROUP BY doc_id, is_edited, k),
prints AS (
  SELECT v.doc_id, v.is_edited, list(coalesce(h.hash, '') ORDER BY v.k) AS prints
  FROM (SELECT doc_id, is_edited, k FROM versions, range(48) AS numbers(k)) v
  LEFT JOIN hashes h ON h.doc_id = v.doc_id AND h.is_edited = v.is_edited AND h.k = v.k
  GROUP BY v.doc_id, v.is_edited),
pairs AS (
  SELECT e.doc_id, e.next_id, n, sha256(edited) AS edited_sha256, text = edited AS unchanged, text = next_text AS repeated, a.prints AS own, b.prints AS changed, c.prints AS following
  FROM edited e
  JOIN prints a ON a.doc_id = e.doc_id AND NOT a.is_edited
  JOIN prints b ON b.doc_id = e.doc_id AND b.is_edited
  JOIN prints c ON c.doc_id = e.next_id AND NOT c.is_edited),
scored AS (
  SELECT p.doc_id, other, s,
         len(list_filter(range(16 * s + 1, 16 * s + 17), lambda i: own[i] <> '' OR o[i] <> '')) AS used,
         len(list_filter(range(16 * s + 1, 16 * s + 17), lambda i: own[i] <> '' AND own[i] = o[i])) AS same,
         same_text OR (own = o AND array_to_string(own, '') <> '') AS equal
  FROM (SELECT doc_id, own, 'changed' AS other, changed AS o, unchanged AS same_text FROM pairs
        UNION ALL SELECT doc_id, own, 'following', following, repeated FROM pairs) p, range(3) AS sizes(s)),
likeness AS (
  SELECT doc_id, other, CASE WHEN bool_or(equal) THEN 1.0 ELSE max(same::DOUBLE / greatest(used, 4)) END AS likeness
  FROM scored GROUP BY doc_id, other)
SELECT p.doc_id, p.next_id, p.n AS n_chars, edited_sha256, array_to_string(own, '.') AS fingerprint,
       array_to_string(changed, '.') AS edited_fingerprint,
       a.likeness::DOUBLE AS near_edited, b.likeness::DOUBLE AS near_next
FROM pairs p
JOIN likeness a ON a.doc_id = p.doc_id AND a.other = 'changed'
JOIN likeness b ON b.doc_id = p.doc_id AND b.other = 'following'
"""

NEAR_DEDUP = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingle
  FROM split WHERE len(words) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n
  FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * shared.n >= 75 * (p.n + q.n - shared.n)),
reach AS (
  SELECT doc_id AS id, doc_id AS other FROM documents
  UNION SELECT reach.id, links.y FROM reach JOIN links ON links.x = reach.other)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, r.component_id, d.doc_id = r.component_id AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id
JOIN (SELECT id, min(other) AS component_id FROM reach GROUP BY id) r ON r.id = d.doc_id
"""

LINE_DEDUP = r"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM split),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
shared AS (
  SELECT key, max(doc_id) AS keep_id FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT k.doc_id, pos, line, coalesce(k.doc_id <> s.keep_id, FALSE) AS dropped
  FROM keyed k LEFT JOIN shared s ON s.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

ORACLE: dict[str, str] = {
    "op12_line_dedup": LINE_DEDUP,
    "op9_exact_dedup": EXACT_DEDUP,
    "op6_near_dedup": NEAR_DEDUP,
    "op7_imatch": IMATCH,
}
