"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

QUALITY_RULES = r"""
WITH
texts AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS host FROM documents
),
cut AS (
  SELECT r, doc_id, t, host, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM texts
),
placed AS (
  SELECT r, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM cut
),
windows AS (
  SELECT r, i, lead(w, 7) OVER p AS whole, concat_ws(' ', w, lead(w, 1) OVER p, lead(w, 2) OVER p, lead(w, 3) OVER p, lead(w, 4) OVER p, lead(w, 5) OVER p, lead(w, 6) OVER p, lead(w, 7) OVER p) AS g
  FROM placed WINDOW p AS (PARTITION BY r ORDER BY i)
),
again AS (
  SELECT r, i FROM windows WHERE whole IS NOT NULL QUALIFY count(*) OVER (PARTITION BY r, g) > 1
),
repeats AS (
  SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM again) AS x GROUP BY r
),
counts AS (
  SELECT cut.r, doc_id, t, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM cut LEFT JOIN repeats ON cut.r = repeats.r
),
held AS (
  SELECT r, doc_id, t, host, place, md5(regexp_replace(lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'))), '[0-9]', '0', 'g')) AS h,
    len(list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS w
  FROM (SELECT r, doc_id, t, host, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM cut) AS x
),
document AS (
  SELECT r, list_sort(list(DISTINCT h)) AS document FROM held GROUP BY r
),
frequent AS (
  SELECT host, h FROM (SELECT DISTINCT held.r, host, h, document FROM held JOIN document ON held.r = document.r) AS x
  GROUP BY host, h HAVING count(DISTINCT document) > 20
),
removed AS (
  SELECT DISTINCT doc_id, t, place, w FROM held JOIN frequent ON held.host = frequent.host AND held.h = frequent.h
),
totals AS (
  SELECT doc_id, t, n_words FROM counts GROUP BY doc_id, t, n_words
),
depleted AS (
  SELECT removed.doc_id, removed.t FROM removed JOIN totals ON removed.doc_id IS NOT DISTINCT FROM totals.doc_id AND removed.t = totals.t
  GROUP BY removed.doc_id, removed.t HAVING 100 * (max(n_words) - sum(w)) < 20 * max(n_words)
),
judged AS (
  SELECT counts.*, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, depleted.t IS NOT NULL AS gone
  FROM counts LEFT JOIN depleted ON counts.doc_id IS NOT DISTINCT FROM depleted.doc_id AND counts.t = depleted.t
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT gone AS kept FROM judged
"""

JACCARD_JOIN = r"""
WITH RECURSIVE
texts AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents
),
placed AS (
  SELECT doc_id, len(words) AS total, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM texts
),
runs AS (
  SELECT doc_id, total, i, concat_ws(' ', w, lead(w, 1) OVER p, lead(w, 2) OVER p, lead(w, 3) OVER p, lead(w, 4) OVER p) AS g
  FROM placed WINDOW p AS (PARTITION BY doc_id ORDER BY i)
),
shingles AS (
  SELECT DISTINCT doc_id, g FROM runs WHERE i <= total - 4 OR (total < 5 AND i = 1)
),
profile AS (
  SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS f FROM shingles GROUP BY doc_id
),
classes AS (
  SELECT f, min(doc_id) AS rep, max(n) AS n FROM profile GROUP BY f
),
grams AS (
  SELECT rep, n, g FROM classes JOIN shingles ON doc_id = rep
),
links AS (
  SELECT a.rep AS x, b.rep AS y FROM grams AS a JOIN grams AS b ON a.g = b.g AND a.rep < b.rep
  GROUP BY a.rep, b.rep HAVING 100 * count(*) >= 75 * (max(a.n) + max(b.n) - count(*))
),
both_ways AS (
  SELECT x, y FROM links UNION SELECT y, x FROM links
),
reach(x, y) AS (
  SELECT rep, rep FROM classes
  UNION
  SELECT reach.x, both_ways.y FROM reach JOIN both_ways ON reach.y = both_ways.x
),
roots AS (
  SELECT x, min(y) AS root FROM reach GROUP BY x
)
SELECT d.doc_id, coalesce(p.n, 0) AS n_shingles, coalesce(root, d.doc_id) AS component_id, coalesce(rep, d.doc_id) AS class_id
FROM documents AS d LEFT JOIN profile AS p ON p.doc_id = d.doc_id LEFT JOIN classes AS c ON c.f = p.f LEFT JOIN roots ON roots.x = c.rep
"""

ORACLES: dict[str, str] = {"op7_quality_rules": QUALITY_RULES, "op10_jaccard_join": JACCARD_JOIN}
