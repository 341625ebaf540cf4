"""DuckDB twin of the filter interaction audit: every order of the filters applied to every document, row by row."""

FILTER_AUDIT = r"""
WITH RECURSIVE text AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY text) AS first FROM text),
label AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
doc AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b,
    100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text) AS c,
    regexp_matches(text, '[#$%&*|]') AS d, coalesce(words.doc_id > first, false) AS e
  FROM words LEFT JOIN label USING (doc_id)),
failed AS (
  SELECT part, good, toxic, concat(CASE WHEN a THEN 'A' ELSE '' END, CASE WHEN b THEN 'B' ELSE '' END, CASE WHEN c THEN 'C' ELSE '' END,
    CASE WHEN d THEN 'D' ELSE '' END, CASE WHEN e THEN 'E' ELSE '' END) AS fails, count(*) AS n
  FROM doc GROUP BY ALL),
letter(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders(o) AS (
  SELECT x FROM letter UNION ALL SELECT o || x FROM orders, letter WHERE NOT contains(o, x)),
step AS (
  SELECT o AS filter_order, CAST(k AS INTEGER) AS step, o[k] AS filter, o[1:k - 1] AS before FROM orders, range(1, 6) r(k) WHERE length(o) = 5),
parts AS (SELECT DISTINCT part FROM doc),
counted AS (
  SELECT part, filter_order, step, filter,
    coalesce(sum(n) FILTER (WHERE translate(fails, before || filter, '') = fails), 0) AS kept,
    coalesce(sum(n) FILTER (WHERE contains(fails, filter) AND translate(fails, before, '') = fails), 0) AS removed,
    coalesce(sum(n) FILTER (WHERE contains(fails, filter) AND translate(fails, before, '') <> fails), 0) AS redundant,
    coalesce(sum(n) FILTER (WHERE fails = filter), 0) AS unique_fails,
    coalesce(sum(n) FILTER (WHERE good = 1 AND contains(fails, filter) AND translate(fails, before, '') = fails), 0) AS good_lost,
    coalesce(sum(n) FILTER (WHERE toxic = 1 AND contains(fails, filter) AND translate(fails, before, '') = fails), 0) AS toxic_lost
  FROM parts JOIN failed USING (part), step GROUP BY part, filter_order, step, filter)
SELECT part, filter_order, step, filter, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM counted
"""
