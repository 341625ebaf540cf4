"""DuckDB twin of the source divergence audit: every kept term of every group and pair, spelled out in 128-bit integers."""

SOURCE_AUDIT = r"""
WITH doc AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
token AS (
  SELECT id, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM doc),
occurs AS (SELECT id, lang, source, term, count(*) AS n FROM token GROUP BY ALL),
kept AS (SELECT lang, term, CAST(sum(n) AS HUGEINT) AS n FROM occurs GROUP BY lang, term HAVING count(*) >= 3),
size AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
own AS (SELECT lang, source, term, CAST(sum(n) AS HUGEINT) AS n FROM occurs SEMI JOIN kept USING (lang, term) GROUP BY ALL),
total AS (
  SELECT g.lang, g.source, coalesce(sum(own.n), 0) AS n FROM (SELECT DISTINCT lang, source FROM doc) g LEFT JOIN own USING (lang, source) GROUP BY ALL),
share AS (
  SELECT t.lang, t.source, kept.term, coalesce(own.n, 0) AS n,
    CAST(1 + (1000000000 * (coalesce(own.n, 0) + 1)) // (t.n + size.v) AS HUGEINT) AS p,
    CAST(1 + (1000000000 * (kept.n + 1)) // (size.n + size.v) AS HUGEINT) AS q
  FROM total t JOIN size USING (lang) JOIN kept USING (lang) LEFT JOIN own ON own.lang = t.lang AND own.source = t.source AND own.term = kept.term),
pair AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM share a JOIN share b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
item AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pair.value, 0) AS value
  FROM total a JOIN total b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM share WHERE n > 0 AND p > q),
ranked AS (
  SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
    CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM item)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200
"""
