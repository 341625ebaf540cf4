"""DuckDB SQL of the URL filter query: the tree grows level by level in a recursive query, to the longest path."""

#: Shares of a child and of its siblings apart, in standard errors; corrected for continuity below a variable point.
_Z = ("(abs(bad / nullif(known, 0) - (ab - bad) / nullif(ak - known, 0)) - CASE WHEN variable THEN (1 / nullif(known, 0) + 1 / nullif(ak - known, 0)) / 2 ELSE 0 END)"
      " / sqrt(nullif((ab / nullif(ak, 0)) * (1 - ab / nullif(ak, 0)) * (1 / nullif(known, 0) + 1 / nullif(ak - known, 0)), 0))")

URL_FILTER = f"""WITH RECURSIVE lab AS (SELECT doc_id AS page_id, max(CASE WHEN quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels
  WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1),
u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
s AS (SELECT *, list_filter(string_split(regexp_replace(path, '[0-9]+', '0', 'g'), '/'), lambda x: x <> '') AS seg FROM p),
c AS (SELECT page_id, host, path, seg AS parts FROM s),
t0 AS (SELECT host, parts, count(*) AS n, count(bad) AS known, coalesce(sum(bad), 0) AS bad FROM c LEFT JOIN lab USING (page_id) GROUP BY 1, 2),
grown AS (
  SELECT 0 AS level, host, parts, CAST(n AS DOUBLE) AS n, CAST(known AS DOUBLE) AS known, CAST(bad AS DOUBLE) AS bad, CAST([] AS VARCHAR[]) AS template FROM t0
  UNION ALL
  SELECT level + 1, host, parts, own_n, own_known, own_bad, list_append(template, CASE WHEN children = 1 OR coalesce({_Z} >= 1.96, false) THEN parts[level + 1] ELSE '*' END)
  FROM (SELECT *, children >= 8 AND children >= 0.2 * an AS variable FROM (
    SELECT level, host, parts, template, n AS own_n, known AS own_known, bad AS own_bad,
      sum(known) OVER child AS known, sum(bad) OVER child AS bad, sum(n) OVER point AS an, sum(known) OVER point AS ak, sum(bad) OVER point AS ab,
      count(DISTINCT parts[level + 1]) OVER point AS children
    FROM grown WHERE len(parts) > level
    WINDOW point AS (PARTITION BY host, template), child AS (PARTITION BY host, template, parts[level + 1])) w) v),
tree AS (SELECT host, parts, '/' || array_to_string(template, '/') AS template, known, bad FROM grown WHERE level = len(parts)),
leaf AS (SELECT host, template, CAST(sum(known) AS DOUBLE) AS known, CAST(sum(bad) AS DOUBLE) AS bad FROM tree GROUP BY 1, 2),
hk AS (SELECT host, sum(known) AS known, sum(bad) AS bad FROM leaf GROUP BY 1),
al AS (SELECT coalesce(sum(bad) / nullif(sum(known), 0), 0) AS overall FROM hk),
hs AS (SELECT host, (bad + 5.0 * overall) / (known + 5.0) AS share FROM hk, al),
pure AS (SELECT leaf.host, template, (bad + CAST(5 AS DOUBLE) * share) / (known + CAST(5 AS DOUBLE)) AS bad_share FROM leaf JOIN hs USING (host)),
j AS (SELECT c.*, tree.template, pure.bad_share,
  CASE WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
       WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
       WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
       WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
       WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM c JOIN tree USING (host, parts) JOIN pure USING (host, template))
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN bad_share > 0.5 THEN 'block' ELSE 'allow' END AS verdict, template, bad_share FROM j"""
