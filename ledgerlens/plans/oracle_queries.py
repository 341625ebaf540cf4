"""DuckDB SQL for every query that has an SQL form (see ``queries.py``)."""

from __future__ import annotations

from ledgerlens.plans.oracle import with_views as W

# White space as Unicode has it, as code points.
WS_CODEPOINTS = [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, 8192, 8193, 8194, 8195, 8196, 8197, 8198, 8199, 8200,
                 8201, 8202, 8232, 8233, 8239, 8287, 12288]
WS_CLASS = "[" + "".join(f"\\x{{{c:X}}}" for c in WS_CODEPOINTS) + "]"

# the shortest text of a double, read as an exact decimal
DEC = "CAST(CAST({} AS VARCHAR) AS DECIMAL(38,10))"
WS_SQL = "(" + " || ".join(f"chr({c})" for c in WS_CODEPOINTS) + ")"
TRIM = "trim({}, " + WS_SQL.replace("{", "{{").replace("}", "}}") + ")"
D0 = "CAST(0 AS DOUBLE)"

ORACLE: dict[str, str] = {}


def money_sum(col: str) -> str:
    return f"SUM({DEC.format(col)})"


def monthly_cte(view: str, date: str = "date", value: str = "revenue") -> str:
    return (f"m AS (SELECT date_trunc('month', {date}) AS ms, {money_sum(value)} AS v FROM {view} "
            f"WHERE {date} IS NOT NULL AND {value} IS NOT NULL GROUP BY 1)")


def share_ctes(view: str, key: str, value: str) -> tuple[str, ...]:
    return (f"agg AS (SELECT {key} AS k, {money_sum(value)} AS v FROM {view} GROUP BY {key})",
            "tot AS (SELECT CAST(SUM(v) AS DOUBLE) AS t, SUM(v) AS td FROM agg)")


def pct(v: str = "v") -> str:
    return f"CASE WHEN coalesce(t, 0) = 0 THEN {D0} ELSE round(CAST({v} AS DOUBLE) / t * 100, 6) END"


def top_n_sql(view, key, value, n, out_key, out_value="revenue", with_pct=True):
    p = f", {pct()} AS pct" if with_pct else ""
    return W([view], f"SELECT k AS {out_key}, CAST(v AS DOUBLE) AS {out_value}{p} FROM agg, tot "
                     f"ORDER BY v DESC, k ASC NULLS FIRST LIMIT {n}", share_ctes(view, key, value))


# ------------------------------------------------------------ time series

ORACLE["monthly_revenue"] = W(["sales"], "SELECT strftime(ms, '%Y-%m') AS month, CAST(v AS DOUBLE) AS revenue FROM m",
                              (monthly_cte("sales"),))

ORACLE["monthly_filled"] = W(["sales_gaps"], """SELECT strftime(cal.ms, '%Y-%m') AS month,
  CAST(coalesce(m.v, 0) AS DOUBLE) AS revenue FROM cal LEFT JOIN m ON cal.ms = m.ms""",
                             (monthly_cte("sales_gaps"),
                              "cal AS (SELECT unnest(generate_series(min(ms), max(ms), INTERVAL 1 MONTH)) AS ms FROM m)"))

ORACLE["moving_avg_3m"] = W(["sales_gaps"], """SELECT strftime(ms, '%Y-%m') AS month, CAST(v AS DOUBLE) AS revenue,
  round(CAST(SUM(v) OVER w AS DOUBLE) / COUNT(*) OVER w, 6) AS ma3
FROM m WINDOW w AS (ORDER BY ms ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""", (monthly_cte("sales_gaps"),))

_YEARLY = (f"y AS (SELECT CAST(year(date) AS INTEGER) AS year, CAST({money_sum('revenue')} AS DOUBLE) AS cur "
           "FROM sales WHERE date IS NOT NULL AND revenue IS NOT NULL GROUP BY 1)")

ORACLE["revenue_by_year"] = W(["sales"], "SELECT year, cur AS revenue FROM y", (_YEARLY,))

ORACLE["yoy_growth"] = W(["sales"], """SELECT year, round((cur - prev) / prev * 100, 6) AS growth_pct
FROM (SELECT year, cur, lag(cur) OVER (ORDER BY year) AS prev FROM y) g
WHERE prev IS NOT NULL AND prev <> 0""", (_YEARLY,))

ORACLE["seasonality"] = W(["sales_gaps"], f"""SELECT g.month_no, monthname(make_date(2000, g.month_no, 1)) AS month_name,
  coalesce(CAST(a.v AS DOUBLE), {D0}) AS revenue
FROM (SELECT CAST(range AS INTEGER) AS month_no FROM range(1, 13)) g LEFT JOIN a ON g.month_no = a.month_no""",
                          (f"a AS (SELECT CAST(month(date) AS INTEGER) AS month_no, {money_sum('revenue')} AS v "
                           "FROM sales_gaps WHERE date IS NOT NULL AND revenue IS NOT NULL GROUP BY 1)",))

ORACLE["peak_month"] = W(["sales"], """SELECT * FROM (SELECT 'peak' AS kind, strftime(ms, '%Y-%m') AS month, CAST(v AS DOUBLE) AS revenue
  FROM m ORDER BY v DESC, ms ASC LIMIT 1)
UNION ALL
SELECT * FROM (SELECT 'weakest' AS kind, strftime(ms, '%Y-%m') AS month, CAST(v AS DOUBLE) AS revenue
  FROM m ORDER BY v ASC, ms ASC LIMIT 1)""", (monthly_cte("sales"),))

ORACLE["calendar_pool"] = W(["sales"], """SELECT CAST(m + (d - 1) * INTERVAL 1 DAY AS DATE) AS date
FROM (SELECT unnest(generate_series(make_date(CAST(min(year(date)) AS INTEGER), 1, 1),
                                    make_date(CAST(max(year(date)) AS INTEGER), 12, 1), INTERVAL 1 MONTH)) AS m FROM sales) t,
     (SELECT unnest([5, 10, 15, 20, 25]) AS d) dd""")

# ------------------------------------------------------------ revenue & distribution

ORACLE["revenue_summary"] = W(["sales"], f"""SELECT CAST({money_sum('revenue')} AS DOUBLE) AS total,
  round(CAST({money_sum('revenue')} AS DOUBLE) / count(revenue), 6) AS mean,
  round(quantile_cont(revenue, 0.5), 6) AS median,
  round(stddev_samp(revenue), 6) AS std FROM sales""")

ORACLE["distribution"] = W(["sales"], """SELECT round(quantile_cont(revenue, 0.25), 6) AS q1,
  round(quantile_cont(revenue, 0.75), 6) AS q3,
  CASE WHEN count(revenue) < 3 THEN NULL WHEN min(revenue) = max(revenue) THEN CAST(0 AS DOUBLE)
       ELSE round(skewness(revenue), 6) END AS skew FROM sales""")

ORACLE["high_value"] = W(["sales"], """SELECT round(CAST(count(*) FILTER (WHERE revenue >= 200000) AS DOUBLE)
  / count(revenue) * 100, 6) AS high_value_pct FROM sales""")

ORACLE["histogram"] = W(["sales"], """SELECT g.bin, round(lo + g.bin * w, 6) AS lo, round(lo + g.bin * w + w, 6) AS hi,
  coalesce(c.n, 0) AS count
FROM (SELECT CAST(range AS INTEGER) AS bin FROM range(30)) g CROSS JOIN bw LEFT JOIN c ON g.bin = c.bin""", (
    "st AS (SELECT CAST(min(revenue) AS DOUBLE) AS lo0, CAST(max(revenue) AS DOUBLE) AS hi0 FROM sales)",
    "bw AS (SELECT CASE WHEN lo0 = hi0 THEN lo0 - 0.5 ELSE lo0 END AS lo, "
    "(CASE WHEN lo0 = hi0 THEN hi0 + 0.5 ELSE hi0 END - CASE WHEN lo0 = hi0 THEN lo0 - 0.5 ELSE lo0 END) / 30.0 AS w "
    "FROM st WHERE lo0 IS NOT NULL)",
    "c AS (SELECT least(CAST(floor((revenue - lo) / w) AS INTEGER), 29) AS bin, count(*) AS n FROM sales, bw "
    "WHERE revenue IS NOT NULL AND NOT isnan(revenue) GROUP BY 1)"))

ORACLE["monthly_histogram"] = W(["sales"], """SELECT g.bin,
  CAST(CAST(floor((lo + g.bin * w) / 1000.0 + 0.5) AS BIGINT) AS VARCHAR) || 'k-' ||
  CAST(CAST(floor((lo + g.bin * w + w) / 1000.0 + 0.5) AS BIGINT) AS VARCHAR) || 'k' AS label,
  coalesce(c.cnt, 0) AS count
FROM (SELECT CAST(range AS INTEGER) AS bin FROM range(10)) g CROSS JOIN bw LEFT JOIN c ON g.bin = c.bin
UNION ALL
SELECT 0 AS bin, CAST(CAST(floor(lo0 + 0.5) AS BIGINT) AS VARCHAR) AS label, n AS count FROM st WHERE lo0 = hi0""", (
    monthly_cte("sales"),
    "mv AS (SELECT CAST(v AS DOUBLE) AS v FROM m)",
    "st AS (SELECT min(v) AS lo0, max(v) AS hi0, count(*) AS n FROM mv)",
    "bw AS (SELECT lo0 AS lo, (hi0 - lo0) / 10.0 AS w FROM st WHERE lo0 < hi0)",
    "c AS (SELECT least(CAST(floor((v - lo) / w) AS INTEGER), 9) AS bin, count(*) AS cnt FROM mv, bw GROUP BY 1)"))

# ------------------------------------------------------------ customers

ORACLE["unique_customers"] = W(["sales_raw"], f"""SELECT CAST(count(DISTINCT NULLIF({TRIM.format('"Particulars"')}, ''))
  AS BIGINT) AS unique_customers FROM sales_raw""")

ORACLE["top_customers"] = top_n_sql("sales", "customer", "revenue", 10, "customer")

ORACLE["top_share"] = W(["sales"], f"""SELECT
  CASE WHEN coalesce(t, 0) = 0 THEN {D0} ELSE round(coalesce(CAST(SUM(v) FILTER (WHERE rn <= 10) AS DOUBLE), 0) / t * 100, 6) END AS top10_pct,
  CASE WHEN coalesce(t, 0) = 0 THEN {D0} ELSE round(coalesce(CAST(SUM(v) FILTER (WHERE rn <= 20) AS DOUBLE), 0) / t * 100, 6) END AS top20_pct
FROM (SELECT v, row_number() OVER (ORDER BY v DESC, k ASC NULLS FIRST) AS rn FROM agg) r, tot GROUP BY t""",
                        share_ctes("sales", "customer", "revenue"))

_CUM = share_ctes("sales", "customer", "revenue") + (
    "c AS (SELECT k, v, SUM(v) OVER (ORDER BY v DESC, k ASC NULLS FIRST "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM agg)",)

ORACLE["pareto_curve"] = W(["sales"], f"""SELECT k AS customer, CAST(v AS DOUBLE) AS revenue,
  CASE WHEN td = 0 THEN {D0} ELSE round(CAST(cum AS DOUBLE) / CAST(td AS DOUBLE) * 100, 6) END AS cum_pct
FROM c, tot ORDER BY v DESC, k ASC NULLS FIRST LIMIT 20""", _CUM)

ORACLE["pareto_count"] = W(["sales"], """SELECT CAST(CASE WHEN count(*) > 0 THEN greatest(
  count(*) FILTER (WHERE CASE WHEN td = 0 THEN true ELSE CAST(cum AS DOUBLE) / CAST(td AS DOUBLE) * 100 <= 80 END), 1) ELSE 0 END AS BIGINT)
  AS customers_within_80pct FROM c, tot""", _CUM)

ORACLE["customer_weights"] = W(["sales"], """SELECT customer, n,
  CAST(n AS DOUBLE) / CAST((SELECT SUM(n) FROM cw) AS DOUBLE) AS weight FROM cw""", (
    f"tn AS (SELECT {TRIM.format('customer')} AS c FROM sales)",
    "cw AS (SELECT c AS customer, count(*) AS n FROM tn WHERE c IS NOT NULL AND c <> '' GROUP BY c)"))

# ------------------------------------------------------------ tax

ORACLE["tax_component"] = W(["invoice_tax"], """SELECT CAST(n AS DOUBLE) AS net_total, CAST(g - n AS DOUBLE) AS tax_total,
  CASE WHEN g = 0 THEN NULL ELSE round(CAST(g - n AS DOUBLE) / CAST(g AS DOUBLE) * 100, 6) END AS tax_pct
FROM (SELECT SUM(gross) AS g, SUM(net) AS n FROM invoice_tax WHERE net IS NOT NULL) s""")

ORACLE["gross_net_year"] = W(["invoice_tax"], """SELECT CAST(year(date) AS INTEGER) AS year,
  CAST(SUM(gross) AS DOUBLE) AS gross, CAST(SUM(net) AS DOUBLE) AS net
FROM invoice_tax WHERE net IS NOT NULL GROUP BY 1""")

ORACLE["tax_breakdown"] = W(["invoice_tax"], """SELECT name, value FROM (
  SELECT 'cgst' AS name, CAST(SUM(cgst) AS DOUBLE) AS value FROM invoice_tax
  UNION ALL SELECT 'sgst', CAST(SUM(sgst) AS DOUBLE) FROM invoice_tax
  UNION ALL SELECT 'igst', CAST(SUM(igst) AS DOUBLE) FROM invoice_tax) t WHERE value > 0""")

# ------------------------------------------------------------ items

ORACLE["item_totals"] = W(["items"], f"""SELECT count(*) AS rows, CAST(min(date) AS DATE) AS start,
  CAST(max(date) AS DATE) AS "end", CAST({money_sum('total_value')} AS DOUBLE) AS total,
  round(CAST({money_sum('total_value')} AS DOUBLE) / count(total_value), 6) AS mean FROM items""")

ORACLE["item_monthly"] = W(["items"], f"""SELECT strftime(date_trunc('month', date), '%Y-%m') AS month,
  CAST({money_sum('total_value')} AS DOUBLE) AS value FROM items GROUP BY 1""")

ORACLE["category_mix"] = W(["items"], f"SELECT k AS category, CAST(v AS DOUBLE) AS revenue, {pct()} AS pct FROM agg, tot",
                           share_ctes("items", "category", "total_value"))

ORACLE["category_sales"] = W(["items"], f"""SELECT category, CAST({money_sum('total_value')} AS DOUBLE) AS total_value
FROM items GROUP BY category""")

ORACLE["top_items"] = top_n_sql("items", "item_name", "total_value", 10, "item")

ORACLE["top3_share"] = W(["items"], f"""SELECT CASE WHEN coalesce(t, 0) = 0 THEN {D0}
  ELSE round(coalesce(CAST(SUM(v) AS DOUBLE), 0) / t * 100, 6) END AS top3_pct
FROM (SELECT v FROM agg ORDER BY v DESC, k ASC NULLS FIRST LIMIT 3) s, tot GROUP BY t""",
                         share_ctes("items", "item_name", "total_value"))

ORACLE["top_products"] = top_n_sql("items", "item_name", "total_value", 10, "item_name", "total_value", False)


# ------------------------------------------------------------ column expressions

def TRIMX(x: str) -> str:
    return TRIM.format(x)


def LENIENT(x: str) -> str:
    return (f"TRY_CAST(NULLIF(NULLIF(regexp_replace(replace({x}, ',', ''), '[^0-9.\\-]', '', 'g'), ''), '-') AS DOUBLE)")


def DAYFIRST(x: str) -> str:
    return "coalesce(" + ", ".join(f"try_strptime({x}, '{f}')" for f in ("%Y-%m-%d", "%d/%m/%Y", "%d-%b-%Y")) + ")"


def TEXTKEY(x: str) -> str:
    s = f"regexp_replace(lower({TRIMX(x)}), '{WS_CLASS}+', ' ', 'g')"
    return f"CASE WHEN {s} IN ('', 'nan', 'none') THEN NULL ELSE {s} END"


def PRODKEY(x: str) -> str:
    s = f"trim(regexp_replace(lower({TRIMX(x)}), '[^a-z0-9]+', ' ', 'g'))"
    return f"NULLIF({s}, '')"


ORACLE["trim_text"] = W(["sales_raw"], f"""SELECT _row_id AS key, {TRIMX('"Particulars"')} AS result FROM sales_raw""")
ORACLE["lenient_number"] = W(["sales_raw"], f"""SELECT _row_id AS key, {LENIENT('"Gross Total"')} AS result FROM sales_raw""")
_FORMS = ["%Y-%m-%d", "%Y-%m-%d %H:%M:%S", "%Y/%m/%d", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M", "%d/%m/%Y", "%d/%m/%Y %H:%M:%S",
          "%d-%m-%Y", "%d.%m.%Y", "%d/%m/%y", "%d-%b-%Y", "%d-%b-%Y %H:%M", "%d %b %Y", "%d-%B-%Y", "%d-%b-%y", "%d/%m/%Y",
          "%Y-%m-%dT%H:%M:%SZ", "%Y-%m-%dT%H:%M:%S+05:30", "%d/%m/%Y %I:%M %p", "%Y%m%d", "%b %d, %Y", "%a, %d %b %Y", "%dth %b %Y",
          "%Y-%m", "%B %Y", "%Y%m%d%H%M%S"]
ORACLE["date_parse"] = W(["date_forms"], "SELECT key, CASE i " + " ".join(
    f"WHEN {i} THEN try_strptime(text, '{f}')" for i, f in enumerate(_FORMS)) + " END AS result FROM date_forms")
ORACLE["money_scale"] = W(["sub_cents"], """SELECT key, CAST(SUM(CAST(CAST(value AS VARCHAR) AS DECIMAL(38,10))) AS DOUBLE) AS total
FROM sub_cents GROUP BY key""")
ORACLE["time_features"] = W(["sales_raw"], """SELECT key, CAST(year(t) AS INTEGER) AS year, CAST(month(t) AS INTEGER) AS month,
  strftime(t, '%Y-%m') AS year_month FROM tf""", (f"""tf AS (SELECT _row_id AS key, {DAYFIRST('"Date"')} AS t FROM sales_raw)""",))
ORACLE["text_key"] = W(["sales_raw"], f"""SELECT _row_id AS key, {TEXTKEY('"Particulars"')} AS result FROM sales_raw""")
ORACLE["product_key"] = W(["catalog"], f"""SELECT _row_id AS key, {PRODKEY('name_of_item')} AS result FROM catalog""")

# ------------------------------------------------------------ cleaning composites

_RAW_COLS = [("Date", "date"), ("Particulars", "particulars"), ("Voucher Type", "voucher_type"),
             ("Voucher No", "voucher_no"), ("GSTIN/UIN", "gstin_uin"), ("Gross Total", "gross_total"), ("Sales", "sales")]

CLEAN_CTES = (
    "cn AS (SELECT _row_id, " + ", ".join(f'{TRIMX(chr(34) + a + chr(34))} AS {b}' for a, b in _RAW_COLS) + " FROM sales_raw)",
    f"""cp AS (SELECT _row_id, {DAYFIRST('date')} AS date, particulars, voucher_type, {LENIENT('voucher_no')} AS voucher_no,
      gstin_uin, {LENIENT('gross_total')} AS gross_total, {LENIENT('sales')} AS sales FROM cn)""",
    "ck AS (SELECT * FROM cp WHERE date IS NOT NULL AND gross_total IS NOT NULL)",
    """cmed AS (SELECT quantile_cont(voucher_no, 0.5) AS m1, quantile_cont(gross_total, 0.5) AS m2,
      quantile_cont(sales, 0.5) AS m3 FROM ck)""",
    """cs AS (SELECT _row_id, date, coalesce(particulars, 'Unknown Customer') AS particulars,
      coalesce(voucher_type, 'Unknown') AS voucher_type, coalesce(voucher_no, m1) AS voucher_no,
      coalesce(gstin_uin, 'Unknown') AS gstin_uin, coalesce(gross_total, m2) AS gross_total,
      coalesce(sales, m3) AS sales, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month,
      strftime(date, '%Y-%m') AS year_month FROM ck, cmed)""",
)

MASTER_CTES = (
    f"""cm AS (SELECT _row_id, {TRIMX('"Customer Name"')} AS customer_name, {TRIMX('"Segment"')} AS segment,
      {LENIENT(TRIMX('"Nation Code"'))} AS nation_code, {LENIENT(TRIMX('"Credit Limit"'))} AS credit_limit FROM master)""",
    f"""dd AS (SELECT _join_key, _row_id, customer_name, segment, nation_code, credit_limit FROM (
      SELECT *, row_number() OVER (PARTITION BY _join_key ORDER BY _row_id) AS rn
      FROM (SELECT *, {TEXTKEY('customer_name')} AS _join_key FROM cm) a) b
      WHERE _join_key IS NOT NULL AND rn = 1)""",
)

INTEG_CTES = CLEAN_CTES + MASTER_CTES + (
    f"""integ AS (SELECT cs.*, dd._row_id AS _row_id_master, dd.customer_name, dd.segment, dd.nation_code,
      dd.credit_limit, CASE WHEN dd._join_key IS NULL THEN 'missing_in_master' ELSE 'matched' END AS _merge_status
      FROM cs LEFT JOIN dd ON {TEXTKEY('cs.particulars')} = dd._join_key)""",)

ORACLE["numeric_ratio"] = W(["sales_raw"], " UNION ALL ".join(
    f"""SELECT '{b}' AS "column", round(CAST(count(*) FILTER (WHERE {LENIENT(TRIMX(chr(34) + a + chr(34)))} IS NOT NULL) AS DOUBLE)
    / count(*), 6) AS ratio FROM sales_raw""" for a, b in _RAW_COLS))

ORACLE["numeric_promote"] = W(["sales_raw"], f"""SELECT _row_id, {LENIENT(TRIMX('"Voucher No"'))} AS voucher_no,
  {LENIENT(TRIMX('"Gross Total"'))} AS gross_total, {LENIENT(TRIMX('"Sales"'))} AS sales FROM sales_raw""")

ORACLE["clean_stats"] = W(["sales_raw"], """SELECT count(*) FILTER (WHERE date IS NULL OR gross_total IS NULL) AS dropped,
  count(*) FILTER (WHERE NOT (date IS NULL OR gross_total IS NULL) AND particulars IS NULL) AS filled,
  count(*) FILTER (WHERE NOT (date IS NULL OR gross_total IS NULL)) AS kept FROM cp""", CLEAN_CTES[:2])

ORACLE["median_impute"] = W(["sales_raw"], "SELECT _row_id AS key, sales AS amount FROM cs", CLEAN_CTES)
ORACLE["clean_sales"] = W(["sales_raw"], "SELECT * FROM cs", CLEAN_CTES)
ORACLE["clean_reference"] = W(["master"], "SELECT * FROM cm", MASTER_CTES[:1])
ORACLE["dedupe_first"] = W(["master"], "SELECT * FROM dd", MASTER_CTES)
ORACLE["integrate"] = W(["sales_raw", "master"], "SELECT * FROM integ", INTEG_CTES)
ORACLE["integrate_summary"] = W(["sales_raw", "master"], f"""SELECT 'customer' AS join_key_used,
  'particulars' AS join_key_daybook, 'customer_name' AS join_key_master,
  count(*) AS total_rows, count(*) FILTER (WHERE _merge_status = 'matched') AS matched_rows,
  count(*) FILTER (WHERE _merge_status <> 'matched') AS unmatched_rows,
  CASE WHEN count(*) = 0 THEN {D0} ELSE round(CAST(count(*) FILTER (WHERE _merge_status = 'matched') AS DOUBLE) / count(*) * 100, 6) END AS match_rate_pct,
  CASE WHEN count(*) = 0 THEN {D0} ELSE round(CAST(count(*) FILTER (WHERE _merge_status <> 'matched') AS DOUBLE) / count(*) * 100, 6) END AS unmatched_rate_pct,
  (SELECT count(*) FROM cm) - (SELECT count(DISTINCT _join_key) FROM (SELECT {TEXTKEY('customer_name')} AS _join_key FROM cm) x) AS master_duplicate_rows_removed,
  (SELECT count(*) FILTER (WHERE {TEXTKEY('particulars')} IS NULL) FROM cs) AS daybook_rows_missing_join_key
FROM integ""", INTEG_CTES)
ORACLE["sales_base"] = W(["sales_raw", "master"], f"""SELECT _row_id, date AS _date, CAST(year(date) AS INTEGER) AS _year,
  strftime(date, '%Y-%m') AS _month, gross_total AS _revenue,
  {TRIMX("coalesce(particulars, 'Unknown Customer')")} AS _customer,
  {TEXTKEY(TRIMX("coalesce(particulars, 'Unknown Customer')"))} AS _customer_norm, _merge_status
FROM integ WHERE date IS NOT NULL AND gross_total IS NOT NULL""", INTEG_CTES)


# ------------------------------------------------------------ catalog & roles by data

def XDEC(x: str) -> str:
    return DEC.format(f"CAST({x} AS DOUBLE)")


CAT_CTE = (f"""cat AS (SELECT key, product, category FROM (
  SELECT {PRODKEY('name_of_item')} AS key, {TRIMX('name_of_item')} AS product,
         coalesce({TRIMX('under')}, 'Uncategorized') AS category,
         row_number() OVER (PARTITION BY {PRODKEY('name_of_item')} ORDER BY _row_id) AS rn FROM catalog) t
  WHERE key IS NOT NULL AND rn = 1)""",)

_P = TRIMX("coalesce(c.product, coalesce(" + TRIMX("i.item_name") + ", 'Unknown Product'))")
_C = TRIMX("coalesce(c.category, 'Uncategorized')")
ENRICH_CTES = CAT_CTE + (f"""enr AS (SELECT i.*, CASE WHEN {_P} = '' THEN 'Unknown Product' ELSE {_P} END AS _product,
  CASE WHEN {_C} = '' THEN 'Uncategorized' ELSE {_C} END AS _category, i.total_value AS _revenue
  FROM items i LEFT JOIN cat c ON {PRODKEY('i.item_name')} = c.key)""",)

ORACLE["catalog"] = W(["catalog"], "SELECT * FROM cat", CAT_CTE)
ORACLE["enrich"] = W(["items", "catalog"], "SELECT _row_id, item_name, total_value, _product, _category FROM enr", ENRICH_CTES)
_PTOP = "pt AS (SELECT _product AS product, SUM(" + XDEC("_revenue") + ") AS v FROM enr GROUP BY _product)"
ORACLE["product_top"] = W(["items", "catalog"], """SELECT product, CAST(v AS DOUBLE) AS revenue FROM pt
ORDER BY v DESC, product ASC NULLS FIRST LIMIT 10""", ENRICH_CTES + (_PTOP,))
ORACLE["product_category"] = W(["items", "catalog"], f"""SELECT _category AS category,
  CAST(SUM({XDEC('_revenue')}) AS DOUBLE) AS revenue FROM enr GROUP BY _category""", ENRICH_CTES)
ORACLE["product_contribution"] = W(["items", "catalog"], f"""SELECT product, revenue,
  CASE WHEN coalesce(t, 0) = 0 THEN {D0} ELSE round(revenue / t * 100, 2) END AS contribution_pct
FROM (SELECT product, CAST(v AS DOUBLE) AS revenue FROM pt ORDER BY v DESC, product ASC NULLS FIRST LIMIT 10) a,
     (SELECT CAST(SUM({XDEC('_revenue')}) AS DOUBLE) AS t FROM enr) b""", ENRICH_CTES + (_PTOP,))

_CTOP = (f"""ctop AS (SELECT product, CAST(v AS DOUBLE) AS revenue, 'catalog' AS source, 'rate' AS metric FROM (
  SELECT {TRIMX('name_of_item')} AS product, SUM({XDEC('coalesce(CAST(rate AS DOUBLE), 0)')}) AS v
  FROM catalog WHERE {TRIMX('name_of_item')} IS NOT NULL GROUP BY 1) t ORDER BY v DESC, product ASC LIMIT 10)""",)
ORACLE["catalog_top"] = W(["catalog"], "SELECT * FROM ctop", _CTOP)
ORACLE["catalog_category"] = W(["catalog"], f"""SELECT category, CAST(SUM(v) AS DOUBLE) AS revenue,
  'catalog' AS source, 'rate' AS metric FROM (SELECT coalesce({TRIMX('under')}, 'Uncategorized') AS category,
  {XDEC('coalesce(CAST(rate AS DOUBLE), 0)')} AS v FROM catalog) t GROUP BY category""")
ORACLE["catalog_contribution"] = W(["catalog"], f"""SELECT product, revenue,
  CASE WHEN coalesce(s, 0) = 0 THEN {D0} ELSE round(revenue / s * 100, 2) END AS contribution_pct, source, metric
FROM ctop, (SELECT CAST(SUM({XDEC('revenue')}) AS DOUBLE) AS s FROM ctop) b""", _CTOP)

_ITEM_TEXT = ["invoice_no", "customer", "item_name", "category"]
ORACLE["role_overlap"] = W(["items", "catalog"], """SELECT col AS "column",
  CAST(count(DISTINCT CASE WHEN k IN (SELECT key FROM cat) THEN k END) AS BIGINT) AS overlap FROM ("""
    + " UNION ALL ".join(f"SELECT '{c}' AS col, {PRODKEY(c)} AS k FROM items" for c in _ITEM_TEXT)
    + ") u GROUP BY col", CAT_CTE)
ORACLE["role_catalog_value"] = W(["catalog"], " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", round(CAST(count(*) FILTER (WHERE abs(coalesce(CAST({c} AS DOUBLE), 0)) > 0) AS DOUBLE)
    * 1000000.0 + CAST(coalesce(SUM({XDEC(f'abs(coalesce(CAST({c} AS DOUBLE), 0))')}), 0) AS DOUBLE), 6) AS score FROM catalog"""
    for c in ["rate", "opening_qty"]))
ORACLE["role_distinct"] = W(["items"], " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", CAST(count(DISTINCT NULLIF({TRIMX(c)}, '')) AS BIGINT) AS n FROM items"""
    for c in _ITEM_TEXT))

# ------------------------------------------------------------ item loaders

ITEMS_TEXT_CTE = ("""items_text AS (SELECT _row_id, strftime(date, '%Y-%m-%d') AS "Date", invoice_no AS "Invoice No",
  customer AS "Customer", item_name AS "Item Name", category AS "Category", CAST(quantity AS VARCHAR) AS "Quantity",
  CAST(unit_price AS VARCHAR) AS "Unit Price", CAST(total_value AS VARCHAR) AS "Total Value" FROM items)""",)

ORACLE["items_load"] = W(["items"], f"""SELECT * FROM (SELECT try_strptime("Date", '%Y-%m-%d') AS date,
  coalesce({TRIMX('"Customer"')}, 'Unknown Customer') AS customer,
  coalesce({TRIMX('"Item Name"')}, 'Unknown Item') AS item_name,
  coalesce({TRIMX('"Category"')}, 'Uncategorized') AS category,
  TRY_CAST("Quantity" AS DOUBLE) AS quantity, TRY_CAST("Unit Price" AS DOUBLE) AS unit_price,
  TRY_CAST("Total Value" AS DOUBLE) AS total_value FROM items_text) t
WHERE date IS NOT NULL AND total_value IS NOT NULL""", ITEMS_TEXT_CTE)

_LC = TRIMX("""coalesce("Customer", 'Unknown Customer')""")
_LI = TRIMX("""coalesce("Item Name", 'Unknown Product')""")
ORACLE["items_load_lenient"] = W(["items"], f"""SELECT * FROM (SELECT try_strptime("Date", '%Y-%m-%d') AS date,
  {_LC} AS customer,
  {_LI} AS item_name,
  'Uncategorized' AS category,
  coalesce(TRY_CAST("Quantity" AS DOUBLE), 0) AS quantity, coalesce(TRY_CAST("Unit Price" AS DOUBLE), 0) AS unit_price,
  coalesce(TRY_CAST("Quantity" AS DOUBLE) * TRY_CAST("Unit Price" AS DOUBLE), 0) AS total_value FROM items_text) t
WHERE date IS NOT NULL""", ITEMS_TEXT_CTE)

# ------------------------------------------------------------ dashboard slices and facets

from ledgerlens.functions.text import literal_text_key  # noqa: E402
from ledgerlens.plans import queries as _Q  # noqa: E402

_CUST = literal_text_key(_Q.SLICE_CUSTOMER)
_PROD = literal_text_key(_Q.SLICE_PRODUCT)

BASE_CTES = (
    f"""sb AS (SELECT _row_id, date AS _date, CAST(year(date) AS INTEGER) AS _year, strftime(date, '%Y-%m') AS _month,
      revenue AS _revenue, {TRIMX("coalesce(customer, 'Unknown Customer')")} AS _customer,
      {TEXTKEY(TRIMX("coalesce(customer, 'Unknown Customer')"))} AS _customer_norm
      FROM sales WHERE date IS NOT NULL AND revenue IS NOT NULL)""",
    f"""ib AS (SELECT _row_id, invoice_no, date, {TRIMX("coalesce(customer, 'Unknown Customer')")} AS customer,
      {TRIMX("coalesce(item_name, 'Unknown Product')")} AS item_name,
      {TRIMX("coalesce(category, 'Uncategorized')")} AS category, coalesce(quantity, 0) AS quantity,
      coalesce(unit_price, 0) AS unit_price, coalesce(total_value, 0) AS total_value FROM items WHERE date IS NOT NULL)""",
    f"""ib2 AS (SELECT *, CAST(year(date) AS INTEGER) AS _year, strftime(date, '%Y-%m') AS _month,
      {TEXTKEY('customer')} AS _customer_norm, item_name AS _product, {TEXTKEY('item_name')} AS _product_norm FROM ib)""",
)
_SB = ", ".join(_Q.SALES_BASE_COLS)
_IB = ", ".join(_Q.ITEM_BASE_COLS)

ORACLE["sales_slice"] = W(["sales", "items"], f"""SELECT {_SB} FROM sb
WHERE _year = {_Q.SLICE_YEAR} AND _customer_norm = '{_CUST}'""", BASE_CTES)
ORACLE["item_slice"] = W(["sales", "items"], f"""SELECT {_IB} FROM ib2
WHERE _year = {_Q.SLICE_YEAR} AND _product_norm = '{_PROD}'""", BASE_CTES)
ORACLE["product_scope"] = W(["sales", "items"], f"""SELECT {_SB} FROM sb
WHERE _customer_norm IN (SELECT _customer_norm FROM ib2 WHERE _product_norm = '{_PROD}')""", BASE_CTES)
ORACLE["multi_slice"] = W(["sales"], f"""SELECT _row_id, date, customer, revenue FROM sales
WHERE date IS NOT NULL AND year(date) IN ({", ".join(str(y) for y in _Q.MULTI_YEARS)})
  AND customer IN ({", ".join("'" + c + "'" for c in _Q.MULTI_CUSTOMERS)}) AND revenue IS NOT NULL""")
ORACLE["facets"] = W(["sales", "items"], f"""SELECT 'year' AS facet, CAST(_year AS VARCHAR) AS value FROM (
  SELECT _year FROM sb WHERE _customer_norm IN (SELECT _customer_norm FROM ib2 WHERE _product_norm = '{_PROD}')
  UNION SELECT _year FROM ib2 WHERE _product_norm = '{_PROD}') y WHERE _year IS NOT NULL
UNION ALL
SELECT DISTINCT 'customer', {TRIMX('_customer')} FROM sb WHERE _year = {_Q.SLICE_YEAR}
  AND _customer_norm IN (SELECT _customer_norm FROM ib2 WHERE _year = {_Q.SLICE_YEAR} AND _product_norm = '{_PROD}')
  AND {TRIMX('_customer')} IS NOT NULL AND {TRIMX('_customer')} <> ''
UNION ALL
SELECT DISTINCT 'product', {TRIMX('_product')} FROM ib2 WHERE _year = {_Q.SLICE_YEAR}
  AND {TRIMX('_product')} IS NOT NULL AND {TRIMX('_product')} <> ''""", BASE_CTES)
ORACLE["report_options"] = W(["sales"], f"""SELECT DISTINCT 'year' AS facet, CAST(year(date) AS VARCHAR) AS value
FROM sales WHERE date IS NOT NULL
UNION ALL
SELECT DISTINCT 'customer', customer FROM sales WHERE date IS NOT NULL AND customer IS NOT NULL AND {TRIMX('customer')} <> ''""")
ORACLE["kpis"] = W(["sales", "items"], f"""SELECT coalesce(CAST(SUM({DEC.format('_revenue')}) AS DOUBLE), 0) AS total_revenue,
  count(*) AS total_transactions,
  CASE WHEN count(*) = 0 THEN {D0} ELSE round(coalesce(CAST(SUM({DEC.format('_revenue')}) AS DOUBLE), 0) / count(*), 6) END AS avg_value,
  (SELECT coalesce(CAST(SUM({DEC.format('total_value')}) AS DOUBLE), 0) FROM ib2
   WHERE _year = {_Q.SLICE_YEAR} AND _customer_norm = '{_CUST}') AS item_value
FROM sb WHERE _year = {_Q.SLICE_YEAR} AND _customer_norm = '{_CUST}'""", BASE_CTES)


# ------------------------------------------------------------ report export

_TOK = "[" + ", ".join("'" + t + "'" for t in ["date", "particular", "customer", "party", "gross", "total", "gst",
                                               "amount", "voucher", "invoice", "sales", "product", "item"]) + "]"
HEADER_CTES = (
    "hf AS (SELECT * FROM export_raw ORDER BY _row_id LIMIT 40)",
    "hc AS (SELECT _row_id, list_filter([" + ", ".join(f"lower({TRIMX(f'_c{i}')})" for i in range(7))
    + "], lambda x: x IS NOT NULL AND x <> '') AS cells FROM hf)",
    f"""hs AS (SELECT _row_id AS row, CAST(len(list_filter({_TOK}, lambda t: len(list_filter(cells, lambda x: contains(x, t))) > 0)) AS DOUBLE) * CAST(2.0 AS DOUBLE)
      + CAST(least(len(cells), 20) AS DOUBLE) * CAST(0.1 AS DOUBLE)
      + CAST(len(list_distinct(cells)) AS DOUBLE) / len(cells) AS score FROM hc WHERE len(cells) >= 3)""",
    "hb AS (SELECT row FROM hs WHERE score >= 3.0 ORDER BY score DESC, row ASC LIMIT 1)",
)
ORACLE["header_scores"] = W(["export_raw"], "SELECT row, round(score, 6) AS score FROM hs", HEADER_CTES)
ORACLE["header_recovery"] = W(["export_raw"], """SELECT _row_id, _c0 AS date, _c1 AS particulars, _c2 AS voucher_type,
  _c3 AS voucher_no, _c4 AS gstin_uin, _c5 AS gross_total, _c6 AS sales
FROM export_raw WHERE _row_id > (SELECT row FROM hb)""", HEADER_CTES)


# ------------------------------------------------------------ forecast (T2): the same likelihood and search in DuckDB

def _filtered_sql(phi: str, theta: str) -> str:
    one = "CAST(1 AS DOUBLE)"
    return (f"list_reduce(w, lambda a, x: {{'p': {phi} * x + {theta} / a.r * (x - a.p), 'r': {one} + {theta} * {theta} - {theta} * {theta} / a.r, "
            f"'ss': a.ss + (x - a.p) * (x - a.p) / a.r, 'pr': a.pr * a.r}}, "
            f"{{'p': {D0}, 'r': ({one} + CAST(2 AS DOUBLE) * {phi} * {theta} + {theta} * {theta}) / ({one} - {phi} * {phi}), 'ss': {D0}, 'pr': {one}}})")


def _best_sql(grid: str) -> str:
    value = "list_transform([" + _filtered_sql("g.phi", "g.theta") + "], lambda f: f.ss * pow(f.pr, CAST(1 AS DOUBLE) / len(w)))[1]"
    return f"list_sort(list_transform({grid}, lambda g: {{'v': {value}, 'phi': g.phi, 'theta': g.theta}}))[1]"


def _kept(x: str) -> str:
    return f"least(CAST(0.99 AS DOUBLE), greatest(CAST(-0.99 AS DOUBLE), {x}))"


_COARSE = ("list_transform(range(0, 361), lambda i: {'phi': round(CAST(-0.9 AS DOUBLE) + CAST(i // 19 AS DOUBLE) * CAST(0.1 AS DOUBLE), 2), "
           "'theta': round(CAST(-0.9 AS DOUBLE) + CAST(i % 19 AS DOUBLE) * CAST(0.1 AS DOUBLE), 2)})")
_AROUND = ("list_transform(range(0, 25), lambda i: {'phi': " + _kept("b.phi + CAST(i // 5 - 2 AS DOUBLE) * {s}") + ", 'theta': "
           + _kept("b.theta + CAST(i % 5 - 2 AS DOUBLE) * {s}") + "})")


def forecast_sql(view: str, key_expr: str, date: str, value: str, prefix: str = "f") -> tuple[tuple[str, ...], str]:
    """CTEs and the final SELECT of the per-key ARIMA forecast over ``view``."""
    P = prefix
    ctes = (
        f"{P}m AS (SELECT {key_expr} AS key, date_trunc('month', {date}) AS ms, {money_sum(value)} AS v FROM {view} "
        f"WHERE {date} IS NOT NULL AND {value} IS NOT NULL GROUP BY 1, 2)",
        f"{P}b AS (SELECT key, unnest(generate_series(min(ms), max(ms), INTERVAL 1 MONTH)) AS ms FROM {P}m GROUP BY key)",
        f"{P}f AS (SELECT {P}b.key, {P}b.ms, CAST(coalesce({P}m.v, 0) AS DOUBLE) AS y FROM {P}b LEFT JOIN {P}m "
        f"ON {P}b.key = {P}m.key AND {P}b.ms = {P}m.ms)",
        f"{P}s AS (SELECT key, list(y ORDER BY ms) AS y, max(ms) AS last_month FROM {P}f GROUP BY key HAVING count(*) >= 6)",
        f"{P}w AS (SELECT key, y, last_month, list_transform(range(1, len(y)), lambda i: y[i + 1] - y[i]) AS w FROM {P}s)",
        f"{P}0 AS (SELECT *, {_best_sql(_COARSE)} AS b FROM {P}w)",
        *(f"{P}{k + 1} AS (SELECT key, y, w, last_month, {_best_sql(_AROUND.replace('{s}', f'CAST({2.0 ** -(k + 4)!r} AS DOUBLE)'))} AS b FROM {P}{k})"
          for k in range(14)),
        f"""{P}out AS (SELECT key, strftime(last_month + to_months(CAST(h AS INTEGER)), '%Y-%m') AS month,
  CAST(h AS INTEGER) AS step, round(mean, 2) AS forecast,
  round(mean - 1.959964 * sqrt(var), 2) AS lower_95, round(mean + 1.959964 * sqrt(var), 2) AS upper_95
FROM (SELECT key, last_month, h, y[len(y)] + f.p * c AS mean, f.ss / len(w) * (psi + (f.r - 1) * pow(c, 2)) AS var
      FROM (SELECT *, list_reduce(list_transform(range(0, h), lambda j: pow(b.phi, j)), lambda a, t: a + t, {D0}) AS c,
              list_reduce(list_transform(range(0, h), lambda j: pow(CASE WHEN j = 0 THEN CAST(1 AS DOUBLE)
                ELSE 1 + (b.phi + b.theta) * (1 - pow(b.phi, j)) / (1 - b.phi) END, 2)), lambda a, t: a + t, {D0}) AS psi
            FROM (SELECT *, {_filtered_sql("b.phi", "b.theta")} AS f FROM {P}14) q1, (SELECT unnest(range(1, 7)) AS h) hh) q2) q3)""",
    )
    return ctes, f"SELECT * FROM {P}out"


_FC_CTES, _FC_SELECT = forecast_sql("items", "category", "date", "total_value")
ORACLE["forecast"] = W(["items"], _FC_SELECT, _FC_CTES)

# ------------------------------------------------------------ insights

_SALES_FC_CTES, _ = forecast_sql("sales", "'all'", "date", "revenue", prefix="g")
ORACLE["insights"] = W(["sales", "items"], f"""SELECT tc.k AS top_customer, CAST(tc.v AS DOUBLE) AS top_customer_revenue,
  CASE WHEN coalesce(tot.t, 0) = 0 THEN {D0} ELSE round(CAST(tc.v AS DOUBLE) / tot.t * 100, 6) END AS top_customer_pct,
  cm.k AS lead_category,
  CASE WHEN coalesce(ct.t, 0) = 0 THEN {D0} ELSE round(CAST(cm.v AS DOUBLE) / ct.t * 100, 6) END AS lead_category_pct,
  nf.month AS next_forecast_month, nf.forecast AS next_forecast,
  pk.month AS peak_month, pk.revenue AS peak_revenue
FROM (SELECT * FROM agg ORDER BY v DESC, k ASC NULLS FIRST LIMIT 1) tc, tot,
     (SELECT * FROM cagg ORDER BY v DESC, k ASC LIMIT 1) cm, (SELECT CAST(SUM(v) AS DOUBLE) AS t FROM cagg) ct,
     (SELECT * FROM gout ORDER BY step, month LIMIT 1) nf,
     (SELECT strftime(ms, '%Y-%m') AS month, CAST(v AS DOUBLE) AS revenue FROM m ORDER BY v DESC, ms ASC LIMIT 1) pk""",
    share_ctes("sales", "customer", "revenue")
    + (f"cagg AS (SELECT category AS k, {money_sum('total_value')} AS v FROM items GROUP BY category)",
       monthly_cte("sales"))
    + _SALES_FC_CTES)

# ------------------------------------------------------------ further operators over the same views

ORACLE["strict_number"] = W(["sales_raw"], """SELECT _row_id AS key,
  CASE WHEN regexp_full_match("Gross Total", '-?[0-9]+([.][0-9]*)?') THEN CAST("Gross Total" AS DOUBLE) END AS result FROM sales_raw""")
ORACLE["top_15_customers"] = top_n_sql("sales", "customer", "revenue", 15, "customer", with_pct=False)
ORACLE["roles_by_name"] = W(["sales_raw"], """SELECT role, col AS "column", filled FROM (
  SELECT 'date' AS role, 'date' AS col, count("Date") AS filled FROM sales_raw
  UNION ALL SELECT 'revenue', 'gross_total', count("Gross Total") FROM sales_raw
  UNION ALL SELECT 'customer', 'particulars', count("Particulars") FROM sales_raw
  UNION ALL SELECT 'product', 'particulars', count("Particulars") FROM sales_raw
  UNION ALL SELECT 'gstin', 'gstin_uin', count("GSTIN/UIN") FROM sales_raw
  UNION ALL SELECT 'category', 'voucher_type', count("Voucher Type") FROM sales_raw
  UNION ALL SELECT 'net_sales', 'sales', count("Sales") FROM sales_raw
  UNION ALL SELECT 'tax_amount', 'gstin_uin', count("GSTIN/UIN") FROM sales_raw) r""")
ORACLE["items_load_stats"] = W(["items"], """SELECT count(*) AS rows_read, count(*) FILTER (WHERE _row_id % 9 = 0) AS dropped_no_date,
  count(*) FILTER (WHERE _row_id % 9 <> 0 AND _row_id % 11 = 0) AS dropped_no_total,
  count(*) FILTER (WHERE _row_id % 9 <> 0 AND _row_id % 11 <> 0) AS rows_kept FROM items""")
ORACLE["enrich_empty_catalog"] = W(["items"], f"""SELECT {TRIMX('item_name')} AS _product, 'Uncategorized' AS _category,
  count(*) AS rows FROM items GROUP BY 1""")
ORACLE["integrate_skipped"] = W(["sales_raw"], """SELECT 'skipped' AS integration_status,
  'no tax id or customer column in both frames' AS reason, CAST(NULL AS VARCHAR) AS join_key_used,
  CAST(NULL AS VARCHAR) AS join_key_daybook, CAST(NULL AS VARCHAR) AS join_key_master, count(*) AS total_rows,
  CAST(0 AS BIGINT) AS matched_rows, count(*) AS unmatched_rows, CAST(0 AS DOUBLE) AS match_rate_pct,
  CAST(100 AS DOUBLE) AS unmatched_rate_pct, CAST(0 AS BIGINT) AS master_duplicate_rows_removed,
  CAST(0 AS BIGINT) AS daybook_rows_missing_join_key, (SELECT count(*) FROM part) AS reference_rows,
  'name_of_item, under, opening_qty, rate' AS reference_columns FROM cs""", CLEAN_CTES)
ORACLE["integrate_short"] = W(["sales_raw", "master"], f"""SELECT 'customer' AS join_key_used, count(*) AS total_rows,
  count(*) FILTER (WHERE _merge_status = 'matched') AS matched_rows, count(*) FILTER (WHERE _merge_status <> 'matched') AS unmatched_rows,
  CASE WHEN count(*) = 0 THEN {D0} ELSE round(CAST(count(*) FILTER (WHERE _merge_status = 'matched') AS DOUBLE) / count(*) * 100, 6) END AS match_rate,
  (SELECT count(*) FROM cm) - (SELECT count(DISTINCT _join_key) FROM (SELECT {TEXTKEY('customer_name')} AS _join_key FROM cm) x) AS master_duplicates_removed
FROM integ""", INTEG_CTES)
ORACLE["merged_roles"] = W(["sales_raw", "master"], """SELECT 'customer' AS role, 'customer_name' AS "column", count(customer_name) AS filled FROM integ
UNION ALL SELECT 'date', 'date', count(date) FROM integ
UNION ALL SELECT 'revenue', 'gross_total', count(gross_total) FROM integ""", INTEG_CTES)
ORACLE["export_wide"] = """SELECT strftime(o_orderdate, '%-d/%-m/%Y') AS date, 'Customer ' || CAST(o_custkey AS VARCHAR) AS particulars,
  'INV' || CAST(o_orderkey AS VARCHAR) AS voucher_no, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS gross_total,
  CAST(o_orderkey % 12 AS VARCHAR) || '" pipe' AS size,
  'order "' || CAST(o_orderkey AS VARCHAR) || '", paid' || CASE WHEN o_orderkey % 5 = 0 THEN chr(10) || 'late' ELSE '' END AS remarks,
  CASE WHEN o_orderkey % 97 = 0 AND year(o_orderdate) % 2 = 1 THEN 'end' || CAST(o_orderkey AS VARCHAR) END AS last_cell FROM orders"""
ORACLE["export_first"] = """SELECT particulars, date, voucher_no FROM (SELECT 'Customer ' || CAST(o_custkey AS VARCHAR) AS particulars,
  strftime(o_orderdate, '%-d/%-m/%Y') AS date, 'INV' || CAST(o_orderkey AS VARCHAR) AS voucher_no,
  row_number() OVER (PARTITION BY o_custkey ORDER BY year(o_orderdate), o_orderkey) AS nth FROM orders) t WHERE nth = 1"""

ORACLE["facet_order"] = f"""SELECT facet, value, CAST(row_number() OVER (PARTITION BY facet ORDER BY TRY_CAST(value AS INTEGER) NULLS FIRST, lower(value), value)
  AS INTEGER) AS place FROM ({ORACLE['facets']}) f"""
ORACLE["csv_sorted"] = """SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS rows, true AS in_order FROM orders GROUP BY 1"""
ORACLE["guards"] = """SELECT input, refused FROM (VALUES ('items', false), ('items without a category', true), ('items without a date', true),
  ('no items', true), ('export', false), ('export without dates', true), ('export without amounts', true),
  ('frames without a shared key', true)) g(input, refused)"""

# ------------------------------------------------------------ the payload's document (S6), section by section

def _section(name: str, sql: str, numbers: str = "", texts: str = "", order: str = "1") -> str:
    """The rows of one section: its fields as number or text, by place in the section."""
    fields = [f"{{'field': '{c}', 'number': CAST(\"{c}\" AS DOUBLE), 'text': CAST(NULL AS VARCHAR)}}" for c in numbers.split()]
    fields += [f"{{'field': '{c}', 'number': CAST(NULL AS DOUBLE), 'text': CAST(\"{c}\" AS VARCHAR)}}" for c in texts.split()]
    return (f"SELECT '{name}' AS section, i, u.field AS field, u.number AS number, u.text AS text FROM (SELECT i, unnest([{', '.join(fields)}]) AS u "
            f"FROM (SELECT *, CAST(row_number() OVER (ORDER BY {order}) - 1 AS INTEGER) AS i FROM ({sql}) q) r) s")


_SALES_M = lambda sql: W(["sales"], sql, (monthly_cte("sales"),))
ORACLE["payload"] = " UNION ALL ".join([
    _section("cleaning", f"""SELECT dropped AS rows_dropped_missing_date_or_revenue, filled AS missing_customers_filled,
        kept AS records_after_cleaning FROM ({ORACLE['clean_stats']}) c""",
             "rows_dropped_missing_date_or_revenue missing_customers_filled records_after_cleaning"),
    _section("integration", ORACLE["integrate_summary"], "total_rows matched_rows unmatched_rows match_rate_pct unmatched_rate_pct "
             "master_duplicate_rows_removed daybook_rows_missing_join_key", "join_key_used join_key_daybook join_key_master"),
    _section("revenue_analysis", ORACLE["revenue_summary"], "total mean median std"),
    _section("distribution_analysis", ORACLE["distribution"], "q1 q3 skew"),
    _section("high_value", ORACLE["high_value"], "high_value_pct"),
    _section("customer_concentration", ORACLE["top_share"], "top10_pct top20_pct"),
    _section("pareto", ORACLE["pareto_count"], "customers_within_80pct"),
    _section("item_totals", ORACLE["item_totals"], "rows total mean", "start end"),
    _section("top3_items", ORACLE["top3_share"], "top3_pct"),
    _section("unique_customers", "SELECT count(DISTINCT customer) AS unique_customers FROM (" + W(["sales"], "SELECT customer FROM sales") + ") c",
             "unique_customers"),
    _section("tax_analysis", ORACLE["tax_component"], "net_total tax_total tax_pct"),
    _section("top_10_customers", ORACLE["top_customers"], "revenue pct", "customer", "revenue DESC, customer"),
    _section("monthly_revenue", ORACLE["monthly_revenue"], "revenue", "month", "month"),
    _section("moving_average", _SALES_M("""SELECT strftime(ms, '%Y-%m') AS month, CAST(v AS DOUBLE) AS revenue, round(CAST(SUM(v) OVER w AS DOUBLE)
        / COUNT(*) OVER w, 6) AS ma3 FROM m WINDOW w AS (ORDER BY ms ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"""), "revenue ma3", "month", "month"),
    _section("month_of_year_revenue", _SALES_M(f"""SELECT CAST(g.k AS INTEGER) AS month_no, monthname(make_date(2000, CAST(g.k AS INTEGER), 1)) AS month_name,
        coalesce(CAST(SUM(m.v) AS DOUBLE), {D0}) AS revenue FROM range(1, 13) g(k) LEFT JOIN m ON month(m.ms) = g.k GROUP BY 1, 2"""),
             "month_no revenue", "month_name", "month_no"),
    _section("year_wise_revenue", ORACLE["revenue_by_year"], "year revenue", "", "year"),
    _section("yearly_growth_pct", ORACLE["yoy_growth"], "year growth_pct", "", "year"),
    _section("peak_and_weakest", ORACLE["peak_month"], "revenue", "kind month", "kind"),
    _section("category_mix", ORACLE["category_mix"], "revenue pct", "category", "revenue DESC, category"),
    _section("top_items", ORACLE["top_items"], "revenue pct", "item", "revenue DESC, item"),
    _section("forecast", W(["sales"], "SELECT month, step, forecast, lower_95, upper_95 FROM gout", _SALES_FC_CTES),
             "step forecast lower_95 upper_95", "month", "step"),
    _section("roles", """SELECT 'date' AS "date", 'gross_total' AS revenue, 'particulars' AS customer, 'gstin_uin' AS gstin,
        'particulars' AS product, 'voucher_type' AS category, 'sales' AS net_sales""", "", "date revenue customer gstin product category net_sales"),
])
