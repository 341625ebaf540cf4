"""DuckDB SQL twins of the queries in ``ledgerlens.plans.queries``.

The view CTEs below restate ``ledgerlens.sources.fixtures`` in SQL.  Money is
summed as DECIMAL and cast to DOUBLE at the end; derived ratios are rounded
to 6 places.  Nothing here is taken from the code under test.
"""

from __future__ import annotations

VIEWS = {
    "sales": """sales AS (
  SELECT o.o_orderkey AS _row_id, o.o_orderdate AS date, c.c_name AS customer,
         c.c_mktsegment AS segment, o.o_orderkey AS voucher_no, o.o_totalprice AS revenue
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey)""",
    "sales_gaps": """sales_gaps AS (
  SELECT * REPLACE (CASE WHEN (year(date) * 12 + month(date) - 1) % 5 = 0 THEN date + INTERVAL 1 MONTH ELSE date END AS date)
  FROM sales)""",
    "invoice_tax": """invoice_tax AS (
  SELECT date, customer, net, net * (1 + tax) AS gross, net * tax * 0.5 AS cgst,
         net * tax * 0.5 AS sgst, CAST(0 AS DECIMAL(3,2)) AS igst, gst_rate
  FROM (SELECT o.o_orderdate AS date, c.c_name AS customer,
               CAST(l.l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l.l_discount AS DECIMAL(3,2))) AS net,
               CAST(l.l_tax AS DECIMAL(3,2)) AS tax, l.l_tax AS gst_rate
        FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
        JOIN customer c ON o.o_custkey = c.c_custkey) t)""",
    "items": """items AS (
  SELECT l.l_orderkey * 10 + l.l_linenumber AS _row_id, l.l_shipdate AS date,
         'INV' || CAST(l.l_orderkey AS VARCHAR) AS invoice_no, c.c_name AS customer,
         p.p_name AS item_name, p.p_type AS category, l.l_quantity AS quantity,
         l.l_extendedprice / l.l_quantity AS unit_price, l.l_extendedprice AS total_value
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey JOIN part p ON l.l_partkey = p.p_partkey)""",
    "catalog": """catalog AS (
  SELECT p_partkey AS _row_id, p_name AS name_of_item, p_type AS under,
         p_size AS opening_qty, p_retailprice AS rate FROM part)""",
    "sales_raw": """sales_raw AS (
  SELECT k AS _row_id,
    CASE WHEN k % 19 = 0 THEN '31/02/' || CAST(year(d) AS VARCHAR)
         WHEN k % 3 = 0 THEN strftime(d, '%Y-%m-%d')
         WHEN k % 3 = 1 THEN strftime(d, '%-d/%-m/%Y')
         ELSE strftime(d, '%-d-%b-%Y') END AS "Date",
    CASE WHEN k % 23 = 0 THEN NULL
         WHEN k % 5 = 0 THEN nm
         WHEN k % 5 = 1 THEN '  ' || nm || '  '
         WHEN k % 5 = 2 THEN replace(nm, '#', '  #')
         WHEN k % 5 = 3 THEN chr(160) || upper(nm) || chr(160)
         ELSE lower(nm) || ' ' END AS "Particulars",
    'Sales' AS "Voucher Type",
    'INV' || CAST(k AS VARCHAR) AS "Voucher No",
    lpad(CAST(nk AS VARCHAR), 2, '0') || 'AAACB' || lpad(CAST(ck % 10000 AS VARCHAR), 4, '0')
      || 'C1Z' || CAST(ck % 10 AS VARCHAR) AS "GSTIN/UIN",
    CASE WHEN k % 13 = 0 THEN NULL
         WHEN k % 17 = 0 THEN '-'
         WHEN k % 7 = 0 THEN format('{:,.2f}', CAST(amt AS DOUBLE))
         WHEN k % 11 = 0 THEN CAST(amt AS VARCHAR) || ' Dr'
         ELSE CAST(amt AS VARCHAR) END AS "Gross Total",
    CASE WHEN k % 29 = 0 THEN NULL
         ELSE CAST(CAST(amt * 0.85 AS DECIMAL(18,2)) AS VARCHAR) END AS "Sales"
  FROM (SELECT o.o_orderkey AS k, o.o_orderdate AS d, c.c_name AS nm, c.c_nationkey AS nk,
               c.c_custkey AS ck, CAST(o.o_totalprice AS DECIMAL(18,2)) AS amt
        FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey) t)""",
    "date_forms": """date_forms AS (SELECT k AS key, i, CASE i WHEN 15 THEN '31/02/' || CAST(year(d) AS VARCHAR)
    WHEN 0 THEN strftime(d, '%Y-%m-%d') WHEN 1 THEN strftime(d, '%Y-%m-%d %H:%M:%S') WHEN 2 THEN strftime(d, '%Y/%m/%d')
    WHEN 3 THEN strftime(d, '%Y-%m-%dT%H:%M:%S') WHEN 4 THEN strftime(d, '%Y-%m-%d %H:%M') WHEN 5 THEN strftime(d, '%-d/%-m/%Y')
    WHEN 6 THEN strftime(d, '%d/%m/%Y %H:%M:%S') WHEN 7 THEN strftime(d, '%d-%m-%Y') WHEN 8 THEN strftime(d, '%d.%m.%Y')
    WHEN 9 THEN strftime(d, '%-d/%-m/%y') WHEN 10 THEN strftime(d, '%-d-%b-%Y') WHEN 11 THEN strftime(d, '%d-%b-%Y %H:%M')
    WHEN 12 THEN strftime(d, '%-d %b %Y') WHEN 13 THEN strftime(d, '%-d-%B-%Y') WHEN 14 THEN strftime(d, '%d-%b-%y')
    WHEN 16 THEN strftime(d, '%Y-%m-%dT%H:%M:%SZ') WHEN 17 THEN strftime(d, '%Y-%m-%dT%H:%M:%S+05:30')
    WHEN 18 THEN strftime(d, '%d/%m/%Y %I:%M %p') WHEN 19 THEN strftime(d, '%Y%m%d') WHEN 20 THEN strftime(d, '%b %-d, %Y')
    WHEN 21 THEN strftime(d, '%a, %-d %b %Y') WHEN 22 THEN strftime(d, '%-dth %b %Y') WHEN 23 THEN strftime(d, '%Y-%m')
    WHEN 24 THEN strftime(d, '%B %Y') WHEN 25 THEN strftime(d, '%Y%m%d%H%M%S') END AS text
  FROM (SELECT o_orderkey AS k, o_orderkey % 26 AS i, date_trunc('day', o_orderdate) + to_hours(CAST(o_orderkey % 24 AS INTEGER))
    + to_minutes(CAST(o_orderkey % 60 AS INTEGER)) AS d FROM orders) t)""",
    "sub_cents": """sub_cents AS (SELECT l_orderkey % 7 AS key, l_quantity * CASE l_linenumber % 3 WHEN 0 THEN CAST(1e15 AS DOUBLE)
    WHEN 1 THEN CAST(0.0001 AS DOUBLE) ELSE CAST(-0.004 AS DOUBLE) END AS value FROM lineitem)""",
    "master": """master AS (
  SELECT c_custkey * 2 AS _row_id,
         CASE WHEN c_custkey % 50 = 2 THEN NULL WHEN c_custkey % 10 = 0 THEN c_name || ' Ltd' ELSE c_name END AS "Customer Name",
         c_mktsegment AS "Segment", CAST(c_nationkey AS VARCHAR) AS "Nation Code",
         CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) AS "Credit Limit"
  FROM customer
  UNION ALL
  SELECT c_custkey * 2 + 1, upper(c_name), lower(c_mktsegment), CAST(c_nationkey AS VARCHAR),
         CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR)
  FROM customer WHERE c_custkey % 10 = 1)""",
    "export_raw": """export_raw AS (
  SELECT * FROM (VALUES
    (-5, 'Acme Traders Pvt Ltd', NULL, NULL, NULL, NULL, NULL, NULL),
    (-4, 'Sales Register', NULL, NULL, NULL, NULL, NULL, NULL),
    (-3, '1-Jan-1995 to 31-Dec-2001', NULL, NULL, NULL, NULL, NULL, NULL),
    (-2, NULL, NULL, NULL, NULL, NULL, NULL, NULL),
    (-1, 'Date', 'Particulars', 'Voucher Type', 'Voucher No', 'GSTIN/UIN', 'Gross Total', 'Sales'))
    v(_row_id, _c0, _c1, _c2, _c3, _c4, _c5, _c6)
  UNION ALL
  SELECT _row_id, "Date", "Particulars", "Voucher Type", "Voucher No", "GSTIN/UIN", "Gross Total", "Sales"
  FROM sales_raw)""",
}

# views each view depends on (so a query lists only what it reads)
VIEW_DEPS = {
    "sales_gaps": ["sales"],
    "export_raw": ["sales_raw"],
}


def with_views(names: list[str], body: str, ctes: tuple[str, ...] = ()) -> str:
    """Prefix `body` with the CTEs of the named views (dependencies first),
    followed by any query-local CTEs."""
    order: list[str] = []

    def add(n):
        for d in VIEW_DEPS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    return "WITH " + ",\n".join([VIEWS[n] for n in order] + list(ctes)) + "\n" + body
