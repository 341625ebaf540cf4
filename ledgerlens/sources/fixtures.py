"""The analysis views, derived from the driver's star-schema tables.

Each view here has a twin CTE in ``ledgerlens.plans.oracle`` written in DuckDB
SQL; both must stay the same deterministic expression.  Dirty views inject
dirt by key modulo (never by sampling or dropping), so every row of the source
tables flows through.  A view joins a dimension only where the caller wants a
column of it (``customer=False``, ``part=False``, ``order=False``): every order
has its customer and every line its order and part, so rows stay the same.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.sources.tables import read_table

NBSP = "\u00a0"

# Header cells of the raw day-book export, in file order.
RAW_SALES_HEADER = ["Date", "Particulars", "Voucher Type", "Voucher No", "GSTIN/UIN", "Gross Total", "Sales"]
# Header cells of the raw customer master sheet.
RAW_MASTER_HEADER = ["Customer Name", "Segment", "Nation Code", "Credit Limit"]
# The preamble lines an ERP report puts above its header row.
EXPORT_TITLE_LINES = ["Acme Traders Pvt Ltd", "Sales Register", "1-Jan-1995 to 31-Dec-2001"]


def _orders_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    return o.join(c, o.o_custkey == c.c_custkey)


def _lines_orders_customers(spark: SparkSession, sf_dir: str, li: DataFrame, order_cols: list[str]) -> DataFrame:
    """Line items joined to their order, then to the order's customer.

    Fact-to-fact first (lineitem and orders share `orderkey`; at scale a
    sort-merge join, or none at all when both are bucketed by it), then the
    customer dimension, which Spark broadcasts only under its measured size
    threshold.
    """
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", *order_cols)
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return li.join(o, li.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == c.c_custkey)


def sales(spark: SparkSession, sf_dir: str, customer: bool = True) -> DataFrame:
    """Clean invoice-level sales: one row per order."""
    if not customer:
        return read_table(spark, sf_dir, "orders").select(
            F.col("o_orderkey").alias("_row_id"), F.col("o_orderdate").alias("date"),
            F.col("o_orderkey").alias("voucher_no"), F.col("o_totalprice").alias("revenue"))
    oc = _orders_customers(spark, sf_dir)
    return oc.select(
        F.col("o_orderkey").alias("_row_id"),
        F.col("o_orderdate").alias("date"),
        F.col("c_name").alias("customer"),
        F.col("c_mktsegment").alias("segment"),
        F.col("o_orderkey").alias("voucher_no"),
        F.col("o_totalprice").alias("revenue"),
    )


def month_index(date_col) -> F.Column:
    return F.year(date_col) * 12 + F.month(date_col) - 1


def sales_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`sales` with the orders of every fifth calendar month moved to the next (months with no sales)."""
    s = sales(spark, sf_dir, customer=False)
    return s.withColumn("date", F.when(month_index(F.col("date")) % 5 == 0, F.expr("date + INTERVAL 1 MONTH"))
                        .otherwise(F.col("date")))


def invoice_tax(spark: SparkSession, sf_dir: str, order: bool = True, customer: bool = True) -> DataFrame:
    """Invoice lines with gross, net and split tax amounts (exact decimals)."""
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount", "l_tax")
    if customer:
        j = _lines_orders_customers(spark, sf_dir, li, ["o_orderdate"])
    elif order:
        o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
        j = li.join(o, li.l_orderkey == o.o_orderkey)
    else:
        j = li
    ext = F.col("l_extendedprice").cast("decimal(12,2)")
    disc = F.col("l_discount").cast("decimal(3,2)")
    tax = F.col("l_tax").cast("decimal(3,2)")
    net = ext * (F.lit(1) - disc)
    return j.select(
        *([F.col("o_orderdate").alias("date")] if order or customer else []),
        *([F.col("c_name").alias("customer")] if customer else []),
        net.alias("net"),
        (net * (F.lit(1) + tax)).alias("gross"),
        (net * tax * F.lit(Decimal("0.5"))).alias("cgst"),
        (net * tax * F.lit(Decimal("0.5"))).alias("sgst"),
        F.lit(0).cast("decimal(3,2)").alias("igst"),
        F.col("l_tax").alias("gst_rate"),
    )


def items(spark: SparkSession, sf_dir: str, customer: bool = True, part: bool = True) -> DataFrame:
    """Item lines: one row per line item, priced and categorised by part."""
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_shipdate")
    j = _lines_orders_customers(spark, sf_dir, li, []) if customer else li
    if part:
        p = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
        j = j.join(p, F.col("l_partkey") == p.p_partkey)
    return j.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("_row_id"),
        F.col("l_shipdate").alias("date"),
        F.concat(F.lit("INV"), F.col("l_orderkey").cast("string")).alias("invoice_no"),
        *([F.col("c_name").alias("customer")] if customer else []),
        *([F.col("p_name").alias("item_name"), F.col("p_type").alias("category")] if part else []),
        F.col("l_quantity").alias("quantity"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
        F.col("l_extendedprice").alias("total_value"),
    )


def items_text(spark: SparkSession, sf_dir: str, lenient: bool = False) -> DataFrame:
    """`items` as an all-text export with its original header names.

    The lenient variant lacks `Total Value` and `Category` (they are derived
    or defaulted by the lenient loader).
    """
    it = items(spark, sf_dir)
    cols = [
        ("_row_id", F.col("_row_id")),
        ("Date", F.date_format("date", "yyyy-MM-dd")),
        ("Invoice No", F.col("invoice_no")),
        ("Customer", F.col("customer")),
        ("Item Name", F.col("item_name")),
        ("Category", F.col("category")),
        ("Quantity", F.col("quantity").cast("string")),
        ("Unit Price", F.col("unit_price").cast("string")),
        ("Total Value", F.col("total_value").cast("string")),
    ]
    if lenient:
        cols = [(n, c) for n, c in cols if n not in ("Category", "Total Value")]
    return it.select(*[c.alias(n) for n, c in cols])


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product catalog sheet (names repeat, so keep-first by `_row_id` matters)."""
    p = read_table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("_row_id"),
        F.col("p_name").alias("name_of_item"),
        F.col("p_type").alias("under"),
        F.col("p_size").alias("opening_qty"),
        F.col("p_retailprice").alias("rate"),
    )


def _money_text(col) -> F.Column:
    return col.cast("decimal(18,2)").cast("string")


def sales_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day-book export as text, with the dirt real exports carry."""
    oc = _orders_customers(spark, sf_dir)
    k = F.col("o_orderkey")
    d = F.col("o_orderdate")
    date_txt = (
        F.when(k % 19 == 0, F.concat(F.lit("31/02/"), F.year(d).cast("string")))
        .when(k % 3 == 0, F.date_format(d, "yyyy-MM-dd"))
        .when(k % 3 == 1, F.date_format(d, "d/M/yyyy"))
        .otherwise(F.date_format(d, "d-MMM-yyyy"))
    )
    name = F.col("c_name")
    cust_txt = (
        F.when(k % 23 == 0, F.lit(None).cast("string"))
        .when(k % 5 == 0, name)
        .when(k % 5 == 1, F.concat(F.lit("  "), name, F.lit("  ")))
        .when(k % 5 == 2, F.replace(name, F.lit("#"), F.lit("  #")))
        .when(k % 5 == 3, F.concat(F.lit(NBSP), F.upper(name), F.lit(NBSP)))
        .otherwise(F.concat(F.lower(name), F.lit(" ")))
    )
    amount = F.col("o_totalprice").cast("decimal(18,2)")
    gross_txt = (
        F.when(k % 13 == 0, F.lit(None).cast("string"))
        .when(k % 17 == 0, F.lit("-"))
        .when(k % 7 == 0, F.format_number(amount, 2))
        .when(k % 11 == 0, F.concat(amount.cast("string"), F.lit(" Dr")))
        .otherwise(amount.cast("string"))
    )
    net_txt = F.when(k % 29 == 0, F.lit(None).cast("string")).otherwise(
        _money_text(amount * F.lit(Decimal("0.85"))))
    gstin = F.concat(
        F.lpad(F.col("c_nationkey").cast("string"), 2, "0"), F.lit("AAACB"),
        F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0"), F.lit("C1Z"),
        (F.col("c_custkey") % 10).cast("string"))
    return oc.select(
        k.alias("_row_id"),
        date_txt.alias("Date"),
        cust_txt.alias("Particulars"),
        F.lit("Sales").alias("Voucher Type"),
        F.concat(F.lit("INV"), k.cast("string")).alias("Voucher No"),
        gstin.alias("GSTIN/UIN"),
        gross_txt.alias("Gross Total"),
        net_txt.alias("Sales"),
    )


def date_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates as text, in every form that exports use (and some that are no dates)."""
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    forms = ["yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "d/M/yyyy",
             "dd/MM/yyyy HH:mm:ss", "dd-MM-yyyy", "dd.MM.yyyy", "d/M/yy", "d-MMM-yyyy", "dd-MMM-yyyy HH:mm", "d MMM yyyy",
             "d-MMMM-yyyy", "dd-MMM-yy", "", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss'+05:30'", "dd/MM/yyyy hh:mm a",
             "yyyyMMdd", "MMM d, yyyy", "EEE, d MMM yyyy", "d'th' MMM yyyy", "yyyy-MM", "MMMM yyyy", "yyyyMMddHHmmss"]
    # times of day from the key: the dates themselves are midnights
    at = F.make_timestamp_ntz(F.year(d), F.month(d), F.dayofmonth(d), (k % 24).cast("int"), (k % 60).cast("int"), F.lit(0))
    text = F.when(k % len(forms) == 15, F.concat(F.lit("31/02/"), F.year(d).cast("string")))
    for i, form in enumerate(forms):
        text = text.when(k % len(forms) == i, F.date_format(at, form)) if form else text
    return read_table(spark, sf_dir, "orders").select(k.alias("key"), text.alias("text"))


def sub_cents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line values of less than a cent and of many digits, of either sign."""
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    scale = F.when(F.col("l_linenumber") % 3 == 0, 1e15).when(F.col("l_linenumber") % 3 == 1, 0.0001).otherwise(-0.004)
    return li.select((F.col("l_orderkey") % 7).alias("key"), (F.col("l_quantity") * scale).alias("value"))


def master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer master sheet as text: unmatched, duplicated and null-named keys."""
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey", "c_acctbal")
    k = F.col("c_custkey")
    # every tenth customer has another name in the sheet, so its sales find no match
    base = c.select(
        (k * 2).alias("_row_id"),
        F.when(k % 50 == 2, F.lit(None).cast("string")).when(k % 10 == 0, F.concat("c_name", F.lit(" Ltd")))
        .otherwise(F.col("c_name")).alias("Customer Name"),
        F.col("c_mktsegment").alias("Segment"),
        F.col("c_nationkey").cast("string").alias("Nation Code"),
        _money_text(F.col("c_acctbal")).alias("Credit Limit"),
    )
    dups = c.filter(k % 10 == 1).select(
        (k * 2 + 1).alias("_row_id"),
        F.upper(F.col("c_name")).alias("Customer Name"),
        F.lower(F.col("c_mktsegment")).alias("Segment"),
        F.col("c_nationkey").cast("string").alias("Nation Code"),
        _money_text(F.col("c_acctbal")).alias("Credit Limit"),
    )
    return base.unionByName(dups)


def export_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day-book export as a headless sheet: title lines, a blank line, the
    header line, then every order; columns `_c0`..`_c6` plus `_row_id`."""
    n = len(RAW_SALES_HEADER)
    names = [f"_c{i}" for i in range(n)]
    pre_rows = [(-5, EXPORT_TITLE_LINES[0]), (-4, EXPORT_TITLE_LINES[1]), (-3, EXPORT_TITLE_LINES[2]), (-2, None)]
    pre = spark.createDataFrame(
        [(rid, txt) + (None,) * (n - 1) for rid, txt in pre_rows] + [(-1,) + tuple(RAW_SALES_HEADER)],
        "_row_id long, " + ", ".join(f"{c} string" for c in names))
    raw = sales_raw(spark, sf_dir)
    body = raw.select(F.col("_row_id"), *[F.col(f"`{h}`").alias(c) for h, c in zip(RAW_SALES_HEADER, names)])
    return pre.unionByName(body)


def export_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text lines of one export file a year (`file`, `value`): two title lines, a header, the orders.

    Remarks are quoted and hold separators, doubled quotes and line breaks; sizes hold
    inch marks, in cells that are not quoted; in odd years every 97th order's record has
    300 cells.  Lines are sorted by file and place over any number of tasks.
    """
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    k, file = F.col("o_orderkey"), F.year("o_orderdate")
    remark = F.concat(F.lit('"order ""'), k.cast("string"), F.lit('"", paid'), F.when(k % 5 == 0, F.lit("\nlate")).otherwise(F.lit("")), F.lit('"'))
    size = F.concat((k % 12).cast("string"), F.lit('" pipe'))
    tail = F.when((k % 97 == 0) & (file % 2 == 1), F.concat(F.lit("," * 294), F.lit("end"), k.cast("string"))).otherwise(F.lit(""))
    line = F.concat(F.date_format("o_orderdate", "d/M/yyyy"), F.lit(",Customer "), F.col("o_custkey").cast("string"), F.lit(",INV"),
                    k.cast("string"), F.lit(","), F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit(","), size, F.lit(","), remark, tail)
    body = o.select(file.alias("file"), k.alias("at"), line.alias("value"))
    files = o.select(file.alias("file")).distinct()
    head = files.select("file", F.explode(F.array(
        F.struct(F.lit(-3).cast("long").alias("at"), F.lit(EXPORT_TITLE_LINES[0]).alias("value")),
        F.struct(F.lit(-2).cast("long").alias("at"), F.lit(EXPORT_TITLE_LINES[1]).alias("value")),
        F.struct(F.lit(-1).cast("long").alias("at"), F.lit('Date,Particulars,"Voucher\nNo",Gross Total,Size,Remarks').alias("value")))).alias("l")).select("file", "l.*")
    return head.unionByName(body).repartitionByRange("file", "at").sortWithinPartitions("file", "at").select("file", "value")


VIEWS = {
    "sales": sales,
    "sales_gaps": sales_gaps,
    "invoice_tax": invoice_tax,
    "items": items,
    "catalog": catalog,
    "sales_raw": sales_raw,
    "master": master,
    "export_raw": export_raw,
}
