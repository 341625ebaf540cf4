"""Named queries: each takes (spark, sf_dir) and returns a lazy DataFrame.

The twin DuckDB SQL of each query lives in ``ledgerlens.plans.oracle_queries``.
"""

from __future__ import annotations

import uuid
from typing import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.sources import fixtures as fx
from ledgerlens.operators import distribution as dist
from ledgerlens.operators import metrics as met
from ledgerlens.operators import pareto as par
from ledgerlens.operators import timeseries as ts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__.removeprefix("q_")] = fn
    return fn


# ------------------------------------------------------------ time series

@query
def q_monthly_revenue(spark, d):
    return ts.monthly_revenue(fx.sales(spark, d, customer=False), "date", "revenue")


@query
def q_monthly_filled(spark, d):
    return ts.monthly_filled(fx.sales_gaps(spark, d), "date", "revenue")


@query
def q_moving_avg_3m(spark, d):
    return ts.moving_average(fx.sales_gaps(spark, d), "date", "revenue")


@query
def q_revenue_by_year(spark, d):
    return ts.revenue_by_year(fx.sales(spark, d, customer=False), "date", "revenue")


@query
def q_yoy_growth(spark, d):
    return ts.yoy_growth(fx.sales(spark, d, customer=False), "date", "revenue")


@query
def q_seasonality(spark, d):
    return ts.seasonality(fx.sales_gaps(spark, d), "date", "revenue")


@query
def q_peak_month(spark, d):
    return ts.peak_month(fx.sales(spark, d, customer=False), "date", "revenue")


@query
def q_calendar_pool(spark, d):
    return ts.calendar_pool(fx.sales(spark, d, customer=False), "date")


# ------------------------------------------------------------ revenue & distribution

@query
def q_revenue_summary(spark, d):
    return met.revenue_summary(fx.sales(spark, d, customer=False), "revenue")


@query
def q_distribution(spark, d):
    return dist.distribution(fx.sales(spark, d, customer=False), "revenue")


@query
def q_high_value(spark, d):
    return dist.high_value_share(fx.sales(spark, d, customer=False), "revenue")


@query
def q_histogram(spark, d):
    return dist.histogram(fx.sales(spark, d, customer=False), "revenue", 30)


@query
def q_monthly_histogram(spark, d):
    return dist.monthly_histogram(fx.sales(spark, d, customer=False), "date", "revenue", 10)


# ------------------------------------------------------------ customers

@query
def q_unique_customers(spark, d):
    return met.unique_customers(fx.sales_raw(spark, d), "Particulars")


@query
def q_top_customers(spark, d):
    return par.top_n(fx.sales(spark, d), "customer", "revenue", 10)


@query
def q_top_share(spark, d):
    return par.top_share(fx.sales(spark, d), "customer", "revenue", (10, 20))


@query
def q_pareto_curve(spark, d):
    return par.pareto_curve(fx.sales(spark, d), "customer", "revenue", 20)


@query
def q_pareto_count(spark, d):
    return par.pareto_count(fx.sales(spark, d), "customer", "revenue")


@query
def q_customer_weights(spark, d):
    return met.customer_weights(fx.sales(spark, d), "customer")


# ------------------------------------------------------------ tax

@query
def q_tax_component(spark, d):
    return met.gross_vs_net(fx.invoice_tax(spark, d, order=False, customer=False), "gross", "net")


@query
def q_gross_net_year(spark, d):
    return met.gross_net_by_year(fx.invoice_tax(spark, d, customer=False), "date", "gross", "net")


@query
def q_tax_breakdown(spark, d):
    return met.tax_breakdown(fx.invoice_tax(spark, d, order=False, customer=False)).select("name", "value")


# ------------------------------------------------------------ items

@query
def q_item_totals(spark, d):
    return met.item_totals(fx.items(spark, d, customer=False, part=False))


@query
def q_item_monthly(spark, d):
    return met.item_monthly(fx.items(spark, d, customer=False, part=False))


@query
def q_category_mix(spark, d):
    return met.share_by(fx.items(spark, d, customer=False), "category", "total_value", "category", "revenue")


@query
def q_category_sales(spark, d):
    return met.totals_by(fx.items(spark, d, customer=False), "category", "total_value", "category", "total_value")


@query
def q_top_items(spark, d):
    return par.top_n(fx.items(spark, d, customer=False), "item_name", "total_value", 10, out_key="item")


@query
def q_top3_share(spark, d):
    return met.top_share_n(fx.items(spark, d, customer=False), "item_name", "total_value", 3, "top3_pct")


@query
def q_top_products(spark, d):
    return par.top_n(fx.items(spark, d, customer=False), "item_name", "total_value", 10, out_value="total_value", with_pct=False)


# ------------------------------------------------------------ column expressions

from ledgerlens.functions.dates import month_label, month_start, parse_dayfirst  # noqa: E402
from ledgerlens.functions.numbers import lenient_number  # noqa: E402
from ledgerlens.functions.text import product_key, text_key, trim_text  # noqa: E402
from ledgerlens.operators import clean as cl  # noqa: E402
from ledgerlens.operators import integrate as ig  # noqa: E402


@query
def q_trim_text(spark, d):
    return fx.sales_raw(spark, d).select(F.col("_row_id").alias("key"), trim_text("Particulars").alias("result"))


@query
def q_lenient_number(spark, d):
    return fx.sales_raw(spark, d).select(F.col("_row_id").alias("key"), lenient_number("Gross Total").alias("result"))


@query
def q_date_parse(spark, d):
    return fx.date_forms(spark, d).select("key", parse_dayfirst("text").alias("result"))


@query
def q_money_scale(spark, d):
    return met.totals_by(fx.sub_cents(spark, d), "key", "value", "key", "total")


@query
def q_time_features(spark, d):
    t = fx.sales_raw(spark, d).select(F.col("_row_id").alias("key"), parse_dayfirst("Date").alias("t"))
    return t.select("key", F.year("t").alias("year"), F.month("t").alias("month"), month_label("t").alias("year_month"))


@query
def q_text_key(spark, d):
    return fx.sales_raw(spark, d).select(F.col("_row_id").alias("key"), text_key("Particulars").alias("result"))


@query
def q_product_key(spark, d):
    return fx.catalog(spark, d).select(F.col("_row_id").alias("key"), product_key("name_of_item").alias("result"))


# ------------------------------------------------------------ cleaning composites

def _cleaned(spark, d, impute=True):
    return cl.clean_sales(fx.sales_raw(spark, d), impute=impute)


def _master(spark, d):
    return cl.clean_reference(fx.master(spark, d))[0]


@query
def q_numeric_ratio(spark, d):
    return cl.numeric_ratios(cl.prepare(fx.sales_raw(spark, d)))


@query
def q_numeric_promote(spark, d):
    df = cl.prepare(fx.sales_raw(spark, d))
    from ledgerlens.operators import roles as R
    protect = tuple(c for c in (R.date_role(df.columns), R.customer_role(df.columns), R.gstin_role(df.columns)) if c)
    out, promoted = cl.promote_numeric(df, protect=protect)
    return out.select("_row_id", *promoted)


@query
def q_clean_stats(spark, d):
    return _cleaned(spark, d, impute=False).stats.select(
        F.col("rows_dropped_missing_date_or_revenue").alias("dropped"),
        F.col("missing_customers_filled").alias("filled"),
        F.col("records_after_cleaning").alias("kept"))


@query
def q_median_impute(spark, d):
    return _cleaned(spark, d).dataframe.select(F.col("_row_id").alias("key"), F.col("sales").alias("amount"))


@query
def q_clean_sales(spark, d):
    return _cleaned(spark, d).dataframe


@query
def q_clean_reference(spark, d):
    return _master(spark, d)


@query
def q_dedupe_first(spark, d):
    m = _master(spark, d)
    return ig.dedupe_first(m.withColumn(ig.KEY, text_key("customer_name")), ig.KEY)


def _integrated(spark, d, impute=True):
    return ig.integrate_sales_and_master(_cleaned(spark, d, impute), _master(spark, d))


@query
def q_integrate(spark, d):
    return _integrated(spark, d)[0]


@query
def q_integrate_summary(spark, d):
    return _integrated(spark, d, impute=False)[1]


@query
def q_sales_base(spark, d):
    cs = _cleaned(spark, d, impute=False)
    merged, _ = ig.integrate_sales_and_master(cs, _master(spark, d))
    base = cl.sales_base(merged, cs.date_column, cs.revenue_column, cs.customer_column)
    return base.select("_row_id", "_date", "_year", "_month", "_revenue", "_customer", "_customer_norm", "_merge_status")


# ------------------------------------------------------------ catalog & roles by data

from ledgerlens.operators import catalog as ct  # noqa: E402
from ledgerlens.operators import facets as fc  # noqa: E402
from ledgerlens.operators import roles as R  # noqa: E402
from ledgerlens.sources import items as itl  # noqa: E402


def _enriched(spark, d):
    e = ct.enrich(fx.items(spark, d), fx.catalog(spark, d))
    return e.withColumn("_revenue", F.col("total_value"))


@query
def q_catalog(spark, d):
    return ct.build_catalog(fx.catalog(spark, d))


@query
def q_enrich(spark, d):
    return _enriched(spark, d).select("_row_id", "item_name", "total_value", "_product", "_category")


@query
def q_product_top(spark, d):
    return ct.product_ranking(_enriched(spark, d), 10)


@query
def q_product_category(spark, d):
    return ct.category_revenue(_enriched(spark, d))


@query
def q_product_contribution(spark, d):
    return ct.product_contribution(_enriched(spark, d), 10)


@query
def q_catalog_top(spark, d):
    return ct.catalog_top(fx.catalog(spark, d), 10)


@query
def q_catalog_category(spark, d):
    return ct.catalog_by_category(fx.catalog(spark, d))


@query
def q_catalog_contribution(spark, d):
    return ct.catalog_contribution(fx.catalog(spark, d), 10)


@query
def q_role_overlap(spark, d):
    keys = ct.build_catalog(fx.catalog(spark, d)).select("key")
    return R.catalog_overlap(fx.items(spark, d), keys).select("column", "overlap")


@query
def q_role_catalog_value(spark, d):
    return R.catalog_value_scores(fx.catalog(spark, d)).select("column", "score")


@query
def q_role_distinct(spark, d):
    return R.distinct_counts(fx.items(spark, d))


# ------------------------------------------------------------ item loaders

@query
def q_items_load(spark, d):
    return itl.load_items(fx.items_text(spark, d)).select(*itl.REQUIRED)


@query
def q_items_load_lenient(spark, d):
    return itl.load_items_lenient(fx.items_text(spark, d, lenient=True)).select(*itl.REQUIRED)


# ------------------------------------------------------------ dashboard slices and facets

# Fixed query arguments, written with odd spacing and case on purpose.
SLICE_YEAR = 1997
SLICE_CUSTOMER = "  CUSTOMER#000000007 "
SLICE_PRODUCT = " Blue  Bolt "
MULTI_YEARS = [1996, 1998]
MULTI_CUSTOMERS = ["Customer#000000007", "Customer#000000042", "Customer#000000100"]

SALES_BASE_COLS = ["_row_id", "_date", "_year", "_month", "_revenue", "_customer", "_customer_norm"]
ITEM_BASE_COLS = ["_row_id"] + itl.ITEM_COLUMNS


def sales_frame(spark, d):
    return cl.sales_base(fx.sales(spark, d), "date", "revenue", "customer")


def items_frame(spark, d):
    return itl.load_items_lenient(fx.items(spark, d))


@query
def q_sales_slice(spark, d):
    return fc.slice_sales(sales_frame(spark, d), items_frame(spark, d), SLICE_YEAR, SLICE_CUSTOMER, None) \
        .select(*SALES_BASE_COLS)


@query
def q_item_slice(spark, d):
    return fc.slice_items(items_frame(spark, d), SLICE_YEAR, None, SLICE_PRODUCT).select(*ITEM_BASE_COLS)


@query
def q_product_scope(spark, d):
    return fc.slice_sales(sales_frame(spark, d), items_frame(spark, d), None, None, SLICE_PRODUCT) \
        .select(*SALES_BASE_COLS)


@query
def q_multi_slice(spark, d):
    return fc.multi_slice(fx.sales(spark, d), "date", "customer", MULTI_YEARS, MULTI_CUSTOMERS) \
        .filter(F.col("revenue").isNotNull()).select("_row_id", "date", "customer", "revenue")


@query
def q_facets(spark, d):
    return fc.facets(sales_frame(spark, d), items_frame(spark, d), SLICE_YEAR, None, SLICE_PRODUCT)


@query
def q_report_options(spark, d):
    return fc.report_options(fx.sales(spark, d), "date", "customer")


@query
def q_kpis(spark, d):
    s = fc.slice_sales(sales_frame(spark, d), items_frame(spark, d), SLICE_YEAR, SLICE_CUSTOMER, None)
    i = fc.slice_items(items_frame(spark, d), SLICE_YEAR, SLICE_CUSTOMER, None)
    return met.kpis(s, i)


# ------------------------------------------------------------ report export, forecast, payload

from ledgerlens.operators import forecast as fcst  # noqa: E402
from ledgerlens.operators import grains as gr  # noqa: E402
from ledgerlens.operators import report as rp  # noqa: E402
from ledgerlens.sources import export as ex  # noqa: E402
from ledgerlens.sources.sinks import write_csv_sorted  # noqa: E402


@query
def q_header_scores(spark, d):
    return ex.header_scores(fx.export_raw(spark, d)).select("row", F.round("score", 6).alias("score"))


@query
def q_header_recovery(spark, d):
    return ex.recover_header(fx.export_raw(spark, d))


@query
def q_forecast(spark, d):
    out = fcst.forecast_revenue(fx.items(spark, d, customer=False), "date", "total_value", ["category"], steps=6)
    return out.select(F.col("category").alias("key"), "month", "step", "forecast", "lower_95", "upper_95")


def _sales_grains(spark, d, **keys):
    """Sales totals by customer, by month and by other keys, in one scan."""
    return gr.grains(fx.sales(spark, d), "revenue", {"customer": F.col("customer"), "month": month_start("date"), **keys})


def _all_forecast(by_month):
    return fcst.forecast_revenue(by_month, "month", "revenue", steps=6).drop("_series", "phi", "theta")


@query
def q_payload(spark, d):
    """Every result of the report as one JSON document, read back as rows; one scan for the sales, the items, the tax lines and the export's profile."""
    sales = _sales_grains(spark, d, value=F.col("revenue").cast("double"))
    by_customer, by_month, counts = sales.total("customer"), sales.total("month"), sales.counts("value")
    items = gr.grains(fx.items(spark, d, customer=False), "total_value", {"category": F.col("category"), "item_name": F.col("item_name")},
                      {"date": F.col("date").cast("date")})
    by_category, by_item = items.total("category"), items.total("item_name", "item")
    cs = _cleaned(spark, d, impute=False)
    _, summary = ig.integrate_sales_and_master(cs, _master(spark, d))
    cleaned = cs.dataframe.columns
    roles = {"date": cs.date_column, "revenue": cs.revenue_column, "customer": cs.customer_column, "gstin": cs.gstin_column,
             "product": R.product_role(cleaned), "category": R.category_role(cleaned),
             "net_sales": R.net_sales_role(cleaned, cs.revenue_column)}
    total = F.col("s").cast("double")
    parts = {
        "cleaning": cs.stats,
        "integration": summary,
        "revenue_analysis": met.revenue_summary(counts, "v", counts),
        "distribution_analysis": dist.distribution(counts, "v", counts),
        "high_value": dist.high_value_share(counts, "v", counts=counts),
        "customer_concentration": par.top_share(by_customer, "customer", "revenue", written=True),
        "pareto": par.pareto_count(by_customer, "customer", "revenue", written=True),
        "item_totals": items.whole().select("rows", F.col("min_date").alias("start"), F.col("max_date").alias("end"), total.alias("total"),
                                            F.round(total / F.col("n"), 6).alias("mean")),
        "top3_items": met.top_share_n(by_item, "item", "revenue", 3, "top3_pct", written=True),
        "unique_customers": met.unique_customers(by_customer, "customer"),
        "tax_analysis": met.gross_vs_net(fx.invoice_tax(spark, d, order=False, customer=False), "gross", "net"),
    }
    lists = {
        "top_10_customers": (par.top_n(by_customer, "customer", "revenue", 10, written=True), ("-revenue", "customer")),
        "monthly_revenue": (ts.monthly_revenue(by_month, "month"), ("month",)),
        "moving_average": (ts.moving_average(by_month, "month"), ("month",)),
        "month_of_year_revenue": (ts.seasonality(by_month, "month"), ("month_no",)),
        "year_wise_revenue": (ts.revenue_by_year(by_month, "month"), ("year",)),
        "yearly_growth_pct": (ts.yoy_growth(by_month, "month"), ("year",)),
        "peak_and_weakest": (ts.peak_month(by_month, "month"), ("kind",)),
        "category_mix": (met.share_by(by_category, "category", "revenue", "category", written=True), ("-revenue", "category")),
        "top_items": (par.top_n(by_item, "item", "revenue", 10, written=True), ("-revenue", "item")),
        "forecast": (_all_forecast(by_month), ("step",)),
    }
    return rp.payload_rows(rp.payload(spark, parts, lists, roles))


@query
def q_insights(spark, d):
    sales = _sales_grains(spark, d)
    by_month = sales.total("month")
    by_category = gr.grains(fx.items(spark, d, customer=False), "total_value", {"category": F.col("category")}).total("category")
    return rp.insights(spark, par.top_n(sales.total("customer"), "customer", "revenue", 10, written=True),
                       met.share_by(by_category, "category", "revenue", "category", written=True),
                       _all_forecast(by_month), ts.peak_month(by_month, "month"))


# ------------------------------------------------------------ further operators over the same views

from ledgerlens.functions.numbers import strict_number  # noqa: E402
from ledgerlens.session import scratch_path  # noqa: E402


@query
def q_strict_number(spark, d):
    return fx.sales_raw(spark, d).select(F.col("_row_id").alias("key"), strict_number("Gross Total").alias("result"))


@query
def q_top_15_customers(spark, d):
    return par.top_n(fx.sales(spark, d), "customer", "revenue", 15, with_pct=False)


@query
def q_roles_by_name(spark, d):
    """The columns that R5-R12 choose in the raw export, with their filled cells."""
    df = cl.prepare(fx.sales_raw(spark, d))
    cols = df.columns
    revenue = R.revenue_role(cols)
    chosen = [("date", R.date_role(cols)), ("revenue", revenue), ("customer", R.customer_role(cols)), ("product", R.product_role(cols)),
              ("gstin", R.gstin_role(cols)), ("category", R.category_role(cols)), ("net_sales", R.net_sales_role(cols, revenue))]
    chosen += [("tax_amount", c) for c in R.tax_amount_columns(cols)]
    wide = df.agg(*[F.count(c if c else F.lit(None)).alias(f"n{i}") for i, (_, c) in enumerate(chosen)])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.lit(c).cast("string").alias("column"), F.col(f"n{i}").alias("filled"))
                                           for i, (r, c) in enumerate(chosen)])).alias("r")).select("r.*")


@query
def q_items_load_stats(spark, d):
    t = fx.items_text(spark, d)
    return itl.load_items_stats(t.withColumn("Date", F.when(F.col("_row_id") % 9 == 0, F.lit("soon")).otherwise(F.col("Date")))
                                .withColumn("Total Value", F.when(F.col("_row_id") % 11 != 0, F.col("Total Value"))))


@query
def q_enrich_empty_catalog(spark, d):
    e = ct.enrich(fx.items(spark, d), fx.catalog(spark, d).filter(F.lit(False)))
    return e.groupBy("_product", "_category").agg(F.count(F.lit(1)).alias("rows"))


@query
def q_integrate_skipped(spark, d):
    cs = _cleaned(spark, d, impute=False)
    return ig.integrate_sales_and_master(cs, fx.catalog(spark, d))[1]


@query
def q_integrate_short(spark, d):
    return ig.short_summary(_integrated(spark, d, impute=False)[1])


@query
def q_merged_roles(spark, d):
    """Roles found again on the merged frame, with their filled cells."""
    merged = _integrated(spark, d, impute=False)[0]
    chosen = [("customer", R.customer_role(merged.columns)), ("date", R.date_role(merged.columns)), ("revenue", R.revenue_role(merged.columns))]
    wide = merged.agg(*[F.count(c).alias(f"n{i}") for i, (_, c) in enumerate(chosen)])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.lit(c).alias("column"), F.col(f"n{i}").alias("filled"))
                                           for i, (r, c) in enumerate(chosen)])).alias("r")).select("r.*")


def _export_report(spark, d):
    """The report files of `fixtures.export_files`, written as text and read back by S3."""
    path = scratch_path(spark, f"export-{uuid.uuid4().hex}")
    lines = fx.export_files(spark, d)
    lines.write.partitionBy("file").text(path)
    years = [r[0] for r in fx.sales(spark, d, customer=False).select(F.year("date")).distinct().orderBy(F.year("date")).collect()]
    return ex.read_report_files(spark, [f"{path}/file={y}" for y in years])


@query
def q_export_wide(spark, d):
    """S3 on files: an export a year with title lines, a header, quoted breaks, inch marks and some records of 300 cells."""
    return _export_report(spark, d).select("date", "particulars", "voucher_no", "gross_total", "size", "remarks", F.col("unnamed_299").alias("last_cell"))


@query
def q_export_first(spark, d):
    """J5 over several files: the first record of each customer in the order of the files and their lines."""
    return ig.dedupe_first(_export_report(spark, d), "particulars").select("particulars", "date", "voucher_no")


@query
def q_facet_order(spark, d):
    """The facet lists in display order."""
    return fc.facet_places(fc.facets(sales_frame(spark, d), items_frame(spark, d), SLICE_YEAR, None, SLICE_PRODUCT))


@query
def q_csv_sorted(spark, d):
    """The sales written as CSV in date order and read back: rows per day, and whether all lie after those of earlier days."""
    path = scratch_path(spark, f"csv-{uuid.uuid4().hex}")
    write_csv_sorted(fx.sales(spark, d, customer=False), path)
    rows = ex.read_headless(spark, path).where(F.col("_c0") != "_row_id")      # every part file has its header
    days = rows.groupBy(F.substring("_c1", 1, 10).alias("day")).agg(F.count(F.lit(1)).alias("rows"), F.min("_row_id").alias("first"), F.max("_row_id").alias("last"))
    earlier = F.max("last").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1))      # a row for each day
    return days.select("day", "rows", (F.coalesce(earlier, F.lit(-1)) < F.col("first")).alias("in_order"))


@query
def q_guards(spark, d):
    """Which inputs the loaders refuse; each is the whole table with one fault."""
    items = fx.items_text(spark, d)
    raw = fx.sales_raw(spark, d)
    cases = {
        "items": lambda: itl.load_items(items, check_empty=True),
        "items without a category": lambda: itl.load_items(items.drop("Category")),
        "items without a date": lambda: itl.load_items(items.withColumn("Date", F.lit("soon")), check_empty=True),
        "no items": lambda: itl.load_items(items.where("false"), check_empty=True),
        "export": lambda: cl.clean_sales(raw, impute=False),
        "export without dates": lambda: cl.clean_sales(raw.drop("Date"), impute=False),
        "export without amounts": lambda: cl.clean_sales(raw.withColumn("Gross Total", F.lit("n/a")), impute=False),
        "frames without a shared key": lambda: ig.integrate_sales_and_master(cl.clean_sales(raw, impute=False), fx.catalog(spark, d), on_missing="error"),
    }

    def refused(run) -> bool:
        try:
            run()
        except ValueError:
            return True
        return False

    return spark.createDataFrame([(case, refused(run)) for case, run in cases.items()], "input string, refused boolean")
