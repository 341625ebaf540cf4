"""Revenue, customer, tax, item and KPI aggregates."""

from __future__ import annotations

from typing import Optional

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, NumericType

from ledgerlens.functions.dates import month_label, month_start
from ledgerlens.functions.numbers import money, money_sum, strict_number
from ledgerlens.functions.text import trim_text
from ledgerlens.operators.quantiles import moments, quantiles, value_counts
from ledgerlens.operators.roles import tax_amount_columns
from ledgerlens.session import materialize


def revenue_summary(df: DataFrame, value_col: str = "revenue", counts: Optional[DataFrame] = None) -> DataFrame:
    """A1: total, mean, median (interpolated), sample standard deviation; NaN counts as missing.

    All from the counts per distinct value (`quantiles.value_counts`, also given
    by ``counts`` where several results share them): one scan, and every sum is
    the same however rows are partitioned.
    """
    counts = value_counts(df, [value_col]) if counts is None else counts
    med = quantiles(counts, [0.5])
    return moments(counts).select(
        F.col("total").cast("double").alias("total"),
        F.round(F.col("total").cast("double") / F.col("n"), 6).alias("mean"),
        F.round(med.q0, 6).alias("median"),
        F.round("std", 6).alias("std"))


def unique_customers(df: DataFrame, customer_col: str, approx: bool = False) -> DataFrame:
    """A2: distinct trimmed, non-empty, non-null names (case-sensitive)."""
    c = F.nullif(trim_text(customer_col), F.lit(""))
    agg = F.approx_count_distinct(c) if approx else F.count_distinct(c)
    return df.agg(agg.cast("long").alias("unique_customers"))


def gross_vs_net(df: DataFrame, gross_col: str, net_col: str) -> DataFrame:
    """Over rows with net present, net total, gross-net total and its % of gross."""
    rows = df.filter(F.col(net_col).isNotNull())
    g = F.sum(money(gross_col) if not _is_decimal(df, gross_col) else F.col(gross_col))
    n = F.sum(money(net_col) if not _is_decimal(df, net_col) else F.col(net_col))
    a = rows.agg(g.alias("g"), n.alias("n"))
    return a.select(
        F.col("n").cast("double").alias("net_total"),
        (F.col("g") - F.col("n")).cast("double").alias("tax_total"),
        F.when(F.col("g") == 0, F.lit(None).cast("double"))
        .otherwise(F.round((F.col("g") - F.col("n")).cast("double") / F.col("g").cast("double") * 100.0, 6)).alias("tax_pct"))


def gross_net_by_year(df: DataFrame, date_col: str, gross_col: str, net_col: str) -> DataFrame:
    """Gross and net totals per year over rows with net present."""
    rows = df.filter(F.col(net_col).isNotNull())
    return rows.groupBy(F.year(date_col).alias("year")).agg(
        F.sum(_exact(df, gross_col)).cast("double").alias("gross"),
        F.sum(_exact(df, net_col)).cast("double").alias("net"))


def _is_decimal(df: DataFrame, col: str) -> bool:
    return isinstance(df.schema[col].dataType, DecimalType)


def _exact(df: DataFrame, col: str):
    return F.col(col) if _is_decimal(df, col) else money(col)


def tax_breakdown(df: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Total per tax-amount column (R12), numerically coerced, > 0 only.

    One wide aggregate, then unpivot; `pos` keeps the column order for the
    dashboard (the report sorts by value instead).
    """
    cols = tax_amount_columns(df.columns, exclude)
    if not cols:
        return df.sparkSession.createDataFrame([], "name string, value double, pos int")
    exprs = []
    for i, c in enumerate(cols):
        t = df.schema[c].dataType
        if isinstance(t, DecimalType):
            e = F.sum(F.col(c)).cast("double")
        else:
            e = money_sum(F.col(c) if isinstance(t, NumericType) else strict_number(c))
        exprs.append(F.coalesce(e, F.lit(0.0)).alias(f"t{i}"))
    wide = df.agg(*exprs)
    long = wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(f"t{i}").alias("value"), F.lit(i).alias("pos"))
        for i, c in enumerate(cols)])).alias("r")).select("r.*")
    return long.filter(F.col("value") > 0)


def item_totals(items: DataFrame, date_col: str = "date", value_col: str = "total_value") -> DataFrame:
    """Rows, first and last date, total and mean line value."""
    return items.agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(date_col).cast("date").alias("start"),
        F.max(date_col).cast("date").alias("end"),
        money_sum(value_col).alias("total"),
        F.round(F.sum(money(value_col)).cast("double") / F.count(value_col), 6).alias("mean"),
    )


def item_monthly(items: DataFrame, date_col: str = "date", value_col: str = "total_value") -> DataFrame:
    """Item value per observed month."""
    return (items.groupBy(month_start(date_col).alias("m"))
            .agg(money_sum(value_col).alias("value"))
            .select(month_label("m").alias("month"), "value"))


def share_by(df: DataFrame, key_col: str, value_col: str, out_key: str, out_value: str = "revenue", written: bool = False) -> DataFrame:
    """Total per key with its % of the grand total (all keys); ``written``: ``df`` already holds the totals."""
    agg = df.select(key_col, F.col(value_col).alias("v")) if written else materialize(df.groupBy(key_col).agg(F.sum(money(value_col)).alias("v")))
    total = agg.agg(F.sum("v").cast("double")).scalar()
    return agg.select(F.col(key_col).alias(out_key), F.col("v").cast("double").alias(out_value),
                      F.when(F.coalesce(total, F.lit(0.0)) == 0, F.lit(0.0))
                      .otherwise(F.round(F.col("v").cast("double") / total * 100.0, 6)).alias("pct"))


def totals_by(df: DataFrame, key_col: str, value_col: str, out_key: str, out_value: str) -> DataFrame:
    """Plain total per key (dashboard category sales, enriched category revenue)."""
    return df.groupBy(key_col).agg(money_sum(value_col).alias(out_value)).select(
        F.col(key_col).alias(out_key), out_value)


def top_share_n(df: DataFrame, key_col: str, value_col: str, n: int, out: str, written: bool = False) -> DataFrame:
    """Share (%) of the grand total held by the best n keys; ``written``: ``df`` already holds the totals."""
    agg = df.select(key_col, F.col(value_col).alias("v")) if written else materialize(df.groupBy(key_col).agg(F.sum(money(value_col)).alias("v")))
    total = agg.agg(F.sum("v").cast("double")).scalar()
    top = agg.orderBy(F.col("v").desc(), F.col(key_col).asc_nulls_first()).limit(n)
    s = F.coalesce(F.sum("v").cast("double"), F.lit(0.0))
    return top.agg(F.when(F.coalesce(total, F.lit(0.0)) == 0, F.lit(0.0))
                   .otherwise(F.round(s / total * 100.0, 6)).alias(out))


def customer_weights(df: DataFrame, customer_col: str) -> DataFrame:
    """Count per trimmed non-empty name, and that count over all such rows."""
    names = df.select(F.nullif(trim_text(customer_col), F.lit("")).alias("customer")).filter(F.col("customer").isNotNull())
    counts = names.groupBy("customer").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.select("customer", "n", (F.col("n").cast("double") / total.cast("double")).alias("weight"))


def kpis(sales: DataFrame, items: Optional[DataFrame], revenue_col: str = "_revenue",
         item_value_col: str = "total_value") -> DataFrame:
    """Total revenue, transactions, revenue per transaction (0 if none), item value.

    The item total is a scalar subquery, so both aggregates stay single-row
    without a join.
    """
    item_value = (items.agg(F.coalesce(money_sum(item_value_col), F.lit(0.0))).scalar()
                  if items is not None else F.lit(0.0))
    a = sales.agg(F.coalesce(money_sum(revenue_col), F.lit(0.0)).alias("total_revenue"),
                  F.count(F.lit(1)).alias("total_transactions"))
    return a.select(
        "total_revenue", "total_transactions",
        F.when(F.col("total_transactions") == 0, F.lit(0.0))
        .otherwise(F.round(F.col("total_revenue") / F.col("total_transactions"), 6)).alias("avg_value"),
        item_value.alias("item_value"))
