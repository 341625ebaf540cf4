"""Dashboard slices, product scope and cascading facets.

Filters are plain predicates (pushed to the scan where they touch stored
columns); the product scope is a left-semi join against the distinct
customers found in the item lines, so no key set is ever collected.
"""

from __future__ import annotations

from typing import Optional, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.text import literal_text_key, trim_text
from ledgerlens.session import materialize


def _active(value: Optional[str]) -> Optional[str]:
    """The normalised argument, or None when blank or 'all' (D3)."""
    if value is None:
        return None
    norm = literal_text_key(value)
    return norm if norm and norm != "all" else None


def year_range(df: DataFrame, date_col: str, years: Sequence[int]):
    """`year(date) in years` as date ranges on the raw column.

    `year()` cannot reach a Parquet scan; a range on the stored column can,
    so row groups outside the years are skipped.  The literal takes the
    column's own type so no cast wraps the column.
    """
    t = df.schema[date_col].dataType.simpleString()
    cond = None
    for y in sorted({int(v) for v in years}):
        r = (F.col(date_col) >= F.lit(f"{y:04d}-01-01").cast(t)) & (F.col(date_col) < F.lit(f"{y + 1:04d}-01-01").cast(t))
        cond = r if cond is None else (cond | r)
    return cond


def _sliced(df: DataFrame, year: Optional[int], customer: Optional[str], product: Optional[str], date_col: str) -> DataFrame:
    out = df if year is None else df.filter(year_range(df, date_col, [year]))
    return out.filter(_fits(customer, product, year))


def slice_items(items: DataFrame, year: Optional[int] = None, customer: Optional[str] = None,
                product: Optional[str] = None, date_col: str = "date") -> DataFrame:
    """year =, customer = and product = on normalised text."""
    return _sliced(items, year, customer, product, date_col)


def product_scope(items: DataFrame, year: Optional[int] = None, customer: Optional[str] = None,
                  product: Optional[str] = None) -> Optional[DataFrame]:
    """Customers (normalised) who bought the product under the same year and
    customer filter; None when no product is chosen."""
    if not _active(product):
        return None
    return slice_items(items, year, customer, product).select("_customer_norm")


def slice_sales(sales: DataFrame, items: Optional[DataFrame], year: Optional[int] = None,
                customer: Optional[str] = None, product: Optional[str] = None,
                date_col: str = "_date") -> DataFrame:
    """year =, customer = on normalised text, and the product scope as a semi-join."""
    out = _sliced(sales, year, customer, None, date_col)
    if items is not None:
        scope = product_scope(items, year, customer, product)
        if scope is not None:
            out = out.join(scope.distinct(), "_customer_norm", "left_semi")
    return out


def multi_slice(df: DataFrame, date_col: str, customer_col: Optional[str], years: Sequence[int] = (),
                customers: Sequence[str] = ()) -> DataFrame:
    """year in a list and raw customer in a list; empty list = no filter;
    rows without a date are dropped.  Values are compared as text."""
    out = df.filter(F.col(date_col).isNotNull())
    if years:
        out = out.filter(year_range(df, date_col, years) & F.year(date_col).isin([int(y) for y in years]))
    if customer_col and customers:
        out = out.filter(F.col(customer_col).cast("string").isin([str(v) for v in customers]))
    return out


def _distinct_text(df: DataFrame, col: str) -> DataFrame:
    """Trimmed, non-blank, distinct (case-sensitive)."""
    v = trim_text(F.col(col).cast("string"))
    return df.select(v.alias("value")).filter(F.col("value").isNotNull() & (F.col("value") != "")).distinct()


def _fits(customer: Optional[str] = None, product: Optional[str] = None, year: Optional[int] = None):
    """A condition on the derived columns; null arguments don't filter."""
    cond = F.lit(True)
    if _active(customer):
        cond = cond & (F.col("_customer_norm") == _active(customer))
    if _active(product):
        cond = cond & (F.col("_product_norm") == _active(product))
    if year is not None:
        cond = cond & (F.col("_year") == int(year))
    return cond


def facets(sales: DataFrame, items: DataFrame, year: Optional[int] = None, customer: Optional[str] = None,
           product: Optional[str] = None) -> DataFrame:
    """(facet, value) rows; each list ignores its own filter and obeys the others.

    Years come from sales and items (U1); order is a presentation concern
    (`sort_facets`), rows here are unordered.  The items are read once: each row
    gives the values of the lists that it is in, and of the two product scopes
    (J8); the sales once, as their distinct years and customers.  Both are the
    size of dimensions and written, as several lists read them.
    """
    name = F.nullif(trim_text(F.col("_product").cast("string")), F.lit(""))
    # each row's texts are normalised once (`inline` keeps them from being put into every condition)
    rows = items.select(F.inline(F.array(F.struct("_year", "_customer_norm", "_product_norm", name.alias("name")))))
    tags = [("year", _fits(customer, product), F.col("_year").cast("string")), ("product", _fits(customer, None, year), F.col("name"))]
    if _active(product):
        tags += [("scope", _fits(customer, product), F.col("_customer_norm")),
                 ("year_scope", _fits(None, product, year), F.col("_customer_norm"))]
    tagged = materialize(
        rows.select(F.explode(F.array(*[F.struct(F.lit(t).alias("facet"), F.when(cond, v).alias("value")) for t, cond, v in tags])).alias("t"))
        .select("t.*").filter(F.col("value").isNotNull()).distinct())
    sold = materialize(sales.select("_year", "_customer", "_customer_norm").distinct())

    def scoped(rows: DataFrame, scope: str) -> DataFrame:
        if not _active(product):
            return rows
        return rows.join(tagged.filter(F.col("facet") == scope).select(F.col("value").alias("_customer_norm")), "_customer_norm", "left_semi")

    ys = scoped(sold.filter(_fits(customer)), "scope").filter(F.col("_year").isNotNull()).select(
        F.lit("year").alias("facet"), F.col("_year").cast("string").alias("value"))
    years = ys.unionByName(tagged.filter(F.col("facet") == "year")).distinct()
    custs = _distinct_text(scoped(sold.filter(_fits(None, None, year)), "year_scope"), "_customer") \
        .select(F.lit("customer").alias("facet"), "value")
    return years.unionByName(custs).unionByName(tagged.filter(F.col("facet") == "product"))


def _display_order():
    return [F.col("value").try_cast("int"), F.lower("value"), F.col("value")]


def sort_facets(f: DataFrame) -> DataFrame:
    """U2 order for display: years numerically, text ignoring case (D8: `lower`)."""
    return f.orderBy("facet", *_display_order())


def facet_places(f: DataFrame) -> DataFrame:
    """Each value's place in its list (from 1); the lists are the size of dimensions."""
    return f.withColumn("place", F.row_number().over(Window.partitionBy("facet").orderBy(*_display_order())))


def report_options(df: DataFrame, date_col: str, customer_col: Optional[str]) -> DataFrame:
    """Distinct years with a date; distinct non-blank raw customers."""
    d = df.filter(F.col(date_col).isNotNull())
    years = d.select(F.year(date_col).alias("y")).distinct() \
        .select(F.lit("year").alias("facet"), F.col("y").cast("string").alias("value"))
    if not customer_col:
        return years
    raw = F.col(customer_col).cast("string")
    custs = d.select(raw.alias("value")).filter(raw.isNotNull() & (trim_text(raw) != "")).distinct() \
        .select(F.lit("customer").alias("facet"), "value")
    return years.unionByName(custs)
