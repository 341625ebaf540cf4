"""Catalog build, enrichment and product rankings."""

from __future__ import annotations

from typing import Optional

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ledgerlens.functions.numbers import money, strict_number
from ledgerlens.functions.text import product_key, trim_text
from ledgerlens.operators import roles as R
from ledgerlens.operators.integrate import dedupe_first
from ledgerlens.session import materialize

UNKNOWN_PRODUCT = "Unknown Product"
UNCATEGORIZED = "Uncategorized"


def _catalog_rows(catalog: DataFrame, order_col: str = "_row_id") -> Optional[DataFrame]:
    """(order, key, product, category) of every catalog row; None where no column can be the product's."""
    prod = R.product_role(catalog.columns)
    if not prod:
        texts = R.text_columns(catalog)
        prod = texts[0] if texts else None
    if not prod:
        return None
    cat = R.category_role(catalog.columns)
    category = F.coalesce(trim_text(cat), F.lit(UNCATEGORIZED)) if cat else F.lit(UNCATEGORIZED)
    return catalog.select(F.col(order_col), product_key(prod).alias("key"),
                          trim_text(prod).alias("product"), category.alias("category"))


def build_catalog(catalog: DataFrame, order_col: str = "_row_id") -> DataFrame:
    """(key, product, category), first row per normalised product key.

    The product column is R8 (else the first text column); the category is
    R10, null or absent -> 'Uncategorized'.
    """
    rows = _catalog_rows(catalog, order_col)
    if rows is None:
        return catalog.sparkSession.createDataFrame([], "key string, product string, category string")
    return dedupe_first(rows, "key", order_col).select("key", "product", "category")


def enrich(txn: DataFrame, catalog: DataFrame, product_col: Optional[str] = None) -> DataFrame:
    """Add `_product` and `_category` to transactions from the catalog.

    The transaction product column is found by catalog overlap (R14, one job)
    unless given; with an empty catalog, by its name (R8).  The catalog side is
    de-duplicated, so the left join keeps the transaction row count, and it is
    the join's small side: Spark broadcasts it below its size threshold.
    """
    cat, rows = build_catalog(catalog), _catalog_rows(catalog)
    # the overlap counts distinct keys: it need not know which row of a key is the first
    keys = cat.select("key") if rows is None else rows.select("key").filter(F.col("key").isNotNull())
    col = product_col or R.product_role_by_catalog(txn, keys)
    if not col:
        return txn.withColumn("_product", F.lit(UNKNOWN_PRODUCT)).withColumn("_category", F.lit(UNCATEGORIZED))
    own = F.coalesce(trim_text(col), F.lit(UNKNOWN_PRODUCT))
    cat = cat.select(F.col("key").alias("_pk"), F.col("product").alias("_cat_product"), F.col("category").alias("_cat_category"))
    # the key in a projection of its own: as a join condition it would be computed twice a row
    j = txn.select("*", product_key(F.col(f"`{col}`")).alias("_own_pk")).join(cat, F.col("_own_pk") == F.col("_pk"), "left")
    # both sides are trimmed already
    p = F.coalesce(F.col("_cat_product"), own)
    c = F.coalesce(F.col("_cat_category"), F.lit(UNCATEGORIZED))
    return j.select(*[F.col(f"`{x}`") for x in txn.columns],
                    F.when(p == "", F.lit(UNKNOWN_PRODUCT)).otherwise(p).alias("_product"),
                    F.when(c == "", F.lit(UNCATEGORIZED)).otherwise(c).alias("_category"))


def product_ranking(df: DataFrame, n: int = 10, key: str = "_product", value: str = "_revenue") -> DataFrame:
    """Top n products by revenue (ties: name ascending)."""
    agg = df.groupBy(key).agg(F.sum(money(value)).alias("v"))
    return (agg.orderBy(F.col("v").desc(), F.col(key).asc_nulls_first()).limit(n)
            .select(F.col(key).alias("product"), F.col("v").cast("double").alias("revenue")))


def category_revenue(df: DataFrame, key: str = "_category", value: str = "_revenue") -> DataFrame:
    """Revenue per enriched category."""
    return df.groupBy(key).agg(F.sum(money(value)).cast("double").alias("revenue")) \
        .select(F.col(key).alias("category"), "revenue")


def product_contribution(df: DataFrame, n: int = 10, key: str = "_product", value: str = "_revenue") -> DataFrame:
    """Top n products with % of *all* revenue, rounded to 2 places."""
    # the total comes from the per-product sums: one pass over the rows
    agg = materialize(df.groupBy(key).agg(F.sum(money(value)).alias("v")))
    total = agg.agg(F.sum("v").cast("double")).scalar()
    top = (agg.orderBy(F.col("v").desc(), F.col(key).asc_nulls_first()).limit(n)
           .select(F.col(key).alias("product"), F.col("v").cast("double").alias("revenue")))
    return top.select("product", "revenue",
                      F.when(F.coalesce(total, F.lit(0.0)) == 0, F.lit(0.0))
                      .otherwise(F.round(F.col("revenue") / total * 100.0, 2)).alias("contribution_pct"))


def _catalog_value(catalog: DataFrame, value_col: str):
    t = catalog.schema[value_col].dataType
    v = F.col(value_col).cast("double") if isinstance(t, NumericType) else strict_number(value_col)
    return F.coalesce(v, F.lit(0.0))


def catalog_top(catalog: DataFrame, n: int = 10, value_col: Optional[str] = None) -> DataFrame:
    """Top n catalog products by the R15 value column (nulls count 0)."""
    prod = R.product_role(catalog.columns)
    value_col = value_col or R.catalog_value_role(catalog)
    if not prod or not value_col:
        return catalog.sparkSession.createDataFrame([], "product string, revenue double, source string, metric string")
    rows = catalog.select(trim_text(prod).alias("product"), money(_catalog_value(catalog, value_col)).alias("v"))
    agg = rows.filter(F.col("product").isNotNull()).groupBy("product").agg(F.sum("v").alias("v"))
    return (agg.orderBy(F.col("v").desc(), F.col("product").asc()).limit(n)
            .select("product", F.col("v").cast("double").alias("revenue"),
                    F.lit("catalog").alias("source"), F.lit(value_col).alias("metric")))


def catalog_by_category(catalog: DataFrame, value_col: Optional[str] = None) -> DataFrame:
    """Catalog value per category ('Uncategorized' for null)."""
    cat = R.category_role(catalog.columns)
    value_col = value_col or R.catalog_value_role(catalog)
    if not cat or not value_col or not R.product_role(catalog.columns):
        return catalog.sparkSession.createDataFrame([], "category string, revenue double, source string, metric string")
    rows = catalog.select(F.coalesce(trim_text(cat), F.lit(UNCATEGORIZED)).alias("category"),
                          money(_catalog_value(catalog, value_col)).alias("v"))
    return rows.groupBy("category").agg(F.sum("v").cast("double").alias("revenue")).select(
        "category", "revenue", F.lit("catalog").alias("source"), F.lit(value_col).alias("metric"))


def catalog_contribution(catalog: DataFrame, n: int = 10, value_col: Optional[str] = None) -> DataFrame:
    """Top n catalog products with % of the *top-n subtotal* (2 places)."""
    top = catalog_top(catalog, n, value_col)
    sub = top.agg(F.sum(money("revenue")).cast("double")).scalar()
    return top.select("product", "revenue",
                      F.when(F.coalesce(sub, F.lit(0.0)) == 0, F.lit(0.0))
                      .otherwise(F.round(F.col("revenue") / sub * 100.0, 2)).alias("contribution_pct"),
                      "source", "metric")
