"""Integration of sales with a master sheet."""

from __future__ import annotations

from typing import Optional

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.text import text_key
from ledgerlens.operators import roles as R

KEY = "_join_key"
ORDER = "_row_id"


def choose_join_keys(left_cols, right_cols, left_gstin: Optional[str] = None,
                     left_customer: Optional[str] = None) -> Optional[tuple[str, str, str]]:
    """Tax id on both sides, else customer on both sides, else None."""
    lg = left_gstin or R.gstin_role(left_cols)
    rg = R.gstin_role(right_cols)
    if lg and rg:
        return lg, rg, "gstin"
    lc = left_customer or R.customer_role(left_cols)
    rc = R.customer_role(right_cols)
    if lc and rc:
        return lc, rc, "customer"
    return None


def dedupe_first(df: DataFrame, key_col: str, order_col: str = ORDER) -> DataFrame:
    """Drop null keys, keep the first row per key by ``order_col`` (unique).

    The smallest order value of each key is a hash aggregate of two columns
    with a map-side part, so a key holding a third of all rows costs one row
    per task before the shuffle; a semi-join then picks these rows whole.
    """
    rows = df.filter(F.col(key_col).isNotNull())
    first = rows.groupBy(key_col).agg(F.min(order_col).alias(order_col))
    others = [c for c in df.columns if c != key_col]
    return rows.join(first, [key_col, order_col], "left_semi").select(key_col, *[F.col(f"`{c}`") for c in others])


def integrate(sales: DataFrame, master: DataFrame, sales_key: str, master_key: str,
              keep_key: bool = False) -> DataFrame:
    """Left join on the normalised key; clashing master columns get `_master`;
    `_merge_status` is matched / missing_in_master; null keys never match.

    The master side is de-duplicated first (J5), so the join never multiplies
    sales rows.  Catalyst/AQE pick broadcast or sort-merge from the measured
    size of the de-duplicated master, and AQE splits a skewed sales key.
    """
    left = sales.withColumn(KEY, text_key(sales_key))
    right = dedupe_first(master.withColumn(KEY, text_key(master_key)), KEY)
    rename = {c: (f"{c}_master" if c in left.columns else c) for c in right.columns if c != KEY}
    right = right.select(F.col(KEY), *[F.col(f"`{c}`").alias(n) for c, n in rename.items()],
                         F.lit(True).alias("_in_master"))
    j = left.join(right, KEY, "left")
    status = F.when(F.col("_in_master").isNull(), F.lit("missing_in_master")).otherwise(F.lit("matched"))
    cols = [c for c in left.columns if c != KEY] + list(rename.values())
    out = j.select(*[F.col(f"`{c}`") for c in cols], status.alias("_merge_status"),
                   *([F.col(KEY).alias("join_key")] if keep_key else []))
    return out


def integration_summary(sales: DataFrame, master: DataFrame, merged: DataFrame, sales_key: str,
                        master_key: str, strategy: str) -> DataFrame:
    """One-row match report (rates are 0 on empty input).

    Two aggregates: one over the merged rows (which are exactly the sales
    rows, the master side being de-duplicated) and one over the master sheet,
    the latter as a struct scalar subquery.  "Duplicates removed" is master
    rows minus distinct non-null keys, so it includes null-key rows.
    """
    m = master.agg(F.struct(F.count(F.lit(1)).alias("rows"),
                            F.count_distinct(text_key(master_key)).alias("keys")).alias("m")).scalar()
    a = merged.agg(F.count(F.lit(1)).alias("total_rows"),
                   F.count_if(F.col("_merge_status") == "matched").alias("matched_rows"),
                   F.count_if(text_key(sales_key).isNull()).alias("missing_keys"))
    total = F.col("total_rows")
    return a.select(
        F.lit(strategy).alias("join_key_used"), F.lit(sales_key).alias("join_key_daybook"),
        F.lit(master_key).alias("join_key_master"), "total_rows", "matched_rows",
        (total - F.col("matched_rows")).alias("unmatched_rows"),
        F.when(total == 0, F.lit(0.0)).otherwise(F.round(F.col("matched_rows") / total * 100.0, 6)).alias("match_rate_pct"),
        F.when(total == 0, F.lit(0.0)).otherwise(F.round((total - F.col("matched_rows")) / total * 100.0, 6)).alias("unmatched_rate_pct"),
        (m.rows - m["keys"]).alias("master_duplicate_rows_removed"),
        F.col("missing_keys").alias("daybook_rows_missing_join_key"))


def skipped_summary(sales: DataFrame, master: DataFrame) -> DataFrame:
    """J7 when J4 finds no shared key: why, and both sides' columns; the join fields are null."""
    return sales.agg(F.count(F.lit(1)).alias("total_rows")).select(
        F.lit("skipped").alias("integration_status"),
        F.lit("no tax id or customer column in both frames").alias("reason"),
        F.lit(None).cast("string").alias("join_key_used"), F.lit(None).cast("string").alias("join_key_daybook"),
        F.lit(None).cast("string").alias("join_key_master"), "total_rows",
        F.lit(0).cast("long").alias("matched_rows"), F.col("total_rows").alias("unmatched_rows"),
        F.lit(0.0).alias("match_rate_pct"), F.when(F.col("total_rows") > 0, 100.0).otherwise(0.0).alias("unmatched_rate_pct"),
        F.lit(0).cast("long").alias("master_duplicate_rows_removed"),
        F.lit(0).cast("long").alias("daybook_rows_missing_join_key"),
        master.agg(F.count(F.lit(1))).scalar().alias("reference_rows"),
        F.lit(", ".join(c for c in master.columns if c != ORDER)).alias("reference_columns"))


def short_summary(summary: DataFrame) -> DataFrame:
    """The compatible record: rows, matches, their rate and the duplicates taken out of the master sheet."""
    return summary.select("join_key_used", "total_rows", "matched_rows", "unmatched_rows",
                          F.col("match_rate_pct").alias("match_rate"),
                          F.col("master_duplicate_rows_removed").alias("master_duplicates_removed"))


def integrate_sales_and_master(cleaned, master: DataFrame, on_missing: str = "skip",
                               keep_key: bool = False) -> tuple[DataFrame, DataFrame]:
    """J6 + J7 for a `CleanedSales` and a cleaned master frame.

    ``on_missing='skip'`` returns the unmerged sales with a skipped record;
    ``'error'`` raises (the compatible variant, J7b).
    """
    df = cleaned.dataframe
    keys = choose_join_keys(df.columns, master.columns, cleaned.gstin_column, cleaned.customer_column)
    if keys is None:
        if on_missing == "error":
            raise ValueError("The two frames share neither a tax id nor a customer column to join on.")
        return df, skipped_summary(df, master)
    sk, mk, strategy = keys
    merged = integrate(df, master, sk, mk, keep_key=keep_key)
    return merged, integration_summary(df, master, merged, sk, mk, strategy)
