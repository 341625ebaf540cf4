"""Cleaning: names, trimming, numeric promotion, imputation, composites.

Only the profiling steps touch data before the plan is fixed: the numeric
promotion decision (C4) needs one aggregate over all text columns, because a
plan's schema must be known up front.  Everything after it is one lazy plan.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from fractions import Fraction
from typing import Optional

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from ledgerlens.functions.dates import FORMS, add_time_features, date_form, month_label, parse_dayfirst, parse_of_form
from ledgerlens.functions.numbers import lenient_number, strict_number
from ledgerlens.functions.text import canonical_names, text_key, trim_text
from ledgerlens.operators import roles as R
from ledgerlens.operators.quantiles import medians
from ledgerlens.session import ensure_checkpoint_dir

UNKNOWN_CUSTOMER = "Unknown Customer"
UNKNOWN_TEXT = "Unknown"
PROMOTE_THRESHOLD = 0.80


@dataclass
class CleanedSales:
    """C14 result: the cleaned frame, detected roles and the cleaning report."""
    dataframe: DataFrame
    date_column: str
    revenue_column: str
    customer_column: Optional[str]
    gstin_column: Optional[str]
    stats: DataFrame                      # one row: dropped, filled, kept
    promoted: list[str] = field(default_factory=list)


def normalize_columns(df: DataFrame) -> DataFrame:
    """R1 + R2 on a frame (schema only)."""
    return df.toDF(*canonical_names(df.columns))


def trim_all_text(df: DataFrame) -> DataFrame:
    """Strip every text column in one projection."""
    return df.select(*[trim_text(f.name).alias(f.name) if isinstance(f.dataType, StringType) else F.col(f"`{f.name}`")
                       for f in df.schema.fields])


def numeric_ratios(df: DataFrame, columns: Optional[list[str]] = None) -> DataFrame:
    """C4 profile: share of all rows whose text parses under C2 (nulls count against).

    One aggregate over every column; output (column, ratio) rounded to 6 for
    display; null on an empty frame.
    """
    cols = columns if columns is not None else R.text_columns(df)
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, ratio double")
    n = F.count(F.lit(1))
    exprs = [F.round(F.try_divide(F.count_if(lenient_number(c).isNotNull()).cast("double"), n), 6).alias(f"r{i}")
             for i, c in enumerate(cols)]
    wide = df.agg(*exprs)
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"r{i}").alias("ratio")) for i, c in enumerate(cols)]))
        .alias("r")).select("r.*")


def promote_numeric(df: DataFrame, threshold: float = PROMOTE_THRESHOLD,
                    protect: tuple = ()) -> tuple[DataFrame, list[str]]:
    """C4: text columns where >= 80 % of rows parse become numeric (one job);
    none on an empty frame."""
    cands = [c for c in R.text_columns(df) if c not in protect]
    if not cands:
        return df, []
    counts = df.agg(F.count(F.lit(1)), *[F.count_if(lenient_number(c).isNotNull()) for c in cands]).first()
    promoted = [c for c, parsed in zip(cands, counts[1:]) if reaches(parsed, counts[0], threshold)]
    out = df.select(*[lenient_number(c).alias(c) if c in promoted else F.col(f"`{c}`") for c in df.columns])
    return out, promoted


def reaches(parsed: int, rows: int, threshold: float = PROMOTE_THRESHOLD) -> bool:
    """Whether parsed / rows >= threshold, compared exactly (never on no rows)."""
    return rows > 0 and parsed >= Fraction(str(threshold)) * rows


def impute_medians(df: DataFrame, columns: list[str], approx: bool = False) -> DataFrame:
    """Fill nulls of each column with its median (an all-null column stays null).

    Medians are exact and distributed (`quantiles.medians`): one job for all
    columns, and no task ever holds all distinct values.  ``approx=True`` uses one
    `percentile_approx` aggregate instead.
    """
    if not columns:
        return df
    if approx:
        med = df.agg(F.struct(*[F.percentile_approx(c, 0.5, 10000).cast("double").alias(f"m{i}")
                                for i, c in enumerate(columns)]).alias("m")).scalar()
        fill = {c: med[f"m{i}"] for i, c in enumerate(columns)}
    else:
        med = medians(df, columns)
        fill = {c: med[f"m{i}"] for i, c in enumerate(columns)}
    return df.select(*[F.coalesce(F.col(c), fill[c]).alias(c) if c in fill else F.col(f"`{c}`")
                       for c in df.columns])


def fill_text(df: DataFrame, value: str = UNKNOWN_TEXT, skip: tuple = ()) -> DataFrame:
    """Null text -> 'Unknown'."""
    return df.select(*[F.coalesce(F.col(f"`{f.name}`"), F.lit(value)).alias(f.name)
                       if isinstance(f.dataType, StringType) and f.name not in skip else F.col(f"`{f.name}`")
                       for f in df.schema.fields])


def prepare(raw: DataFrame) -> DataFrame:
    """R1/R2 + C1: canonical names and trimmed text (no job)."""
    return trim_all_text(normalize_columns(raw))


def clean_sales(raw: DataFrame, compat: bool = False, approx_median: bool = False,
                materialize: bool = False, impute: bool = True) -> CleanedSales:
    """C14: clean a day-book export.

    Steps: names -> trim -> roles -> day-first dates -> numeric promotion ->
    revenue coercion -> drop rows without date/revenue -> fill customer ->
    median imputation -> text imputation -> year/month features.  With
    ``compat=False`` the date, customer and tax-id roles are protected from
    numeric promotion.

    One profiling pass fixes the schema; the result is one lazy plan over the
    export that parses only the columns its caller selects.  ``materialize``
    writes the parsed rows by ``checkpoint()`` to the shared folder first, for
    sources that are dear to read twice.  ``impute=False`` leaves nulls in
    numeric columns (and spares the medians' jobs) where the caller only counts.
    """
    df = prepare(raw)
    cols = df.columns
    date_c, rev_c = R.date_role(cols), R.revenue_role(cols)
    cust_c, gst_c = R.customer_role(cols), R.gstin_role(cols)
    if not date_c:
        raise ValueError(f"No date column among {cols}.")
    if not rev_c:
        raise ValueError(f"No revenue column among {cols}.")
    protect = (date_c,) if compat else tuple(c for c in (date_c, cust_c, gst_c) if c)
    cands = [c for c in R.text_columns(df) if c not in protect]
    rev_text = isinstance(df.schema[rev_c].dataType, StringType)
    rev_parsed = lenient_number(rev_c) if rev_text else F.col(rev_c).cast("double")
    staged = df.select(*[F.col(f"`{c}`") for c in df.columns],
                       *[lenient_number(c).alias(f"__num{i}") for i, c in enumerate(cands)],
                       rev_parsed.alias("__rev"))
    if materialize:
        ensure_checkpoint_dir(staged.sparkSession)
        staged = staged.withColumn(date_c, parse_dayfirst(date_c, df.schema[date_c].dataType)).checkpoint(eager=True)
    date_type = staged.schema[date_c].dataType
    forms = list(FORMS) if isinstance(date_type, StringType) else []
    # profile: the forms of dates, promotion ratios and the revenue sanity check, one aggregate
    seen = staged.withColumn("__form", date_form(date_c) if forms else F.lit(None).cast("string"))
    seen = seen.withColumn("__date", parse_of_form(date_c, "__form") if forms else parse_dayfirst(date_c, date_type))
    kept_row = F.col("__date").isNotNull() & F.col("__rev").isNotNull()
    already = [f.name for f in df.schema.fields
               if isinstance(f.dataType, NumericType) and f.name not in R.SYSTEM_COLUMNS and f.name != rev_c]
    prof = seen.agg(*([F.count_if(F.col(f"__num{i}").isNotNull()) for i in range(len(cands))]
                      + [F.count(F.lit(1)).alias("rows"), F.count_if(F.col("__rev").isNotNull()).alias("rev_ok"), F.count_if(kept_row).alias("kept"),
                         F.count_if(kept_row & (F.col(cust_c).isNull() if cust_c else F.lit(False))).alias("unnamed")]
                      + [F.count_if(kept_row & F.col(f"__num{i}").isNull()).alias(f"miss{i}") for i in range(len(cands))]
                      + [F.count_if(kept_row & F.col(f"`{c}`").isNull()).alias(f"missn{j}") for j, c in enumerate(already)]
                      + [F.count_if(F.col("__form") == name).alias(f"form{j}") for j, name in enumerate(forms)]
                      )).collect()[0]
    # only the forms that the column has are parsed from here on, the most frequent first
    forms = sorted((f for j, f in enumerate(forms) if prof[f"form{j}"]), key=lambda f: -prof[f"form{forms.index(f)}"])
    staged = staged.withColumn(date_c, parse_dayfirst(date_c, date_type, forms))
    promoted = [c for i, c in enumerate(cands) if reaches(prof[i], prof["rows"])]
    if not prof["rev_ok"]:
        raise ValueError(f"No value of the revenue column {rev_c!r} is a number ({prof['rows']} rows read).")
    num_of = {c: f"__num{i}" for i, c in enumerate(cands)}
    df = staged.select(*[F.col(num_of[c]).alias(c) if c in promoted
                         else (F.col("__rev").alias(c) if c == rev_c else F.col(f"`{c}`")) for c in cols])

    # the profile has counted what the drop will leave
    stats = df.sparkSession.range(1).select(
        F.lit(prof["rows"] - prof["kept"]).cast("long").alias("rows_dropped_missing_date_or_revenue"),
        F.lit(prof["unnamed"]).cast("long").alias("missing_customers_filled"),
        F.lit(prof["kept"]).cast("long").alias("records_after_cleaning"))
    kept = df.filter(F.col(date_c).isNotNull() & F.col(rev_c).isNotNull())
    if cust_c:
        kept = kept.withColumn(cust_c, F.coalesce(F.col(cust_c), F.lit(UNKNOWN_CUSTOMER)))
    # only columns with a missing value among the kept rows need a median
    missing = {c for i, c in enumerate(cands) if c in promoted and prof[f"miss{i}"]}
    missing |= {c for j, c in enumerate(already) if prof[f"missn{j}"]}
    numeric = [f.name for f in kept.schema.fields
               if isinstance(f.dataType, NumericType) and f.name in missing]
    if impute:
        kept = impute_medians(kept, numeric, approx=approx_median)
    kept = fill_text(kept)
    kept = add_time_features(kept, date_c)
    return CleanedSales(kept, date_c, rev_c, cust_c, gst_c, stats, promoted)


def clean_reference(raw: DataFrame, compat: bool = False) -> tuple[DataFrame, list[str]]:
    """Names -> trim -> numeric promotion (customer/tax-id roles protected
    unless ``compat``).  One profiling job."""
    df = prepare(raw)
    protect = () if compat else tuple(c for c in (R.customer_role(df.columns), R.gstin_role(df.columns)) if c)
    return promote_numeric(df, protect=protect)


def sales_base(merged: DataFrame, date_col: str, revenue_col: str, customer_col: Optional[str]) -> DataFrame:
    """C17: the dashboard's base sales frame from a cleaned (and merged) frame.

    Adds `_date _year _month _revenue _customer _customer_norm` after
    re-coercing date and revenue and dropping rows missing either.
    """
    t = merged.schema[date_col].dataType
    d = parse_dayfirst(date_col, t)
    rv = strict_number(revenue_col) if isinstance(merged.schema[revenue_col].dataType, StringType) \
        else F.col(revenue_col).cast("double")
    df = merged.withColumn(date_col, d).withColumn(revenue_col, rv)
    df = df.filter(F.col(date_col).isNotNull() & F.col(revenue_col).isNotNull())
    cust = (trim_text(F.coalesce(F.col(customer_col).cast("string"), F.lit(UNKNOWN_CUSTOMER)))
            if customer_col and customer_col in df.columns else F.lit(UNKNOWN_CUSTOMER))
    return df.select("*", F.col(date_col).alias("_date"), F.year(date_col).alias("_year"),
                     month_label(date_col).alias("_month"), F.col(revenue_col).alias("_revenue"),
                     cust.alias("_customer")).withColumn("_customer_norm", text_key("_customer"))
