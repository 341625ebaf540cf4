"""Monthly and yearly revenue series, moving average, growth, seasonality."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.dates import month_label, month_start
from ledgerlens.functions.numbers import MONEY, money


def _keys(keys: Sequence[str]) -> list[str]:
    return list(keys or [])


def monthly_totals(df: DataFrame, date_col: str, value_col: str, keys: Sequence[str] = ()) -> DataFrame:
    """A4 core: exact (decimal) revenue per observed month start, optionally per key.

    Output: keys..., month_start (date), revenue_dec (decimal).  Partial
    aggregation runs map-side, so a hot key costs one row per task.
    """
    return (df.filter(F.col(date_col).isNotNull() & F.col(value_col).isNotNull())
            .groupBy(*_keys(keys), month_start(date_col).alias("month_start"))
            .agg(F.sum(money(value_col)).alias("revenue_dec")))


def monthly_revenue(df: DataFrame, date_col: str = "date", value_col: str = "revenue",
                    keys: Sequence[str] = ()) -> DataFrame:
    """A4: revenue per observed month ('yyyy-MM'); months without sales are absent."""
    m = monthly_totals(df, date_col, value_col, keys)
    return m.select(*_keys(keys), month_label("month_start").alias("month"),
                    F.col("revenue_dec").cast("double").alias("revenue"))


def fill_months(monthly: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """A5 core: every month between each series' first and last month, absent = 0.

    One pass over the monthly rows: a key's observed months (bounded by the
    calendar) become a map, and `sequence` between its ends looks each month up.
    """
    ks = _keys(keys)
    series = monthly.groupBy(*ks).agg(
        F.min("month_start").alias("lo"), F.max("month_start").alias("hi"),
        F.map_from_entries(F.collect_list(F.struct("month_start", "revenue_dec"))).alias("seen"))
    filled = series.where("lo is not null").select(*ks, "seen", F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 MONTH"))).alias("month_start"))
    return filled.select(*ks, "month_start", F.coalesce(F.try_element_at("seen", F.col("month_start")), F.lit(0).cast(MONEY)).alias("revenue_dec"))


def monthly_filled(df: DataFrame, date_col: str = "date", value_col: str = "revenue",
                   keys: Sequence[str] = ()) -> DataFrame:
    """Gap-filled monthly series (differs from A4 where months are empty)."""
    m = fill_months(monthly_totals(df, date_col, value_col, keys), keys)
    return m.select(*_keys(keys), month_label("month_start").alias("month"),
                    F.col("revenue_dec").cast("double").alias("revenue"))


def moving_average(df: DataFrame, date_col: str = "date", value_col: str = "revenue",
                   keys: Sequence[str] = (), window: int = 3) -> DataFrame:
    """Mean of the current and previous (window-1) *present* months, min 1.

    Runs on the monthly aggregate; with keys it is partitioned by key,
    without keys the window holds one row per month (a few hundred rows).
    """
    ks = _keys(keys)
    m = monthly_totals(df, date_col, value_col, keys)
    w = Window.partitionBy(*ks).orderBy("month_start").rowsBetween(-(window - 1), 0)
    return m.select(
        *ks, month_label("month_start").alias("month"),
        F.col("revenue_dec").cast("double").alias("revenue"),
        F.round(F.sum("revenue_dec").over(w).cast("double") / F.count(F.lit(1)).over(w), 6).alias("ma3"))


def yearly_totals(df: DataFrame, date_col: str, value_col: str, keys: Sequence[str] = ()) -> DataFrame:
    return (df.filter(F.col(date_col).isNotNull() & F.col(value_col).isNotNull())
            .groupBy(*_keys(keys), F.year(date_col).alias("year"))
            .agg(F.sum(money(value_col)).alias("revenue_dec")))


def revenue_by_year(df: DataFrame, date_col: str = "date", value_col: str = "revenue",
                    keys: Sequence[str] = ()) -> DataFrame:
    """A3: revenue per calendar year."""
    y = yearly_totals(df, date_col, value_col, keys)
    return y.select(*_keys(keys), "year", F.col("revenue_dec").cast("double").alias("revenue"))


def yoy_growth(df: DataFrame, date_col: str = "date", value_col: str = "revenue",
               keys: Sequence[str] = ()) -> DataFrame:
    """% change against the previous *present* year; skipped for the first
    year and where the previous year is 0."""
    ks = _keys(keys)
    y = yearly_totals(df, date_col, value_col, keys)
    w = Window.partitionBy(*ks).orderBy("year")
    cur = F.col("revenue_dec").cast("double")
    prev = F.lag(cur).over(w)
    g = y.select(*ks, "year", cur.alias("cur"), prev.alias("prev"))
    return (g.filter(F.col("prev").isNotNull() & (F.col("prev") != 0))
            .select(*ks, "year", F.round((F.col("cur") - F.col("prev")) / F.col("prev") * 100.0, 6).alias("growth_pct")))


def seasonality(df: DataFrame, date_col: str = "date", value_col: str = "revenue") -> DataFrame:
    """Revenue per calendar month; all twelve months present (zeros kept)."""
    spark = df.sparkSession
    agg = (df.filter(F.col(date_col).isNotNull() & F.col(value_col).isNotNull())
           .groupBy(F.month(date_col).alias("month_no")).agg(F.sum(money(value_col)).alias("revenue_dec")))
    months = spark.range(1, 13).select(F.col("id").cast("int").alias("month_no"))
    # broadcast bound: at most 12 rows (one per calendar month)
    return (months.join(F.broadcast(agg), "month_no", "left")
            .select("month_no",
                    F.date_format(F.make_date(F.lit(2000), F.col("month_no"), F.lit(1)), "MMMM").alias("month_name"),
                    F.coalesce(F.col("revenue_dec").cast("double"), F.lit(0.0)).alias("revenue")))


def peak_month(df: DataFrame, date_col: str = "date", value_col: str = "revenue") -> DataFrame:
    """First month at the maximum and first month at the minimum.

    One aggregate with max_by/min_by over the monthly totals, no sort; ties go
    to the earliest month.
    """
    m = monthly_totals(df, date_col, value_col)
    idx = F.year("month_start") * 12 + F.month("month_start")
    row = F.struct(month_label("month_start").alias("month"), F.col("revenue_dec").cast("double").alias("revenue"))
    one = m.agg(F.max_by(row, F.struct(F.col("revenue_dec"), -idx)).alias("peak"),
                F.min_by(row, F.struct(F.col("revenue_dec"), idx)).alias("weakest"))
    return one.select(F.explode(F.array(
        F.struct(F.lit("peak").alias("kind"), F.col("peak.month").alias("month"), F.col("peak.revenue").alias("revenue")),
        F.struct(F.lit("weakest").alias("kind"), F.col("weakest.month").alias("month"), F.col("weakest.revenue").alias("revenue")),
    )).alias("r")).select("r.*").filter(F.col("month").isNotNull())


def calendar_pool(df: DataFrame, date_col: str = "date", days: Sequence[int] = (5, 10, 15, 20, 25)) -> DataFrame:
    """Days 5, 10, 15, 20, 25 of every month in the year range the data covers."""
    b = df.agg(F.min(F.year(date_col)).alias("y0"), F.max(F.year(date_col)).alias("y1"))
    months = b.select(F.explode(F.sequence(F.make_date("y0", F.lit(1), F.lit(1)),
                                           F.make_date("y1", F.lit(12), F.lit(1)),
                                           F.expr("INTERVAL 1 MONTH"))).alias("m"))
    # a day past the month's end (say 31 in April) is dropped, not rolled over
    return (months.select("m", F.explode(F.transform(F.array(*[F.lit(d) for d in days]),
                                                     lambda d: F.date_add("m", d - 1))).alias("date"))
            .filter(F.month("date") == F.month("m")).select("date"))
