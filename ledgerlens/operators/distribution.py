"""Distribution shape: quartiles, adjusted skewness, high-value share, histograms."""

from __future__ import annotations

from typing import Optional

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.quantiles import moments, quantiles, value_counts
from ledgerlens.operators.timeseries import monthly_totals
from ledgerlens.session import materialize

HIGH_VALUE_THRESHOLD = 200000


def distribution(df: DataFrame, value_col: str = "revenue", counts: Optional[DataFrame] = None) -> DataFrame:
    """Interpolated q1/q3 and bias-adjusted skewness, from the counts per distinct value (one scan).

    The moments give the population skewness g1; the sample-adjusted G1 is
    g1 * sqrt(n(n-1)) / (n-2).  n < 3 gives null, a constant column gives 0.
    """
    counts = value_counts(df, [value_col]) if counts is None else counts
    q = quantiles(counts, [0.25, 0.75])
    n = F.col("n").cast("double")
    adj = F.col("skew") * F.sqrt(n * (n - 1)) / (n - 2)
    return moments(counts).select(
        F.round(q.q0, 6).alias("q1"),
        F.round(q.q1, 6).alias("q3"),
        F.when(F.coalesce("n", F.lit(0)) < 3, F.lit(None).cast("double"))
        .when(F.col("lo") == F.col("hi"), F.lit(0.0))
        .otherwise(F.round(adj, 6)).alias("skew"))


def high_value_share(df: DataFrame, value_col: str = "revenue", threshold: float = HIGH_VALUE_THRESHOLD,
                     counts: Optional[DataFrame] = None) -> DataFrame:
    """% of rows at or above the threshold (of ``counts`` where given)."""
    rows = df.select(F.col(value_col).alias("v"), F.when(F.col(value_col).isNotNull(), 1).alias("c")) if counts is None else counts
    over = F.coalesce(F.sum(F.when(F.col("v") >= threshold, F.col("c"))), F.lit(0))
    return rows.agg(F.round(F.try_divide(over.cast("double"), F.sum("c")) * 100.0, 6).alias("high_value_pct"))


def _bins(values: DataFrame, n: int) -> DataFrame:
    """Equal-width bins over [min, max] of `v` (in `c` rows each), last bin closed; a constant column gets ±0.5.

    ``values`` is a written frame: min/max are one scalar subquery; binning is a
    projection plus a partial aggregate, and the n-row bin frame is joined back so
    empty bins show 0.
    """
    stats = values.agg(F.struct(F.min("v").alias("lo"), F.max("v").alias("hi")).alias("s")).scalar()
    lo = F.when(stats.lo == stats.hi, stats.lo - 0.5).otherwise(stats.lo)
    hi = F.when(stats.lo == stats.hi, stats.hi + 0.5).otherwise(stats.hi)
    width = (hi - lo) / float(n)
    counted = (values.select(F.least(F.floor((F.col("v") - lo) / width).cast("int"), F.lit(n - 1)).alias("bin"), "c")
               .groupBy("bin").agg(F.sum("c").alias("count")))
    frame = values.sparkSession.range(n).select(F.col("id").cast("int").alias("bin"))
    # broadcast bound: at most n rows (one per bin)
    return (frame.join(F.broadcast(counted), "bin", "left")
            .select("bin", (lo + F.col("bin") * width).alias("lo"), width.alias("w"),
                    F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"),
                    stats.lo.alias("min_v"), stats.hi.alias("max_v")))


def histogram(df: DataFrame, value_col: str = "revenue", bins: int = 30, counts: Optional[DataFrame] = None) -> DataFrame:
    """Bin, lo, hi, count with `bins` equal-width bins.

    Bounds and bins both come from the written counts per distinct value, so the
    facts are scanned once.
    """
    b = _bins(value_counts(df, [value_col]) if counts is None else counts, bins)
    return b.filter(F.col("min_v").isNotNull()).select(
        "bin", F.round("lo", 6).alias("lo"), F.round(F.col("lo") + F.col("w"), 6).alias("hi"), "count")


def _js_round(x):
    """Half-up rounding as a browser does it: floor(x + 0.5)."""
    return F.floor(x + 0.5).cast("long")


def monthly_histogram(df: DataFrame, date_col: str = "date", value_col: str = "revenue", bins: int = 10) -> DataFrame:
    """Histogram of monthly revenue with `{start}k-{end}k` labels.

    All-equal monthly values give one bucket labelled with the rounded value.
    """
    # the month series is read for its bounds, its bins and its size
    m = materialize(monthly_totals(df, date_col, value_col).select(F.col("revenue_dec").cast("double").alias("v"), F.lit(1).alias("c")))
    b = _bins(m, bins)
    start = F.col("lo")
    end = F.col("lo") + F.col("w")
    label = F.concat(_js_round(start / 1000.0).cast("string"), F.lit("k-"),
                     _js_round(end / 1000.0).cast("string"), F.lit("k"))
    spread = b.filter(F.col("min_v") < F.col("max_v")).select("bin", label.alias("label"), "count")
    n_rows = m.agg(F.count(F.lit(1))).scalar()
    flat = (b.filter((F.col("min_v") == F.col("max_v")) & (F.col("bin") == 0))
            .select(F.lit(0).alias("bin"), _js_round(F.col("min_v")).cast("string").alias("label"),
                    n_rows.alias("count")))
    return spread.unionByName(flat)
