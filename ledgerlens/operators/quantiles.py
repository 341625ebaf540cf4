"""Exact, distributed statistics of whole columns from one scan: quantiles with linear
interpolation (as pandas and DuckDB's quantile_cont compute them), moments, histograms.

Spark's exact `percentile` merges a map of every distinct value into one final task.
Here the work stays spread out, for any number of columns at once (`value_counts`):

1. count rows per (column, distinct value); partial aggregation collapses hot values,
2. range-partition these into buckets and write them once - the only scan of the facts,
3. bucket totals give each bucket's rank offset (buckets x columns rows),
4. a window inside each bucket gives every value its cumulative count, and the values
   covering ranks floor(h) and ceil(h), h = (n - 1) p, are picked by one conditional
   aggregate.

Moments come from the same counts.  Each value's part is taken to a fixed scale and
summed in decimals, so a sum does not depend on how rows were partitioned.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.numbers import MONEY, money
from ledgerlens.session import materialize

MIN_BUCKETS = 16
#: Parts of a moment lie in [-1, 1] times a count; 18 places and 20 digits before the point hold any sum of them.
PART = "decimal(38,18)"


def ranged(counts: DataFrame, buckets: int | None = None) -> DataFrame:
    """Counts per distinct value (k, v, c, s) dealt into range buckets `b` and written."""
    if buckets is None:
        buckets = max(MIN_BUCKETS, int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions", "200") or 200))
    return materialize(counts.repartitionByRange(buckets, "k", "v").withColumn("b", F.spark_partition_id()))


def value_counts(df: DataFrame, columns: Sequence[str], buckets: int | None = None) -> DataFrame:
    """The written counts of every distinct value (nulls and NaN ignored): k (place of the column), v, c rows, s (their exact sum), b (range bucket)."""
    value = lambda c: F.col(f"`{c}`").cast("double")
    if len(columns) == 1:
        stacked = df.select(F.lit(0).alias("k"), value(columns[0]).alias("v"))
    else:
        stacked = df.select(F.inline(F.array(*[F.struct(F.lit(k).alias("k"), value(c).alias("v")) for k, c in enumerate(columns)])))
    # -0.0 and 0.0 are one value
    counts = (stacked.where(F.col("v").isNotNull() & ~F.isnan("v")).groupBy("k", (F.col("v") + 0.0).alias("v"))
              .agg(F.count(F.lit(1)).alias("c"), F.sum(money("v")).cast(MONEY).alias("s")))
    return ranged(counts, buckets)


def quantiles_of(counts: DataFrame, probs: Sequence[float]) -> DataFrame:
    """Per column of `value_counts` with a value: k and its interpolated quantiles q0, q1, ..."""
    per_bucket = counts.groupBy("k", "b").agg(F.sum("c").alias("bc"))
    before = Window.partitionBy("k").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select("k", "b", F.coalesce(F.sum("bc").over(before), F.lit(0)).alias("off"),
                                F.sum("bc").over(Window.partitionBy("k")).alias("n"))
    w = Window.partitionBy("k", "b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    # broadcast bound: a row for each bucket and column
    cum = counts.join(F.broadcast(offsets), ["k", "b"]).select("k", "v", "c", "n", (F.col("off") + F.sum("c").over(w)).alias("cum"))

    def at_rank(r: Column) -> Column:
        # the one distinct value whose rank range [cum - c, cum) holds r
        return F.max(F.when((F.col("cum") - F.col("c") <= r) & (r < F.col("cum")), F.col("v")))

    rank = lambda p: (F.col("n") - 1).cast("double") * float(p)
    picks = [pick for i, p in enumerate(probs) for pick in (at_rank(F.floor(rank(p))).alias(f"lo{i}"), at_rank(F.ceil(rank(p))).alias(f"hi{i}"))]
    picked = cum.groupBy("k").agg(F.max("n").alias("n"), *picks)
    return picked.select("k", *[(F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * (rank(p) - F.floor(rank(p)))).alias(f"q{i}")
                                for i, p in enumerate(probs)])


def quantiles(counts: DataFrame, probs: Sequence[float], k: int = 0) -> Column:
    """Struct scalar subquery (q0, q1, ...) of one column of `value_counts`."""
    return quantiles_of(counts.where(F.col("k") == k), probs).select(F.struct(*[F.col(f"q{i}") for i in range(len(probs))]).alias("q")).scalar()


def exact_quantiles(df: DataFrame, col: str, probs: Sequence[float], buckets: int | None = None) -> Column:
    """Struct scalar subquery of the interpolated quantiles of ``col`` (nulls and NaN ignored)."""
    return quantiles(value_counts(df, [col], buckets), probs)


def medians(df: DataFrame, columns: Sequence[str]) -> Column:
    """Struct scalar subquery (m0, m1, ...) of the medians of all columns: one scan, however many (a column without values: null)."""
    found = quantiles_of(value_counts(df, columns), [0.5])
    return found.agg(F.struct(*[F.max(F.when(F.col("k") == k, F.col("q0"))).alias(f"m{k}") for k in range(len(columns))]).alias("m")).scalar()


def moments(counts: DataFrame, k: int = 0) -> DataFrame:
    """One row of one column of `value_counts`: n, total (exact decimal), lo, hi, and from the centred second and third power sums std (n - 1) and skew (population).

    Deviations are taken from the mean and divided by the largest one.
    """
    own = counts.where(F.col("k") == k)
    first = own.agg(F.sum("c").alias("n"), F.sum("s").alias("total"), F.min("v").alias("lo"), F.max("v").alias("hi")).withColumn(
        "mean", F.col("total").cast("double") / F.col("n")).withColumn(
        "reach", F.greatest(F.abs(F.col("hi") - F.col("mean")), F.abs(F.col("lo") - F.col("mean"))))
    a = first.agg(F.first(F.struct(*first.columns)).alias("a")).scalar()
    u = (F.col("v") - a["mean"]) / F.nullif(a["reach"], F.lit(0.0))
    part = lambda x: F.sum((F.col("c") * x).try_cast(PART)).cast("double")
    sums = own.agg(F.first(a).alias("a"), part(u * u).alias("s2"), part(u * u * u).alias("s3"))
    n = F.col("n").cast("double")
    return sums.select("a.*", "s2", "s3").select(
        "n", "total", "lo", "hi",
        F.when(F.col("n") > 1, F.col("reach") * F.sqrt(F.coalesce("s2", F.lit(0.0)) / (n - 1))).alias("std"),
        F.when(F.col("s2") > 0, F.col("s3") / n / F.pow(F.col("s2") / n, F.lit(1.5))).alias("skew"))
