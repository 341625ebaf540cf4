"""Customer concentration: top-N, top-N share, Pareto curve and count."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.numbers import money
from ledgerlens.session import materialize

# Buckets for the distributed running sum (W3).  Any bucketing in sort order
# gives the same exact answer; more buckets spread the window work wider.  The
# default follows the session's shuffle width, with this floor.
PARETO_BUCKETS = 64


def value_by_key(df: DataFrame, key_col: str, value_col: str) -> DataFrame:
    """Exact (decimal) total per key; null keys form their own group."""
    return df.groupBy(key_col).agg(F.sum(money(value_col)).alias("value_dec"))


def _totals(df: DataFrame, key_col: str, value_col: str, written: bool) -> DataFrame:
    """The total per key, written once; ``written`` says that ``df`` already holds just that."""
    return df.select(key_col, F.col(value_col).alias("value_dec")) if written else materialize(value_by_key(df, key_col, value_col))


def _order(key_col: str):
    return [F.col("value_dec").desc(), F.col(key_col).asc_nulls_first()]


def top_n(df: DataFrame, key_col: str, value_col: str, n: int = 10,
          out_key: str | None = None, out_value: str = "revenue", with_pct: bool = True, written: bool = False) -> DataFrame:
    """Top n keys by total (ties: key ascending), with % of the grand total.

    Planned as a partial+final aggregate followed by TakeOrderedAndProject; the
    grand total is a scalar subquery over the same aggregate.
    """
    # written where it is read by the top-n and by the total
    agg = _totals(df, key_col, value_col, written) if with_pct or written else value_by_key(df, key_col, value_col)
    top = agg.orderBy(*_order(key_col)).limit(n)
    cols = [F.col(key_col).alias(out_key or key_col), F.col("value_dec").cast("double").alias(out_value)]
    if with_pct:
        total = agg.agg(F.sum("value_dec").cast("double")).scalar()
        cols.append(F.when(F.coalesce(total, F.lit(0.0)) == 0, F.lit(0.0))
                    .otherwise(F.round(F.col("value_dec").cast("double") / total * 100.0, 6)).alias("pct"))
    return top.select(*cols)


def top_share(df: DataFrame, key_col: str, value_col: str, limits=(10, 20), written: bool = False) -> DataFrame:
    """Share (%) of the grand total held by the top 10 / top 20 keys; 0 if empty."""
    agg = _totals(df, key_col, value_col, written)
    biggest = max(limits)
    top = agg.orderBy(*_order(key_col)).limit(biggest)
    ranked = top.select("value_dec", F.row_number().over(Window.orderBy(*_order(key_col))).alias("rn"))
    total = agg.agg(F.sum("value_dec").cast("double")).scalar()
    outs = []
    for n in limits:
        s = F.coalesce(F.sum(F.when(F.col("rn") <= n, F.col("value_dec"))).cast("double"), F.lit(0.0))
        outs.append(F.when(F.coalesce(total, F.lit(0.0)) == 0, F.lit(0.0))
                    .otherwise(F.round(s / total * 100.0, 6)).alias(f"top{n}_pct"))
    return ranked.agg(*outs)


def cumulative_share(df: DataFrame, key_col: str, value_col: str,
                     buckets: int | None = None, written: bool = False) -> DataFrame:
    """Running share of the grand total, keys by total descending (ties: key asc).

    A global running sum would put every key into one task.  Instead the
    per-key totals are range-partitioned on the full sort key (total desc,
    key asc): Spark samples bounds on that composite key, so even one total
    shared by a third of all keys is split across buckets by key.  Bucket
    sums give each bucket's offset (a handful of rows, broadcast back), and
    the running sum is a window inside each bucket.  The bucketed aggregate
    is written once (reliable checkpoint), so the sums and the window see the
    same buckets and never re-read the fact table.
    Output: key, revenue, cum_dec (exact), cum_pct, total_dec.
    """
    if buckets is None:
        width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200") or 200)
        buckets = max(PARETO_BUCKETS, width)
    agg = _totals(df, key_col, value_col, written)
    ranged = materialize(agg.repartitionByRange(buckets, *_order(key_col))
                         .withColumn("bucket", F.spark_partition_id()))
    sums = ranged.groupBy("bucket").agg(F.sum("value_dec").alias("bucket_dec"))
    offsets = sums.select("bucket", F.coalesce(F.sum("bucket_dec").over(
        Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset_dec"))
    total = sums.agg(F.sum("bucket_dec")).scalar()
    w = Window.partitionBy("bucket").orderBy(*_order(key_col)).rowsBetween(Window.unboundedPreceding, 0)
    # broadcast bound: one row per bucket (the bucket count is a parameter)
    running = (ranged.join(F.broadcast(offsets), "bucket")
               .select(key_col, "value_dec", (F.col("offset_dec") + F.sum("value_dec").over(w)).alias("cum_dec")))
    return running.select(
        key_col, F.col("value_dec").cast("double").alias("revenue"), "cum_dec",
        F.when(F.coalesce(total, F.lit(0)) == 0, F.lit(0.0))
        .otherwise(F.round(F.col("cum_dec").cast("double") / total.cast("double") * 100.0, 6)).alias("cum_pct"),
        total.alias("total_dec"))


def pareto_curve(df: DataFrame, key_col: str, value_col: str, n: int = 20) -> DataFrame:
    """W3 output: the first n points of the cumulative-share curve."""
    cs = cumulative_share(df, key_col, value_col)
    return (cs.orderBy(F.col("revenue").desc(), F.col(key_col).asc_nulls_first()).limit(n)
            .select(key_col, "revenue", "cum_pct"))


def pareto_count(df: DataFrame, key_col: str, value_col: str, written: bool = False) -> DataFrame:
    """A10: keys whose cumulative share is <= 80 % (at least 1 when any key exists).

    Compared in decimals: cum * 100 / total <= 80 is 5 * cum <= 4 * total, or >= below a
    negative total.
    """
    cs = cumulative_share(df, key_col, value_col, written=written)
    cum, total = F.col("cum_dec") * 5, F.col("total_dec") * 4
    within = F.when(total > 0, cum <= total).when(total < 0, cum >= total).otherwise(F.lit(True))
    return cs.agg(F.count_if(within).alias("n"), F.count(F.lit(1)).alias("keys")).select(
        F.when(F.col("keys") > 0, F.greatest(F.col("n"), F.lit(1))).otherwise(F.lit(0)).cast("long")
        .alias("customers_within_80pct"))
