"""One scan for many results: totals by several keys at once, written once.

Most results of a report start from a total per customer, per month, per category
or per distinct value.  `grains` computes all of them in one pass over the facts
(grouping sets: partial aggregation leaves a row per task and key before the
shuffle) and writes them; each result then reads its own small part.
"""

from __future__ import annotations

from typing import Mapping, Optional

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.numbers import MONEY, money
from ledgerlens.operators.quantiles import ranged
from ledgerlens.session import materialize


class Grains:
    """The written totals; a frame per key."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def total(self, key: str, key_name: Optional[str] = None, value_name: str = "revenue") -> DataFrame:
        """Rows (key, exact total) of one key."""
        return self.rows.where(F.col("grain") == key).select(F.col(f"`{key}`").alias(key_name or key), F.col("s").alias(value_name))

    def counts(self, key: str) -> DataFrame:
        """The counts per distinct value of a key of numbers, as `quantiles.value_counts` writes them."""
        v = F.col(f"`{key}`")
        return ranged(self.rows.where((F.col("grain") == key) & v.isNotNull() & ~F.isnan(v)).select(
            F.lit(0).alias("k"), v.alias("v"), F.col("n").alias("c"), "s"))

    def whole(self) -> DataFrame:
        """The one row of all rows: n, s and the other aggregates."""
        return self.rows.where("grain = ''")


def grains(df: DataFrame, value_col: str, keys: Mapping[str, Column], whole: Mapping[str, Column] = ()) -> Grains:
    """Rows, rows with a value (n) and exact total (s) per value of each of ``keys``, and over all rows, from one scan.

    ``whole`` are further aggregates wanted over all rows, of columns of ``df``.
    """
    names, extra = list(keys), dict(whole)
    flat = df.select(*[c.alias(k) for k, c in keys.items()], money(value_col).alias("__s"),
                     *[c.alias(f"__{k}") for k, c in extra.items()])
    sums = flat.groupingSets([[F.col(f"`{k}`")] for k in names] + [[]], *[F.col(f"`{k}`") for k in names]).agg(
        F.count(F.lit(1)).alias("rows"), F.count("__s").alias("n"), F.sum("__s").cast(MONEY).alias("s"),
        *[F.min(f"__{k}").alias(f"min_{k}") for k in extra], *[F.max(f"__{k}").alias(f"max_{k}") for k in extra],
        *[F.grouping(F.col(f"`{k}`")).alias(f"__g{i}") for i, k in enumerate(names)])
    grain = F.coalesce(*[F.when(F.col(f"__g{i}") == 0, k) for i, k in enumerate(names)], F.lit(""))
    return Grains(materialize(sums.withColumn("grain", grain).drop(*[f"__g{i}" for i in range(len(names))])))
