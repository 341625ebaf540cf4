"""Parquet table access."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy Parquet scan of ``{sf_dir}/{name}.parquet``.

    Column pruning and predicate pushdown reach this scan through Catalyst, so
    callers select only what they need and never pre-filter by hand.
    """
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
