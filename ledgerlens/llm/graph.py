"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerlens.llm.tables import written


def _to_minimum(pairs: DataFrame) -> DataFrame:
    """(u, v, m): every pair with the smallest of u and its partners."""
    low = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(low, "u")


def _state(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable from every id on an edge of (u, v).

    Each step halves the distances at least; edges are written after every round,
    so lineage stays short, and only a count and a checksum reach the driver.
    """
    edges = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                    .distinct(), "edges")
    state = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_minimum(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _to_minimum(large)
        edges = written(small.select(F.col("v").alias("u"), F.col("m").alias("v"))
                        .unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        before, state = state, _state(edges)
        if state == before:
            roots = edges.select(F.col("v").alias("id")).distinct()
            return (edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
                    .unionByName(roots.select("id", F.col("id").alias("component"))))
