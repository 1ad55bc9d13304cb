"""Connected components of an edge table in rounds of grouped minima."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step: neighbours move to the smallest node that their centre knows."""
    if large:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    met = both.join(low, "a")
    if large:
        moved = met.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        moved = met.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(
            low.select("a", F.col("low").alias("b"))
        )
    return moved.where("a <> b").distinct()


def connected(edges: DataFrame, store: Callable[[DataFrame], DataFrame] = cut_lineage) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the smallest node of its component.

    Large-star and small-star steps alternate until every edge leads to a root. Each step is
    a grouped minimum (combined before the shuffle) and a join, and ends in a stored table;
    no component meets in one task.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    now = store(edges)
    mark = None
    while True:
        now = store(_stars(_stars(now, True), False))
        row = now.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")
        ).first()
        if (row.n, row.h) == mark:
            break
        mark = (row.n, row.h)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
