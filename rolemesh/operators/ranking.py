"""Top-k helpers. ``row_number() <= k`` lets Spark cut each group before the shuffle
(WindowGroupLimit), so a hot group sends at most k rows per map task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Sort rank of node types. Companies sort last on purpose.
TYPE_RANK = {"job": 1, "skill": 2, "location": 3, "role_family": 4, "source": 5, "node": 6}
LAST_RANK = 99


def top_k(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank"
) -> DataFrame:
    """First ``k`` rows of every group under a total order, with their 1-based rank."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window).cast("long")).where(F.col(rank) <= k)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return top_k(df, keys, order, 1, "_first").drop("_first")


def type_rank(c: Column) -> Column:
    expr = F.lit(None).cast("int")
    for name, rank in TYPE_RANK.items():
        expr = F.when(c == name, rank).otherwise(expr)
    return F.coalesce(expr, F.lit(LAST_RANK))


def newest_first(posted: str = "posted_at", title: str = "title", tie: str = "job_id") -> list[Column]:
    """Date as text, latest first and missing last; then title; then id."""
    return [F.coalesce(F.col(posted), F.lit("")).desc(), F.col(title).asc(), F.col(tie).asc()]
