"""Weighted links among the roots of a view: features, similarity, direct links, link cap.

Everything here works on a root set that the view already limited (``browse.ROOTS``), so
broadcasting the roots is safe; their features may still be as many as there are edges.
Weights are kept as whole billionths, so sums do not depend on the order of rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..session import cut_lineage
from . import graph
from .browse import ROOTS, GraphTables, roots

UNIT = 1_000_000_000

# Feature weights per kind of root, threshold and link shape.
SKILL_WEIGHTS = {"company": 1.1, "job": 0.72, "parent": 0.85, "category": 0.2}
COMPANY_BASE, COMPANY_SPAN, COMPANY_INDUSTRY = 0.45, 0.75, 0.22
JOB_REQUIRED, JOB_OTHER, JOB_COMPANY, JOB_FAMILY = 1.0, 0.66, 0.3, 0.55
MIN_SIMILARITY = 0.12
DIRECT_BASE, DIRECT_SPAN = 0.22, 0.78
LINKS_PER_NODE = 4


def _units(weight) -> Column:
    column = weight if isinstance(weight, Column) else F.lit(weight)
    return F.rint(column * UNIT).cast("long")


def _feature(df: DataFrame, node: str, prefix: str, key: str, weight) -> DataFrame:
    filled = df.where(text.blank_to_null(F.col(key)).isNotNull())
    return filled.select(
        F.col(node).alias("id"), F.concat(F.lit(prefix + ":"), F.col(key)).alias("key"), _units(weight).alias("w")
    )


def weighted_features(g: GraphTables, kind: str, among: DataFrame) -> DataFrame:
    """(id, key, w) of the given roots; of equal keys the largest weight counts."""
    small = F.broadcast(among.select("id"))

    def of(df: DataFrame, column: str) -> DataFrame:
        return df.join(small.withColumnRenamed("id", column), column, "left_semi")

    if kind == "skill":
        known = of(g.known, "skill_id")
        skills = of(g.skills, "id")
        parts = [
            _feature(known.select("skill_id", "company_id").distinct(), "skill_id", "company", "company_id", SKILL_WEIGHTS["company"]),
            _feature(known.select("skill_id", "job_id").distinct(), "skill_id", "job", "job_id", SKILL_WEIGHTS["job"]),
            _feature(skills, "id", "parent", "parent_id", SKILL_WEIGHTS["parent"]),
            _feature(skills, "id", "category", "category", SKILL_WEIGHTS["category"]),
        ]
    elif kind == "company":
        stats = graph.company_skill_stats(of(g.known, "company_id"))
        top = stats.groupBy("company_id").agg(F.max("n").alias("top"))
        share = F.lit(COMPANY_BASE) + F.col("n") / F.col("top") * COMPANY_SPAN
        parts = [_feature(stats.join(F.broadcast(top), "company_id"), "company_id", "skill", "skill_id", share)]
        if "industry" in g.companies.columns:
            parts.append(_feature(of(g.companies, "id"), "id", "industry", "industry", COMPANY_INDUSTRY))
    else:
        jobs = of(g.jobs, "id")
        weight = F.when(F.col("edge_type") == "REQUIRES", JOB_REQUIRED).otherwise(JOB_OTHER)
        parts = [
            _feature(of(g.known, "job_id"), "job_id", "skill", "skill_id", weight),
            _feature(jobs, "id", "company", "company_id", JOB_COMPANY),
        ]
        if "role_family" in g.jobs.columns:
            parts.append(_feature(jobs, "id", "family", "role_family", JOB_FAMILY))
    return reduce(DataFrame.unionByName, parts).groupBy("id", "key").agg(F.max("w").alias("w"))


def weighted_similarity(features: DataFrame, among: DataFrame, more_than: float = MIN_SIMILARITY) -> DataFrame:
    """Root pairs (source before target in root order) with Σmin / Σmax above the bound."""
    placed = features.join(F.broadcast(among.select("id", "pos")), "id")
    total = features.groupBy("id").agg(F.sum("w").alias("total"))
    left = placed.select("key", F.col("pos").alias("pa"), F.col("id").alias("source"), F.col("w").alias("wa"))
    right = placed.select("key", F.col("pos").alias("pb"), F.col("id").alias("target"), F.col("w").alias("wb"))
    shared = (
        left.join(right, "key")
        .where(F.col("pa") < F.col("pb"))
        .groupBy("source", "target", "pa", "pb")
        .agg(F.sum(F.least("wa", "wb")).alias("low"))
    )
    bounded = F.broadcast(total)
    return (
        shared.join(bounded.select(F.col("id").alias("source"), F.col("total").alias("ta")), "source")
        .join(bounded.select(F.col("id").alias("target"), F.col("total").alias("tb")), "target")
        .withColumn("weight", F.col("low") / (F.col("ta") + F.col("tb") - F.col("low")))
        .where(F.col("weight") > more_than)
        .select("source", "target", "weight", "pa", "pb")
    )


def direct_links(neighbors: DataFrame, among: DataFrame) -> DataFrame:
    """Similar jobs that are both roots; each pair once, as the earlier root lists it."""
    small = among.select("id", "pos")
    listed = (
        neighbors.join(F.broadcast(small.select(F.col("id").alias("job_id"), F.col("pos").alias("pa"))), "job_id")
        .join(F.broadcast(small.select(F.col("id").alias("other_id"))), "other_id", "left_semi")
    )
    weight = F.least(F.lit(1.0), F.greatest(F.lit(DIRECT_BASE), F.lit(DIRECT_BASE) + F.col("score") * DIRECT_SPAN))
    return (
        listed.groupBy(F.least("job_id", "other_id").alias("x"), F.greatest("job_id", "other_id").alias("y"))
        .agg(F.min_by(F.struct(F.col("job_id").alias("source"), F.col("other_id").alias("target"),
                               weight.alias("weight"), "pa", F.col("rank").alias("pb")),
                      F.struct("pa", "rank")).alias("l"))
        .select("l.*")
    )


def merge_links(similar: DataFrame, direct: DataFrame) -> DataFrame:
    """One link per pair with the larger weight; ``ord`` is where the pair was first seen."""
    marked = similar.select("source", "target", "weight", F.struct(F.lit(0).alias("part"), "pa", "pb").alias("ord")).unionByName(
        direct.select("source", "target", "weight", F.struct(F.lit(1).alias("part"), "pa", "pb").alias("ord"))
    )
    return (
        marked.groupBy(F.least("source", "target").alias("x"), F.greatest("source", "target").alias("y"))
        .agg(
            F.max_by(F.struct("source", "target"), F.struct("weight", (-F.col("ord.part")).alias("p"))).alias("ends"),
            F.max("weight").alias("weight"),
            F.min("ord").alias("ord"),
        )
        .select("ends.*", "weight", "ord")
    )


def cap_links(links: DataFrame, per_node: int = LINKS_PER_NODE) -> DataFrame:
    """Greedy choice of links (source, target, weight, ord) by weight, then ``ord``, with at
    most ``per_node`` kept at either end.

    Each round keeps the links that rank within the capacity left at both ends; those are
    exactly links the greedy pass would keep. Full nodes then drop out, and the rest is
    ranked again until nothing is left. Rounds are few, because the best remaining link of
    every neighbourhood is settled in each.
    """
    left = cut_lineage(links.select("source", "target", "weight", "ord", F.lit(per_node).alias("ca"), F.lit(per_node).alias("cb")))
    kept = left.limit(0)
    while not left.isEmpty():
        ends = left.select("*", F.explode(F.array("source", "target")).alias("node"))
        by_node = Window.partitionBy("node").orderBy(F.col("weight").desc(), F.col("ord").asc(), F.col("source"), F.col("target"))
        capacity = F.when(F.col("node") == F.col("source"), F.col("ca")).otherwise(F.col("cb"))
        fits = ends.withColumn("fits", F.row_number().over(by_node) <= capacity)
        judged = fits.groupBy("source", "target", "weight", "ord", "ca", "cb").agg(F.min("fits").alias("keep"))
        chosen = judged.where("keep").drop("keep")
        used = chosen.select(F.explode(F.array("source", "target")).alias("node")).groupBy("node").agg(F.count("*").alias("used"))
        rest = (
            judged.where(~F.col("keep")).drop("keep")
            .join(used.select(F.col("node").alias("source"), F.col("used").alias("ua")), "source", "left")
            .join(used.select(F.col("node").alias("target"), F.col("used").alias("ub")), "target", "left")
            .withColumn("ca", F.col("ca") - F.coalesce("ua", F.lit(0)).cast("int"))
            .withColumn("cb", F.col("cb") - F.coalesce("ub", F.lit(0)).cast("int"))
            .where((F.col("ca") > 0) & (F.col("cb") > 0))
            .select("source", "target", "weight", "ord", "ca", "cb")
        )
        kept = cut_lineage(kept.unionByName(chosen.select(*kept.columns)))
        left = cut_lineage(rest)
    return kept.select("source", "target", "weight", "ord")


def root_weave(
    g: GraphTables, kind: str, limit: int = ROOTS, more_than: float = MIN_SIMILARITY
) -> DataFrame:
    """Links drawn between the roots of one kind."""
    top = cut_lineage(roots(g, kind, limit=limit))
    similar = weighted_similarity(weighted_features(g, kind, top), top, more_than)
    if kind == "job" and g.neighbors is not None:
        links = merge_links(similar, direct_links(g.neighbors, top))
    else:
        links = similar.select("source", "target", "weight", F.struct(F.lit(0).alias("part"), "pa", "pb").alias("ord"))
    return cap_links(links).select("source", "target", "weight")
