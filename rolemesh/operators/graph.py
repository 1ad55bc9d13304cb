"""Typed property graph from the entity tables, and its read models.

Read models that map one key to a list are kept as rows, range-partitioned by
(key, order), because a single hot company or skill may own a third of all rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids, text

NODE_COLUMNS = ["id", "type", "label", "data"]
EDGE_COLUMNS = ["id", "source", "target", "type", "weight", "confidence", "data"]

# Confidence of derived edges.
POSTS_CONFIDENCE, LOCATED_CONFIDENCE, FAMILY_CONFIDENCE = 1.0, 0.9, 0.7


def hydrate_jobs(jobs: DataFrame, enrichment: DataFrame | None, companies: DataFrame) -> DataFrame:
    """Public job rows: company name (or its id) and the nested enrichment, no descriptions."""
    names = companies.select(F.col("id").alias("company_id"), F.col("name").alias("_name"))
    slim = jobs.drop("description_raw", "description_text", "raw_payload", "company_name")
    out = slim.join(names, "company_id", "left").withColumn(
        "company_name", F.coalesce("_name", "company_id")
    )
    if enrichment is not None:
        fields = [c for c in enrichment.columns if c not in ("job_id", "skills", "prompt_version")]
        nested = enrichment.select(
            F.col("job_id").alias("id"), F.struct(*fields).alias("enrichment")
        )
        out = out.join(nested, "id", "left")
    return out.drop("_name")


def _enriched(jobs: DataFrame, name: str) -> Column:
    """An enrichment attribute, whether nested or already flat."""
    if "enrichment" in jobs.columns:
        return F.col("enrichment")[name]
    return F.col(name) if name in jobs.columns else F.lit(None).cast("string")


def company_nodes(companies: DataFrame) -> DataFrame:
    return companies.select(
        "id",
        F.lit("company").alias("type"),
        F.col("name").alias("label"),
        F.to_json(F.struct(*companies.columns)).alias("data"),
    )


def skill_nodes(skills: DataFrame) -> DataFrame:
    return skills.select(
        "id",
        F.lit("skill").alias("type"),
        "label",
        F.to_json(F.struct(*skills.columns)).alias("data"),
    )


def job_nodes(jobs: DataFrame) -> DataFrame:
    """Slim job nodes: eight fields, the rest stays in the job table."""
    data = F.to_json(
        F.struct(
            "id",
            "title",
            "company_id",
            "company_name",
            "location_text",
            _enriched(jobs, "seniority").alias("seniority"),
            _enriched(jobs, "role_family").alias("role_family"),
            "posted_at",
        )
    )
    return jobs.select("id", F.lit("job").alias("type"), F.col("title").alias("label"), data.alias("data"))


def _shared_nodes(jobs: DataFrame, kind: str, value: Column, node_id, field: str) -> DataFrame:
    """One node per distinct slug, labelled by the job with the lowest id."""
    return (
        jobs.select(F.col("id").alias("job_id"), value.alias("label"))
        .where(text.blank_to_null(F.col("label")).isNotNull())
        # Equal texts are folded first, so the costly slug runs once per distinct text.
        .groupBy("label")
        .agg(F.min("job_id").alias("job_id"))
        .groupBy(node_id(F.col("label")).alias("id"))
        .agg(F.min_by("label", "job_id").alias("label"))
        .select(
            "id",
            F.lit(kind).alias("type"),
            "label",
            F.to_json(F.struct(F.col("label").alias(field))).alias("data"),
        )
    )


def location_nodes(jobs: DataFrame) -> DataFrame:
    return _shared_nodes(jobs, "location", F.col("location_text"), ids.location_id, "location_text")


def role_family_nodes(jobs: DataFrame) -> DataFrame:
    return _shared_nodes(
        jobs, "role_family", _enriched(jobs, "role_family"), ids.role_family_id, "role_family"
    )


def _edges(df: DataFrame, source: Column, target: Column, kind: str, weight, confidence) -> DataFrame:
    ends = df.select(source.alias("source"), target.alias("target"), weight.alias("weight"),
                     confidence.alias("confidence"))
    return ends.select(
        ids.edge_id(F.col("source"), F.lit(kind), F.col("target")).alias("id"),
        "source",
        "target",
        F.lit(kind).alias("type"),
        "weight",
        "confidence",
        F.lit(None).cast("string").alias("data"),
    )


def posts_edges(jobs: DataFrame) -> DataFrame:
    return _edges(jobs, F.col("company_id"), F.col("id"), "POSTS", F.lit(1.0), F.lit(POSTS_CONFIDENCE))


def located_edges(jobs: DataFrame) -> DataFrame:
    placed = jobs.where(text.blank_to_null(F.col("location_text")).isNotNull())
    return _edges(
        placed, F.col("id"), ids.location_id(F.col("location_text")), "LOCATED_IN",
        F.lit(1.0), F.lit(LOCATED_CONFIDENCE),
    )


def family_edges(jobs: DataFrame) -> DataFrame:
    family = _enriched(jobs, "role_family")
    return _edges(
        jobs.where(text.blank_to_null(family).isNotNull()), F.col("id"), ids.role_family_id(family),
        "BELONGS_TO", F.lit(1.0), F.lit(FAMILY_CONFIDENCE),
    )


def known_job_skills(job_skills: DataFrame, jobs: DataFrame, skills: DataFrame) -> DataFrame:
    """Job-skill rows whose both ends exist, with the skill's label and the job's company,
    title and date, so that rankings need no second join; unused columns are pruned."""
    carried = jobs.select(F.col("id").alias("job_id"), "company_id", "title", "posted_at")
    return job_skills.join(
        skills.select(F.col("id").alias("skill_id"), F.col("label").alias("skill_label")), "skill_id"
    ).join(carried, "job_id")


def skill_edges(known: DataFrame) -> DataFrame:
    has_evidence = "evidence" in known.columns
    data = F.to_json(
        F.struct(
            (F.col("provenance") if "provenance" in known.columns else F.lit(None).cast("string")).alias(
                "provenance"
            ),
            (F.col("evidence") if has_evidence else F.array().cast("array<string>")).alias("evidence"),
        )
    )
    return known.select(
        ids.edge_id(F.col("job_id"), F.col("edge_type"), F.col("skill_id")).alias("id"),
        F.col("job_id").alias("source"),
        F.col("skill_id").alias("target"),
        F.col("edge_type").alias("type"),
        "weight",
        "confidence",
        data.alias("data"),
    )


def similar_edges(pairs: DataFrame) -> DataFrame:
    """Undirected kept pairs (job_a, job_b, score) -> SIMILAR_TO edges."""
    return _edges(pairs, F.col("job_a"), F.col("job_b"), "SIMILAR_TO", F.col("score"), F.col("score"))


def all_nodes(companies: DataFrame, skills: DataFrame, jobs: DataFrame) -> DataFrame:
    parts = [
        company_nodes(companies), skill_nodes(skills), job_nodes(jobs),
        location_nodes(jobs), role_family_nodes(jobs),
    ]
    return reduce(DataFrame.unionByName, parts)


def all_edges(jobs: DataFrame, known: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    parts = [posts_edges(jobs), located_edges(jobs), family_edges(jobs), skill_edges(known)]
    if pairs is not None:
        parts.append(similar_edges(pairs))
    return reduce(DataFrame.unionByName, parts)


# --- read models -----------------------------------------------------------


def company_jobs(jobs: DataFrame) -> DataFrame:
    """Rows (company_id, job_id); the order inside a company is the job id."""
    return jobs.select("company_id", F.col("id").alias("job_id"))


def skill_jobs(known: DataFrame) -> DataFrame:
    """Rows (skill_id, job_id), one per edge: a job may appear once per edge type."""
    return known.select("skill_id", "job_id", "edge_type")


def job_skills(known: DataFrame) -> DataFrame:
    return known.select(
        "job_id", "skill_id", F.col("skill_label").alias("label"), "edge_type", "weight", "confidence"
    )


def company_skill_stats(known: DataFrame) -> DataFrame:
    return known.groupBy("company_id", "skill_id").agg(F.count("*").alias("n"))


def degree(edges: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Edges touching a node; a self-loop counts twice. ``ids`` (id) limits the count to its nodes."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("id"))
    if ids is not None:
        ends = ends.join(ids.select("id"), "id", "left_semi")
    return ends.groupBy("id").agg(F.count("*").alias("degree"))


def adjacency(edges: DataFrame) -> DataFrame:
    """Both directions of every edge as (id, neighbor_id, direction, edge fields)."""
    carried = [F.col("id").alias("edge_id"), "type", "weight", "confidence"]
    out = edges.select(F.col("source").alias("id"), F.col("target").alias("neighbor_id"),
                       F.lit("out").alias("direction"), *carried)
    into = edges.select(F.col("target").alias("id"), F.col("source").alias("neighbor_id"),
                        F.lit("in").alias("direction"), *carried)
    return out.unionByName(into)


def incoming(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("target").alias("id"), F.col("source").alias("neighbor_id"),
                        F.col("id").alias("edge_id"), "type", "weight", "confidence")


def skill_companies(known: DataFrame) -> DataFrame:
    """Distinct companies of a skill's jobs, with the lowest job id that links them."""
    return known.groupBy("skill_id", "company_id").agg(F.min("job_id").alias("first_job"))


def facets(jobs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct filled remote modes, seniorities and node types as (facet, value)."""
    pairs = jobs.select(
        F.explode(
            F.array(
                F.struct(F.lit("remote_mode").alias("facet"), F.col("remote_mode").alias("value")),
                F.struct(F.lit("seniority").alias("facet"), _enriched(jobs, "seniority").alias("value")),
            )
        ).alias("p")
    ).select("p.*")
    types = nodes.select(F.lit("node_type").alias("facet"), F.col("type").alias("value"))
    return pairs.unionByName(types).where(text.blank_to_null(F.col("value")).isNotNull()).distinct()


def summary_counts(**tables: DataFrame) -> DataFrame:
    """One row per table name with its row count."""
    parts = [
        df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def search_index(companies: DataFrame, skills: DataFrame, jobs: DataFrame) -> DataFrame:
    """Documents of companies, skills and jobs; ``doc_rank`` and id give the index order."""

    def with_aliases(df: DataFrame, label: str) -> Column:
        aliases = F.col("aliases") if "aliases" in df.columns else F.array().cast("array<string>")
        return F.array_join(F.concat(F.array(F.col(label)), F.coalesce(aliases, F.array().cast("array<string>"))), " ")

    company_docs = companies.select(
        "id", F.lit("company").alias("type"), F.col("name").alias("title"),
        with_aliases(companies, "name").alias("text"), F.lit(0).alias("doc_rank"),
    )
    skill_docs = skills.select(
        "id", F.lit("skill").alias("type"), F.col("label").alias("title"),
        with_aliases(skills, "label").alias("text"), F.lit(1).alias("doc_rank"),
    )
    parts = [F.col("title"), F.col("company_name"), F.col("location_text")]
    parts += [_enriched(jobs, n) for n in ("summary", "role_family", "seniority")]
    job_docs = jobs.select(
        "id", F.lit("job").alias("type"), "title",
        F.concat_ws(" ", *[text.blank_to_null(p) for p in parts]).alias("text"),
        F.lit(2).alias("doc_rank"),
    )
    return company_docs.unionByName(skill_docs).unionByName(job_docs)
