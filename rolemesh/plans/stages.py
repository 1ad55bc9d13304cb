"""The batch stages as functions from tables to tables.

Each stage ends in a stored table, so a later stage (or a rerun) starts from files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import dedupe, enrich, graph, similarity
from ..operators.browse import GraphTables
from ..operators.vocabulary import Rules, Skill


def normalize_stage(
    raw: DataFrame, aliases: DataFrame, rules: Rules = Rules()
) -> dict[str, DataFrame]:
    """Raw postings (with raw_id) -> companies and jobs."""
    normalized = dedupe.normalize_jobs(raw, aliases, rules.remote, rules.employment)
    return {
        "companies": dedupe.upsert_companies(normalized),
        "jobs": dedupe.upsert_jobs(normalized),
    }


def enrich_stage(
    jobs: DataFrame,
    taxonomy: list[Skill],
    rules: Rules = Rules(),
    stored: DataFrame | None = None,
    limit: int | None = None,
) -> dict[str, DataFrame]:
    """Jobs without a stored enrichment -> enrichment rows, skills and job-skill edges."""
    todo = enrich.pending_jobs(jobs, stored, limit)
    return enrich.store_results(enrich.enrich(todo, taxonomy, rules))


def graph_stage(
    companies: DataFrame,
    jobs: DataFrame,
    skills: DataFrame,
    job_skills: DataFrame,
    enrichment: DataFrame | None = None,
) -> GraphTables:
    """Entity tables -> graph, similarity lists and search index."""
    public = graph.hydrate_jobs(jobs, enrichment, companies)
    if "enrichment" in public.columns:
        for name in ("role_family", "seniority", "summary"):
            public = public.withColumn(name, F.col("enrichment")[name])
    known = graph.known_job_skills(job_skills, public, skills)
    neighbors = similarity.similar_top_k(known)
    pairs = similarity.kept_pairs(neighbors)
    return GraphTables(
        companies=companies,
        skills=skills,
        jobs=public,
        known=known,
        nodes=graph.all_nodes(companies, skills, public),
        edges=graph.all_edges(public, known, pairs),
        search=graph.search_index(companies, skills, public),
        neighbors=neighbors,
    )


def read_models(g: GraphTables) -> dict[str, DataFrame]:
    """Every exported table, by name."""
    return {
        "jobs": g.jobs,
        "companies": g.companies,
        "skills": g.skills,
        "nodes": g.nodes,
        "edges": g.edges,
        "company_jobs": graph.company_jobs(g.jobs),
        "skill_jobs": graph.skill_jobs(g.known),
        "job_skills": graph.job_skills(g.known),
        "company_skill_stats": graph.company_skill_stats(g.known),
        "job_neighbors": similarity.job_neighbors(
            g.known.withColumnRenamed("skill_label", "label"), g.jobs, g.neighbors
        ),
        "search_index": g.search,
        "summary": graph.summary_counts(
            companies=g.companies, jobs=g.jobs, skills=g.skills, nodes=g.nodes, edges=g.edges
        ),
    }
