"""Graph queries, answered for all nodes at once or for a small table of seeds."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..session import cut_lineage
from . import graph
from .ranking import newest_first, top_k, type_rank

CORE_TYPES = ["company", "job", "skill"]

# Sizes of the browse views.
OVERVIEW_NODES, FOCUSED_NODES, FOCUSED_MATCHES, FALLBACK_NODES = 2600, 600, 72, 220
ROOTS, CHILDREN, RESULTS = 120, 10, 120
PAGE_WITH_QUERY, PAGE_WITHOUT_QUERY, RELATED = 14, 10, 5


@dataclass(frozen=True)
class GraphTables:
    """The tables browse queries read.

    ``known`` are job-skill rows with skill label and company; ``neighbors`` the directed
    similarity lists; ``nodes`` and ``edges`` the property graph.
    """

    companies: DataFrame
    skills: DataFrame
    jobs: DataFrame
    known: DataFrame
    nodes: DataFrame
    edges: DataFrame
    search: DataFrame | None = None
    neighbors: DataFrame | None = None


# --- ordered lists ---------------------------------------------------------


def jobs_newest_first(jobs: DataFrame, limit: int | None = None) -> DataFrame:
    ordered = jobs.orderBy(*newest_first(tie="id"))
    return ordered if limit is None else ordered.limit(limit)


def _skill_order() -> list[Column]:
    return [
        F.when(F.col("edge_type") == "REQUIRES", 0).otherwise(1).asc(),
        F.col("skill_label").asc(),
        F.col("skill_id").asc(),
    ]


def ranked_job_skills(known: DataFrame, k: int = CHILDREN) -> DataFrame:
    """A job's skills, required ones first, then by label."""
    return top_k(known, ["job_id"], _skill_order(), k)


def company_top_skills(known: DataFrame, skills: DataFrame, k: int = 8) -> DataFrame:
    """Most frequent skills of every company, ties by label."""
    stats = graph.company_skill_stats(known).join(
        skills.select(F.col("id").alias("skill_id"), F.col("label").alias("skill_label")), "skill_id"
    )
    order = [F.col("n").desc(), F.col("skill_label").asc(), F.col("skill_id").asc()]
    return top_k(stats, ["company_id"], order, k)


def company_job_counts(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("company_id").agg(F.count("*").alias("jobs"))


def skill_top_companies(g: GraphTables, k: int = CHILDREN) -> DataFrame:
    """Companies hiring for a skill, the ones with most jobs (of any kind) first."""
    pairs = g.known.select("skill_id", "company_id").distinct()
    described = company_job_counts(g.jobs).join(
        g.companies.select(F.col("id").alias("company_id"), F.col("name").alias("company_name")),
        "company_id",
    )
    order = [F.col("jobs").desc(), F.col("company_name").asc(), F.col("company_id").asc()]
    return top_k(pairs.join(described, "company_id"), ["skill_id"], order, k)


def company_newest_jobs(jobs: DataFrame, k: int = CHILDREN) -> DataFrame:
    slim = jobs.select("company_id", F.col("id").alias("job_id"), "title", "posted_at")
    return top_k(slim, ["company_id"], newest_first(), k)


def skill_company_newest_jobs(g: GraphTables, k: int = CHILDREN) -> DataFrame:
    """Newest jobs of every (skill, company); ranked before any join on the company."""
    described = g.known.select("skill_id", "job_id", "company_id", "title", "posted_at").distinct()
    return top_k(described, ["skill_id", "company_id"], newest_first(), k)


# --- drill-down ------------------------------------------------------------


def drill_down(g: GraphTables, k: int = CHILDREN) -> DataFrame:
    """Skill -> its companies by job count -> their newest jobs with that skill; every level
    keeps ``k`` children per parent. The level below, a job's skills, is :func:`job_children`."""
    companies = skill_top_companies(g, k).select(
        "skill_id", "company_id", "company_name", F.col("jobs").alias("company_jobs"),
        F.col("rank").alias("company_rank"),
    )
    jobs = skill_company_newest_jobs(g, k).select(
        "skill_id", "company_id", "job_id", "title", "posted_at", F.col("rank").alias("job_rank")
    )
    return companies.join(jobs, ["skill_id", "company_id"])


def job_children(g: GraphTables, below_company: bool, k: int = CHILDREN) -> DataFrame:
    """Children of a job: its company unless already above it, then its skills, each once."""
    skills = ranked_job_skills(g.known, k).select(
        "job_id", F.col("skill_id").alias("child_id"), F.lit("skill").alias("child_type"),
        "edge_type", F.col("rank").alias("pos"),
    )
    children = skills
    if not below_company:
        own = g.jobs.select(F.col("id").alias("job_id"), F.col("company_id").alias("child_id")).join(
            g.companies.select(F.col("id").alias("child_id")), "child_id", "left_semi"
        )
        children = own.select(
            "job_id", "child_id", F.lit("company").alias("child_type"),
            F.lit("POSTS").alias("edge_type"), F.lit(0).cast("long").alias("pos"),
        ).unionByName(skills)
    once = children.groupBy("job_id", "child_id").agg(
        F.min_by(F.struct("child_type", "edge_type", "pos"), "pos").alias("c")
    ).select("job_id", "child_id", "c.*")
    return top_k(once, ["job_id"], [F.col("pos").asc()], k).drop("pos")


def edge_order(edges: DataFrame) -> Column:
    """Where an edge stands in the export: by job, then skill edges, then similar pairs."""
    kind = F.col("type")
    own_job = F.when(kind == "POSTS", F.col("target")).otherwise(F.col("source"))
    phase = (
        F.when(kind.isin("POSTS", "LOCATED_IN", "BELONGS_TO"), 0)
        .when(kind == "SIMILAR_TO", 2)
        .otherwise(1)
    )
    inner = (
        F.when(kind == "POSTS", "0").when(kind == "LOCATED_IN", "1").when(kind == "BELONGS_TO", "2")
        .otherwise(F.col("target"))
    )
    return F.struct(phase.alias("phase"), own_job.alias("a"), inner.alias("b"), kind.alias("c"))


def first_neighbors(g: GraphTables, k: int = CHILDREN, kinds=("location", "role_family")) -> DataFrame:
    """Raw neighbours in export order, for nodes without a richer view."""
    ordered = g.edges.withColumn("_ord", edge_order(g.edges))
    both = (
        ordered.select(F.col("source").alias("id"), F.col("target").alias("neighbor_id"), "type", "_ord")
        .unionByName(
            ordered.select(F.col("target").alias("id"), F.col("source").alias("neighbor_id"), "type", "_ord")
        )
        .withColumn("kind", F.substring_index("id", ":", 1))
        .where(F.col("kind").isin(*kinds))
    )
    return top_k(both, ["id"], [F.col("_ord").asc(), F.col("neighbor_id").asc()], k).drop("_ord")


# --- neighbourhoods --------------------------------------------------------


def job_neighborhoods(g: GraphTables, skills: int = 6, similar: int = 4) -> DataFrame:
    """Per job: its company, first skills, first similar jobs."""
    company = g.jobs.select(F.col("id").alias("center_id"), F.col("company_id").alias("node_id")).join(
        g.companies.select(F.col("id").alias("node_id")), "node_id", "left_semi"
    ).select("center_id", F.lit("company").alias("role"), F.lit(1).cast("long").alias("rank"), "node_id",
             F.lit("POSTS").alias("edge_type"))
    linked = ranked_job_skills(g.known, skills).select(
        F.col("job_id").alias("center_id"), F.lit("skill").alias("role"), "rank",
        F.col("skill_id").alias("node_id"), "edge_type",
    )
    parts = [company, linked]
    if g.neighbors is not None:
        parts.append(
            g.neighbors.where(F.col("rank") <= similar).select(
                F.col("job_id").alias("center_id"), F.lit("similar").alias("role"), "rank",
                F.col("other_id").alias("node_id"), F.lit("SIMILAR_TO").alias("edge_type"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def company_neighborhoods(g: GraphTables, jobs: int = 7, skills: int = 8) -> tuple[DataFrame, DataFrame]:
    """Per company: newest jobs and top skills; and the edges among exactly those."""
    newest = company_newest_jobs(g.jobs, jobs)
    top = company_top_skills(g.known, g.skills, skills)
    members = newest.select(
        F.col("company_id").alias("center_id"), F.lit("job").alias("role"), "rank",
        F.col("job_id").alias("node_id"),
    ).unionByName(
        top.select(F.col("company_id").alias("center_id"), F.lit("skill").alias("role"), "rank",
                   F.col("skill_id").alias("node_id"))
    )
    links = (
        g.known.select("company_id", "job_id", "skill_id", "edge_type", "weight", "confidence")
        .join(newest.select("company_id", "job_id"), ["company_id", "job_id"], "left_semi")
        .join(top.select("company_id", "skill_id"), ["company_id", "skill_id"], "left_semi")
    )
    return members, links


def skill_neighborhoods(g: GraphTables, jobs: int = 7, companies: int = 4) -> DataFrame:
    """Per skill: newest jobs (a job counts once per edge) and first companies."""
    linked = g.known.select("skill_id", "job_id", "edge_type", "title", "posted_at")
    newest = (
        top_k(linked, ["skill_id"], [*newest_first(), F.col("edge_type").asc()], jobs)
        .groupBy("skill_id", "job_id")
        .agg(F.min("rank").alias("rank"))
    )
    first = top_k(
        graph.skill_companies(g.known), ["skill_id"],
        [F.col("first_job").asc(), F.col("company_id").asc()], companies,
    )
    return newest.select(
        F.col("skill_id").alias("center_id"), F.lit("job").alias("role"), "rank",
        F.col("job_id").alias("node_id"),
    ).unionByName(
        first.select(F.col("skill_id").alias("center_id"), F.lit("company").alias("role"), "rank",
                     F.col("company_id").alias("node_id"))
    )


# --- search, expansion, subgraphs -------------------------------------------


def search(docs: DataFrame, query: str, kind: str | None = None, limit: int | None = FOCUSED_MATCHES) -> DataFrame:
    """Documents whose title, text, id or type contains the query, in index order."""
    haystack = F.lower(F.concat_ws(" ", *[text.blank_to_null(F.col(c)) for c in ("title", "text", "id", "type")]))
    hits = docs.where(F.contains(haystack, F.lit(query.strip().lower())))
    if kind:
        hits = hits.where(F.col("type") == kind)
    return hits if limit is None else hits.orderBy("doc_rank", "id").limit(limit)


def expand(
    g: GraphTables,
    seeds: DataFrame,
    hops: int = 1,
    cap: int | None = None,
    kind: str | None = None,
) -> DataFrame:
    """Seeds (id, pos) plus neighbours within ``hops``; with ``cap``, the first ones in
    (hop, seed position, export order)."""
    types = g.nodes.select(F.col("id").alias("neighbor_id"), F.col("type").alias("neighbor_type"))
    wanted = F.lit(True) if kind is None else F.col("neighbor_type").isin(kind, *CORE_TYPES)
    ordered = g.edges.select("source", "target", edge_order(g.edges).alias("_ord"))
    adjacent = ordered.select(
        F.col("source").alias("id"), F.col("target").alias("neighbor_id"), "_ord"
    ).unionByName(ordered.select(F.col("target").alias("id"), F.col("source").alias("neighbor_id"), "_ord"))
    none = F.lit(None).cast("struct<phase:int,a:string,b:string,c:string>")
    reached = cut_lineage(
        g.nodes.select("id").join(seeds.select("id", "pos"), "id").select(
            "id", F.struct(F.lit(0).alias("hop"), F.col("pos").cast("long").alias("pos"), none.alias("o")).alias("at")
        )
    )
    frontier = reached
    # Level by level: a hop reads the stored frontier alone, and nodes are ordered by hop first,
    # so none that a full hop leaves out could come in later, nor anything behind it.
    room = None if cap is None else cap - reached.count()
    for hop in range(1, hops + 1):
        if room is not None and room <= 0:
            break
        nearer = (
            adjacent.join(frontier, "id")
            .groupBy("neighbor_id")
            .agg(F.min(F.struct(F.lit(hop).alias("hop"), F.col("at.pos").alias("pos"), F.col("_ord").alias("o"))).alias("at"))
            .join(types, "neighbor_id")
            .where(wanted)
            .select(F.col("neighbor_id").alias("id"), "at")
        )
        new = nearer.join(reached.select("id"), "id", "left_anti")
        frontier = cut_lineage(new if room is None else new.orderBy("at", "id").limit(room))
        if hop < hops or room is not None:
            found = frontier.count()
            room = None if room is None else room - found
        reached = reached.unionByName(frontier)
    if cap is not None:
        reached = reached.orderBy("at", "id").limit(cap)
    return reached.select("id", F.col("at.hop").alias("hop"))


def node_subtitle(g: GraphTables, nodes: DataFrame) -> DataFrame:
    names = g.jobs.select("id", F.col("company_name").alias("_company"))
    categories = g.skills.select("id", F.col("category").alias("_category"))
    return (
        nodes.join(names, "id", "left")
        .join(categories, "id", "left")
        .withColumn(
            "subtitle",
            F.when(F.col("type") == "job", F.coalesce(text.blank_to_null(F.col("_company")), F.lit("Job")))
            .when(F.col("type") == "company", "Company")
            .when(F.col("type") == "skill", F.coalesce(text.blank_to_null(F.col("_category")), F.lit("Skill")))
            .when(F.col("type") == "location", "Location")
            .when(F.col("type") == "role_family", "Role family")
            .otherwise(F.initcap(F.regexp_replace("type", "[_-]+", " "))),
        )
        .drop("_company", "_category")
    )


def induced_subgraph(g: GraphTables, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of ``wanted`` (id) with degree and subtitle, and the edges between them."""
    ids = wanted.select("id").distinct()
    nodes = node_subtitle(g, g.nodes.select("id", "type", "label").join(ids, "id", "left_semi"))
    nodes = nodes.join(graph.degree(g.edges, ids), "id", "left").withColumn(
        "degree", F.coalesce("degree", F.lit(0).cast("long"))
    )
    edges = (
        g.edges.select("id", "source", "target", "type", "weight", "confidence")
        .join(ids.select(F.col("id").alias("source")), "source", "left_semi")
        .join(ids.select(F.col("id").alias("target")), "target", "left_semi")
    )
    return nodes, edges


def with_degree(g: GraphTables, nodes: DataFrame) -> DataFrame:
    return nodes.join(graph.degree(g.edges), "id", "left").withColumn(
        "degree", F.coalesce("degree", F.lit(0).cast("long"))
    )


def overview_nodes(g: GraphTables, kinds=CORE_TYPES, limit: int = OVERVIEW_NODES) -> DataFrame:
    """Best connected nodes first, then type rank, then label."""
    typed = g.nodes.select("id", "type", "label").where(F.col("type").isin(*kinds))
    return (
        with_degree(g, typed)
        .orderBy(F.col("degree").desc(), type_rank(F.col("type")), F.col("label"), F.col("id"))
        .limit(limit)
    )


def focused_nodes(
    g: GraphTables, query: str = "", kind: str | None = None, selected: str | None = None
) -> DataFrame:
    """Search hits (or the best connected nodes of a type), the selected node first,
    with their direct neighbours, at most ``FOCUSED_NODES``."""
    if query:
        hits = search(g.search, query, kind).select(
            "id", F.row_number().over(_order(["doc_rank", "id"])).cast("long").alias("pos")
        )
    elif kind:
        hits = (
            with_degree(g, g.nodes.select("id", "type").where(F.col("type") == kind))
            .orderBy(F.col("degree").desc(), F.col("id"))
            .limit(FOCUSED_MATCHES)
            .select("id", F.row_number().over(_order([F.col("degree").desc(), "id"])).cast("long").alias("pos"))
        )
    else:
        hits = g.nodes.select("id", F.lit(1).cast("long").alias("pos")).limit(0)
    if selected:
        first = g.nodes.where(F.col("id") == selected).select("id", F.lit(0).cast("long").alias("pos"))
        hits = hits.unionByName(first.join(hits.select("id"), "id", "left_anti"))
    # A handful of rows that the expansion reads several times.
    return expand(g, cut_lineage(hits), 1, FOCUSED_NODES, kind).select("id")


def _order(columns):
    from pyspark.sql import Window

    # Only ever applied to an already limited handful of rows.
    return Window.orderBy(*columns)


def settled(g: GraphTables) -> GraphTables:
    """The graph with its nodes and edges stored once, for views that read them several times."""
    return replace(
        g,
        nodes=cut_lineage(g.nodes.select("id", "type", "label")),
        edges=cut_lineage(g.edges.select("id", "source", "target", "type", "weight", "confidence")),
    )


def overview(
    g: GraphTables, query: str = "", kind: str | None = None, selected: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """The graph view for a filter: focused when anything is set, the default otherwise."""
    query = query.strip().lower()
    g = settled(g)
    if query or kind or selected:
        ids, limit = focused_nodes(g, query, kind, selected), FOCUSED_NODES
    else:
        ids, limit = overview_nodes(g).select("id"), OVERVIEW_NODES
    ids = cut_lineage(ids)  # at most ``limit`` rows, read for nodes and for edges
    if ids.isEmpty():
        ids = overview_nodes(g, limit=min(limit, FALLBACK_NODES)).select("id")
    if selected:
        own = g.nodes.where(F.col("id") == selected).select("id", F.lit(1).cast("long").alias("pos"))
        ids = ids.unionByName(expand(g, own, 1, limit).select("id")).distinct()
    return induced_subgraph(g, ids)


def search_results(nodes: DataFrame, selected: str | None = None, limit: int = RESULTS) -> DataFrame:
    """Result list of a view: selected first, then type rank, degree, label."""
    chosen = F.when(F.col("id") == F.lit(selected), 0).otherwise(1)
    return nodes.orderBy(
        chosen, type_rank(F.col("type")), F.col("degree").desc(), F.col("label"), F.col("id")
    ).limit(limit)


def result_page(results: DataFrame, query: str, allowed: list[str] | None) -> tuple[DataFrame, DataFrame]:
    """First page of results of the wanted types, and a few related ones of other types."""
    order = [type_rank(F.col("type")), F.col("degree").desc(), F.col("label"), F.col("id")]
    size, extra = (PAGE_WITH_QUERY, RELATED) if query else (PAGE_WITHOUT_QUERY, 0)
    if not allowed:
        return results.orderBy(*order).limit(size), results.limit(0)
    fits = F.col("type").isin(*allowed)
    return results.where(fits).orderBy(*order).limit(size), results.where(~fits).orderBy(*order).limit(extra)


# --- roots, pages, lookup ----------------------------------------------------


def roots(g: GraphTables, kind: str, query: str = "", limit: int = ROOTS, pinned: str | None = None) -> DataFrame:
    """Top-level nodes of one kind (id, label, subtitle, degree, pos)."""
    if kind == "skill":
        counts = g.known.groupBy(F.col("skill_id").alias("id")).agg(F.count("*").alias("degree"))
        items = g.skills.select("id", "label", F.coalesce(text.blank_to_null(F.col("category")), F.lit("Skill")).alias("subtitle"))
    elif kind == "company":
        counts = g.jobs.groupBy(F.col("company_id").alias("id")).agg(F.count("*").alias("degree"))
        industry = F.col("industry") if "industry" in g.companies.columns else F.lit(None).cast("string")
        items = g.companies.select("id", F.col("name").alias("label"),
                                   F.coalesce(text.blank_to_null(industry), F.lit("Company")).alias("subtitle"))
    else:
        counts = g.known.groupBy(F.col("job_id").alias("id")).agg(F.count("*").alias("degree"))
        items = g.jobs.select("id", F.col("title").alias("label"),
                              F.coalesce(text.blank_to_null(F.col("company_name")), F.lit("Job")).alias("subtitle"),
                              F.coalesce("posted_at", F.lit("")).alias("day"))
    if query:
        haystack = F.lower(F.concat_ws(" ", *[text.blank_to_null(F.col(c)) for c in ("label", "subtitle", "id")]))
        items = items.where(F.contains(haystack, F.lit(query.strip().lower())))
    items = items.join(counts, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0).cast("long")))
    order = [F.col("degree").desc(), F.col("label").asc(), F.col("id").asc()]
    if kind == "job":
        order.insert(0, F.col("day").desc())
    picked = items.orderBy(*order).limit(limit)
    ranked = picked.select("id", "label", "subtitle", "degree",
                           F.row_number().over(_order(order)).cast("long").alias("pos"))
    if not pinned:
        return ranked
    node = node_subtitle(g, g.nodes.select("id", "type", "label").where(F.col("id") == pinned))
    extra = with_degree(g, node).select("id", "label", "subtitle", "degree", F.lit(0).cast("long").alias("pos"))
    both = ranked.unionByName(extra.join(ranked.select("id"), "id", "left_anti"))
    return both.orderBy("pos").limit(limit)


def company_pages(g: GraphTables, top: int = 8) -> DataFrame:
    """Open roles, shown skills and distinct locations per company."""
    place = F.coalesce(text.blank_to_null(F.col("location_text")), F.lit("Unknown"))
    by_place = g.jobs.groupBy("company_id", place.alias("place")).agg(F.count("*").alias("n"))
    roles = by_place.groupBy("company_id").agg(
        F.sum("n").alias("open_roles"), F.count("*").alias("locations")
    )
    skills = (
        g.known.select("company_id", "skill_id").distinct().groupBy("company_id")
        .agg(F.least(F.count("*"), F.lit(top)).cast("long").alias("top_skills"))
    )
    return (
        g.companies.select(F.col("id").alias("company_id"), "name")
        .join(roles, "company_id", "left")
        .join(skills, "company_id", "left")
        .na.fill(0, ["open_roles", "locations", "top_skills"])
    )


def skill_pages(g: GraphTables) -> DataFrame:
    """Jobs, companies, required and preferred jobs per skill; a job counts once per edge."""
    per_job = g.known.groupBy("skill_id", "company_id", "job_id").agg(
        F.count("*").alias("n"),
        F.max(F.when(F.col("edge_type") == "REQUIRES", 1).otherwise(0)).alias("req"),
        F.max(F.when(F.col("edge_type") == "PREFERS", 1).otherwise(0)).alias("pref"),
    )
    per_company = per_job.groupBy("skill_id", "company_id").agg(
        F.sum("n").alias("jobs"),
        F.sum(F.col("n") * F.col("req")).alias("required_jobs"),
        F.sum(F.col("n") * F.col("pref")).alias("preferred_jobs"),
    )
    counts = per_company.groupBy("skill_id").agg(
        F.sum("jobs").alias("jobs"),
        F.count("*").alias("companies"),
        F.sum("required_jobs").alias("required_jobs"),
        F.sum("preferred_jobs").alias("preferred_jobs"),
    )
    return (
        g.skills.select(F.col("id").alias("skill_id"), "label")
        .join(counts, "skill_id", "left")
        .na.fill(0, ["jobs", "companies", "required_jobs", "preferred_jobs"])
    )


def lookup(g: GraphTables, wanted: DataFrame) -> DataFrame:
    """Requested ids with kind and label; unknown ids stay, marked as missing."""
    prefix = F.substring_index("id", ":", 1)
    kind = F.when(prefix.isin(*CORE_TYPES), prefix).otherwise("graph")
    found = g.nodes.select("id", "label", F.lit(True).alias("_found"))
    return (
        wanted.select("id")
        .join(found, "id", "left")
        .select("id", kind.alias("kind"), "label", F.col("_found").isNull().alias("missing"))
    )
