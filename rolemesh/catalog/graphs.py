"""Graph tables, read models and similarity over orders, line items and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, similarity
from ..plans import standins
from ..plans.standins import graph_tables
from .registry import query
from .sql import DEGREES, GRAPH, NODES, SIMILAR, edges, with_

PLAIN = with_(GRAPH)
FULL = with_(GRAPH, SIMILAR, edges(True))
EDGES = with_(GRAPH, edges(False))


@query("graph_nodes", with_(GRAPH, NODES) + "SELECT id, type, label FROM nodes")
def graph_nodes(spark, sf):
    return graph_tables(spark, sf).nodes.select("id", "type", "label")


@query("job_node_fields", PLAIN + """
SELECT id, title, company_id, company_name, location_text, seniority, role_family, posted_at FROM jobs""")
def job_node_fields(spark, sf):
    data = "struct<id:string,title:string,company_id:string,company_name:string,location_text:string,seniority:string,role_family:string,posted_at:string>"
    nodes = graph.job_nodes(standins.jobs(spark, sf))
    return nodes.select(F.from_json("data", data).alias("d")).select("d.*")


@query("location_nodes", with_(GRAPH, NODES) + "SELECT id, label FROM nodes WHERE type = 'location'")
def location_nodes(spark, sf):
    return graph.location_nodes(standins.jobs(spark, sf)).select("id", "label")


@query("role_family_nodes", with_(GRAPH, NODES) + "SELECT id, label FROM nodes WHERE type = 'role_family'")
def role_family_nodes(spark, sf):
    return graph.role_family_nodes(standins.jobs(spark, sf)).select("id", "label")


@query("posts_edges", EDGES + "SELECT * FROM edges WHERE type = 'POSTS'")
def posts_edges(spark, sf):
    return graph.posts_edges(standins.jobs(spark, sf)).drop("data")


@query("located_in_edges", EDGES + "SELECT * FROM edges WHERE type = 'LOCATED_IN'")
def located_in_edges(spark, sf):
    return graph.located_edges(standins.jobs(spark, sf)).drop("data")


@query("belongs_to_edges", EDGES + "SELECT * FROM edges WHERE type = 'BELONGS_TO'")
def belongs_to_edges(spark, sf):
    return graph.family_edges(standins.jobs(spark, sf)).drop("data")


@query("skill_edges", EDGES + "SELECT * FROM edges WHERE type IN ('REQUIRES', 'PREFERS')")
def skill_edges(spark, sf):
    return graph.skill_edges(standins.known(spark, sf)).drop("data")


@query("similar_to_edges", FULL + "SELECT * FROM edges WHERE type = 'SIMILAR_TO'")
def similar_to_edges(spark, sf):
    pairs = similarity.kept_pairs(standins.neighbors(spark, sf))
    return graph.similar_edges(pairs).drop("data")


@query("graph_edges", FULL + "SELECT * FROM edges")
def graph_edges(spark, sf):
    return graph_tables(spark, sf, similar=True).edges.drop("data")


@query("orphan_free_job_skills", PLAIN + "SELECT job_id, skill_id, edge_type, skill_label, company_id FROM known")
def orphan_free_job_skills(spark, sf):
    return standins.known(spark, sf).select("job_id", "skill_id", "edge_type", "skill_label", "company_id")


# --- similarity --------------------------------------------------------------


@query("similar_top_k", with_(GRAPH, SIMILAR) + "SELECT job_id, other_id, rank, i, u, score FROM neighbors")
def similar_top_k(spark, sf):
    return standins.neighbors(spark, sf)


@query("similar_kept_pairs", with_(GRAPH, SIMILAR) + "SELECT job_a, job_b, score FROM kept")
def similar_kept_pairs(spark, sf):
    return similarity.kept_pairs(standins.neighbors(spark, sf))


@query("similar_top_k_hot_skills", with_(GRAPH, SIMILAR) + "SELECT job_id, other_id, rank, i, u, score FROM neighbors")
def similar_top_k_hot_skills(spark, sf):
    """The same answer by rounds from the highest level on, with lists cut into blocks of 20."""
    return similarity.similar_top_k(standins.known(spark, sf), start=0, block=20)


DENSE = """
known AS (
  SELECT DISTINCT 'c' || o_custkey AS job_id, unnest([p_brand, o_orderpriority, l_returnflag, l_linestatus]) AS skill_id
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey)
"""


@query("similar_top_k_dense_skills", with_(DENSE, SIMILAR) + "SELECT job_id, other_id, rank, i, u, score FROM neighbors")
def similar_top_k_dense_skills(spark, sf):
    """Customers by the brands, priorities and states of what they buy: 35 skills, all of them hot."""
    lines = standins.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag", "l_linestatus")
    orders = standins.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    parts = standins.table(spark, sf, "part").select("p_partkey", "p_brand")
    bought = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    held = bought.select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("job_id"),
        F.explode(F.array("p_brand", "o_orderpriority", "l_returnflag", "l_linestatus")).alias("skill_id"),
    )
    return similarity.similar_top_k(held)


@query("jaccard_of_brands", """
WITH b AS (SELECT l_suppkey, list(DISTINCT p_brand) AS brands FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1),
o AS (SELECT s_suppkey, s_nationkey FROM supplier),
r AS (SELECT s_nationkey, list(DISTINCT p_brand) AS common FROM lineitem JOIN part ON p_partkey = l_partkey
      JOIN supplier ON s_suppkey = l_suppkey WHERE l_returnflag = 'R' GROUP BY 1)
SELECT b.l_suppkey, round_even(len(list_intersect(brands, common))::DOUBLE
       / len(list_distinct(list_concat(brands, common))), 4) AS score
FROM b JOIN o ON b.l_suppkey = o.s_suppkey JOIN r USING (s_nationkey)""")
def jaccard_of_brands(spark, sf):
    """Array Jaccard: a supplier's brands against the returned brands of its nation."""
    lines = standins.table(spark, sf, "lineitem").join(
        standins.table(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey")
    )
    s = standins.table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    brands = lines.groupBy("l_suppkey").agg(F.collect_set("p_brand").alias("brands"))
    common = (
        lines.where(F.col("l_returnflag") == "R")
        .join(s, F.col("s_suppkey") == F.col("l_suppkey"))
        .groupBy("s_nationkey")
        .agg(F.collect_set("p_brand").alias("common"))
    )
    joined = brands.join(s, F.col("s_suppkey") == F.col("l_suppkey")).join(common, "s_nationkey")
    score = F.bround(similarity.jaccard(F.col("brands"), F.col("common")), 4)
    return joined.select("l_suppkey", score.alias("score"))


@query("job_neighbors", with_(GRAPH, SIMILAR) + """
SELECT k.job_id, any_value(k.company_id) AS company_id, count(*) AS skills,
       string_agg(k.skill_id || '/' || k.edge_type, ' ' ORDER BY k.skill_id, k.edge_type) AS skill_list,
       coalesce(any_value(n.similar), '') AS similar
FROM known k LEFT JOIN (SELECT job_id, string_agg(other_id, ' ' ORDER BY rank) AS similar FROM neighbors GROUP BY 1) n
  ON n.job_id = k.job_id
GROUP BY k.job_id""")
def job_neighbors(spark, sf):
    k = standins.known(spark, sf)
    out = similarity.job_neighbors(
        k.withColumnRenamed("skill_label", "label"), standins.jobs(spark, sf), similarity.similar_top_k(k)
    )
    return out.select(
        "job_id",
        "company_id",
        F.size("skills").cast("long").alias("skills"),
        F.array_join(F.transform("skills", lambda s: F.concat_ws("/", s["skill_id"], s["edge_type"])), " ").alias("skill_list"),
        F.array_join(F.transform("similar_jobs", lambda s: s["job_id"]), " ").alias("similar"),
    )


# --- read models -------------------------------------------------------------


@query("company_jobs", PLAIN + "SELECT company_id, id AS job_id FROM jobs")
def company_jobs(spark, sf):
    return graph.company_jobs(standins.jobs(spark, sf))


@query("skill_jobs", PLAIN + "SELECT skill_id, job_id, edge_type FROM known")
def skill_jobs(spark, sf):
    return graph.skill_jobs(standins.known(spark, sf))


@query("job_skills", PLAIN + "SELECT job_id, skill_id, skill_label AS label, edge_type, weight, confidence FROM known")
def job_skills(spark, sf):
    return graph.job_skills(standins.known(spark, sf))


@query("company_skill_stats", PLAIN + "SELECT company_id, skill_id, count(*) AS n FROM known GROUP BY ALL")
def company_skill_stats(spark, sf):
    return graph.company_skill_stats(standins.known(spark, sf))


@query("node_degree", with_(GRAPH, edges(False), DEGREES) + "SELECT id, degree FROM degrees")
def node_degree(spark, sf):
    return graph.degree(graph_tables(spark, sf).edges)


@query("adjacency", EDGES + """
SELECT source AS id, target AS neighbor_id, 'out' AS direction, id AS edge_id, type, weight, confidence FROM edges
UNION ALL SELECT target, source, 'in', id, type, weight, confidence FROM edges""")
def adjacency(spark, sf):
    return graph.adjacency(graph_tables(spark, sf).edges)


@query("incoming_edges", EDGES + "SELECT target AS id, source AS neighbor_id, id AS edge_id, type, weight, confidence FROM edges")
def incoming_edges(spark, sf):
    return graph.incoming(graph_tables(spark, sf).edges)


@query("skill_companies", PLAIN + "SELECT skill_id, company_id, min(job_id) AS first_job FROM known GROUP BY ALL")
def skill_companies(spark, sf):
    return graph.skill_companies(standins.known(spark, sf))


@query("facets", with_(GRAPH, NODES) + """
SELECT DISTINCT 'remote_mode' AS facet, remote_mode AS value FROM jobs WHERE remote_mode <> ''
UNION SELECT DISTINCT 'seniority', seniority FROM jobs WHERE seniority <> ''
UNION SELECT DISTINCT 'node_type', type FROM nodes""")
def facets(spark, sf):
    g = graph_tables(spark, sf)
    return graph.facets(g.jobs, g.nodes)


@query("summary_counts", with_(GRAPH, SIMILAR, edges(True), NODES) + """
SELECT 'companies' AS name, count(*) AS n FROM companies UNION ALL SELECT 'jobs', count(*) FROM jobs
UNION ALL SELECT 'skills', count(*) FROM skills UNION ALL SELECT 'nodes', count(*) FROM nodes
UNION ALL SELECT 'edges', count(*) FROM edges""")
def summary_counts(spark, sf):
    g = graph_tables(spark, sf, similar=True)
    return graph.summary_counts(
        companies=g.companies, jobs=g.jobs, skills=g.skills, nodes=g.nodes, edges=g.edges
    )


SEARCH = """
docs AS (
  SELECT id, 'company' AS type, name AS title, name AS text, 0 AS doc_rank FROM companies
  UNION ALL SELECT id, 'skill', label, label, 1 FROM skills
  UNION ALL SELECT id, 'job', title, concat_ws(' ', title, company_name, location_text, role_family, seniority), 2 FROM jobs)
"""


@query("search_index", with_(GRAPH, SEARCH) + "SELECT id, type, title, text FROM docs")
def search_index(spark, sf):
    return graph_tables(spark, sf).search.select("id", "type", "title", "text")


@query("hydrated_jobs", PLAIN + """
SELECT j.id, j.company_id, coalesce(c.name, j.company_id) AS company_name, j.title, j.posted_at
FROM jobs j LEFT JOIN companies c ON c.id = j.company_id AND c.industry <> 'BUILDING'""")
def hydrated_jobs(spark, sf):
    """Jobs whose company row is missing fall back to the company id."""
    some = standins.companies(spark, sf).where(F.col("industry") != "BUILDING")
    out = graph.hydrate_jobs(standins.jobs(spark, sf), None, some)
    return out.select("id", "company_id", "company_name", "title", "posted_at")
