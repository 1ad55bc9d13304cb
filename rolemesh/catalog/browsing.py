"""Ordered lists, drill-down, neighbourhoods, search and pages over the graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import browse, enrich
from ..plans import standins
from ..plans.standins import graph_tables
from .graphs import SEARCH
from .registry import query
from .sql import DEGREES, GRAPH, NODES, SIMILAR, TYPE_RANK, edges, with_

PLAIN = with_(GRAPH)
VIEW = with_(GRAPH, edges(False), NODES, DEGREES)

SKILL_ORDER = "CASE WHEN edge_type = 'REQUIRES' THEN 0 ELSE 1 END, skill_label, skill_id"
NEWEST = "coalesce(posted_at, '') DESC, title, job_id"

TOP_SKILLS = """
top_skills AS (
  SELECT company_id, skill_id, n, row_number() OVER (PARTITION BY company_id ORDER BY n DESC, label, skill_id) AS rank
  FROM (SELECT company_id, skill_id, count(*) AS n FROM known GROUP BY ALL) k JOIN skills s ON s.id = k.skill_id)
"""
COMPANY_COUNTS = "counts AS (SELECT company_id, count(*) AS jobs FROM jobs GROUP BY 1)"
TOP_COMPANIES = """
top_companies AS (
  SELECT p.skill_id, p.company_id, c.name AS company_name, n.jobs,
         row_number() OVER (PARTITION BY p.skill_id ORDER BY n.jobs DESC, c.name, p.company_id) AS rank
  FROM (SELECT DISTINCT skill_id, company_id FROM known) p
  JOIN counts n USING (company_id) JOIN companies c ON c.id = p.company_id QUALIFY rank <= 10)
"""
PAIR_JOBS = f"""
pair_jobs AS (
  SELECT skill_id, company_id, job_id, title, posted_at,
         row_number() OVER (PARTITION BY skill_id, company_id ORDER BY {NEWEST}) AS rank
  FROM (SELECT DISTINCT k.skill_id, k.job_id, j.company_id, j.title, j.posted_at
        FROM known k JOIN jobs j ON j.id = k.job_id) QUALIFY rank <= 10)
"""


@query("pending_jobs_first_100", PLAIN + """
SELECT id, title FROM jobs WHERE id NOT IN (SELECT id FROM jobs WHERE seniority = 'F') ORDER BY id LIMIT 100""")
def pending_jobs_first_100(spark, sf):
    jobs = standins.jobs(spark, sf)
    done = jobs.where(F.col("seniority") == "F").select(F.col("id").alias("job_id"))
    return enrich.pending_jobs(jobs, done, limit=100).select("id", "title")


@query("jobs_newest_first", PLAIN + """
SELECT id, title, posted_at FROM jobs ORDER BY coalesce(posted_at, '') DESC, title, id""")
def jobs_newest_first(spark, sf):
    return browse.jobs_newest_first(standins.jobs(spark, sf)).select("id", "title", "posted_at")


@query("job_skill_ranking", PLAIN + f"""
SELECT job_id, skill_id, edge_type, row_number() OVER (PARTITION BY job_id ORDER BY {SKILL_ORDER}) AS rank
FROM known QUALIFY rank <= 10""")
def job_skill_ranking(spark, sf):
    return browse.ranked_job_skills(standins.known(spark, sf)).select("job_id", "skill_id", "edge_type", "rank")


@query("company_top_skills", with_(GRAPH, TOP_SKILLS) + "SELECT * FROM top_skills WHERE rank <= 8")
def company_top_skills(spark, sf):
    return browse.company_top_skills(standins.known(spark, sf), standins.skills(spark, sf)).drop("skill_label")


@query("company_job_counts", with_(GRAPH, COMPANY_COUNTS) + "SELECT * FROM counts")
def company_job_counts(spark, sf):
    return browse.company_job_counts(standins.jobs(spark, sf))


@query("skill_top_companies", with_(GRAPH, COMPANY_COUNTS, TOP_COMPANIES) + "SELECT * FROM top_companies")
def skill_top_companies(spark, sf):
    return browse.skill_top_companies(graph_tables(spark, sf))


@query("company_newest_jobs", PLAIN + """
SELECT company_id, id AS job_id, title, posted_at,
       row_number() OVER (PARTITION BY company_id ORDER BY coalesce(posted_at, '') DESC, title, id) AS rank
FROM jobs QUALIFY rank <= 10""")
def company_newest_jobs(spark, sf):
    return browse.company_newest_jobs(standins.jobs(spark, sf))


@query("skill_company_newest_jobs", with_(GRAPH, PAIR_JOBS) + "SELECT * FROM pair_jobs")
def skill_company_newest_jobs(spark, sf):
    return browse.skill_company_newest_jobs(graph_tables(spark, sf))


DRILL = with_(GRAPH, COMPANY_COUNTS, TOP_COMPANIES, PAIR_JOBS) + """
SELECT c.skill_id, c.company_id, c.company_name, c.jobs AS company_jobs, c.rank AS company_rank,
       p.job_id, p.title, p.posted_at, p.rank AS job_rank
FROM top_companies c JOIN pair_jobs p USING (skill_id, company_id)"""


@query("drill_down", DRILL)
def drill_down(spark, sf):
    return browse.drill_down(graph_tables(spark, sf))


@query("job_children_below_company", PLAIN + f"""
SELECT job_id, child_id, child_type, edge_type, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY pos) AS rank FROM (
    SELECT job_id, skill_id AS child_id, 'skill' AS child_type, edge_type, pos FROM (
      SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY {SKILL_ORDER}) AS pos FROM known QUALIFY pos <= 10)
    QUALIFY row_number() OVER (PARTITION BY job_id, skill_id ORDER BY pos) = 1))
WHERE rank <= 10""")
def job_children_below_company(spark, sf):
    return browse.job_children(graph_tables(spark, sf), below_company=True)


@query("job_children_as_root", PLAIN + f"""
SELECT job_id, child_id, child_type, edge_type, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY pos) AS rank FROM (
    SELECT * FROM (
      SELECT id AS job_id, company_id AS child_id, 'company' AS child_type, 'POSTS' AS edge_type, 0 AS pos
      FROM jobs WHERE company_id IN (SELECT id FROM companies)
      UNION ALL
      SELECT job_id, skill_id, 'skill', edge_type, row_number() OVER (PARTITION BY job_id ORDER BY {SKILL_ORDER}) AS pos
      FROM known QUALIFY pos <= 10)
    QUALIFY row_number() OVER (PARTITION BY job_id, child_id ORDER BY pos) = 1))
WHERE rank <= 10""")
def job_children_as_root(spark, sf):
    return browse.job_children(graph_tables(spark, sf), below_company=False)


@query("first_neighbors_of_places", with_(GRAPH, edges(False)) + """
SELECT id, neighbor_id, type, split_part(id, ':', 1) AS kind,
       row_number() OVER (PARTITION BY id ORDER BY neighbor_id) AS rank
FROM (SELECT target AS id, source AS neighbor_id, type FROM edges WHERE type IN ('LOCATED_IN', 'BELONGS_TO'))
QUALIFY rank <= 10""")
def first_neighbors_of_places(spark, sf):
    return browse.first_neighbors(graph_tables(spark, sf))


@query("job_neighborhoods", with_(GRAPH, SIMILAR) + f"""
SELECT id AS center_id, 'company' AS role, 1 AS rank, company_id AS node_id, 'POSTS' AS edge_type
FROM jobs WHERE company_id IN (SELECT id FROM companies)
UNION ALL
SELECT job_id, 'skill', row_number() OVER (PARTITION BY job_id ORDER BY {SKILL_ORDER}) AS r, skill_id, edge_type
FROM known QUALIFY r <= 6
UNION ALL
SELECT job_id, 'similar', rank, other_id, 'SIMILAR_TO' FROM neighbors WHERE rank <= 4""")
def job_neighborhoods(spark, sf):
    return browse.job_neighborhoods(graph_tables(spark, sf, similar=True))


COMPANY_JOBS7 = """
newest AS (
  SELECT company_id, id AS job_id,
         row_number() OVER (PARTITION BY company_id ORDER BY coalesce(posted_at, '') DESC, title, id) AS rank
  FROM jobs QUALIFY rank <= 7),
top8 AS (SELECT * FROM top_skills WHERE rank <= 8)
"""


@query("company_neighborhood_members", with_(GRAPH, TOP_SKILLS, COMPANY_JOBS7) + """
SELECT company_id AS center_id, 'job' AS role, rank, job_id AS node_id FROM newest
UNION ALL SELECT company_id, 'skill', rank, skill_id FROM top8""")
def company_neighborhood_members(spark, sf):
    return browse.company_neighborhoods(graph_tables(spark, sf))[0]


@query("company_neighborhood_links", with_(GRAPH, TOP_SKILLS, COMPANY_JOBS7) + """
SELECT k.company_id, k.job_id, k.skill_id, k.edge_type, k.weight, k.confidence
FROM known k JOIN newest n ON n.company_id = k.company_id AND n.job_id = k.job_id
JOIN top8 t ON t.company_id = k.company_id AND t.skill_id = k.skill_id""")
def company_neighborhood_links(spark, sf):
    return browse.company_neighborhoods(graph_tables(spark, sf))[1]


@query("skill_neighborhoods", PLAIN + """
SELECT skill_id AS center_id, 'job' AS role, min(r) AS rank, job_id AS node_id
FROM (SELECT k.skill_id, k.job_id, row_number() OVER (
        PARTITION BY k.skill_id ORDER BY coalesce(j.posted_at, '') DESC, j.title, k.job_id, k.edge_type) AS r
      FROM known k JOIN jobs j ON j.id = k.job_id QUALIFY r <= 7) GROUP BY skill_id, job_id
UNION ALL
SELECT skill_id, 'company', row_number() OVER (PARTITION BY skill_id ORDER BY first_job, company_id) AS r, company_id
FROM (SELECT skill_id, company_id, min(job_id) AS first_job FROM known GROUP BY ALL) QUALIFY r <= 4""")
def skill_neighborhoods(spark, sf):
    return browse.skill_neighborhoods(graph_tables(spark, sf))


# --- search and views ----------------------------------------------------------

HITS = "contains(lower(concat_ws(' ', title, text, id, type)), '{q}')"


@query("search_first_72", with_(GRAPH, SEARCH) + f"""
SELECT id, type, title FROM docs WHERE {HITS.format(q='ring')} ORDER BY doc_rank, id LIMIT 72""")
def search_first_72(spark, sf):
    return browse.search(graph_tables(spark, sf).search, "Ring").select("id", "type", "title")


@query("search_all_jobs", with_(GRAPH, SEARCH) + f"""
SELECT id, type, title FROM docs WHERE type = 'job' AND {HITS.format(q='urgent f')}""")
def search_all_jobs(spark, sf):
    return browse.search(graph_tables(spark, sf).search, "urgent F", "job", limit=None).select("id", "type", "title")


BOTH = """
both_ways AS (SELECT source AS id, target AS neighbor FROM edges UNION ALL SELECT target, source FROM edges)
"""


@query("expand_two_hops", with_(GRAPH, edges(False), BOTH).rstrip() + """,
seeds AS (SELECT id FROM skills WHERE label = 'red widget' AND category = 'ECONOMY'),
hop1 AS (SELECT DISTINCT neighbor AS id FROM both_ways JOIN seeds USING (id) WHERE neighbor NOT IN (SELECT id FROM seeds)),
hop2 AS (SELECT DISTINCT neighbor AS id FROM both_ways JOIN hop1 USING (id)
         WHERE neighbor NOT IN (SELECT id FROM seeds) AND neighbor NOT IN (SELECT id FROM hop1))
SELECT id, 0 AS hop FROM seeds UNION ALL SELECT id, 1 FROM hop1 UNION ALL SELECT id, 2 FROM hop2""")
def expand_two_hops(spark, sf):
    g = graph_tables(spark, sf)
    seeds = g.skills.where((F.col("label") == "red widget") & (F.col("category") == "ECONOMY"))
    return browse.expand(g, seeds.select("id", F.lit(0).alias("pos")), hops=2)


@query("expand_core_types", with_(GRAPH, edges(False), BOTH).rstrip() + """,
seeds AS (SELECT id FROM jobs WHERE title = '1-URGENT P'),
hop1 AS (SELECT DISTINCT neighbor AS id FROM both_ways JOIN seeds USING (id)
         WHERE neighbor NOT IN (SELECT id FROM seeds) AND split_part(neighbor, ':', 1) <> 'role_family')
SELECT id, 0 AS hop FROM seeds UNION ALL SELECT id, 1 FROM hop1""")
def expand_core_types(spark, sf):
    g = graph_tables(spark, sf)
    seeds = g.jobs.where(F.col("title") == "1-URGENT P").select("id", F.lit(0).alias("pos"))
    return browse.expand(g, seeds, kind="location")


INDUCED = """
wanted AS (
  SELECT id FROM nodes WHERE type IN ('company', 'location') OR (type = 'job' AND label LIKE '1-URGENT%'))
"""


@query("induced_subgraph_nodes", VIEW.rstrip() + ",\n" + INDUCED.strip() + """
SELECT n.id, n.type, n.label, coalesce(d.degree, 0) AS degree,
       CASE n.type WHEN 'job' THEN j.company_name WHEN 'company' THEN 'Company' ELSE 'Location' END AS subtitle
FROM nodes n SEMI JOIN wanted USING (id) LEFT JOIN degrees d ON d.id = n.id LEFT JOIN jobs j ON j.id = n.id""")
def induced_subgraph_nodes(spark, sf):
    g = graph_tables(spark, sf)
    return browse.induced_subgraph(g, _wanted(g))[0]


def _wanted(g):
    return g.nodes.where(
        F.col("type").isin("company", "location") | ((F.col("type") == "job") & F.col("label").startswith("1-URGENT"))
    )


@query("induced_subgraph_edges", VIEW.rstrip() + ",\n" + INDUCED.strip() + """
SELECT e.* FROM edges e WHERE source IN (SELECT id FROM wanted) AND target IN (SELECT id FROM wanted)""")
def induced_subgraph_edges(spark, sf):
    g = graph_tables(spark, sf)
    return browse.induced_subgraph(g, _wanted(g))[1]


@query("overview_nodes", VIEW + f"""
SELECT id, type, label, coalesce(degree, 0) AS degree FROM nodes LEFT JOIN degrees USING (id)
WHERE type IN ('company', 'job', 'skill')
ORDER BY coalesce(degree, 0) DESC, {TYPE_RANK}, label, id LIMIT 2600""")
def overview_nodes(spark, sf):
    return browse.overview_nodes(graph_tables(spark, sf))


EDGE_ORDER = """
ordered AS (
  SELECT source AS id, target AS neighbor, phase, a, b, c FROM placed
  UNION ALL SELECT target, source, phase, a, b, c FROM placed)
"""
PLACED = """
placed AS (
  SELECT source, target,
         CASE WHEN type IN ('POSTS', 'LOCATED_IN', 'BELONGS_TO') THEN 0 WHEN type = 'SIMILAR_TO' THEN 2 ELSE 1 END AS phase,
         CASE WHEN type = 'POSTS' THEN target ELSE source END AS a,
         CASE type WHEN 'POSTS' THEN '0' WHEN 'LOCATED_IN' THEN '1' WHEN 'BELONGS_TO' THEN '2' ELSE target END AS b, type AS c
  FROM edges)
"""
FOCUS = """
hits AS (
  SELECT id, row_number() OVER (ORDER BY doc_rank, id) AS pos FROM docs
  WHERE contains(lower(concat_ws(' ', title, text, id, type)), 'blue bolt') ORDER BY doc_rank, id LIMIT 72),
near AS (
  SELECT o.neighbor AS id, min(struct_pack(hop := 1, pos := h.pos, phase := phase, a := a, b := b, c := c)) AS place
  FROM ordered o JOIN hits h USING (id) WHERE o.neighbor NOT IN (SELECT id FROM hits) GROUP BY 1),
view_ids AS (
  SELECT id FROM (
    SELECT id, 0 AS hop, pos, 0 AS phase, '' AS a, '' AS b, '' AS c FROM hits
    UNION ALL SELECT id, place.hop, place.pos, place.phase, place.a, place.b, place.c FROM near)
  ORDER BY hop, pos, phase, a, b, c, id LIMIT 600)
"""


@query("focused_view_nodes", VIEW.rstrip() + "," + ",".join([SEARCH, PLACED, EDGE_ORDER, FOCUS]) + """
SELECT n.id, n.type, n.label, coalesce(degree, 0) AS degree FROM nodes n SEMI JOIN view_ids USING (id)
LEFT JOIN degrees d ON d.id = n.id""")
def focused_view_nodes(spark, sf):
    nodes, _ = browse.overview(graph_tables(spark, sf), "Blue bolt")
    return nodes.drop("subtitle")


# Materialised, or DuckDB expands each of the nested parts again.
FOCUS_EDGES = VIEW.rstrip() + "," + ",".join([SEARCH, PLACED, EDGE_ORDER, FOCUS]) + """
SELECT e.* FROM edges e WHERE source IN (SELECT id FROM view_ids) AND target IN (SELECT id FROM view_ids)"""


@query("focused_view_edges", FOCUS_EDGES.replace(" AS (", " AS MATERIALIZED ("))
def focused_view_edges(spark, sf):
    return browse.overview(graph_tables(spark, sf), "Blue bolt")[1]


@query("search_results", VIEW.rstrip() + "," + ",".join([SEARCH, PLACED, EDGE_ORDER, FOCUS]) + f"""
SELECT n.id, n.type, n.label, coalesce(degree, 0) AS degree FROM nodes n SEMI JOIN view_ids USING (id)
LEFT JOIN degrees d ON d.id = n.id ORDER BY {TYPE_RANK}, coalesce(degree, 0) DESC, label, n.id LIMIT 120""")
def search_results(spark, sf):
    nodes, _ = browse.overview(graph_tables(spark, sf), "Blue bolt")
    return browse.search_results(nodes).drop("subtitle")


@query("search_result_page", VIEW.rstrip() + "," + ",".join([SEARCH, PLACED, EDGE_ORDER, FOCUS]) + f""",
results AS (
  SELECT n.id, n.type, n.label, coalesce(degree, 0) AS degree FROM nodes n SEMI JOIN view_ids USING (id)
  LEFT JOIN degrees d ON d.id = n.id ORDER BY {TYPE_RANK}, coalesce(degree, 0) DESC, label, n.id LIMIT 120)
SELECT * FROM (SELECT 'primary' AS part, * FROM results WHERE type = 'skill' ORDER BY degree DESC, label, id LIMIT 14)
UNION ALL
SELECT * FROM (SELECT 'related' AS part, * FROM results WHERE type <> 'skill' ORDER BY {TYPE_RANK}, degree DESC, label, id LIMIT 5)""")
def search_result_page(spark, sf):
    nodes, _ = browse.overview(graph_tables(spark, sf), "Blue bolt")
    first, related = browse.result_page(browse.search_results(nodes), "blue bolt", ["skill"])
    return first.withColumn("part", F.lit("primary")).unionByName(
        related.withColumn("part", F.lit("related"))
    ).drop("subtitle")


def _roots_sql(kind: str, body: str, order: str) -> str:
    return PLAIN + f"""
SELECT id, label, subtitle, degree, row_number() OVER (ORDER BY {order}) AS pos FROM ({body})
ORDER BY {order} LIMIT 120"""


SKILL_ROOTS = _roots_sql("skill", """
  SELECT s.id, s.label, coalesce(nullif(s.category, ''), 'Skill') AS subtitle, coalesce(n, 0) AS degree
  FROM skills s LEFT JOIN (SELECT skill_id AS id, count(*) AS n FROM known GROUP BY 1) USING (id)
  WHERE contains(lower(concat_ws(' ', label, category, s.id)), 'standard')""", "degree DESC, label, id")
COMPANY_ROOTS = _roots_sql("company", """
  SELECT c.id, c.name AS label, coalesce(nullif(c.industry, ''), 'Company') AS subtitle, coalesce(n, 0) AS degree
  FROM companies c LEFT JOIN (SELECT company_id AS id, count(*) AS n FROM jobs GROUP BY 1) USING (id)""", "degree DESC, label, id")
JOB_ROOTS = _roots_sql("job", """
  SELECT j.id, j.title AS label, coalesce(nullif(j.company_name, ''), 'Job') AS subtitle, coalesce(n, 0) AS degree,
         coalesce(posted_at, '') AS day
  FROM jobs j LEFT JOIN (SELECT job_id AS id, count(*) AS n FROM known GROUP BY 1) USING (id)""", "day DESC, degree DESC, label, id")


@query("skill_roots", SKILL_ROOTS)
def skill_roots(spark, sf):
    return browse.roots(graph_tables(spark, sf), "skill", "Standard")


@query("company_roots", COMPANY_ROOTS)
def company_roots(spark, sf):
    return browse.roots(graph_tables(spark, sf), "company")


@query("job_roots", JOB_ROOTS)
def job_roots(spark, sf):
    return browse.roots(graph_tables(spark, sf), "job")


# --- pages and lookup ------------------------------------------------------------


@query("company_pages", PLAIN + """
SELECT c.id AS company_id, c.name, coalesce(open_roles, 0) AS open_roles, coalesce(locations, 0) AS locations,
       coalesce(top_skills, 0) AS top_skills
FROM companies c
LEFT JOIN (SELECT company_id, count(*) AS open_roles,
                  count(DISTINCT coalesce(nullif(location_text, ''), 'Unknown')) AS locations FROM jobs GROUP BY 1) j
  ON j.company_id = c.id
LEFT JOIN (SELECT company_id, least(count(DISTINCT skill_id), 8) AS top_skills FROM known GROUP BY 1) s
  ON s.company_id = c.id""")
def company_pages(spark, sf):
    return browse.company_pages(graph_tables(spark, sf))


@query("skill_pages", PLAIN.rstrip() + """,
per_job AS (SELECT skill_id, job_id, company_id, count(*) AS n, bool_or(edge_type = 'REQUIRES') AS req,
                   bool_or(edge_type = 'PREFERS') AS pref FROM known GROUP BY 1, 2, 3)
SELECT s.id AS skill_id, any_value(s.label) AS label, coalesce(sum(n), 0)::BIGINT AS jobs,
       count(DISTINCT company_id) AS companies,
       coalesce(sum(n) FILTER (req), 0)::BIGINT AS required_jobs, coalesce(sum(n) FILTER (pref), 0)::BIGINT AS preferred_jobs
FROM skills s LEFT JOIN per_job p ON p.skill_id = s.id GROUP BY s.id""")
def skill_pages(spark, sf):
    return browse.skill_pages(graph_tables(spark, sf))


@query("lookup_by_id", with_(GRAPH, NODES).rstrip() + """,
wanted AS (
  SELECT 'job:' || l_orderkey AS id FROM lineitem UNION SELECT 'skill:' || (l_partkey + 500) FROM lineitem
  UNION SELECT 'company:' || l_suppkey FROM lineitem UNION SELECT 'location:' || lower(n_name) FROM nation)
SELECT w.id, CASE WHEN split_part(w.id, ':', 1) IN ('job', 'company', 'skill') THEN split_part(w.id, ':', 1) ELSE 'graph' END AS kind,
       n.label, n.id IS NULL AS missing
FROM wanted w LEFT JOIN nodes n ON n.id = w.id""")
def lookup_by_id(spark, sf):
    lines = standins.table(spark, sf, "lineitem")

    def ids(df, prefix, key):
        return df.select(F.concat(F.lit(prefix), key.cast("string")).alias("id"))

    wanted = (
        ids(lines, "job:", F.col("l_orderkey"))
        .unionByName(ids(lines, "skill:", F.col("l_partkey") + 500))
        .unionByName(ids(lines, "company:", F.col("l_suppkey")))
        .unionByName(ids(standins.table(spark, sf, "nation"), "location:", F.lower("n_name")))
        .distinct()
    )
    return browse.lookup(graph_tables(spark, sf), wanted)
