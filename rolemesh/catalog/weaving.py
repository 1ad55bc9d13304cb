"""Weighted similarity and links among the roots of each view."""

from __future__ import annotations

from ..operators import browse, weave
from ..plans.standins import graph_tables
from .registry import query
from .sql import GRAPH, SIMILAR, with_

TOP_SKILLS = """
tops AS (
  SELECT s.id, row_number() OVER (ORDER BY coalesce(n, 0) DESC, s.label, s.id) AS pos
  FROM skills s LEFT JOIN (SELECT skill_id AS id, count(*) AS n FROM known GROUP BY 1) USING (id) QUALIFY pos <= 120)
"""
TOP_COMPANIES = """
tops AS (
  SELECT c.id, row_number() OVER (ORDER BY coalesce(n, 0) DESC, c.name, c.id) AS pos
  FROM companies c LEFT JOIN (SELECT company_id AS id, count(*) AS n FROM jobs GROUP BY 1) USING (id) QUALIFY pos <= 120)
"""
TOP_JOBS = """
tops AS (
  SELECT j.id, row_number() OVER (ORDER BY coalesce(posted_at, '') DESC, coalesce(n, 0) DESC, j.title, j.id) AS pos
  FROM jobs j LEFT JOIN (SELECT job_id AS id, count(*) AS n FROM known GROUP BY 1) USING (id) QUALIFY pos <= 120)
"""
SKILL_FEATURES = """
features AS (
  SELECT skill_id AS id, 'company:' || company_id AS key, 1100000000::BIGINT AS w FROM known SEMI JOIN tops ON tops.id = skill_id GROUP BY 1, 2
  UNION ALL SELECT skill_id, 'job:' || job_id, 720000000 FROM known SEMI JOIN tops ON tops.id = skill_id GROUP BY 1, 2
  UNION ALL SELECT id, 'parent:' || parent_id, 850000000 FROM skills SEMI JOIN tops USING (id)
  UNION ALL SELECT id, 'category:' || category, 200000000 FROM skills SEMI JOIN tops USING (id))
"""
COMPANY_FEATURES = """
stats AS (SELECT company_id, skill_id, count(*) AS n FROM known SEMI JOIN tops ON tops.id = company_id GROUP BY 1, 2),
features AS (
  SELECT company_id AS id, 'skill:' || skill_id AS key,
         round((0.45::DOUBLE + n::DOUBLE / max(n) OVER (PARTITION BY company_id) * 0.75::DOUBLE) * 1000000000)::BIGINT AS w FROM stats
  UNION ALL SELECT id, 'industry:' || industry, 220000000 FROM companies SEMI JOIN tops USING (id))
"""
JOB_FEATURES = """
features AS (
  SELECT job_id AS id, 'skill:' || skill_id AS key, max(CASE WHEN edge_type = 'REQUIRES' THEN 1000000000 ELSE 660000000 END)::BIGINT AS w
  FROM known SEMI JOIN tops ON tops.id = job_id GROUP BY 1, 2
  UNION ALL SELECT id, 'company:' || company_id, 300000000 FROM jobs SEMI JOIN tops USING (id)
  UNION ALL SELECT id, 'family:' || role_family, 550000000 FROM jobs SEMI JOIN tops USING (id))
"""
PAIRS = """
totals AS (SELECT id, sum(w) AS total FROM features GROUP BY 1),
pairs AS (
  SELECT x.id AS source, y.id AS target, sum(least(x.w, y.w))::BIGINT AS low
  FROM (SELECT * FROM features JOIN tops USING (id)) x JOIN (SELECT * FROM features JOIN tops USING (id)) y
    ON x.key = y.key AND x.pos < y.pos GROUP BY 1, 2)
"""
# The bound of the view is 0.12; skills and companies of these tables are less alike.
BOUNDS = {"skill": 0.01, "company": 0.01, "job": weave.MIN_SIMILARITY}
ANSWER = """
SELECT source, target, low::DOUBLE / (a.total + b.total - low)::DOUBLE AS weight
FROM pairs JOIN totals a ON a.id = source JOIN totals b ON b.id = target WHERE low::DOUBLE / (a.total + b.total - low)::DOUBLE > {}"""


PLACED_LINKS = """
placed AS (
  SELECT source, target, low::DOUBLE / (a.total + b.total - low)::DOUBLE AS weight, 0 AS part, p.pos AS pa, q.pos AS pb
  FROM pairs JOIN totals a ON a.id = source JOIN totals b ON b.id = target JOIN tops p ON p.id = source JOIN tops q ON q.id = target
  WHERE low::DOUBLE / (a.total + b.total - low)::DOUBLE > {bound}{direct}),
merged AS (
  SELECT arg_max(source, (weight, -part)) AS source, arg_max(target, (weight, -part)) AS target, max(weight) AS weight, min((part, pa, pb)) AS ord
  FROM placed GROUP BY least(source, target), greatest(source, target)),
"""
DIRECT_LINKS = """
  UNION ALL SELECT arg_min(job_id, (a.pos, rank)), arg_min(other_id, (a.pos, rank)),
         least(1.0::DOUBLE, greatest(0.22::DOUBLE, 0.22::DOUBLE + any_value(score) * 0.78::DOUBLE))::DOUBLE, 1, min(a.pos),
         arg_min(rank, (a.pos, rank))
  FROM neighbors JOIN tops a ON a.id = job_id SEMI JOIN tops b ON b.id = other_id GROUP BY least(job_id, other_id), greatest(job_id, other_id)"""
# The greedy pass: links by weight, each kept while both ends have room for it.
GREEDY = """
listed AS (
  SELECT list({'s': source, 't': target, 'w': weight, 'used': []::VARCHAR[], 'kept': []::STRUCT(s VARCHAR, t VARCHAR, w DOUBLE)[]}
              ORDER BY weight DESC, ord, source, target) AS l FROM merged),
greedy AS (
  SELECT list_reduce(list_prepend({'s': '', 't': '', 'w': 0.0::DOUBLE, 'used': []::VARCHAR[], 'kept': []::STRUCT(s VARCHAR, t VARCHAR, w DOUBLE)[]}, l),
    lambda a, x: CASE WHEN len(list_filter(a.used, lambda u: u = x.s)) < 4 AND len(list_filter(a.used, lambda u: u = x.t)) < 4
      THEN {'s': '', 't': '', 'w': 0.0::DOUBLE, 'used': list_concat(a.used, [x.s, x.t]), 'kept': list_append(a.kept, {'s': x.s, 't': x.t, 'w': x.w})}
      ELSE a END).kept AS kept FROM listed)
SELECT k.s AS source, k.t AS target, k.w AS weight FROM (SELECT unnest(kept) AS k FROM greedy)"""


def _links_sql(kind: str, ctes: tuple[str, str]) -> str:
    direct = DIRECT_LINKS if kind == "job" else ""
    tables = (GRAPH, SIMILAR, *ctes, PAIRS) if kind == "job" else (GRAPH, *ctes, PAIRS)
    placed = PLACED_LINKS.format(bound=BOUNDS[kind], direct=direct)
    return with_(*tables).rstrip() + "," + placed + GREEDY.lstrip()


def _features(kind):
    def run(spark, sf):
        g = graph_tables(spark, sf)
        return weave.weighted_features(g, kind, browse.roots(g, kind))

    return run


def _pairs(kind):
    def run(spark, sf):
        g = graph_tables(spark, sf)
        top = browse.roots(g, kind)
        features = weave.weighted_features(g, kind, top)
        return weave.weighted_similarity(features, top, BOUNDS[kind]).select("source", "target", "weight")

    return run


def _weave(kind):
    def run(spark, sf):
        g = graph_tables(spark, sf, similar=kind == "job")
        return weave.root_weave(g, kind, more_than=BOUNDS[kind])

    return run


for _kind, _ctes in {
    "skill": (TOP_SKILLS, SKILL_FEATURES),
    "company": (TOP_COMPANIES, COMPANY_FEATURES),
    "job": (TOP_JOBS, JOB_FEATURES),
}.items():
    query(f"{_kind}_root_features", with_(GRAPH, *_ctes) + "SELECT id, key, w FROM features")(_features(_kind))
    query(f"{_kind}_root_similarity", with_(GRAPH, *_ctes, PAIRS) + ANSWER.format(BOUNDS[_kind]))(_pairs(_kind))
    query(f"{_kind}_root_links", _links_sql(_kind, _ctes))(_weave(_kind))


@query("job_root_direct_links", with_(GRAPH, SIMILAR, TOP_JOBS.replace("120", "5000")) + """
SELECT arg_min(job_id, (a.pos, rank)) AS source, arg_min(other_id, (a.pos, rank)) AS target,
       least(1.0::DOUBLE, greatest(0.22::DOUBLE, 0.22::DOUBLE + any_value(score) * 0.78::DOUBLE))::DOUBLE AS weight
FROM neighbors JOIN tops a ON a.id = job_id SEMI JOIN tops b ON b.id = other_id GROUP BY least(job_id, other_id), greatest(job_id, other_id)""")
def job_root_direct_links(spark, sf):
    g = graph_tables(spark, sf, similar=True)
    return weave.direct_links(g.neighbors, browse.roots(g, "job", limit=5000)).select("source", "target", "weight")
