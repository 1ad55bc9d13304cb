"""SQL fragments shared by the counterpart queries."""

from __future__ import annotations

# White space as the text functions see it.
WS = r"[\s\x0b\x1c-\x1f\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def slug(expr: str, empty: str = "unknown") -> str:
    ascii_only = rf"regexp_replace(strip_accents({expr}), '[^\x00-\x7F]', '', 'g')"
    dashed = f"trim(regexp_replace(lower({ascii_only}), '[^a-z0-9]+', '-', 'g'), '-')"
    return f"coalesce(nullif({dashed}, ''), '{empty}')"


def collapse(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '{WS}+', ' ', 'g'))"


def strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^{WS}+|{WS}+$', '', 'g')"


def strip_tags(expr: str) -> str:
    return collapse(f"regexp_replace(coalesce({expr}, ''), '<[^>]+>', ' ', 'g')")


def has_word(expr: str, pattern: str) -> str:
    """Word-bounded match, ignoring case, with word characters of every script."""
    return rf"regexp_matches({expr}, '(?i)(^|[^\p{{L}}\p{{N}}_])({pattern})($|[^\p{{L}}\p{{N}}_])')"


def edge_id(source: str, kind: str, target: str) -> str:
    return f"'edge:' || lower({kind}) || ':' || left(sha256({source} || '|' || {kind} || '|' || {target}), 12)"


def graph_slug(expr: str) -> str:
    dashed = rf"trim(lower(regexp_replace({expr}, '[^\p{{L}}\p{{N}}]', '-', 'g')), '-')"
    return f"coalesce(nullif({dashed}, ''), 'unknown')"


# The job-skill graph read from orders, line items, parts and customers.
GRAPH = """
jobs AS (
  SELECT 'job:' || o_orderkey AS id, 'company:' || o_custkey AS company_id, c_name AS company_name,
         o_orderpriority || ' ' || o_orderstatus AS title, n_name AS location_text,
         lower(o_orderstatus) AS remote_mode, nullif(o_orderstatus, 'O') AS seniority,
         o_orderpriority AS role_family, strftime(o_orderdate, '%Y-%m-%d') AS posted_at
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey),
companies AS (
  SELECT 'company:' || c_custkey AS id, c_name AS name, c_mktsegment AS industry FROM customer),
skills AS (
  SELECT 'skill:' || p_partkey AS id, p_name AS label, p_type AS category, p_brand AS parent_id FROM part),
known AS (
  SELECT DISTINCT js.job_id, js.skill_id, js.edge_type, s.label AS skill_label, j.company_id,
         CASE WHEN js.edge_type = 'PREFERS' THEN 0.6 ELSE 1.0 END::DOUBLE AS weight,
         CASE WHEN js.edge_type = 'PREFERS' THEN 0.6 ELSE 0.75 END::DOUBLE AS confidence
  FROM (SELECT 'job:' || l_orderkey AS job_id, 'skill:' || l_partkey AS skill_id,
               CASE WHEN l_returnflag = 'R' THEN 'PREFERS' ELSE 'REQUIRES' END AS edge_type
        FROM lineitem) js
  JOIN skills s ON s.id = js.skill_id JOIN jobs j ON j.id = js.job_id)
"""

# Undirected skill-set shared_items and the directed top 8 per job.
SIMILAR = """
sets AS (SELECT DISTINCT job_id, skill_id FROM known),
sizes AS (SELECT job_id, count(*) AS n FROM sets GROUP BY job_id),
shared_items AS (
  SELECT x.job_id AS job_id, y.job_id AS other_id, count(*) AS i
  FROM sets x JOIN sets y ON x.skill_id = y.skill_id AND x.job_id <> y.job_id GROUP BY 1, 2),
similar_pairs AS (
  SELECT o.job_id, o.other_id, o.i, a.n + b.n - o.i AS u
  FROM shared_items o JOIN sizes a ON a.job_id = o.job_id JOIN sizes b ON b.job_id = o.other_id
  WHERE 20 * o.i >= 7 * (a.n + b.n - o.i)),
neighbors AS (
  SELECT job_id, other_id, i, u, round_even(i::DOUBLE / u, 4) AS score,
         row_number() OVER (PARTITION BY job_id ORDER BY i::DOUBLE / u DESC, other_id) AS rank
  FROM similar_pairs QUALIFY rank <= 8),
kept AS (
  SELECT DISTINCT least(job_id, other_id) AS job_a, greatest(job_id, other_id) AS job_b, score FROM neighbors)
"""


def edges(with_similar: bool) -> str:
    """CTE ``edges`` (id, source, target, type, weight, confidence) of the graph."""
    parts = [
        f"SELECT {edge_id('company_id', chr(39) + 'POSTS' + chr(39), 'id')} AS id, company_id AS source, id AS target, 'POSTS' AS type, 1.0::DOUBLE AS weight, 1.0::DOUBLE AS confidence FROM jobs",
        f"SELECT {edge_id('id', chr(39) + 'LOCATED_IN' + chr(39), 'loc')}, id, loc, 'LOCATED_IN', 1.0, 0.9 FROM (SELECT id, 'location:' || {graph_slug('location_text')} AS loc FROM jobs WHERE location_text <> '')",
        f"SELECT {edge_id('id', chr(39) + 'BELONGS_TO' + chr(39), 'fam')}, id, fam, 'BELONGS_TO', 1.0, 0.7 FROM (SELECT id, 'role_family:' || {graph_slug('role_family')} AS fam FROM jobs WHERE role_family <> '')",
        f"SELECT {edge_id('job_id', 'edge_type', 'skill_id')}, job_id, skill_id, edge_type, weight, confidence FROM known",
    ]
    if with_similar:
        parts.append(
            f"SELECT {edge_id('job_a', chr(39) + 'SIMILAR_TO' + chr(39), 'job_b')}, job_a, job_b, 'SIMILAR_TO', score, score FROM kept"
        )
    return "edges AS (" + " UNION ALL ".join(parts) + ")"


NODES = f"""
nodes AS (
  SELECT id, 'company' AS type, name AS label FROM companies
  UNION ALL SELECT id, 'skill', label FROM skills
  UNION ALL SELECT id, 'job', title FROM jobs
  UNION ALL SELECT 'location:' || {graph_slug('location_text')}, 'location', arg_min(location_text, id)
            FROM jobs WHERE location_text <> '' GROUP BY 1
  UNION ALL SELECT 'role_family:' || {graph_slug('role_family')}, 'role_family', arg_min(role_family, id)
            FROM jobs WHERE role_family <> '' GROUP BY 1)
"""

DEGREES = """
degrees AS (
  SELECT id, count(*) AS degree
  FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) GROUP BY id)
"""

TYPE_RANK = "CASE type WHEN 'job' THEN 1 WHEN 'skill' THEN 2 WHEN 'location' THEN 3 WHEN 'role_family' THEN 4 ELSE 99 END"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"
