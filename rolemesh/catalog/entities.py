"""Dedupe, keyed state and run-log queries over documents, customers and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids
from ..operators import dedupe
from ..plans import standins
from ..plans.standins import RULES, table
from ..sinks.tables import run_status, stage_durations
from ..streaming.ingest import fold, refold, unfold
from .registry import query
from .textual import _rules
from .sql import slug, strip, strip_tags, with_


KEYWORDS = r"""left(sha256(array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(clean), '[a-z][a-z0-9+\-]+'),
    lambda x: x NOT IN ('the','and','with','for','you','our','will','this','that','are','job','role'))[1:100]))[1:12], ' ')), 12)"""
NORMALIZED = f"""
raw AS (
  SELECT doc_id AS raw_id, 'doc' AS source_type, 'doc://' || doc_id AS source_url,
         CASE WHEN lang <> 'fr' THEN n_chars::VARCHAR END AS external_id, split_part(text, chr(10), 1) AS title,
         source AS raw_company_name, lang AS location_text, text FROM documents),
resolved AS (
  SELECT *, CASE lower(trim(raw_company_name)) WHEN 'src1' THEN 'company:one' WHEN 'src2' THEN 'company:one'
               WHEN 'src3' THEN 'company:three' ELSE 'company:' || {slug('raw_company_name')} END AS company_id,
         CASE WHEN lower(trim(raw_company_name)) IN ('src1', 'src2') THEN 'Source One' ELSE {strip('raw_company_name')} END AS company_name,
         {strip_tags("coalesce(nullif(text, ''), '')")} AS clean
  FROM raw),
normalized AS (
  SELECT raw_id, company_id, company_name, raw_company_name, external_id, title, location_text, source_type, source_url,
         trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS title_normalized,
         {_rules("location_text || ' ' || clean", RULES.remote)} AS remote_mode,
         {_rules('clean', RULES.employment)} AS employment_type,
         sha256(clean) AS description_hash,
         sha256({slug('company_name')} || '|' || {slug('title')} || '|' || {slug('location_text')} || '|' || {KEYWORDS}) AS dedupe_fingerprint,
         'job:' || substr(company_id, 9) || ':' || CASE WHEN external_id <> '' THEN {slug('external_id')}
             ELSE left(sha256(company_name || '|' || title || '|' || sha256(clean)), 12) END AS id
  FROM resolved)
"""


@query("raw_insert_if_absent", """
WITH raw AS (SELECT doc_id, lang, CASE WHEN lang <> 'fr' THEN 'doc::' || source || '::' || n_chars ELSE 'doc::doc://' || doc_id END AS source_key FROM documents),
old AS (SELECT DISTINCT source_key FROM raw WHERE lang IN ('de', 'es'))
SELECT source_key, min(doc_id) AS raw_id FROM raw
WHERE lang NOT IN ('de', 'es') AND source_key NOT IN (SELECT source_key FROM old) GROUP BY 1""")
def raw_insert_if_absent(spark, sf):
    """German and Spanish postings are stored first, the others arrive as a second load."""
    raw = standins.raw_jobs(spark, sf)
    first_load = F.col("location_text").isin("de", "es")
    stored = dedupe.insert_if_absent(raw.where(first_load))
    return dedupe.insert_if_absent(raw.where(~first_load), stored).select("source_key", "raw_id")


@query("events_first_wins", """
SELECT user_id, event_type, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM events GROUP BY 1, 2""")
def events_first_wins(spark, sf):
    from ..operators.ranking import first_per_key

    first = first_per_key(table(spark, sf, "events"), ["user_id", "event_type"], [F.col("event_id").asc()])
    return first.select("user_id", "event_type", "event_id", "value")


LAST_WINS = """
SELECT user_id, event_type, arg_max(props, event_id) AS props, arg_max(big, event_id) FILTER (big IS NOT NULL) AS big,
       max(event_id) AS event_id
FROM (SELECT *, CASE WHEN value > 50 THEN value END AS big FROM events) GROUP BY 1, 2"""


@query("events_last_wins", LAST_WINS)
def events_last_wins(spark, sf):
    """``props`` takes the last value, ``big`` the last one that is not null."""
    events = table(spark, sf, "events").withColumn("big", F.when(F.col("value") > 50, F.col("value")))
    return dedupe.upsert_last_wins(
        events.withColumn("ord", F.col("event_id")), ["user_id", "event_type"], "ord", ["props", "event_id"], ["big"]
    )


@query("events_last_wins_in_parts", LAST_WINS)
def events_last_wins_in_parts(spark, sf):
    """The same state folded per day first and merged afterwards, as the stream does."""
    keys = ["user_id", "event_type"]
    events = table(spark, sf, "events").withColumn("big", F.when(F.col("value") > 50, F.col("value")))
    daily = events.withColumn("day", F.to_date("ts")).withColumn("ord", F.col("event_id"))
    parts = fold(daily, [*keys, "day"], "ord", ["props", "event_id"], ["big"]).drop("day")
    return unfold(refold(parts, keys), keys)


@query("company_resolution", f"""
WITH n AS (SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN upper(n_name) || ' ' WHEN 'MACHINERY' THEN '  ' || n_name ELSE lower(n_name) END AS name
           FROM customer JOIN nation ON c_nationkey = n_nationkey),
k AS (SELECT *, lower(trim(name)) AS key FROM n)
SELECT c_custkey, CASE WHEN key IN ('nation_1', 'nation_2') THEN 'company:first' WHEN key = 'nation_3' THEN 'company:third'
         ELSE 'company:' || {slug('trim(name)')} END AS company_id,
       CASE WHEN key IN ('nation_1', 'nation_2') THEN 'First Nation' ELSE trim(name) END AS canonical_name FROM k""")
def company_resolution(spark, sf):
    nation = F.col("n_name")
    segment = F.col("c_mktsegment")
    named = (
        table(spark, sf, "customer")
        .join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            "c_custkey",
            F.when(segment == "BUILDING", F.concat(F.upper(nation), F.lit(" ")))
            .when(segment == "MACHINERY", F.concat(F.lit("  "), nation))
            .otherwise(F.lower(nation))
            .alias("company_name"),
        )
    )
    first = {"id": "company:first", "name": "First Nation"}
    aliases = {"nation_1": first, "nation_2": first, "nation_3": "company:third"}
    return dedupe.resolve_company(named, dedupe.alias_table(spark, aliases)).drop("company_name")


@query("normalized_jobs", with_(NORMALIZED) + """
SELECT raw_id, id, company_id, company_name, title_normalized, remote_mode, employment_type, description_hash, dedupe_fingerprint FROM normalized""")
def normalized_jobs(spark, sf):
    return standins.normalized_documents(spark, sf).select(
        "raw_id", "id", "company_id", "company_name", "title_normalized", "remote_mode", "employment_type",
        "description_hash", "dedupe_fingerprint",
    )


@query("upserted_companies", with_(NORMALIZED) + """
SELECT company_id AS id, arg_max(company_name, raw_id) AS name,
       coalesce(arg_max(CASE WHEN raw_company_name <> company_name THEN raw_company_name ELSE '' END, raw_id), '') AS alias
FROM normalized GROUP BY 1""")
def upserted_companies(spark, sf):
    out = dedupe.upsert_companies(standins.normalized_documents(spark, sf))
    return out.select("id", "name", F.array_join("aliases", ",").alias("alias"))


@query("upserted_jobs", with_(NORMALIZED).rstrip() + """,
by_external AS (
  SELECT arg_min(id, raw_id) AS id, arg_max(dedupe_fingerprint, raw_id) AS fp, min(raw_id) AS lo, max(raw_id) AS hi
  FROM normalized WHERE external_id <> '' GROUP BY company_id, source_type, external_id
  UNION ALL SELECT id, dedupe_fingerprint, raw_id, raw_id FROM normalized WHERE coalesce(external_id, '') = ''),
by_fp AS (SELECT arg_min(id, lo) AS id, min(lo) AS lo, max(hi) AS hi FROM by_external GROUP BY fp),
by_id AS (SELECT id, min(lo) AS first_ord, max(hi) AS hi, count(*) AS id_claims FROM by_fp GROUP BY 1)
SELECT b.id, n.raw_id, b.first_ord, b.id_claims, n.title, n.external_id, n.description_hash
FROM by_id b JOIN normalized n ON n.raw_id = b.hi""")
def upserted_jobs(spark, sf):
    return dedupe.upsert_jobs(standins.normalized_documents(spark, sf)).select(
        "id", "raw_id", "first_ord", "id_claims", "title", "external_id", "description_hash"
    )


# Few external ids and few fingerprints, so that postings are linked both ways; a third has no external id.
CHAINS = """
rows AS (
  SELECT doc_id AS ord, source, 'd' || doc_id AS id, CASE WHEN doc_id % 3 > 0 THEN (doc_id * 7919 + n_chars) % 61 END AS ext,
         (doc_id * 104729 + n_chars) % 53 AS fp FROM documents),
lists AS (
  SELECT source, list({'id': id, 'ord': ord, 'ext': ext, 'fp': fp, 'jobs': []::STRUCT(id VARCHAR, lo BIGINT, hi BIGINT, ext BIGINT, fp BIGINT)[]} ORDER BY ord) AS l
  FROM rows GROUP BY source),
folded AS (
  SELECT list_reduce(list_prepend({'id': NULL, 'ord': NULL, 'ext': NULL, 'fp': NULL, 'jobs': []}, l), lambda a, r:
    {'id': r.id, 'ord': r.ord, 'ext': r.ext, 'fp': r.fp, 'jobs': list_transform([coalesce(
        CASE WHEN r.ext IS NOT NULL THEN list_position(list_transform(a.jobs, lambda j: j.ext), r.ext) END, list_position(list_transform(a.jobs, lambda j: j.fp), r.fp), len(a.jobs) + 1)],
      lambda p: list_concat(list_concat(a.jobs[1:p - 1],
        [{'id': coalesce(a.jobs[p].id, r.id), 'lo': coalesce(a.jobs[p].lo, r.ord), 'hi': r.ord, 'ext': r.ext, 'fp': r.fp}]),
        a.jobs[p + 1:]))[1]}).jobs AS jobs FROM lists)
"""


@query("upserted_mixed_chains", with_(CHAINS) + "SELECT j.id, j.lo AS first_ord, j.hi AS raw_id FROM (SELECT unnest(jobs) AS j FROM folded)")
def upserted_mixed_chains(spark, sf):
    """Postings whose two keys disagree on what is one job, next to a fold of one row after another."""
    d, c = table(spark, sf, "documents"), F.col
    number = c("doc_id").cast("long")
    external = F.when(number % 3 > 0, (number * 7919 + c("n_chars")) % 61)
    postings = d.select(
        F.concat(F.lit("d"), number.cast("string")).alias("id"), number.alias("raw_id"), c("source").alias("company_id"),
        F.lit("doc").alias("source_type"), external.cast("string").alias("external_id"),
        F.concat_ws("/", "source", ((number * 104729 + c("n_chars")) % 53).cast("string")).alias("dedupe_fingerprint"),
    )
    return dedupe.upsert_jobs(postings).select("id", "first_ord", "raw_id")


@query("upserted_skills", """
SELECT 'skill:' || l_partkey AS skill_id, arg_max(l_shipdate::DATE::VARCHAR, n) AS label, arg_max(l_linestatus, n) AS provenance,
       arg_max(rf, n) FILTER (rf IS NOT NULL) AS category
FROM (SELECT *, CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS rf,
             row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate) AS n FROM lineitem) GROUP BY 1""")
def upserted_skills(spark, sf):
    """Line items as repeated writes of one skill per part, in a fixed total order."""
    c = F.col
    order = [
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount",
        "l_tax", "l_shipdate",
    ]
    flag = F.when(c("l_returnflag") != "N", c("l_returnflag"))
    writes = table(spark, sf, "lineitem").select(
        F.concat(F.lit("skill:"), c("l_partkey").cast("string")).alias("skill_id"),
        c("l_shipdate").cast("date").cast("string").alias("label"),
        F.lit("").alias("normalized_label"),
        F.array().cast("array<string>").alias("aliases"),
        c("l_linestatus").alias("provenance"),
        F.lit(None).cast("string").alias("parent_id"),
        flag.alias("category"),
        F.struct(*order).alias("ord"),
    )
    return dedupe.upsert_skills(writes).select("skill_id", "label", "provenance", "category")


@query("upserted_job_skill_edges", """
WITH w AS (SELECT 'job:' || l_orderkey AS job_id, 'skill:' || l_partkey AS skill_id,
                  CASE WHEN l_returnflag = 'R' THEN 'PREFERS' ELSE 'REQUIRES' END AS edge_type, l_linenumber FROM lineitem)
SELECT job_id, skill_id, edge_type, CASE WHEN edge_type = 'PREFERS' THEN 0.6 ELSE 1.0 END::DOUBLE AS weight, max(l_linenumber)::VARCHAR AS provenance,
       'edge:' || lower(edge_type) || ':' || left(sha256(job_id || '|' || edge_type || '|' || skill_id), 12) AS id
FROM w GROUP BY 1, 2, 3""")
def upserted_job_skill_edges(spark, sf):
    prefers = F.col("l_returnflag") == "R"
    writes = table(spark, sf, "lineitem").select(
        F.concat(F.lit("job:"), F.col("l_orderkey").cast("string")).alias("job_id"),
        F.concat(F.lit("skill:"), F.col("l_partkey").cast("string")).alias("skill_id"),
        F.when(prefers, "PREFERS").otherwise("REQUIRES").alias("edge_type"),
        F.when(prefers, 0.6).otherwise(1.0).alias("weight"),
        F.lit(1.0).alias("confidence"),
        F.col("l_linenumber").cast("string").alias("provenance"),
        F.array().cast("array<string>").alias("evidence"),
        F.col("l_linenumber").alias("ord"),
    )
    return dedupe.upsert_job_skill_edges(writes).select("job_id", "skill_id", "edge_type", "weight", "provenance", "id")


@query("records_by_canonical_url", r"""
SELECT regexp_replace(url, '[?#].*$', '') AS url, min(page_id) AS page_id
FROM (SELECT page_id, regexp_replace(url, '/[0-9]+(/|\.html)?([?#].*)?$', '') AS url FROM pages) GROUP BY 1""")
def records_by_canonical_url(spark, sf):
    """First page per section of a host."""
    section = F.regexp_replace("url", r"/[0-9]+(/|\.html)?([?#].*)?$", "")
    pages = table(spark, sf, "pages").select("page_id", F.regexp_replace(section, r"[?#].*$", "").alias("url"))
    return dedupe.dedupe_by_url(pages, "url", "page_id")[0]


@query("records_by_url_counts", r"""
SELECT count(DISTINCT url) AS emitted, (count(*) - count(DISTINCT url))::BIGINT AS skipped
FROM (SELECT regexp_replace(url, '/[0-9]+(/|\.html)?([?#].*)?$', '') AS url FROM pages)""")
def records_by_url_counts(spark, sf):
    section = F.regexp_replace("url", r"/[0-9]+(/|\.html)?([?#].*)?$", "")
    return dedupe.dedupe_by_url(table(spark, sf, "pages").select("page_id", section.alias("url")), "url", "page_id")[1]


# --- run log -----------------------------------------------------------------


def _run_log(spark, sf):
    """Events as a run log: a user and day is a run, the event type a stage."""
    e = table(spark, sf, "events")
    return e.select(
        F.concat_ws("/", F.col("user_id").cast("string"), F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyy-MM-dd")).alias("run_id"),
        F.col("event_type").alias("stage"),
        F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"),
        F.create_map(F.lit("props"), F.col("props")).alias("details"),
        F.col("ts").cast("timestamp_ntz").cast("timestamp").alias("created_at"),
    )


LOG = "log AS (SELECT user_id || '/' || strftime(ts, '%Y-%m-%d') AS run_id, event_type AS stage, epoch_us(ts) AS us FROM events)"


@query("stage_durations", with_(LOG) + """
SELECT run_id, stage, stage = 'error' AS failed, ((max(us) - min(us)) // 1000)::BIGINT AS duration_ms FROM log GROUP BY 1, 2""")
def stage_durations_query(spark, sf):
    return stage_durations(_run_log(spark, sf)).select("run_id", "stage", "failed", "duration_ms")


@query("run_status", with_(LOG) + """
SELECT run_id, count(DISTINCT stage) AS stages, ((max(us) - min(us)) // 1000)::BIGINT AS duration_ms,
       CASE WHEN bool_or(stage = 'error') THEN 'error' ELSE 'ok' END AS status FROM log GROUP BY 1""")
def run_status_query(spark, sf):
    return run_status(_run_log(spark, sf))


@query("stable_edge_ids", """
SELECT l_orderkey, l_linenumber, 'edge:requires:' || left(sha256(l_orderkey || '|REQUIRES|' || l_partkey), 12) AS id FROM lineitem""")
def stable_edge_ids(spark, sf):
    c = F.col
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        ids.edge_id(c("l_orderkey").cast("string"), F.lit("REQUIRES"), c("l_partkey").cast("string")).alias("id"),
    )
