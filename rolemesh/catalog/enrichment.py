"""Dictionary enrichment of documents with the stand-in taxonomy and cues."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dedupe, enrich, providers
from ..operators.vocabulary import load_taxonomy
from ..plans import standins
from ..plans.standins import RULES, TAXONOMY, table
from ..schemas import CACHE
from ..session import cut_lineage
from .registry import query
from .sql import WS, has_word, strip, strip_tags, with_
from .textual import _rules

CLEAN = f"docs AS (SELECT doc_id, split_part(text, chr(10), 1) AS title, {strip_tags('text')} AS clean FROM documents)"
SENTENCES = f"""
sentences AS (
  SELECT doc_id, list_filter(string_split(regexp_replace(regexp_replace(clean, '([.!?]){WS}+', '\\1' || chr(1), 'g'),
         '([。！？；])', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS parts FROM docs),
sentence_rows AS (SELECT doc_id, unnest(parts) AS sentence, generate_subscripts(parts, 1) AS pos FROM sentences)
"""
TERMS = {
    "with": "with", "thin": "thin|then", "thing": "thing", "que": "que", "der": "der", "pour": "pour|los",
    "license": "license", "are": "are|of the|is",
}


def _skills_cte() -> str:
    rows = []
    for pos, s in enumerate(TAXONOMY):
        test = has_word("lower(sentence)", TERMS[s.normalized_label])
        label_in_text = has_word("lower(clean)", s.normalized_label)
        parent = "NULL" if s.parent_id is None else f"'{s.parent_id}'"
        category = "NULL" if s.category is None else f"'{s.category}'"
        rows.append(
            f"SELECT r.doc_id, {pos} AS skill_pos, '{s.skill_id}' AS skill_id, '{s.label}' AS label, {parent} AS parent_id, "
            f"{category} AS category, list({strip('sentence')} ORDER BY r.pos) AS evidence, any_value({label_in_text}) AS label_in_text "
            f"FROM sentence_rows r JOIN docs USING (doc_id) WHERE {test} GROUP BY r.doc_id"
        )
    found = " UNION ALL ".join(rows)
    preferred = has_word("array_to_string(evidence, ' ')", "than")
    required = has_word("array_to_string(evidence, ' ')", "from")
    return f"""
found AS ({found}),
matches AS (
  SELECT doc_id, skill_pos, skill_id, label, parent_id, category, evidence,
         CASE WHEN {preferred} THEN 'PREFERS' ELSE 'REQUIRES' END AS edge_type,
         CASE WHEN {preferred} THEN 0.6 ELSE 1.0 END::DOUBLE AS weight,
         CASE WHEN {preferred} THEN 0.6 WHEN {required} OR label_in_text THEN 0.75 ELSE 0.7 END::DOUBLE AS confidence
  FROM found)
"""


def _bullets(pattern: str) -> str:
    at = f"list_position(list_transform(parts, lambda x: {has_word('x', pattern)}), true)"
    cut = f"CASE WHEN {at} > 0 THEN list_slice(parts, {at} + 1, {at} + 4) ELSE list_slice(parts, 1, 3) END"
    return (
        f"array_to_string(list_transform(list_filter({cut}, lambda x: {strip('x')} <> ''), "
        "lambda x: trim(x, ' -•·、')), ' # ')"
    )


CTES = with_(CLEAN, SENTENCES, _skills_cte())
SALARY = r"(?i)(?:\$|USD\s*)?\d{2,3}(?:[,\d]{0,6})\s*(?:-|to)\s*(?:\$|USD\s*)?\d{2,3}(?:[,\d]{0,6})"


def _jobs(spark, sf):
    d = table(spark, sf, "documents")
    from ..functions import text

    return d.select(
        F.col("doc_id").cast("string").alias("id"),
        F.substring_index("text", "\n", 1).alias("title"),
        text.normalize_text(F.col("text")).alias("description_text"),
        F.lit(None).cast("string").alias("remote_mode"),
        F.sha2(text.normalize_text(F.col("text")), 256).alias("description_hash"),
    )


@query("sentences", with_(CLEAN, SENTENCES) + "SELECT doc_id, pos, sentence FROM sentence_rows")
def sentences(spark, sf):
    return _jobs(spark, sf).select(
        F.col("id").cast("long").alias("doc_id"), F.posexplode(enrich.split_sentences(F.col("description_text"))).alias("p", "sentence")
    ).select("doc_id", (F.col("p") + 1).cast("long").alias("pos"), "sentence")


@query("contained_terms", f"""
SELECT doc_id, {has_word('text', 'est')} AS est, {has_word('text', 'for the')} AS for_the,
       regexp_matches(text, '(?i)(^|[^\\p{{L}}\\p{{N}}_])été($|[^\\p{{L}}\\p{{N}}_])') AS ete, contains(lower(text), '要求') AS cjk FROM documents""")
def contained_terms(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id",
        enrich.contains_term(t, "est").alias("est"),
        enrich.contains_term(t, "For the").alias("for_the"),
        enrich.contains_term(t, "été").alias("ete"),
        enrich.contains_term(t, "要求").alias("cjk"),
    )


SKILL_MATCHES = CTES + """
SELECT doc_id AS job_id, skill_id, label, parent_id, category, edge_type, weight, confidence,
       array_to_string(evidence[1:5], ' # ') AS evidence FROM matches"""


def _flat_matches(results):
    return enrich.skill_matches(results).select(
        F.col("job_id").cast("long").alias("job_id"), "skill_id", "label", "parent_id", "category", "edge_type", "weight", "confidence",
        F.array_join("evidence", " # ").alias("evidence"),
    )


@query("skill_matches", SKILL_MATCHES)
def skill_matches(spark, sf):
    return _flat_matches(enrich.enrich(_jobs(spark, sf), TAXONOMY, RULES))


LARGE = 2_000
LARGE_TAXONOMY = with_(CLEAN, SENTENCES).rstrip() + f""",
w AS (
  SELECT word FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(clean), '[\\p{{L}}\\p{{N}}_]+')) AS word FROM docs)
  WHERE regexp_full_match(word, '[a-z]{{5,}}') ORDER BY md5(word) LIMIT {LARGE}),
t AS (
  SELECT DISTINCT doc_id, pos, sentence, word FROM (
    SELECT doc_id, pos, sentence, unnest(regexp_extract_all(lower(sentence), '[\\p{{L}}\\p{{N}}_]+')) AS word FROM sentence_rows)
  SEMI JOIN w USING (word)),
f AS (
  SELECT doc_id, word, list({strip('sentence')} ORDER BY pos) AS evidence FROM t GROUP BY 1, 2)
SELECT doc_id AS job_id, 'skill:' || word AS skill_id,
       CASE WHEN {has_word("array_to_string(evidence, ' ')", "than")} THEN 'PREFERS' ELSE 'REQUIRES' END AS edge_type,
       CASE WHEN {has_word("array_to_string(evidence, ' ')", "than")} THEN 0.6 ELSE 0.75 END::DOUBLE AS confidence,
       array_to_string(evidence[1:5], ' # ') AS evidence FROM f"""


@query("skill_matches_large_taxonomy", LARGE_TAXONOMY)
def skill_matches_large_taxonomy(spark, sf):
    """A taxonomy of 2,000 words that the documents themselves hold."""
    jobs = _jobs(spark, sf)
    words = jobs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("description_text"), F.lit(r"(?U)\w+"), F.lit(0)))).alias("word"))
    some = words.where(F.col("word").rlike("^[a-z]{5,}$")).distinct().orderBy(F.md5("word")).limit(LARGE)
    taxonomy = load_taxonomy({r.word: {} for r in some.collect()})
    return _flat_matches(enrich.enrich(jobs, taxonomy, RULES)).select("job_id", "skill_id", "edge_type", "confidence", "evidence")


@query("enriched_jobs", CTES.rstrip() + f""",
merged AS (
  SELECT doc_id, array_to_string(list(item ORDER BY seq)[1:20], ' # ') AS evidence FROM (
    SELECT doc_id, item, min(skill_pos * 100 + i) AS seq FROM (
      SELECT doc_id, skill_pos, unnest(evidence[1:5]) AS item, generate_subscripts(evidence[1:5], 1) AS i FROM matches)
    GROUP BY 1, 2) GROUP BY 1)
SELECT d.doc_id AS job_id, array_to_string(list_filter(list_transform(parts, lambda x: {strip('x')}), lambda x: x <> '')[1:2], ' ') AS summary,
       {_rules("title || ' ' || clean", RULES.role_families)} AS role_family,
       {_rules("title || ' ' || clean", RULES.seniority)} AS seniority,
       nullif(regexp_extract(clean, '{SALARY}', 0), '') AS salary_text,
       {_bullets('from')} AS responsibilities, {_bullets('with')} AS qualifications,
       coalesce(m.evidence, '') AS evidence, CASE WHEN m.doc_id IS NULL THEN 0.35 ELSE 0.55 END::DOUBLE AS confidence
FROM docs d JOIN sentences s USING (doc_id) LEFT JOIN merged m ON m.doc_id = d.doc_id""")
def enriched_jobs(spark, sf):
    out = enrich.enrich(_jobs(spark, sf), TAXONOMY, RULES)

    def joined(name):
        return F.array_join(name, " # ").alias(name)

    return out.select(
        F.col("job_id").cast("long").alias("job_id"), "summary", "role_family", "seniority", "salary_text", joined("responsibilities"),
        joined("qualifications"), joined("evidence"), "confidence",
    )


STORED = """
SELECT skill_id, max(label) AS label, max(parent_id) AS parent_id, count(*) AS matches FROM matches GROUP BY 1"""


@query("stored_skills", CTES + STORED)
def stored_skills(spark, sf):
    """Only skills some job matched end up in the skill table."""
    # Read by the skill table and by the counts, so the texts are enriched once.
    results = cut_lineage(enrich.enrich(_jobs(spark, sf), TAXONOMY, RULES).select("job_id", "evidence", "skills"))
    tables = enrich.store_results(results)
    counts = enrich.skill_matches(results).groupBy("skill_id").agg(F.count("*").alias("matches"))
    return tables["skills"].join(counts, "skill_id").select("skill_id", "label", "parent_id", "matches")


@query("stored_job_skill_edges", CTES + """
SELECT doc_id AS job_id, skill_id, edge_type, weight, confidence,
       'edge:' || lower(edge_type) || ':' || left(sha256(doc_id || '|' || edge_type || '|' || skill_id), 12) AS id FROM matches""")
def stored_job_skill_edges(spark, sf):
    results = enrich.enrich(_jobs(spark, sf), TAXONOMY, RULES)
    edges = enrich.store_results(results)["edges"]
    return edges.select(F.col("job_id").cast("long").alias("job_id"), "skill_id", "edge_type", "weight", "confidence", "id")


@query("jobs_with_enrichment_and_company", """
SELECT o_orderkey, c_name AS company_name, e.n AS lines FROM orders
LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) e ON e.l_orderkey = o_orderkey""")
def jobs_with_enrichment_and_company(spark, sf):
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"))
    return (
        table(spark, sf, "orders")
        .join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey"), "left")
        .join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left")
        .select("o_orderkey", F.col("c_name").alias("company_name"), "lines")
    )


@query("jobs_pending_enrichment", "SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def jobs_pending_enrichment(spark, sf):
    """Documents without a label count as not enriched yet."""
    done = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("job_id"))
    return enrich.pending_jobs(_jobs(spark, sf).select("id"), done).select(F.col("id").cast("long").alias("id"))


def _cache_run(spark, sf):
    """Labelled documents filled the cache earlier; now all documents are enriched."""
    jobs = _jobs(spark, sf)
    provider = providers.HeuristicProvider(RULES)
    labelled = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("id"))
    empty = spark.createDataFrame([], CACHE)
    earlier = enrich.cached_enrichment(jobs.join(labelled, "id", "left_semi"), empty, TAXONOMY, provider)[1]
    return enrich.cached_enrichment(jobs, earlier, TAXONOMY, provider)


@query("cached_enrichment", CTES.rstrip() + """,
first_doc AS (SELECT doc_id, first_value(doc_id) OVER (PARTITION BY clean ORDER BY labelled DESC, doc_id::VARCHAR) AS source_id
  FROM (SELECT doc_id, clean, doc_id IN (SELECT doc_id FROM labels) AS labelled FROM docs)),
n AS (SELECT doc_id, count(*) AS skills FROM matches GROUP BY 1)
SELECT f.doc_id::VARCHAR AS job_id, coalesce(n.skills, 0) AS skills,
       """ + _rules("title || ' ' || clean", RULES.seniority) + """ AS seniority
FROM first_doc f JOIN docs d ON d.doc_id = f.source_id LEFT JOIN n ON n.doc_id = f.source_id""")
def cached_enrichment(spark, sf):
    results = _cache_run(spark, sf)[0]
    return results.select(F.col("job_id").cast("string").alias("job_id"), F.size("skills").cast("long").alias("skills"), "seniority")


@query("cache_counters", with_(CLEAN).rstrip() + """,
l AS (SELECT clean, bool_or(doc_id IN (SELECT doc_id FROM labels)) AS cached, count(*) AS n FROM docs GROUP BY 1)
SELECT sum(n)::BIGINT AS jobs_processed, (sum(n) - count(*) FILTER (NOT cached))::BIGINT AS cache_hits,
       count(*) FILTER (NOT cached) AS cache_misses, count(*) FILTER (NOT cached) AS cache_writes FROM l""")
def cache_counters(spark, sf):
    return _cache_run(spark, sf)[2]


@query("provider_requests", r"""
SELECT doc_id::VARCHAR AS job_id, lang AS location, n_chars AS chars, 8 AS taxonomy_rows FROM documents""")
def provider_requests(spark, sf):
    """One request per document, read back field by field."""
    d = table(spark, sf, "documents")
    jobs = d.select(
        F.col("doc_id").cast("string").alias("id"), F.lit("t").alias("title"), F.col("source").alias("company_name"),
        F.col("lang").alias("location_text"), F.col("text").alias("description_text"), F.lit("u").alias("source_url"),
        F.lit(None).cast("string").alias("remote_mode"), F.lit(None).cast("string").alias("employment_type"),
        F.sha2("text", 256).alias("description_hash"),
    )
    v = F.try_parse_json("request")
    return providers.build_provider_requests(jobs, TAXONOMY).select(
        "job_id",
        F.try_variant_get(v, "$.job.location_text", "string").alias("location"),
        F.length(F.try_variant_get(v, "$.job.description_text", "string")).cast("long").alias("chars"),
        F.size(F.try_variant_get(v, "$.taxonomy", "array<variant>")).alias("taxonomy_rows"),
    )


@query("parsed_provider_responses", r"""
SELECT doc_id AS job_id, source AS summary, CASE WHEN lang = 'en' THEN 'senior' END AS seniority,
       CASE lang WHEN 'en' THEN 1.0 WHEN 'de' THEN 0.0 WHEN 'fr' THEN 0.25 END::DOUBLE AS confidence,
       'skill:' || lang AS skill_id, CASE WHEN lang = 'en' THEN 'PREFERS' ELSE 'REQUIRES' END AS edge_type,
       CASE WHEN lang = 'en' THEN 'quoted' ELSE '' END AS evidence
FROM documents WHERE lang <> 'es'""")
def parsed_provider_responses(spark, sf):
    good, _ = _responses(spark, sf)
    return good.select(
        "job_id", "summary", "seniority", "confidence", F.get("skills", 0)["skill_id"].alias("skill_id"),
        F.get("skills", 0)["edge_type"].alias("edge_type"),
        F.array_join(F.get("skills", 0)["evidence"], ",").alias("evidence"),
    )


@query("rejected_provider_responses", "SELECT doc_id AS job_id, 'answer holds no JSON object' AS reason FROM documents WHERE lang = 'es'")
def rejected_provider_responses(spark, sf):
    return _responses(spark, sf)[1]


def _responses(spark, sf):
    """Model answers written from document fields: fenced, wrapped, inside prose, broken."""
    lang, source = F.col("lang"), F.col("source")
    en = F.concat(
        F.lit('```json\n{"result": {"data": {"summary": "'), source,
        F.lit('", "seniority": " senior ", "confidence": 7, "skills": [{"skill_id": "skill:en", "label": "E", "edge_type": "prefers", "evidence_quotes": "quoted"}, "noise"]}}}\n```'),
    )
    de = F.concat(
        F.lit('Sure! Here it is: {"summary": "'), source,
        F.lit('", "confidence": -3, "skills": [{"skill_id": "skill:de", "label": "D"}]} Anything else?'),
    )
    fr = F.concat(
        F.lit('[{"summary": "'), source,
        F.lit('", "confidence": "0.25", "skills": [{"skill_id": "skill:fr", "label": "F"}]}]'),
    )
    content = F.when(lang == "en", en).when(lang == "de", de).when(lang == "fr", fr).otherwise(F.concat(F.lit("no { answer for "), source))
    answers = table(spark, sf, "documents").select(F.col("doc_id").alias("job_id"), content.alias("content"))
    return providers.parse_provider_responses(answers, "test-model")


@query("enveloped_provider_responses", with_(f"d AS (SELECT doc_id, {strip('text')} AS summary FROM documents)") + """
SELECT doc_id AS job_id, nullif(summary, '') AS summary, 'quoted' AS evidence FROM d""")
def enveloped_provider_responses(spark, sf):
    """Whole texts as answers in every shape of a response body, blank evidence before the quoted one."""
    d = table(spark, sf, "documents")
    answer = F.to_json(
        F.struct(F.col("text").alias("summary"), F.lit("").alias("evidence"), F.array(F.lit("quoted")).alias("evidence_quotes"))
    )
    half = F.floor(F.length(answer) / 2).cast("int")

    def part(value):
        return F.struct(F.lit("text").alias("type"), value.alias("text"))

    parts = F.array(part(F.substring(answer, F.lit(1), half)), part(F.substring(answer, half + 1, F.length(answer))))
    chat = F.to_json(F.struct(F.array(F.struct(F.struct(answer.alias("content")).alias("message"))).alias("choices")))
    chat_parts = F.to_json(F.struct(F.array(F.struct(F.struct(parts.alias("content")).alias("message"))).alias("choices")))
    plain = F.to_json(F.struct(answer.alias("output_text")))
    output = F.to_json(F.struct(F.array(F.struct(parts.alias("content"))).alias("output")))
    lang = F.col("lang")
    body = F.when(lang == "en", chat).when(lang == "de", chat_parts).when(lang == "fr", plain).otherwise(output)
    answers = d.select(F.col("doc_id").alias("job_id"), providers.response_content(body).alias("content"))
    good, _ = providers.parse_provider_responses(answers, "test-model")
    return good.select("job_id", "summary", F.array_join("evidence", ",").alias("evidence"))


@query("upserted_enrichment", """
WITH r AS (
  SELECT doc_id // 4 AS job_id, source AS summary, lang AS seniority, doc_id AS ord, 'run-' || source AS written_at FROM documents
  UNION ALL SELECT d.doc_id // 4, NULL, d.lang, 1000000000000 + d.doc_id, 'run-x' FROM documents d WHERE d.doc_id IN (SELECT doc_id FROM labels))
SELECT job_id, summary, seniority, created_at, updated_at FROM (
  SELECT *, min(written_at) OVER w AS created_at, max(written_at) OVER w AS updated_at,
         row_number() OVER (PARTITION BY job_id ORDER BY ord DESC) AS back FROM r WINDOW w AS (PARTITION BY job_id)) WHERE back = 1""")
def upserted_enrichment(spark, sf):
    """Four documents are results of one job; labelled ones come again without a summary."""
    d = table(spark, sf, "documents")
    job = F.floor(F.col("doc_id") / 4).cast("long").alias("job_id")
    first = d.select(job, F.col("source").alias("summary"), F.col("lang").alias("seniority"), F.col("doc_id").cast("long").alias("ord"),
                     F.concat(F.lit("run-"), "source").alias("written_at"))
    again = d.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi").select(
        job, F.lit(None).cast("string").alias("summary"), F.col("lang").alias("seniority"),
        (F.col("doc_id") + F.lit(1_000_000_000_000)).alias("ord"), F.lit("run-x").alias("written_at"),
    )
    return enrich.upsert_enrichment(first.unionByName(again), "ord", "written_at").select(
        "job_id", "summary", "seniority", "created_at", "updated_at"
    )


@query("invalid_results", "SELECT doc_id::VARCHAR AS job_id, 'skills must be a list' AS reason FROM documents WHERE lang = 'fr'")
def invalid_results(spark, sf):
    results = enrich.enrich(_jobs(spark, sf), TAXONOMY, RULES)
    langs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("job_id"), "lang")
    broken = results.join(langs, "job_id").withColumn("skills", F.when(F.col("lang") != "fr", F.col("skills")))
    return enrich.invalid_results(broken)


@query("resolved_document_companies", """
SELECT company_id, count(*) AS postings FROM (
  SELECT CASE lower(source) WHEN 'src1' THEN 'company:one' WHEN 'src2' THEN 'company:one' WHEN 'src3' THEN 'company:three'
         ELSE 'company:' || lower(source) END AS company_id FROM documents) GROUP BY 1""")
def resolved_document_companies(spark, sf):
    resolved = dedupe.resolve_company(standins.raw_jobs(spark, sf), dedupe.alias_table(spark, standins.ALIASES))
    return resolved.groupBy("company_id").agg(F.count("*").alias("postings"))
