"""Files read and written, contracts, and streams next to the batch results they must equal."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import enrich, graph, providers, quality
from ..operators.vocabulary import read_taxonomy, taxonomy_hash
from ..plans import standins
from ..plans.standins import RULES, TAXONOMY, table
from ..schemas import CONTRACTS, RAW_COLUMNS
from ..session import scratch_folder
from ..sinks import tables
from ..sources import files
from ..streaming import ingest
from .enrichment import CTES, _cache_run, _jobs
from .entities import LAST_WINS
from .registry import query
from .sql import GRAPH, with_

# --- files -------------------------------------------------------------------


def _as_array_files(records: DataFrame, path: str) -> None:
    """One JSON array for each partition of ``records`` (json), written entry by entry."""

    def run(batches):
        import pyarrow as pa

        opened = False
        for batch in batches:
            if batch.num_rows:
                lines = [("," if opened or i else "[") + v for i, v in enumerate(batch.column("json").to_pylist())]
                opened = True
                yield pa.RecordBatch.from_arrays([pa.array(lines)], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["]" if opened else "[]"])], names=["value"])

    records.mapInArrow(run, "value string").write.text(path)


@query("raw_jobs_from_array_files", """
SELECT 'doc://' || doc_id AS source_url, split_part(text, chr(10), 1) AS title, source AS company_name,
       CASE WHEN lang <> 'fr' THEN n_chars::VARCHAR END AS external_job_id, md5(text) AS text_md5, lang AS note FROM documents
UNION ALL SELECT 'line://' || doc_id, split_part(text, chr(10), 1), source, NULL, md5(text), NULL FROM documents""")
def raw_jobs_from_array_files(spark, sf):
    """Whole documents landed in array files and in files of lines, read back as postings."""
    folder = scratch_folder(spark, "landed")
    noted = standins.raw_jobs(spark, sf).withColumn("metadata", F.create_map(F.lit('no}"{te'), F.col("location_text")))
    as_json = F.to_json(F.struct(*RAW_COLUMNS), {"ignoreNullFields": "false"}).alias("json")
    _as_array_files(noted.select(as_json), f"{folder}/arrays")
    lined = noted.withColumn("source_url", F.replace("source_url", F.lit("doc:"), F.lit("line:"))).withColumn("metadata", F.lit(None))
    lined = lined.withColumn("external_job_id", F.lit(None).cast("string"))
    lined.select(as_json).write.option("compression", "none").text(f"{folder}/lines/")
    arrays, _ = files.read_raw_jobs(spark, f"{folder}/arrays", documents="part-*.txt")
    lines, _ = files.read_raw_jobs(spark, f"{folder}/lines", lines="part-*.txt")
    return arrays.unionByName(lines).select(
        "source_url", "title", "company_name", "external_job_id", F.md5("description_text").alias("text_md5"),
        F.element_at("metadata", F.lit('no}"{te')).alias("note"),
    )


@query("truth_tables_written", """
SELECT 1::BIGINT AS version, 'companies' AS name, 'company:' || c_custkey AS id FROM customer
UNION ALL SELECT 1, 'skills', 'skill:' || p_partkey FROM part
UNION ALL SELECT 2, 'companies', 'company:' || c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'""")
def truth_tables_written(spark, sf):
    """Two versions of the company table, the second one written twice."""
    root = scratch_folder(spark, "truth")
    companies, skills = standins.companies(spark, sf), standins.skills(spark, sf)
    some = companies.where("industry = 'BUILDING'")
    tables.write_truth_tables({"companies": companies, "skills": skills}, root, 1)
    for df in (companies, some):
        tables.write_truth_tables({"companies": df}, root, 2)
    parts = [(1, "companies"), (1, "skills"), (2, "companies")]
    out = [
        tables.read_version(spark, f"{root}/{name}", v).select(
            F.lit(v).cast("long").alias("version"), F.lit(name).alias("name"), "id"
        )
        for v, name in parts
    ]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("written_rows_counted", """
SELECT 'companies' AS name, count(*) AS n FROM customer UNION ALL SELECT 'skills', count(*) FROM part
UNION ALL SELECT 'jobs', count(*) FROM orders""")
def written_rows_counted(spark, sf):
    """Row counts observed while the tables were written."""
    named = {"companies": standins.companies(spark, sf), "skills": standins.skills(spark, sf), "jobs": standins.jobs(spark, sf)}
    counts = tables.write_truth_tables(named, scratch_folder(spark, "truth"), 1)
    return spark.createDataFrame(list(counts.items()), "name string, n long")


@query("read_models_written", with_(GRAPH) + """
SELECT 'skill_jobs' AS model, skill_id AS key, job_id AS value, edge_type AS kind FROM known
UNION ALL SELECT 'company_jobs', company_id, id, NULL FROM jobs""")
def read_models_written(spark, sf):
    root = scratch_folder(spark, "models")
    name = f"skill_jobs_{uuid.uuid4().hex}"
    models = {
        "skill_jobs": graph.skill_jobs(standins.known(spark, sf)), "company_jobs": graph.company_jobs(standins.jobs(spark, sf))
    }
    tables.write_read_models(models, root, skill_table=name)
    skills = spark.table(name).select(F.lit("skill_jobs").alias("model"), F.col("skill_id").alias("key"), F.col("job_id").alias("value"), F.col("edge_type").alias("kind"))
    companies = spark.read.json(f"{root}/company_jobs").select(
        F.lit("company_jobs").alias("model"), F.col("company_id").alias("key"), F.col("job_id").alias("value"), F.lit(None).cast("string").alias("kind")
    )
    return skills.unionByName(companies)


@query("json_lines_written", """
SELECT '{"doc_id":' || doc_id || ',"lang":"' || lang || '","note":null,"text":' || to_json(text)::VARCHAR || '}' AS line FROM documents""")
def json_lines_written(spark, sf):
    path = scratch_folder(spark, "lines")
    docs = table(spark, sf, "documents").select("doc_id", "lang", F.lit(None).cast("string").alias("note"), "text")
    tables.write_jsonl(docs, path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("run_log_appended", """
SELECT 'r1' AS run_id, 'import' AS stage, 'ok' AS status, 'seen=' || (SELECT count(*) FROM orders) AS details
UNION ALL SELECT 'r1', 'enrich', 'error', '' UNION ALL SELECT 'r2', 'import', 'ok', 'seen=' || (SELECT count(*) FROM customer)""")
def run_log_appended(spark, sf):
    path = scratch_folder(spark, "log")
    for run, stage, status, source in (("r1", "import", "ok", "orders"), ("r1", "enrich", "error", None), ("r2", "import", "ok", "customer")):
        details = {"seen": table(spark, sf, source).count()} if source else None
        tables.append_run_log(spark, path, run, stage, status, details)
    shown = F.array_join(F.transform(F.map_entries("details"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return spark.read.parquet(path).select("run_id", "stage", "status", shown.alias("details"))


@query("validated_companies_written", """
SELECT 'company:' || c_custkey AS id, c_name AS name, (SELECT count(*) FROM customer) AS written FROM customer""")
def validated_companies_written(spark, sf):
    path = scratch_folder(spark, "valid")
    written = tables.write_validated(standins.companies(spark, sf), path, "company", "id")
    return spark.read.parquet(path).select("id", "name", F.lit(written).cast("long").alias("written"))


@query("refused_company_write", """
SELECT 'company[company:' || c_custkey || ']: $.name expected string, got NoneType' AS message FROM customer WHERE c_custkey = (
  SELECT min(c_custkey) FROM customer)""")
def refused_company_write(spark, sf):
    """One company without a name: nothing is written, and the error names it."""
    companies = standins.companies(spark, sf)
    number = F.substring_index("id", ":", -1).cast("long")
    first = companies.agg(F.min(number)).first()[0]
    broken = companies.withColumn("name", F.when(number != first, F.col("name")))
    try:
        tables.write_validated(broken, scratch_folder(spark, "refused"), "company", "id")
        message = "written"
    except quality.ContractError as error:
        message = str(error)
    return spark.createDataFrame([(message,)], "message string")


# --- contracts ---------------------------------------------------------------


def _sample(contract: dict):
    """A value that keeps a contract, required members only."""
    names = contract.get("type", "string")
    kind = names if isinstance(names, str) else names[0]
    if kind == "object":
        extra = contract.get("additionalProperties")
        members = {k: _sample(contract["properties"][k]) for k in contract.get("required", [])}
        return members | ({"k": _sample(extra)} if isinstance(extra, dict) else {})
    if kind == "array":
        return [_sample(contract["items"])] if isinstance(contract.get("items"), dict) else []
    return {"string": "s", "number": 0.5, "integer": 1, "boolean": True}.get(kind)


def _broken(contract: dict, value, path: str = "$"):
    """(value, path, message) with the first scalar on the way down replaced by one of a wrong type."""
    if isinstance(value, dict):
        key = next(iter(value))
        sub = contract.get("properties", {}).get(key) or contract["additionalProperties"]
        inner, at, message = _broken(sub, value[key], f"{path}.{key}")
        return value | {key: inner}, at, message
    if isinstance(value, list) and value:
        inner, at, message = _broken(contract["items"], value[0], f"{path}[0]")
        return [inner], at, message
    names = contract["type"]
    wrong, name = (True, "bool")
    return wrong, path, f"expected {names if isinstance(names, str) else ' | '.join(names)}, got {name}"


def _contract_cases() -> list[tuple[str, str, str | None, str | None]]:
    """(contract, JSON, path, message): a record that keeps each contract, and one that breaks it."""
    out = []
    for name, contract in sorted(CONTRACTS.items()):
        good = _sample(contract)
        bad, path, message = _broken(contract, good)
        out += [(name, json.dumps(good), None, None), (name, json.dumps(bad), path, message)]
    return out


def _contract_sql() -> str:
    rows = ", ".join(
        f"('{name}', '{path}', '{message}')" for name, _, path, message in _contract_cases() if message is not None
    )
    return f"""
SELECT c.name || '[' || doc_id || ']' AS context, c.path, c.message
FROM documents, (VALUES {rows}) c(name, path, message) WHERE doc_id % 2 = 1"""


@query("contract_violations", _contract_sql())
def contract_violations(spark, sf):
    """All contracts: every second document stands for a record that breaks each of them."""
    docs = table(spark, sf, "documents").select("doc_id")
    out = None
    for (name, good, _, _), (_, bad, _, _) in zip(*[iter(_contract_cases())] * 2):
        records = docs.select("doc_id", F.when(F.col("doc_id") % 2 == 1, bad).otherwise(good).alias("json"))
        context = F.concat(F.lit(f"{name}["), F.col("doc_id").cast("string"), F.lit("]"))
        found = quality.violations(records, name, "json", context)
        out = found if out is None else out.unionByName(found)
    return out


# --- taxonomy and providers --------------------------------------------------


def _brand_taxonomy(spark: SparkSession, sf: str):
    """The brands of the parts as a taxonomy file, written and read back."""
    brands = table(spark, sf, "part").groupBy("p_brand").agg(F.min("p_type").alias("m"))  # a few dozen
    meta = F.struct(F.array(F.lower("m")).alias("aliases"), F.col("m").alias("category"))
    entries = brands.agg(F.sort_array(F.collect_list(F.struct(F.lower("p_brand").alias("k"), meta.alias("v")))).alias("e"))
    path = scratch_folder(spark, "taxonomy")
    entries.select(F.to_json(F.map_from_entries("e")).alias("value")).write.text(path)
    return read_taxonomy(spark, path)


BRANDS = "b AS (SELECT lower(p_brand) AS name, p_brand AS label, min(p_type) AS category FROM part GROUP BY p_brand)"


@query("loaded_taxonomy", with_(BRANDS) + """
SELECT name AS normalized_label, 'skill:' || replace(name, '#', '-') AS skill_id, label, lower(category) AS alias, category,
       row_number() OVER (ORDER BY name) AS place FROM b""")
def loaded_taxonomy(spark, sf):
    rows = [
        (s.normalized_label, s.skill_id, s.label, s.aliases[0], s.category, i)
        for i, s in enumerate(_brand_taxonomy(spark, sf), 1)
    ]
    return spark.createDataFrame(rows, "normalized_label string, skill_id string, label string, alias string, category string, place long")


@query("taxonomy_fingerprint", with_(BRANDS) + """
SELECT sha256('[' || string_agg('{"aliases":["' || lower(category) || '"],"category":"' || category || '","label":"' || label
       || '","normalized_label":"' || name || '","parent_id":null,"skill_id":"skill:' || replace(name, '#', '-') || '"}', ',' ORDER BY name)
       || ']') AS fingerprint, count(*) AS entries FROM b""")
def taxonomy_fingerprint(spark, sf):
    taxonomy = _brand_taxonomy(spark, sf)
    return spark.createDataFrame([(taxonomy_hash(taxonomy), len(taxonomy))], "fingerprint string, entries long")


def _first_word(job: dict, taxonomy: list[dict]) -> dict:
    """A row provider: the title as the summary, and a skill named by the job's language."""
    return {
        "job_id": job["id"], "summary": job["title"], "evidence": [], "confidence": 0.25,
        "skills": [{"skill_id": taxonomy[0]["skill_id"], "label": job["lang"], "edge_type": "PREFERS", "evidence": [job["lang"]]}],
    }


@query("row_provider_results", """
SELECT doc_id::VARCHAR AS job_id, nullif(trim(split_part(text, chr(10), 1)), '') AS summary, 0.25::DOUBLE AS confidence, 'skill:with' AS skill_id,
       lang AS label, 'PREFERS' AS edge_type, 'rows' AS provenance FROM documents""")
def row_provider_results(spark, sf):
    """A callable found by name in the provider registry and run on every document."""
    provider = providers.build_provider("Callable", name="rows", fn=_first_word, cache_key="rows-v1")
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.substring_index("text", "\n", 1).alias("title"), "lang"
    )
    skill = F.get("skills", 0)
    return provider.enrich(docs, TAXONOMY).select(
        "job_id", "summary", "confidence", skill["skill_id"].alias("skill_id"), skill["label"].alias("label"),
        skill["edge_type"].alias("edge_type"), skill["provenance"].alias("provenance"),
    )


@query("provider_registry", """
SELECT kind, name, signature, (SELECT count(*) FROM documents) AS jobs FROM (VALUES
  ('heuristic', 'heuristic', 'heuristic'), ('callable', 'rows', 'rows-v1'), ('callable', 'plain', 'plain')) p(kind, name, signature)""")
def provider_registry(spark, sf):
    """Providers by name, with what stands for them in cache keys; each can enrich the documents."""
    built = [
        ("heuristic", providers.build_provider(None)),
        ("callable", providers.build_provider("callable", name="rows", fn=_first_word, cache_key=lambda: "rows-v1")),
        ("callable", providers.build_provider("CALLABLE", name="plain", fn=_first_word)),
    ]
    docs = _jobs(spark, sf).withColumn("lang", F.lit("x"))
    out = None
    for kind, provider in built:
        one = provider.enrich(docs, TAXONOMY).agg(F.count("*").alias("jobs")).select(
            F.lit(kind).alias("kind"), F.lit(provider.name).alias("name"), F.lit(providers.provider_signature(provider)).alias("signature"), "jobs"
        )
        out = one if out is None else out.unionByName(one)
    return out


@query("enrichment_run_counters", CTES.rstrip() + """,
l AS (SELECT clean, bool_or(doc_id IN (SELECT doc_id FROM labels)) AS cached, count(*) AS n FROM docs GROUP BY 1)
SELECT sum(n)::BIGINT AS jobs_processed, (sum(n) - count(*) FILTER (NOT cached))::BIGINT AS cache_hits,
       count(*) FILTER (NOT cached) AS cache_misses, count(*) FILTER (NOT cached) AS cache_writes,
       (SELECT count(DISTINCT skill_id) FROM matches) AS skills_written, (SELECT count(*) FROM matches) AS edges_written FROM l""")
def enrichment_run_counters(spark, sf):
    """Cache hits and misses of a run, and the skills and edges that its writes counted."""
    results, _, counts = _cache_run(spark, sf)
    found = enrich.store_results(results)
    written = tables.write_truth_tables(
        {"skills": found["skills"], "job_skill_edges": found["edges"]}, scratch_folder(spark, "run"), 1
    )
    return enrich.run_counters(counts, written)


COMPANY_OF = "CASE WHEN source <> 'src1' THEN 'company:' || source END"


def _document_tables(spark, sf):
    """Documents as jobs of their source, enriched where they have a label; one source has no company row."""
    docs = table(spark, sf, "documents")
    jobs = _jobs(spark, sf).join(
        docs.select(F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("company:"), "source").alias("company_id")), "id"
    )
    labelled = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("id"))
    enrichment = enrich.enrich(jobs.join(labelled, "id", "left_semi"), TAXONOMY, RULES)
    companies = docs.where("source <> 'src1'").select(
        F.concat(F.lit("company:"), "source").alias("id"), F.upper("source").alias("name")
    ).distinct()
    return jobs, enrichment, companies


ENRICHED = CTES.rstrip() + """,
e AS (
  SELECT d.doc_id, count(m.skill_id) AS skills, CASE WHEN count(m.skill_id) > 0 THEN 0.55 ELSE 0.35 END::DOUBLE AS confidence
  FROM docs d LEFT JOIN matches m ON m.doc_id = d.doc_id WHERE d.doc_id IN (SELECT doc_id FROM labels) GROUP BY 1)
"""


@query("jobs_with_enrichment", ENRICHED + """
SELECT d.doc_id::VARCHAR AS id, CASE WHEN source <> 'src1' THEN upper(source) END AS company_name, e.confidence, e.skills
FROM documents d LEFT JOIN e USING (doc_id)""")
def jobs_with_enrichment(spark, sf):
    jobs, enrichment, companies = _document_tables(spark, sf)
    return enrich.jobs_with_enrichment(jobs, enrichment, companies).select(
        "id", "company_name", "enrichment.confidence", F.size("enrichment.skills").cast("long").alias("skills")
    ).withColumn("skills", F.when(F.col("confidence").isNotNull(), F.col("skills")))


@query("hydrated_jobs_with_enrichment", ENRICHED + """
SELECT d.doc_id::VARCHAR AS id, CASE WHEN source = 'src1' THEN 'company:src1' ELSE upper(source) END AS company_name, e.confidence,
       CASE WHEN e.doc_id IS NOT NULL THEN 'heuristic' END AS model_name
FROM documents d LEFT JOIN e USING (doc_id)""")
def hydrated_jobs_with_enrichment(spark, sf):
    """The public job rows with their nested enrichment; a job without one has null in its place."""
    out = graph.hydrate_jobs(*_document_tables(spark, sf))
    return out.select("id", "company_name", "enrichment.confidence", "enrichment.model_name")


# --- streams -----------------------------------------------------------------


def _arrivals(df: DataFrame, parts: list, name: str, run) -> None:
    """The table as parts that land one after the other; ``run`` streams what has landed, a batch a part."""
    path = scratch_folder(df.sparkSession, name)
    for condition in parts:
        df.where(condition).write.mode("append").parquet(path)
        run(df.sparkSession.readStream.schema(df.schema).parquet(path)).awaitTermination()


@query("streamed_first_postings", """
WITH raw AS (SELECT doc_id, CASE WHEN lang <> 'fr' THEN 'doc::' || source || '::' || n_chars ELSE 'doc::doc://' || doc_id END AS source_key FROM documents)
SELECT source_key, min(doc_id) AS raw_id FROM raw GROUP BY 1""")
def streamed_first_postings(spark, sf):
    """Postings arriving in three batches, the second one again with the third: the first one per key stays."""
    raw = standins.raw_jobs(spark, sf).select("raw_id", "source_type", "company_name", "external_job_id", "source_url")
    low, high = raw.agg(F.expr("percentile_approx(raw_id, 0.3)"), F.expr("percentile_approx(raw_id, 0.7)")).first()
    parts = [F.col("raw_id") < low, F.col("raw_id").between(low, high), F.col("raw_id") >= low]
    path, progress = scratch_folder(spark, "postings"), scratch_folder(spark, "progress")
    _arrivals(raw, parts, "arrived", lambda stream: ingest.stream_raw_ingest(stream, path, progress))
    return tables.read_versions(spark, path).select("source_key", "raw_id")


@query("streamed_last_wins", LAST_WINS)
def streamed_last_wins(spark, sf):
    """Events arriving out of order in four batches, compacted in between."""
    events = table(spark, sf, "events").select(
        "user_id", "event_type", "props", "event_id", F.when(F.col("value") > 50, F.col("value")).alias("big"), F.col("event_id").alias("ord")
    )
    path, progress, keys = scratch_folder(spark, "state"), scratch_folder(spark, "progress"), ["user_id", "event_type"]
    parts = [F.col("event_id") % 4 == i for i in (2, 0, 3, 1)]
    _arrivals(
        events, parts, "arrived",
        lambda stream: ingest.stream_upsert(stream, path, progress, keys, "ord", ["props", "event_id"], ["big"]),
    )
    ingest.compact(spark, path, keys)
    return ingest.current_state(spark, path, keys)


@query("streamed_enrichment", CTES + """
SELECT doc_id::VARCHAR AS job_id, skill_id, edge_type, confidence FROM matches""")
def streamed_enrichment(spark, sf):
    """Documents arriving in two batches that overlap; copies of a text share one result."""
    jobs = _jobs(spark, sf).withColumn("ord", F.col("id").cast("long"))
    path, progress = scratch_folder(spark, "enriched"), scratch_folder(spark, "progress")
    _arrivals(
        jobs, [F.col("ord") % 3 < 2, F.col("ord") % 3 > 0], "arrived",
        lambda stream: ingest.stream_enrich(stream, path, progress, TAXONOMY, providers.HeuristicProvider(RULES)),
    )
    return enrich.skill_matches(ingest.enriched(spark, path)).select("job_id", "skill_id", "edge_type", "confidence")
