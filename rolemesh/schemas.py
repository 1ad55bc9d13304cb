"""Table layouts and the validation contracts of every exported record."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _D, _L = T.StringType(), T.DoubleType(), T.LongType()


def _table(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


RAW_JOB = _table(
    source_type=_S,
    source_url=_S,
    external_job_id=_S,
    title=_S,
    company_name=_S,
    location_text=_S,
    employment_type=_S,
    posted_at=_S,
    description_text=_S,
    description_html=_S,
    json_payload=_S,
    metadata=T.MapType(_S, _S),
    fetched_at=_S,
)
RAW_COLUMNS = RAW_JOB.fieldNames()

SKILL_MATCH = _table(
    skill_id=_S,
    label=_S,
    normalized_label=_S,
    aliases=T.ArrayType(_S),
    parent_id=_S,
    category=_S,
    edge_type=_S,
    weight=_D,
    confidence=_D,
    evidence=T.ArrayType(_S),
    provenance=_S,
)
ENRICHMENT = _table(
    job_id=_S,
    summary=_S,
    role_family=_S,
    seniority=_S,
    remote_mode_inferred=_S,
    salary_text=_S,
    responsibilities=T.ArrayType(_S),
    qualifications=T.ArrayType(_S),
    evidence=T.ArrayType(_S),
    confidence=_D,
    model_name=_S,
    prompt_version=_S,
    skills=T.ArrayType(SKILL_MATCH),
)
CACHE = _table(
    cache_key=_S,
    description_hash=_S,
    provider_name=_S,
    provider_signature=_S,
    taxonomy_hash=_S,
    result_json=_S,
)
RUN_LOG = _table(
    run_id=_S,
    stage=_S,
    status=_S,
    details=T.MapType(_S, _S),
    created_at=T.TimestampType(),
)

# --- contracts -------------------------------------------------------------
# Which keys each exported record needs and which types they take.
TEXT = {"type": "string"}
OPT_TEXT = {"type": ["string", "null"]}
NUMBER = {"type": ["number", "null"]}
COUNT = {"type": "integer"}
TEXTS = {"type": "array", "items": TEXT}
OPT_OBJECT = {"type": ["object", "null"]}


def _record(required: str, additional=True, **properties) -> dict:
    return {
        "type": "object",
        "required": required.split(),
        "properties": properties,
        "additionalProperties": additional,
    }


def _keyed(values: dict) -> dict:
    return {"type": "object", "required": [], "properties": {}, "additionalProperties": values}


def _many(items: dict) -> dict:
    return {"type": "array", "items": items}


_NODE = _record("id type label", id=TEXT, type=TEXT, label=TEXT, data=OPT_OBJECT)
_EDGE = _record(
    "id source target type",
    id=TEXT,
    source=TEXT,
    target=TEXT,
    type=TEXT,
    weight=NUMBER,
    confidence=NUMBER,
    data=OPT_OBJECT,
)
_JOB_SKILL = _record(
    "skill_id label edge_type",
    skill_id=TEXT,
    label=TEXT,
    edge_type=TEXT,
    weight=NUMBER,
    confidence=NUMBER,
)
_SIMILAR = _record("job_id score", job_id=TEXT, score={"type": "number"})

CONTRACTS = {
    "raw_job": _record(
        "source_type source_url title company_name fetched_at",
        source_type=TEXT,
        source_url=TEXT,
        external_job_id=OPT_TEXT,
        title=TEXT,
        company_name=TEXT,
        location_text=OPT_TEXT,
        employment_type=OPT_TEXT,
        posted_at=OPT_TEXT,
        description_text=OPT_TEXT,
        description_html=OPT_TEXT,
        json_payload={"type": ["object", "array", "string", "null"]},
        metadata=OPT_OBJECT,
        fetched_at=TEXT,
    ),
    "job": _record(
        "id company_id title source_type source_url description_hash status",
        id=TEXT,
        company_id=TEXT,
        external_id=OPT_TEXT,
        title=TEXT,
        title_normalized=TEXT,
        location_text=OPT_TEXT,
        remote_mode=OPT_TEXT,
        employment_type=OPT_TEXT,
        posted_at=OPT_TEXT,
        source_type=TEXT,
        source_url=TEXT,
        description_raw=TEXT,
        description_text=TEXT,
        description_hash=TEXT,
        dedupe_fingerprint=TEXT,
        status=TEXT,
    ),
    "company": _record(
        "id name", id=TEXT, name=TEXT, aliases=TEXTS, website=OPT_TEXT, industry=OPT_TEXT
    ),
    "skill": _record(
        "id label", id=TEXT, label=TEXT, aliases=TEXTS, parent_id=OPT_TEXT, category=OPT_TEXT
    ),
    "graph_node": _NODE,
    "graph_edge": _EDGE,
    "summary": _record(
        "generated_at counts",
        generated_at=TEXT,
        counts=_record(
            "companies jobs skills nodes edges",
            companies=COUNT,
            jobs=COUNT,
            skills=COUNT,
            nodes=COUNT,
            edges=COUNT,
        ),
    ),
    "graph_full": _record("nodes edges", nodes=_many(_NODE), edges=_many(_EDGE)),
    "company_jobs": _keyed(TEXTS),
    "skill_jobs": _keyed(TEXTS),
    "job_skills": _keyed(_many(_JOB_SKILL)),
    "company_skill_stats": _keyed(_keyed(COUNT)),
    "job_neighbors": _keyed(
        _record(
            "similar_jobs skills company_id",
            similar_jobs=_many(_SIMILAR),
            skills=_many(_JOB_SKILL),
            company_id=OPT_TEXT,
        )
    ),
    "search_index": _many(
        _record("id type title text", id=TEXT, type=TEXT, title=TEXT, text=TEXT)
    ),
}
