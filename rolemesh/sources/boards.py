"""Landed job-board payloads (one JSON document per row) -> raw postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, text
from ..schemas import RAW_COLUMNS
from .walk import nested_postings

UNTITLED = "Untitled role"

# Board URLs, used where a posting carries none.
GREENHOUSE_URL = "https://boards-api.greenhouse.io/v1/boards/{}/jobs?content=true"
LEVER_URL = "https://api.lever.co/v0/postings/{}"
ASHBY_URL = "https://api.ashbyhq.com/posting-api/job-board/{}?includeCompensation=false"


def _url(template: str, name: Column) -> Column:
    head, tail = template.split("{}")
    quoted = F.replace(F.replace(F.url_encode(name), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))
    return F.concat(F.lit(head), quoted, F.lit(tail))


def _text(v: Column, path: str) -> Column:
    return F.try_variant_get(v, "$." + path, "string")


def _json(v: Column, path: str) -> Column:
    return F.try_variant_get(v, "$." + path, "string")


def _metadata(**fields: Column) -> Column:
    """Map of the filled fields; nested values stay JSON text."""
    pairs = [x for name, value in fields.items() for x in (F.lit(name), value)]
    return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())


def _raw(df: DataFrame, carry: list[str], **fields: Column) -> DataFrame:
    columns = {name: fields.get(name, F.lit(None).cast("string")) for name in RAW_COLUMNS}
    return df.select(*carry, *[value.alias(name) for name, value in columns.items()])


def _jobs(df: DataFrame, payload: str) -> DataFrame:
    parsed = df.withColumn("_doc", F.try_parse_json(payload))
    jobs = F.try_variant_get("_doc", "$.jobs", "array<variant>")
    return parsed.select("*", F.posexplode(jobs).alias("pos", "_job"))


def flatten_greenhouse(
    landed: DataFrame, board: str = "board", payload: str = "payload", carry: list[str] = ()
) -> DataFrame:
    """(board, payload, fetched_at) -> one raw posting per entry of ``jobs``."""
    job = F.col("_job")
    content = F.coalesce(_text(job, "content"), F.lit(""))
    offices = F.filter(
        F.transform(
            F.try_variant_get(job, "$.offices", "array<variant>"), lambda o: _text(o, "name")
        ),
        lambda n: F.coalesce(n, F.lit("")) != "",
    )
    return _raw(
        _jobs(landed, payload),
        [*carry, "pos"],
        source_type=F.lit("greenhouse"),
        source_url=text.first_filled(_text(job, "absolute_url"), _url(GREENHOUSE_URL, F.col(board))),
        external_job_id=_text(job, "id"),
        title=text.first_filled(_text(job, "title"), F.lit(UNTITLED)),
        company_name=F.col(board),
        location_text=text.blank_to_null(F.array_join(offices, ", ")),
        posted_at=_text(job, "updated_at"),
        description_html=content,
        description_text=text.strip_markup(content),
        json_payload=F.to_json(job),
        metadata=_metadata(
            absolute_url=_text(job, "absolute_url"),
            internal_job_id=_text(job, "internal_job_id"),
            updated_at=_text(job, "updated_at"),
            departments=_json(job, "departments"),
            offices=_json(job, "offices"),
        ),
        fetched_at=F.col("fetched_at"),
    )


_LEVER_NAMED = [
    "text", "title", "jobTitle", "descriptionHtml", "description", "content", "descriptionPlain",
    "descriptionText", "categories", "hostedUrl", "applyUrl", "createdAt", "updatedAt", "state",
    "workplaceType",
]


def _lever_location(job: Column) -> Column:
    location = F.try_variant_get(job, "$.categories.location", "variant")
    parts = [_text(job, "categories.location." + k) for k in ("name", "city", "state", "country")]
    from_object = text.blank_to_null(F.concat_ws(", ", *[text.blank_to_null(p) for p in parts]))
    is_object = F.startswith(F.schema_of_variant(location), F.lit("OBJECT"))
    return F.when(is_object, from_object).otherwise(
        text.blank_to_null(_text(job, "categories.location"))
    )


def _lever_posted(job: Column) -> Column:
    """Created, else updated: epochs become ISO text, text passes through."""

    def filled(path: str) -> Column:
        value = _text(job, path)
        return F.when(~value.isin("", "0", "false"), F.try_variant_get(job, "$." + path, "variant"))

    picked = F.coalesce(filled("createdAt"), filled("updatedAt"))
    kind = F.regexp_extract(F.schema_of_variant(picked), "^[A-Z]+", 0)
    as_text = F.try_variant_get(picked, "$", "string")
    return F.when(kind == "STRING", as_text).when(
        kind.isin("BIGINT", "DOUBLE", "DECIMAL"), dates.epoch_to_iso(as_text.try_cast("double"))
    )


def flatten_lever(
    landed: DataFrame, account: str = "account", payload: str = "payload", carry: list[str] = ()
) -> DataFrame:
    """(account, payload, fetched_at) -> raw postings, found at any depth of the payload."""
    jobs = landed.select("*", F.posexplode(nested_postings(payload)).alias("pos", "_text")).withColumn(
        "_job", F.try_parse_json("_text")
    )
    job = F.col("_job")

    def pick(*paths: str) -> Column:
        return text.first_filled(*[_text(job, p) for p in paths])

    html = F.coalesce(pick("descriptionHtml", "description", "content"), F.lit(""))
    members = F.try_variant_get(job, "$", "map<string,variant>")
    additional = F.to_json(
        F.transform_values(
            F.map_filter(members, lambda k, v: ~k.isin(_LEVER_NAMED)), lambda k, v: F.to_json(v)
        )
    )
    return _raw(
        jobs,
        [*carry, "pos"],
        source_type=F.lit("lever"),
        source_url=F.coalesce(pick("hostedUrl", "applyUrl"), _url(LEVER_URL, F.col(account))),
        external_job_id=F.coalesce(pick("id"), _text(job, "leverId")),
        title=F.coalesce(pick("text", "title", "jobTitle"), F.lit(UNTITLED)),
        company_name=F.col(account),
        location_text=_lever_location(job),
        employment_type=text.map_employment(
            pick("categories.commitment", "employmentType"), text.LEVER_EMPLOYMENT
        ),
        posted_at=_lever_posted(job),
        description_html=html,
        description_text=F.coalesce(pick("descriptionPlain", "descriptionText"), text.strip_markup(html)),
        json_payload=F.col("_text"),
        metadata=_metadata(
            hosted_url=_text(job, "hostedUrl"),
            apply_url=_text(job, "applyUrl"),
            created_at=_text(job, "createdAt"),
            updated_at=_text(job, "updatedAt"),
            categories=_json(job, "categories"),
            state=_text(job, "state"),
            workplace_type=_text(job, "workplaceType"),
            additional=additional,
        ),
        fetched_at=F.col("fetched_at"),
    )


def flatten_ashby(
    landed: DataFrame, board: str = "board", payload: str = "payload", carry: list[str] = ()
) -> DataFrame:
    """(board, payload, fetched_at) -> one raw posting per entry of ``jobs``."""
    job, doc = F.col("_job"), F.col("_doc")
    html = F.coalesce(_text(job, "descriptionHtml"), F.lit(""))
    address = F.concat_ws(
        ", ",
        *[
            text.blank_to_null(_text(job, "address.postalAddress." + k))
            for k in ("addressLocality", "addressRegion", "addressCountry")
        ],
    )
    secondary = F.transform(
        F.coalesce(
            F.try_variant_get(job, "$.secondaryLocations", "array<variant>"),
            F.array().cast("array<variant>"),
        ),
        lambda s: _text(s, "location"),
    )
    places = F.array_distinct(
        F.filter(
            F.concat(F.array(_text(job, "location"), address), secondary),
            lambda p: F.coalesce(p, F.lit("")) != "",
        )
    )
    company = F.coalesce(
        text.first_filled(_text(doc, "meta.name"), _text(job, "organizationName")), F.col(board)
    )
    return _raw(
        _jobs(landed, payload),
        [*carry, "pos"],
        source_type=F.lit("ashby"),
        source_url=text.first_filled(
            _text(job, "jobUrl"), _text(doc, "meta.jobBoardLink"), _text(job, "applyUrl"),
            _url(ASHBY_URL, F.col(board)),
        ),
        external_job_id=_text(job, "id"),
        title=text.first_filled(_text(job, "title"), F.lit(UNTITLED)),
        company_name=company,
        location_text=text.blank_to_null(F.array_join(places, ", ")),
        employment_type=text.map_employment(
            text.blank_to_null(_text(job, "employmentType")), text.ASHBY_EMPLOYMENT
        ),
        posted_at=_text(job, "publishedAt"),
        description_html=html,
        description_text=F.coalesce(
            text.blank_to_null(_text(job, "descriptionPlain")), text.strip_markup(html)
        ),
        json_payload=F.to_json(job),
        metadata=_metadata(
            api_version=_text(doc, "apiVersion"),
            organization_id=text.first_filled(_text(doc, "meta.id"), _text(job, "organizationId")),
            organization_name=company,
            organization_link=_text(doc, "meta.link"),
            job_board_link=_text(doc, "meta.jobBoardLink"),
            job_url=_text(job, "jobUrl"),
            apply_url=_text(job, "applyUrl"),
            department=_text(job, "department"),
            team=_text(job, "team"),
            is_listed=_text(job, "isListed"),
            is_remote=_text(job, "isRemote"),
            workplace_type=_text(job, "workplaceType"),
            published_at=_text(job, "publishedAt"),
            employment_type=_text(job, "employmentType"),
            address=_json(job, "address"),
            secondary_locations=_json(job, "secondaryLocations"),
            compensation=_json(job, "compensation"),
        ),
        fetched_at=F.col("fetched_at"),
    )
