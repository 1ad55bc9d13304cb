"""Landed HTML pages -> raw postings: embedded JSON-LD, or the page text itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .boards import UNTITLED, _json, _metadata, _raw, _text
from .walk import linked_data_objects

UNKNOWN_COMPANY = "Unknown company"

# Where a page keeps linked data, its title and its location.
LD_SCRIPT = r"""(?is)<script[^>]+type=["']application/ld\+json["'][^>]*>(.*?)</script>"""
H1, TITLE = r"(?is)<h1[^>]*>(.*?)</h1>", r"(?is)<title[^>]*>(.*?)</title>"
LOCATION_PHRASES = [
    r"(?iU)location[:\s\x1c-\x1f]+([A-Za-z0-9,\- ]+)",
    r"(?iU)based in ([A-Za-z0-9,\- ]+)",
]


def _strip_html_text(c: Column) -> Column:
    return text.strip_tags(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?i)<br\s*/?>", "\n"))


def extract_jsonld(
    pages: DataFrame, html: str = "html", url: str = "url", carry: list[str] = ()
) -> DataFrame:
    """Every JobPosting in every linked-data script; unreadable scripts yield nothing."""
    scripts = pages.where(F.contains(F.lower(html), F.lit("ld+json"))).select(
        *carry,
        F.col(url).alias("_url"),
        "fetched_at",
        F.posexplode(F.regexp_extract_all(html, F.lit(LD_SCRIPT), F.lit(1))).alias("script_no", "_script"),
    )
    objects = scripts.select(
        "*", F.posexplode(linked_data_objects(text.strip(F.col("_script")))).alias("pos", "_object")
    ).withColumn("_job", F.try_parse_json("_object"))
    job = F.col("_job")
    postings = objects.where(_type(job) == "JobPosting")
    place = F.try_variant_get(job, "$.jobLocation", "variant")
    first = F.when(
        F.startswith(F.schema_of_variant(place), F.lit("ARRAY")), F.try_variant_get(place, "$[0]", "variant")
    ).otherwise(place)
    location = F.concat_ws(
        ", ",
        *[
            text.blank_to_null(F.try_variant_get(first, "$.address." + k, "string"))
            for k in ("addressLocality", "addressRegion", "addressCountry")
        ],
    )
    html_text = F.coalesce(_text(job, "description"), F.lit(""))
    return _raw(
        postings,
        [*carry, "script_no", "pos"],
        source_type=F.lit("jsonld"),
        source_url=text.first_filled(_text(job, "url"), F.col("_url")),
        external_job_id=text.blank_to_null(_text(job, "identifier.value")),
        title=text.first_filled(_text(job, "title"), F.lit(UNTITLED)),
        company_name=text.first_filled(_text(job, "hiringOrganization.name"), F.lit(UNKNOWN_COMPANY)),
        location_text=text.blank_to_null(location),
        employment_type=_text(job, "employmentType"),
        posted_at=_text(job, "datePosted"),
        description_html=html_text,
        description_text=_strip_html_text(html_text),
        json_payload=F.col("_object"),
        metadata=_metadata(
            valid_through=_text(job, "validThrough"),
            direct_apply=_text(job, "directApply"),
            industry=_json(job, "industry"),
        ),
        fetched_at=F.col("fetched_at"),
    )


def _type(job: Column) -> Column:
    return F.try_variant_get(job, '$["@type"]', "string")


def page_heading(html: Column) -> Column:
    """Text of the first h1, else of the title element, else a placeholder."""
    found = [text.blank_to_null(text.strip_tags(F.regexp_extract(html, p, 1))) for p in (H1, TITLE)]
    return F.coalesce(*found, F.lit(UNTITLED))


def phrase_location(plain: Column) -> Column:
    """Location after the first phrase that names one."""
    picks = [
        F.when(plain.rlike(p), text.strip(F.regexp_extract(plain, p, 1))) for p in LOCATION_PHRASES
    ]
    return F.coalesce(*picks)


def extract_html(
    pages: DataFrame, html: str = "html", url: str = "url", company: Column | None = None,
    carry: list[str] = (),
) -> DataFrame:
    """One raw posting per page, from its heading and visible text."""
    plain = pages.withColumn("_plain", text.strip_tags(F.col(html)))
    return _raw(
        plain,
        list(carry),
        source_type=F.lit("html"),
        source_url=F.col(url),
        title=page_heading(F.col(html)),
        company_name=company if company is not None else F.lit(UNKNOWN_COMPANY),
        location_text=phrase_location(F.col("_plain")),
        description_html=F.col(html),
        description_text=F.col("_plain"),
        metadata=F.create_map().cast("map<string,string>"),
        fetched_at=F.col("fetched_at"),
    )
