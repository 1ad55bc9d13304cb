"""Deterministic, content-derived ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank_to_null, graph_slug, short_hash, slug


def company_id(name: Column) -> Column:
    return F.concat(F.lit("company:"), slug(name))


def skill_id(label: Column) -> Column:
    return F.concat(F.lit("skill:"), slug(label))


def job_id(company: Column, external_id: Column, fallback: Column) -> Column:
    """``job:<company slug>:<external id slug>``; without an external id, a content hash."""
    stable = F.when(blank_to_null(external_id).isNotNull(), slug(external_id)).otherwise(
        short_hash(fallback)
    )
    return F.concat(F.lit("job:"), F.regexp_replace(company, "^[^:]*:", ""), F.lit(":"), stable)


def edge_id(source: Column, edge_type: Column, target: Column) -> Column:
    return F.concat(
        F.lit("edge:"),
        F.lower(edge_type),
        F.lit(":"),
        short_hash(F.concat_ws("|", source, edge_type, target)),
    )


def location_id(text: Column) -> Column:
    return F.concat(F.lit("location:"), graph_slug(text))


def role_family_id(text: Column) -> Column:
    return F.concat(F.lit("role_family:"), graph_slug(text))


def source_key(source_type: Column, company: Column, external: Column, url: Column) -> Column:
    """Identity of a raw posting: the external id where there is one, otherwise the URL."""
    return F.when(
        blank_to_null(external).isNotNull(), F.concat_ws("::", source_type, company, external)
    ).otherwise(F.concat_ws("::", source_type, url))


def cache_key(description_hash: Column, signature: str, taxonomy_hash: str) -> Column:
    return F.sha2(F.concat_ws("::", description_hash, F.lit(signature), F.lit(taxonomy_hash)), 256)
