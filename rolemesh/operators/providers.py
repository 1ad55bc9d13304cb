"""Enrichment providers: the native heuristic, any per-row callable, stored model responses."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Protocol, runtime_checkable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..schemas import ENRICHMENT, SKILL_MATCH
from .vocabulary import Rules, Skill, taxonomy_records

# Envelope keys of model responses and limits of a request.
WRAPPERS = ("result", "data", "payload", "output", "response")
TEXT_PARTS = ("output_text", "text")
RESULT_KEYS = ("summary", "role_family", "skills", "confidence")
REQUEST_SKILLS, REQUEST_ALIASES = 250, 5
RESPONSE_VERSION = "openai-compatible-v2"


@runtime_checkable
class EnrichmentProvider(Protocol):
    """Turns jobs into enrichment rows, DataFrame to DataFrame.

    ``cache_key`` (text or callable) is optional and stands for the provider in cache keys.
    """

    name: str

    def enrich(self, jobs: DataFrame, taxonomy: list[Skill]) -> DataFrame: ...


def provider_signature(provider) -> str:
    given = getattr(provider, "cache_key", None)
    value = given() if callable(given) else given
    return str(value).strip() if value and str(value).strip() else provider.name


class HeuristicProvider:
    name = "heuristic"
    cache_key = "heuristic"

    def __init__(self, rules: Rules | None = None) -> None:
        self.rules = rules or Rules()

    def enrich(self, jobs: DataFrame, taxonomy: list[Skill]) -> DataFrame:
        from .enrich import enrich

        return enrich(jobs, taxonomy, self.rules)


class RowProvider:
    """Adapts ``fn(job: dict, taxonomy: list[dict]) -> dict`` to a distributed provider."""

    def __init__(self, name: str, fn: Callable[[dict, list[dict]], dict], cache_key=None) -> None:
        self.name, self.fn, self.cache_key = name, fn, cache_key

    def enrich(self, jobs: DataFrame, taxonomy: list[Skill]) -> DataFrame:
        fn, records = self.fn, taxonomy_records(taxonomy)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame(
                    {
                        "job_id": batch["id"],
                        "answer": [
                            json.dumps(fn(job, records), ensure_ascii=False)
                            for job in batch.to_dict("records")
                        ],
                    }
                )

        answers = jobs.mapInPandas(run, "job_id string, answer string")
        return decode_results(answers, "answer", self.name)


PROVIDERS: dict[str, Callable[..., EnrichmentProvider]] = {
    "heuristic": HeuristicProvider,
    "callable": RowProvider,
}


def build_provider(kind: str | None = None, **options) -> EnrichmentProvider:
    name = (kind or "heuristic").strip().lower().replace("-", "_")
    if name not in PROVIDERS:
        raise ValueError(f"unknown provider kind: {kind}")
    return PROVIDERS[name](**options)


# --- results as JSON -------------------------------------------------------


def _optional(v: Column) -> Column:
    return text.blank_to_null(text.strip(v))



def _clamped(v: Column) -> Column:
    number = v.try_cast("double")
    return F.when(number.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)))


def _field(path: str, source: str = "_v") -> Column:
    return F.try_variant_get(F.col(source), "$." + path, "string")


def _list(value: Column, keep_scalars: bool) -> Column:
    """Variant -> texts without nulls; objects become JSON text, a scalar one element."""
    items = F.filter(
        F.try_variant_get(value, "$", "array<variant>"), lambda x: ~F.is_variant_null(x)
    )
    texts = F.transform(items, lambda x: F.try_variant_get(x, "$", "string"))
    if not keep_scalars:
        return F.coalesce(texts, F.array().cast("array<string>"))
    scalar = F.when(
        value.isNotNull() & ~F.is_variant_null(value), F.array(F.try_variant_get(value, "$", "string"))
    )
    return F.coalesce(texts, scalar, F.array().cast("array<string>"))


def decode_results(df: DataFrame, column: str, default_provenance: str, lenient: bool = False) -> DataFrame:
    """JSON result text -> enrichment rows, with defaults for what is missing.

    ``lenient`` adds what model answers need: single values where lists are expected,
    alternative evidence keys and confidences forced into 0..1.
    """

    def evidence(v) -> Column:
        if not lenient:
            return _list(F.try_variant_get(v, "$.evidence", "variant"), False)
        # An empty text or list falls through to the next key.
        picks = []
        for k in ("evidence", "evidence_quotes", "source_spans"):
            found = _list(F.try_variant_get(v, f"$.{k}", "variant"), True)
            blank = F.coalesce(F.try_variant_get(v, f"$.{k}", "string") == "", F.lit(False))
            picks.append(F.when((F.size(found) > 0) & ~blank, found))
        return F.coalesce(*picks, F.array().cast("array<string>"))

    def score(c: Column) -> Column:
        return _clamped(c) if lenient else c.try_cast("double")

    def skill(v: Column) -> Column:
        def get(path: str) -> Column:
            return F.try_variant_get(v, "$." + path, "string")

        empty = F.lit("")
        return F.struct(
            text.strip(F.coalesce(get("skill_id"), empty)),
            text.strip(F.coalesce(get("label"), empty)),
            F.lower(text.strip(F.coalesce(text.first_filled(get("normalized_label"), get("label")), empty))),
            F.filter(
                F.transform(
                    _list(F.try_variant_get(v, "$.aliases", "variant"), lenient), text.strip
                ),
                lambda a: a != "",
            ),
            _optional(get("parent_id")),
            _optional(get("category")),
            F.upper(F.coalesce(text.blank_to_null(get("edge_type")), F.lit("REQUIRES"))),
            F.coalesce(get("weight").try_cast("double"), F.lit(1.0)),
            score(get("confidence")) if lenient
            else F.coalesce(score(get("confidence")), F.lit(0.0)),
            evidence(v),
            F.coalesce(text.blank_to_null(get("provenance")), F.lit(default_provenance)),
        ).cast(SKILL_MATCH)

    v = F.col("_v")
    items = F.filter(
        F.try_variant_get(v, "$.skills", "array<variant>"),
        lambda x: F.startswith(F.schema_of_variant(x), F.lit("OBJECT")),
    )
    return df.withColumn("_v", F.try_parse_json(column)).select(
        "job_id",
        *[
            _optional(_field(c)).alias(c)
            for c in ("summary", "role_family", "seniority", "remote_mode_inferred", "salary_text")
        ],
        *[
            _list(F.try_variant_get(v, f"$.{c}", "variant"), lenient).alias(c)
            for c in ("responsibilities", "qualifications")
        ],
        evidence(v).alias("evidence"),
        score(_field("confidence")).alias("confidence"),
        _optional(_field("model_name")).alias("model_name"),
        _optional(_field("prompt_version")).alias("prompt_version"),
        F.coalesce(F.transform(items, skill), F.array().cast(T.ArrayType(SKILL_MATCH))).alias("skills"),
    )


# The fence that models put around JSON, and how many wrappers are opened.
FENCE = r"(?is)^\s*```(?:json)?\s*|\s*```\s*$"
WRAPPER_DEPTH = 8


def _spanned(body: Column, opening: str, closing: str) -> Column:
    """From the first opening sign to the last closing one; null where there is no such span."""
    first, back = F.locate(opening, body), F.locate(closing, F.reverse(body))
    size = F.length(body) - back + 2 - first
    return F.when((first > 0) & (back > 0) & (size > 1), body.substr(first, size))


def _kind(v: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def _unwrapped(v: Column) -> Column:
    """The object behind known wrapper keys: the first one that has a key of a result."""

    def step(inner: Column, _: Column) -> Column:
        members = F.try_variant_get(inner, "$", "map<string,variant>")
        is_result = F.arrays_overlap(F.map_keys(members), F.array(*(F.lit(k) for k in RESULT_KEYS)))
        nested = [F.try_element_at(members, F.lit(k)) for k in WRAPPERS]
        found = F.coalesce(*(F.when(_kind(n) == "OBJECT", n) for n in nested))
        return F.when(is_result, inner).otherwise(F.coalesce(found, inner))

    return F.aggregate(F.sequence(F.lit(1), F.lit(WRAPPER_DEPTH)), v, step)


def response_object(content: str) -> Column:
    """The JSON object inside a model answer, as text; null when there is none.

    An answer may be fenced, stand inside prose, be a list of one, or be wrapped in objects.
    """
    body = text.strip(F.regexp_replace(F.col(content), FENCE, ""))

    def read(body: Column) -> Column:
        spans = F.array_compact(F.array(body, _spanned(body, "{", "}"), _spanned(body, "[", "]")))
        values = F.filter(F.transform(spans, F.try_parse_json), lambda v: v.isNotNull() & (_kind(v) != "VOID"))
        return text.let(F.get(values, 0), lone)

    def lone(v: Column) -> Column:
        entries = F.try_variant_get(v, "$", "array<variant>")
        single = F.when((_kind(v) == "ARRAY") & (F.size(entries) == 1), F.get(entries, 0)).otherwise(v)
        return text.let(single, lambda one: F.when(_kind(one) == "OBJECT", F.to_json(_unwrapped(one))))

    return text.let(body, read)


def _joined_texts(items: Column) -> Column:
    """The texts of message parts in one; null when there is none."""
    parts = F.filter(items, lambda x: F.try_variant_get(x, "$.type", "string").isin(*TEXT_PARTS))
    texts = F.transform(parts, lambda x: F.coalesce(F.try_variant_get(x, "$.text", "string"), F.lit("")))
    return text.blank_to_null(F.array_join(texts, ""))


def response_content(body: Column) -> Column:
    """The answer text inside a stored response body; null for a body of another shape.

    A chat body holds it in its first choice, as text or as parts; other bodies in
    ``output_text`` or in the parts of their ``output`` items, in this order.
    """

    def read(v: Column) -> Column:
        def get(path: str, kind: str) -> Column:
            return F.try_variant_get(v, "$." + path, kind)

        message = "choices[0].message.content"
        chat = F.coalesce(_joined_texts(get(message, "array<variant>")), get(message, "string"))
        contents = F.transform(get("output", "array<variant>"), lambda o: F.try_variant_get(o, "$.content", "array<variant>"))
        parts = F.flatten(F.filter(contents, lambda c: c.isNotNull()))
        return (
            F.when(F.size(get("choices", "array<variant>")) > 0, chat)
            .when(get("output_text", "variant").isNotNull(), get("output_text", "string"))
            .otherwise(_joined_texts(parts))
        )

    return read(F.try_parse_json(body))


def parse_provider_responses(
    responses: DataFrame, model: str, provider: str = "openai-compatible"
) -> tuple[DataFrame, DataFrame]:
    """Stored model answers (job_id, content) -> enrichment rows, and the rejected answers."""
    read = responses.withColumn("_object", response_object("content"))
    good = decode_results(read.where(F.col("_object").isNotNull()), "_object", provider, lenient=True)
    rejected = read.where(F.col("_object").isNull()).select(
        "job_id", F.lit("answer holds no JSON object").alias("reason")
    )
    return (
        good.withColumn("model_name", F.lit(model)).withColumn("prompt_version", F.lit(RESPONSE_VERSION)),
        rejected,
    )


def build_provider_requests(jobs: DataFrame, taxonomy: list[Skill]) -> DataFrame:
    """One JSON request per job for an external model runner: job fields plus the taxonomy."""
    compact = json.dumps(
        [
            {
                "id": s.skill_id,
                "label": s.label,
                "aliases": list(s.aliases[:REQUEST_ALIASES]),
                "parent_id": s.parent_id,
                "category": s.category,
            }
            for s in taxonomy[:REQUEST_SKILLS]
        ],
        ensure_ascii=False,
    )
    job_json = F.to_json(
        F.struct(
            "id", "title", "company_name", "location_text", "description_text", "source_url",
            "remote_mode", "employment_type", "description_hash",
        ),
        {"ignoreNullFields": "false"},
    )
    return jobs.select(
        F.col("id").alias("job_id"),
        F.concat(
            F.lit('{"task":"Extract structured enrichment data for a job posting.","job":'),
            job_json,
            F.lit(',"taxonomy":' + compact + "}"),
        ).alias("request"),
    )
