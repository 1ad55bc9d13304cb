"""Contract checks: a JSON-Schema subset compiled to column expressions over VARIANT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, text, urls
from ..schemas import CONTRACTS

# How each JSON kind is named in a message.
_NAMES = {
    "OBJECT": "dict",
    "ARRAY": "list",
    "STRING": "str",
    "BOOLEAN": "bool",
    "BIGINT": "int",
    "VOID": "NoneType",
}
_ACCEPTS = {
    "object": ["OBJECT"],
    "array": ["ARRAY"],
    "string": ["STRING"],
    "number": ["BIGINT", "DOUBLE", "DECIMAL"],
    "integer": ["BIGINT"],
    "boolean": ["BOOLEAN"],
    "null": ["VOID"],
}
_NONE = "array<struct<path:string,message:string>>"


class ContractError(ValueError):
    """Raised in strict mode when any record breaks its contract."""


def _kind(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, ... without the parameters Spark adds."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def _kind_name(kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in _NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, kind), F.lit("float"))


def _problem(path: Column, message: Column) -> Column:
    return F.struct(path.alias("path"), message.alias("message"))


def _type_names(contract: dict) -> list[str]:
    expected = contract.get("type", [])
    return expected if isinstance(expected, list) else [expected]


def _type_problem(kind: Column, contract: dict, path: Column) -> Column:
    """One (path, message) when a value of this kind is not allowed, else null."""
    names = _type_names(contract)
    accepted = [k for n in names for k in _ACCEPTS[n]]
    if not names:
        return F.lit(None).cast("struct<path:string,message:string>")
    message = F.concat(F.lit("expected " + " | ".join(names) + ", got "), _kind_name(kind))
    return F.when(~kind.isin(accepted), _problem(path, message))


def _is_leaf(contract: dict) -> bool:
    names = _type_names(contract)
    has_fields = "object" in names and (
        contract.get("required") or contract.get("properties")
        or contract.get("additionalProperties", True) is not True
    )
    return not has_fields and not ("array" in names and isinstance(contract.get("items"), dict))


def _violations(v: Column, contract: dict, path: Column) -> Column:
    """array of (path, message) for one variant value against one contract."""

    def by_kind(kind: Column) -> Column:
        own = F.array_compact(F.array(_type_problem(kind, contract, path)))
        if _is_leaf(contract):
            return own
        names = _type_names(contract)
        out = own
        if "array" in names and isinstance(contract.get("items"), dict):
            out = F.when(kind == "ARRAY", _array_violations(v, contract["items"], path)).otherwise(out)
        if "object" in names:
            out = F.when(kind == "OBJECT", _object_violations(v, contract, path)).otherwise(out)
        return out

    return text.let(_kind(v), by_kind)


def _object_violations(v: Column, contract: dict, path: Column) -> Column:
    members = F.try_variant_get(v, "$", "map<string,variant>")
    return text.let(members, lambda m: _member_violations(m, contract, path))


def _member_violations(members: Column, contract: dict, path: Column) -> Column:
    properties = contract.get("properties", {})
    additional = contract.get("additionalProperties", True)

    def under(key: str) -> Column:
        return F.concat(path, F.lit("." + key))

    single = [
        F.when(~F.map_contains_key(members, key), _problem(under(key), F.lit("is required")))
        for key in contract.get("required", [])
    ]
    nested = []
    for key, sub in properties.items():
        member = F.try_element_at(members, F.lit(key))
        if _is_leaf(sub):
            # Absent members have no kind, so they break no type rule.
            single.append(_leaf(member, sub, under(key)))
        else:
            found = _violations(member, sub, under(key))
            nested.append(F.when(F.map_contains_key(members, key), found).otherwise(_nothing()))
    if additional is not True and additional is not None:
        extra = F.filter(F.map_entries(members), lambda e: ~e["key"].isin(list(properties)))

        def judge(e: Column) -> Column:
            where = F.concat(path, F.lit("."), e["key"])
            if additional is False:
                return F.array(_problem(where, F.lit("is not allowed")))
            return _violations(e["value"], additional, where)

        nested.append(F.flatten(F.transform(extra, judge)))
    own = F.array_compact(F.array(*single)).cast(_NONE) if single else _nothing()
    return F.concat(own, *[n.cast(_NONE) for n in nested])


def _leaf(member: Column, contract: dict, path: Column) -> Column:
    return text.let(_kind(member), lambda kind: _type_problem(kind, contract, path))


def _nothing() -> Column:
    return F.array().cast(_NONE)


def _array_violations(v: Column, items: dict, path: Column) -> Column:
    members = F.try_variant_get(v, "$", "array<variant>")
    return F.flatten(
        F.transform(
            members,
            lambda x, i: _violations(x, items, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))),
        )
    )


def record_problems(payload: Column, contract: str | dict) -> Column:
    """All broken rules of JSON text as an array of (path, message).

    Text that is no JSON at all is one violation at ``$``.
    """
    rules = CONTRACTS[contract] if isinstance(contract, str) else contract
    unreadable = F.array(F.struct(F.lit("$").alias("path"), F.lit("is not valid JSON").alias("message"))).cast(_NONE)

    def found(v: Column) -> Column:
        return F.when(v.isNull(), unreadable).otherwise(_violations(v, rules, F.lit("$")))

    return text.let(F.try_parse_json(payload), found)


def violations(df: DataFrame, contract: str | dict, payload: str, context: Column) -> DataFrame:
    """All broken rules of JSON text column ``payload`` as (context, path, message) rows."""
    # The outer form keeps Spark from testing the array first, which would compute it twice.
    listed = df.select(context.alias("context"), F.explode_outer(record_problems(F.col(payload), contract)).alias("e"))
    return listed.where(F.col("e").isNotNull()).select("context", "e.path", "e.message")


def require_valid(df: DataFrame, contract: str | dict, payload: str, context: Column, show: int = 20) -> DataFrame:
    """Strict mode: returns ``df`` or raises with the first messages."""
    broken = violations(df, contract, payload, context).limit(show).collect()
    if broken:
        raise ContractError("; ".join(f"{r.context}: {r.path} {r.message}" for r in broken))
    return df


def table_violations(df: DataFrame, contract: str, key: str) -> DataFrame:
    """The same check for typed rows, through their JSON form with nulls kept."""
    record = df.select(F.col(key).alias("_key"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("_json"))
    return violations(record, contract, "_json", F.concat(F.lit(contract + "["), F.col("_key").cast("string"), F.lit("]")))


REQUIRED_CRAWL_FIELDS = ["source_type", "source_url", "title", "company_name", "fetched_at"]
CRAWL_SOURCE_TYPE = "company_site"


def crawl_record_problems(df: DataFrame) -> DataFrame:
    """First broken rule of every crawled record: required fields, source type, URL, dates."""
    missing = F.filter(
        F.array(*[F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(c)) for c in REQUIRED_CRAWL_FIELDS]),
        lambda x: x.isNotNull(),
    )
    reason = (
        F.when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ", ")))
        .when(F.col("source_type") != CRAWL_SOURCE_TYPE, "source_type")
        .when(~urls.is_absolute_url(F.col("source_url")), "source_url")
        .when(
            text.blank_to_null(F.col("posted_at")).isNotNull() & ~dates.looks_like_date(F.col("posted_at")),
            "posted_at",
        )
        .when(~dates.looks_like_datetime(F.col("fetched_at")), "fetched_at")
    )
    return df.withColumn("problem", reason)
