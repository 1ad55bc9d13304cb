"""Nested JSON of any depth -> flat arrays of its objects and lists.

Spark has no recursive walk, so this one step is a small Arrow UDF. Everything that looks
at the result (scores, choices, fallbacks) is column work in :mod:`rolemesh.sources.crawl`.
"""

from __future__ import annotations

import json
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

PIECE = 256  # Payloads opened at once: what is open is Python objects, what is done is Arrow.
SAMPLE = 5  # Fixed value: how many items of a list are looked at.

OBJECTS = T.ArrayType(
    T.StructType(
        [
            T.StructField("pos", T.IntegerType()),
            T.StructField("last", T.IntegerType()),
            T.StructField("fields", T.MapType(T.StringType(), T.StringType())),
            T.StructField("scalars", T.StringType()),
            T.StructField("json", T.StringType()),
        ]
    )
)
LISTS = T.ArrayType(
    T.StructType(
        [
            T.StructField("pos", T.IntegerType()),
            T.StructField("all_objects", T.BooleanType()),
            T.StructField("keys", T.ArrayType(T.StringType())),
            T.StructField("scalars", T.StringType()),
            T.StructField("items", T.ArrayType(T.StringType())),
        ]
    )
)


def _dump(value) -> str:
    return json.dumps(value, ensure_ascii=False)


def _key(name: str) -> str:
    return re.sub("[^a-z0-9一-鿿]", "", name.strip().lower())


def _scalars(values) -> str:
    return " ".join(str(v) for v in values if isinstance(v, (str, int, float)))


def _children(value):
    if isinstance(value, dict):
        return list(value.values())
    return value if isinstance(value, list) else []


def _load(payload):
    try:
        return json.loads(payload) if payload else None
    except ValueError:
        return None


def _objects(payload: str | None) -> list[dict]:
    """Objects in document order; ``last`` is the position of the last object inside."""
    found: list[dict] = []

    def visit(value) -> None:
        entry = None
        if isinstance(value, dict):
            entry = {
                "pos": len(found),
                "last": len(found),
                "fields": list({_key(k): _dump(v) for k, v in value.items()}.items()),
                "scalars": _scalars(value.values()),
                "json": _dump(value),
            }
            found.append(entry)
        for child in _children(value):
            visit(child)
        if entry:
            entry["last"] = len(found) - 1

    visit(_load(payload))
    return found


def _lists(payload: str | None) -> list[dict]:
    found: list[dict] = []

    def visit(value) -> None:
        if isinstance(value, list):
            head = value[:SAMPLE]
            rows = [x for x in head if isinstance(x, dict)]
            found.append(
                {
                    "pos": len(found),
                    "all_objects": bool(head) and len(rows) == len(head),
                    "keys": sorted({_key(k) for x in rows for k in x}),
                    "scalars": _scalars(v for x in rows for v in x.values()),
                    "items": [_dump(x) for x in value if isinstance(x, dict)],
                }
            )
        for child in _children(value):
            visit(child)

    visit(_load(payload))
    return found


def _opened(payload: pa.Array, read, kind: T.DataType) -> pa.Array:
    """``read`` of every payload, a piece of the batch at a time."""
    arrow = to_arrow_type(kind)
    pieces = (payload.slice(at, PIECE).to_pylist() for at in range(0, len(payload), PIECE))
    return pa.concat_arrays([pa.array([], arrow), *(pa.array([read(p) for p in piece], arrow) for piece in pieces)])


@F.arrow_udf(OBJECTS)
def json_objects(payload: pa.Array) -> pa.Array:
    return _opened(payload, _objects, OBJECTS)


@F.arrow_udf(LISTS)
def json_lists(payload: pa.Array) -> pa.Array:
    return _opened(payload, _lists, LISTS)


POSTING_KEYS = ("text", "title", "hostedUrl", "applyUrl", "description")
WRAPPER_KEYS = ("postings", "jobs", "items", "data", "results")


def _postings(payload: str | None) -> list[str]:
    """Posting objects below lists and known wrapper keys.

    Wrappers of one object are read last to first, the items of a list in order.
    """

    def visit(value):
        if isinstance(value, list):
            for item in value:
                yield from visit(item)
        elif isinstance(value, dict):
            if any(k in value for k in POSTING_KEYS):
                yield _dump(value)
            else:
                for name in reversed(WRAPPER_KEYS):
                    yield from visit(value.get(name))

    return list(visit(_load(payload)))


@F.pandas_udf(T.ArrayType(T.StringType()))
def nested_postings(payload: pd.Series) -> pd.Series:
    return payload.map(_postings)


def _ld_objects(payload: str | None) -> list[str]:
    """Linked-data objects; lists and ``@graph`` lists are opened at any depth."""

    def visit(value):
        if isinstance(value, list):
            for item in value:
                yield from visit(item)
        elif isinstance(value, dict):
            if isinstance(value.get("@graph"), list):
                yield from visit(value["@graph"])
            else:
                yield _dump(value)

    return list(visit(_load(payload)))


@F.pandas_udf(T.ArrayType(T.StringType()))
def linked_data_objects(payload: pd.Series) -> pd.Series:
    return payload.map(_ld_objects)
