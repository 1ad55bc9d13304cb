"""Tool calls of conversations: linked to results, ordered, validated and serialised.

Calls meet their results in a join by conversation and identifier. A call that refers to
others comes after them: chains of calls with one reference each are walked by pointer
doubling, and calls with several references are placed in rounds over what the chains have
shortened. Arguments are checked against schemas, and every call becomes one line of
canonical JSON: keys sorted, no white space, and numbers with all their digits.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import stored


@dataclass(frozen=True)
class Parameter:
    """One argument: its JSON type (string, integer, number, boolean, array, object) and bounds.

    ``items`` is what every entry of an array must be, ``fields`` are the members of an object.
    """

    name: str
    kind: str
    required: bool = True
    least: float | None = None
    most: float | None = None
    pattern: str | None = None
    choices: tuple[str, ...] | None = None
    items: Parameter | None = None
    fields: tuple[Parameter, ...] | None = None


# --- canonical numbers -----------------------------------------------------------

PLAIN_DIGITS = 309  # longer numbers are written with an exponent; a double has no more
_NUMBER = r"^-?(0|[1-9][0-9]*)(?:\.([0-9]+))?(?:[eE]([+-]?[0-9]{1,9}))?$"
_PARTS = r"(-?[0-9][0-9.eE+-]*|[^0-9-]+|-)"
# How a number and a string that looks like one are marked while the text is a variant.
_MARK = r"\u0001"


def canonical_number(token: Column) -> Column:
    """A JSON number as the one text of its value: 1.0, 1e0 and 10e-1 are all 1.

    No digit is lost, however many there are. Exponents of over nine digits are not read.
    """
    part = lambda i: F.coalesce(F.regexp_extract(token, _NUMBER, i), F.lit(""))
    digits = F.regexp_replace(F.concat(part(1), part(2)), "^0+", "")
    kept = F.regexp_replace(digits, "0+$", "")
    ten = F.coalesce(part(3).try_cast("int"), F.lit(0)) - F.length(part(2)) + F.length(digits) - F.length(kept)
    size = F.length(kept)
    whole = F.concat(kept, F.repeat(F.lit("0"), ten))
    split = F.concat(kept.substr(F.lit(1), size + ten), F.lit("."), kept.substr(size + ten + 1, size))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -(size + ten)), kept)
    text = (
        F.when(kept == "", "0")
        .when((ten >= 0) & (size + ten <= PLAIN_DIGITS), whole)
        .when((ten < 0) & (size + ten > 0), split)
        .when((ten < 0) & (size + ten <= 0) & (-ten <= PLAIN_DIGITS), small)
        .otherwise(F.concat(kept, F.lit("e"), ten.cast("string")))
    )
    return F.when(token.startswith("-") & (kept != ""), F.concat(F.lit("-"), text)).otherwise(text)


def _marked(text: Column) -> Column:
    """JSON text whose numbers are strings, marked, in canonical form; null if it holds a sign used inside."""
    # With escaped quotes out of the way, every second piece between quotes is a string.
    plain = F.replace(F.replace(text, F.lit("\\\\"), F.lit("\u0002")), F.lit('\\"'), F.lit("\u0003"))
    token = lambda t: F.when(
        F.regexp_like(t, F.lit(_NUMBER)), F.concat(F.lit(f'"{_MARK}n'), canonical_number(t), F.lit('"'))
    ).otherwise(t)
    outside = lambda p: F.array_join(F.transform(F.regexp_extract_all(p, F.lit(_PARTS), 1), token), "")
    string = lambda p: F.when(F.lower(p).startswith(_MARK), F.concat(F.lit(f"{_MARK}s"), p)).otherwise(p)
    pieces = F.transform(F.split(plain, '"'), lambda p, i: F.when(i % 2 == 0, outside(p)).otherwise(string(p)))
    joined = F.array_join(pieces, '"')
    restored = F.replace(F.replace(joined, F.lit("\u0003"), F.lit('\\"')), F.lit("\u0002"), F.lit("\\\\"))
    return F.when(~(text.contains("\u0002") | text.contains("\u0003")), restored)


def parsed_json(text: Column) -> Column:
    """JSON text as a variant for :func:`canonical_json` and :func:`violations`; null if it is none.

    An object with a repeated key is none either: its members have no single value.
    """
    return F.try_parse_json(_marked(text))


def canonical_json(value: Column) -> Column:
    """A variant of :func:`parsed_json` as canonical JSON; a variant prints its keys sorted."""
    printed = F.regexp_replace(F.to_json(value), r'(?<!\\)"\\u0001n([-0-9.e]+)"', "$1")
    return F.regexp_replace(printed, r'(?<!\\)"\\u0001s', '"')


# --- schemas ---------------------------------------------------------------------


def _kind_of(value: Column) -> Column:
    shape = F.schema_of_variant(value)
    text = F.try_variant_get(value, "$", "string")
    number = F.when(F.regexp_like(text, F.lit("^\u0001n-?[0-9]+$")), "integer").when(text.startswith("\u0001n"), "number").otherwise("string")
    return (
        F.when(shape == "STRING", number)
        .when(shape == "BOOLEAN", "boolean")
        .when(shape == "VOID", "null")
        .when(shape.startswith("ARRAY"), "array")
        .otherwise("object")
    )


def _text_of(value: Column) -> Column:
    """The string, or the digits of a number, behind a value."""
    return F.regexp_replace(F.try_variant_get(value, "$", "string"), "^\u0001[ns]", "")


def _strings(*values: Column) -> Column:
    return F.array_compact(F.array(*values)).cast("array<string>") if values else F.array().cast("array<string>")


def _value_problems(value: Column, p: Parameter, label: str) -> Column:
    """Problems of one present value, an array of strings."""
    kind = _kind_of(value)
    kinds = [p.kind, "integer"] if p.kind == "number" else [p.kind]
    simple, nested = [], []
    if p.least is not None or p.most is not None:
        number = _text_of(value).try_cast("double")
        out = F.lit(False)
        if p.least is not None:
            out = out | (number < p.least)
        if p.most is not None:
            out = out | (number > p.most)
        simple.append(F.when(out, F.lit(f"range of {label}")))
    if p.pattern is not None:
        simple.append(F.when(~_text_of(value).rlike(p.pattern), F.lit(f"form of {label}")))
    if p.choices is not None:
        simple.append(F.when(~_text_of(value).isin(list(p.choices)), F.lit(f"choice of {label}")))
    if p.items is not None:
        entries = F.try_variant_get(value, "$", "array<variant>")
        nested.append(F.flatten(F.transform(entries, lambda x: _value_problems(x, p.items, f"{label}[]"))))
    if p.fields is not None:
        nested.append(_member_problems(value, p.fields, f"{label}."))
    good = F.concat(_strings(*simple), *(F.coalesce(n, _strings()) for n in nested))
    return F.when(~kind.isin(kinds), _strings(F.lit(f"type of {label}"))).otherwise(good)


def _member_problems(value: Column, parameters: tuple[Parameter, ...] | list[Parameter], prefix: str) -> Column:
    """Problems of an object's members under their parameters."""
    keys = F.coalesce(F.json_object_keys(F.to_json(value)), _strings())
    allowed = F.array(*(F.lit(p.name) for p in parameters)) if parameters else _strings()
    extra = "extra argument" + (f" in {prefix[:-1]}" if prefix else "")
    found = [_strings(F.when(F.size(F.array_except(keys, allowed)) > 0, F.lit(extra)))]
    for p in parameters:
        member = F.try_variant_get(value, f"$['{p.name}']", "variant")
        label = prefix + p.name
        absent = member.isNull() | (_kind_of(member) == "null")
        missing = _strings(F.lit(f"missing {label}")) if p.required else _strings()
        found.append(F.when(absent, missing).otherwise(_value_problems(member, p, label)))
    return F.concat(*found)


def violations(arguments: Column, text: Column, tool: Column, schemas: dict[str, list[Parameter]]) -> Column:
    """Sorted different problems of the parsed arguments (a variant) under the schema of ``tool``."""
    known = _strings(F.when(tool.isin(sorted(schemas)), F.lit(None).cast("string")).otherwise("unknown tool"))
    # A lenient parser reads objects with repeated keys.
    unread = F.when(F.get_json_object(text, "$").isNotNull() & text.rlike(r"^\s*[{\[]"), "repeated key").otherwise("not JSON")
    shape = _strings(F.when(arguments.isNull(), unread).when(~F.schema_of_variant(arguments).startswith("OBJECT"), "not an object"))
    found = [known, shape]
    is_object = F.coalesce(F.schema_of_variant(arguments).startswith("OBJECT"), F.lit(False))
    for name, parameters in sorted(schemas.items()):
        found.append(F.when((tool == name) & is_object, _member_problems(arguments, parameters, "")).otherwise(_strings()))
    return F.sort_array(F.array_distinct(F.concat(*found)))


# --- order -----------------------------------------------------------------------


def dependency_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, level) of every node: 0 without references, else one more than the highest it refers to.

    edges: (node, needs). References to unknown nodes are ignored; nodes on or behind a
    cycle get level -1. Null nodes are left out.

    A node with one reference points to it; every round of doubling lets it point twice as
    far, to the next node with none or several references, so a chain takes as many rounds as
    its length has binary digits. Nodes with several references are then placed in rounds, one
    for each layer of such nodes.
    """
    nodes = stored(nodes.select("node").where("node is not null").distinct(), "calls")
    known = edges.select("node", "needs").distinct().join(nodes, "node", "left_semi")
    known = stored(known.join(nodes.select(F.col("node").alias("needs")), "needs", "left_semi").select("node", "needs"), "references")
    degree = known.groupBy("node").agg(F.count("*").alias("n"), F.min("needs").alias("to"))
    chain = stored(degree.where("n = 1").select("node", "to", F.lit(1).cast("long").alias("steps")), "chain")
    total, reach = chain.count(), 1
    while True:
        ahead = chain.select(F.col("node").alias("to"), F.col("to").alias("next"), F.col("steps").alias("more"))
        joined = stored(chain.join(ahead, "to", "left"), "doubled")
        if reach > total or not joined.where("next is not null").limit(1).count():
            break
        # A path without a cycle is no longer than there are nodes in chains.
        chain = joined.select(
            "node", F.coalesce("next", "to").alias("to"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")
        )
        reach *= 2
    # What still points into a chain is on a cycle or leads to one.
    chain = joined.where("next is null").select("node", "to", "steps")
    placed = stored(nodes.join(degree.select("node"), "node", "left_anti").withColumn("level", F.lit(0).cast("long")), "level")
    several = known.join(degree.where("n > 1").select("node"), "node", "left_semi")
    jumps = chain.select(F.col("node").alias("needs"), F.col("to").alias("end"), F.col("steps"))
    left = stored(
        several.join(jumps, "needs", "left").select(
            "node", F.coalesce("end", "needs").alias("end"), (F.coalesce("steps", F.lit(0)) + 1).alias("steps")
        ),
        "several",
    )
    while left.limit(1).count():
        ends = placed.select(F.col("node").alias("end"), "level")
        ready = left.join(ends, "end", "left").groupBy("node").agg(
            F.count_if(F.col("level").isNull()).alias("open"), F.max(F.col("level") + F.col("steps")).alias("level")
        )
        ready = stored(ready.where("open = 0").select("node", "level"), "level")
        if not ready.limit(1).count():
            break
        left = stored(left.join(ready, "node", "left_anti"), "several")
        placed = stored(placed.unionByName(ready), "level")
    ends = placed.select(F.col("node").alias("to"), "level")
    behind = chain.join(ends, "to").select("node", (F.col("level") + F.col("steps")).alias("level"))
    levels = stored(placed.unionByName(behind), "levels")
    cyclic = nodes.join(levels, "node", "left_anti").withColumn("level", F.lit(-1).cast("long"))
    return levels.unionByName(cyclic)


# --- records ---------------------------------------------------------------------


def link_tool_calls(
    calls: DataFrame, results: DataFrame, references: DataFrame, schemas: dict[str, list[Parameter]]
) -> DataFrame:
    """Every call and every result without a call, as linked, ordered, validated records.

    calls: (conv_id, call_id, position, tool, arguments as JSON text); results: (conv_id,
    call_id, position, content); references: (conv_id, call_id, needs), needs being a call_id
    of the same conversation. Output: conv_id, call_id, level, position, state, problems,
    json. A conversation is read in the order of (level, position, call_id): no call comes
    before one that it refers to.

    Identifiers count within their conversation; rows without conv_id are a conversation of
    their own. A result without conv_id that finds no call there goes to the one other
    conversation that has its identifier, if it is only one.

    state: ``linked``, ``no result``, ``early result`` (it stands before its call), ``no
    call``. Of several results for one call the first by (position, content) counts, of
    repeated calls of one identifier every row is kept. A null identifier links with
    nothing and has level 0. Arguments that are not JSON, or repeat a key, stay as a JSON
    string; empty and very long texts are read whole. Other columns are not read.
    """
    calls = calls.select("conv_id", "call_id", "position", "tool", "arguments")
    node = F.when(F.col("call_id").isNotNull(), F.struct("conv_id", "call_id"))
    calls = calls.withColumn("node", node)
    if "conv_id" not in results.columns:
        results = results.withColumn("conv_id", F.lit(None).cast(calls.schema["conv_id"].dataType))
    results = results.select("conv_id", "call_id", "position", "content")
    alone = calls.where("conv_id is not null").groupBy("call_id").agg(F.min("conv_id").alias("only"), F.max("conv_id").alias("last"))
    nameless = calls.where("conv_id is null").select("call_id", F.lit(True).alias("here")).distinct()
    adopted = (
        results.join(alone.where("only = last").select("call_id", "only"), "call_id", "left")
        .join(nameless, "call_id", "left")
        .withColumn("of", F.when(F.col("conv_id").isNull() & F.col("here").isNull(), F.col("only")).otherwise(F.col("conv_id")))
        .select("conv_id", "call_id", "position", "content", F.when(F.col("call_id").isNotNull(), F.struct(F.col("of").alias("conv_id"), "call_id")).alias("node"))
    )
    first = adopted.where("node is not null").groupBy("node").agg(F.min(F.struct("position", "content")).alias("r"))
    needs = references.select(
        F.struct("conv_id", "call_id").alias("node"), F.struct("conv_id", F.col("needs").alias("call_id")).alias("needs"),
        F.col("call_id").isNotNull().alias("a"), F.col("needs").isNotNull().alias("b"),
    ).where("a and b").select("node", "needs")
    levels = dependency_levels(calls.select("node"), needs)
    joined = calls.join(first, "node", "left").join(levels, "node", "left").withColumn("parsed", parsed_json(F.col("arguments")))
    state = (
        F.when(F.col("r").isNull(), "no result")
        .when(F.col("r.position") < F.col("position"), "early result")
        .otherwise("linked")
    )
    whole = {"ignoreNullFields": "false"}
    # What stands in {"a":...} is the text as a JSON string.
    joined = joined.withColumn("quoted", F.to_json(F.struct(F.col("arguments").alias("a")), whole))
    rest = F.to_json(F.struct(F.col("call_id").alias("id"), F.col("tool").alias("name"), F.col("r.content").alias("result")), whole)
    joined = joined.withColumn("rest", rest)
    plain = F.expr("substring(quoted, 6, length(quoted) - 6)")
    call_json = F.concat(
        F.lit('{"arguments":'), F.coalesce(canonical_json(F.col("parsed")), plain), F.lit(","), F.expr("substring(rest, 2)")
    )
    linked = joined.select(
        "conv_id", "call_id", F.coalesce("level", F.lit(0)).cast("long").alias("level"), "position", state.alias("state"),
        F.array_join(violations(F.col("parsed"), F.col("arguments"), F.col("tool"), schemas), "; ").alias("problems"),
        call_json.alias("json"),
    )
    lone = adopted.join(calls.where("node is not null").select("node").distinct(), "node", "left_anti").select(
        "conv_id", "call_id", F.lit(0).cast("long").alias("level"), "position", F.lit("no call").alias("state"),
        F.lit("").alias("problems"), F.to_json(F.struct(F.col("call_id").alias("id"), F.col("content").alias("result")), whole).alias("json"),
    )
    return linked.unionByName(lone)
