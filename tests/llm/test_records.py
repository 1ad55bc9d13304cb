"""Tool calls, revisits and licences on small fixtures, and all queries against their SQL."""

from __future__ import annotations

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from rolemesh.llm import licences, queries, revisits, toolcalls
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, queries.QUERIES[name], queries.ORACLES[name], SF) is None


CALLS = "conv_id long, call_id string, position long, tool string, arguments string, level int, r string, node string"
RESULTS = "conv_id long, call_id string, position long, content string, level int, r string"
NEEDS = "conv_id long, call_id string, needs string, level int"


def linked(spark, calls, results, needs, schemas):
    """Tables with extra columns whose names clash with inner ones."""
    a = spark.createDataFrame([(*r, 1, "r", "n") for r in calls], CALLS)
    b = spark.createDataFrame([(*r, 1, "r") for r in results], RESULTS)
    c = spark.createDataFrame([(*r, 1) for r in needs], NEEDS)
    return toolcalls.link_tool_calls(a, b, c, schemas)


def test_tool_calls(spark):
    calls = [
        (1, "a", 0, "add", '{"y": 2, "x": 1}'),
        (1, "b", 1, "add", '{"x": "1", "z": 0}'),
        (1, "c", 2, "fly", "{bad"),
        (1, "d", 3, "add", None),
        (1, "e", 4, "add", '{"x": 900, "y": null}'),
        (1, None, 5, "add", '{"x": 1}'),
        (1, "a", 6, "add", '{"x": 3}'),
        (1, "g", 7, "add", ""),
    ]
    results = [(1, "a", 2, "later"), (1, "a", 1, "three"), (1, "b", 0, "early"), (1, "q", 9, "lone"), (1, None, 9, "none")]
    needs = [(1, "b", "a"), (1, "c", "b"), (1, "c", "zz"), (1, "d", "e"), (1, "e", "d"), (1, "g", "g"), (1, None, "a")]
    schemas = {"add": [toolcalls.Parameter("x", "integer", most=100), toolcalls.Parameter("y", "number", required=False)]}
    got = linked(spark, calls, results, needs, schemas).collect()
    by = {(r.call_id, r.position): r for r in got}
    assert len(got) == 10
    assert by["a", 0].json == '{"arguments":{"x":1,"y":2},"id":"a","name":"add","result":"three"}'
    assert [by[k].level for k in (("a", 0), ("b", 1), ("c", 2), ("d", 3), ("e", 4), (None, 5), ("g", 7))] == [0, 1, 2, -1, -1, 0, -1]
    assert by["a", 0].problems == "" and by["b", 1].problems == "extra argument; type of x"
    assert by["c", 2].problems == "not JSON; unknown tool" and by["e", 4].problems == "range of x"
    assert by["b", 1].state == "early result" and by["c", 2].state == "no result" and by["q", 9].state == "no call"
    assert all(json.loads(r.json) for r in got)
    assert linked(spark, [], [], [], schemas).count() == 0


def test_identifiers_count_within_their_conversation(spark):
    calls = [(c, "call_1", 0, "t", "{}") for c in (1, 2, None)] + [(1, "call_2", 2, "t", "{}"), (2, "call_2", 2, "t", "{}"), (3, "own", 0, "t", "{}")]
    results = [(1, "call_1", 1, "one"), (2, "call_1", 1, "two"), (None, "call_1", 1, "none"), (None, "own", 5, "adopted"), (None, "call_2", 5, "whose")]
    got = linked(spark, calls, results, [(1, "call_2", "call_1")], {"t": []}).collect()
    found = {(r.conv_id, r.call_id): (r.level, r.state, json.loads(r.json)["result"]) for r in got}
    assert found == {
        (1, "call_1"): (0, "linked", "one"), (2, "call_1"): (0, "linked", "two"), (None, "call_1"): (0, "linked", "none"),
        (1, "call_2"): (1, "no result", None), (2, "call_2"): (0, "no result", None), (3, "own"): (0, "linked", "adopted"),
        (None, "call_2"): (0, "no call", "whose"),
    }


def test_levels_of_chains_and_webs(spark):
    """Against a walk over the graph: long chains, several references, cycles and what leads to them."""
    rng = random.Random(8)
    edges = {(f"n{i}", f"n{i - 1}") for i in range(1, 70)}
    edges |= {(f"m{i}", f"m{rng.randrange(i)}") for i in range(1, 60) for _ in range(rng.choice([1, 1, 1, 2, 3]))}
    edges |= {("m20", "n69"), ("x", "y"), ("y", "z"), ("z", "x"), ("w", "x"), ("v", "w"), ("v", "n3"), ("s", "s"), ("m5", "gone")}
    nodes = {n for e in edges for n in e if n != "gone"} | {"lone"}
    needs = {n: [b for a, b in edges if a == n and b in nodes] for n in nodes}

    def walk(n, on=()):
        if n in on:
            return None
        below = [walk(m, (*on, n)) for m in needs[n]]
        return None if None in below else 1 + max(below, default=-1)

    got = toolcalls.dependency_levels(
        spark.createDataFrame([(n,) for n in nodes] + [(None,), ("lone",)], "node string"),
        spark.createDataFrame([*edges, ("n1", "n0")], "node string, needs string"),
    )
    small = {n: walk(n) for n in nodes if not n.startswith("m")}
    levels = {r.node: r.level for r in got.collect()}
    assert levels.keys() == nodes and all(levels[n] == (-1 if v is None else v) for n, v in small.items())
    assert all(levels[n] == 1 + max(levels[m] for m in needs[n]) for n in nodes if n.startswith("m") and needs[n])
    assert toolcalls.dependency_levels(spark.createDataFrame([], "node string"), spark.createDataFrame([], "node string, needs string")).count() == 0


NUMBERS = {
    "0": "0", "-0": "0", "-0.0": "0", "1.0": "1", "1e2": "100", "100": "100", "1.50": "1.5", "-2.5E-3": "-0.0025", "0.1e1": "1",
    "12345678901234567890123456789012345678901234": "12345678901234567890123456789012345678901234",
    "0.1000000000000000055511151231257827": "0.1000000000000000055511151231257827", "1e400": "1e400", "12e-400": "12e-400",
    "1E+2": "100", "10e-1": "1", "123.456e1": "1234.56",
}


def test_numbers_keep_their_digits(spark, column):
    assert column(list(NUMBERS), toolcalls.canonical_number) == list(NUMBERS.values())
    texts = [f'{{"b": [{t}, "{t}"], "a": {{"z": {t}, "\\"y\\\\": {t}}}}}' for t in NUMBERS]
    want = [f'{{"a":{{"\\"y\\\\":{v},"z":{v}}},"b":[{v},"{t}"]}}' for t, v in NUMBERS.items()]
    through = lambda c: toolcalls.canonical_json(toolcalls.parsed_json(c))
    assert column(texts, through) == want
    marks = [r'["\u0001n5", "x\u0001n5", "\"\u0001n7\"", 5, true, null, false]', "1", '"e1"', "01", "1.", "-", "", None, '{"a":1,"a":2}', "[1", '["\x02"]']
    assert column(marks, through) == [
        r'["\u0001n5","x\u0001n5","\"\u0001n7\"",5,true,null,false]', "1", '"e1"', None, None, None, None, None, None, None, None,
    ]
    long = "[" + ",".join(['"' + r"\n\"" * 30_000 + '"', *map(str, range(20_000))]) + "]"
    assert column([long], through) == [long]


def test_schemas_of_nested_arguments(spark):
    P = toolcalls.Parameter  # noqa: N806
    schemas = {
        "f": [
            P("mode", "string", choices=("fast", "slow")), P("ids", "array", required=False, items=P("", "integer", least=1)),
            P("at", "object", required=False, fields=(P("x", "number"), P("tags", "array", required=False, items=P("", "string", pattern="^t")))),
        ]
    }
    cases = {
        '{"mode": "fast", "ids": [1, 1e2, 3.0], "at": {"x": 1.5, "tags": ["t1"]}}': "",
        '{"mode": "x", "ids": [0, "1", 2.5]}': "choice of mode; range of ids[]; type of ids[]",
        '{"mode": "slow", "at": {"tags": ["t", "u", 3], "y": 1}}': "extra argument in at; form of at.tags[]; missing at.x; type of at.tags[]",
        '{"mode": 1, "ids": {}, "at": []}': "type of at; type of ids; type of mode",
        '{"mode": "fast", "mode": "slow"}': "repeated key",
        '["mode"]': "not an object", "7": "not an object", "nope": "not JSON",
    }
    calls = [(1, f"c{i}", i, "f", text) for i, text in enumerate(cases)]
    got = {r.call_id: r for r in linked(spark, calls, [], [], schemas).collect()}
    assert [got[f"c{i}"].problems for i in range(len(cases))] == list(cases.values())
    assert json.loads(got["c4"].json)["arguments"] == '{"mode": "fast", "mode": "slow"}'


def test_revisits(spark):
    rows = [
        ("r1", "http://A.org/x/?utm_source=q#f", 10, 200, {"etag": '"1"', "server": "s", "content-length": "5"}),
        ("r2", "https://a.org/x", 20, 200, {"etag": '"2"'}),
        ("v1", "a.org/x", 15, 304, {"etag": 'W/"1"', "date": "d", "content-length": "0"}),
        ("v2", "a.org/x", 20, 304, {"etag": '"1"'}),
        ("v3", "a.org/x", 999, 304, {"etag": '"1"'}),
        ("v4", "a.org/x", 10, 304, {}),
        ("v5", "a.org/x", 2000, 304, None),
        ("v6", None, 5, 304, {}),
        ("v7", "a.org/x", None, 304, {}),
        ("o1", "a.org/x", 11, 404, {}),
    ]
    records = spark.createDataFrame(rows, "record_id string, url string, ts long, status int, headers map<string,string>")
    for bucket in (7, 100_000):
        got = {r.record_id: r for r in revisits.resolve_revisits(records, bucket).collect()}
        assert {k: (r.response_id, r.outcome) for k, r in got.items()} == {
            "v1": ("r1", "resolved"), "v2": ("r1", "resolved"), "v3": ("r2", "mismatch"), "v4": (None, "missing"),
            "v5": ("r2", "unverified"), "v6": (None, "missing"), "v7": (None, "missing"),
        }
        assert got["v1"].headers == {"etag": 'W/"1"', "server": "s", "content-length": "5", "date": "d"}
    assert revisits.resolve_revisits(records.limit(0)).count() == 0


NOTICES = {
    "Proprietary": "Copyright (c) 2020 Jane Doe. All rights reserved.",
    "Apache-2.0": "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/",
    "MIT": "MIT License\n\nCopyright (c) 2020\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and"
    " associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including",
    "GPL-3.0": "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007",
    "MPL-2.0": "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed */",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that",
}


def test_licences(spark):
    rows = [
        ("a/LICENSE", "words\nReleased under the MIT License.\nmore"),
        ("a/b/c/x.py", "no licence here"),
        ("a/b/COPYING", "Licensed under the Apache License, Version 2.0."),
        ("a/y.py", None),
        ("z.py", ""),
        ("a/own.py", "# Licensed under CC BY-NC 4.0.\n"),
        ("a/inside.py", "x " * 50_000 + "this code was written by me and released under the MIT License. " + "y " * 50_000),
        (None, "the the the"),
        ("a/y.py", None),
    ]
    rows += [(f"n/{name}/LICENSE", text) for name, text in NOTICES.items()] + [(f"n/{name}/deep/down/x.c", "int main") for name in NOTICES]
    clash = {c: F.lit(c) for c in ("h", "kept", "own_path", "directory", "from", "words", "template", "basis", "position")}
    files = spark.createDataFrame([(*r, 1.0) for r in rows], "path string, text string, score double").withColumns(clash)
    found = licences.scan_licences(files)
    assert found.columns == ["path", "h", "kept", "own_path", "directory", "from", "words", "template", "licence", "score", "position", "basis", "licence_path"]
    got = [(r.path, r.licence, r.basis, r.licence_path) for r in found.collect()]
    want = [
        ("a/LICENSE", "MIT", "own", None), ("a/b/c/x.py", "Apache-2.0", "inherited", "a/b/COPYING"),
        ("a/b/COPYING", "Apache-2.0", "own", None), ("a/y.py", "MIT", "inherited", "a/LICENSE"),
        ("a/y.py", "MIT", "inherited", "a/LICENSE"), ("z.py", None, "none", None),
        ("a/own.py", "CC-BY-NC-4.0", "own", None), ("a/inside.py", "MIT", "own", None), (None, None, "none", None),
    ]
    want += [(f"n/{n}/LICENSE", n, "own", None) for n in NOTICES] + [(f"n/{n}/deep/down/x.c", n, "inherited", f"n/{n}/LICENSE") for n in NOTICES]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert licences.scan_licences(files.limit(0)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES][0] == "language ID" and len(corpus_pipeline.STAGES) == 5
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        docs = out
    rows = corpus_pipeline.run(spark, SF).orderBy("start").collect()
    assert rows and all(b.start == a.start + a.n_tokens for a, b in zip(rows, rows[1:]))
    assert os.path.exists(corpus_pipeline.__file__)


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows, clashing columns and empty tables in every stage."""
    import corpus_pipeline

    spark.createDataFrame([(1, "some words of a benchmark item that no text holds")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rng = random.Random(3)
    say = lambda n: " ".join("".join(rng.choices("abcdefgh", k=4)) for _ in range(n))
    rows = [(i, say(12), "en", "s") for i in range(40)] + [(90, None, "en", "s"), (91, "", None, None), (92, "12 3!", "en", "s")]
    rows += [(93, say(30_000), "en", "s"), (None, say(9), None, None), rows[0], rows[0]]
    schema = "doc_id long, text string, lang string, source string"
    names = ("row_key", "component_id", "spans", "s", "n", "h", "lang_pred", "score", "item_id", "start", "keys", "node")
    for own in (rows, []):
        docs = spark.createDataFrame(own, schema).withColumns({c: F.lit(c) for c in names})
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns, name
            got = out.collect()
            assert all(r[c] == c for r in got for c in names), name
            if own and name == "language ID":
                assert {r.doc_id for r in got} == {*range(40), 93, None} and len(got) == 44
            if own and name == "near duplicates":
                assert len(got) == 45  # three equal rows of the first stay as one
        tokens = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
        assert len(tokens) == len(own) and sum(r.n_tokens for r in tokens) == max((r.start + r.n_tokens for r in tokens), default=0)


def test_pipeline_keeps_rows_apart_by_more_than_their_id(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randrange(3, 7))) for _ in range(900)]
    say = lambda n: " ".join(rng.choices(vocabulary, k=n))
    item, one, two, three, four = say(30), *(say(60) for _ in range(4))
    clean = [(None, say(50), "en", "s"), (None, say(50), "en", None), (7, say(50), "en", "s"), (7, say(50), "en", "s")]
    copies = [(5, one, "en", "s"), (7, one + " end", "en", "s"), (None, one, "en", "s")]
    nameless = [(None, two, "en", "s"), (None, two, "en", "s"), (None, two + " end", "en", "s")]
    same_id = [(8, three, "en", "s"), (8, three + " end", "en", "s"), (8, four, "en", "s"), (8, four, "en", "s")]
    leaked = [(None, f"{say(40)} {item} {say(40)}", "en", "s"), (7, f"{say(20)} {item} {say(70)}", "en", "s")]
    rows = [*clean, *copies, *nameless, *same_id, *leaked]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def smallest(*own):
        order = spark.createDataFrame(own, docs.schema).withColumn("h", F.xxhash64("text"))
        return tuple(order.orderBy("h").drop("h").first())

    key = lambda r: tuple(map(str, r))
    want = sorted([*clean, copies[0], smallest(*nameless), smallest(*same_id[:2]), same_id[2]], key=key)
    for deal in (1, 5):
        kept = corpus_pipeline.near_duplicates_stage(spark, docs.repartition(deal), str(tmp_path))
        assert sorted(map(tuple, kept.collect()), key=key) == sorted([*want, *leaked], key=key)
        left = corpus_pipeline.decontamination(spark, kept, str(tmp_path))
        assert left.columns == docs.columns and sorted(map(tuple, left.collect()), key=key) == want
