from __future__ import annotations

import json
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rolemesh.operators import dedupe, quality
from rolemesh.sources import boards, crawl, files, pages, registry
from rolemesh.sources import walk
from rolemesh.sources.walk import nested_postings

NOW = "2026-01-02T03:04:05+00:00"


def one(title, **extra):
    return {"source_type": "t", "source_url": "u/" + title, "title": title, "company_name": "C", "fetched_at": NOW, **extra}


def test_read_raw_jobs(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "a.jsonl").write_text(
        "\n".join([json.dumps(one("first", metadata={"k": "v"})), "", "{broken", json.dumps(one("second", json_payload={"x": [1]}))])
    )
    (tmp_path / "b" / "many.json").write_text(json.dumps([one("third"), one("fourth")], indent=2))
    (tmp_path / "b" / "single.json").write_text(json.dumps(one("fifth"), indent=2))
    (tmp_path / "source-registry-report.json").write_text(json.dumps(one("report")))
    (tmp_path / "x.report.json").write_text(json.dumps(one("sidecar")))
    good, bad = files.read_raw_jobs(spark, str(tmp_path))
    stamped = files.stamp_raw_ids(good).orderBy("raw_id").collect()
    assert [r.title for r in stamped] == ["first", "second", "third", "fourth", "fifth"]
    assert stamped[0].metadata == {"k": "v"} and json.loads(stamped[1].json_payload) == {"x": [1]}
    assert [r.record for r in bad.collect()] == ["{broken"]


@pytest.mark.parametrize("split", [1 << 27, 700])
def test_array_files_are_split_like_lines(spark, tmp_path, split):
    """One array file equals the same records as lines, wherever the cuts fall."""
    tricky = ['}', '{"', '\\', '"}],[{', 'a\\"}', "é}\n", "", "]"]
    records = [one(f"t{i}" + tricky[i % 8], description_text=tricky[(i * 3) % 8] * (i % 5), metadata={"k": tricky[i % 7]}) for i in range(200)]
    (tmp_path / "array").mkdir()
    (tmp_path / "array" / "all.json").write_text(json.dumps(records, indent=1))
    (tmp_path / "array" / "flat.json").write_text(" \n" + json.dumps(records, separators=(",", ":"), ensure_ascii=False) + "\n\n")
    (tmp_path / "array" / "none.json").write_text("[ ]")
    (tmp_path / "array" / "one.json").write_text(json.dumps(records[3], indent=2) + "\n")
    (tmp_path / "array" / "odd.json").write_text(json.dumps([7, records[4], ["x"]]))
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "all.jsonl").write_text("\n".join(map(json.dumps, records)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        good, bad = files.read_raw_jobs(spark, str(tmp_path / "array"))
        name = F.regexp_extract("place.file_path", "([a-z]+)[.]json$", 1).alias("name")
        got = {}
        for r in good.orderBy("place").select(name, "title", "description_text", "metadata").collect():
            got.setdefault(r.name, []).append((r.title, r.description_text, r.metadata))
        lines, _ = files.read_raw_jobs(spark, str(tmp_path / "lines"))
        want = [(r.title, r.description_text, r.metadata) for r in lines.orderBy("place").collect()]
        assert len(want) == 200 and got["all"] == want and got["flat"] == want and got["one"] == [want[3]]
        assert set(got) == {"all", "flat", "one"} and len(bad.collect()) == 2
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def landed(spark, payload, **extra):
    return spark.createDataFrame([("acme", json.dumps(payload) if not isinstance(payload, str) else payload, NOW)], "board string, payload string, fetched_at string").withColumn("account", F.col("board"))


def test_greenhouse(spark):
    payload = {"jobs": [
        {"id": 5, "title": "Eng", "absolute_url": "https://x/5", "content": "<p>Do<br/>it</p>", "updated_at": "2026-01-01", "internal_job_id": 9, "departments": [{"name": "D"}], "offices": [{"name": "Berlin"}, {"name": None}, {"name": "Remote"}]},
        {"title": None, "offices": []},
    ]}
    a, b = boards.flatten_greenhouse(landed(spark, payload)).orderBy("pos").collect()
    assert (a.external_job_id, a.location_text, a.description_text, a.posted_at) == ("5", "Berlin, Remote", "Do it", "2026-01-01")
    assert json.loads(a.metadata["departments"]) == [{"name": "D"}]
    assert (b.title, b.external_job_id, b.location_text, b.description_text) == ("Untitled role", None, None, "")
    assert b.source_url == "https://boards-api.greenhouse.io/v1/boards/acme/jobs?content=true"


@pytest.mark.parametrize(
    "payload, titles",
    [
        ([{"text": "a"}, {"title": "b"}], ["a", "b"]),
        ({"postings": [{"text": "a"}], "results": {"items": [{"text": "b"}]}}, ["b", "a"]),
        ({"data": [[{"text": "a"}], {"jobs": [{"hostedUrl": "h"}]}]}, ["a", "Untitled role"]),
        ({"other": [{"text": "lost"}]}, []),
        ("not json", []),
    ],
)
def test_lever_shapes(spark, payload, titles):
    rows = boards.flatten_lever(landed(spark, payload)).orderBy("pos").collect()
    assert [r.title for r in rows] == titles


def test_lever_fields(spark):
    posting = {"leverId": "L1", "title": "T", "hostedUrl": "", "applyUrl": "https://apply", "description": "<b>x</b> y", "categories": {"location": {"name": "HQ", "country": "DE"}, "commitment": "Full Time"}, "createdAt": 1700000000123, "zip": {"a": 1}}
    row = boards.flatten_lever(landed(spark, [posting])).first()
    assert (row.source_url, row.external_job_id, row.location_text, row.employment_type) == ("https://apply", "L1", "HQ, DE", "full-time")
    assert (row.posted_at, row.description_text) == ("2023-11-14T22:13:20.123000+00:00", "x y")
    assert "zip" in json.loads(row.metadata["additional"])


def test_deep_lever_nesting(spark):
    payload = {"text": "deep"}
    for _ in range(40):
        payload = {"data": [payload]}
    df = spark.createDataFrame([(json.dumps(payload),)], "p string")
    assert df.select(nested_postings("p")).first()[0] == ['{"text": "deep"}']


def test_ashby(spark):
    payload = {"meta": {"name": "Org", "jobBoardLink": "https://board"}, "jobs": [
        {"id": "i", "title": "T", "location": "Paris", "address": {"postalAddress": {"addressLocality": "Paris"}}, "secondaryLocations": [{"location": "Lyon"}, {"location": "Paris"}], "employmentType": "FullTime", "descriptionPlain": "plain"},
    ]}
    row = boards.flatten_ashby(landed(spark, payload)).first()
    assert (row.company_name, row.location_text, row.employment_type, row.source_url) == ("Org", "Paris, Lyon", "full-time", "https://board")


def test_jsonld_variants(spark):
    def script(body):
        return f'<script type="application/ld+json">{body}</script>'

    posting = {"@type": "JobPosting", "title": "T", "identifier": {"value": 7}, "jobLocation": [{"address": {"addressRegion": "R"}}, {"address": {"addressRegion": "S"}}], "hiringOrganization": "text"}
    html = script(json.dumps(posting)) + script("{bad") + script("") + script(json.dumps([{"@graph": [{"@type": "Org"}, posting]}])) + script('{"@type": "Event"}')
    df = spark.createDataFrame([("https://p", html, NOW)], "url string, html string, fetched_at string")
    rows = pages.extract_jsonld(df).collect()
    assert len(rows) == 2
    assert {(r.title, r.external_job_id, r.location_text, r.company_name, r.source_url) for r in rows} == {("T", "7", "R", "Unknown company", "https://p")}


def test_html_page(spark):
    html = "<title>Doc</title><h1> <b>Lead</b> </h1><p>Location: Berlin, DE</p>!"
    df = spark.createDataFrame([("u", html, NOW), ("v", "<title>Only</title>based in Oslo", NOW), ("w", "", NOW)], "url string, html string, fetched_at string")
    rows = {r.source_url: r for r in pages.extract_html(df).collect()}
    assert (rows["u"].title, rows["u"].location_text) == ("Lead", "Berlin, DE")
    assert (rows["v"].title, rows["v"].location_text) == ("Only", "Oslo")
    assert rows["w"].title == "Untitled role"


def test_registry_of_five(spark, tmp_path):
    rows = [
        ("gh", 1, json.dumps({"jobs": [{"id": 1, "title": "G", "absolute_url": "a"}, {"id": 2, "title": "H", "absolute_url": "b"}]}), NOW),
        ("lv", 1, json.dumps([{"text": "L", "id": "1"}]), NOW),
        ("pg", 1, "<h1>P</h1>", NOW),
        ("off", 1, "<h1>never</h1>", NOW),
    ]
    landed = spark.createDataFrame(rows, "source_name string, seq long, payload string, fetched_at string")
    sources = [
        {"name": "gh", "type": "greenhouse", "config": {"board": "b", "max_jobs": 1}},
        {"name": "lv", "type": "lever", "account": "a"},
        {"name": "pg", "kind": "html", "config": {"url": "https://p"}},
        {"name": "off", "type": "html", "enabled": False, "config": {"url": "https://q"}},
        {"name": "bad", "type": "greenhouse", "config": {}},
    ]
    records, report = registry.ingest_sources(spark, sources, landed)
    assert sorted(r.title for r in records.collect()) == ["G", "L", "P"]
    summary = registry.ingest_summary(report).first().asDict()
    assert summary == {"sources_seen": 5, "sources_succeeded": 3, "sources_failed": 1, "sources_skipped": 1, "records_written": 3, "status": "error"}
    errors = {r.name: r.error for r in report.collect() if r.error}
    assert errors == {"bad": "Source type 'greenhouse' requires field 'board'"}
    with pytest.raises(registry.SourceError):
        registry.ingest_sources(spark, sources, landed, continue_on_error=False)


def test_records_that_break_the_contract_fail_their_source(spark):
    rows = [("crawl", 1, json.dumps(one("fine")), NOW), ("crawl", 2, json.dumps({"title": "no url"}), NOW), ("pg", 1, "<h1>P</h1>", NOW)]
    landed = spark.createDataFrame(rows, "source_name string, seq long, payload string, fetched_at string")
    sources = [{"name": "crawl", "type": "company_site", "config": {"source": "s"}}, {"name": "pg", "type": "html", "config": {"url": "https://p"}}]
    records, report = registry.ingest_sources(spark, sources, landed)
    assert [r.title for r in records.collect()] == ["P"]
    status = {r.name: (r.status, r.error) for r in report.collect()}
    assert status["pg"] == ("ok", None) and status["crawl"] == ("error", "$.company_name expected string, got NoneType")


def test_detail_payload_ties_and_fallbacks(spark):
    first = {"data": {"title": "A", "id": "1", "more": {"cityList": ["X", "Y"]}}}
    second = {"data": {"title": "B", "id": "2"}}
    rows = [("p", 0, json.dumps(first)), ("p", 1, json.dumps(second)), ("q", 0, "nope"), ("r", 0, json.dumps({"jobName": 5, "position_id": True}))]
    out = {r.page_url: r for r in crawl.resolve_detail_payload(spark.createDataFrame(rows, "page_url string, seq int, payload string")).collect()}
    assert (out["p"].title, out["p"].external_id, out["p"].location) == ("A", "1", "X / Y")
    assert "q" not in out and out["r"].title == "5"


def test_campus_stubs(spark):
    items = [json.dumps({"id": "9001700170", "title": "编译器开发", "city": "成都", "recruitType": "秋招"}), json.dumps({"title": "no id"})]
    df = spark.createDataFrame([(i,) for i in items], "item string")
    rows = crawl.listing_stubs(df, "bytedance_campus").collect()
    assert [(r.detail_url, r.external_id, r.location, r.employment) for r in rows] == [
        ("https://jobs.bytedance.com/campus/position/9001700170/detail", "9001700170", "成都", "秋招")
    ]
    item = json.dumps({"id": "58", "pid": "9", "tid": "4", "title": "图形引擎", "location": ["杭州", "西安"]}, ensure_ascii=False)
    row = crawl.listing_stubs(spark.createDataFrame([(item,)], "item string"), "tencent_campus").first()
    assert (row.detail_url, row.location) == ("https://join.qq.com/post_detail.html?id=58&pid=9&tid=4", "杭州 / 西安")


def test_contract_messages(spark):
    bad = {"source_type": 1, "title": None, "company_name": "c", "fetched_at": "f", "metadata": [], "extra": 1, "posted_at": True}
    df = spark.createDataFrame([("a", json.dumps(bad)), ("b", "{"), ("c", json.dumps(one("x")))], "k string, j string")
    found = {(r.context, r.path, r.message) for r in quality.violations(df, "raw_job", "j", F.col("k")).collect()}
    assert found == {
        ("a", "$.source_url", "is required"),
        ("a", "$.source_type", "expected string, got int"),
        ("a", "$.title", "expected string, got NoneType"),
        ("a", "$.metadata", "expected object | null, got list"),
        ("a", "$.posted_at", "expected string | null, got bool"),
        ("b", "$", "is not valid JSON"),
    }
    with pytest.raises(quality.ContractError, match=r"\$\.source_url is required"):
        quality.require_valid(df, "raw_job", "j", F.col("k"))


def test_closed_and_typed_extra_properties(spark):
    closed = {"type": "object", "required": [], "properties": {"a": {"type": "integer"}}, "additionalProperties": False}
    typed = {"type": "object", "properties": {}, "additionalProperties": {"type": "array", "items": {"type": "number"}}}
    df = spark.createDataFrame([("k", json.dumps({"a": True, "b": [1, "x", 2.5]}))], "k string, j string")

    def found(contract):
        return sorted((r.path, r.message) for r in quality.violations(df, contract, "j", F.col("k")).collect())

    assert found(closed) == [("$.a", "expected integer, got bool"), ("$.b", "is not allowed")]
    assert found(typed) == [("$.a", "expected array, got bool"), ("$.b[1]", "expected number, got str")]
    summary = {"type": "array", "items": {"type": "object", "required": ["id"], "properties": {}}}
    assert found(summary) == [("$", "expected array, got dict")]


def test_import_and_normalise(spark):
    rows = [
        (1, "g", "https://g/1", "1", "Platform Engineer!", "Quarzo Corporation", "Hybrid, US", "Build it."),
        (2, "g", "https://g/1", "1", "Again", "Quarzo Corporation", None, "x"),
        (3, "l", "https://l/2", None, "Engineer", " quarzo ", None, "remote work"),
        (4, "l", "https://l/3", "", "Engineer", "lumenor", None, "A Remote role"),
        (5, "l", "https://l/4", "9", "工程师", "某公司", None, "t"),
    ]
    raw = spark.createDataFrame(rows, "raw_id long, source_type string, source_url string, external_job_id string, title string, company_name string, location_text string, description_text string")
    for c in ("employment_type", "posted_at", "description_html", "json_payload"):
        raw = raw.withColumn(c, F.lit(None).cast("string"))
    raw = raw.withColumn("metadata", F.lit(None).cast("map<string,string>")).withColumn("fetched_at", F.lit(NOW))
    fresh = dedupe.insert_if_absent(raw)
    assert sorted(r.raw_id for r in fresh.collect()) == [1, 3, 4, 5]
    assert dedupe.insert_if_absent(raw, fresh).count() == 0
    quarzo = {"id": "company:quarzo", "name": "QUARZO"}
    aliases = dedupe.alias_table(spark, {"quarzo": quarzo, "quarzo corporation": quarzo, "lumenor": {"id": "company:lumenor", "name": "LumenOr"}})
    normalized = dedupe.normalize_jobs(fresh, aliases)
    jobs = {r.raw_id: r for r in normalized.collect()}
    assert jobs[1].title_normalized == "platform engineer" and jobs[1].id == "job:quarzo:1"
    assert [jobs[i].remote_mode for i in (1, 3, 4, 5)] == ["hybrid", "remote", "remote", None]
    assert jobs[5].title_normalized == "" and jobs[5].company_id == "company:unknown"
    assert jobs[4].id.startswith("job:lumenor:") and jobs[4].raw_payload == "{}" and jobs[4].metadata == {}
    companies = {r.id: r for r in dedupe.upsert_companies(normalized).collect()}
    assert companies["company:quarzo"].aliases == [" quarzo "] and companies["company:quarzo"].name == "QUARZO"
    assert dedupe.unsluggable_companies(dedupe.resolve_company(raw, aliases)).first().canonical_name == "某公司"


def test_reposted_jobs_merge(spark):
    cols = "raw_id long, id string, company_id string, source_type string, external_id string, dedupe_fingerprint string, title string"
    rows = [
        (1, "job:c:1", "c", "s", "1", "F1", "old"),
        (2, "job:c:1", "c", "s", "1", "F2", "new"),  # same external id: overwritten
        (3, "job:c:x", "c", "s", None, "F9", "no id"),
        (4, "job:c:7", "c", "s", "7", "F9", "again"),  # same fingerprint, new external id
        (5, "job:c:8", "c", "s", "8", "F8", "alone"),
        (6, "job:c:8", "c", "t", "8", "F7", "other source, same id"),
    ]
    out = {r.id: r for r in dedupe.upsert_jobs(spark.createDataFrame(rows, cols)).collect()}
    assert {k: (v.title, v.raw_id, v.first_ord) for k, v in out.items()} == {
        "job:c:1": ("new", 2, 1), "job:c:x": ("again", 4, 3), "job:c:8": ("other source, same id", 6, 5),
    }
    assert [r.id for r in dedupe.id_collisions(spark.createDataFrame(list(out.values()))).collect()] == ["job:c:8"]


def test_payloads_are_opened_a_piece_at_a_time():
    """Only a piece of a batch is held as Python objects; the rest is Arrow."""
    payloads = [json.dumps({"a": [{"title": f"t{i}", "n": j} for j in range(8)]}) for i in range(4_000)]

    def peak(work):
        tracemalloc.start()
        out = work()
        top = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return out, top

    opened, held = peak(lambda: walk._opened(pa.array(payloads), walk._objects, walk.OBJECTS))
    whole, all_at_once = peak(lambda: [walk._objects(p) for p in payloads])
    assert held < all_at_once / 4
    assert opened.to_pylist() == whole


def test_rows_of_one_small_file_are_opened_on_all_cores(spark, tmp_path):
    from rolemesh.catalog import landing

    rows = [(i, f"c{i}", "m", 0.0, 1) for i in range(100)]
    customers = spark.createDataFrame(rows, "c_custkey long, c_name string, c_mktsegment string, c_acctbal double, c_nationkey long")
    customers.coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    cores = spark.sparkContext.defaultParallelism
    assert landing._list_payloads(spark, str(tmp_path)).rdd.getNumPartitions() >= cores


def test_list_items_are_read_once_per_item(spark):
    """The filter on the URL stands above the attributes that it names, it does not read them again."""
    items = spark.createDataFrame([('{"id": 1}',)], "item string")
    stubs = crawl.listing_stubs(items, "tencent_campus").select("detail_url", "title")
    plan = stubs._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if line.lstrip(" :+-").startswith("Filter")]
    assert filters and not any("transform" in line for line in filters)
