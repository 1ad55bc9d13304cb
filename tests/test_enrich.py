from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from rolemesh.operators import enrich as E
from rolemesh.operators import providers
from rolemesh.operators.vocabulary import Rules, load_taxonomy, taxonomy_hash
from rolemesh.schemas import CACHE, ENRICHMENT

TAXONOMY = load_taxonomy(
    {
        "python": {"id": "skill:python", "label": "Python", "aliases": ["python3", "py"]},
        "java": {"id": "skill:java", "label": "Java", "aliases": []},
        "c++": {"label": "C++", "aliases": ["cpp"]},
        "sql": {"label": "SQL"},
        "machine learning": {"label": "Machine Learning", "aliases": ["机器学习"], "category": "domain"},
        "backend": {"label": "Backend", "aliases": ["后端", "back-end"]},
        "recommendation systems": {"label": "Recommendation Systems", "aliases": ["推荐系统"]},
        "multimodal": {"label": "Multimodal", "aliases": ["多模态"]},
        "llm": {"label": "LLM", "aliases": ["大模型"]},
    }
)

ROWS = [
    ("j1", "高级服务端工程师", "岗位职责：维护广告推荐系统与后端接口，日常用 Java 编写。用机器学习改进排序。\n任职要求：Java 基础扎实。会写 SQL 查询。\n加分项：做过大模型 LLM 应用。"),
    ("j2", "校招 - 语音算法工程师", "工作职责：做多模态检索研究。\n岗位要求：会用 Python，读过框架源码。\n优先考虑：参与过大模型训练。"),
    ("j3", "Senior Ranking Engineer", "Responsibilities: Own ranking models from data to launch. Required: SQL, Python, machine learning. Nice to have: LLM tuning. Pay $90,000 - 130,000 a year."),
    ("j4", "使用Java构建", "C++ dev wanted! C++11 and cpp are a plus. 使用Java构建"),
    ("j5", "", ""),
    ("j6", "Mobile", None),
]


@pytest.fixture(scope="module")
def results(spark):
    jobs = spark.createDataFrame([(*r, "remote") for r in ROWS], "id string, title string, description_text string, remote_mode string")
    rows = E.enrich(jobs, TAXONOMY).collect()
    unused = load_taxonomy({f"qz{i}xj": {"label": f"Unused {i}"} for i in range(1_500)})
    large = E.enrich(jobs, [*TAXONOMY, *unused]).collect()
    assert sorted(map(str, rows)) == sorted(map(str, large))
    return {r.job_id: r for r in rows}


def labels(row):
    return {s.label: s for s in row.skills}


def test_chinese_posting(results):
    row = results["j1"]
    assert {"Backend", "Recommendation Systems", "Java", "SQL", "LLM", "Machine Learning"} == set(labels(row))
    assert (row.role_family, row.seniority) == ("machine-learning", "senior")
    assert labels(row)["LLM"].edge_type == "PREFERS" and labels(row)["LLM"].weight == 0.6
    assert labels(row)["Backend"].confidence == 0.7  # found by its alias, no cue near it


def test_campus_posting(results):
    assert {"Multimodal", "Python", "LLM"} == set(labels(results["j2"]))
    assert results["j2"].seniority == "entry"


def test_english_posting(results):
    row = results["j3"]
    assert set(labels(row)) == {"Python", "SQL", "Machine Learning", "LLM"}
    assert row.seniority == "senior" and row.role_family == "machine-learning"
    assert row.salary_text == "$90,000 - 130,000"
    assert row.summary == "Responsibilities: Own ranking models from data to launch. Required: SQL, Python, machine learning."
    assert row.responsibilities[0].startswith("Required") and len(row.responsibilities) == 3
    assert labels(row)["Python"].confidence == 0.75
    assert row.confidence == 0.55 and row.remote_mode_inferred == "remote"


def test_boundaries_and_evidence(results):
    row = results["j4"]
    # "C++" before a blank is no match, before a digit it is; CJK letters join a Latin word.
    assert set(labels(row)) == {"C++"}
    assert labels(row)["C++"].evidence == ["C++11 and cpp are a plus."]
    assert labels(row)["C++"].edge_type == "PREFERS"


def test_empty_text(results):
    for key in ("j5", "j6"):
        row = results[key]
        assert row.skills == [] and row.confidence == 0.35 and row.summary == "" and row.salary_text is None
    assert results["j6"].role_family == "data"  # the loose term "bi" also sits inside "mobile"


def test_every_section_cue(column):
    rules = Rules()
    for name, sample in {"required": "任职要求：", "responsibilities": "What you'll do", "preferred": "Nice to have", "qualifications": "what you bring"}.items():
        assert column([sample, "unplussed"], lambda v, name=name: rules.sections[name].found(F.lower(v))) == [True, False]


def test_duplicate_skill_ids_keep_the_first(spark):
    twice = load_taxonomy({"py": {"id": "skill:x", "label": "One"}, "sql": {"id": "skill:x", "label": "Two"}})
    jobs = spark.createDataFrame([("a", "t", "py here. sql there.", None)], "id string, title string, description_text string, remote_mode string")
    assert [s.label for s in E.enrich(jobs, twice).first().skills] == ["One"]


def test_taxonomy_hash_is_stable():
    assert taxonomy_hash(TAXONOMY) == taxonomy_hash(list(TAXONOMY))
    assert taxonomy_hash(TAXONOMY) != taxonomy_hash(TAXONOMY[1:])


def test_cache_shares_texts_and_survives_bad_rows(spark):
    jobs = spark.createDataFrame(
        [("a", "t", "Python.", None, "h1"), ("b", "t", "Python.", None, "h1"), ("c", "t", "SQL.", None, "h2"), ("d", "t", "Java.", None, "")],
        "id string, title string, description_text string, remote_mode string, description_hash string",
    )
    empty = spark.createDataFrame([], CACHE)
    found, fresh, counts = E.cached_enrichment(jobs, empty, TAXONOMY)
    assert counts.first().asDict() == {"jobs_processed": 4, "cache_hits": 1, "cache_misses": 3, "cache_writes": 2}
    assert {r.job_id: [s.label for s in r.skills] for r in found.collect()} == {"a": ["Python"], "b": ["Python"], "c": ["SQL"], "d": ["Java"]}
    assert found.schema.fieldNames() == ENRICHMENT.fieldNames()
    broken = fresh.withColumn("result_json", F.when(F.col("description_hash") == "h2", "{oops").otherwise(F.col("result_json")))
    again, fresh2, counts2 = E.cached_enrichment(jobs, broken, TAXONOMY)
    assert counts2.first().cache_misses == 2 and counts2.first().cache_writes == 1
    assert again.count() == 4 and fresh2.first().description_hash == "h2"


def test_row_provider_and_registry(spark):
    def answer(job, taxonomy):
        return {"job_id": job["id"], "summary": job["title"].upper(), "skills": [{"skill_id": "s", "label": "L", "weight": "2"}], "evidence": ["e", None]}

    jobs = spark.createDataFrame([("a", "t")], "id string, title string")
    row = providers.RowProvider("mine", answer, cache_key=lambda: "v2").enrich(jobs, TAXONOMY).first()
    assert (row.summary, row.skills[0].weight, row.evidence, row.skills[0].provenance) == ("T", 2.0, ["e"], "mine")
    assert providers.provider_signature(providers.RowProvider("mine", answer, lambda: "v2")) == "v2"
    assert isinstance(providers.build_provider("heuristic"), providers.HeuristicProvider)
    with pytest.raises(ValueError):
        providers.build_provider("unknown")


def test_provider_answers(spark):
    answers = [
        ("fenced", '```json\n{"summary":"s","confidence":-1}\n```'),
        ("prose", 'Here: {"result":{"output":{"skills":[{"skill_id":" a ","label":"B","confidence":2}]}}} done'),
        ("list", '[{"role_family":"data","evidence":"one","confidence":"x"}]'),
        ("many", '[{"a":1},{"b":2}]'),
        ("broken", "{not json"),
    ]
    good, bad = providers.parse_provider_responses(spark.createDataFrame(answers, "job_id string, content string"), "m")
    rows = {r.job_id: r for r in good.collect()}
    assert rows["fenced"].confidence == 0.0 and rows["fenced"].summary == "s"
    assert rows["prose"].skills[0].skill_id == "a" and rows["prose"].skills[0].confidence == 1.0
    assert rows["list"].evidence == ["one"] and rows["list"].confidence is None
    assert sorted(r.job_id for r in bad.collect()) == ["broken", "many"]


def test_response_bodies(column):
    parts = [{"type": "text", "text": "a"}, {"type": "image", "text": "x"}, "noise", {"type": "output_text", "text": "b"}]
    bodies = [
        {"choices": [{"message": {"content": "plain"}}], "output_text": "later"},
        {"choices": [{"message": {"content": parts}}]},
        {"choices": [], "output_text": "text"},
        {"output": [{"content": parts}, {}, {"content": [{"type": "text", "text": ""}]}]},
        {"choices": [{"message": {"content": {"summary": "s"}}}]},
        {"output": []},
        {"other": 1},
    ]
    values = [json.dumps(b) for b in bodies] + ["{broken", None]
    assert column(values, lambda v: providers.response_content(v)) == [
        "plain", "ab", "text", "ab", '{"summary":"s"}', None, None, None, None,
    ]


def test_last_result_of_a_job_stays(spark):
    rows = [("a", "old", "x", 1, "t1"), ("a", None, "y", 3, "t3"), ("a", "mid", "z", 2, "t2"), ("b", "one", None, 1, "t9")]
    results = spark.createDataFrame(rows, "job_id string, summary string, seniority string, ord long, at string")
    out = {r.job_id: tuple(r)[1:] for r in E.upsert_enrichment(results, "ord", "at").collect()}
    assert out == {"a": (None, "y", "t1", "t3"), "b": ("one", None, "t9", "t9")}


def test_requests_hold_the_taxonomy(spark):
    jobs = spark.createDataFrame([("a",)], "id string")
    for c in ("title", "company_name", "location_text", "description_text", "source_url", "remote_mode", "employment_type", "description_hash"):
        jobs = jobs.withColumn(c, F.lit(None).cast("string"))
    body = json.loads(providers.build_provider_requests(jobs, TAXONOMY).first().request)
    assert len(body["taxonomy"]) == len(TAXONOMY) and body["job"]["id"] == "a" and body["job"]["title"] is None


def test_cached_enrichment_prepares_texts_once(spark):
    """What the jobs' columns cost is paid once, however many steps read them."""
    calls = spark.sparkContext.accumulator(0)

    def hashed(text):
        calls.add(1)
        return text

    jobs = spark.createDataFrame([("1", "t", "python", None), ("2", "t", "python", None)], "id string, title string, description_text string, remote_mode string")
    jobs = jobs.withColumn("description_hash", F.udf(hashed, "string")("description_text"))
    results, _, counts = E.cached_enrichment(jobs, spark.createDataFrame([], CACHE), TAXONOMY)
    assert results.count() == 2 and counts.first().cache_hits == 1
    assert calls.value == 2
