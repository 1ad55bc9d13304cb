from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rolemesh.operators import dedupe, enrich, graph, quality
from rolemesh.operators.vocabulary import load_taxonomy
from rolemesh.plans import stages, standins
from rolemesh.sinks import tables
from rolemesh.streaming import ingest

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(str, df.collect()))


def test_versions_keep_out_of_each_others_way(spark, tmp_path):
    path = str(tmp_path / "jobs")
    assert tables.read_versions(spark, path) is None and tables.latest_version(spark, path) is None
    tables.write_version(spark.range(3), path, 1)
    tables.write_version(spark.range(9), path, 7)
    tables.write_version(spark.range(5), path, 7)  # a repeated write replaces its own version
    assert tables.latest_version(spark, path) == 7
    assert [tables.read_version(spark, path, v).count() for v in (1, 7)] == [3, 5]
    assert tables.read_version(spark, path, 7).columns == ["id"]
    with pytest.raises(ValueError):
        tables.write_truth_tables({"nonsense": spark.range(1)}, str(tmp_path), 1)
    assert tables.write_truth_tables({"jobs": spark.range(4), "skills": spark.range(0)}, str(tmp_path), 8) == {"jobs": 4, "skills": 0}


def test_jsonl_and_validated_writes(spark, tmp_path):
    df = spark.createDataFrame([("é", None)], "id string, name string")
    tables.write_jsonl(df, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first()[0] == '{"id":"é","name":null}'
    with pytest.raises(quality.ContractError, match=r"company\[é\]: \$.name expected string, got NoneType"):
        tables.write_validated(df, str(tmp_path / "bad"), "company", "id")
    assert not (tmp_path / "bad").exists()
    assert tables.write_validated(df.fillna("n"), str(tmp_path / "good"), "company", "id") == 1
    assert spark.read.parquet(str(tmp_path / "good")).count() == 1


def test_validated_write_computes_its_input_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            calls.add(batch.num_rows)
            yield batch

    df = spark.createDataFrame([(f"c{i}", "n") for i in range(7)], "id string, name string").mapInArrow(counted, "id string, name string")
    assert tables.write_validated(df, str(tmp_path / "once"), "company", "id") == 7
    assert calls.value == 7


def test_skill_jobs_are_bucketed(spark, tmp_path, capsys):
    rows = spark.createDataFrame([(f"s{i % 5}", f"j{i}", "REQUIRES") for i in range(50)], "skill_id string, job_id string, edge_type string")
    tables.write_read_models({"skill_jobs": rows}, str(tmp_path), skill_table="skill_jobs_test", buckets=8)
    stored = spark.table("skill_jobs_test")
    assert stored.where("skill_id = 's3'").count() == 10
    stored.hint("merge").join(stored.withColumnRenamed("job_id", "other"), "skill_id").explain("formatted")
    shown = capsys.readouterr().out
    assert "Bucketed: true" in shown and "Exchange" not in shown, shown
    spark.sql("DROP TABLE skill_jobs_test")


def test_run_log(spark, tmp_path):
    path = str(tmp_path / "log")
    tables.append_run_log(spark, path, "r1", "import", "ok", {"seen": 3})
    tables.append_run_log(spark, path, "r1", "enrich", "error")
    log = spark.read.parquet(path)
    status = tables.run_status(log).first()
    assert (status.stages, status.status) == (2, "error") and status.duration_ms >= 0
    assert {r.stage: r.failed for r in tables.stage_durations(log).collect()} == {"import": False, "enrich": True}


def test_upserts_are_idempotent(spark):
    events = standins.table(spark, SF, "events").withColumn("ord", F.col("event_id"))
    keys, over, keep = ["user_id", "event_type"], ["props"], ["value"]
    once = dedupe.upsert_last_wins(events, keys, "ord", over, keep)
    twice = dedupe.upsert_last_wins(events.unionByName(events), keys, "ord", over, keep)
    assert rows(once) == rows(twice)


def _arrive(df, path, conditions):
    """The rows of each condition as a file that arrives with the next run of a stream."""
    for condition in conditions:
        df.where(condition).coalesce(1).write.mode("append").parquet(path)
        yield df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_stream_raw_ingest_equals_batch(spark, tmp_path):
    raw = standins.raw_jobs(spark, SF)
    doubled = raw.unionByName(raw).orderBy(F.xxhash64("raw_id"))
    path, check = str(tmp_path / "raw"), str(tmp_path / "check")
    arrivals = ["raw_id < 70", "raw_id >= 60 and raw_id < 140", "raw_id >= 20"]  # rows come again later
    for source in _arrive(doubled, str(tmp_path / "in"), arrivals):
        ingest.stream_raw_ingest(source, path, check).awaitTermination()  # a restart each time
    batch = dedupe.insert_if_absent(raw).select("source_key", "raw_id")
    stored = tables.read_versions(spark, path)
    assert rows(stored.select("source_key", "raw_id")) == rows(batch)
    assert stored.select("batch").distinct().count() == 3


def test_stream_upsert_equals_batch(spark, tmp_path):
    events = standins.table(spark, SF, "events").select(
        "user_id", "event_type", "props", F.when(F.col("value") > 20, F.col("value")).alias("value"), F.col("event_id").alias("ord")
    )
    path, check = str(tmp_path / "state"), str(tmp_path / "check")
    keys = ["user_id", "event_type"]
    # Late rows, and a batch that brings nothing new.
    arrivals = ["ord % 3 = 1", "ord % 3 = 0", "ord % 3 = 1 and ord < 500", "ord % 3 = 2"]
    for i, source in enumerate(_arrive(events, str(tmp_path / "in"), arrivals)):
        ingest.stream_upsert(source, path, check, keys, "ord", ["props"], ["value"]).awaitTermination()
        if i == 1:
            assert ingest.compact(spark, path, keys) == 1 == ingest.compact(spark, path, keys)
            # What is retired is not read any more.
            assert {r.batch for r in ingest.state_files(spark, path).select("batch").distinct().collect()} == {1}
    changes = {r.batch: r["count"] for r in tables.read_versions(spark, f"{path}/changes").groupBy("batch").count().collect()}
    assert 2 not in changes and sum(changes.values()) < 2 * events.count()
    batch = dedupe.upsert_last_wins(events, keys, "ord", ["props"], ["value"])
    assert rows(ingest.current_state(spark, path, keys).select(*batch.columns)) == rows(batch)
    assert ingest.compact(spark, path, keys) == 3
    # A replay of a compacted batch changes nothing.
    again = tables.read_version(spark, f"{path}/changes", 3, "batch")
    tables.write_version(again, f"{path}/changes", 3, "batch")
    assert rows(ingest.current_state(spark, path, keys).select(*batch.columns)) == rows(batch)


def test_stream_enrich_equals_batch(spark, tmp_path):
    taxonomy = load_taxonomy({"with": {}, "der": {}, "pour": {}})
    columns = ["id", "title", "description_text", "remote_mode", "description_hash"]
    jobs = standins.document_jobs(spark, SF).select(*columns, F.col("raw_id").alias("ord"))
    path, check = str(tmp_path / "store"), str(tmp_path / "check")
    for source in _arrive(jobs, str(tmp_path / "in"), ["ord < 120", "ord >= 60"]):
        ingest.stream_enrich(source, path, check, taxonomy).awaitTermination()
    want = enrich.skill_matches(enrich.enrich(jobs, taxonomy)).select("job_id", "skill_id", "edge_type")
    got = enrich.skill_matches(ingest.enriched(spark, path)).select("job_id", "skill_id", "edge_type")
    assert rows(got) == rows(want)
    computed = tables.read_versions(spark, f"{path}/results")
    assert computed.count() == jobs.select("description_hash").distinct().count() < jobs.count()
    assert ingest.enriched(spark, path).count() == jobs.count()


def test_end_to_end(spark, tmp_path):
    """Postings to graph: the exports agree with each other."""
    raw = standins.raw_jobs(spark, SF)

    def kept(name, df):
        tables.write_version(df, str(tmp_path / name), 1)
        return tables.read_version(spark, str(tmp_path / name), 1)

    normal = stages.normalize_stage(dedupe.insert_if_absent(raw).drop("source_key"), dedupe.alias_table(spark, standins.ALIASES), standins.RULES)
    companies, jobs = kept("companies", normal["companies"]), kept("jobs", normal["jobs"])
    found = stages.enrich_stage(jobs, standins.TAXONOMY, standins.RULES)
    enrichment, skills, edges = (kept(n, found[k]) for n, k in [("job_enrichment", "enrichment"), ("skills", "skills"), ("job_skill_edges", "edges")])
    skills = skills.withColumnRenamed("skill_id", "id")
    g = stages.graph_stage(companies, jobs, skills, edges, enrichment)
    models = stages.read_models(g)
    counts = {r.name: r.n for r in models["summary"].collect()}
    assert counts["jobs"] == jobs.count() and counts["companies"] == companies.count()
    assert models["search_index"].count() == counts["jobs"] + counts["companies"] + counts["skills"]
    assert models["job_neighbors"].count() == edges.select("job_id").distinct().count()
    kinds = {r.type for r in g.edges.select("type").distinct().collect()}
    assert kinds == {"POSTS", "LOCATED_IN", "BELONGS_TO", "REQUIRES", "PREFERS", "SIMILAR_TO"}
    ends = g.edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    assert ends.join(g.nodes, "id", "left_anti").count() == 0
    assert quality.table_violations(g.nodes.select("id", "type", "label"), "graph_node", "id").count() == 0
    some = {k: models[k] for k in ("company_jobs", "skill_jobs", "job_skills", "company_skill_stats", "summary")}
    tables.write_read_models(some, str(tmp_path / "models"), skill_table="skill_jobs_end")
    assert spark.table("skill_jobs_end").count() == graph.skill_jobs(g.known).count()
    assert spark.read.json(str(tmp_path / "models" / "job_skills")).count() == g.known.count()
    spark.sql("DROP TABLE skill_jobs_end")


def test_arrivals_are_one_batch_each_in_many_files(spark, tmp_path):
    """No task reads a whole part of the table that lands."""
    from rolemesh.catalog.state import _arrivals

    seen = []
    rows = spark.range(0, 1_000, 1, 8)

    def run(stream):
        def handle(batch, batch_id):
            seen.append((batch_id, batch.count(), batch.select(F.input_file_name()).distinct().count()))

        query = stream.writeStream.foreachBatch(handle).option("checkpointLocation", str(tmp_path / "progress"))
        return query.trigger(availableNow=True).start()

    _arrivals(rows, [F.col("id") % 2 == 0, F.col("id") % 2 == 1], "arrived", run)
    assert [(n, count) for n, count, _ in seen] == [(0, 500), (1, 500)]
    assert all(files > 1 for _, _, files in seen)
