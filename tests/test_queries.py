"""Registered queries against their SQL on the smallest tables."""

from __future__ import annotations

import os

import pytest

from rolemesh.catalog import ORACLES, QUERIES

from .oracle import compare, connect

SF = "/root/testdata/sf0.001"
FAST = [
    "graph_nodes", "graph_edges", "similar_top_k", "similar_top_k_hot_skills", "node_degree", "search_index",
    "drill_down", "job_children_as_root", "focused_view_nodes", "company_pages", "skill_pages", "lookup_by_id",
    "slugs_of_documents", "derived_ids", "cleaned_whitespace", "clean_page_urls", "normalized_dates",
    "raw_insert_if_absent", "events_last_wins", "events_last_wins_in_parts", "normalized_jobs", "upserted_jobs",
    "skill_matches", "skill_matches_large_taxonomy", "enriched_jobs", "cache_counters",
    "parsed_provider_responses", "enveloped_provider_responses", "upserted_enrichment", "greenhouse_postings", "lever_postings", "ashby_postings", "jsonld_postings",
    "resolved_detail_payloads", "merged_detail_records", "raw_job_violations", "source_report",
    "company_root_similarity", "job_root_similarity", "similar_top_k_dense_skills", "upserted_mixed_chains",
    "raw_jobs_from_array_files", "truth_tables_written", "read_models_written", "json_lines_written", "run_log_appended",
    "validated_companies_written", "refused_company_write", "contract_violations", "loaded_taxonomy", "taxonomy_fingerprint",
    "row_provider_results", "provider_registry", "jobs_with_enrichment", "hydrated_jobs_with_enrichment",
    "streamed_first_postings", "streamed_last_wins", "streamed_enrichment", "safe_rich_text", "skill_root_links",
    "page_sections", "merged_sections", "phrase_locations", "written_rows_counted",
]
NAMES = sorted(ORACLES) if os.environ.get("ALL_QUERIES") else FAST


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    problem = compare(spark, con, QUERIES[name], ORACLES[name], SF)
    assert problem is None


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns[:2] == ["skill_id", "company_id"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
