"""The given tables read as postings and as a job-skill graph (see FIXTURES.md, part B)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import Cue
from ..operators import dedupe, graph, similarity
from ..operators.browse import GraphTables
from ..operators.vocabulary import Rules, Skill
from ..session import spread

FETCHED_AT = "2024-01-01T00:00:00+00:00"


# Texts cost far more to work on than to move.
HEAVY_ROWS = {"documents", "pages"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    scan = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(scan) if name in HEAVY_ROWS else scan


# --- documents as postings ---------------------------------------------------

# Ordinary words of the documents stand in for skills and cues.
TAXONOMY = [
    Skill("skill:with", "With", "with", (), "skill:function", "function"),
    Skill("skill:thin", "Thin", "thin", ("then",), "skill:content", "content"),
    Skill("skill:thing", "Thing", "thing", (), "skill:content", "content"),
    Skill("skill:que", "Que", "que", (), "skill:function", "romance"),
    Skill("skill:der", "Der", "der", (), None, "german"),
    Skill("skill:pour", "Pour", "pour", ("los",), "skill:function", "romance"),
    Skill("skill:license", "License", "license", (), None, None),
    Skill("skill:are", "Are", "are", ("of the", "is"), "skill:function", "function"),
]
RULES = Rules(
    sections={
        "preferred": Cue(["than"]),
        "required": Cue(["from"]),
        "responsibilities": Cue(["from"]),
        "qualifications": Cue(["with"]),
    },
    role_families=[
        ("legal", Cue(["license"])),
        ("de", Cue(["der"])),
        ("fr", Cue(["pour"])),
        ("es", Cue(["los"])),
    ],
    seniority=[("senior", Cue(["with"])), ("junior", Cue(["que"]))],
    remote=[("remote", Cue(["license"])), ("hybrid", Cue(["thing"])), ("onsite", Cue(["from"]))],
    employment=[("contract", Cue(["then"])), ("internship", Cue(["thing"]))],
)


def raw_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as raw postings. French ones have no external id, so both keys occur."""
    d = table(spark, sf_dir, "documents")
    none = F.lit(None).cast("string")
    return d.select(
        F.col("doc_id").alias("raw_id"),
        F.lit("doc").alias("source_type"),
        F.concat(F.lit("doc://"), F.col("doc_id").cast("string")).alias("source_url"),
        F.when(F.col("lang") != "fr", F.col("n_chars").cast("string")).alias("external_job_id"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("source").alias("company_name"),
        F.col("lang").alias("location_text"),
        none.alias("employment_type"),
        none.alias("posted_at"),
        F.col("text").alias("description_text"),
        none.alias("description_html"),
        none.alias("json_payload"),
        F.lit(None).cast("map<string,string>").alias("metadata"),
        F.lit(FETCHED_AT).alias("fetched_at"),
    )


def normalized_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.normalize_jobs(
        raw_jobs(spark, sf_dir), dedupe.alias_table(spark, ALIASES), RULES.remote, RULES.employment
    )


ALIASES = {
    "src1": {"id": "company:one", "name": "Source One"},
    "src2": {"id": "company:one", "name": "Source One"},
    "src3": "company:three",
}


def document_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as normalised jobs, one per document."""
    c = F.col
    return normalized_documents(spark, sf_dir).withColumn(
        "id", F.concat(F.lit("job:doc:"), c("raw_id").cast("string"))
    )


# --- orders, line items and parts as a graph ---------------------------------


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.concat(F.lit("company:"), F.col("c_custkey").cast("string")).alias("id"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("industry"),
    )


def skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        F.concat(F.lit("skill:"), F.col("p_partkey").cast("string")).alias("id"),
        F.col("p_name").alias("label"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("parent_id"),
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    joined = o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").join(
        n, F.col("c_nationkey") == F.col("n_nationkey"), "left"
    )
    return joined.select(
        F.concat(F.lit("job:"), F.col("o_orderkey").cast("string")).alias("id"),
        F.concat(F.lit("company:"), F.col("o_custkey").cast("string")).alias("company_id"),
        F.col("c_name").alias("company_name"),
        F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("title"),
        F.col("n_name").alias("location_text"),
        F.lower("o_orderstatus").alias("remote_mode"),
        F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")).alias("seniority"),
        F.col("o_orderpriority").alias("role_family"),
        F.date_format(F.col("o_orderdate").cast("timestamp_ntz"), "yyyy-MM-dd").alias("posted_at"),
    )


def job_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as job-skill rows, one per (job, skill, type); the type fixes the weight."""
    lines = table(spark, sf_dir, "lineitem")
    pairs = lines.select(
        "l_orderkey", "l_partkey", (F.col("l_returnflag") == "R").alias("prefers")
    ).distinct()
    prefers = F.col("prefers")
    return pairs.select(
        F.concat(F.lit("job:"), F.col("l_orderkey").cast("string")).alias("job_id"),
        F.concat(F.lit("skill:"), F.col("l_partkey").cast("string")).alias("skill_id"),
        F.when(prefers, "PREFERS").otherwise("REQUIRES").alias("edge_type"),
        F.when(prefers, 0.6).otherwise(1.0).alias("weight"),
        F.when(prefers, 0.6).otherwise(0.75).alias("confidence"),
    )


def known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.known_job_skills(
        job_skills(spark, sf_dir), jobs(spark, sf_dir), skills(spark, sf_dir)
    )


def neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.similar_top_k(known(spark, sf_dir))


def graph_tables(spark: SparkSession, sf_dir: str, similar: bool = False) -> GraphTables:
    """The graph of the tables; similarity only where a query needs it."""
    c, s, j = companies(spark, sf_dir), skills(spark, sf_dir), jobs(spark, sf_dir)
    k = graph.known_job_skills(job_skills(spark, sf_dir), j, s)
    near = similarity.similar_top_k(k) if similar else None
    pairs = similarity.kept_pairs(near) if similar else None
    return GraphTables(
        companies=c,
        skills=s,
        jobs=j,
        known=k,
        nodes=graph.all_nodes(c, s, j),
        edges=graph.all_edges(j, k, pairs),
        search=graph.search_index(c, s, j),
        neighbors=near,
    )
