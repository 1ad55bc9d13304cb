"""Stored state: versioned tables, checked writes, exports, JSON lines, the run log."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.quality import ContractError, record_problems
from ..schemas import RUN_LOG
from ..session import scratch_folder

TRUTH_TABLES = ["raw_jobs", "companies", "jobs", "skills", "job_enrichment", "job_skill_edges", "run_log"]
SKILL_BUCKETS = 64
VERSION = "version"


def write_version(df: DataFrame, path: str, version: int, column: str = VERSION) -> None:
    """Store ``df`` as one version of the table at ``path``; the caller names the version.

    Versions are values of a partition column. Writing one replaces that one alone, so a
    repeated write does no harm and writers of different versions keep out of each other's way.
    """
    (
        df.withColumn(column, F.lit(version).cast("long"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(column)
        .parquet(path)
    )


def read_versions(spark: SparkSession, path: str) -> DataFrame | None:
    """All versions of a table, or None before the first one."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def read_version(spark: SparkSession, path: str, version: int, column: str = VERSION) -> DataFrame:
    """One version; only its files are read."""
    return spark.read.parquet(path).where(F.col(column) == version).drop(column)


def latest_version(spark: SparkSession, path: str, column: str = VERSION) -> int | None:
    """The largest version stored, from the names of the folders."""
    found = read_versions(spark, path)
    return None if found is None else found.agg(F.max(column)).first()[0]


def write_truth_tables(tables: dict[str, DataFrame], root: str, version: int) -> dict[str, int]:
    """Write entity tables as one version, nested columns as they are; every name must be a known table.

    Returns the rows written per table, counted while writing.
    """
    unknown = set(tables) - set(TRUTH_TABLES)
    if unknown:
        raise ValueError(f"unknown tables: {sorted(unknown)}")
    written = {}
    for name, df in tables.items():
        seen = Observation()
        write_version(df.observe(seen, F.count(F.lit(1)).alias("rows")), f"{root}/{name}", version)
        written[name] = seen.get["rows"]
    return written


def write_validated(df: DataFrame, path: str, contract: str, key: str, fmt: str = "parquet") -> int:
    """Check every record against its contract and write them all, or nothing when one fails.

    The input is computed once: rows go to a staging folder together with their problems,
    which are counted on the way, and from there to ``path``. Returns the rows written.
    """
    record = F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)), {"ignoreNullFields": "false"})
    context = F.concat(F.lit(contract + "["), F.col(key).cast("string"), F.lit("]"))
    checked = df.select(
        F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"),
        context.alias("context"),
        record_problems(record, contract).alias("problems"),
    )
    seen = Observation()
    counted = checked.observe(
        seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.size("problems") > 0).alias("broken")
    )
    staging = scratch_folder(df.sparkSession, "staging")
    counted.write.parquet(staging)
    staged = df.sparkSession.read.schema(checked.schema).parquet(staging)
    if seen.get["broken"]:
        listed = staged.where(F.size("problems") > 0).select("context", F.explode("problems").alias("p")).limit(20)
        raise ContractError("; ".join(f"{r.context}: {r.p.path} {r.p.message}" for r in listed.collect()))
    staged.select("row.*").write.mode("overwrite").format(fmt).save(path)
    return seen.get["rows"]


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object per line, nulls kept, text unescaped."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_read_models(
    models: dict[str, DataFrame], root: str, fmt: str = "json", skill_table: str = "skill_jobs", buckets: int = SKILL_BUCKETS
) -> None:
    """Write each read model as rows sorted by key over range partitions.

    A range partition may split one key, so a hot company or skill spreads over several
    files. ``skill_jobs`` becomes the catalog table ``skill_table``, bucketed by skill: a skill
    is fetched, and joined, without touching the other buckets.
    """
    for name, df in models.items():
        # The first three columns identify and order a row of every read model.
        lead = df.columns[:3]
        if name == "skill_jobs":
            writer = df.write.mode("overwrite").bucketBy(buckets, "skill_id").sortBy("skill_id", "job_id")
            writer.format("parquet").option("path", f"{root}/{name}").saveAsTable(skill_table)
            continue
        writer = df.repartitionByRange(*lead).sortWithinPartitions(*lead).write.mode("overwrite")
        if fmt == "json":
            writer = writer.option("ignoreNullFields", "false")
        writer.format(fmt).save(f"{root}/{name}")


def append_run_log(
    spark: SparkSession, path: str, run_id: str, stage: str, status: str, details: dict[str, str] | None = None
) -> None:
    """Add one event to the run log."""
    row = spark.range(1).select(
        F.lit(run_id).alias("run_id"),
        F.lit(stage).alias("stage"),
        F.lit(status).alias("status"),
        F.create_map(*[F.lit(str(x)) for kv in (details or {}).items() for x in kv])
        .cast("map<string,string>")
        .alias("details"),
        F.current_timestamp().alias("created_at"),
    )
    spark.createDataFrame([], RUN_LOG).unionByName(row).coalesce(1).write.mode("append").parquet(path)


def _millis(start: Column, end: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.timestamp_diff("MILLISECOND", start, end))


def stage_durations(log: DataFrame) -> DataFrame:
    """Per run and stage: first and last event apart in milliseconds, and whether it failed."""
    return (
        log.groupBy("run_id", "stage")
        .agg(
            F.min("created_at").alias("started_at"),
            F.max("created_at").alias("ended_at"),
            F.bool_or(F.col("status") == "error").alias("failed"),
        )
        .withColumn("duration_ms", _millis(F.col("started_at"), F.col("ended_at")))
    )


def run_status(log: DataFrame) -> DataFrame:
    """Per run: duration and ``error`` when any stage failed, else ``ok``."""
    return log.groupBy("run_id").agg(
        F.count_distinct("stage").alias("stages"),
        _millis(F.min("created_at"), F.max("created_at")).alias("duration_ms"),
        F.when(F.bool_or(F.col("status") == "error"), "error").otherwise("ok").alias("status"),
    )
