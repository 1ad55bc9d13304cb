"""Company resolution, normalisation, keyed first-wins and last-wins state."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids, text
from ..session import cut_lineage
from .components import connected
from .ranking import first_per_key

# What counts as a keyword of a posting, and how many are kept.
KEYWORD = "[A-Za-z][A-Za-z0-9+-]+"
STOP_WORDS = ["the", "and", "with", "for", "you", "our", "will", "this", "that", "are", "job", "role"]
KEYWORDS_READ, KEYWORDS_KEPT = 100, 12


def insert_if_absent(raw: DataFrame, existing_keys: DataFrame | None = None) -> DataFrame:
    """Raw postings whose source key is new; of equal keys in the batch the first stays."""
    keyed = raw.withColumn(
        "source_key",
        ids.source_key(
            F.col("source_type"), F.col("company_name"), F.col("external_job_id"), F.col("source_url")
        ),
    )
    batch = first_per_key(keyed, ["source_key"], [F.col("raw_id").asc()])
    if existing_keys is None:
        return batch
    return batch.join(existing_keys.select("source_key"), "source_key", "left_anti")


def alias_table(spark, aliases: dict) -> DataFrame:
    """``{lower name: id | {id, name}}`` -> table; a bare id keeps the posting's own name."""
    rows = [
        (key, value, None) if isinstance(value, str) else (key, value["id"], value.get("name") or None)
        for key, value in aliases.items()
    ]
    return spark.createDataFrame(rows, "alias_key string, alias_id string, alias_name string")


def resolve_company(df: DataFrame, aliases: DataFrame, name: str = "company_name") -> DataFrame:
    """Adds ``company_id`` and ``canonical_name`` from the alias table or the name itself."""
    trimmed = text.strip(F.col(name))
    return (
        df.withColumn("alias_key", F.lower(trimmed))
        .join(aliases, "alias_key", "left")
        .withColumn("canonical_name", F.coalesce("alias_name", trimmed))
        .withColumn("company_id", F.coalesce("alias_id", ids.company_id(trimmed)))
        .drop("alias_key", "alias_id", "alias_name")
    )


def unsluggable_companies(resolved: DataFrame) -> DataFrame:
    """Names without an ASCII form all share one id; report them instead of hiding it."""
    return (
        resolved.where(F.col("company_id") == "company:unknown")
        .groupBy("company_id", "canonical_name")
        .agg(F.count("*").alias("postings"))
    )


def keyword_hash(description: Column) -> Column:
    """Hash of the first 12 words, in sorted order, of the distinct leading keywords."""
    words = F.filter(
        F.regexp_extract_all(F.lower(description), F.lit(KEYWORD), F.lit(0)),
        lambda w: ~w.isin(STOP_WORDS),
    )
    picked = F.slice(F.array_sort(F.array_distinct(F.slice(words, 1, KEYWORDS_READ))), 1, KEYWORDS_KEPT)
    return text.short_hash(F.array_join(picked, " "))


def dedupe_fingerprint(company: Column, title: Column, location: Column, description: Column) -> Column:
    return F.sha2(
        F.concat_ws(
            "|",
            text.slug(company),
            text.slug(title),
            text.slug(F.coalesce(location, F.lit(""))),
            keyword_hash(description),
        ),
        256,
    )


def normalize_jobs(
    raw: DataFrame,
    aliases: DataFrame,
    remote_rules=text.REMOTE_RULES,
    employment_rules=text.EMPLOYMENT_RULES,
) -> DataFrame:
    """One normalised job candidate per raw posting; a projection plus the alias lookup."""
    c = F.col
    described = (
        resolve_company(raw, aliases)
        .withColumn(
            "description_raw",
            F.coalesce(text.first_filled(c("description_html"), c("description_text")), F.lit("")),
        )
        .withColumn(
            "description_text",
            text.normalize_text(text.first_filled(c("description_text"), c("description_html"))),
        )
        .withColumn("description_hash", F.sha2(c("description_text"), 256))
    )
    return described.select(
        ids.job_id(
            c("company_id"),
            c("external_job_id"),
            F.concat_ws("|", c("canonical_name"), c("title"), c("description_hash")),
        ).alias("id"),
        "raw_id",
        "company_id",
        c("canonical_name").alias("company_name"),
        c("company_name").alias("raw_company_name"),
        c("external_job_id").alias("external_id"),
        "title",
        text.normalize_title(c("title")).alias("title_normalized"),
        "location_text",
        text.infer_remote_mode(c("location_text"), c("description_text"), remote_rules).alias("remote_mode"),
        text.infer_employment_type(c("employment_type"), c("description_text"), employment_rules).alias(
            "employment_type"
        ),
        "posted_at",
        "source_type",
        "source_url",
        "description_raw",
        "description_text",
        "description_hash",
        dedupe_fingerprint(
            c("canonical_name"), c("title"), c("location_text"), c("description_text")
        ).alias("dedupe_fingerprint"),
        F.lit("active").alias("status"),
        F.coalesce(c("json_payload"), F.lit("{}")).alias("raw_payload"),
        F.coalesce(c("metadata"), F.create_map().cast("map<string,string>")).alias("metadata"),
        c("fetched_at"),
    )


def upsert_last_wins(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    overwrite: Sequence[str] = (),
    keep_non_null: Sequence[str] = (),
    created: str | None = None,
    updated: str | None = None,
) -> DataFrame:
    """Fold keyed rows in ``order``: ``overwrite`` columns take the last value, even null;
    ``keep_non_null`` columns take the last value that is not null."""
    at = F.col(order)
    aggs = [F.max_by(F.struct(*overwrite), at).alias("_last")] if overwrite else []
    aggs += [
        F.max_by(name, F.when(F.col(name).isNotNull(), at)).alias(name) for name in keep_non_null
    ]
    if created:
        aggs.append(F.min(created).alias("created_at"))
    if updated:
        aggs.append(F.max(updated).alias("updated_at"))
    folded = df.groupBy(*keys).agg(*aggs)
    if not overwrite:
        return folded
    rest = [c for c in folded.columns if c not in (*keys, "_last")]
    return folded.select(*keys, "_last.*", *rest)


def upsert_companies(normalized: DataFrame, order: str = "raw_id") -> DataFrame:
    """Last name and aliases per company; an alias is the latest raw spelling that differs."""
    raw_name = F.col("raw_company_name")
    aliases = F.when(raw_name != F.col("company_name"), F.array(raw_name)).otherwise(
        F.array().cast("array<string>")
    )
    prepared = normalized.select(
        F.col("company_id").alias("id"),
        F.col("company_name").alias("name"),
        aliases.alias("aliases"),
        *[
            (F.col(c) if c in normalized.columns else F.lit(None).cast("string")).alias(c)
            for c in ("website", "industry")
        ],
        F.col(order),
    )
    return upsert_last_wins(prepared, ["id"], order, ["name", "aliases"], ["website", "industry"])


def _mixed_chains(narrow: DataFrame) -> DataFrame | None:
    """(dedupe_fingerprint, chain) of the postings that the two keys link in more than one way.

    Where all linked postings share one external id, or all share one fingerprint, they are
    one job whatever their order. Else some pair of keys has an external id with several
    fingerprints and a fingerprint with several external ids; only then order decides.
    """
    pairs = narrow.select("external", "dedupe_fingerprint").distinct()
    by_external = pairs.where("external is not null").groupBy("external").agg(F.count("*").alias("prints"))
    by_print = pairs.groupBy("dedupe_fingerprint").agg(F.count("*").alias("externals"))
    middle = (
        pairs.join(by_external.where("prints > 1"), "external")
        .join(by_print.where("externals > 1"), "dedupe_fingerprint")
        .select("dedupe_fingerprint")
        .distinct()
    )
    middle = cut_lineage(middle)
    if middle.isEmpty():
        return None
    edges = pairs.where("external is not null").select(
        F.concat(F.lit("e"), "external").alias("a"), F.concat(F.lit("f"), "dedupe_fingerprint").alias("b")
    )
    found = connected(edges).where(F.col("node").startswith("f"))
    prints = found.select(F.expr("substring(node, 2)").alias("dedupe_fingerprint"), F.col("root").alias("chain"))
    chains = prints.join(middle, "dedupe_fingerprint", "left_semi").select("chain").distinct()
    return cut_lineage(prints.join(chains, "chain", "left_semi"))


def _folded_chains(rows: DataFrame) -> DataFrame:
    """(id, first_ord, last_ord) of the jobs in mixed chains, by the rule for one posting after another.

    A posting belongs to the job that now has its external id, else to the first job that now
    has its fingerprint, else it is a new one; the job takes over both keys. Postings stream
    through in order, narrow rows only; what is kept of a chain is its jobs.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, jobs, by_external, by_print = None, [], {}, {}

        def done() -> Iterator[pa.RecordBatch]:
            if jobs:
                columns = zip(*((j[0], j[1], j[2]) for j in jobs))
                kinds = (pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["id", "first_ord", "last_ord"])

        for batch in batches:
            for row in batch.to_pylist():
                if row["chain"] != chain:
                    yield from done()
                    chain, jobs, by_external, by_print = row["chain"], [], {}, {}
                external, fingerprint = row["external"], row["dedupe_fingerprint"]
                at = by_external.get(external) if external is not None else None
                if at is None and by_print.get(fingerprint):
                    at = min(by_print[fingerprint])
                if at is None:
                    at = len(jobs)
                    jobs.append([row["id"], row["ord"], row["ord"], None, None])
                job = jobs[at]
                if job[3] is not None:
                    by_external.pop(job[3], None)
                if job[4] is not None:
                    by_print[job[4]].discard(at)
                job[2], job[3], job[4] = row["ord"], external, fingerprint
                if external is not None:
                    by_external[external] = at
                by_print.setdefault(fingerprint, set()).add(at)
        yield from done()

    dealt = rows.repartition("chain").sortWithinPartitions("chain", "ord")
    return dealt.mapInArrow(fold, "id string, first_ord long, last_ord long")


def upsert_jobs(normalized: DataFrame, order: str = "raw_id") -> DataFrame:
    """Merge re-posted jobs and keep the first id with the last attributes.

    A posting updates the job that has its (company, source, external id) at that time, else
    the one that has its fingerprint. Where the keys agree on who belongs together, that is a
    grouping by external id and then by fingerprint; only chains that mix the keys are walked
    in order. Ids that several jobs claim are merged last. Only narrow keys are aggregated;
    the wide row of the winner is fetched once at the end.
    """
    at = F.col(order)
    external = text.blank_to_null(F.col("external_id"))
    narrow = cut_lineage(normalized.select(
        F.when(external.isNotNull(), F.concat_ws("\u0001", "company_id", "source_type", external)).alias("external"),
        "dedupe_fingerprint", "id", at.cast("long").alias("ord"),
    ))
    mixed = _mixed_chains(narrow)
    chained = None
    if mixed is not None:
        # At most the keys of mixed chains.
        chained = _folded_chains(narrow.join(mixed, "dedupe_fingerprint"))
        narrow = narrow.join(mixed.select("dedupe_fingerprint"), "dedupe_fingerprint", "left_anti")
    by_external = (
        narrow.where(F.col("external").isNotNull())
        .groupBy("external")
        .agg(
            F.min_by("id", "ord").alias("id"),
            F.max_by("dedupe_fingerprint", "ord").alias("dedupe_fingerprint"),
            F.min("ord").alias("first_ord"),
            F.max("ord").alias("last_ord"),
        )
        .select("id", "dedupe_fingerprint", "first_ord", "last_ord")
    )
    without = narrow.where(F.col("external").isNull()).select(
        "id", "dedupe_fingerprint", F.col("ord").alias("first_ord"), F.col("ord").alias("last_ord")
    )
    by_fingerprint = (
        by_external.unionByName(without)
        .groupBy("dedupe_fingerprint")
        .agg(
            F.min_by("id", "first_ord").alias("id"),
            F.min("first_ord").alias("first_ord"),
            F.max("last_ord").alias("last_ord"),
        )
        .drop("dedupe_fingerprint")
    )
    if chained is not None:
        by_fingerprint = by_fingerprint.unionByName(chained)
    survivors = by_fingerprint.groupBy("id").agg(
        F.min("first_ord").alias("first_ord"),
        F.max("last_ord").alias("last_ord"),
        F.count("*").alias("id_claims"),
    )
    return normalized.drop("id").join(survivors, at == F.col("last_ord")).drop("last_ord")


def id_collisions(jobs: DataFrame) -> DataFrame:
    """Jobs whose id was claimed by more than one merged record (sources sharing an id)."""
    return jobs.where(F.col("id_claims") > 1).select("id", "id_claims")


def upsert_skills(matches: DataFrame, order: str = "ord") -> DataFrame:
    return upsert_last_wins(
        matches,
        ["skill_id"],
        order,
        ["label", "normalized_label", "aliases", "provenance"],
        ["parent_id", "category"],
    )


def upsert_job_skill_edges(matches: DataFrame, order: str = "ord") -> DataFrame:
    folded = upsert_last_wins(
        matches,
        ["job_id", "skill_id", "edge_type"],
        order,
        ["weight", "confidence", "provenance", "evidence"],
    )
    return folded.withColumn("id", ids.edge_id(F.col("job_id"), F.col("edge_type"), F.col("skill_id")))


def dedupe_by_url(records: DataFrame, url: str, order: str) -> tuple[DataFrame, DataFrame]:
    """First record per URL, and one row with emitted / skipped counts."""
    kept = first_per_key(records, [url], [F.col(order).asc()])
    counts = records.groupBy(url).agg(F.count("*").alias("n")).agg(
        F.count("*").alias("emitted"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("skipped"),
    )
    return kept, counts
