"""Dictionary enrichment: skills, evidence and attributes read from posting text.

Sentences, tokens, candidate skills, evidence and attributes are array expressions inside
one row, so the text itself is never shuffled. A skill is looked at only when one of its
words occurs among the tokens of the text.
"""

from __future__ import annotations

import json
import re
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids, text
from ..schemas import ENRICHMENT, SKILL_MATCH
from ..session import cut_lineage
from .dedupe import upsert_job_skill_edges, upsert_last_wins, upsert_skills
from .ranking import first_per_key
from .vocabulary import BULLET_MARKS, CJK, SENTENCE_END, Rules, Skill, taxonomy_hash

# Weights, confidences and list lengths of the heuristic.
PREFERS, REQUIRES = "PREFERS", "REQUIRES"
PREFERRED_WEIGHT, REQUIRED_WEIGHT = 0.6, 1.0
PREFERRED_CONFIDENCE, CONFIRMED_CONFIDENCE, PLAIN_CONFIDENCE = 0.6, 0.75, 0.7
WITH_SKILLS, WITHOUT_SKILLS = 0.55, 0.35
EVIDENCE_PER_SKILL, EVIDENCE_PER_JOB = 5, 20
HEURISTIC = "heuristic"
PROVENANCE = "heuristic+taxonomy"

_ENTRY = (
    "struct<pos:int,skill_id:string,label:string,normalized_label:string,"
    "aliases:array<string>,parent_id:string,category:string,keys:array<string>,"
    "words:array<string>,phrases:string,cjk:array<string>,label_pattern:string>"
)


def _quoted(term: str) -> str:
    return r"\b\Q" + term + r"\E\b"


def _entry(pos: int, skill: Skill) -> tuple:
    """What matching one skill needs: single words, patterns for the rest, CJK substrings."""
    terms = [t.lower() for t in (skill.normalized_label, *skill.aliases) if t]
    cjk = [t for t in terms if re.search(CJK, t)]
    bounded = [t for t in terms if t not in cjk]
    words = [t for t in bounded if re.fullmatch(r"\w+", t)]
    phrases = [t for t in bounded if t not in words]
    # Any word of a phrase must stand as a whole token where the phrase matches.
    keys = sorted({(re.findall(r"\w+", t) or [""])[0] for t in bounded})
    label = skill.normalized_label.lower()
    return (
        pos,
        skill.skill_id,
        skill.label,
        skill.normalized_label,
        list(skill.aliases),
        skill.parent_id,
        skill.category,
        keys,
        words,
        "(?iU)" + "|".join(_quoted(t) for t in phrases) if phrases else None,
        cjk,
        None if label in cjk or label in words else "(?iU)" + _quoted(label),
    )


def split_sentences(c: Column) -> Column:
    """Split after ``.!?`` plus white space and right after CJK terminators."""
    return F.filter(F.split(c, SENTENCE_END, -1), lambda s: s != "")


def contains_term(c: Column, term: str) -> Column:
    """CJK terms match as substrings, others between word boundaries, ignoring case."""
    term = term.lower()
    if not term:
        return F.lit(False)
    if re.search(CJK, term):
        return F.contains(F.lower(c), F.lit(term))
    return c.rlike("(?iU)" + _quoted(term))


def sentence_tokens(sentences: Column) -> Column:
    """array of (sentence, text, lower, tokens); ``text`` is the stripped sentence."""

    def describe(s: Column) -> Column:
        stripped, lowered = text.strip(s), F.lower(s)
        return F.struct(
            s.alias("sentence"),
            stripped.alias("text"),
            lowered.alias("lower"),
            F.regexp_extract_all(lowered, F.lit(r"(?U)\w+"), F.lit(0)).alias("tokens"),
        )

    return F.transform(sentences, describe)


def _match(entry: Column, sentences: Column, description: Column, tokens: Column, rules: Rules) -> Column:
    """Evidence, edge type and confidence of one candidate skill; no evidence -> null."""
    evidence = F.filter(
        sentences,
        lambda s: F.arrays_overlap(s["tokens"], entry["words"])
        | F.coalesce(F.rlike(s["lower"], entry["phrases"]), F.lit(False))
        | F.exists(entry["cjk"], lambda t: F.contains(s["lower"], t)),
    )
    label = F.lower(entry["normalized_label"])
    label_in_text = (
        F.when(entry["label_pattern"].isNotNull(), F.rlike(description, entry["label_pattern"]))
        .when(F.array_contains(entry["cjk"], label), F.contains(F.lower(description), label))
        .otherwise(F.array_contains(tokens, label))
    )

    def classify(found: Column) -> Column:
        # Sentences end with their terminator, so no cue can span two of them.
        preferred = F.exists(found, lambda s: rules.sections["preferred"].found(s["lower"]))
        confirmed = label_in_text | F.exists(
            found, lambda s: rules.sections["required"].found(s["lower"])
        )
        kind = (
            F.when(preferred, F.struct(F.lit(PREFERS), F.lit(PREFERRED_WEIGHT), F.lit(PREFERRED_CONFIDENCE)))
            .when(confirmed, F.struct(F.lit(REQUIRES), F.lit(REQUIRED_WEIGHT), F.lit(CONFIRMED_CONFIDENCE)))
            .otherwise(F.struct(F.lit(REQUIRES), F.lit(REQUIRED_WEIGHT), F.lit(PLAIN_CONFIDENCE)))
        ).cast("struct<edge_type:string,weight:double,confidence:double>")
        return text.let(
            kind,
            lambda k: F.struct(
                entry["skill_id"],
                entry["label"],
                entry["normalized_label"],
                entry["aliases"],
                entry["parent_id"],
                entry["category"],
                k["edge_type"],
                k["weight"],
                k["confidence"],
                F.slice(F.transform(found, lambda s: s["text"]), 1, EVIDENCE_PER_SKILL),
                F.lit(PROVENANCE),
            ).cast(SKILL_MATCH),
        )

    return text.let(evidence, lambda found: F.when(F.size(found) > 0, classify(found)))


def _constant(value, kind: str) -> Column:
    """A driver-side value as one constant of the plan."""
    return F.from_json(F.lit(json.dumps(value, ensure_ascii=False)), kind)


def _lookup(places: dict[str, list[int]], words: Column) -> Column:
    """Positions listed for any of ``words``, each word looked up in a hash table of its own making.

    The table travels as constants: buckets by the word's CRC, about one word in each. A
    look-up costs the same however many words the table has.
    """
    size = 1
    while size < 2 * len(places):
        size *= 2
    buckets: list[list[dict]] = [[] for _ in range(size)]
    for word, at in sorted(places.items()):
        buckets[zlib.crc32(word.encode()) % size].append({"word": word, "at": at})
    table = _constant(buckets, "array<array<struct<word:string,at:array<int>>>>")

    def find(word: Column) -> Column:
        bucket = F.get(table, F.pmod(F.crc32(word), F.lit(size)).cast("int"))
        return F.flatten(F.transform(F.filter(bucket, lambda e: e["word"] == word), lambda e: e["at"]))

    return F.flatten(F.transform(words, find))


def _heads(chars: Column) -> Column:
    """Every letter of a text, and every pair of neighbouring ones, each once."""
    pairs = F.transform(
        F.slice(chars, F.lit(1), F.greatest(F.size(chars) - 1, F.lit(0))), lambda c, i: F.concat(c, F.get(chars, i + 1))
    )
    return F.array_distinct(F.concat(chars, pairs))


def _candidates(df: DataFrame, entries: list[tuple]) -> DataFrame:
    """Adds ``_entries``: what can match a text, in taxonomy order.

    The taxonomy travels as constants. A text's distinct words are looked up one by one, so a
    text meets only entries that share a word with it. CJK terms are found by their first two
    letters, where the text has CJK letters at all, and then tested as substrings.
    """
    places: dict[str, list[int]] = {}
    for entry in entries:
        for word in entry[7]:
            if word:
                places.setdefault(word, []).append(entry[0])
    names = re.findall(r"(\w+):", re.sub("<string>", "", _ENTRY))
    table = _constant([dict(zip(names, e)) for e in entries], f"array<{_ENTRY}>")
    always = _constant([e[0] for e in entries if "" in e[7]], "array<int>")
    worded = _lookup(places, F.col("_tokens"))
    terms = [(t, e[0]) for e in entries for t in e[10]]
    cjk = F.array().cast("array<int>")
    if terms:
        heads: dict[str, list[int]] = {}
        for i, (term, _) in enumerate(terms):
            heads.setdefault(term[:2], []).append(i)
        listed = _constant([{"term": t, "pos": p} for t, p in terms], "array<struct<term:string,pos:int>>")

        def inside(low: Column) -> Column:
            begun = F.array_distinct(_lookup(heads, text.let(F.split(low, ""), _heads)))
            found = F.filter(F.transform(begun, lambda i: F.get(listed, i)), lambda t: F.contains(low, t["term"]))
            return F.transform(found, lambda t: t["pos"])

        has_cjk = F.col("description_text").rlike(CJK)
        cjk = F.when(has_cjk, text.let(F.lower("description_text"), inside)).otherwise(cjk)
    positions = F.array_sort(F.array_distinct(F.concat(worded, cjk, always)))
    return df.withColumn("_entries", F.transform(positions, lambda at: F.get(table, at)))


def _bullets(described: Column, cue: text.Cue) -> Column:
    """Four sentences after the section cue, or the first three when there is no cue."""
    marks = F.transform(described, lambda s: cue.found(s["lower"]))
    window = text.let(
        F.array_position(marks, F.lit(True)).cast("int"),
        lambda at: F.when(at > 0, F.slice(described, at + 1, F.lit(4))).otherwise(
            F.slice(described, 1, 3)
        ),
    )
    kept = F.filter(window, lambda s: s["text"] != "")
    return F.transform(kept, lambda s: F.btrim(s["sentence"], F.lit(BULLET_MARKS)))


def describe_text(described: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Attributes read by ordered cues: family, level, salary, summary, section bullets.

    Needs ``title``, ``description_text`` and ``_described`` (:func:`sentence_tokens`).
    """
    corpus = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.col("description_text"))
    sentences = F.col("_described")
    salary = F.when(
        F.col("description_text").rlike(r"\p{Nd}{2}"),
        text.blank_to_null(F.regexp_extract("description_text", "(?iU)" + rules.salary, 0)),
    )
    spoken = F.filter(F.transform(sentences, lambda s: s["text"]), lambda s: s != "")
    return described.withColumns(
        {
            "role_family": text.first_rule(corpus, rules.role_families),
            "seniority": text.first_rule(corpus, rules.seniority),
            "salary_text": salary,
            "summary": F.array_join(F.slice(spoken, 1, 2), " "),
            "responsibilities": _bullets(sentences, rules.sections["responsibilities"]),
            "qualifications": _bullets(sentences, rules.sections["qualifications"]),
        }
    )


def enrich(
    jobs: DataFrame,
    taxonomy: list[Skill],
    rules: Rules = Rules(),
    key: str = "id",
) -> DataFrame:
    """Jobs (key, title, description_text, remote_mode) -> enrichment rows, one per job."""
    entries = [_entry(i, s) for i, s in enumerate(taxonomy)]
    base = jobs.select(
        key, "title", F.coalesce("description_text", F.lit("")).alias("description_text"), "remote_mode"
    )
    tokenised = base.withColumn(
        "_described", sentence_tokens(split_sentences(F.col("description_text")))
    ).withColumn(
        "_tokens", F.array_distinct(F.flatten(F.col("_described.tokens")))
    )
    candidates = _candidates(tokenised, entries)
    matched = F.filter(
        F.transform(
            F.col("_entries"),
            lambda e: _match(e, F.col("_described"), F.col("description_text"), F.col("_tokens"), rules),
        ),
        lambda m: m.isNotNull(),
    )
    if len({s.skill_id for s in taxonomy}) < len(taxonomy):
        matched = _first_of_each_kind(matched)
    with_skills = describe_text(candidates.withColumn("skills", matched), rules)
    return with_skills.select(
        F.col(key).alias("job_id"),
        "summary",
        "role_family",
        "seniority",
        F.col("remote_mode").alias("remote_mode_inferred"),
        "salary_text",
        "responsibilities",
        "qualifications",
        F.slice(
            F.array_distinct(F.flatten(F.transform("skills", lambda s: s["evidence"]))),
            1,
            EVIDENCE_PER_JOB,
        ).alias("evidence"),
        F.when(F.size("skills") > 0, WITH_SKILLS).otherwise(WITHOUT_SKILLS).alias("confidence"),
        F.lit(HEURISTIC).alias("model_name"),
        F.lit("n/a").alias("prompt_version"),
        "skills",
    )


def _first_of_each_kind(matches: Column) -> Column:
    """Keep the first match per (skill id, edge type)."""

    def kind(m: Column) -> Column:
        return F.concat_ws("|", m["edge_type"], m["skill_id"])

    def dedupe(all_matches: Column) -> Column:
        kinds = F.transform(all_matches, kind)
        return F.filter(all_matches, lambda m, i: F.array_position(kinds, kind(m)) == i + 1)

    return text.let(matches, dedupe)


def skill_matches(results: DataFrame) -> DataFrame:
    """One row per (job, skill match), with its position; unusable matches are left out."""
    # The outer form keeps Spark from testing the array first, which would compute it twice.
    exploded = results.select("job_id", F.posexplode_outer("skills").alias("pos", "skill"))
    return exploded.select("job_id", "pos", "skill.*").where(
        (F.coalesce("skill_id", F.lit("")) != "") & (F.coalesce("label", F.lit("")) != "")
    )


def invalid_results(results: DataFrame) -> DataFrame:
    """Results that must not be stored, each with its reason."""
    reason = (
        F.when(F.coalesce("job_id", F.lit("")) == "", "result must include job_id")
        .when(F.col("evidence").isNull(), "evidence must be a list")
        .when(F.col("skills").isNull(), "skills must be a list")
    )
    return results.select("job_id", reason.alias("reason")).where(F.col("reason").isNotNull())


def pending_jobs(jobs: DataFrame, enrichment: DataFrame | None, limit: int | None = None, force=False) -> DataFrame:
    """Jobs without a stored enrichment; ``limit`` takes the first by id."""
    todo = jobs
    if enrichment is not None and not force:
        todo = jobs.join(enrichment.select(F.col("job_id").alias("id")), "id", "left_anti")
    return todo if limit is None else todo.orderBy("id").limit(limit)


def cached_enrichment(
    jobs: DataFrame,
    cache: DataFrame,
    taxonomy: list[Skill],
    provider=None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Results for ``jobs``, the new cache rows, and hit / miss counts.

    Each distinct text is computed once, for its first job by id; copies share the result.
    Jobs without a hash skip the cache. Unreadable cache rows count as misses.
    """
    from .providers import HeuristicProvider, provider_signature

    provider = provider or HeuristicProvider()
    signature, digest = provider_signature(provider), taxonomy_hash(taxonomy)
    has_hash = F.coalesce("description_hash", F.lit("")) != ""
    # Read by every step below: what prepares and hashes the texts runs once.
    keyed = cut_lineage(
        jobs.withColumn("cache_key", F.when(has_hash, ids.cache_key(F.col("description_hash"), signature, digest)))
    )
    # Only rows that some job asks for are parsed.
    asked = cache.join(keyed.select("cache_key").distinct(), "cache_key", "left_semi")
    readable = asked.select(
        "cache_key", F.from_json("result_json", ENRICHMENT, {"mode": "PERMISSIVE"}).alias("cached")
    ).where(F.col("cached.job_id").isNotNull())
    looked_up = keyed.join(readable, "cache_key", "left")
    misses = looked_up.where(F.col("cached").isNull()).drop("cached")
    to_compute = first_per_key(
        misses.where(F.col("cache_key").isNotNull()), ["cache_key"], [F.col("id").asc()]
    ).unionByName(misses.where(F.col("cache_key").isNull()))
    computed = provider.enrich(to_compute.drop("cache_key"), taxonomy).join(
        to_compute.select(F.col("id").alias("job_id"), "cache_key", "description_hash"), "job_id"
    )
    # Needed for the cache, for copies and for jobs without a key, so it is stored once.
    computed = cut_lineage(computed)
    result_columns = ENRICHMENT.fieldNames()
    fresh = computed.where(F.col("cache_key").isNotNull()).select(
        "cache_key",
        "description_hash",
        F.lit(provider.name).alias("provider_name"),
        F.lit(signature).alias("provider_signature"),
        F.lit(digest).alias("taxonomy_hash"),
        F.to_json(F.struct(*result_columns)).alias("result_json"),
    )
    shared = computed.where(F.col("cache_key").isNotNull()).select(
        "cache_key", F.struct(*result_columns).alias("result")
    )
    answered = (
        looked_up.where(F.col("cached").isNotNull())
        .select("id", F.col("cached").cast(ENRICHMENT).alias("result"))
        .unionByName(
            misses.select("id", "cache_key")
            .join(shared, "cache_key")
            .select("id", F.col("result").cast(ENRICHMENT).alias("result"))
        )
        .select(F.col("id").alias("job_id"), *[F.col("result")[c].alias(c) for c in result_columns[1:]])
        .unionByName(computed.where(F.col("cache_key").isNull()).select(*result_columns))
    )
    missed = F.col("cached").isNull()
    counts = looked_up.agg(
        F.count("*").alias("jobs_processed"),
        F.count_distinct(F.when(missed, F.col("cache_key"))).alias("cache_writes"),
        F.count_if(missed & F.col("cache_key").isNull()).alias("unkeyed"),
    ).select(
        "jobs_processed",
        # A copy of a text that was computed earlier in the same run is a hit, too.
        (F.col("jobs_processed") - F.col("cache_writes") - F.col("unkeyed")).alias("cache_hits"),
        (F.col("cache_writes") + F.col("unkeyed")).alias("cache_misses"),
        "cache_writes",
    )
    return answered, fresh, counts


def jobs_with_enrichment(jobs: DataFrame, enrichment: DataFrame, companies: DataFrame) -> DataFrame:
    """Every job with its enrichment row (struct ``enrichment``) and company name, both null where missing."""
    rows = enrichment.select(
        F.col("job_id").alias("id"), F.struct(*(c for c in enrichment.columns if c != "job_id")).alias("enrichment")
    )
    names = companies.select(F.col("id").alias("company_id"), F.col("name").alias("company_name"))
    return jobs.drop("company_name").join(rows, "id", "left").join(names, "company_id", "left")


def run_counters(counts: DataFrame, written: dict[str, int]) -> DataFrame:
    """The counters of an enrichment run: cache hits and misses, and what the writes counted."""
    return counts.select(
        "*",
        F.lit(written["skills"]).cast("long").alias("skills_written"),
        F.lit(written["job_skill_edges"]).cast("long").alias("edges_written"),
    )


def upsert_enrichment(results: DataFrame, order: str, written_at: str) -> DataFrame:
    """One enrichment row per job: the last result by ``order`` with all its values, even null;
    created_at is the first ``written_at`` of the job and updated_at the last."""
    values = [c for c in results.columns if c not in ("job_id", "skills", order, written_at)]
    return upsert_last_wins(results, ["job_id"], order, values, created=written_at, updated=written_at)


def store_results(results: DataFrame) -> dict[str, DataFrame]:
    """Enrichment rows, skills and job-skill edges to upsert from a batch of results.

    Order within the batch is (job id, position of the match), which fixes who is last.
    A batch holds one result per job; :func:`upsert_enrichment` folds several.
    """
    good = results.where((F.coalesce("job_id", F.lit("")) != "") & F.col("skills").isNotNull())
    matches = skill_matches(good).withColumn("ord", F.struct("job_id", "pos"))
    return {
        "enrichment": good.drop("skills"),
        "skills": upsert_skills(matches),
        "edges": upsert_job_skill_edges(matches),
    }
