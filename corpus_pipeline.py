"""The training-data pipeline: documents in, token ids of the mix out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolemesh.llm import contamination, languages, mixing, near_duplicates, wavelet
from rolemesh.llm.queries import END_ID, ID_BITS, TOKENIZER, held_out
from rolemesh.llm.store import bounded_batches, fresh_name, stored


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a key of each row, never null, in order of (doc_id, text hash), null ids last; and its name.

    Only rows that are equal in all columns share a key: a doc_id may be null or repeated.
    """
    no_id = F.col("doc_id").isNull()
    doc_id = F.coalesce("doc_id", F.lit(0).cast(docs.schema["doc_id"].dataType))
    text_hash = F.xxhash64("text")
    # xxhash64 skips nulls, so each column is hashed with a mark for them.
    row_hash = F.xxhash64(*(x for c in sorted(docs.columns) for x in (F.col(c).isNull(), F.col(c))))
    fields = {"no_id": no_id, "doc_id": doc_id, "text_hash": text_hash, "row_hash": row_hash}
    key = fresh_name("row_key", docs.columns)
    return docs.withColumn(key, F.struct(*(v.alias(k) for k, v in fields.items()))), key


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; null texts and texts without a letter go."""
    bounded_batches(spark)
    profiles = languages.train(docs.where(~held_out()).select("text", "lang"))
    # The operator's own columns replace the caller's, which therefore go by other names meanwhile.
    aside = {c: fresh_name(f"kept_{c}", docs.columns) for c in docs.columns if c.lower() in ("lang_pred", "score")}
    found = languages.identify(docs.withColumnsRenamed(aside), profiles, keep_text=True)
    kept = found.where(F.col("lang_pred") != languages.UNKNOWN)
    return kept.select(*(F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (word 5-grams, Jaccard 0.8): the smallest (doc_id, text hash).

    A row with an id goes before one without. Rows are told apart by all their columns, so
    different texts with one doc_id, or without any, are documents of their own; rows equal
    in all columns stay once.
    """
    bounded_batches(spark)
    rows, key = keyed(docs)
    classes = near_duplicates.near_duplicate_classes(rows.select(F.col(key).alias("doc_id"), "text"))
    gone = classes.where("doc_id <> component_id").select(F.col("doc_id").alias(key)).distinct()
    return rows.join(gone, key, "left_anti").dropDuplicates([key]).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a verified passage of the benchmark."""
    bounded_batches(spark)
    rows, key = keyed(docs)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    leaks = contamination.find_leaks(rows.select(F.col(key).alias("doc_id"), "text"), benchmark)
    leaked = stored(leaks.select(F.col("doc_id").alias(key)).distinct(), "leaks")
    return rows.join(leaked, key, "left_anti").select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as the mix takes them: pieces that are left out go, repeats follow again."""
    bounded_batches(spark)
    return mixing.mixed_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Wavelet-matrix files of the token ids, read back: doc_id, start, n_tokens, ids_crc32."""
    bounded_batches(spark)
    path = TOKENIZER
    return wavelet.read_shards(wavelet.write_shards(docs, lambda: wavelet.word_encoder(path), END_ID, ID_BITS))


STAGES = [
    ("language ID", language_id),
    ("near duplicates", near_duplicates_stage),
    ("decontamination", decontamination),
    ("source mix", source_mix),
    ("token output", token_output),
]

#: SQL has no language profiles, n-gram trees or tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
