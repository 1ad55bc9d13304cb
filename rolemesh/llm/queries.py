"""Registered queries of this folder: one per operator, over its whole table, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    contamination,
    disclosure,
    fingerprints,
    hard_negatives,
    languages,
    licences,
    mixing,
    near_duplicates,
    revisits,
    secrets,
    toolcalls,
    wavelet,
    whitening,
)
from .store import bounded_batches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
ID_BITS = 16  # 49,408 ids
END_ID = 2


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bounded_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def held_out():
    """One fifth of the documents, on which language profiles are not trained."""
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


@query("op1_language_profiles")
def language_profiles(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    profiles = languages.train(docs.where(~held_out()))
    found = languages.identify(docs.select("doc_id", "text"), profiles)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@query("op3_benchmark_leaks")
def benchmark_leaks(spark, sf_dir):
    return contamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op4_source_mix")
def source_mix(spark, sf_dir):
    plan = mixing.plan_mix(table(spark, sf_dir, "documents"))
    return mixing.taken_words(*plan).select("doc_id", "size", "source_size", "target", "taken")


@query("op5_near_duplicates")
def near_duplicate_rows(spark, sf_dir):
    return near_duplicates.near_duplicate_classes(table(spark, sf_dir, "documents"), size=4, num=85, den=100)


@query("op8_wavelet_shards")
def wavelet_shards(spark, sf_dir):
    path = TOKENIZER
    shards = wavelet.write_shards(
        table(spark, sf_dir, "documents"), lambda: wavelet.word_encoder(path), END_ID, ID_BITS
    )
    return wavelet.read_shards(shards)


@query("op9_weighted_samples")
def weighted_samples(spark, sf_dir):
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


@query("op10_disclosure_spans")
def disclosure_spans(spark, sf_dir):
    found = disclosure.find_spans(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans"
    )


@query("op11_secret_formats")
def secret_formats(spark, sf_dir):
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "scores"
    )


@query("op12_whitened_embeddings")
def whitened_embeddings(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


NEGATIVE_SQL = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = len(embedding)
), s AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
           CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
    SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other) AS INTEGER) AS rank,
       s.other AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
 AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other) <= 5
"""


@query("op13_hard_negatives", NEGATIVE_SQL)
def hard_negative_rows(spark, sf_dir):
    """Every seventh label moves on by one first; rows whose id is divisible by 100 ask."""
    rows = table(spark, sf_dir, "embeddings").withColumn(
        "label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    )
    return hard_negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0)


# --- conversations as tool calls ------------------------------------------------

TOOLS = {
    name: [
        toolcalls.Parameter("query", "string"),
        toolcalls.Parameter("words", "integer", least=1, most=most),
        toolcalls.Parameter("after", "string", required=False, pattern="^call_[0-9]+$"),
    ]
    for name, most in (("ask", 40), ("read", 400))
}

TOOL_SQL = """
WITH RECURSIVE u AS (
    SELECT conv_id, turn, text, 'call_' || turn AS call_id,
           CASE WHEN contains(text, chr(10)) THEN 'read' ELSE 'ask' END AS tool,
           len(string_split(text, ' ')) AS words
    FROM conversations WHERE role = 'user'
), c AS (
    SELECT u.*, CASE WHEN length(u.text) < length(p.text) THEN p.call_id END AS after
    FROM u LEFT JOIN u p ON p.conv_id = u.conv_id AND p.turn = u.turn - 2
), lv AS (
    SELECT conv_id, call_id, 0 AS level FROM c WHERE after IS NULL
    UNION ALL
    SELECT c.conv_id, c.call_id, lv.level + 1 FROM c JOIN lv ON c.after = lv.call_id AND c.conv_id = lv.conv_id
), r AS (
    SELECT conv_id, turn, text, 'call_' || (turn - 1) AS call_id FROM conversations WHERE role = 'assistant'
)
SELECT c.conv_id, c.call_id, CAST(lv.level AS BIGINT) AS level, c.turn AS position,
       CASE WHEN r.call_id IS NULL THEN 'no result' ELSE 'linked' END AS state,
       CASE WHEN c.words > (CASE c.tool WHEN 'ask' THEN 40 ELSE 400 END) THEN 'range of words' ELSE '' END AS problems,
       '{"arguments":{' || CASE WHEN c.after IS NULL THEN '' ELSE '"after":"' || c.after || '",' END
           || '"query":' || CAST(to_json(c.text) AS VARCHAR) || ',"words":' || c.words || '},"id":"' || c.call_id
           || '","name":"' || c.tool || '","result":'
           || CASE WHEN r.call_id IS NULL THEN 'null' ELSE CAST(to_json(r.text) AS VARCHAR) END || '}' AS json
FROM c JOIN lv USING (conv_id, call_id) LEFT JOIN r USING (conv_id, call_id)
UNION ALL
SELECT r.conv_id, r.call_id, 0, r.turn, 'no call', '',
       '{"id":"' || r.call_id || '","result":' || CAST(to_json(r.text) AS VARCHAR) || '}'
FROM r WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.call_id = r.call_id AND u.conv_id = r.conv_id)
"""


@query("op2_tool_calls", TOOL_SQL)
def tool_calls(spark, sf_dir):
    """User turns as calls, the turns after them as results; a shorter turn refers to the one before.

    Identifiers are numbers of turns, so all conversations use the same ones.
    """
    turns = table(spark, sf_dir, "conversations")
    call_id = lambda turn: F.concat(F.lit("call_"), turn.cast("string"))
    user = turns.where("role = 'user'").select("conv_id", "turn", "text", call_id(F.col("turn")).alias("call_id"))
    before = user.select("conv_id", (F.col("turn") + 2).alias("turn"), F.length("text").alias("n"), F.col("call_id").alias("previous"))
    asked = user.join(before, ["conv_id", "turn"], "left").withColumn(
        "after", F.when(F.length("text") < F.col("n"), F.col("previous"))
    )
    words = F.size(F.split("text", " "))
    arguments = F.to_json(F.struct(F.col("text").alias("query"), words.alias("words"), "after"))
    calls = asked.select(
        "conv_id", "call_id", F.col("turn").alias("position"),
        F.when(F.col("text").contains("\n"), "read").otherwise("ask").alias("tool"), arguments.alias("arguments"),
    )
    answered = turns.where("role = 'assistant'").select(
        "conv_id", call_id(F.col("turn") - 1).alias("call_id"), F.col("turn").alias("position"), F.col("text").alias("content")
    )
    references = asked.where("after is not null").select("conv_id", "call_id", F.col("after").alias("needs"))
    return toolcalls.link_tool_calls(calls, answered, references, TOOLS)


# --- pages as captures of an archive ----------------------------------------------

REVISIT_DELAY = 1_000
HISTORY_PIECE = 500

REVISIT_SQL = f"""
WITH p AS (
    SELECT page_id, md5(html) AS tag, length(html) AS n,
           regexp_replace(trim(url), '#.*$', '') AS plain
    FROM pages
), q AS (
    SELECT *, regexp_replace(split_part(plain, '?', 1), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS base,
           list_sort(list_filter(string_split(CASE WHEN contains(plain, '?') THEN regexp_replace(plain, '^[^?]*[?]', '') ELSE '' END, '&'),
                     lambda x: x <> '' AND NOT regexp_matches(x, '{revisits.TRACKING}'))) AS kept
    FROM p
), k AS (
    SELECT page_id, tag, n,
           regexp_replace(lower(split_part(base, '/', 1)), ':(80|443)$', '')
           || regexp_replace(regexp_replace(base, '^[^/]*', ''), '/+$', '')
           || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS url_key
    FROM q
), v AS (
    SELECT 'v' || page_id AS record_id, url_key, page_id + {REVISIT_DELAY} AS ts, tag, page_id FROM k
), a AS (
    SELECT v.*, r.page_id AS rid, r.tag AS rtag, r.n AS rn
    FROM v LEFT JOIN k r ON r.url_key = v.url_key AND r.page_id < v.ts
    QUALIFY row_number() OVER (PARTITION BY v.record_id ORDER BY r.page_id DESC NULLS LAST) = 1
), o AS (
    SELECT *, CASE WHEN substr(tag, 1, 1) < '4' THEN reverse(tag) WHEN substr(tag, 1, 1) = '4' THEN NULL ELSE tag END AS vtag
    FROM a
), s AS (
    SELECT *, CASE WHEN vtag IS NULL THEN 'unverified' WHEN vtag = rtag THEN 'resolved' ELSE 'mismatch' END AS outcome FROM o
)
SELECT record_id, url_key, CAST(ts AS BIGINT) AS ts, 'r' || rid AS response_id, CAST(rid AS BIGINT) AS response_ts, outcome,
       CASE WHEN outcome <> 'mismatch' THEN
           'cache-control: max-age=' || page_id || chr(10) || 'content-length: ' || rn || chr(10) || 'content-type: text/html'
           || chr(10) || 'etag: "' || coalesce(vtag, rtag) || '"' || chr(10) || 'server: s' || rid % 7 END AS headers
FROM s
"""


@query("op6_revisits", REVISIT_SQL)
def revisit_records(spark, sf_dir):
    """Every page as a response at the time page_id, and a not-modified capture of its URL later."""
    pages = table(spark, sf_dir, "pages").withColumn("tag", F.md5("html"))
    number = F.col("page_id").cast("string")

    def headers(**values):
        given = F.map_from_arrays(
            F.array(*(F.lit(k.replace("_", "-")) for k in values)), F.array(*(v.cast("string") for v in values.values()))
        )
        return F.map_filter(given, lambda k, v: v.isNotNull()).alias("headers")

    quoted = lambda tag: F.concat(F.lit('"'), tag, F.lit('"'))
    full = pages.select(
        F.concat(F.lit("r"), number).alias("record_id"), "url", F.col("page_id").alias("ts"), F.lit(200).alias("status"),
        headers(content_type=F.lit("text/html"), content_length=F.length("html"), etag=quoted(F.col("tag")),
                server=F.concat(F.lit("s"), (F.col("page_id") % 7).cast("string"))),
    )
    first = F.substring("tag", 1, 1)
    shown = F.when(first < "4", F.reverse("tag")).when(first != "4", F.col("tag"))
    again = pages.select(
        F.concat(F.lit("v"), number).alias("record_id"), "url", (F.col("page_id") + REVISIT_DELAY).alias("ts"), F.lit(304).alias("status"),
        headers(cache_control=F.concat(F.lit("max-age="), number), content_length=F.lit(0), etag=quoted(shown)),
    )
    found = revisits.resolve_revisits(full.unionByName(again), HISTORY_PIECE)
    return found.withColumn("headers", revisits.header_text(F.col("headers")))


# --- documents as files of a tree -------------------------------------------------

_SCAN = licences.Templates(licences.TEMPLATES, licences.THRESHOLD)


def _licence_sql() -> str:
    weights = ", ".join(
        f"({i}, '{t}', {w!r}::DOUBLE, {_SCAN.idf[t]!r}::DOUBLE)" for i, own in enumerate(_SCAN.weights) for t, w in own.items()
    )
    common = ", ".join(f"'{t}'" for t in sorted(licences.COMMON))
    places = ", ".join(f"({i}, '{t}', {at}, {len(_SCAN.terms[i])})" for i, own in enumerate(_SCAN.places) for t, at in own)
    names = ", ".join(f"({i}, '{n}')" for i, n in enumerate(_SCAN.names))
    return f"""
WITH weights(template, term, w, idf) AS (VALUES {weights}),
places(template, term, place, size) AS (VALUES {places}), names(template, licence) AS (VALUES {names}),
f AS (
    SELECT doc_id, text, source || '/' || lang || '/' || CASE WHEN doc_id % 32 = 0 THEN '' ELSE 'part' || doc_id % 7 || '/' END
           || CASE WHEN doc_id % 8 = 0 THEN 'LICENSE' ELSE doc_id || '.txt' END AS path
    FROM documents
), a AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+'), lambda t: t <> '') AS words
    FROM f
), tok AS (
    SELECT doc_id, unnest(words) AS term, unnest(range(len(words))) AS at FROM a
), win AS (
    SELECT DISTINCT tok.doc_id, places.template, places.size, greatest(tok.at - places.place, 0) AS start FROM tok JOIN places USING (term)
), tf AS (
    SELECT win.doc_id, win.template, win.start, tok.term, count(*) AS n
    FROM win JOIN tok ON tok.doc_id = win.doc_id AND tok.at BETWEEN win.start AND win.start + win.size - 1 GROUP BY ALL
), cosine AS (
    SELECT doc_id, template, start, round(sum(w * own) / sqrt(sum(w * w)), 6) AS score FROM (
      SELECT tf.doc_id, tf.template, tf.start, coalesce(weights.w, 0) AS own,
             n * coalesce(weights.idf, CASE WHEN tf.term IN ({common}) OR regexp_matches(tf.term, '{licences.SHORT_NUMBER}') THEN 1.0::DOUBLE ELSE {_SCAN.rare!r}::DOUBLE END) AS w
      FROM tf LEFT JOIN weights ON weights.template = tf.template AND weights.term = tf.term) GROUP BY ALL
), best AS (
    SELECT doc_id, licence, score, start FROM cosine JOIN names USING (template) WHERE score >= {_SCAN.threshold}
    QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, template, start) = 1
), own AS (
    SELECT f.doc_id, f.path, regexp_replace(f.path, '/?[^/]*$', '') AS dir, b.licence, b.score, b.start FROM f LEFT JOIN best b USING (doc_id)
), held AS (
    SELECT dir AS top, licence, path FROM own WHERE licence IS NOT NULL AND path LIKE '%/LICENSE'
    QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, path, licence) = 1
), near AS (
    SELECT DISTINCT o.dir, h.licence, h.path, length(h.top) AS depth
    FROM (SELECT DISTINCT dir FROM own) o JOIN held h ON o.dir = h.top OR starts_with(o.dir, h.top || '/')
    QUALIFY row_number() OVER (PARTITION BY o.dir ORDER BY length(h.top) DESC) = 1
)
SELECT own.doc_id, own.path, coalesce(own.licence, near.licence) AS licence, own.score, CAST(own.start AS BIGINT) AS position,
       CASE WHEN own.licence IS NOT NULL THEN 'own' WHEN near.licence IS NOT NULL THEN 'inherited' ELSE 'none' END AS basis,
       CASE WHEN own.licence IS NULL THEN near.path END AS licence_path
FROM own LEFT JOIN near ON near.dir = own.dir AND own.licence IS NULL
"""


@query("op7_licences", _licence_sql())
def licence_scan(spark, sf_dir):
    """Documents as files source/lang[/part]/name; every eighth is called LICENSE."""
    docs = table(spark, sf_dir, "documents")
    number = F.col("doc_id").cast("string")
    part = F.when(F.col("doc_id") % 32 == 0, "").otherwise(F.concat(F.lit("part"), (F.col("doc_id") % 7).cast("string"), F.lit("/")))
    name = F.when(F.col("doc_id") % 8 == 0, "LICENSE").otherwise(F.concat(number, F.lit(".txt")))
    files = docs.select("doc_id", F.concat("source", F.lit("/"), "lang", F.lit("/"), part, name).alias("path"), "text")
    return licences.scan_licences(files)
