"""Personal data and what gives it away.

Four kinds of personal data are found by their form. Each value and the group it belongs to
(mail host, network, card issuer, dialling prefix) are entities to protect, and the corpus
tells how strongly a word anywhere in the same text reveals it: the pointwise mutual
information of word and entity, as a share of the entity's own information content. A word
that carries nearly all of it is removed, one that carries much of it is generalised,
wherever it stands in a text that holds the entity.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bits import bit_filter, passes
from .store import fresh_name, stored
from .words import NOT_WORD, hash_words, slices

KINDS = ("email", "ip", "card", "phone")
ADDED = ("generalised", "removed")
SUPPORT = 3  # different texts that hold both the word and the entity
PAIRS_AT_ONCE = 1 << 18  # rows of found words in a batch
TERMS_AT_ONCE = 1 << 20  # terms that a task counts before it hands them on
GENERALISE, REMOVE = 0.6, 0.9  # shares of an entity's information

# The forms of the four kinds. Possessive where giving back cannot help.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of local@domain, leftmost first: the run in front of an @, then the domain after it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text, start - 1):
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
            at = text.find("@", done)
        else:
            done = at + 1
            at = text.find("@", at + 1)


def luhn(digits: str) -> bool:
    """Whether a digit string passes the Luhn test."""
    total = 0
    for i, ch in enumerate(reversed(digits)):
        n = int(ch) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _only_digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, entity) by kind, then start; offsets in code points, end exclusive."""
    out = []
    if "@" in text:
        out += [("email", a, b, "email:" + text[a:b].lower()) for a, b in _emails(text)]
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m.group().split(".")]
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in parts):
            out.append(("ip", *m.span(), "ip:" + m.group()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _only_digits(m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span(), "card:" + digits))
    if "+" in text:
        for m in _PHONE.finditer(text):
            digits = _only_digits(m.group())
            if 8 <= len(digits) <= 15:
                out.append(("phone", *m.span(), "phone:" + digits))
    return out


def entities_of(value: str) -> tuple[str, str]:
    """A value and its group: what stands behind the @, three parts of an address, leading digits."""
    kind, text = value.split(":", 1)
    if kind == "email":
        group = text.rsplit("@", 1)[1]
    elif kind == "ip":
        group = text.rsplit(".", 1)[0]
    else:
        group = text[: 6 if kind == "card" else 4]
    return value, f"{kind} of {group}"


def free_words(text: str, spans: list[tuple[str, int, int, str]]) -> str:
    """The text with blanks, as many as code points, for each value and the words it touches."""
    out, done = [], 0
    for a, b in sorted((a, b) for _, a, b, _ in spans):
        while a > done and _WORD.match(text, a - 1):
            a -= 1
        while b < len(text) and _WORD.match(text, b):
            b += 1
        if b > done:
            a = max(a, done)
            out += [text[done:a], " " * (b - a)]
            done = b
    return "".join(out) + text[done:]


def _hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    hashes, begins = hash_words(pc.utf8_lower(pa.array(texts, pa.large_string())), NOT_WORD)
    return hashes.view(np.int64), begins


ROW = (
    "row long, doc_id {id}, h long, n_email long, n_ip long, n_card long, n_phone long, base string, "
    "entities array<long>, free string"
)


def _scan(docs: DataFrame) -> DataFrame:
    """Base spans of every row and its entities; for rows with entities, the text without the values."""

    def name(entity: str) -> int:
        return xxhash.xxh64_intdigest(entity.encode(), 17) - (1 << 63)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in slices(batches, "text"):
            counts, base, entities, free = [], [], [], []
            for text in batch.column("text").to_pylist():
                spans = base_spans(text or "")
                counts.append([sum(s[0] == k for s in spans) for k in KINDS])
                base.append(",".join(f"{k}:{a}:{b}" for k, a, b, _ in spans))
                entities.append(sorted({name(e) for s in spans for e in entities_of(s[3])}))
                free.append(free_words(text, spans) if spans else None)
            rows = number + np.arange(batch.num_rows)
            number += batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows), batch.column("doc_id"), batch.column("h")]
                + [pa.array([c[i] for c in counts], pa.int64()) for i in range(4)]
                + [pa.array(base, pa.string()), pa.array(entities, pa.list_(pa.int64())), pa.array(free, pa.string())],
                names=["row", "doc_id", "h", "n_email", "n_ip", "n_card", "n_phone", "base", "entities", "free"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(run, ROW.format(id=kind))


def _vocabulary(docs: DataFrame) -> DataFrame:
    """(term, df): in how many rows of the whole corpus each word occurs.

    Every task sums over its own rows first, so it hands on its vocabulary once, or in parts
    of TERMS_AT_ONCE words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in slices(batches, "text"):
            hashes, begins = hash_words(pc.utf8_lower(batch.column("text").cast(pa.large_string())), NOT_WORD)
            hashes = hashes.view(np.int64)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(begins))
            order = np.lexsort((owner, hashes))
            owner, term = owner[order], hashes[order]
            if not len(term):
                continue
            first = np.concatenate(([True], (owner[1:] != owner[:-1]) | (term[1:] != term[:-1])))
            found, n = np.unique(term[first], return_counts=True)
            both, at = np.unique(np.concatenate((terms, found)), return_inverse=True)
            terms, counts = both, np.bincount(at, np.concatenate((counts, n)), len(both)).astype(np.int64)
            if len(terms) >= TERMS_AT_ONCE:
                yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(counts)], names=["term", "n"])
                terms, counts = terms[:0], counts[:0]
        if len(terms):
            yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(counts)], names=["term", "n"])

    return docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("df"))


def _texts(scanned: DataFrame) -> DataFrame:
    """(h, copies, entities, terms) of every different text with entities; terms are its distinct words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "free"):
            hashes, begins = _hashes(batch.column("free").to_pylist())
            terms = [np.unique(hashes[a:b]) for a, b in zip(begins[:-1], begins[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("h", "copies", "entities")] + [pa.array(terms, pa.list_(pa.int64()))],
                names=["h", "copies", "entities", "terms"],
            )

    folded = scanned.where(F.size("entities") > 0).groupBy("h").agg(
        F.count("*").alias("copies"), F.first("entities").alias("entities"), F.first("free").alias("free")
    )
    return folded.mapInArrow(run, "h long, copies long, entities array<long>, terms array<long>")


def _occurrences(scanned: DataFrame, risky: DataFrame) -> DataFrame:
    """(row, entity, term, start, stop) of every word that may be risky for an entity of its row."""
    held = scanned.sparkSession.sparkContext.broadcast(bit_filter(risky.select(F.expr("entity ^ term").alias("code")), "code"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "free"):
            texts = batch.column("free").to_pylist()
            hashes, begins = _hashes(texts)
            rows = batch.column("row").to_numpy()
            parts, n = [], 0
            for i, entities in enumerate(batch.column("entities").to_pylist()):
                own = hashes[begins[i] : begins[i + 1]]
                spans = None
                for entity in entities:
                    at = np.flatnonzero(passes(held.value, own ^ np.int64(entity)))
                    if not len(at):
                        continue
                    if spans is None:
                        spans = np.array([m.span() for m in _WORD.finditer(texts[i])], np.int64)
                    parts.append((np.full(len(at), rows[i]), np.full(len(at), entity), own[at], spans[at, 0], spans[at, 1]))
                    n += len(at)
                    if n >= PAIRS_AT_ONCE:
                        yield emit(parts)
                        parts, n = [], 0
            if parts:
                yield emit(parts)

    def emit(parts: list) -> pa.RecordBatch:
        columns = [pa.array(np.concatenate(c)) for c in zip(*parts)]
        return pa.RecordBatch.from_arrays(columns, names=["row", "entity", "term", "start", "stop"])

    holds = scanned.where(F.size("entities") > 0).select("row", "entities", "free")
    return holds.mapInArrow(run, "row long, entity long, term long, start long, stop long")


def risky_terms(scanned: DataFrame, docs: DataFrame, support: int, generalise: float, remove: float) -> DataFrame:
    """(entity, term, share, action) of the words that reveal an entity.

    With N rows, share = log(N n(e,t) / (n(e) n(t))) / log(N / n(e)). All counts are over
    whole rows of the corpus; a pair needs ``support`` different texts, so that copies of
    one text prove nothing.

    n(e,t) is at most n(e), so a word is too frequent for an entity from some n(t) on: such
    pairs are never listed, however many words and entities a text has.
    """
    total = scanned.count()
    n = F.lit(float(max(total, 1)))
    information = F.ln(n / F.col("ne"))

    def share(both: str):
        return F.when(information > 0, F.ln(n * F.col(both) / (F.col("ne") * F.col("df"))) / information).otherwise(0.0)

    words = stored(_vocabulary(docs), "words")
    texts = stored(_texts(scanned), "texts")
    often = texts.select(F.explode("entities").alias("entity"), "copies").groupBy("entity").agg(
        F.sum("copies").alias("ne"), F.count("*").alias("texts")
    )
    often = stored(often.where(F.col("texts") >= support).select("entity", "ne"), "entities")
    entities = texts.select("h", F.explode("entities").alias("entity")).join(often, "entity")
    # A term of ``support`` texts stands in as many rows at least.
    terms = texts.select("h", "copies", F.explode("terms").alias("term")).join(words.where(F.col("df") >= support), "term")
    pairs = entities.join(terms, "h").where(F.round(share("ne"), 6) >= generalise)
    counted = pairs.groupBy("entity", "term", "ne", "df").agg(F.sum("copies").alias("both"), F.count("*").alias("texts"))
    return (
        counted.where(F.col("texts") >= support)
        .select("entity", "term", F.round(share("both"), 6).alias("share"))
        .where(F.col("share") >= generalise)
        .withColumn("action", F.when(F.col("share") >= remove, F.lit(ADDED[1])).otherwise(F.lit(ADDED[0])))
    )


def find_spans(
    docs: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE
) -> DataFrame:
    """Spans of every row of ``docs`` (doc_id, text): base spans and the words that give them away.

    doc_id, h (hash of the text), n_email, n_ip, n_card, n_phone, base (kind:start:end,
    comma-joined), spans (base, then generalised and removed words by start). A word is added
    at each of its occurrences in every text that holds a value, or a group, which it
    reveals; of two actions the stronger counts. Added spans never overlap base spans. Null texts count as empty;
    repeated rows each have their spans; other columns are not read.
    """
    scanned = stored(_scan(docs), "scan")
    risky = stored(risky_terms(scanned, docs, support, generalise, remove), "risky")
    flagged = (
        _occurrences(scanned, risky).join(risky.select("entity", "term", "action"), ["entity", "term"])
        .groupBy("row", "start", "stop")
        .agg(F.max("action").alias("action"))  # removed before generalised, by letter
        .groupBy("row")
        .agg(F.sort_array(F.collect_list(F.struct("action", "start", "stop"))).alias("added"))
    )
    text = F.transform("added", lambda x: F.concat_ws(":", x["action"], x["start"].cast("string"), x["stop"].cast("string")))
    spans = F.array_join(F.concat(F.when(F.col("base") != "", F.array("base")).otherwise(F.array().cast("array<string>")), text), ",")
    return scanned.join(flagged, "row", "left").select(
        "doc_id", "h", "n_email", "n_ip", "n_card", "n_phone", "base", F.coalesce(spans, "base").alias("spans")
    )


def general_form(word: str) -> str:
    """What a generalised word leaves: a number its size, any other word its kind.

    1987 becomes 1000+, Berlin becomes [Name], other words become [word].
    """
    if word.isascii() and word.isdigit():
        digits = word.lstrip("0")
        return f"{digits[0]}{'0' * (len(digits) - 1)}+" if digits else "0"
    return "[Name]" if word[:1].isupper() else "[word]"


def sanitised(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with the spans of their texts replaced: values by [KIND], generalised words by a general form.

    Removed words vanish. Where base spans overlap, the one that begins first hides the
    others. Null texts stay null. Rows keep their columns, whatever their names; repeated rows
    stay repeated.
    """
    found = find_spans(docs.select("doc_id", "text"), **options).select(
        F.col("doc_id").alias("of_id"), F.col("h").alias("of_h"), F.col("spans").alias("of_spans")
    ).distinct()
    columns = docs.columns
    spans_name = fresh_name("spans", columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column(spans_name).to_pylist()):
                own = sorted((int(a), int(b), k) for k, a, b in (s.rsplit(":", 2) for s in (spans or "").split(",") if s))
                out, done = [], 0
                for a, b, kind in own:
                    if a >= done:
                        shown = {"removed": "", "generalised": general_form(text[a:b])}.get(kind, f"[{kind.upper()}]")
                        out += [text[done:a], shown]
                        done = b
                texts.append(None if text is None else "".join(out) + text[done:])
            kept = [pa.array(texts, batch.schema.field("text").type) if c == "text" else batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays(kept, names=columns)

    joined = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("d"), F.col("doc_id").alias("my_id"), F.xxhash64("text").alias("my_h")).join(
        found, F.expr("my_id <=> of_id and my_h = of_h"), "left"
    )
    return joined.select("d.*", F.col("of_spans").alias(spans_name)).mapInArrow(run, docs.schema)
