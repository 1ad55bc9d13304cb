"""Mixing sources to target weights by blocks of words.

The words of every source, document after document, are packed into blocks of a fixed
length. Each source is due a number of slots of the mix; the slots are dealt to the output
shards by a pseudorandom permutation of all slots, so the source counts of a shard are a
multinomial draw given the totals. (Free draws per shard would let a source that stands at
its cap exceed it.) The k-th slot of a source takes the block that the source's own
permutation of its block numbers puts there, a new permutation for each pass over the
source, and blocks are joined to slots by number.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import fresh_name, stored
from .words import WHITE, mix, slices, text_bytes

BLOCK_WORDS = 128
SHARD_SLOTS = 4096
WEIGHTS = (5, 2, 1)
CAP = 3
SEED = 7
MAX_SOURCES = 100_000
ROWS_PER_BUCKET = 1_000


def permuted(x: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 at ``x``: Feistel rounds, repeated until below n."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = mix(np.arange(4, dtype=np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    out = x.astype(np.uint64)
    todo = np.ones(len(out), bool)
    while todo.any():
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for key in keys:
            left, right = right, left ^ (mix(right + key) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = out >= np.uint64(n)
    return out.astype(np.int64)


def word_spans(text: bytes) -> np.ndarray:
    """Where each word begins, and the end of the text."""
    if not text:
        return np.zeros(1, np.int64)
    breaks = WHITE[np.frombuffer(text, np.uint8)]
    starts = ~breaks
    starts[1:] &= breaks[:-1]
    return np.append(np.flatnonzero(starts), len(text))


def targets(sizes: dict, weights=WEIGHTS, cap: int = CAP) -> dict:
    """Words due to each source: weights repeat over the sources by code point, null last.

    All sizes together are shared by weight; a share above ``cap`` times its source's size
    stops there and the excess is shared again by weight among the others.
    """
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = Fraction(sum(sizes.values())), list(names), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if unit * weight[s] > cap * sizes[s]]
        if not full:
            out.update({s: unit * weight[s] for s in open_})
            break
        out.update({s: Fraction(cap * sizes[s]) for s in full})
        left -= sum(out[s] for s in full)
        open_ = [s for s in open_ if s not in out]
    return {s: out[s] for s in names}


def _sizes(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            body, offsets = text_bytes(batch.column("text"))
            starts = np.zeros(len(body) + 1, np.int64)
            if len(body):
                breaks = WHITE[body]
                first = ~breaks
                first[1:] &= breaks[:-1]
                inner = offsets[(offsets > 0) & (offsets < len(body))]
                first[inner] = ~breaks[inner]
                np.cumsum(first, out=starts[1:])
            size = starts[offsets[1:]] - starts[offsets[:-1]]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("source"), batch.column("h"), pa.array(size)],
                names=["doc_id", "source", "h", "size"],
            )

    doc_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("source").cast("string"), F.xxhash64("text").alias("h"), "text")
    return rows.mapInArrow(run, f"doc_id {doc_type}, source string, h long, size long")


def plan_mix(
    docs: DataFrame,
    weights=WEIGHTS,
    cap: int = CAP,
    block_words: int = BLOCK_WORDS,
    shard_slots: int = SHARD_SLOTS,
    seed: int = SEED,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, pieces, slots) of a mix of ``docs`` (doc_id, text, source).

    documents: doc_id, h (hash of the text), row, source, s (source number), size,
    source_size, target, first (its first word in the source). pieces: the parts of
    documents in blocks (s, block, row, doc_id, h, from, to; word numbers of the
    document). slots: shard, slot, s, epoch, block.

    Null texts and texts without words have size 0 and no piece. A null source is a source
    of its own, last in order. A null doc_id is allowed; repeated rows are documents of
    their own, told apart by ``row``. The result depends on the rows and ``seed`` alone.
    """
    spark = docs.sparkSession
    rows = stored(_sizes(docs), "sizes")
    found = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    size = {r.source: r["size"] for r in found}
    due = targets(size, weights, cap)
    names = list(due)
    blocks = np.array([-(-size[s] // block_words) for s in names], np.int64)
    # A source's blocks are block_words long but for the last: the mean length counts.
    draws = [round(due[s] * int(b) / size[s]) if size[s] else 0 for s, b in zip(names, blocks)]
    before = np.concatenate(([0], np.cumsum(draws))).astype(np.int64)

    info = spark.createDataFrame(
        [(s, i, size[s], float(due[s])) for i, s in enumerate(names)],
        "source string, s long, source_size long, target double",
    )
    # Order within a source: buckets of a hash, so that no source is summed up in one task.
    buckets = 1 + sum(r.rows for r in found) // ROWS_PER_BUCKET
    spread = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "h"), F.lit(buckets)))
    inside = Window.partitionBy("source", "bucket").orderBy("doc_id", "h").rowsBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy("source", "bucket", "doc_id", "h").orderBy("size")
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = spread.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    sums = sums.select("source", "bucket", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("base"))
    placed = (
        spread.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .withColumn("row", F.row_number().over(same))
        .alias("r")
        .join(sums.alias("b"), F.expr("r.source <=> b.source and r.bucket = b.bucket"))
        .select("r.doc_id", "r.h", "r.row", "r.source", "r.size", (F.col("inner") + F.col("base")).alias("first"))
        .alias("r")
        .join(F.broadcast(info.alias("i")), F.expr("r.source <=> i.source"))
        .select("r.*", "s", "source_size", "target")
    )
    documents = stored(placed, "placed")
    length = F.lit(block_words)
    pieces = (
        documents.where("size > 0")
        .withColumn("block", F.explode(F.sequence(F.floor(F.col("first") / length), F.floor((F.col("first") + F.col("size") - 1) / length))))
        .select(
            "s",
            "block",
            "row",
            "doc_id",
            "h",
            F.greatest(F.lit(0), F.col("block") * length - F.col("first")).alias("from"),
            F.least(F.col("size"), (F.col("block") + 1) * length - F.col("first")).alias("to"),
        )
    )

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = batch.column(0).to_numpy()
            at = permuted(slot, int(before[-1]), seed)
            s = np.searchsorted(before, at, "right") - 1
            draw = at - before[s]
            epoch, block = draw // blocks[s], draw % blocks[s]
            order = np.lexsort((epoch, s))
            cut = np.flatnonzero((np.diff(s[order]) != 0) | (np.diff(epoch[order]) != 0)) + 1
            for own in np.split(order, cut):
                if len(own):
                    k = int(s[own[0]])
                    block[own] = permuted(block[own], int(blocks[k]), seed + 1 + k * (cap + 1) + int(epoch[own[0]]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(slot // shard_slots), pa.array(slot), pa.array(s), pa.array(epoch), pa.array(block)],
                names=["shard", "slot", "s", "epoch", "block"],
            )

    slots = spark.range(int(before[-1])).mapInArrow(deal, "shard long, slot long, s long, epoch long, block long")
    return documents, pieces, slots


def taken_words(documents: DataFrame, pieces: DataFrame, slots: DataFrame) -> DataFrame:
    """``documents`` with taken: the words the mix takes of each, repeats counted."""
    times = slots.groupBy("s", "block").agg(F.count("*").alias("times"))
    used = (
        pieces.join(times, ["s", "block"])
        .groupBy("s", "doc_id", "h", "row")
        .agg(F.sum((F.col("to") - F.col("from")) * F.col("times")).alias("taken"))
    )
    key = "d.s = u.s and d.doc_id <=> u.doc_id and d.h = u.h and d.row = u.row"
    return documents.alias("d").join(used.alias("u"), F.expr(key), "left").select(
        "d.*", F.coalesce("taken", F.lit(0)).alias("taken")
    )


def _cut(texts: pa.Array, spans: list) -> list[list[str]]:
    """Each text's pieces; a piece keeps the white space up to the next word."""
    out = []
    for text, own in zip(texts.to_pylist(), spans):
        body = (text or "").encode()
        at = word_spans(body)
        out.append([body[at[x["from"]] : at[x["to"]]].decode() for x in own])
    return out


HAS_WORD = r"[^\x20\x09-\x0D]"


def _with_spans(docs: DataFrame, pieces: DataFrame) -> tuple[DataFrame, str, str]:
    """Rows of ``docs`` with the list of their pieces and the number of their source, under names of their own.

    The list is bounded by its document. Rows without a word have no piece and go first.
    """
    spans, number = fresh_name("spans", docs.columns), fresh_name("source_number", docs.columns)
    lists = pieces.groupBy("doc_id", "h", "s", "row").agg(
        F.sort_array(F.collect_list(F.struct("from", "to", "block", *(c for c in ("times",) if c in pieces.columns)))).alias("spans")
    )
    numbered = lists.withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "h").orderBy("s", "row")))
    key = Window.partitionBy("id", "h").orderBy(F.col("of").asc_nulls_last())
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")
    texts = docs.where(F.col("text").rlike(HAS_WORD)).select(
        whole, F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"), F.col("source").cast("string").alias("of")
    )
    texts = texts.withColumn("n", F.row_number().over(key))
    joined = texts.alias("t").join(numbered.alias("p"), F.expr("t.id <=> p.doc_id and t.h = p.h and t.n = p.n"))
    return joined.select("t.doc.*", F.col("p.spans").alias(spans), F.col("p.s").alias(number)), spans, number


def mixed_blocks(docs: DataFrame, pieces: DataFrame, slots: DataFrame) -> DataFrame:
    """The mix itself: (shard, slot, source number s, epoch, block, text) of every slot."""
    chosen, spans_name, number = _with_spans(docs.select("doc_id", "source", "text"), pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            spans = batch.column(spans_name).to_pylist()
            s = batch.column(number).to_pylist()
            first = batch.column("doc_id").to_pylist()
            rows = [
                (k, x["block"], x["from"], d, t)
                for own, k, d, cut in zip(spans, s, first, _cut(batch.column("text"), spans))
                for x, t in zip(own, cut)
            ]
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), batch.schema.field("doc_id").type, pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["s", "block", "from", "doc_id", "text"]
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = chosen.mapInArrow(run, f"s long, block long, `from` long, doc_id {kind}, text string")
    blocks = texts.groupBy("s", "block").agg(F.sort_array(F.collect_list(F.struct("doc_id", "from", "text"))).alias("parts"))
    whole = blocks.select("s", "block", F.array_join(F.col("parts.text"), " ").alias("text"))
    return slots.join(whole, ["s", "block"])


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as the mix takes them, with their columns: one row for each document taken from.

    text holds the taken pieces in order; pieces taken more than once follow again, pass by
    pass. n_chars, where there is such a column, is the new length. A document taken whole
    and once keeps its text but for white space at its ends.
    """
    _, pieces, slots = plan_mix(docs, **options)
    times = slots.groupBy("s", "block").agg(F.count("*").alias("times"))
    chosen, spans_name, _ = _with_spans(docs, pieces.join(times, ["s", "block"]))
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            spans = batch.column(spans_name).to_pylist()
            texts = []
            for own, cut in zip(spans, _cut(batch.column("text"), spans)):
                passes = [
                    "".join(t for x, t in zip(own, cut) if x["times"] > e) for e in range(max(x["times"] for x in own))
                ]
                texts.append("\n".join(p.strip(" \t\n\r\x0b\x0c") for p in passes))
            out = [pa.array(texts, batch.schema.field("text").type) if c == "text" else batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays(out, names=columns)

    out = chosen.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in columns else out
