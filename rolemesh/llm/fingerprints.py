"""Document fingerprints by consistent weighted sampling, in DataFrame functions alone.

For sample k and term x, hashes of (x, k) give r and c from Gamma(2, 1) and b from [0, 1).
A term of weight w has level t = floor(ln w / r + b) and value ln a = ln c - r (t - b + 1).
The smallest value over a text's terms is the text's k-th sample: it names a term and its
level, and two texts agree in it with a probability equal to the generalised Jaccard
similarity (sum of minima over sum of maxima) of their weights. Terms are lower-case words
between white space, weights their counts.

A text's words are exploded, counted and sampled where the text has been placed by its key,
so words are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import stored

SAMPLES = 64  # the standard error of a likeness is at most 1 / 16
GROUP = 8  # samples computed in one row
_NO_ID = -(1 << 63)
_DIGITS = 4  # hexadecimal digits of a sample in a fingerprint: two samples differ unseen once in 65,536


def words_of(text: Column) -> Column:
    """Lower-case runs between white space (\\x20 and \\x09-\\x0D), and some empty strings."""
    return F.split(F.translate(F.lower(text), "\t\n\x0b\x0c\r", "     "), " ")


def _uniform(bits: Column, shift: int, width: int) -> Column:
    """Some bits of a hash as a number strictly between 0 and 1."""
    return (F.shiftrightunsigned(bits, shift).bitwiseAND((1 << width) - 1) + 0.5) / float(1 << width)


def sample_values(term: Column, logs: list[Column], k: Column) -> list[Column]:
    """ln a of sample ``k`` for a term under each of several logarithms of weights; null for null."""
    one, two = F.xxhash64(term, 2 * k), F.xxhash64(term, 2 * k + 1)
    r = -F.ln(_uniform(one, 0, 31) * _uniform(one, 32, 31))
    c = F.ln(-F.ln(_uniform(two, 0, 21) * _uniform(two, 21, 21)))
    b = _uniform(two, 42, 21)
    return [c - r * (F.floor(w / r + b) - b + 1) for w in logs]


def _digits(value: Column) -> Column:
    return F.substring(F.lpad(F.lower(F.hex(F.xxhash64(value))), 16, "0"), 1, _DIGITS)


def likeness(one: Column, two: Column, samples: int) -> Column:
    """The share of equal samples of two fingerprints."""
    at = F.array(*(F.lit(1 + _DIGITS * k) for k in range(samples)))
    return F.size(F.filter(at, lambda i: one.substr(i, F.lit(_DIGITS)) == two.substr(i, F.lit(_DIGITS)))) / float(samples)


def _samples(texts: DataFrame, keys: list[str], columns: list[str], samples: int) -> DataFrame:
    """keys and a fingerprint per text column, for texts with a word; ``texts`` is placed by ``keys``.

    GROUP samples of one term are a row on its way to the smallest values, never shuffled.
    """
    text = F.col(columns[-1])
    for i, c in list(enumerate(columns))[:-1]:
        text = F.when(F.col("side") == i, F.col(c)).otherwise(text)
    sides = F.explode(F.array(*(F.lit(i) for i in range(len(columns))))).alias("side")
    each = texts.select(*keys, *columns, sides).select(*keys, "side", F.explode(words_of(text)).alias("word"))
    counted = (
        each.where("word <> ''")
        .select(*keys, "side", F.xxhash64("word").alias("term"))
        .groupBy(*keys, "term")
        .agg(*(F.sum((F.col("side") == i).cast("long")).alias(f"w{i}") for i in range(len(columns))))
    )
    # The logarithm of weight 0 is null, and so are its values.
    logs = counted.select(*keys, "term", *(F.ln(f"w{i}").alias(f"l{i}") for i in range(len(columns))))
    groups = -(-samples // GROUP)
    steps = logs.select("*", F.explode(F.array(*(F.lit(g) for g in range(groups)))).alias("g"))
    sides_of = range(len(columns))
    least = []
    for j in range(GROUP):
        values = sample_values(F.col("term"), [F.col(f"l{i}") for i in sides_of], F.col("g") * GROUP + j)
        least += [F.min(v).alias(f"v{i}_{j}") for i, v in enumerate(values)]
    found = steps.groupBy(*keys, "g").agg(*least)
    digits = found.select(
        *keys, "g", *(F.concat(*(_digits(F.col(f"v{i}_{j}")) for j in range(GROUP))).alias(f"p{i}") for i in sides_of)
    )
    parts = F.sort_array(F.collect_list(F.struct("g", *(f"p{i}" for i in sides_of))))
    whole = digits.groupBy(*keys).agg(parts.alias("parts"))
    joined = (F.substring(F.array_join(F.col(f"parts.p{i}"), ""), 1, samples * _DIGITS).alias(f"print{i}") for i in sides_of)
    return whole.select(*keys, *joined)


def _successors(rows: DataFrame) -> DataFrame:
    """Each row (id, h, ...) with next_id and next_h, the row after it in order; the last meets the first.

    Rows are dealt out by ranges; the seams between ranges are closed with one row per range.
    """
    ranged = stored(rows.repartitionByRange("id", "h").withColumn("part", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("part").orderBy("id", "h")
    seam = ranged.groupBy("part").agg(F.min(F.struct("id", "h")).alias("first"))
    order = Window.orderBy("part")
    # One row per range partition; the first row of all follows the last.
    start = F.first("first").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    seam = seam.select("part", F.coalesce(F.lead("first").over(order), start).alias("after"))
    follows = ranged.withColumn("next", F.lead(F.struct("id", "h")).over(inside))
    return (
        follows.join(seam, "part")
        .withColumn("next", F.coalesce("next", "after"))
        .select(*rows.columns, F.col("next.id").alias("next_id"), F.col("next.h").alias("next_h"))
    )


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of the texts of ``docs`` (doc_id, text): doc_id, n_chars, fingerprint, copies.

    Null texts count as empty; all texts without words share one fingerprint. Rows that
    repeat a doc_id and text are folded, copies says how many there are.
    """
    rows = _keyed(docs)
    once = rows.groupBy("id", "h").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.count("*").alias("copies"))
    prints = _samples(once, ["id", "h"], ["text"], samples)
    none = F.repeat(F.lit("0"), samples * _DIGITS)
    small = once.select("id", "h", "doc_id", F.length("text").alias("n_chars"), "copies")
    return small.join(prints, ["id", "h"], "left").select(
        "doc_id", "n_chars", F.coalesce("print0", none).alias("fingerprint"), "copies"
    )


def _keyed(docs: DataFrame) -> DataFrame:
    """(id, h, doc_id, text); id orders doc_ids, nulls first: whole numbers by value, others as text."""
    text = F.coalesce("text", F.lit(""))
    if docs.schema["doc_id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint"):
        key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID))
    else:
        key = F.coalesce(F.concat(F.lit("1"), F.col("doc_id").cast("string")), F.lit("0"))
    return docs.select(
        key.alias("id"), F.xxhash64(F.col("doc_id").isNull(), text).alias("h"), "doc_id", text.alias("text")
    )


def edited_fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of all texts of ``docs`` (doc_id, text), of their edits and of their neighbours.

    A text's edit replaces its last floor(n_chars / 4) code points by the first as many (or
    all) of the next document in ascending doc_id, nulls first; the document after the last
    is the first. Documents that share a doc_id are ordered by a hash of their text. Rows
    that repeat doc_id and text are one document in this order, and each such row is
    returned. Null texts count as empty; a text without words has the same fingerprint as
    any other. Other columns are not read.
    """
    rows = _keyed(docs)
    small = rows.groupBy("id", "h").agg(
        F.first("doc_id").alias("doc_id"), F.first(F.length("text")).cast("long").alias("n_chars"), F.count("*").alias("copies")
    )
    order = stored(_successors(small), "order")
    one = Window.partitionBy("id", "h").orderBy("id")
    texts = rows.select("id", "h", "text").withColumn("nth", F.row_number().over(one)).where("nth = 1").drop("nth")
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    gifts = texts.join(
        order.select(F.col("next_id").alias("id"), F.col("next_h").alias("h"), F.col("id").alias("to_id"), F.col("h").alias("to_h"), "n_chars"),
        ["id", "h"],
    ).select(F.col("to_id").alias("id"), F.col("to_h").alias("h"), F.substring(F.col("text"), F.lit(1), cut).alias("gift"), "n_chars")
    both = texts.join(gifts, ["id", "h"]).select(
        "id", "h", "text", F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - cut), F.col("gift")).alias("edited")
    )
    prints = _samples(both, ["id", "h"], ["text", "edited"], samples)
    sums = both.select("id", "h", F.sha2("edited", 256).alias("edited_sha256"))
    none = F.repeat(F.lit("0"), samples * _DIGITS)
    done = sums.join(prints, ["id", "h"], "left").select(
        "id", "h", "edited_sha256", F.coalesce("print0", none).alias("print0"), F.coalesce("print1", none).alias("print1")
    )
    done = stored(done, "prints")
    after = done.select(F.col("id").alias("next_id"), F.col("h").alias("next_h"), F.col("print0").alias("next_print"))
    return (
        order.join(done, ["id", "h"])
        .join(after, ["next_id", "next_h"])
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
        .select(
            "doc_id",
            "n_chars",
            "edited_sha256",
            F.col("print0").alias("fingerprint"),
            F.col("print1").alias("edited_fingerprint"),
            likeness(F.col("print0"), F.col("print1"), samples).alias("near_edited"),
            likeness(F.col("print0"), F.col("next_print"), samples).alias("near_next"),
        )
    )
