"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram's vector binds its letters: the
vectors are rotated by their place and multiplied. A text is the bundle (sum) of its n-gram
vectors, a language's prototype the bundle of its training texts, and a text gets the
language whose prototype has the largest cosine with it.

The dot product of a bundle is the sum of its n-grams' dot products, so a worker keeps one
row of products per n-gram it has seen instead of building each text's vector. The length
of a bundle is taken from its n-gram counts, as random vectors of thousands of dimensions
are orthogonal up to a few hundredths.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import slices

DIMENSIONS = 4096
SAMPLE_PER_LANGUAGE = 4_000  # about so many training texts of each language, picked by a hash
MAX_LANGUAGES = 1_000
KNOWN_NUMBERS = 1 << 24  # products of n-grams with prototypes that a task remembers
UNKNOWN = "und"
_LETTERS = 255  # vectors; ASCII letters have their own, others share the rest by code point
_SIZES = (1, 2, 3)

_letter_of: np.ndarray | None = None


def _letters() -> np.ndarray:
    """The vector number of each code point; 0 is everything that is not a letter."""
    global _letter_of
    if _letter_of is None:
        flags = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
        at = np.arange(0x110000)
        table = np.where(at < 128, (at | 32) - 96, 27 + at % (_LETTERS - 26))
        _letter_of = np.where(flags, table, 0).astype(np.uint32)
    return _letter_of


def ngram_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the letter 1- to 3-grams of all texts and the text number of each.

    A run of other characters counts as one blank; n-grams have no blank inside and are
    not blank alone.
    """
    body = np.frombuffer("\0".join(texts).encode("utf-32-le", "replace"), np.uint32)
    lengths = np.array([len(t) for t in texts], np.int64)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), lengths + 1)[: len(body)]
    letters = _letters()[body]
    keep = letters > 0
    keep[1:] |= letters[:-1] > 0  # the first blank of a run ends a word
    letters, owner = letters[keep], owner[keep]
    padded = np.concatenate(([0, 0], letters)).astype(np.uint32)
    a, b, c = padded[:-2], padded[1:-1], padded[2:]
    codes, owners = [], []
    for size, code in ((1, c), (2, (b << 8) | c), (3, (a << 16) | (b << 8) | c)):
        good = (c > 0) if size == 1 else ((b > 0) | (c > 0)) if size == 2 else (b > 0)
        codes.append((code | np.uint32(size << 24))[good])
        owners.append(owner[good])
    return np.concatenate(codes), np.concatenate(owners)


class Vectors:
    """The random letter vectors, equal on every machine, and their bindings."""

    def __init__(self, dimensions: int):
        rng = np.random.default_rng(20_011)
        self.base = (rng.integers(0, 2, (_LETTERS + 1, dimensions), np.int8) * 2 - 1).astype(np.int8)
        self.rotated = [np.roll(self.base, k, axis=1) for k in (0, 1, 2)]

    def bind(self, codes: np.ndarray) -> np.ndarray:
        """One row per n-gram: letters rotated by their distance from the end, multiplied."""
        out = self.rotated[0][codes & 255].copy()
        for place, size in ((1, 2), (2, 3)):
            has = (codes >> 24) >= size
            out[has] *= self.rotated[place][(codes[has] >> (8 * place)) & 255]
        return out


_vectors: dict[int, Vectors] = {}


def _shared_vectors(dimensions: int) -> Vectors:
    if dimensions not in _vectors:
        _vectors[dimensions] = Vectors(dimensions)
    return _vectors[dimensions]


def _counted(codes: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, code) pairs and how often each occurs."""
    if not len(codes):
        return (np.zeros(0, np.int64),) * 3
    key = np.sort((owners.astype(np.int64) << 27) | codes)
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    counts = np.diff(np.concatenate((first, [len(key)])))
    key = key[first]
    return key >> 27, key & ((1 << 27) - 1), counts


def train(docs: DataFrame, dimensions: int = DIMENSIONS, sample: int = SAMPLE_PER_LANGUAGE) -> dict[str, np.ndarray]:
    """Prototype of each language from the labelled rows (text, lang) of ``docs``.

    About ``sample`` texts of every language are used, picked by a hash of the text, so the
    result does not depend on the order of rows; fewer where a language has fewer. Each
    text adds its n-gram counts scaled to length one. Rows with null text or lang are left out.
    """
    labelled = docs.where("lang is not null and text is not null").select("lang", "text")
    sizes = labelled.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not sizes:
        return {}
    share = F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(min(1.0, sample / r["count"])))])
    picked = labelled.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = _shared_vectors(dimensions)
        total: dict[str, np.ndarray] = {}
        for batch in slices(batches, "text", 1 << 19):
            langs = batch.column("lang").to_pylist()
            owner, code, n = _counted(*ngram_codes(batch.column("text").to_pylist()))
            if not len(owner):
                continue
            length = np.sqrt(np.bincount(owner, (n * n).astype(float), len(langs)))
            weight = n / length[owner]
            names = sorted(set(langs))
            lang = np.array([names.index(x) for x in langs])[owner]
            distinct, at = np.unique(code, return_inverse=True)
            table = np.zeros((len(names), len(distinct)))
            np.add.at(table, (lang, at), weight)
            for begin in range(0, len(distinct), 1024):
                part = vectors.bind(distinct[begin : begin + 1024]).astype(np.float32)
                for name, row in zip(names, table[:, begin : begin + 1024].astype(np.float32) @ part):
                    total[name] = total.get(name, 0) + row
        for name, row in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([row.astype(float)], pa.list_(pa.float64()))], names=["lang", "v"]
            )

    # The sample is bounded for every language, and so is what a task bundles of it.
    partial = picked.repartition(max(64, 16 * len(sizes))).mapInArrow(bundle, "lang string, v array<double>")
    # Sums in whole thousandths do not depend on the order of the parts.
    summed = (
        partial.select("lang", F.posexplode("v").alias("i", "x"))
        .groupBy("lang", "i")
        .agg(F.sum(F.round(F.col("x") * 1000).cast("long")).alias("x"))
        .collect()
    )
    out: dict[str, np.ndarray] = {}
    for r in summed:
        out.setdefault(r["lang"], np.zeros(dimensions))[r["i"]] = r["x"]
    return dict(sorted(out.items()))


def identify(
    docs: DataFrame, prototypes: dict[str, np.ndarray], dimensions: int = DIMENSIONS, keep_text: bool = False
) -> DataFrame:
    """``docs`` with lang_pred and score, from each row's whole text alone; text is dropped unless kept.

    score is the cosine with the chosen prototype, cut to 0..1. Null texts and texts without
    a letter get ``und`` and 0; so does every text when nothing was learned. Equal cosines
    go to the first name. The columns lang_pred and score of the input, if any, are replaced.
    """
    names = list(prototypes)
    matrix = np.array([prototypes[x] for x in names], np.float32).reshape(len(names), dimensions)
    if names:
        matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-9)
    held = docs.sparkSession.sparkContext.broadcast(matrix)
    others = [c for c in docs.columns if c not in ("lang_pred", "score") and (keep_text or c != "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = held.value
        vectors = _shared_vectors(dimensions)
        known = np.zeros(0, np.int64)  # n-gram codes in order, and their rows of products
        products = np.zeros((0, len(names)), np.float32)
        for batch in slices(batches, "text", 1 << 19):
            n_rows = batch.num_rows
            best, score = np.full(n_rows, -1), np.zeros(n_rows)
            texts = pc.fill_null(batch.column("text"), "").to_pylist()
            owner, code, n = _counted(*ngram_codes(texts))
            if len(known) * max(1, len(names)) > KNOWN_NUMBERS:
                known, products = known[:0], products[:0]
            if len(owner) and names:
                new = np.setdiff1d(code, known)
                for begin in range(0, len(new), 1024):
                    part = new[begin : begin + 1024]
                    known = np.concatenate((known, part))
                    products = np.concatenate((products, vectors.bind(part).astype(np.float32) @ matrix.T))
                if len(new):
                    order = np.argsort(known)
                    known, products = known[order], products[order]
                rows = products[np.searchsorted(known, code)] * n[:, None]
                first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
                dots = np.add.reduceat(rows, first, axis=0)
                length = np.sqrt(np.add.reduceat((n * n).astype(float), first) * dimensions)
                cosine = dots / length[:, None]
                best[owner[first]] = cosine.argmax(axis=1)
                score[owner[first]] = np.clip(cosine.max(axis=1), 0, 1)
            kept = [batch.column(c) for c in others]
            pred = pa.array([names[k] if k >= 0 else UNKNOWN for k in best], pa.string())
            yield pa.RecordBatch.from_arrays(
                [*kept, pred, pa.array(np.round(score, 6))], names=[*others, "lang_pred", "score"]
            )

    schema = docs.select(*others).schema.add("lang_pred", "string").add("score", "double")
    return docs.select(*others, *(["text"] if "text" not in others else [])).mapInArrow(run, schema)
