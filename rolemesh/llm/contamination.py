"""Benchmark decontamination: BM25 over the test items, searched with block-max WAND.

Test items are indexed by words; every passage of every training text is a query. An item
is retrieved when the BM25 score of the passage reaches a share of the score that the item
gives itself. A passage may hold only part of a long item, so items are also indexed as
overlapping pieces, each short enough to lie whole in some passage wherever it stands, and
retrieved by the score that a piece gives itself. Retrieved pairs are verified on their
words: enough of the item's question part and of its answer part has to occur in the
passage and its surroundings.
"""

from __future__ import annotations

from collections.abc import Container, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import stored
from .words import NOT_WORD, hash_words, shingles, slices

K1, B = 1.2, 0.75
PASSAGE, STEP = 64, 32  # words of a passage and from one passage to the next
PIECE, PIECE_STEP = PASSAGE - STEP + 1, (PASSAGE - STEP) // 2  # words of a piece, which some passage holds whole
SCORE = 0.6  # of the score that an item, or a piece of it, gives itself
OVERLAP = 0.6  # of the n-grams of the question, and of the answer
NGRAM = 3
LEAST_WORDS = 4  # of an item; every text that holds a shorter one would be a leak
BLOCK = 8  # items of a block with stored maxima
SHARD_BYTES = 64 << 10  # of benchmark text in one index
SHARDS_AT_ONCE = 32  # indexes sent to the workers together; a larger benchmark takes several passes


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return hash_words(pc.utf8_lower(texts.cast(pa.large_string())), NOT_WORD)


def question_and_answer(words: np.ndarray, answer: float = 0.25) -> tuple[np.ndarray, np.ndarray]:
    """The leading words and the last quarter (one word at least); a single word is both."""
    cut = len(words) - max(1, int(len(words) * answer))
    return (words[:cut] if cut else words), words[cut:]


def pieces_of(words: np.ndarray) -> list[np.ndarray]:
    """Overlapping pieces that cover an item, the last one at its end; none for an item that is no longer than a piece."""
    last = len(words) - PIECE
    return [words[k : k + PIECE] for k in (*range(0, last, PIECE_STEP), last)] if last > 0 else []


@dataclass
class Index:
    """Inverted index of one shard of items, or of their pieces, scores as shares of each entry's own score."""

    items: list  # ids
    words: list[np.ndarray]
    owner: list[int]  # the item of each entry
    terms: np.ndarray  # sorted
    begins: np.ndarray  # of each term's postings
    item: np.ndarray
    score: np.ndarray
    most: np.ndarray  # the largest score of each term
    block_most: np.ndarray  # the largest score of each term in each block of items; one row of zeros more

    @classmethod
    def build(
        cls, ids: list, texts: list[str], df: dict[int, int], n_items: int, mean: float, pieces: bool = False
    ) -> "Index":
        hashes, at = _words(pa.array(texts, pa.string()))
        words = [hashes[at[i] : at[i + 1]] for i in range(len(ids))]
        entries = [(i, e) for i, w in enumerate(words) for e in (pieces_of(w) if pieces else [w])]
        rows = []
        for i, (_, w) in enumerate(entries):
            term, tf = np.unique(w, return_counts=True)
            if not len(term):
                continue
            n = np.array([df[int(t)] for t in term.view(np.int64)])
            idf = np.log(1 + (n_items - n + 0.5) / (n + 0.5))
            score = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(w) / mean))
            rows.append((term, np.full(len(term), i), score / score.sum()))
        if not rows:
            rows = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0))]
        term, item, score = (np.concatenate(c) for c in zip(*rows))
        order = np.lexsort((item, term))
        term, item, score = term[order], item[order], score[order]
        terms, begins = np.unique(term, return_index=True)
        begins = np.append(begins, len(term))
        most = np.maximum.reduceat(score, begins[:-1]) if len(terms) else score
        block_most = np.zeros((len(terms) + 1, max(1, -(-len(entries) // BLOCK))), np.float32)
        np.maximum.at(block_most, (np.repeat(np.arange(len(terms)), np.diff(begins)), item // BLOCK), score)
        # Rounded up, so that single precision never undercuts a score.
        block_most = np.nextafter(block_most, np.float32(2)) * (block_most > 0)
        return cls(ids, words, [i for i, _ in entries], terms, begins, item, score, most, block_most)

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """The term number of each word, -1 where no item has it."""
        if not len(self.terms):
            return np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, -1)

    def search(self, query: np.ndarray, threshold: float) -> list[tuple[int, float]]:
        """All entries whose score reaches ``threshold``, by document-at-a-time block-max WAND.

        Cursors stand in the postings of the query's terms in order of item. The pivot is the
        first item at which the maxima of the terms up to it reach the threshold. If the
        maxima of those terms in the pivot's block do not, the whole block is left behind.
        """
        place = {int(t): int(self.begins[t]) for t in query}
        end = {t: int(self.begins[t + 1]) for t in place}
        found = []

        def seek(t: int, target: int) -> None:
            place[t] += int(np.searchsorted(self.item[place[t] : end[t]], target))

        while True:
            live = sorted((t for t in place if place[t] < end[t]), key=lambda t: (self.item[place[t]], t))
            total, pivot = 0.0, None
            for k, t in enumerate(live):
                total += self.most[t]
                if total >= threshold - 1e-9:
                    pivot = k
                    break
            if pivot is None:
                return found
            item = int(self.item[place[live[pivot]]])
            while pivot + 1 < len(live) and self.item[place[live[pivot + 1]]] == item:
                pivot += 1
            upto = live[: pivot + 1]
            if float(self.block_most[upto, item // BLOCK].sum()) < threshold - 1e-6:
                target = (item // BLOCK + 1) * BLOCK
                if pivot + 1 < len(live):
                    target = min(target, int(self.item[place[live[pivot + 1]]]))
                for t in upto:
                    seek(t, max(target, item + 1))
            elif self.item[place[upto[0]]] == item:
                score = sum(float(self.score[place[t]]) for t in upto)
                if score >= threshold:
                    found.append((item, score))
                for t in upto:
                    place[t] += 1
            else:
                for t in upto:
                    if self.item[place[t]] < item:
                        seek(t, item)

    def promising(self, term: np.ndarray, first: np.ndarray, end: np.ndarray, threshold: float) -> np.ndarray:
        """The passages of which some block's maxima reach the threshold, each term counted once.

        The same bound as in the search, taken for many passages together.
        """
        if not len(self.terms):
            return np.zeros(0, np.int64)
        most = np.append(self.most, 0.0)[term]
        before = np.concatenate(([0.0], np.cumsum(most)))
        some = np.flatnonzero(before[end] - before[first] >= threshold - 1e-6)
        earlier = _previous(term)
        out = []
        for part in np.array_split(some, len(some) // 2048 + 1):
            at = first[part, None] + np.arange(PASSAGE)
            inside = at < end[part, None]
            at = np.minimum(at, len(term) - 1)
            now = np.where(inside & (earlier[at] < first[part, None]), term[at], -1)
            bound = self.block_most[now[:, 0]].copy()
            for k in range(1, PASSAGE):
                bound += self.block_most[now[:, k]]
            out.append(part[bound.max(axis=1) >= threshold - 1e-4])
        return np.concatenate(out)


def _previous(term: np.ndarray) -> np.ndarray:
    """Where each word's term occurred last before in the batch, or -1."""
    order = np.argsort(term, kind="stable")
    out = np.full(len(term), -1)
    same = term[order[1:]] == term[order[:-1]]
    out[order[1:][same]] = order[:-1][same]
    return out


def _share(part: np.ndarray, text: np.ndarray) -> float:
    size = min(NGRAM, len(part))
    wanted = shingles(part, size)
    have = shingles(text, size) if len(text) >= size else text[:0]
    return float(np.isin(wanted, have).mean())


def _passages(begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, end) of every passage; the last one of a text ends with it."""
    n = np.diff(begins)
    count = np.where(n == 0, 0, 1 + np.maximum(0, -(-(n - PASSAGE) // STEP)))
    owner = np.repeat(np.arange(len(n)), count)
    number = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    first = begins[:-1][owner] + number * STEP
    return owner, first, np.minimum(first + PASSAGE, begins[1:][owner])


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    score: float = SCORE,
    overlap: float = OVERLAP,
    shard_bytes: int = SHARD_BYTES,
    least_words: int = LEAST_WORDS,
) -> DataFrame:
    """Verified (doc_id, item_id, first_word, n_words, score, question_overlap, answer_overlap).

    One row per row of ``docs`` (doc_id, text) and leaked item of ``benchmark`` (item_id,
    text), with the best passage (ties: the first). Words are runs of letters and digits,
    lower case. Null or empty texts and items match nothing; repeated rows each get their
    rows; items that occur twice are reported by each id. An item of any length may lie
    anywhere. The score is that of the whole item where a passage reaches the threshold
    with it, else that of the item's best piece; an item is always verified as a whole. Items
    of fewer than ``least_words`` words match nothing. Very long texts are searched whole.
    Other columns of both tables are not read.

    The index is sent to the workers in shards of bounded size, a bounded number of them at
    once, and what these found is stored before the next ones are built; document
    frequencies, item count and mean length cover the whole benchmark.
    """
    spark = docs.sparkSession
    long_enough = F.size(F.filter(F.split("text", "[^0-9A-Za-z\\x{80}-\\x{10FFFF}]+"), lambda w: w != "")) >= least_words
    items = benchmark.where(long_enough).select("item_id", "text")

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            hashes, at = _words(batch.column("text"))
            for i in range(batch.num_rows):
                w = hashes[at[i] : at[i + 1]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([len(w)]), pa.array([np.unique(w).view(np.int64)], pa.list_(pa.int64()))], names=["n", "terms"]
                )

    counted = items.mapInArrow(terms, "n long, terms array<long>")
    total = counted.agg(F.count("*").alias("items"), F.avg("n").alias("mean")).first()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    frequencies = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    n_shards = max(1, -(-size // shard_bytes))
    shard = F.pmod(F.xxhash64(F.col("item_id").cast("string"), F.col("text")), F.lit(n_shards))
    id_type = benchmark.schema["item_id"].dataType.simpleString()
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    numbered = items.withColumn("shard", shard)
    out = None
    for low in range(0, n_shards, SHARDS_AT_ONCE):
        part = numbered.where(F.col("shard").between(low, low + SHARDS_AT_ONCE - 1))
        own = part.mapInArrow(terms, "n long, terms array<long>").select(F.explode("terms").alias("term")).distinct()
        df = {r.term: r.df for r in own.join(frequencies, "term").collect()}
        rows = part.orderBy(F.col("item_id").asc_nulls_first(), "text").collect()
        indexes = []
        for k in range(low, min(n_shards, low + SHARDS_AT_ONCE)):
            mine = [r for r in rows if r.shard == k]
            own = [r.item_id for r in mine], [r.text for r in mine], df, total["items"], total.mean or 1.0
            indexes.append((Index.build(*own), Index.build(*own, pieces=True)))
        held = spark.sparkContext.broadcast(indexes)
        found = docs.select("doc_id", "text").mapInArrow(
            _searcher(held, score, overlap, docs.select("doc_id").schema, benchmark.select("item_id").schema),
            f"doc_id {doc_type}, item_id {id_type}, first_word long, n_words long, score double, "
            "question_overlap double, answer_overlap double",
        )
        if n_shards > SHARDS_AT_ONCE:
            found = stored(found, "leaks")
            held.unpersist()
        out = found if out is None else out.unionByName(found)
    return out


def _searcher(held, threshold: float, overlap: float, doc_schema, item_schema):
    from pyspark.sql.pandas.types import to_arrow_schema

    doc_type, item_type = to_arrow_schema(doc_schema).field(0).type, to_arrow_schema(item_schema).field(0).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            hashes, begins = _words(batch.column("text"))
            passages = _passages(begins)
            for index, pieces in held.value:
                whole = _leaks(index, hashes, begins, passages, threshold, overlap)
                found = _leaks(pieces, hashes, begins, passages, threshold, overlap, whole) | whole
                if not found:
                    continue
                keys = sorted(found)
                ids = batch.column("doc_id").take(pa.array([d for d, _ in keys])).cast(doc_type)
                columns = list(zip(*(found[k] for k in keys)))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([index.items[i] for _, i in keys], item_type)]
                    + [pa.array(c, pa.int64()) for c in columns[:2]]
                    + [pa.array(np.round(c, 6), pa.float64()) for c in columns[2:]],
                    names=["doc_id", "item_id", "first_word", "n_words", "score", "question_overlap", "answer_overlap"],
                )

    return run


def _leaks(
    index: Index, hashes, begins, passages, threshold: float, overlap: float, done: Container = ()
) -> dict[tuple[int, int], tuple]:
    """The best verified passage of each (text, item) of a batch that is not among those done."""
    owner, first, end = passages
    term = index.lookup(hashes)
    longest = max((len(w) for w in index.words), default=0)
    best: dict[tuple[int, int], tuple] = {}
    for p in index.promising(term, first, end, threshold):
        query = np.unique(term[first[p] : end[p]])
        doc = int(owner[p])
        hits: dict[int, float] = {}
        for entry, score in index.search(query[query >= 0], threshold):
            hits[index.owner[entry]] = max(score, hits.get(index.owner[entry], 0.0))
        for item, score in hits.items():
            known = best.get((doc, item))
            if (doc, item) in done or known and known[2] >= score:
                continue
            low = max(int(begins[doc]), int(first[p]) - longest)
            high = min(int(begins[doc + 1]), int(end[p]) + longest)
            text = hashes[low:high]
            shares = [_share(part, text) for part in question_and_answer(index.words[item])]
            if min(shares) >= overlap:
                best[doc, item] = (int(first[p] - begins[doc]), int(end[p] - first[p]), score, *shares)
    return best
