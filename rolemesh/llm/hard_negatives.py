"""Hard negatives by a multiway hyperplane tree with distance ranges.

Vectors are lifted onto one sphere: a further coordinate sqrt(M^2 - |x|^2) makes all norms M,
and with 0 in that place an anchor's distance to x falls as their inner product grows. A
window of scores is then an annulus around the anchor.

Every node of the tree has up to FAN split points; a vector goes to the nearest of them. For
each split point and each sibling subtree the node stores the least and the largest distance
from the point to the vectors below. A sibling is left out when that range and the
anchor's annulus, moved by the anchor's distance to the split point, do not meet. What is left
are leaves, and those are searched exactly.

The split points are chosen from a sample of at most SAMPLE vectors; all vectors are sorted
into the tree and all of them count for the ranges. Leaves are cut into blocks of about BLOCK
vectors and anchors into chunks of about CHUNK; a block and a chunk meet in one task, so no
group grows with the data, however many equal vectors there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import stored
from .whitening import grid_vectors, matrix

FAN = 12
SAMPLE = 8_192
LEAF_ROWS = 1_024  # rows of a leaf aimed at, as far as the sample can tell
LEAST_SAMPLE = 24  # sample rows below which a node is not split
BLOCK = 4_096
CHUNK = 1_024
POSITIVES, NEGATIVES = 5, 5
LEAST, PARTS = 80, 100  # a negative's score is at least 80 hundredths of the positive's


class Tree:
    """Split points of all nodes; children are numbers of nodes, or leaves as ~number."""

    def __init__(self, sample: np.ndarray, top: float, leaf: int):
        self.top = top  # M^2
        self.points: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.paths: list[list[tuple[int, int]]] = []  # of each leaf: (node, branch) from the root
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self._grow(sample, leaf, [])

    def _grow(self, sample: np.ndarray, leaf: int, path: list[tuple[int, int]]) -> int:
        points = self._split(sample) if len(sample) >= leaf else sample[:0]
        if len(points) < 2:
            self.paths.append(path)
            return ~(len(self.paths) - 1)
        node = len(self.points)
        self.points.append(points)
        self.children.append([])
        near = self.distances(points, sample, True).argmin(axis=0)
        for j in range(len(points)):
            self.children[node].append(self._grow(sample[near == j], leaf, [*path, (node, j)]))
        return node

    def _split(self, sample: np.ndarray) -> np.ndarray:
        """Up to FAN split points, each the farthest of a few candidates from those before."""
        some = sample[:: max(1, len(sample) // (3 * FAN))]
        chosen = [0]
        away = self.distances(some[:1], some, True)[0]
        while len(chosen) < FAN and away.max() > 1e-6 * (1 + np.sqrt(self.top)):
            chosen.append(int(away.argmax()))
            away = np.minimum(away, self.distances(some[chosen[-1:]], some, True)[0])
        return some[chosen]

    def distances(self, points: np.ndarray, others: np.ndarray, lifted: bool) -> np.ndarray:
        """From split points to vectors, both lifted, or to anchors (whose lift is 0)."""
        p, x = points.astype(float), others.astype(float)
        dots = p @ x.T
        if lifted:
            a = np.sqrt(np.maximum(self.top - (p * p).sum(axis=1), 0))
            b = np.sqrt(np.maximum(self.top - (x * x).sum(axis=1), 0))
            dots += a[:, None] * b[None]
            square = 2 * self.top - 2 * dots
        else:
            square = (x * x).sum(axis=1)[None] + self.top - 2 * dots
        return np.sqrt(np.maximum(square, 0))

    def slack(self) -> float:
        """More than rounding can add to a distance."""
        return 1e-6 * (1 + float(np.sqrt(self.top)))

    def placed(self, x: np.ndarray, lifted: bool = True, ranges: dict | None = None) -> np.ndarray:
        """Leaves of vectors; ``ranges`` gets the least and largest distances met on the way."""
        leaves = np.zeros(len(x), np.int32)
        todo = [(0 if self.points else ~0, np.arange(len(x)))]
        while todo:
            node, own = todo.pop()
            if node < 0:
                leaves[own] = ~node
                continue
            away = self.distances(self.points[node], x[own], lifted)
            near = away.argmin(axis=0)
            for j, child in enumerate(self.children[node]):
                here = near == j
                if not here.any():
                    continue
                if ranges is not None:
                    part = away[:, here]
                    for i in range(len(away)):
                        lo, hi = ranges.get((node, i, j), (np.inf, -np.inf))
                        ranges[node, i, j] = min(lo, part[i].min()), max(hi, part[i].max())
                todo.append((child, own[here]))
        return leaves

    def set_ranges(self, found: list[tuple[int, int, int, float, float]]) -> None:
        self.low = [np.full((len(p), len(p)), np.inf) for p in self.points]
        self.high = [np.full((len(p), len(p)), -np.inf) for p in self.points]
        for node, i, j, lo, hi in found:
            self.low[node][i, j], self.high[node][i, j] = lo, hi

    def reached(self, anchors: np.ndarray, inner: np.ndarray, outer: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, anchors) where some window of an anchor may hold vectors of the leaf.

        ``inner`` and ``outer`` are the radii of windows, a row per anchor; a window whose
        outer radius is negative holds nothing.
        """
        spare = self.slack()
        inner, outer = np.maximum(inner - spare, 0), np.where(outer < 0, -np.inf, outer + spare)
        todo = [(0 if self.points else ~0, np.flatnonzero((outer >= 0).any(axis=1)))]
        while todo:
            node, own = todo.pop()
            if not len(own):
                continue
            if node < 0:
                yield ~node, own
                continue
            away = self.distances(self.points[node], anchors[own], False)
            low, high = self.low[node], self.high[node]
            alive = np.zeros((len(own), len(low)), bool)
            for r1, r2 in zip(inner[own].T, outer[own].T):  # a window of each anchor at a time
                least = np.maximum(away - r2, r1 - away)  # [split point, anchor]
                most = away + r2
                fits = (low[:, None] <= most[:, :, None]) & (high[:, None] >= least[:, :, None])
                alive |= fits.all(axis=0) & (r2 >= 0)[:, None]
            for j, child in enumerate(self.children[node]):
                todo.append((child, own[alive[:, j]]))


def radius(square: np.ndarray, top: float, score: np.ndarray) -> np.ndarray:
    """Distance of a lifted vector from an anchor, by their inner product."""
    return np.sqrt(np.maximum(square + top - 2.0 * score, 0))


def inner_products(a: np.ndarray, b: np.ndarray, bound: int) -> np.ndarray:
    """Exact integer products; ``bound`` is an upper bound of their size."""
    if bound < 1 << 53:
        return a.astype(float) @ b.astype(float).T
    if bound < 1 << 63:
        return a @ b.T
    raise OverflowError("inner products exceed 64 bits")


def best(scores: np.ndarray, allowed: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each row the columns of its k best allowed scores; of equal ones the first columns."""
    lowest = np.iinfo(np.int64).min if scores.dtype.kind == "i" else -np.inf
    key = np.where(allowed, scores, lowest)
    if key.shape[1] > k:
        least = np.partition(key, key.shape[1] - k, axis=1)[:, key.shape[1] - k]
        allowed = allowed & (key >= least[:, None])
    for i in np.flatnonzero(allowed.any(axis=1)):
        at = np.flatnonzero(allowed[i])
        yield i, at[np.argsort(-key[i, at], kind="stable")[:k]]


# --- tables ----------------------------------------------------------------------


def _vectors(rows: DataFrame, anchor: Column) -> DataFrame:
    """(rid, vec_id, label, anchor, x) of the usable rows; rid tells rows apart."""
    own = rows.select("vec_id", "label", F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col("embedding").alias("vector"))
    cells = grid_vectors(own.where("label is not null"), "vector")
    return stored(cells.select(F.monotonically_increasing_id().alias("rid"), "vec_id", "label", "anchor", "x"), "vectors")


def _with_leaf(rows: DataFrame) -> T.StructType:
    return T.StructType([*rows.schema.fields, T.StructField("leaf", T.IntegerType())])


def build_tree(rows: DataFrame, total: int) -> tuple[Tree, int]:
    """A tree over the stored vectors with ranges from all of them, and a bound of |inner product|."""
    squares = rows.select(
        F.aggregate("x", F.lit(0.0), lambda s, v: s + v.cast("double") * v).alias("square"), F.size("x").alias("d"),
        F.greatest(F.array_max("x"), -F.array_min("x")).alias("largest"),
    )
    most = squares.agg(F.max("square").alias("top"), F.max("d").alias("d"), F.max("largest").alias("largest")).first()
    picked = rows.select("rid", "x").orderBy(F.xxhash64("rid"), "rid").limit(SAMPLE).collect()
    sample = np.unique(np.array([r.x for r in picked], np.int64), axis=0)
    np.random.default_rng(3).shuffle(sample)
    # As many sample rows in a leaf as stand for LEAF_ROWS rows.
    leaf = max(LEAST_SAMPLE, 2 * len(picked) * LEAF_ROWS // max(total, 1))
    tree = Tree(sample, float(most.top), leaf)
    sent = rows.sparkSession.sparkContext.broadcast(tree)

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict = {}
        for batch in batches:
            if batch.num_rows:
                sent.value.placed(matrix(batch.column("x"), batch.num_rows), True, met)
        if met:
            columns = zip(*((*k, *v) for k, v in met.items()))
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["node", "i", "j", "lo", "hi"])

    found = (
        rows.select("x").mapInArrow(ranges, "node int, i int, j int, lo double, hi double")
        .groupBy("node", "i", "j").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    )
    tree.set_ranges([tuple(r) for r in found.collect()])
    return tree, int(most.d) * int(most.largest) ** 2


def _placed(rows: DataFrame, tree: Tree) -> DataFrame:
    """``rows`` with the leaf of each vector and the block of the leaf that it is dealt to."""
    sent = rows.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaf = sent.value.placed(matrix(batch.column("x"), batch.num_rows))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=[*batch.schema.names, "leaf"])

    placed = stored(rows.mapInArrow(run, _with_leaf(rows)), "placed")
    blocks = placed.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = placed.join(F.broadcast(blocks), "leaf")  # as many rows as the tree has leaves
    return stored(dealt.withColumn("block", F.pmod(F.xxhash64("rid"), "blocks").cast("int")), "blocks")


def _chunks(anchors: DataFrame) -> DataFrame:
    """Anchors in chunks of about CHUNK: neighbouring leaves share one, a large leaf has several."""
    counts = sorted(tuple(r) for r in anchors.groupBy("leaf").count().collect())  # one row per leaf
    spans, chunk, filled = [], 0, 0
    for leaf, n in counts:
        if filled and filled + n > CHUNK:
            chunk, filled = chunk + 1, 0
        parts = max(1, -(-n // CHUNK))
        spans.append((leaf, chunk, parts))
        chunk, filled = (chunk, filled + n) if parts == 1 else (chunk + parts, 0)
    table = anchors.sparkSession.createDataFrame(spans, "leaf int, first int, parts int")
    return anchors.join(F.broadcast(table), "leaf").withColumn(
        "chunk", (F.col("first") + F.pmod(F.xxhash64("rid"), "parts")).cast("int")
    )


def _reached(asking: DataFrame, tree: Tree, blocks: DataFrame) -> DataFrame:
    """(chunk, leaf, block) rows of the anchors that a block may answer.

    ``asking`` has (chunk, rid, label, x, wants), wants being windows (least, most) of scores.
    """
    sent = asking.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            tree = sent.value
            x = matrix(batch.column("x"), batch.num_rows)
            square = (x.astype(float) ** 2).sum(axis=1)
            wants = batch.column("wants").to_pylist()
            width = max(1, max(map(len, wants)))
            inner, outer = np.zeros((len(x), width)), np.full((len(x), width), -1.0)
            for i, own in enumerate(wants):
                for k, w in enumerate(own):
                    if w["most"] is not None:
                        inner[i, k] = radius(square[i], tree.top, float(w["most"]))
                    outer[i, k] = np.inf if w["least"] is None else radius(square[i], tree.top, float(w["least"]))
            for leaf, own in tree.reached(x, inner, outer):
                part = batch.take(pa.array(own))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(np.full(len(own), leaf, np.int32))], names=[*batch.schema.names, "leaf"]
                )

    met = asking.mapInArrow(run, _with_leaf(asking))
    return met.join(F.broadcast(blocks), "leaf").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")


_LIMITS = np.iinfo(np.int64)
_FOUND = "rid long, place int, other long, other_id {id}, score long"


def _search(asked: DataFrame, placed: DataFrame, same: bool, k: int, bound: int) -> DataFrame:
    """Best k rows per anchor, window and block: of the anchor's label, or of all others.

    (rid, place of the window, other, other_id, score), then cut to the k best of all blocks.
    """
    keys, theirs = ["chunk", "leaf", "block"], ["in_chunk", "in_leaf", "in_block"]
    met = asked.select(*(F.col(k).alias(t) for k, t in zip(keys, theirs))).distinct()
    offered = placed.select(F.col("leaf").alias("in_leaf"), F.col("block").alias("in_block"), F.col("rid").alias("other"), F.col("vec_id").alias("other_id"), F.col("label").alias("other_label"), F.col("x").alias("other_x"))
    offered = offered.join(met, theirs[1:])
    kind = placed.schema["vec_id"].dataType.simpleString()

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.take(pc.sort_indices(right, [("other_id", "ascending"), ("other", "ascending")], null_placement="at_end"))
        other, label = right.column("other").to_numpy(), right.column("other_label").to_numpy()
        rid, own = left.column("rid").to_numpy(), left.column("label").to_numpy()
        ids = right.column("other_id").combine_chunks()
        out: list[tuple] = []
        if len(left) and len(right):
            a = matrix(left.column("x").combine_chunks(), len(left))
            b = matrix(right.column("other_x").combine_chunks(), len(right))
            scores = inner_products(a, b, bound)
            fits = (own[:, None] == label[None]) == same
            if same:
                fits &= rid[:, None] != other[None]
            wants = left.column("wants").to_pylist()
            for place in range(max(map(len, wants))):
                windows = [w[place] if place < len(w) else {"least": 1, "most": 0} for w in wants]
                least = np.array([_LIMITS.min if w["least"] is None else w["least"] for w in windows], np.int64)
                most = np.array([_LIMITS.max if w["most"] is None else w["most"] for w in windows], np.int64)
                allowed = fits & (scores >= least[:, None]) & (scores <= most[:, None])
                for i, at in best(scores, allowed, k):
                    out.append((np.full(len(at), rid[i]), np.full(len(at), place, np.int32), at, scores[i, at].astype(np.int64)))
        if not out:
            out = [(np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        rids, places, at, score = (np.concatenate(c) for c in zip(*out))
        return pa.table(
            {"rid": rids, "place": places, "other": other[at], "other_id": ids.take(pa.array(at)), "score": score}
        )

    found = (
        asked.groupBy(*keys).cogroup(offered.groupBy(*theirs)).applyInArrow(search, _FOUND.format(id=kind))
    )
    order = Window.partitionBy("rid", "place").orderBy(F.col("score").desc(), F.col("other_id").asc_nulls_last(), "other")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    rows: DataFrame,
    anchor: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    least: int = LEAST,
    parts: int = PARTS,
) -> DataFrame:
    """Hard negatives of the rows (vec_id, label, embedding) for which ``anchor`` holds.

    Scores are inner products of the vectors floor(256 c). An anchor's positives are its
    ``positives`` best other rows of the same label; for each, the ``negatives`` best rows of
    other labels with least * positive <= parts * negative <= parts * positive. Ties go to
    the smaller vec_id, null last. Returns anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score.

    Rows with a null label, or without a vector of finite entries, take no part, nor do
    vectors of another length than most rows have. Equal rows and repeated or null ids are
    rows of their own. A positive without a negative, an anchor without a positive and an
    empty table give no rows. Other columns of ``rows`` are not read.
    """
    vectors = _vectors(rows, anchor)
    total = vectors.count()
    kind = rows.schema["vec_id"].dataType.simpleString()
    out = f"anchor_id {kind}, positive_id {kind}, rank int, negative_id {kind}, positive_score long, negative_score long"
    if not total:
        return rows.sparkSession.createDataFrame([], out)
    tree, bound = build_tree(vectors, total)
    placed = _placed(vectors, tree)
    blocks = stored(placed.select("leaf", "blocks").distinct(), "leaves")
    wants = "array<struct<least:long,most:long>>"
    anchors = stored(
        _chunks(placed.where("anchor").select("rid", "vec_id", "label", "x", "leaf", "block")), "anchors"
    ).select("chunk", "rid", "label", "x", "leaf", "block", "vec_id")

    # A first look at the anchor's own block tells from which score on others matter.
    everything = F.array(F.struct(F.lit(None).cast("long").alias("least"), F.lit(None).cast("long").alias("most"))).cast(wants)
    first = _search(anchors.withColumn("wants", everything).drop("vec_id"), placed, True, positives, bound)
    enough = first.groupBy("rid").agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(F.col("n") >= positives)
    asking = anchors.drop("leaf", "block", "vec_id").join(enough.select("rid", "floor"), "rid", "left").select(
        "chunk", "rid", "label", "x",
        F.array(F.struct(F.col("floor").alias("least"), F.lit(None).cast("long").alias("most"))).cast(wants).alias("wants"),
    )
    good = stored(_search(_reached(asking, tree, blocks), placed, True, positives, bound), "positives")

    # From the positives' scores on: 80 p <= 100 n is n >= ceil(80 p / 100); div cuts towards 0.
    p = F.col("score")
    lowest = F.expr(f"if(score > 0, (score * {least}L + {parts - 1}L) div {parts}L, (score * {least}L) div {parts}L)")
    windows = good.groupBy("rid").agg(
        F.array_sort(F.collect_list(F.struct("rank", lowest.alias("least"), p.alias("most")))).alias("w")
    )
    asking = anchors.drop("leaf", "block", "vec_id").join(windows, "rid").select(
        "chunk", "rid", "label", "x",
        F.transform("w", lambda w: F.struct(
            F.when(w["least"] <= w["most"], w["least"]).otherwise(w["most"] + 1).alias("least"), w["most"].alias("most")
        )).cast(wants).alias("wants"),
    )
    bad = _search(_reached(asking, tree, blocks), placed, False, negatives, bound)
    ends = good.select("rid", (F.col("rank") - 1).alias("place"), F.col("other_id").alias("positive_id"), p.alias("positive_score"))
    return (
        bad.select("rid", "place", "rank", F.col("other_id").alias("negative_id"), F.col("score").alias("negative_score"))
        .join(ends, ["rid", "place"])
        .join(anchors.select("rid", F.col("vec_id").alias("anchor_id")), "rid")
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
