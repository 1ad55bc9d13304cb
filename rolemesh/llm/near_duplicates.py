"""Exact Jaccard join of word n-gram sets with a count-vector R-tree.

Every text becomes a set of hashed n-grams. The n-grams are hashed into groups; the number
of members per group is a point, and the sum of the coordinate minima of two points bounds
the size of their overlap from above. R-trees over the points find the pairs whose bound
reaches the overlap that the threshold asks for, and those pairs are verified on their sets.

One tree over everything would visit nearly all of it: hashed counts of unrelated texts lie
equally far apart, so the boxes of inner nodes overlap. The trees are therefore built in
blocks that lose no link. For a class of set sizes the hash space is cut into more parts
than two linked sets can differ in n-grams; so at least one part is equal in both, and texts
meet in a block for every part that is. A block of unrelated texts is rare, even where they
share a long passage, as all n-grams of the part have to agree.

Equal sets are folded into one node first. Then members of a block are compared with its
smallest node, and links are joined to components. Blocks that still hold more than one
component are put together to clusters, so that two texts meet once however many blocks they
share. The members of a cluster are cut into tiles by size; a pair of tiles is one task, which
builds trees over points with two groups or more for every n-gram, tests what the bound
lets through, and hands on links that join components, never more than it has members.

Sets travel to the tiles as the low halves of their hashes. Two halves may agree where the
hashes differ, so such a test misses no link but may let a pair through that is none: the links
handed on are verified on whole hashes, and if one fails, the tiles are met with whole hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bits import bit_filter, passes
from .components import connected
from .store import stored
from .words import hash_words, mix, shingles, slices

TILE = 4_096  # members of a cluster that meet in one task, at most about so many
TILE_NGRAMS = 1 << 21  # and at most about so many n-grams of theirs; or one longer text
DENSE = 0.02  # share of a tree's pairs of points from which on the bound is a matrix product
STRIP = 512  # rows of such a product at once
SEEN = 100_000  # sets that a task remembers to list copies once
_CLASS_GROWTH = 1.6
_DELETIONS = 2  # up to so many differences, sets with members left out are listed instead of parts


def _u(x: int) -> np.uint64:
    return np.uint64(x & 0xFFFFFFFFFFFFFFFF)


def size_classes(limit: int = 1 << 40) -> np.ndarray:
    """Smallest sizes of the classes."""
    out = [1]
    while out[-1] < limit:
        out.append(max(out[-1] + 1, int(out[-1] * _CLASS_GROWTH)))
    return np.array(out, np.int64)


_CLASSES = size_classes()


def block_keys(members: np.ndarray, num: int, den: int) -> np.ndarray:
    """Keys of the blocks of a set, so that sets with Jaccard >= num/den share at least one.

    In a class whose largest size is S, linked sets differ in at most
    r = 2 S (den - num) / (den + num) members, and this set differs from one it links with
    there in at most ``own_r``, by its own size. A set enters its own class and each larger
    one in which it could have a partner, with the first own_r + 1 of its filled parts in an
    order that holds for all sets: one of them is equal in the partner. Of two linked sets, the
    one whose listed parts end first thus shares one that the other lists as well. Parts with
    many members come first, as unrelated sets with a passage in common agree in small ones.
    """
    n = len(members)
    own = int(np.searchsorted(_CLASSES, n, "right")) - 1
    scrambled = mix(members ^ _u(0x5851F42D4C957F2D))
    out = []
    for c in range(own, len(_CLASSES) - 1):
        if int(_CLASSES[c]) * num > n * den:
            break
        r = 2 * (int(_CLASSES[c + 1]) - 1) * (den - num) // (den + num)
        tag = _u((c + 1) * 0x9E3779B97F4A7C15)
        if r <= _DELETIONS:
            whole = scrambled.sum(dtype=np.uint64)
            keys = [np.array([whole], np.uint64)]
            if r >= 1:
                keys.append(whole - scrambled)
            if r >= 2:
                one, two = np.triu_indices(n, 1)
                keys.append(whole - scrambled[one] - scrambled[two])
            out.append(np.unique(mix(np.concatenate(keys) + tag)))
            continue
        parts = r + 3 + r // 6
        at = ((members >> np.uint64(32)) * _u(parts)) >> np.uint64(32)
        begins = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        keys = np.add.reduceat(scrambled, begins) + at[begins] * _u(0xD1342543DE82EF95)
        most = min(int(_CLASSES[c + 1]) - 1, n * den // num)
        own_r = (n + max(n, most)) * (den - num) // (den + num)
        if len(begins) <= own_r:  # empty parts could be the only equal ones
            empty = np.setdiff1d(np.arange(parts, dtype=np.uint64), at[begins])
            keys = np.concatenate((keys, empty * _u(0xD1342543DE82EF95) + _u(0xA0761D6478BD642F)))
        else:
            members_of = np.diff(begins, append=n)
            keys = keys[np.lexsort((keys, -members_of))[: own_r + 1]]
        out.append(mix(keys + tag))
    return np.concatenate(out)


def _sets(batch: pa.RecordBatch, size: int) -> Iterator[np.ndarray]:
    hashes, begins = hash_words(batch.column("text"))
    for i in range(batch.num_rows):
        yield shingles(hashes[begins[i] : begins[i + 1]], size)


def _node(members: np.ndarray) -> tuple[int, int]:
    """A 64-bit name of a set and a second, independent hash to notice clashes."""
    name = mix(mix(members + _u(0x1D8E4E27C47D124F)).sum(dtype=np.uint64, keepdims=True) + _u(len(members)))
    other = mix(members ^ _u(0xC2B2AE3D27D4EB4F)).sum(dtype=np.uint64, keepdims=True)
    return int(name.view(np.int64)[0]), int(other.view(np.int64)[0])


def _scan(docs: DataFrame, size: int, num: int, den: int) -> tuple[DataFrame, frozenset[int]]:
    """(doc_id, n_shingles, node, h, keys, point) of every row, stored; and the clashing names.

    The only reading of all texts: the set's name (null for an empty set), the row's hash,
    and, for most copies within a task once, the keys of its blocks and its point. Two
    different sets share a 64-bit name once in 2^64 pairs: a handful of names however large
    the corpus. Those sets go by their second hash instead.
    """

    def run(batches):
        seen = set()
        for batch in slices(batches, "text"):
            if len(seen) > SEEN:
                seen.clear()
            n, node, other, keys, points = [], [], [], [], []
            for members in _sets(batch, size):
                one, two = _node(members) if len(members) else (None, None)
                new = one is not None and (one, two) not in seen
                seen.add((one, two))
                n.append(len(members))
                node.append(one)
                other.append(two)
                keys.append(block_keys(members, num, den).view(np.int64) if new else None)
                points.append(packed(point_of(members)) if new else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("h"), pa.array(n, pa.int64()), pa.array(node, pa.int64())]
                + [pa.array(other, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(points, pa.binary())],
                names=["doc_id", "h", "n_shingles", "node", "other", "keys", "point"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, h long, n_shingles long, node long, other long, keys array<long>, point binary"
    found = stored(docs.select("doc_id", F.xxhash64("doc_id", "text").alias("h"), "text").mapInArrow(run, schema), "sets")
    twice = found.groupBy("node").agg(F.min("other").alias("x"), F.max("other").alias("y")).where("x <> y")
    clashed = frozenset(r.node for r in twice.select("node").collect())
    name = F.when(F.col("node").isin(*clashed), F.col("other")).otherwise(F.col("node")) if clashed else F.col("node")
    return found.withColumn("node", name).drop("other"), clashed


def _shared_blocks(found: DataFrame) -> DataFrame:
    """(key, node, low) of the blocks that several sets share; low is the block's smallest node.

    Grouped minima and maxima find the shared keys, and the sets are read once more for those
    alone: no block meets in one task, however many texts it has.
    """
    listed = found.where("keys is not null").select("node", "keys")
    ends = listed.select("node", F.explode("keys").alias("key")).groupBy("key").agg(
        F.min("node").alias("low"), F.max("node").alias("high")
    )
    keys = stored(ends.where("low <> high").select("key", "low"), "keys")
    among = found.sparkSession.sparkContext.broadcast(bit_filter(keys, "key"))

    def run(batches):
        for batch in batches:
            column = batch.column("keys")
            counts = pc.list_value_length(column).to_numpy()
            key = pc.list_flatten(column).to_numpy()
            node = np.repeat(batch.column("node").to_numpy(), counts)
            kept = passes(among.value, key)
            yield pa.RecordBatch.from_arrays([pa.array(key[kept]), pa.array(node[kept])], names=["key", "node"])

    rows = listed.mapInArrow(run, "key long, node long")
    return stored(rows.join(keys, "key").distinct(), "blocks")


def _among(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of the given nodes; a bit filter leaves most others out before the exact join."""
    held = rows.sparkSession.sparkContext.broadcast(bit_filter(nodes, "node"))

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(passes(held.value, batch.column("node").to_numpy())))

    return rows.mapInArrow(run, rows.schema).join(nodes, "node", "left_semi")


def point_of(members: np.ndarray) -> np.ndarray:
    """Members per group, two groups or more for every member; counts fit four bits.

    The group is the low bits of the hash, so a point with more groups folds into one with fewer.
    """
    groups = 64
    while True:
        if groups >= 2 * len(members):
            point = np.bincount((members & _u(groups - 1)).astype(np.int64), minlength=groups)
            if point.max() < 16:
                return point.astype(np.uint8)
        groups *= 2


def packed(point: np.ndarray) -> bytes:
    """Two counts a byte: a point takes one to two bytes a member, its set eight."""
    return (point[0::2] | (point[1::2] << 4)).tobytes()


def unpacked(stored_point: bytes) -> np.ndarray:
    both = np.frombuffer(stored_point, np.uint8)
    return np.stack((both & 15, both >> 4), axis=1).reshape(-1)


def folded_point(point: np.ndarray, groups: int) -> np.ndarray:
    """A point as one of fewer groups."""
    return point.reshape(-1, groups).sum(axis=0, dtype=np.int32)


def half(members: np.ndarray) -> np.ndarray:
    """The low halves of a set's hashes, sorted; equal ones stay, as each stands for a member."""
    return np.sort(members.astype(np.uint32))


def _sets_of(
    docs: DataFrame, found: DataFrame, nodes: DataFrame, size: int, clashed: frozenset[int], halves: bool = False
) -> DataFrame:
    """(node, members) of the given nodes, each once; ``halves`` of their hashes if asked for.

    One row of each set is read again: a bit filter of their hashes travels to the scan, so
    that hardly any other text is looked at; the join that follows is exact.
    """
    texts = found.select("node", "h").join(nodes, "node", "left_semi").groupBy("node").agg(F.min("h").alias("h"))
    held = docs.sparkSession.sparkContext.broadcast(bit_filter(texts, "h"))

    def run(batches):
        seen = set()
        for batch in batches:
            batch = batch.filter(pa.array(passes(held.value, batch.column("h").to_numpy())))
            for part in slices([batch], "text") if batch.num_rows else ():
                if len(seen) > SEEN:
                    seen.clear()
                rows = []
                for own in _sets(part, size):
                    if len(own):
                        name, other = _node(own)
                        node = other if name in clashed else name
                        if node not in seen:
                            seen.add(node)
                            rows.append((node, (half(own) if halves else own).tobytes()))
                if rows:
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary()))]
                    yield pa.RecordBatch.from_arrays(columns, names=["node", "members"])

    sets = docs.select(F.xxhash64("doc_id", "text").alias("h"), "text").mapInArrow(run, "node long, members binary")
    return sets.join(nodes, "node", "left_semi").dropDuplicates(["node"])


def _bounded(pairs: DataFrame, points: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) whose sizes fit and whose points bound their overlap high enough."""

    def run(batches):
        for batch in batches:
            total = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("p_a").to_pylist(), batch.column("p_b").to_pylist())):
                one, two = unpacked(x), unpacked(y)
                groups = min(len(one), len(two))
                bound = int(np.minimum(folded_point(one, groups), folded_point(two, groups)).sum())
                keep[i] = bound * (den + num) >= int(total[i]) * num
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    def side(name, *columns):
        return points.select(F.col("node").alias(name), *(F.col(c).alias(f"{c[0]}_{name}") for c in columns))

    sized = (
        pairs.join(side("a", "n"), "a").join(side("b", "n"), "b")
        .where(F.least("n_a", "n_b") * den >= F.greatest("n_a", "n_b") * num)
    )
    return sized.join(side("a", "point"), "a").join(side("b", "point"), "b").mapInArrow(run, "a long, b long")


def linked(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    """Whether two sorted sets have a Jaccard similarity of num/den or more.

    For halves of hashes: whether they may have. What agrees in the halves counts as shared.
    """
    both = np.sort(np.concatenate((x, y)), kind="stable")
    same = int((both[1:] == both[:-1]).sum())
    return den * same >= num * (len(both) - same)


class _Verifier:
    """Exact tests of bounded pairs; a set is computed when a pair first needs it."""

    def __init__(self, docs: DataFrame, found: DataFrame, size: int, num: int, den: int, clashed: frozenset[int]):
        self.docs, self.found, self.clashed = docs, found, clashed
        self.size, self.num, self.den = size, num, den
        self.sets: DataFrame | None = None

    def sets_of(self, nodes: DataFrame) -> DataFrame | None:
        """(node, members) of the stored nodes and of all asked for before."""
        if self.sets is not None:
            nodes = nodes.join(self.sets.select("node"), "node", "left_anti")
        if nodes.limit(1).count():
            more = stored(_sets_of(self.docs, self.found, nodes, self.size, self.clashed), "sets")
            self.sets = more if self.sets is None else self.sets.unionByName(more)
        return self.sets

    def links(self, pairs: DataFrame) -> DataFrame:
        """The stored pairs (a, b) that link."""
        num, den = self.num, self.den
        pairs = stored(pairs, "bounded")
        nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        sets = self.sets_of(nodes)
        if sets is None:
            return pairs

        def exact(batches):
            for batch in batches:
                keep = np.zeros(batch.num_rows, bool)
                for i in range(batch.num_rows):
                    x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for c in ("m_a", "m_b"))
                    keep[i] = linked(x, y, num, den)
                yield batch.select(["a", "b"]).filter(pa.array(keep))

        one = sets.select(F.col("node").alias("a"), F.col("members").alias("m_a"))
        two = sets.select(F.col("node").alias("b"), F.col("members").alias("m_b"))
        return stored(pairs.join(one, "a").join(two, "b").mapInArrow(exact, "a long, b long"), "links")


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links: components of the components' roots."""
    ends = links.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left").join(
        roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left"
    )
    upper = connected(ends.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")), "merged")
    up = upper.select(F.col("node").alias("root"), F.col("root").alias("upper"))
    known = roots.join(up, "root", "left").select("node", F.coalesce("upper", "root").alias("root"))
    new = upper.join(roots.select("node"), "node", "left_anti").select("node", "root")
    return stored(known.unionByName(new), "roots")


class CountTree:
    """R-tree over count vectors: leaves in order of size, boxes by their largest coordinates."""

    FAN = 16

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        order = np.lexsort((points[:, 1], points[:, 0], sizes))
        self.order = order
        self.levels = [(points[order], sizes[order])]
        while len(self.levels[-1][0]) > 1:
            top, low = self.levels[-1]
            at = np.arange(0, len(top), self.FAN)
            self.levels.append((np.maximum.reduceat(top, at), np.minimum.reduceat(low, at)))

    def pairs(self, other: "CountTree", num: int, den: int) -> np.ndarray:
        """Positions (of self, of other) of points whose bound reaches the wanted overlap.

        Whoever descends, a node's box holds its largest coordinates and its smallest size:
        the bound of two nodes is never below that of any two points in them.
        """
        depth = max(len(self.levels), len(other.levels)) - 1
        mine = self.levels + [self.levels[-1]] * (depth + 1 - len(self.levels))
        theirs = other.levels + [other.levels[-1]] * (depth + 1 - len(other.levels))
        now = np.zeros((1, 2), np.int64)
        for level in range(depth, -1, -1):
            (p, low), (q, low2) = mine[level], theirs[level]
            if level == 0 and len(now) * self.FAN**2 >= DENSE * len(p) * len(q) and len(p) * len(q) > 1 << 12:
                now = np.concatenate([
                    np.argwhere(_least_sums(p[k : k + STRIP], q) * (den + num) >= (low[k : k + STRIP, None] + low2[None]) * num) + (k, 0)
                    for k in range(0, len(p), STRIP)
                ])
                continue
            if level < depth:
                now = _children(now, 0, len(mine[level][0]), mine[level] is not mine[level + 1])
                now = _children(now, 1, len(theirs[level][0]), theirs[level] is not theirs[level + 1])
            kept = []
            for part in np.array_split(now, len(now) * p.shape[1] // (1 << 18) + 1):
                bound = np.minimum(p[part[:, 0]], q[part[:, 1]]).sum(axis=1, dtype=np.int64)
                kept.append(part[bound * (den + num) >= (low[part[:, 0]] + low2[part[:, 1]]) * num])
            now = np.concatenate(kept)
        return np.stack((self.order[now[:, 0]], other.order[now[:, 1]]), axis=1)


def _least_sums(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Sums of coordinate minima of all rows of p and q: a count's minimum is how many levels both reach."""
    total = np.zeros((len(p), len(q)), np.float32)
    for level in range(1, int(min(p.max(), q.max())) + 1):
        left, right = (p >= level).astype(np.float32), (q >= level).astype(np.float32)
        some = left.any(axis=0) & right.any(axis=0)
        total += left[:, some] @ right[:, some].T
    return total


def _children(pairs: np.ndarray, side: int, n: int, deeper: bool) -> np.ndarray:
    if not deeper or not len(pairs):
        return pairs
    first = pairs[:, side] * CountTree.FAN
    count = np.minimum(first + CountTree.FAN, n) - first
    out = np.repeat(pairs, count, axis=0)
    out[:, side] = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return out


def tile_links(left: list[tuple], right: list[tuple], num: int, den: int) -> list[tuple[int, int]]:
    """Links between members (node, root, set) of two tiles that join their components.

    Two trees give the pairs that the bound lets through; of those, only pairs of components
    not joined yet are tested. At most one link fewer than there are members comes back.
    """
    sides = [[m for m in side if len(m[2])] for side in (left, right)]
    if not all(sides):
        return []
    groups = max(len(point_of(m[2])) for side in sides for m in side)
    trees = []
    for side in sides:
        points = np.stack([np.bincount((m[2] & _u(groups - 1)).astype(np.int64), minlength=groups) for m in side])
        trees.append(CountTree(points.astype(np.uint8), np.array([len(m[2]) for m in side], np.int64)))
    up: dict[int, int] = {}

    def top(root: int) -> int:
        while up.get(root, root) != root:
            up[root] = root = up.get(up[root], up[root])
        return root

    root = [np.array([m[1] for m in side], np.int64) for side in sides]
    found = trees[0].pairs(trees[1], num, den)
    found = found[root[0][found[:, 0]] != root[1][found[:, 1]]]
    out = []
    for i, j in found.tolist():
        (a, ra, x), (b, rb, y) = sides[0][i], sides[1][j]
        ra, rb = top(ra), top(rb)
        if ra != rb and linked(x, y, num, den):
            up[max(ra, rb)] = min(ra, rb)
            out.append((min(a, b), max(a, b)))
    return out


def _tree_links(rows: DataFrame, num: int, den: int, kind: type = np.uint64) -> DataFrame:
    """Links (a, b) of pairs of tiles (cluster, i, j), found with two trees each; members are of ``kind``."""

    def run(batches):
        key, left, right = None, [], []
        for batch in batches:
            for row in batch.to_pylist():
                at = (row["cluster"], row["i"], row["j"])
                if at != key:
                    yield from emit(tile_links(left, right, num, den))
                    key, left, right = at, [], []
                member = (row["node"], row["root"], np.frombuffer(row["members"], kind))
                if row["tile"] == row["i"]:
                    left.append(member)
                if row["tile"] == row["j"]:
                    right.append(member)
        yield from emit(tile_links(left, right, num, den))

    def emit(pairs):
        if pairs:
            a, b = zip(*pairs)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    keys = ["cluster", "i", "j"]
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _tile_links(rows: DataFrame, nodes: DataFrame, verify: _Verifier) -> DataFrame:
    """Verified links of the tiles' members ``rows``, whose sets are those of ``nodes``."""
    num, den = verify.num, verify.den
    # Sets are joined last, to be shuffled once.
    halves = _sets_of(verify.docs, verify.found, nodes, verify.size, verify.clashed, halves=True)
    found = stored(_tree_links(rows.join(halves, "node"), num, den, np.uint32), "links")
    links = verify.links(found)
    if links.count() == found.count():
        return links
    # A pair that is no link may have stood in for one that is.
    return stored(_tree_links(rows.join(verify.sets_of(nodes), "node"), num, den), "links")


def _open_blocks(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, node, root) of the blocks that still hold several components, equal blocks once.

    The only pair of a block of two has been compared as a pair with its smallest node.
    """
    rows = shared.select("key", "node").join(roots, "node", "left").select(
        "key", "node", F.coalesce("root", "node").alias("root")
    )
    kept = (
        rows.groupBy("key")
        .agg(
            F.min("root").alias("low"),
            F.max("root").alias("high"),
            F.count("*").alias("members"),
            F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("mark"),
        )
        .where("low <> high and members > 2")
        .groupBy("members", "mark")
        .agg(F.min("key").alias("key"))
        .select("key", "members")
    )
    return stored(rows.join(kept, "key"), "open")


def _clusters(rows: DataFrame) -> DataFrame:
    """(node, root, cluster) of the members of open blocks; blocks with a common node are one cluster."""
    low = rows.groupBy("key").agg(F.min("node").alias("low"))
    edges = rows.join(low, "key").select(F.col("node").alias("a"), F.col("low").alias("b"))
    found = connected(edges, "clusters").select("node", F.col("root").alias("cluster"))
    return stored(rows.select("node", "root").distinct().join(found, "node"), "clusters")


def _tiles(clusters: DataFrame, points: DataFrame, num: int, den: int) -> DataFrame:
    """(cluster, tile, i, j, node, root): members dealt out as pairs of tiles of fitting sizes.

    Members stand in the order of their sizes; a tile is a stretch of about TILE_NGRAMS, and of
    TILE members at most. Only the counts per size meet in one task, so a cluster may be as
    large as it likes.
    """
    members = clusters.join(points.select("node", "n"), "node")
    weight = F.greatest("n", F.lit(TILE_NGRAMS // TILE))
    sizes = members.groupBy("cluster", "n").agg(F.count("*").alias("c"), F.sum(weight).alias("w"))
    before = Window.partitionBy("cluster").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("begin", F.coalesce(F.sum("w").over(before), F.lit(0)))
    place = F.col("begin") + F.pmod(F.xxhash64("node"), "c") * weight
    tiled = members.join(sizes.drop("w"), ["cluster", "n"]).withColumn("tile", F.floor(place / TILE_NGRAMS).cast("int"))
    tiled = stored(tiled.select("cluster", "tile", "n", "node", "root"), "tiles")
    span = tiled.groupBy("cluster", "tile").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    met = span.select("cluster", F.col("tile").alias("i"), F.col("most").alias("most_i")).join(
        span.select("cluster", F.col("tile").alias("j"), F.col("least").alias("least_j")), "cluster"
    ).where((F.col("i") <= F.col("j")) & (F.col("most_i") * den >= F.col("least_j") * num))
    sides = met.select("cluster", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("tile"))
    return tiled.drop("n").join(sides, ["cluster", "tile"])


def near_duplicate_classes(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text).

    Two texts link when den * |intersection| >= num * |union| of their word ``size``-gram
    sets. component_id is the smallest doc_id reachable by links. Null texts and texts
    without words have an empty set, link with nothing and keep their own doc_id. Rows
    with a null doc_id get the smallest id of their component, or null when it has none.
    Repeated rows and equal texts fall into one component. Other columns are not read.
    """
    found, clashed = _scan(docs, size, num, den)
    folded = found.select("doc_id", "n_shingles", "node")
    names = folded.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    shared = _shared_blocks(found)
    listed = found.where("point is not null").select("node", F.col("n_shingles").alias("n"), "point")
    nodes = shared.select("node").distinct()
    points = stored(_among(listed, nodes).dropDuplicates(["node"]), "points")
    verify = _Verifier(docs, found, size, num, den, clashed)

    star = shared.where("node <> low").select(F.least("node", "low").alias("a"), F.greatest("node", "low").alias("b"))
    roots = stored(connected(verify.links(_bounded(star.distinct(), points, num, den))), "roots")
    clusters = _clusters(_open_blocks(shared, roots))
    if clusters.limit(1).count():
        rows = _tiles(clusters, points, num, den)
        roots = _joined(roots, _tile_links(rows, clusters.select("node"), verify))
    final = names.join(roots, "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root"))
    least = final.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    classes = final.join(least, "root").select("node", "component_id")
    return (
        folded.join(classes, "node", "left")
        .select(
            "doc_id",
            "n_shingles",
            F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        )
    )
