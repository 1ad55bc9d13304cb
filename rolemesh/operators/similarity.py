"""Jaccard similarity of skill sets: top-k neighbours per job, exact and safe under skew.

* Jobs with equal skill sets are folded into one *set row* that keeps its ``k + 1``
  smallest job ids; a job never needs more neighbours than that from one set. A set with
  more than ``k`` jobs serves its own jobs, at similarity 1, and only offers to others.
* Skills are numbered by how many sets hold them, rarest first. A pair of sets is found at
  its rarest common skill only, in the posting list of that skill.
* Rounds go down by levels of similarity. At a level a set stands in the lists of its first
  skills only, as many as a pair of that similarity can miss. A set that has met ``k + 1``
  jobs at or above the level is closed: what is still unseen is below. Later rounds look
  only for the sets that are open. The first round takes the lowest level at which the lists
  are short enough, so sparse skills need one round and skills that everybody has need more.
  A round that is told to start higher is followed by that level.
* Few skills that everybody has (at most MASKED of them, lists too long for one round) need no
  lists: sets are bit masks in their order, cut into blocks. A tile of asking sets meets all
  blocks, the near ones first, and a set leaves out a block whose common and united skills
  bound its similarity below the worst that the set keeps.
* A posting list of at most BLOCK sets is compared where its skill is dealt to. Longer lists
  are cut into blocks of at most BLOCK sets in the order of their skills. Two blocks of a list are compared in one task, by a product of their bit matrices, unless
  their common and united skills bound every similarity between them below the level. Per
  asking set a task hands on its best ``k + 1`` sets, never all pairs.

Similarity is compared in integers: i / u >= 7 / 20 is 20 i >= 7 u.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ranking import top_k

# Threshold 0.35 = 7/20, neighbours kept per job, digits of a score.
NUM, DEN = 7, 20
TOP = 8
DIGITS = 4

# Levels of similarity in falling order; the last is the threshold.
LEVELS = ((9, 10), (4, 5), (7, 10), (3, 5), (1, 2), (2, 5), (NUM, DEN))
BLOCK = 1_024
# A first level is low enough if its lists ask for about so many comparisons per list entry.
COMPARISONS = 4_096
# Masks: skills in a word of a mask, most skills, sets in a block, blocks in a tile, pairs compared at once.
WORD = 63
MASKED = 4 * WORD
MASK_BLOCK, MASK_TILE = 256, 64
AT_ONCE = 1 << 18
# Pairs of blocks with at most so many sets of at most so many skills are compared many at once.
FEW_SETS, FEW_SKILLS = 128, 16


def jaccard(a: Column, b: Column) -> Column:
    """|a ∩ b| / |a ∪ b| of two arrays; 0 when either is empty."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(both > 0, both / either).otherwise(F.lit(0.0))


def skill_sets(job_skills: DataFrame) -> DataFrame:
    """(job_id, skill_id) rows -> one row per job with its distinct skills, sorted."""
    return job_skills.groupBy("job_id").agg(F.sort_array(F.collect_set("skill_id")).alias("toks"))


def _distinct_sets(members: DataFrame, k: int) -> DataFrame:
    """Equal skill sets folded: (sid, toks, job_ids), the k + 1 smallest job ids each.

    Numbers follow the smallest job id, so that a smaller sid stands for a smaller job. They
    are stored with the table: a recomputed partition must not number them differently.
    """
    folded = (
        top_k(members, ["toks"], [F.col("job_id").asc()], k + 1)
        .groupBy("toks")
        .agg(F.sort_array(F.collect_list("job_id")).alias("job_ids"))
    )
    ordered = folded.orderBy(F.col("job_ids")[0])
    return cut_lineage(ordered.select(F.monotonically_increasing_id().alias("sid"), "toks", "job_ids"))


def _encoded_sets(folded: DataFrame, k: int) -> DataFrame:
    """Set rows (sid, n, skills, jobs): skill numbers rarest first, how many jobs it offers."""
    df = folded.select(F.explode("toks").alias("tok")).groupBy("tok").agg(F.count("*").alias("df"))
    tokens = cut_lineage(df.orderBy("df", "tok").select("tok", F.monotonically_increasing_id().alias("tid")))
    ordered = (
        folded.select("sid", F.explode("toks").alias("tok"))
        .join(tokens, "tok")
        .groupBy("sid")
        .agg(F.sort_array(F.collect_list("tid")).alias("skills"))
    )
    return ordered.join(folded.select("sid", F.size("job_ids").alias("jobs")), "sid").select(
        "sid", F.size("skills").alias("n"), "skills", "jobs"
    )


def _reach(n: Column, level: tuple[int, int]) -> Column:
    """How many of its first skills a set of ``n`` must be found by, for all pairs of the level."""
    num, den = level
    return n - F.ceil(n * num / F.lit(den)).cast("int") + 1


def first_level(sets: DataFrame, levels: tuple = LEVELS) -> int:
    """The lowest level whose posting lists are short enough to be compared, else the highest.

    The length of every list at every level is counted: a skill's place in a set tells from
    which level on the set stands in that list.
    """
    enters = F.lit(len(levels))
    for at in reversed(range(len(levels))):
        enters = F.when(F.col("pos") < _reach(F.col("n"), levels[at]), at).otherwise(enters)
    entries = sets.select("n", F.posexplode("skills").alias("pos", "tok")).select("tok", enters.alias("level"))
    counts = entries.groupBy("tok", "level").count()
    lengths = counts.groupBy("tok").agg(
        *(F.sum(F.when(F.col("level") <= at, F.col("count")).otherwise(0)).cast("double").alias(f"m{at}") for at in range(len(levels)))
    )
    row = lengths.agg(
        *(F.sum(F.col(f"m{at}") * F.col(f"m{at}")).alias(f"c{at}") for at in range(len(levels))),
        *(F.sum(f"m{at}").alias(f"r{at}") for at in range(len(levels))),
    ).first()
    fits = [at for at in range(len(levels)) if (row[f"c{at}"] or 0) <= COMPARISONS * (row[f"r{at}"] or 0)]
    return fits[-1] if fits else 0


def _entries(sets: DataFrame, still_open: DataFrame | None, level: tuple[int, int]) -> DataFrame:
    """Entries (tok, sid, n, skills, asks) of the posting lists of the level."""
    asks = sets.withColumn("asks", F.lit(True)) if still_open is None else sets.join(
        still_open.select("sid", F.lit(True).alias("asks")), "sid", "left"
    ).withColumn("asks", F.coalesce("asks", F.lit(False)))
    return asks.select(
        "sid", "n", "skills", "asks", F.explode(F.slice("skills", F.lit(1), _reach(F.col("n"), level))).alias("tok")
    )


def _lists(entries: DataFrame, block: int) -> DataFrame:
    """Posting lists (tok, block, sid, n, skills, asks), cut into blocks, stored.

    Entries are sorted by (skill, the set's skills) over all tasks, so a list may span many
    tasks, and the sets of a block are alike.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, tok, filled = TaskContext.get().partitionId() << 32, None, 0
        for batch in batches:
            toks = batch.column("tok").to_numpy()
            numbers = np.empty(len(toks), np.int64)
            begins = np.flatnonzero(np.concatenate(([True], toks[1:] != toks[:-1]))) if len(toks) else []
            for a, b in zip(begins, [*begins[1:], len(toks)]):
                if toks[a] != tok:
                    number, tok, filled = number + 1, toks[a], 0
                places = filled + np.arange(b - a)
                numbers[a:b] = number + places // block
                number, filled = int(numbers[b - 1]), int(places[-1] % block) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers)], names=[*batch.schema.names, "block"])

    ranged = entries.repartitionByRange("tok", "skills").sortWithinPartitions("tok", "skills")
    return cut_lineage(ranged.mapInArrow(cut, "tok long, sid long, n int, skills array<bigint>, asks boolean, block long"))


def _block_pairs(lists: DataFrame, level: tuple[int, int]) -> DataFrame:
    """(tok, i, j) of the blocks that may hold a pair of the level, i <= j, one of them asking.

    Skills that all sets of one block have and no set of the other are missed by every pair.
    """
    num, den = level
    blocks = cut_lineage(
        lists.groupBy("tok", "block").agg(
            F.count("*").alias("m"), F.min("n").alias("least"), F.max("n").alias("most"), F.bool_or("asks").alias("asks")
        )
    )
    alone = blocks.where("asks and m > 1").select("tok", F.col("block").alias("i"), F.col("block").alias("j"))
    several = blocks.groupBy("tok").agg(F.count("*").alias("blocks")).where("blocks > 1")
    held = (
        lists.join(several, "tok", "left_semi")
        .select("tok", "block", F.explode("skills").alias("skill"))
        .groupBy("tok", "block", "skill")
        .agg(F.count("*").alias("c"))
        .join(blocks, ["tok", "block"])
        .groupBy("tok", "block", "least", "most", "asks")
        .agg(F.collect_list("skill").alias("some"), F.collect_list(F.when(F.col("c") == F.col("m"), F.col("skill"))).alias("all"))
    )
    held = cut_lineage(held)
    a, b = (held.select([F.col(c).alias(f"{c}_{x}") for c in held.columns]) for x in "ab")
    common = F.least(F.size(F.array_intersect("some_a", "some_b")), F.col("most_a"), F.col("most_b"))
    missed = F.size(F.array_except("all_a", "some_b")) + F.size(F.array_except("all_b", "some_a"))
    either = F.greatest(common + missed, F.col("least_a") + F.col("least_b") - common)
    near = (
        (F.col("block_a") < F.col("block_b")) & (F.col("asks_a") | F.col("asks_b"))
        & (F.col("most_a") * den >= F.col("least_b") * num) & (F.col("most_b") * den >= F.col("least_a") * num)
    )
    met = a.join(b, (F.col("tok_a") == F.col("tok_b")) & near).where(common * den >= either * num)
    return alone.unionByName(met.select(F.col("tok_a").alias("tok"), F.col("block_a").alias("i"), F.col("block_b").alias("j")))


def _bits(sets: list[np.ndarray], columns: np.ndarray) -> np.ndarray:
    """Rows of sets as 0 / 1 over the sorted skill numbers ``columns``."""
    out = np.zeros((len(sets), len(columns)), np.float32)
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    at = np.searchsorted(columns, flat)
    known = (at < len(columns)) & (columns[np.minimum(at, len(columns) - 1)] == flat)
    out[row[known], at[known]] = 1
    return out


def compare_blocks(
    tok: int, asking: tuple, offering: tuple, level: tuple[int, int], above: tuple[int, int] | None, k: int
) -> tuple[np.ndarray, ...] | None:
    """(sid, other, i, u): per asking set its ``k`` best sets of the offering block.

    Blocks are (sid, skills, asks). Counted are pairs of the level, below ``above``, whose
    rarest common skill is ``tok``; ties go to the smaller sid.
    """
    sid, skills, asks = asking
    other, theirs, _ = offering
    skills, sid = [s for s, ask in zip(skills, asks) if ask], sid[asks]
    if not len(sid):
        return None
    # Skills of one side alone are in no intersection.
    columns = np.intersect1d(np.concatenate(skills), np.concatenate(theirs))
    a, b = _bits(skills, columns), _bits(theirs, columns)
    common = a @ b.T
    rarer = int(np.searchsorted(columns, tok))
    total = np.array([len(s) for s in skills])[:, None] + np.array([len(s) for s in theirs])[None]
    either = total - common
    num, den = level
    good = (den * common >= num * either) & (sid[:, None] != other[None])
    if above is not None:
        good &= above[1] * common < above[0] * either
    if rarer:
        good &= a[:, :rarer] @ b[:, :rarer].T == 0
    i, j = np.nonzero(good)
    if not len(i):
        return None
    both, united = common[i, j].astype(float), either[i, j].astype(float)
    order = np.lexsort((other[j], -both / united, i))
    i, j, both, united = i[order], j[order], both[order], united[order]
    first = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1])))
    place = np.arange(len(i)) - np.repeat(first, np.diff(np.append(first, len(i))))
    kept = place < k
    return sid[i[kept]], other[j[kept]], both[kept].astype(np.int32), united[kept].astype(np.int32)


def _signatures(skills: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row of ``skills`` (-1: none) a word with a bit for every skill, and how many skills share a bit."""
    bits = np.left_shift(np.uint64(1), (skills & 63).astype(np.uint64))
    words = np.bitwise_or.reduce(np.where(skills >= 0, bits, np.uint64(0)), 1)
    return words, lengths.astype(np.int32) - np.bitwise_count(words)


def _may_reach(
    a: np.ndarray, b: np.ndarray, words: np.ndarray, shared: np.ndarray, lengths: np.ndarray, level: tuple[int, int]
) -> np.ndarray:
    """Which pairs of rows may be of the level: two rows have no more skills in common than bits, but for shared ones."""
    common = np.bitwise_count(words[a] & words[b]) + shared[a]
    return (level[0] + level[1]) * common >= level[0] * (lengths[a] + lengths[b])


def compare_small(
    tok: np.ndarray, block: np.ndarray, alone: np.ndarray, sid: np.ndarray, asks: np.ndarray, lengths: np.ndarray,
    flat: np.ndarray, sizes: np.ndarray, level: tuple[int, int], above: tuple[int, int] | None, k: int,
) -> tuple[np.ndarray, ...]:
    """What ``compare_blocks`` finds, for many small pairs of blocks at once.

    Rows are sets with their skills in ``flat``; ``sizes`` counts the rows of one pair of
    blocks after another, ``alone`` marks those of a block that meets itself.
    """
    skills = np.full((len(sid), max(int(lengths.max()), 1)), -1, np.int64)
    row = np.repeat(np.arange(len(sid)), lengths)
    skills[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    words, shared = _signatures(skills, lengths)
    short = lengths.astype(np.int32)
    group = np.repeat(np.arange(len(sizes)), sizes)
    first = (np.cumsum(sizes) - sizes)[group]
    asking = np.flatnonzero(asks)
    per_row = sizes[group[asking]]
    step = max(AT_ONCE // (skills.shape[1] * int(sizes.max())), 1)
    found = []
    for at in range(0, len(asking), step):
        rows, n = asking[at : at + step], per_row[at : at + step]
        a = np.repeat(rows, n)
        b = np.repeat(first[rows], n) + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
        near = _may_reach(a, b, words, shared, short, level)
        a, b = a[near], b[near]
        other = (a != b) & (alone[a] | (block[a] != block[b]))
        a, b = a[other], b[other]
        if not len(a):
            continue
        mine = skills[a]
        held = np.zeros(mine.shape, bool)
        for column in range(skills.shape[1]):
            held |= mine == skills[b, column][:, None]
        held &= mine >= 0
        common = held.sum(1)
        either = lengths[a] + lengths[b] - common
        good = (level[1] * common >= level[0] * either) & (mine[np.arange(len(a)), held.argmax(1)] == tok[a])
        if above is not None:
            good &= above[1] * common < above[0] * either
        a, b, common, either = a[good], b[good], common[good], either[good]
        order = np.lexsort((sid[b], -common / np.maximum(either, 1), a))
        a, b, common, either = a[order], b[order], common[order], either[order]
        begins = np.searchsorted(a, a)
        kept = np.arange(len(a)) - begins < k
        found.append((sid[a[kept]], sid[b[kept]], common[kept].astype(np.int32), either[kept].astype(np.int32)))
    if not found:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int32, np.int32))
    return tuple(np.concatenate(c) for c in zip(*found))


def _met(entries: DataFrame, level: tuple[int, int], above: tuple[int, int] | None, k: int, block: int) -> DataFrame:
    """(sid, other, i, u) that asking sets meet at the level, ``k`` best of each pair of blocks.

    A list of at most ``block`` sets is one block; only longer lists are stored, cut and paired.
    """
    lengths = entries.groupBy("tok").agg(F.count("*").alias("m"), F.bool_or("asks").alias("any"))
    worth = cut_lineage(lengths.where("m > 1 and any").select("tok", (F.col("m") > block).alias("long")))
    zero = F.lit(0).cast("long")
    whole = entries.join(worth.where("not long"), "tok", "left_semi")
    dealt = whole.select(
        "tok", zero.alias("i"), zero.alias("j"), zero.alias("block"), "sid", "skills", "asks"
    ).repartition("tok")
    met = _compared(dealt.sortWithinPartitions("tok"), level, above, k)
    long = worth.where("long")
    if long.isEmpty():
        return met
    lists = _lists(entries.join(long, "tok", "left_semi"), block)
    sides = _block_pairs(lists, level).select(
        "tok", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block")
    )
    keys = ["tok", "i", "j", "block"]
    dealt = lists.join(sides, ["tok", "block"]).select(*keys, "sid", "skills", "asks")
    dealt = dealt.repartition("tok", "i", "j").sortWithinPartitions(*keys)
    return met.unionByName(_compared(dealt, level, above, k))


def _compared(dealt: DataFrame, level: tuple[int, int], above: tuple[int, int] | None, k: int) -> DataFrame:
    """What the sets (tok, i, j, block, sid, skills, asks) of pairs of blocks meet, pairs one after another."""

    def search(parts: list[tuple]) -> pa.RecordBatch | None:
        """Rows of one pair of blocks, in pieces (i, j, block, sid, skills, asks, tok)."""
        i, j, tok = parts[0][0], parts[0][1], parts[0][6]
        side = {}
        for block in dict.fromkeys((i, j)):
            own = [p for p in parts if p[2] == block]
            side[block] = (
                np.concatenate([p[3] for p in own]), [s for p in own for s in p[4]], np.concatenate([p[5] for p in own])
            )
        if len(side) == 1 and i != j:
            return None
        found = [compare_blocks(tok, side[x], side[y], level, above, k) for x, y in dict.fromkeys(((i, j), (j, i)))]
        found = [f for f in found if f is not None]
        if not found:
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=["sid", "other", "i", "u"])

    def small(columns: list[np.ndarray], asks: np.ndarray, lengths: np.ndarray, flat: np.ndarray, sizes: np.ndarray, few: np.ndarray):
        """Rows of the pairs of blocks marked ``few``, all of which are in this batch."""
        rows = np.repeat(few, sizes)
        if not rows.any():
            return None
        tok, i, j, block, sid = (c[rows] for c in columns)
        out = compare_small(
            tok, block, i == j, sid, asks[rows], lengths[rows], flat[np.repeat(rows, lengths)], sizes[few], level, above, k
        )
        return pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=["sid", "other", "i", "u"]) if len(out[0]) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c).to_numpy() for c in ("tok", "i", "j", "block", "sid")]
            asks = batch.column("asks").to_numpy(zero_copy_only=False)
            lengths = pc.list_value_length(batch.column("skills")).to_numpy().astype(np.int64)
            flat = pc.list_flatten(batch.column("skills")).to_numpy()
            ends = np.cumsum(lengths)
            # Pairs of blocks that may go on in another batch are at its ends.
            changes = np.any([c[1:] != c[:-1] for c in columns[:3]], axis=0)
            begins = np.flatnonzero(np.concatenate(([True], changes)))
            sizes = np.diff(np.append(begins, batch.num_rows))
            few = (sizes <= FEW_SETS) & (np.maximum.reduceat(lengths, begins) <= FEW_SKILLS)
            few[[0, -1]] = False
            if (out := small(columns, asks, lengths, flat, sizes, few)) is not None:
                yield out
            for begin, size in zip(begins[~few], sizes[~few]):
                tok, i, j = (int(c[begin]) for c in columns[:3])
                if parts and (parts[0][6], parts[0][0], parts[0][1]) != (tok, i, j):
                    if (out := search(parts)) is not None:
                        yield out
                    parts = []
                own = columns[3][begin : begin + size]
                cuts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
                for a, b in zip(cuts + begin, np.append(cuts[1:], size) + begin):
                    sets = np.split(flat[ends[a] - lengths[a] : ends[b - 1]], (ends[a:b] - ends[a] + lengths[a])[:-1])
                    parts.append((i, j, int(columns[3][a]), columns[4][a:b], sets, asks[a:b], tok))
        if parts and (out := search(parts)) is not None:
            yield out

    return dealt.mapInArrow(run, "sid long, other long, i int, u int")


def _masked_blocks(sets: DataFrame, toks: np.ndarray, k: int) -> DataFrame:
    """Blocks (tile, block, sid, n, asks, words) of sets as bit masks over ``toks``, alike sets together, stored."""
    words = -(-len(toks) // WORD)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.list_value_length(batch.column("skills")).to_numpy()
            code = np.searchsorted(toks, pc.list_flatten(batch.column("skills")).to_numpy())
            masks = np.zeros((batch.num_rows, words), np.int64)
            # The rarest skill is the highest bit, so that the order of the masks parts the sets best.
            np.bitwise_or.at(masks, (np.repeat(np.arange(batch.num_rows), lengths), code // WORD), np.int64(1) << (WORD - 1 - code % WORD))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * words), pa.array(masks.ravel()))
            asks = pc.less_equal(batch.column("jobs"), k)
            yield pa.RecordBatch.from_arrays([batch.column("sid"), batch.column("n"), asks, lists], names=["sid", "n", "asks", "words"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, None

        def block(rows: pa.Table) -> pa.RecordBatch:
            rows = rows.sort_by("sid").combine_chunks()
            columns = [rows.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("sid", "n", "asks")]
            columns.append(pc.list_flatten(rows.column("words")).combine_chunks().to_numpy())
            values = [pa.array([number - number % MASK_TILE]), pa.array([number]), *(pa.array([c.tolist()]) for c in columns)]
            types = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([v.cast(t) for v, t in zip(values, types)], names=["tile", "block", "sid", "n", "asks", "words"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            while held.num_rows >= MASK_BLOCK:
                yield block(held.slice(0, MASK_BLOCK))
                number, held = number + 1, held.slice(MASK_BLOCK)
        if held is not None and held.num_rows:
            yield block(held)

    masks = sets.select("sid", "n", "skills", "jobs").mapInArrow(encode, "sid long, n int, asks boolean, words array<bigint>")
    ranged = masks.repartitionByRange("words").sortWithinPartitions("words")
    shape = "tile long, block long, sid array<bigint>, n array<int>, asks array<boolean>, words array<bigint>"
    return cut_lineage(ranged.mapInArrow(cut, shape))


def _bit_counts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits that rows of ``a`` and ``b`` (words) share; arrays are broadcast against each other."""
    return np.bitwise_count(a & b).sum(-1, dtype=np.uint8) if a.shape[-1] > 1 else np.bitwise_count(a[..., 0] & b[..., 0])


class _Tile:
    """Asking sets of a tile with the ``k`` best sets that each has met, ties by the smaller sid."""

    def __init__(self, sid: np.ndarray, n: np.ndarray, words: np.ndarray, level: tuple[int, int], k: int):
        self.sid, self.n, self.words, self.k = sid, n.astype(np.int16), words, k
        self.worst = np.full(len(sid), np.float32(level[0]) / np.float32(level[1]), np.float32)
        self.best = tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int32, np.int32, np.float32))
        self.new: list[tuple] = []
        self.waiting = 0

    def merge(self) -> None:
        row, other, i, u, score = (np.concatenate(c) for c in zip(self.best, *self.new))
        order = np.lexsort((other, -score, row))
        row = row[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        kept = place < self.k
        self.best = (row[kept], *(c[order][kept] for c in (other, i, u, score)))
        full = place[kept] == self.k - 1
        self.worst[self.best[0][full]] = self.best[4][full]
        self.new, self.waiting = [], 0

    def meet(self, sid: np.ndarray, n: np.ndarray, words: np.ndarray, rows: np.ndarray | None = None) -> None:
        """Compare the asking sets (``rows`` of them) with a block, unless their bound is below what they keep."""
        every, some = np.bitwise_and.reduce(words, 0), np.bitwise_or.reduce(words, 0)
        own = self.words if rows is None else self.words[rows]
        size = self.n if rows is None else self.n[rows]
        missed = int(np.bitwise_count(every).sum()) - _bit_counts(own, every[None]).astype(np.int16)
        bound = np.true_divide(_bit_counts(own, some[None]), size + missed, dtype=np.float32)
        near = np.flatnonzero(bound >= (self.worst if rows is None else self.worst[rows]))
        if rows is not None:
            near = rows[near]
        step = AT_ONCE // MASK_BLOCK
        for at in range(0, len(near), step):
            part = near[at : at + step]
            common = _bit_counts(self.words[part][:, None], words[None])
            either = self.n[part][:, None] + n.astype(np.int16)[None] - common
            score = np.true_divide(common, either, dtype=np.float32)
            a, b = np.nonzero(score >= self.worst[part][:, None])
            differ = self.sid[part[a]] != sid[b]
            a, b = a[differ], b[differ]
            if len(a):
                self.new.append((part[a], sid[b], common[a, b].astype(np.int32), either[a, b].astype(np.int32), score[a, b]))
                self.waiting += len(a)
            if self.waiting > max(AT_ONCE, len(self.best[0])):
                self.merge()


def _met_by_masks(blocks: DataFrame, level: tuple[int, int], k: int) -> DataFrame:
    """(sid, other, i, u): the ``k`` best sets at or above the level of every asking set."""
    tiles = blocks.where(F.exists("asks", lambda x: x)).select(F.col("tile").alias("asking")).distinct()
    own = F.col("asking") == F.col("tile")
    # Own blocks come first, then the others by their place in the order of the masks.
    apart = F.when(own, -1).otherwise(F.abs(F.col("block") - F.col("asking") - MASK_TILE // 2))
    dealt = blocks.crossJoin(F.broadcast(tiles)).withColumn("apart", apart)
    dealt = dealt.repartition("asking").sortWithinPartitions("asking", "apart", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tile, own = None, None, []

        def begin() -> _Tile:
            sid, n, asks, words = (np.concatenate(c) for c in zip(*own))
            found = _Tile(sid[asks], n[asks], words[asks], level, k)
            # First every block with itself: what a set keeps of its likes rules out most others.
            ends = np.cumsum([o[2].sum() for o in own])
            ranges = [np.arange(end - o[2].sum(), end) for o, end in zip(own, ends)]
            for o, rows in zip(own, ranges):
                found.meet(o[0], o[1], o[3], rows)
                if found.new:
                    found.merge()
            for o, rows in zip(own, ranges):
                rest = np.ones(len(found.sid), bool)
                rest[rows] = False
                found.meet(o[0], o[1], o[3], np.flatnonzero(rest))
            return found

        def done() -> Iterator[pa.RecordBatch]:
            found = tile if tile is not None else begin()
            if found.new:
                found.merge()
            row, other, i, u, _ = found.best
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (found.sid[row], other, i, u)], names=["sid", "other", "i", "u"])

        for batch in batches:
            asking, apart = batch.column("asking").to_numpy(), batch.column("apart").to_numpy()
            for r in range(batch.num_rows):
                if asking[r] != at:
                    if at is not None:
                        yield from done()
                    at, tile, own = asking[r], None, []
                sid, n, asks, words = (
                    batch.column(c)[r].values.to_numpy(zero_copy_only=False) for c in ("sid", "n", "asks", "words")
                )
                words = words.reshape(len(sid), -1)
                if apart[r] < 0:
                    own.append((sid, n, asks, words))
                    continue
                if tile is None:
                    tile = begin()
                tile.meet(sid, n, words)
        if at is not None:
            yield from done()

    return dealt.mapInArrow(run, "sid long, other long, i int, u int")


def _hot_skills(sets: DataFrame) -> np.ndarray | None:
    """The numbers of all skills if they are few enough for masks, in order."""
    toks = sets.select(F.explode("skills").alias("tok")).distinct().limit(MASKED + 1).collect()
    return np.array(sorted(r.tok for r in toks), np.int64) if 0 < len(toks) <= MASKED else None


def similar_top_k(
    job_skills: DataFrame, k: int = TOP, levels: tuple[tuple[int, int], ...] = LEVELS, block: int = BLOCK, start: int | None = None
) -> DataFrame:
    """Directed neighbours (job_id, other_id, rank, i, u, score): at most ``k`` per job,
    most similar first, equal similarity by id.

    ``levels`` fall to the threshold; ``start`` is the first one taken, by the lists' lengths
    if not given.
    """
    # Each of these is read by several of the steps below, so it is computed once.
    members = cut_lineage(skill_sets(job_skills))
    folded = _distinct_sets(members, k)
    sets = cut_lineage(_encoded_sets(folded, k))
    order = [(F.col("i") / F.col("u")).desc(), F.col("other").asc()]
    # A set that serves its own jobs never asks. k + 1 jobs, because a job may find itself.
    still_open = sets.where(F.col("jobs") <= k).select("sid", F.col("jobs").alias("seen"))
    masked, low = None, first_level(sets, levels)
    if start is None:
        start = low
        masked = _hot_skills(sets) if start + 1 < len(levels) else None
    best, above = None, None
    if masked is not None:
        best = cut_lineage(_met_by_masks(_masked_blocks(sets, masked, k), levels[-1], k + 1))
    # After a first round above the level that the lists allow, that level is the next one.
    for at in [start, *range(max(start + 1, low), len(levels))] if masked is None else ():
        asking = still_open if at > start else sets.where(F.col("jobs") <= k).select("sid")
        # k + 1 best sets hold the k + 1 best jobs: every set before one offers a smaller job.
        met = _met(_entries(sets, asking, levels[at]), levels[at], above, k + 1, block)
        met = cut_lineage(top_k(met, ["sid"], order, k + 1).drop("rank"))
        best = met if best is None else cut_lineage(top_k(best.unionByName(met), ["sid"], order, k + 1).drop("rank"))
        above = levels[at]
        if at + 1 < len(levels):
            gained = met.join(sets.select(F.col("sid").alias("other"), "jobs"), "other").groupBy("sid").agg(F.sum("jobs").alias("more"))
            still_open = cut_lineage(
                still_open.join(gained, "sid", "left")
                .select("sid", (F.col("seen") + F.coalesce("more", F.lit(0))).alias("seen"))
                .where(F.col("seen") <= k)
            )
            if still_open.isEmpty():
                break
    within = sets.select("sid", F.col("sid").alias("other"), F.col("n").alias("i"), F.col("n").alias("u"))
    offers = best.unionByName(within).join(folded.select(F.col("sid").alias("other"), "job_ids"), "other")
    offers = offers.select("sid", F.explode("job_ids").alias("other_id"), "i", "u")
    ranked = top_k(offers, ["sid"], [(F.col("i") / F.col("u")).desc(), F.col("other_id").asc()], k + 1)
    offered = ranked.groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("rank", "other_id", "i", "u"))).alias("best"))
    per_set = folded.select("sid", "toks").join(offered, "sid").select("toks", "best")
    own = F.filter("best", lambda o: o["other_id"] != F.col("job_id"))
    return (
        members.join(per_set, "toks")
        .select("job_id", F.posexplode(F.slice(own, 1, k)).alias("pos", "o"))
        .select(
            "job_id",
            "o.other_id",
            (F.col("pos") + 1).cast("long").alias("rank"),
            F.col("o.i").cast("long").alias("i"),
            F.col("o.u").cast("long").alias("u"),
            F.bround(F.col("o.i") / F.col("o.u"), DIGITS).alias("score"),
        )
    )


def kept_pairs(neighbors: DataFrame) -> DataFrame:
    """Undirected pairs that either side picked; a job may end in more than k of them."""
    return neighbors.select(
        F.least("job_id", "other_id").alias("job_a"),
        F.greatest("job_id", "other_id").alias("job_b"),
        "score",
    ).distinct()


def job_neighbors(job_skills: DataFrame, jobs: DataFrame, neighbors: DataFrame) -> DataFrame:
    """Per job with skills: company, skill rows and the directed neighbour list."""
    skills = job_skills.groupBy("job_id").agg(
        F.sort_array(
            F.collect_list(F.struct("skill_id", "edge_type", "label", "weight", "confidence"))
        ).alias("skills")
    )
    similar = neighbors.groupBy("job_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "other_id", "score"))).alias("_similar")
    )
    return (
        skills.join(jobs.select(F.col("id").alias("job_id"), "company_id"), "job_id")
        .join(similar, "job_id", "left")
        .select(
            "job_id",
            "company_id",
            "skills",
            F.coalesce(
                F.transform("_similar", lambda s: F.struct(s["other_id"].alias("job_id"), s["score"])),
                F.array().cast("array<struct<job_id:string,score:double>>"),
            ).alias("similar_jobs"),
        )
    )
