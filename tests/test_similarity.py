from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from rolemesh.operators import similarity as S
from rolemesh.operators import weave


def brute_force(sets: dict[str, set], k: int = 8):
    out = {}
    for a, mine in sets.items():
        scored = []
        for b, other in sets.items():
            i, u = len(mine & other), len(mine | other)
            if a != b and 20 * i >= 7 * u:
                scored.append((-i / u, b, i, u))
        out[a] = [(b, i, u) for _, b, i, u in sorted(scored)[:k]]
    return out


def run(spark, sets, **options):
    rows = [(j, s) for j, items in sets.items() for s in items]
    df = spark.createDataFrame(rows, "job_id string, skill_id string")
    got = {j: [] for j in sets}
    for r in S.similar_top_k(df, **options).orderBy("job_id", "rank").collect():
        got[r.job_id].append((r.other_id, r.i, r.u))
    return got


def random_sets(seed: int, jobs: int, skills: int, most: int):
    rng = random.Random(seed)
    names = [f"s{i:02d}" for i in range(skills)]
    weights = [1 / (i + 1) for i in range(skills)]
    out = {}
    for j in range(jobs):
        size = rng.randint(1, most)
        out[f"j{j:03d}"] = set(rng.choices(names, weights, k=size))
    for j in range(0, jobs, 3):  # a third of all jobs are copies of one set
        out[f"j{j:03d}"] = {"s00", "s01", "s02"}
    return out


@pytest.mark.parametrize(
    "options",
    [{}, {"block": 3}, {"start": 0}, {"start": 0, "block": 5}, {"start": 3, "block": 2}],
    ids=["one-round", "small-blocks", "all-rounds", "rounds-and-blocks", "late-rounds"],
)
def test_equals_brute_force(spark, options):
    sets = random_sets(7, 150, 14, 8)
    assert run(spark, sets, **options) == brute_force(sets)


def test_short_lists_need_two_rounds_and_no_cut(spark, monkeypatch):
    """A first round at the highest level is followed by the level that the lists allow; lists of a block are not stored."""
    sets, rounds, met, cut = random_sets(7, 60, 14, 8), [], S._met, []
    monkeypatch.setattr(S, "_met", lambda *args: (rounds.append(args), met(*args))[1])
    monkeypatch.setattr(S, "_lists", lambda *args: cut.append(args))
    assert run(spark, sets, start=0) == brute_force(sets)
    assert len(rounds) <= 2 and not cut


def test_sparse_and_dense_worlds(spark):
    sets = random_sets(3, 120, 60, 6)
    assert run(spark, sets, start=1, block=16) == brute_force(sets)


def test_large_sets_of_few_skills(spark):
    """Every skill is hot and sets are larger than what could be listed as subsets."""
    rng = random.Random(13)
    names = [f"s{i:02d}" for i in range(35)]
    sets = {f"j{j:03d}": set(rng.sample(names, rng.choice([3, 12, 13, 14, 20, 30]))) for j in range(300)}
    want = brute_force(sets)
    assert run(spark, sets, start=0, block=40) == want
    assert run(spark, sets) == want


def test_bound_of_blocks_drops_no_pair():
    rng = random.Random(2)
    sets = [np.array(sorted(rng.sample(range(40), rng.randint(2, 20)))) for _ in range(60)]
    asks = np.array([i % 3 > 0 for i in range(60)])
    sid = np.arange(60)
    for level, above in (((1, 2), None), ((7, 20), (1, 2))):
        got = {}
        for tok in range(40):
            own = [i for i in range(60) if tok in sets[i]]
            if own:
                side = (sid[own], [sets[i] for i in own], asks[own])
                found = S.compare_blocks(tok, side, side, level, above, 1_000)
                for a, b, i, u in zip(*found) if found else ():
                    assert (a, b) not in got
                    got[a, b] = (i, u)
        want = {}
        for a, b in [(a, b) for a in range(60) if asks[a] for b in range(60) if a != b]:
            i, u = len(set(sets[a]) & set(sets[b])), len(set(sets[a]) | set(sets[b]))
            if level[1] * i >= level[0] * u and (above is None or above[1] * i < above[0] * u):
                want[a, b] = (i, u)
        assert got == want and want


def test_twenty_identical_sets(spark):
    sets = {f"j{i:02d}": {"a", "b"} for i in range(20)}
    got = run(spark, sets)
    assert got == brute_force(sets)
    assert [b for b, _, _ in got["j00"]] == [f"j{i:02d}" for i in range(1, 9)]


def test_threshold_is_exact_and_rounding_half_even(spark):
    # 7 shared of 20: exactly 0.35; 13 of 32: 0.40625 rounds to 0.4062.
    common = {f"c{i}" for i in range(7)}
    a, b = common | {f"a{i}" for i in range(6)}, common | {f"b{i}" for i in range(7)}
    assert len(a & b) * 20 == len(a | b) * 7
    many = {f"d{i}" for i in range(13)}
    c, d = many | {f"e{i}" for i in range(9)}, many | {f"f{i}" for i in range(10)}
    rows = [(j, s) for j, items in {"a": a, "b": b, "c": c, "d": d}.items() for s in items]
    df = spark.createDataFrame(rows, "job_id string, skill_id string")
    scores = {(r.job_id, r.other_id): r.score for r in S.similar_top_k(df).collect()}
    assert scores == {("a", "b"): 0.35, ("b", "a"): 0.35, ("c", "d"): 0.4062, ("d", "c"): 0.4062}


def test_properties(spark):
    sets = random_sets(11, 100, 20, 6)
    got = run(spark, sets, start=2)
    for job, near in got.items():
        assert len(near) <= 8 and job not in [b for b, _, _ in near]
        for other, i, u in near:
            assert 0.35 <= i / u <= 1 and (i, u) == (len(sets[job] & sets[other]), len(sets[job] | sets[other]))


def test_array_jaccard(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], ["a"]), (["x"], ["x"])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(S.jaccard(F.col("a"), F.col("b"))).collect()] == [1 / 3, 0.0, 1.0]


# --- link cap ------------------------------------------------------------------


def greedy(links, cap=4):
    used, kept = {}, set()
    for a, b, w, o in sorted(links, key=lambda x: (-x[2], x[3], x[0], x[1])):
        if used.get(a, 0) < cap and used.get(b, 0) < cap:
            used[a], used[b] = used.get(a, 0) + 1, used.get(b, 0) + 1
            kept.add((a, b))
    return kept


def capped(spark, links):
    df = spark.createDataFrame(links, "source string, target string, weight double, o int").withColumn("ord", F.struct("o")).drop("o")
    return {(r.source, r.target) for r in weave.cap_links(df).collect()}


def test_cap_keeps_what_greedy_keeps(spark):
    rng = random.Random(5)
    nodes = [f"n{i}" for i in range(14)]
    links = [(a, b, rng.choice([0.2, 0.5, 0.9]), o) for o, (a, b) in enumerate(combinations(nodes, 2))]
    assert capped(spark, links) == greedy(links)


def test_cap_on_a_star(spark):
    links = [("hub", f"leaf{i}", 0.5, i) for i in range(10)]
    assert capped(spark, links) == {("hub", f"leaf{i}") for i in range(4)}


def test_merge_takes_the_larger_weight(spark):
    similar = spark.createDataFrame([("a", "b", 0.3, 1, 2), ("a", "c", 0.9, 1, 3)], "source string, target string, weight double, pa long, pb long")
    direct = spark.createDataFrame([("b", "a", 0.7, 2, 1), ("c", "a", 0.2, 3, 1), ("b", "c", 0.5, 2, 2)], "source string, target string, weight double, pa long, pb long")
    rows = {(r.source, r.target): r.weight for r in weave.merge_links(similar, direct).collect()}
    assert rows == {("b", "a"): 0.7, ("a", "c"): 0.9, ("b", "c"): 0.5}


@pytest.mark.parametrize("skills", [35, 80], ids=["one-word", "two-words"])
def test_masks_of_few_skills_equal_brute_force(spark, monkeypatch, skills):
    """Hot skills: every set is met once, in tiles and blocks of masks, copies and ties included."""
    monkeypatch.setattr(S, "first_level", lambda *_: 0)
    monkeypatch.setattr(S, "MASK_BLOCK", 16)
    monkeypatch.setattr(S, "MASK_TILE", 2)
    rng = random.Random(skills)
    names = [f"s{i:02d}" for i in range(skills)]
    sets = {f"j{j:03d}": set(rng.sample(names[: rng.choice([20, skills])], rng.choice([3, 12, 13, 18]))) for j in range(200)}
    for j in range(0, 200, 5):
        sets[f"j{j:03d}"] = set(names[:3])
    monkeypatch.setattr(S, "_lists", None)  # no posting list is asked for
    assert run(spark, sets) == brute_force(sets)


def test_small_pairs_of_blocks_at_once_equal_one_by_one():
    rng = random.Random(5)
    rows, sizes = [], []
    for tok in range(6):
        for i, j in ((0, 0), (0, 1)):
            blocks = [(b, sorted({tok, *rng.sample(range(12), rng.randint(1, 7))})) for b in sorted({i, j}) for _ in range(9)]
            rows += [(tok, b, i == j, sid + 100 * b, rng.random() < 0.7, skills) for sid, (b, skills) in enumerate(blocks)]
            sizes.append(len(blocks))
    tok, block, alone, sid, asks, skills = zip(*rows)
    sets = [np.array(s) for s in skills]
    for level, above in (((1, 2), None), ((7, 20), (1, 2))):
        got = S.compare_small(
            np.array(tok), np.array(block), np.array(alone), np.array(sid), np.array(asks),
            np.array([len(s) for s in sets]), np.concatenate(sets), np.array(sizes), level, above, 1000,
        )
        want, begin = [], 0
        for size in sizes:
            part = slice(begin, begin + size)
            begin += size
            sides = {}
            for b in sorted(set(block[part])):
                at = [x for x in range(part.start, part.stop) if block[x] == b]
                sides[b] = (np.array([sid[x] for x in at]), [sets[x] for x in at], np.array([asks[x] for x in at]))
            names = sorted(sides)
            for x, y in dict.fromkeys(((names[0], names[-1]), (names[-1], names[0]))):
                found = S.compare_blocks(tok[part.start], sides[x], sides[y], level, above, 1000)
                want += [] if found is None else list(zip(*(c.tolist() for c in found)))
        assert sorted(zip(*(c.tolist() for c in got))) == sorted(want)


def test_signatures_rule_out_far_pairs_and_no_near_one():
    """Sets of numbers that share bits, too: what is ruled out is below the level."""
    rng = np.random.default_rng(5)
    sets = [sorted(rng.choice(200, rng.integers(1, 8), replace=False)) for _ in range(300)]
    sets += [sorted({*s[:-1], s[0] + 64}) for s in sets[:100]]
    lengths = np.array([len(s) for s in sets])
    skills = np.full((len(sets), 9), -1, np.int64)
    for row, s in zip(skills, sets):
        row[: len(s)] = s
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    words, shared = S._signatures(skills, lengths)
    may = S._may_reach(a, b, words, shared, lengths, (7, 20))
    is_near = np.array([20 * len({*sets[i]} & {*sets[j]}) >= 7 * len({*sets[i]} | {*sets[j]}) for i, j in zip(a, b)])
    assert may[is_near].all() and is_near.sum() > len(sets)
    assert may.mean() < 0.2
