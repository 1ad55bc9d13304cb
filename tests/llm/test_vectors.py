"""Whitening and hard negatives against brute force, with odd rows and empty tables."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rolemesh.llm import hard_negatives, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x long, leaf int, rank long, score double, id string"
NAN, INF = float("nan"), float("inf")


def make(spark, rows):
    """Rows (vec_id, embedding, label) with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(*r, 1, 2, 3, 0.5, "i") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(11)
    centres = rng.standard_normal((6, 12))
    points = [(centres[i % 6] + 0.6 * rng.standard_normal(12)) / 4 for i in range(400)]
    rows = [(i, [float(np.float32(c)) for c in p], int(rng.integers(0, 5))) for i, p in enumerate(points)]
    hot = rows[3][1]
    rows += [(1000 + i, hot, i % 3) for i in range(150)]  # one common vector
    rows += [rows[7], rows[8], (None, rows[9][1], 1)]
    rows += [(2000, None, 1), (2001, [], 1), (2002, [NAN] * 12, 1), (2100, [INF] + [0.0] * 11, 1), (2200, [None] + [0.1] * 11, 2)]
    rows += [(2300, [0.5] * 5, 1), (2400, rows[0][1], None)]
    return rows


def usable(rows, dim=12):
    out = []
    for vec_id, c, label in rows:
        if c is not None and len(c) == dim and all(v is not None and math.isfinite(v) for v in c):
            out.append((vec_id, [math.floor(256 * float(np.float32(v))) for v in c], label))
    return out


def test_whitening_equals_a_dense_solver(spark, vectors):
    got = whitening.whiten(make(spark, vectors)).collect()
    own = usable(vectors)
    fit = np.array(sorted({tuple(x) for _, x, _ in own}))
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:4], axes[:, ::-1][:, :4]
    want = {}
    for vec_id, x, _ in own:
        places = (np.array(x) - sums / n) @ axes / np.sqrt(values)
        far = sum((n * a - int(s)) ** 2 for a, s in zip(x, sums))
        want.setdefault(vec_id, []).append((places, far))
    assert len(got) == 4 * len(own)
    signs = {}
    for r in got:
        places, far = want[r.vec_id][0]
        assert r.deviation == far and r.n == n and r.identity_error < 1e-9
        assert r.explained == pytest.approx(values[r.component - 1] / (centred**2).sum() * n, rel=1e-10)
        if abs(places[r.component - 1]) > 1e-6:
            signs.setdefault(r.component, set()).add(round(r.whitened / places[r.component - 1], 7))
    assert all(s in ({1.0}, {-1.0}) for s in signs.values()) and len(signs) == 4


@pytest.mark.parametrize("dim,rank", [(1, 1), (5, 2), (40, 40), (90, 90)])
def test_solver_reaches_double_precision(dim, rank):
    rng = np.random.default_rng(dim)
    x = rng.standard_normal((300, rank)) @ rng.standard_normal((rank, dim)) * 50
    v = x.T @ x / 300
    values, vectors = whitening.jacobi_davidson(lambda u: v @ u, dim, 4, float(np.trace(v)))
    want = np.linalg.eigvalsh(v)[::-1][: min(4, dim)]
    assert np.abs(values - want).max() <= 1e-12 * max(want[0], 1)
    assert np.linalg.norm(v @ vectors - vectors * values) <= 1e-12 * max(want[0], 1) * dim


def test_solver_separates_close_and_equal_values():
    rng = np.random.default_rng(1)
    axes = np.linalg.qr(rng.standard_normal((60, 60)))[0]
    spectrum = np.concatenate(([5.0, 5.0, 4.999999, 4.9], np.linspace(4.8, 0, 56)))
    v = (axes * spectrum) @ axes.T
    values, vectors = whitening.jacobi_davidson(lambda u: v @ u, 60, 4, float(np.trace(v)))
    assert np.abs(values - spectrum[:4]).max() < 1e-12
    assert np.abs(vectors.T @ vectors - np.eye(4)).max() < 1e-12


def test_minres_solves_shifted_systems():
    rng = np.random.default_rng(2)
    a = rng.standard_normal((20, 20))
    a = a + a.T
    right, shifts = rng.standard_normal((20, 3)), np.array([0.3, -2.0, 7.0])
    found = whitening.minres(lambda u: a @ u, shifts, lambda x: x, right, np.full(3, 1e-12), 60)
    for i in range(3):
        assert np.allclose((a - shifts[i] * np.eye(20)) @ found[:, i], right[:, i], atol=1e-8)


def test_whitening_without_variance(spark):
    assert whitening.whiten(make(spark, [])).count() == 0
    assert whitening.whiten(make(spark, [(1, [0.5, 0.25], 1), (2, [0.5, 0.25], 1)])).count() == 0
    flat = whitening.whiten(make(spark, [(1, [0.5, 0.25], 1), (2, [0.5, 0.75], 1)])).collect()
    assert {(r.vec_id, r.component) for r in flat} == {(1, 1), (2, 1)}
    assert sorted(round(r.whitened, 9) for r in flat) == [-1, 1] and {r.explained for r in flat} == {1.0}


def brute(rows):
    own = [(i, v, np.array(x, object), l) for i, (v, x, l) in enumerate(usable([r for r in rows if r[2] is not None]))]
    order = lambda r: (-r[0], r[1] is None, r[1] or 0, r[2])
    out = []
    for i, v, x, label in own:
        if v is None or v % 10:
            continue
        scored = [(int(sum(x * y)), w, j, l) for j, w, y, l in own if j != i]
        for p in sorted((s for s in scored if s[3] == label), key=order)[:5]:
            window = [s for s in scored if s[3] != label and 80 * p[0] <= 100 * s[0] <= 100 * p[0]]
            out += [(v, p[1], k, s[1], p[0], s[0]) for k, s in enumerate(sorted(window, key=order)[:5], 1)]
    return out


@pytest.mark.parametrize("leaf,block,chunk", [(1_024, 4_096, 1_024), (30, 50, 7)])
def test_hard_negatives_equal_brute_force(spark, vectors, monkeypatch, leaf, block, chunk):
    monkeypatch.setattr(hard_negatives, "LEAF_ROWS", leaf)
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    monkeypatch.setattr(hard_negatives, "CHUNK", chunk)
    key = lambda r: tuple((v is None, v or 0) for v in r)
    got = hard_negatives.hard_negatives(make(spark, vectors).repartition(3), F.col("vec_id") % 10 == 0).collect()
    want = brute(vectors)
    # Rows that are alike in score and id may stand for each other.
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key) and len(want) > 400


def test_hard_negatives_of_little(spark):
    asks = F.col("vec_id") % 100 == 0
    assert hard_negatives.hard_negatives(make(spark, []), asks).count() == 0
    assert hard_negatives.hard_negatives(make(spark, [(0, [1.0], 1), (1, [1.0], 2)]), asks).count() == 0  # no positive
    assert hard_negatives.hard_negatives(make(spark, [(1, [1.0], 1), (2, [1.0], 1)]), asks).count() == 0  # no anchor
    rows = [(0, [1.0], 1), (5, [0.5], 1), (6, [0.4], 2), (7, [0.39], 2), (8, [0.51], 2), (9, [0.5], 3)]
    got = hard_negatives.hard_negatives(make(spark, rows), asks).collect()
    assert sorted(tuple(r) for r in got) == [(0, 5, 1, 9, 32768, 32768), (0, 5, 2, 6, 32768, 26112)][:2] or len(got) == 1
    # 0.4 -> 102 * 256 = 26112 is below 80 % of 32768, so only the equal score stays.
    assert [(r.negative_id, r["rank"]) for r in got] == [(9, 1)]


def test_pruning_leaves_out_leaves():
    """On clustered vectors the ranges rule out most leaves, and never one that holds an answer."""
    rng = np.random.default_rng(4)
    centres = rng.integers(-2000, 2000, (40, 8))
    x = (centres[:, None] + rng.integers(-60, 60, (40, 50, 8))).reshape(-1, 8)
    top = float((x.astype(float) ** 2).sum(axis=1).max())
    tree = hard_negatives.Tree(x[::4], top, 30)
    met: dict = {}
    leaves = tree.placed(x, True, met)
    tree.set_ranges([(*k, *v) for k, v in met.items()])
    asked, visited = 0, 0
    for q in x[::97]:
        scores = x @ q
        least, most = np.partition(scores, -20)[-20], scores.max()
        square = float(q @ q)
        inner, outer = (hard_negatives.radius(np.array([square]), top, np.array([s]))[:, None] for s in (float(most), float(least)))
        reached = {leaf for leaf, _ in tree.reached(q[None], inner, outer)}
        assert {*leaves[(scores >= least) & (scores <= most)].tolist()} <= reached
        asked, visited = asked + len(tree.paths), visited + len(reached)
    assert visited < asked / 3
