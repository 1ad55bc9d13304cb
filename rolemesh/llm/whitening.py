"""Whitening of embeddings with a distributed Jacobi-Davidson solver.

The covariance of the distinct vectors is never formed. A product with it is one pass over
the stored vectors: every task centres its rows, multiplies, and hands on one small matrix.
The solver keeps a search space on the driver (dimension x at most MAX_SPACE numbers). Each
round takes Ritz pairs of that space, locks those whose residual has reached double
precision, and widens the space by approximate solutions of the projected correction
equations, all of which run through MINRES in lockstep so that one pass serves them all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import stored

COMPONENTS = 4
SCALE = 256
GUARDS = 2  # pairs sought beyond the wanted ones, so that none is overlooked
INNER = 6  # MINRES steps per round at most
ROUNDS = 200
MAX_SPACE = 48
PARTIALS = 1_024  # tasks of a pass, each of which hands one small matrix to the driver
ROUNDING = 2.0**-48  # times the root of the dimension: a residual below this share of the largest value is rounding

Product = Callable[[np.ndarray], np.ndarray]


# --- the solver ------------------------------------------------------------------


def _without(v: np.ndarray, basis: np.ndarray) -> np.ndarray:
    for _ in range(2):  # the second time removes what rounding left
        v = v - basis @ (basis.T @ v)
    return v


def _widened(space: np.ndarray, more: np.ndarray, locked: np.ndarray) -> np.ndarray:
    """New orthonormal columns for ``more``, orthogonal to the space and to what is locked."""
    new = np.zeros((len(more), 0))
    for v in more.T:
        size = np.linalg.norm(v)
        if not np.isfinite(size) or size == 0:
            continue
        v = v / size
        for basis in (locked, space, new) * 2:
            v = _without(v, basis)
        size = np.linalg.norm(v)
        if size > 1e-10:
            new = np.column_stack((new, v / size))
    return new


def minres(product: Product, shifts: np.ndarray, project: Callable, right: np.ndarray, target: np.ndarray, steps: int) -> np.ndarray:
    """Approximate solutions t of P (A - shift) P t = right, a column each, in lockstep.

    ``project`` applies each column's projector P. A column rests once its residual is below
    its ``target`` share of the right side.
    """
    n, m = right.shape
    v = project(right)
    beta = np.linalg.norm(v, axis=0)
    first = np.where(beta > 0, beta, 1.0)
    v = v / first
    phi = beta.copy()
    solution, old_v = np.zeros((n, m)), np.zeros((n, m))
    w1, w2 = np.zeros((n, m)), np.zeros((n, m))
    cos, sin = -np.ones(m), np.zeros(m)
    delta, epsilon, link = np.zeros(m), np.zeros(m), np.zeros(m)
    for _ in range(steps):
        active = np.flatnonzero((phi > target * first) & (beta > 0))
        if not len(active):
            break
        image = np.zeros((n, m))
        image[:, active] = product(v[:, active])
        image = project(image - v * shifts)
        alpha = (v * image).sum(axis=0)
        fresh = image - v * alpha - old_v * link
        fresh -= v * (v * fresh).sum(axis=0)
        grown = np.linalg.norm(fresh, axis=0)
        # The last two rotations applied to the new column of the tridiagonal matrix.
        turned = cos * delta + sin * alpha
        bar = sin * delta - cos * alpha
        before, epsilon = epsilon, sin * grown
        delta = -cos * grown
        gamma = np.hypot(bar, grown)
        ok = np.zeros(m, bool)
        ok[active] = gamma[active] > 1e-300
        safe = np.where(gamma > 1e-300, gamma, 1.0)
        cos, sin = bar / safe, grown / safe
        step = cos * phi
        w = (v - w1 * turned - w2 * before) / safe
        solution += np.where(ok, step, 0.0) * np.where(ok, w, 0.0)
        w2, w1 = w1, w
        phi = np.where(ok, np.abs(sin) * phi, 0.0)
        old_v, v, link = v, fresh / np.where(grown > 1e-300, grown, 1.0), grown
        beta = np.where(ok & (grown > 1e-14 * first), beta, 0.0)
    return solution


def jacobi_davidson(product: Product, dim: int, wanted: int, norm: float) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues (falling) and unit eigenvectors of a symmetric operator.

    ``norm`` bounds the operator (its trace). Pairs are locked from the largest down, once
    their residual is rounding. As many as ``wanted`` or ``dim``, whichever is less.
    """
    wanted = min(wanted, dim)
    sought = min(wanted + GUARDS, dim)
    start = np.random.default_rng(7).standard_normal((dim, min(dim, 2 * sought)))
    locked, values = np.zeros((dim, 0)), []
    space = _widened(np.zeros((dim, 0)), start, locked)
    images = product(space)
    for turn in range(ROUNDS):
        inner = space.T @ images
        ritz, rotation = np.linalg.eigh((inner + inner.T) / 2)
        order = np.argsort(-ritz)
        ritz, rotation = ritz[order], rotation[:, order]
        space, images = space @ rotation, images @ rotation
        take = min(sought - len(values), space.shape[1])
        error = images[:, :take] - space[:, :take] * ritz[:take]
        error = _without(error, locked)
        sizes = np.linalg.norm(error, axis=0)
        whole = space.shape[1] + locked.shape[1] >= dim
        top = max(abs(ritz[0]) if len(ritz) else 0.0, max(values, default=0.0))
        done = 0
        while done < take and len(values) + done < wanted and (
            whole or sizes[done] <= ROUNDING * np.sqrt(dim) * max(top, norm / dim)
        ):
            done += 1
        if done:
            locked = np.column_stack((locked, space[:, :done]))
            values += ritz[:done].tolist()
            space, images = space[:, done:], images[:, done:]
            ritz, error, sizes = ritz[done:], error[:, done:], sizes[done:]
            take -= done
        if len(values) >= wanted:
            break
        if space.shape[1] + take > MAX_SPACE:  # thick restart
            keep = min(space.shape[1], max(2 * sought, MAX_SPACE // 3))
            space, images = space[:, :keep], images[:, :keep]
        near = space[:, :take]

        def project(x: np.ndarray, near: np.ndarray = near, locked: np.ndarray = locked) -> np.ndarray:
            return _without(x, np.column_stack((locked, near)))

        # Looser far from the solution, where an exact step would be wasted.
        target = np.full(take, max(1e-4, 2.0 ** -(turn + 2)))
        more = minres(product, ritz[:take], project, -error, target, INNER)
        fresh = _widened(space, more, locked)
        if not fresh.shape[1]:
            fresh = _widened(space, np.random.default_rng(turn).standard_normal((dim, take)), locked)
        if not fresh.shape[1]:
            continue
        space = np.column_stack((space, fresh))
        images = np.column_stack((images, product(fresh)))
    else:
        raise ArithmeticError("the residuals did not reach double precision")
    order = np.argsort(-np.array(values), kind="stable")
    vectors = locked[:, order]
    lead = np.abs(vectors).argmax(axis=0)
    return np.array(values)[order], vectors * np.sign(vectors[lead, np.arange(wanted)])


# --- the vectors -----------------------------------------------------------------


@dataclass
class Fit:
    """Moments and components of the fit list."""

    n: int
    sums: np.ndarray  # exact, as Python integers
    largest: int
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float


def grid_vectors(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """``rows`` with the integer vector x = floor(256 c) of each row whose entries are all finite.

    Rows with a null or empty vector, or a null or non-finite entry, go. A vector whose length
    is not that of most rows (the longer of two equally frequent) goes too: it has no
    covariance with the others.
    """
    usable = F.col(vector).isNotNull() & F.forall(vector, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)))
    kept = rows.where(usable & (F.size(vector) > 0))
    best = kept.groupBy(F.size(vector).alias("d")).count().agg(F.max(F.struct("count", "d")).alias("m")).first().m
    width = best.d if best else 0
    cell = lambda c: F.floor(c.cast("double") * SCALE).cast("long")
    return kept.where(F.size(vector) == width).withColumn("x", F.transform(vector, cell))


def matrix(column: pa.Array, rows: int) -> np.ndarray:
    """The lists of an Arrow column as the rows of a matrix."""
    flat = pc.list_flatten(column).to_numpy(zero_copy_only=False)
    return flat.reshape(rows, -1)


def _partials(points: DataFrame, part: Callable[[np.ndarray], np.ndarray], zero: np.ndarray) -> np.ndarray:
    """Sum over all vectors of ``part`` (a batch of rows to one array of the shape of ``zero``).

    At most PARTIALS tasks hand on one array each; they are added in the order of the
    partitions, so that a repeated pass gives the same bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = zero.copy()
        for batch in batches:
            if batch.num_rows:
                total += part(matrix(batch.column("x"), batch.num_rows))
        yield pa.RecordBatch.from_arrays(
            [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "total"]
        )

    found = points.coalesce(PARTIALS).mapInArrow(run, "part int, total binary").collect()
    out = zero.copy()
    for row in sorted(found, key=lambda r: r.part):
        out += np.frombuffer(row.total, zero.dtype).reshape(zero.shape)
    return out


def fit(points: DataFrame, wanted: int = COMPONENTS) -> Fit | None:
    """Components of the covariance of the stored vectors ``x``, each of which counts once.

    Covariances divide by n. Directions without variance are no components; None for no rows.
    """
    moments = points.select(F.size("x").alias("d"), F.array_max("x").alias("hi"), F.array_min("x").alias("lo"))
    first = moments.agg(
        F.count("*").alias("n"), F.max("d").alias("d"), F.max("hi").alias("hi"), F.min("lo").alias("lo")
    ).first()
    if not first.n:
        return None
    n, dim, largest = first.n, first.d, max(abs(first.hi), abs(first.lo))
    # Two halves of 32 bits each, so that no sum can overflow.
    halves = _partials(points, lambda x: np.stack(((x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0))), np.zeros((2, dim), np.int64))
    sums = np.array([(int(a) << 32) + int(b) for a, b in halves.T], object)
    mean = np.array([s / n for s in sums], float)

    def squares(x: np.ndarray) -> np.ndarray:
        return np.array([((x - mean) ** 2).sum()])

    trace = float(_partials(points, squares, np.zeros(1))[0]) / n

    def product(u: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            centred = x - mean
            return centred.T @ (centred @ u)

        return _partials(points, part, np.zeros(u.shape)) / n

    if trace == 0:
        return Fit(n, sums, largest, np.zeros(0), np.zeros((dim, 0)), 0.0, 0.0)
    values, vectors = jacobi_davidson(product, dim, wanted, trace)
    some = values > 1e-12 * trace
    values, vectors = values[some], vectors[:, some]
    scaled = vectors / np.sqrt(values)
    centre = _partials(points, lambda x: ((x - mean) @ scaled).sum(axis=0), np.zeros(len(values))) / n

    def spread(x: np.ndarray) -> np.ndarray:
        w = (x - mean) @ scaled - centre
        return w.T @ w

    found = _partials(points, spread, np.zeros((len(values), len(values)))) / n
    error = float(np.abs(found - np.eye(len(values))).max(initial=0.0))
    return Fit(n, sums, largest, values, vectors, trace, error)


_ADDED = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(rows: DataFrame, found: Fit | None, keep: list[str]) -> DataFrame:
    """For each row and component: the columns ``keep`` of the row, and the whitened coordinate.

    deviation is exact; a value beyond 64 bits raises an error instead of a wrong number.
    """
    schema = T.StructType([rows.schema[c] for c in keep] + list(T._parse_datatype_string(_ADDED).fields))
    k = len(found.values) if found else 0
    if not k:
        return rows.sparkSession.createDataFrame([], schema)
    n, sums = found.n, found.sums
    mean = np.array([s / n for s in sums], float)
    scaled = found.vectors / np.sqrt(found.values)
    explained, error = found.values / found.trace, found.identity_error
    dim = len(mean)
    # |n x - S| <= 2 n max|x|
    small = dim * (2 * n * found.largest) ** 2 < 1 << 63

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact = np.array(sums, np.int64) if small else sums
        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            x = matrix(batch.column("x"), size)
            apart = ((x if small else x.astype(object)) * n - exact) ** 2
            places = (x - mean) @ scaled
            at = pa.array(np.repeat(np.arange(size), k))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(at) for c in keep]
                + [
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), size)),
                    pa.array(np.full(size * k, n, np.int64)),
                    pa.array([int(v) for v in apart.sum(axis=1)], pa.int64()).take(at),
                    pa.array(places.reshape(-1)),
                    pa.array(np.tile(explained, size)),
                    pa.array(np.full(size * k, error)),
                ],
                names=schema.names,
            )

    return rows.select(*keep, "x").mapInArrow(run, schema)


def whiten(rows: DataFrame, vector: str = "embedding", key: str = "vec_id", wanted: int = COMPONENTS) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) of every usable row.

    Rows without a usable vector (:func:`grid_vectors`) go; a null or repeated key is kept, and
    repeated rows are repeated. Equal vectors count once in the fit. An empty table, a single
    distinct vector and directions without variance give no rows. Other columns of ``rows``,
    whatever their names, are not read.
    """
    own = rows.select(F.col(key).alias("id"), F.col(vector).alias("vector"))
    cells = stored(grid_vectors(own, "vector").select("id", "x"), "vectors")
    found = fit(stored(cells.select("x").distinct(), "fit"), wanted)
    return whitened(cells, found, ["id"]).withColumnRenamed("id", key)
