"""Whitening by Chebyshev-filtered subspace iteration.

The covariance is never formed. A pass multiplies a thin block Q by it: each task adds up Xc'(Xc Q) over its own rows, centred
before they are multiplied, and Spark adds the tasks' cells. A polynomial of the covariance, by the three-term recurrence, damps all
that lies in [low, high], the unwanted part of the spectrum, and lets everything above grow; QR and a Rayleigh-Ritz step on the
filtered block give the next bounds. It ends when the residuals of the wanted pairs are at rounding level.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import map_arrow

COMPONENTS, DEGREE, SEED = 8, 10, 7
#: Block width beyond the wanted components: the filter needs only the gap behind the whole block.
GUARD = 24
#: Residual of a wanted pair, relative to the largest eigenvalue: reached, or not falling any more below the second.
TOLERANCE, FLOOR = 1e-14, 1e-11
MOST_CYCLES = 200
#: Eigenvalues below this share of the largest are rounding: such a direction has no variance to scale.
FLAT = 1e-12
SCALE, SHIFT = 1024.0, 100_000
#: Entries c with |1024 c| beyond this have no long value that can be summed; their rows take no part.
LARGEST = float(1 << 40)


def grid(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that take part, their entries as whole numbers): lists of ``dims`` finite entries without null."""
    fits = pc.fill_null(pc.equal(pc.list_value_length(column), dims), False)
    rows = np.flatnonzero(fits.to_numpy(zero_copy_only=False))
    flat = column.take(pa.array(rows)).flatten().cast(pa.float64())
    c = flat.to_numpy(zero_copy_only=False).reshape(-1, dims)
    scaled = SCALE * c
    good = (np.isfinite(c) & (np.abs(scaled) < LARGEST)).all(axis=1)
    return rows[good], np.floor(scaled[good]).astype(np.int64) + SHIFT


def _cells(values: np.ndarray, kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.arange(values.size, dtype=np.int32)), pa.array(values.ravel()).cast(kind)], names=["cell", "value"])


def totals(vectors: DataFrame, dims: int) -> tuple[int, list[int]]:
    """n and the exact sums of each dimension."""

    def run(batches):
        for batch in batches:
            _, x = grid(batch.column(0), dims)
            yield _cells(np.append(x.sum(axis=0), len(x)), pa.int64())

    cells = map_arrow(vectors, run, "cell int, value long").groupBy("cell").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
    found = {r.cell: int(r.value) for r in cells}
    return found.get(dims, 0), [found.get(i, 0) for i in range(dims)]


def summed(vectors: DataFrame, dims: int, mean: np.ndarray, shape: tuple[int, ...], work) -> np.ndarray:
    """Sum over all rows of ``work(centred rows)``, an array of ``shape``: one partial array a task, added up by cell."""

    def run(batches):
        total = np.zeros(shape)
        for batch in batches:
            _, x = grid(batch.column(0), dims)
            if len(x):
                total += work(x - mean)
        yield _cells(total, pa.float64())

    cells = map_arrow(vectors, run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).toPandas()
    out = np.zeros(int(np.prod(shape)))
    out[cells.cell.to_numpy()] = cells.value.to_numpy()
    return out.reshape(shape)


def chebyshev(apply, block: np.ndarray, degree: int, low: float, high: float, top: float) -> np.ndarray:
    """Degree-``degree`` Chebyshev polynomial of [low, high], scaled to stay near one at ``top``, applied to the block."""
    middle, half = (high + low) / 2, max((high - low) / 2, 1e-6 * top)
    first = half / (top - middle)
    ratio, before, now = first, block, (apply(block) - middle * block) * (first / half)
    for _ in range(degree - 1):
        after = 1 / (2 / first - ratio)
        before, now = now, (apply(now) - middle * now) * (2 * after / half) - (ratio * after) * before
        ratio = after
    return now


def leading(apply, dims: int, components: int, degree: int = DEGREE) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit vectors (columns) of the operator behind ``apply``."""
    width, low, last = min(dims, components + GUARD), 0.0, np.inf
    block = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dims, width)))[0]
    for cycle in range(MOST_CYCLES):
        image = apply(block)
        values, turn = np.linalg.eigh((block.T @ image + image.T @ block) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        block, image = block @ turn, image @ turn
        top = values[0]
        if top <= 0:
            return np.zeros(0), block[:, :0]
        gaps = np.linalg.norm(image - block * values, axis=0)
        worst = gaps[:components].max() / top
        if worst <= TOLERANCE or (worst <= FLOOR and worst > last / 4):
            keep = [i for i in range(min(components, width)) if values[i] > FLAT * top]
            return values[keep], block[:, keep]
        last = worst
        if cycle == 0:
            low = max(0.0, values[-1] - gaps[-1])
        high = values[-1]
        block = np.linalg.qr(chebyshev(apply, block, degree, min(low, high), high, top + gaps[0]))[0]
    raise ArithmeticError(f"the leading components are not separated: residual {worst:.1e}")


def whiten(embeddings: DataFrame, components: int = COMPONENTS, vector: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: one row of each vector and component.

    Null vectors and vectors with null or non-finite entries take no part, nor do those of another length than most vectors
    have (at equal counts the longer length counts), empty ones, and entries beyond 2^40 / 1024. Repeated rows and null ids count
    and give their rows. With fewer dimensions there are fewer components; directions without variance can't be scaled to
    variance one and are left out, so a table of equal vectors, or an empty one, gives an empty result. ``deviation`` is null
    where it is no long. Components of equal eigenvalues are an arbitrary basis, the same for all rows. Other columns are ignored.
    """
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("embedding"))
    vectors = rows.select("embedding")
    lengths = vectors.where(F.size("embedding") > 0).groupBy(F.size("embedding").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    most = lengths.agg(F.max(F.struct("n", "size")).alias("m")).first().m
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    dims = most.size if most else 0
    n, sums = totals(vectors, dims) if dims else (0, [])
    if not n:
        return map_arrow(rows.where("false"), lambda batches: iter(()), schema)
    mean = np.array([s / n for s in sums])

    def apply(block: np.ndarray) -> np.ndarray:
        return summed(vectors, dims, mean, block.shape, lambda x: x.T @ (x @ block)) / n

    values, axes = leading(apply, dims, components)
    spread = float(summed(vectors, dims, mean, (1,), lambda x: np.array([np.einsum("ij,ij->", x, x)]))[0]) / n
    scaled = axes / np.sqrt(values)
    k = len(values)
    error = 0.0
    if k:
        square = summed(vectors, dims, mean, (k + 1, k), lambda x: np.vstack([(x @ scaled).T @ (x @ scaled), (x @ scaled).sum(axis=0)])) / n
        error = float(np.abs(square[:k] - np.outer(square[k], square[k]) - np.eye(k)).max())
    shares = values / spread if k else values
    # Exact in longs while n x - S, its square and their sum fit; whole numbers of any size beyond that.
    exact_sums = np.array(sums, dtype=object)

    def deviations(x: np.ndarray) -> pa.Array:
        reach = n * max(int(np.abs(x).max(initial=0)), 1) + max(map(abs, sums))
        if reach < 1 << 62:
            d = n * x - np.array(sums, dtype=np.int64)
            if dims * int(np.abs(d).max(initial=0)) ** 2 < 1 << 63:
                return pa.array((d * d).sum(axis=1))
        wide = ((n * x.astype(object) - exact_sums) ** 2).sum(axis=1)
        return pa.array([int(v) if v < 1 << 63 else None for v in wide], pa.int64())

    def run(batches):
        for batch in batches:
            at, x = grid(batch.column(1), dims)
            row = pa.array(np.repeat(np.arange(len(at)), k))
            ids, times = batch.column(0).take(pa.array(at)), len(at)
            yield pa.RecordBatch.from_arrays(
                [ids.take(row), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), times)), pa.array(np.full(k * times, n)), deviations(x).take(row),
                 pa.array(((x - mean) @ scaled).ravel()), pa.array(np.tile(shares, times)), pa.array(np.full(k * times, error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return map_arrow(rows, run, schema)
