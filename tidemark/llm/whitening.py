"""Whitening of embeddings by a two-pass covariance.

Vectors become whole numbers on a fixed grid, and each distinct one counts once. The first pass adds them exactly, which
gives the mean; the second centres them, multiplies blocks (NumPy) and merges the products in a tree; LAPACK's symmetric
solver gives the components, which go to the workers as one matrix. A third pass over the same vectors measures the
covariance of what comes out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, written

#: An entry c becomes floor(SCALE * c) + SHIFT; beyond this absolute value a double doesn't hold it exactly, and the row counts as not finite.
SCALE, SHIFT, LARGEST = 64, 1_000_000, 1 << 52
#: Components that are returned at most; one with less than this share of the variance has no direction.
COMPONENTS, LEAST_SHARE = 16, 1e-11
#: Bits of the lower half of a sum.
HALF = 26
#: Rows of a block that is multiplied at once.
BLOCK = 4096
#: Levels of the merging tree.
DEPTH = 3


def on_grid(vector: Column) -> Column:
    """The vector in whole numbers; null if it is null or holds a null, a non-finite or a too large entry."""
    doubles = vector.cast("array<double>")
    good = F.forall(doubles, lambda c: F.coalesce(F.abs(c * SCALE) < LARGEST - SHIFT, F.lit(False)))  # NaN is larger than any number
    return F.when(good, F.transform(doubles, lambda c: F.floor(c * SCALE).cast("long") + SHIFT))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column whose lists have one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class Whitener(NamedTuple):
    """``centre``: whole numbers near the mean, ``rest``: what the mean has besides; ``axes``: a component a column, divided by its deviation."""

    n: int
    sums: list[int]
    centre: np.ndarray
    rest: np.ndarray
    axes: np.ndarray
    explained: np.ndarray


def centred(x: np.ndarray, centre: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Exact before the remainder is taken off."""
    return (x - centre) - rest


def _tree_sum(fit: DataFrame, block_sum: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int], kind: type = np.float64) -> np.ndarray:
    """The sum of ``block_sum`` over blocks of all vectors: one array a task, merged in a tree."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, kind)
        for batch in batches:
            x = _matrix(batch.column(0))
            for at in range(0, len(x), BLOCK):
                total += block_sum(x[at : at + BLOCK])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    parts = fit.select("x").mapInArrow(partial, "part binary").rdd
    return parts.treeAggregate(np.zeros(shape, kind), lambda a, row: a + np.frombuffer(row.part, kind).reshape(shape), lambda a, b: a + b, depth=DEPTH)


def _exact_sums(fit: DataFrame, dim: int) -> tuple[int, list[int]]:
    """The number of vectors and the sum of each dimension. Upper and lower bits are added apart, so that neither exceeds a long."""

    def halves(x: np.ndarray) -> np.ndarray:
        counted = np.hstack([np.ones((len(x), 1), np.int64), x])
        return np.stack([(counted >> HALF).sum(0), (counted & ((1 << HALF) - 1)).sum(0)])

    upper, lower = _tree_sum(fit, halves, (2, dim + 1), np.int64).tolist()
    total = [(a << HALF) + b for a, b in zip(upper, lower, strict=True)]
    return total[0], total[1:]


def fitted(fit: DataFrame, dim: int) -> Whitener:
    """The whitener of distinct vectors ``x`` of ``dim`` entries, at least one of each."""
    n, sums = _exact_sums(fit, dim)
    centre = np.array([round(Fraction(s, n)) for s in sums], np.int64)
    rest = np.array([float(Fraction(s, n) - int(c)) for s, c in zip(sums, centre, strict=True)])

    def outer(x: np.ndarray) -> np.ndarray:
        y = centred(x, centre, rest)
        return y.T @ y

    v = _tree_sum(fit, outer, (dim, dim)) / n
    e, u = np.linalg.eigh((v + v.T) / 2)
    e, u = e[::-1][:COMPONENTS], u[:, ::-1][:, :COMPONENTS]
    trace = np.trace(v)
    real = e > LEAST_SHARE * trace
    e, u = e[real], u[:, real]
    return Whitener(n, sums, centre, rest, u / np.sqrt(e), e / trace if trace else e)


def identity_error(fit: DataFrame, net: Whitener) -> float:
    """The largest absolute entry of the outputs' covariance, minus the identity, over the fitted vectors."""
    _, _, centre, rest, axes, _ = net
    k = axes.shape[1]
    if not k:
        return 0.0
    mean = _tree_sum(fit, lambda x: (centred(x, centre, rest) @ axes).sum(0, keepdims=True), (1, k)) / net.n

    def outer(x: np.ndarray) -> np.ndarray:
        y = centred(x, centre, rest) @ axes - mean
        return y.T @ y

    return float(np.abs(_tree_sum(fit, outer, (k, k)) / net.n - np.eye(k)).max())


def deviations(x: np.ndarray, n: int, sums: list[int], centre: np.ndarray) -> list[int | None]:
    """The sums of (n x - S) squared, exact: in longs if all fit, else number by number; null beyond a long."""
    most = (1 << 63) - 1
    off = [s - n * int(c) for s, c in zip(sums, centre, strict=True)]
    near = x - centre
    reach = n * int(np.abs(near).max(initial=0)) + max(map(abs, off))
    if reach * reach * len(off) <= most:
        return ((near * n - np.array(off)) ** 2).sum(1).tolist()
    exact = (sum((int(v) * n - o) ** 2 for v, o in zip(row, off, strict=True)) for row in near)
    return [v if v <= most else None for v in exact]


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each row and component: ``vec_id, component`` (from 1), ``n, deviation, whitened, explained, identity_error``.

    Rows whose vector is null or has a null, a non-finite or a huge entry (``LARGEST``) are dropped, and so are those
    that don't have the commonest length (the longest of several). Repeated rows are all returned, but each distinct
    vector counts once in the fit. A direction without variance is no component, so vectors that are all the same give no
    rows, as an empty table does. ``deviation`` is null where it exceeds a long. Null ids are kept, other columns ignored.
    """
    spark = rows.sparkSession
    kind = rows.schema[id_col].dataType.simpleString()
    known = rows.select(F.col(id_col).alias("vec_id"), on_grid(F.col(vector_col)).alias("x")).where("x IS NOT NULL")
    lengths = known.groupBy(F.size("x").alias("dim")).agg(F.count("*").alias("n"))
    top = lengths.agg(F.max_by("dim", F.struct("n", "dim")).alias("dim")).first()
    dim = top.dim or 0
    known = known.where(F.size("x") == dim)
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not dim:
        return spark.createDataFrame([], schema)
    fit = written(known.select("x").distinct(), "distinct")
    net = fitted(fit, dim)
    error = identity_error(fit, net)
    dropped(fit)
    shared = spark.sparkContext.broadcast(tuple(net))  # its largest part is a matrix of dim x COMPONENTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, centre, rest, axes, explained = shared.value
        k = axes.shape[1]
        for batch in batches:
            for at in range(0, len(batch) if k else 0, BLOCK):
                part = batch.slice(at, BLOCK)
                x, rows = _matrix(part.column(1)), len(part)
                each = pa.array(np.repeat(np.arange(rows), k))
                columns = [
                    part.column(0).take(each),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * k, n, np.int64)),
                    pa.array(deviations(x, n, sums, centre), pa.int64()).take(each),
                    pa.array((centred(x, centre, rest) @ axes).ravel()),
                    pa.array(np.tile(explained, rows)),
                    pa.array(np.full(rows * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return known.mapInArrow(run, schema)
