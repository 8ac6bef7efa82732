"""Whitening of embeddings by the eigenvectors of their covariance, found by cyclic Jacobi rotations.

The fit list holds each different integer vector once. Executors sum it, then centre it and add up its scatter, one small matrix
a task. The driver turns the covariance by plane rotations, each of which makes one off-diagonal entry zero, in rounds of disjoint
planes, until every off-diagonal entry is negligible beside its own two diagonal entries; such a relative end keeps small eigenvalues
accurate. Eigenvectors are sorted by falling eigenvalue, scaled and broadcast, and each row is projected where it lies.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, vectors

SCALE = 256
COMPONENTS = 4
#: Sweeps over all planes, at most; a handful is what matrices need.
SWEEPS = 60
EPS = float(np.finfo(np.float64).eps)


def jacobi(symmetric: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in falling order and unit eigenvectors in columns.

    A sweep visits each plane (p, q) once: in each of its rounds all indices are paired, and the pairs' rotations, which do not
    touch each other's planes, are applied together.
    """
    a = np.array(symmetric, np.float64)
    n = len(a)
    turned = np.eye(n)
    seats = np.arange(n + n % 2)
    half = len(seats) // 2
    for _ in range(SWEEPS):
        diagonal = np.abs(np.diag(a))
        small = np.abs(a) <= EPS * np.sqrt(np.outer(diagonal, diagonal))
        np.fill_diagonal(small, True)
        if small.all():
            break
        for _ in range(len(seats) - 1):
            p, q = np.minimum(seats[:half], seats[::-1][:half]), np.maximum(seats[:half], seats[::-1][:half])
            seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])
            inside = q < n  # an odd index sits out
            p, q = p[inside], q[inside]
            open_ = a[p, q] != 0
            p, q = p[open_], q[open_]
            with np.errstate(over="ignore"):
                tau = (a[q, q] - a[p, p]) / (2 * a[p, q])
                t = np.where(tau >= 0, 1.0, -1.0) / (np.abs(tau) + np.hypot(1.0, tau))
            c = 1 / np.sqrt(1 + t * t)
            s = t * c
            one, other = a[p].copy(), a[q].copy()
            a[p], a[q] = c[:, None] * one - s[:, None] * other, s[:, None] * one + c[:, None] * other
            one, other = a[:, p].copy(), a[:, q].copy()
            a[:, p], a[:, q] = c * one - s * other, s * one + c * other
            a[p, q] = a[q, p] = 0.0
            one, other = turned[:, p].copy(), turned[:, q].copy()
            turned[:, p], turned[:, q] = c * one - s * other, s * one + c * other
    order = np.argsort(-np.diag(a), kind="stable")
    return np.diag(a)[order], turned[:, order]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - sums / n: the whole part of the mean is taken off as integers, the rest as a double."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])
    return (x - whole) - rest


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """Sum of (n * x - sums)^2 of each row, exactly, ``vectors.LONG`` at most."""
    about = (centred(x, n, sums) ** 2).sum(axis=1) * float(n) ** 2
    with np.errstate(over="ignore"):
        # 64-bit sums wrap, but are right below 2^63
        low = np.array([s & vectors.MASK for s in sums], np.uint64)
        off = x.astype(np.uint64) * np.uint64(n & vectors.MASK) - low
        out = (off * off).sum(axis=1).view(np.int64)
    for i in np.flatnonzero(about > 2.0**62):
        out[i] = min(vectors.LONG, sum((n * int(v) - s) ** 2 for v, s in zip(x[i], sums)))
    return out


def long_matrix(column: pa.Array, dim: int) -> np.ndarray:
    offsets = column.offsets.to_numpy()
    return column.values.slice(offsets[0], offsets[-1] - offsets[0]).to_numpy().reshape(-1, dim)


def added_up(fit: DataFrame, dim: int, size: int, make: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of the symmetric (size, size) matrix that ``make`` gives for a batch of rows; a task sends one matrix."""
    row, column = np.triu_indices(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            total += make(long_matrix(batch.column("x"), dim))
        yield pa.RecordBatch.from_arrays([pa.array(row, pa.int32()), pa.array(column, pa.int32()), pa.array(total[row, column])], ["i", "j", "v"])

    found = fit.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros((size, size))
    out[found["i"], found["j"]] = out[found["j"], found["i"]] = found["v"]
    return out


def counted(fit: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Rows, and the exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * dim
        for batch in batches:
            n += batch.num_rows
            sums = [a + b for a, b in zip(sums, vectors.column_sums(long_matrix(batch.column("x"), dim)))]
        yield pa.RecordBatch.from_arrays([pa.array(range(dim + 1), pa.int32()), pa.array([*sums, n], pa.decimal128(38, 0))], ["place", "total"])

    found = {r["place"]: int(r["total"]) for r in fit.mapInArrow(run, "place int, total decimal(38,0)").groupBy("place").agg(F.sum("total").cast("decimal(38,0)").alias("total")).collect()}
    return found[dim], [found[i] for i in range(dim)]


OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(table: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained and identity_error, one row for each row of ``table`` (vec_id, embedding) and component.

    Rows whose vector is null or holds null or non-finite components take no part. A component x counts as floor(scale * x), at most
    2^53 in absolute value; shorter vectors count as padded with zeros. ``n`` is the number of different vectors, the fit list, so
    repeated rows and groups of copies weigh once, but each row has its own result, with its vec_id, null or repeated.
    ``deviation`` is exact, 2^63 - 1 where it is beyond. Components without variance, whose eigenvalue is at the level of rounding, cannot
    be whitened and give no row: so equal vectors, a single vector and an empty table give no rows. Other columns are ignored.

    The driver holds a matrix of the dimensions' square; tasks hold one as well.
    """
    spark = table.sparkSession
    rows = vectors.finite_rows(table)
    dim = vectors.dimensions(rows)
    whole = rows.select("vec_id", vectors.integer_array(F.col("embedding"), scale, dim).alias("x"))
    fit = common.written(whole.select("x").distinct(), "fit-list") if dim else None
    n, sums = counted(fit, dim) if dim else (0, [])
    if n < 2:
        return spark.createDataFrame([], OUT)
    cov = added_up(fit, dim, dim, lambda x: (lambda y: y.T @ y)(centred(x, n, sums))) / n
    values, axes = jacobi(cov)
    trace = float(np.trace(cov))
    k = int((values[:components] > dim * EPS * trace).sum())
    if not k:
        return spark.createDataFrame([], OUT)
    shared = spark.sparkContext.broadcast(axes[:, :k] / np.sqrt(values[:k]))
    told = added_up(fit, dim, k, lambda x: (lambda y: y.T @ y)(centred(x, n, sums) @ shared.value)) / n
    error = float(np.abs(told - np.eye(k)).max())
    explained = values[:k] / trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, m = long_matrix(batch.column("x"), dim), batch.num_rows
            at = np.repeat(np.arange(m), k)
            each = [
                batch.column("vec_id").take(pa.array(at)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, n)),
                pa.array(deviations(x, n, sums)[at]),
                pa.array((centred(x, n, sums) @ shared.value).reshape(-1)),
                pa.array(np.tile(explained, m)),
                pa.array(np.full(m * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(each, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return whole.mapInArrow(run, OUT)


def query(spark, sf_dir: str) -> DataFrame:
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
