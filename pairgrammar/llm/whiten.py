"""Whitening of integer-scaled vectors: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the factor."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairgrammar.session import scratch_path

SCALE, OFFSET = 64, 1_000_000
LARGEST = 2.0**53  # scaled entries beyond saturate here
SWEEPS = 60  # Jacobi ends by itself once all columns are orthogonal, mostly after about ten
RESULT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def pivoted_cholesky(scatter: np.ndarray) -> np.ndarray:
    """``factor`` (dimensions x rank) with factor @ factor.T = scatter; its rows in pivot order are lower triangular.

    The next pivot is the dimension with the most left; what is left below rounding of the trace is none.
    """
    d = len(scatter)
    factor, left, order = np.zeros((d, d)), scatter.diagonal().copy(), np.arange(d)
    least = d * np.finfo(float).eps * max(0.0, left.sum())
    for k in range(d):
        at = k + int(np.argmax(left[order[k:]]))
        if left[order[at]] <= least:
            return factor[:, :k]
        order[[k, at]] = order[[at, k]]
        pivot, rest = order[k], order[k + 1:]
        factor[pivot, k] = np.sqrt(left[pivot])
        factor[rest, k] = (scatter[rest, pivot] - factor[rest, :k] @ factor[pivot, :k]) / factor[pivot, k]
        left[rest] -= factor[rest, k] ** 2
    return factor


def jacobi(factor: np.ndarray) -> np.ndarray:
    """The factor's columns turned in pairs until all are orthogonal, longest first."""
    columns = np.ascontiguousarray(factor.T)
    for _ in range(SWEEPS):
        turned = False
        for p in range(len(columns) - 1):
            for q in range(p + 1, len(columns)):
                a, b = columns[p], columns[q]
                aa, bb, ab = a @ a, b @ b, a @ b
                if abs(ab) <= 1e-15 * np.sqrt(aa * bb):
                    continue
                turned = True
                zeta = (bb - aa) / (2 * ab)
                t = np.copysign(1.0, zeta) / (abs(zeta) + np.hypot(1.0, zeta))
                c = 1 / np.hypot(1.0, t)
                columns[p], columns[q] = c * (a - t * b), c * (b + t * a)
        if not turned:
            break
    return columns[np.argsort(-(columns**2).sum(axis=1), kind="stable")].T


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _grid_sums(rows: DataFrame, width: int, table) -> dict[tuple[int, int], float]:
    """Cells (i, j) of a square table that every task adds up for its rows, then summed by cell: ``width`` squared values."""
    def run(batches):
        total = None
        for batch in batches:
            part = table(batch.column(0))
            total = part if total is None else total + part
        if total is not None:
            i, j = np.indices(total.shape).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel())], ["i", "j", "v"])

    cells = rows.select("x").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    return {(r["i"], r["j"]): r["v"] for r in cells.collect()}


def _sums(fit: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and the exact sum of each dimension."""
    def run(batches):
        n, high, low = 0, 0, 0
        for batch in batches:
            x = batch.column(0)
            if len(x):
                x = _matrix(x, len(x[0]))
                n, high, low = n + len(x), high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)
        if n:
            d = len(high)
            yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array(high), pa.array(low)], ["i", "n", "high", "low"])

    total = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    found = fit.select("x").mapInArrow(run, "i int, n long, high long, low long").groupBy("i").agg(total("n"), total("high"), total("low")).collect()
    found = sorted(found, key=lambda r: r["i"])
    return int(found[0]["n"]), [(int(r["high"]) << 32) + int(r["low"]) for r in found]


def _deviation(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2, exact; null where a long cannot hold it."""
    most = max(float(np.abs(x).max(initial=0)) * n, max(map(abs, sums)))
    rough = n * x.astype(float) - np.array(sums, float)
    if most < 2**62 and float((rough**2).sum(axis=1).max(initial=0)) < 2**62:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    exact = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]
    return [v if v < 2**63 else None for v in exact]


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 16, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """``key``, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``: a row for each vector and component.

    A vector's entries become x = floor(scale * entry) + offset. The fit list holds each distinct x
    vector once; its sums are exact integers, and its scatter is summed from entries centred first, as
    partial tables in the tasks. Cholesky with pivots and Jacobi turns work on a table of dimensions
    squared, whatever the number of rows. Components are numbered from 1 by falling eigenvalue, with
    their largest entry positive; there are at most ``components`` and no more than the scatter's rank.
    ``identity_error`` is measured on the whitened fit list. ``deviation`` is null beyond a long.

    Null vectors and those with null or non-finite entries take no part, nor do vectors of another length
    than the most frequent one (of equally frequent ones the longest). Scaled entries
    saturate at 2^53. Null and repeated keys keep their rows, each with its own results; repeated vectors count
    once in the fit. Equal eigenvalues may take any basis. An empty table, or one whose vectors are all
    alike, has no component and gives no rows.
    """
    spark = rows.sparkSession
    given = rows.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"))
    fine = given.where(F.col("v").isNotNull() & F.forall("v", lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False))))
    scaled = fine.select("key", F.transform("v", lambda c: F.floor(F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), c * float(scale)))) + offset).alias("x"))
    width = scaled.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    empty = spark.createDataFrame([], f"{key} {rows.schema[key].dataType.simpleString()}, {RESULT}")
    if width is None or not width["d"]:
        return empty
    d = width["d"]
    used = scaled.where(F.size("x") == d)
    path = scratch_path(spark, "fit")
    used.select("x").distinct().write.parquet(path)
    fit = spark.read.parquet(path)
    n, sums = _sums(fit)
    whole, rest = np.array([s // n for s in sums], np.int64), np.array([s % n / n for s in sums])

    def centred(x: np.ndarray) -> np.ndarray:
        return (x - whole).astype(float) - rest

    def products(column: pa.Array) -> np.ndarray:
        c = centred(_matrix(column, d))
        return c.T @ c

    cells = _grid_sums(fit, d, products)
    scatter = np.array([[cells[i, j] for j in range(d)] for i in range(d)])
    turned = jacobi(pivoted_cholesky((scatter + scatter.T) / 2))[:, :components]
    k = turned.shape[1]
    if not k:
        return empty
    norms = np.sqrt((turned**2).sum(axis=0))
    units = turned / norms
    units = units * np.sign(units[np.abs(units).argmax(axis=0), range(k)])
    explained = (norms**2 / scatter.trace()).tolist()
    weights = units / (norms / np.sqrt(n))  # the covariance is the scatter over n

    def moments(column: pa.Array) -> np.ndarray:
        w = np.column_stack([centred(_matrix(column, d)) @ weights, np.ones(len(column))])
        return w.T @ w

    second = _grid_sums(fit, k + 1, moments)
    mean = [second[i, k] / n for i in range(k)]
    error = max(abs(second[i, j] / n - mean[i] * mean[j] - (i == j)) for i in range(k) for j in range(k))

    def project(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1), d)
            take, number = np.repeat(np.arange(len(x)), k), np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(take)), pa.array(number), pa.array([n] * len(take), pa.int64()), pa.array(_deviation(x, n, sums), pa.int64()).take(pa.array(take)),
                 pa.array((centred(x) @ weights).ravel()), pa.array(explained * len(x))],
                ["key", "component", "n", "deviation", "whitened", "explained"])

    schema = f"key {rows.schema[key].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double"
    return used.mapInArrow(project, schema).select(F.col("key").alias(key), "component", "n", "deviation", "whitened", "explained", F.lit(float(error)).alias("identity_error"))
