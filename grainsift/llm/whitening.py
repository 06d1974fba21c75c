"""Whitening components of embeddings by shifted CholeskyQR.

Vectors become whole numbers, and the fit list holds each distinct one once. The rows of the fit list, centred exactly, are
orthogonalised by passes over it: tasks carry rows through the triangular solves of all earlier factors and
add up a Gram matrix, whose Cholesky factor R is the next. The first factor is shifted, which makes the factorisation
safe for any condition; two further passes bring the columns to orthonormal in double precision. The product of the factors has the
singular values and right vectors of the centred rows, so its decomposition gives variances and components
without the covariance's squared condition. Only matrices of the size of one vector squared reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from grainsift.llm.vectors import matrices
from grainsift.operators.materialize import materialize

COMPONENTS = 16
SCALE = 64
OFFSET = 1_000_000
#: passes after the shifted one
PASSES = 2
#: entries beyond it have no whole number of 64 bits with room for the offset
LARGEST = 2.0 ** 62
#: partial sums that reach the driver, at most
SUMMANDS = 8
#: rows centred and solved at once
ROWS = 2_048

_WIDTHS = (1, 2, 4, 8)
_UNIT = 2.0 ** -53


def _pack(y: np.ndarray) -> list[bytes]:
    """Whole numbers of each row in the fewest bytes that hold them all: equal rows have equal bytes."""
    peak = np.where(y < 0, -(y + 1), y).max(axis=1)
    out: list[bytes] = [b""] * len(y)
    width = np.searchsorted([1 << 7, 1 << 15, 1 << 31], peak, "right")
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        for i, row in zip(at, y[at].astype(f"<i{_WIDTHS[w]}")):
            out[i] = bytes([w]) + row.tobytes()
    return out


def _unpack(column: pd.Series, size: int) -> np.ndarray:
    y = np.empty((len(column), size), np.int64)
    width = np.array([v[0] for v in column], int)
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        y[at] = np.frombuffer(b"".join(v[1:] for v in column.iloc[at]), f"<i{_WIDTHS[w]}").reshape(len(at), size)
    return y


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, x in matrices(batch.column("vector")):
            with np.errstate(over="ignore"):
                y = np.floor(x * SCALE)
            fits = (np.abs(y) < LARGEST).all(axis=1)
            rows, y = rows[fits], y[fits]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(rows)), pa.array(_pack(y.astype(np.int64)), pa.binary()),
                 pa.array(np.full(len(y), y.shape[1], np.int32))], ["id", "packed", "size"])


def _numbers(batches: Iterator[pd.DataFrame], size: int) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            part = batch.iloc[at:at + ROWS]
            yield part, _unpack(part["packed"], size)


def _sums(size: int):
    """Number of rows and sums per dimension, each sum as its high and low part."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((3, size), np.int64)
        for _, y in _numbers(batches, size):
            total += np.stack([np.full(size, len(y)), (y >> 31).sum(axis=0), (y & 0x7FFFFFFF).sum(axis=0)])
        yield pd.DataFrame({"matrix": [total.tobytes()]})
    return run


def _added(partials: DataFrame, kind: str, shape: tuple[int, int]) -> np.ndarray:
    """Sum of the matrices of all rows: first in a fixed number of tasks, then here."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(shape, kind)
        for batch in batches:
            for matrix in batch["matrix"]:
                total += np.frombuffer(matrix, kind).reshape(shape)
        yield pd.DataFrame({"matrix": [total.tobytes()]})
    rows = partials.repartition(SUMMANDS).mapInPandas(run, "matrix binary").collect()
    return sum((np.frombuffer(r["matrix"], kind).reshape(shape) for r in rows), np.zeros(shape, kind))


def scaled_rows(y: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: of 64 bits where that holds it, else of any length."""
    reach = int(max(abs(int(y.min())), abs(int(y.max()))))
    if n * reach + max(abs(s) for s in sums) < 1 << 62:
        return n * y - np.array(sums, np.int64)
    return n * y.astype(object) - np.array(sums, object)


def solve_rows(rows: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """Rows times the inverse of an upper triangular factor, by substitution."""
    out = np.empty_like(rows)
    for j in range(len(factor)):
        out[:, j] = (rows[:, j] - out[:, :j] @ factor[:j, j]) / factor[j, j]
    return out


@dataclass
class Fit:
    n: int
    sums: list[int]
    factors: list[np.ndarray]
    components: np.ndarray | None = None      # a column per component, divided by its deviation


def _centred(y: np.ndarray, fit: Fit) -> np.ndarray:
    rows = scaled_rows(y, fit.n, fit.sums)
    return (rows / fit.n).astype(np.float64)


def _gram(shared, size: int, columns: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fit, total = shared.value, np.zeros((columns, columns))
        for _, y in _numbers(batches, size):
            rows = _centred(y, fit)
            if fit.components is not None:
                rows = rows @ fit.components
            else:
                for factor in fit.factors:
                    rows = solve_rows(rows, factor)
            total += rows.T @ rows
        yield pd.DataFrame({"matrix": [total.tobytes()]})
    return run


def _gram_pass(rows: DataFrame, fit: Fit, size: int, columns: int) -> np.ndarray:
    shared = rows.sparkSession.sparkContext.broadcast(fit)           # a few matrices of the size of a vector squared
    return _added(rows.mapInPandas(_gram(shared, size, columns), "matrix binary"), "<f8", (columns, columns))


def _cholesky(gram: np.ndarray, shift: float) -> np.ndarray:
    """Upper factor of the matrix with its diagonal raised, more where that is not yet definite."""
    while True:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(len(gram))).T
        except np.linalg.LinAlgError:
            shift = max(10 * shift, _UNIT * np.trace(gram))


def _principal(gram: np.ndarray, factors: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Variances and components from the factors and the Gram matrix of the rows they leave (near the identity)."""
    values, vectors = np.linalg.eigh(gram)
    root = (vectors * np.sqrt(np.maximum(values, 0))) @ vectors.T
    for factor in reversed(factors):
        root = root @ factor
    _, singular, right = np.linalg.svd(root)
    kept = singular > len(root) * 4 * _UNIT * singular[0]
    components = right[kept].T
    first = np.abs(components).argmax(axis=0)
    components = components * np.where(components[first, np.arange(components.shape[1])] < 0, -1.0, 1.0)
    return singular[kept] ** 2 / n, components


def whiten(df: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows ``vec_id``, ``component`` (1 is the one of largest variance), ``n``, ``deviation``, ``whitened``, ``explained``,
    ``identity_error``.

    An entry c counts as x = floor(64 c) + 1,000,000. The fit list holds each distinct x-vector once: ``n`` of them with sums
    S. ``deviation`` is the exact sum of (n x - S)^2 (null beyond 64 bits), ``whitened`` is x - S/n on the component over its
    deviation, ``explained`` the component's share of the variance, ``identity_error`` the largest difference of an entry of
    the covariance of all whitened columns, measured over the fit list, from the identity.

    Vectors that are null, empty or hold null, non-finite or unrepresentable entries (64 |c| >= 2^62) are dropped. Vectors of
    other lengths than the most common one of the fit list (ties: the longer) are dropped too. Components without variance
    do not come, so a table of equal vectors, like an empty one, gives no rows. Repeated rows and null ids come as they
    are; other columns are not looked at.
    """
    id_type = df.schema[id_col].dataType.simpleString()
    schema = (f"vec_id {id_type}, component int, n long, deviation long, whitened double, explained double, "
              "identity_error double")
    facts = materialize(df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")).mapInArrow(
        _facts, f"id {id_type}, packed binary, size int"))
    distinct = materialize(facts.select("size", "packed").distinct())
    lengths = distinct.groupBy("size").count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    none = df.sparkSession.createDataFrame([], schema)
    if not lengths:
        return none
    size = lengths[0]["size"]
    rows = distinct.filter(F.col("size") == size).select("packed")
    sums = _added(rows.mapInPandas(_sums(size), "matrix binary"), "<i8", (3, size))
    n = int(sums[0, 0])
    fit = Fit(n, [(int(high) << 31) + int(low) for high, low in zip(sums[1], sums[2])], [])

    gram = _gram_pass(rows, fit, size, size)
    trace = float(np.trace(gram)) / n
    if trace == 0:
        return none
    for turn in range(1 + PASSES):
        first = 11 * (n * size + size * (size + 1)) * _UNIT * np.linalg.norm(gram, 2)
        fit.factors.append(_cholesky(gram, first if turn == 0 else 0.0))
        gram = _gram_pass(rows, fit, size, size)
    variances, axes = _principal(gram, fit.factors, n)
    variances, axes = variances[:components], axes[:, :components]
    fit = Fit(n, fit.sums, [], axes / np.sqrt(variances))
    error = float(np.abs(_gram_pass(rows, fit, size, len(variances)) / n - np.eye(len(variances))).max())
    shared, shares = df.sparkSession.sparkContext.broadcast(fit), variances / trace

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fit, count = shared.value, len(shares)
        for part, y in _numbers(batches, size):
            scaled = scaled_rows(y, fit.n, fit.sums)
            large = np.square(scaled.astype(np.float64)).sum(axis=1) >= 2.0 ** 62
            deviation = np.empty(len(y), object)
            deviation[~large] = np.square(scaled[~large]).sum(axis=1)
            deviation[large] = np.square(scaled[large].astype(object)).sum(axis=1)
            deviation = pd.array([int(v) if v < 1 << 63 else None for v in deviation], "Int64")
            whitened = (scaled / fit.n).astype(np.float64) @ fit.components
            yield pd.DataFrame({
                "vec_id": part["id"].repeat(count).array, "component": np.tile(np.arange(1, count + 1, dtype=np.int32), len(y)),
                "n": fit.n, "deviation": deviation.repeat(count), "whitened": whitened.ravel(),
                "explained": np.tile(shares, len(y)), "identity_error": error})
    return facts.filter(F.col("size") == size).select("id", "packed").mapInPandas(project, schema)
