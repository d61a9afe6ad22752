"""Embedding whitening by matrix-free block Lanczos.

The covariance V is never formed. A pass over the table multiplies it with a
block of directions: every task centres its vectors, projects them on the block
and adds up what comes back; the sums of all tasks are added by Spark, entry by
entry, so the driver gets one matrix of dimensions x block whatever the number
of rows or tasks. The driver keeps the basis and its images (dimensions x at
most ``BASIS`` columns each), orthogonalises every new block twice against the
whole basis, fills directions that break down with fresh ones, and stops when
the residuals of all wanted components are at rounding level. A basis that
reaches its bound is restarted from its best Ritz vectors.

Vectors are integers (see ``quantised``), so the sums of a dimension and the
squared deviations are exact; the trace of V is the sum of the deviations.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.shared import by_arrow, rows_out, written

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Directions beside the wanted ones in a block, and columns of the basis per wanted component at most.
MORE, BASIS = 8, 40
#: Vectors of a batch, so a task holds a few MB of doubles.
ROWS = 2048
LONG = 1 << 62
DECIMAL = pa.decimal128(38, 0)


@dataclass(frozen=True)
class Whitener:
    """What the fit found: rows, sums by dimension, eigenvectors as columns, eigenvalues, trace, passes over the table."""

    n: int
    sums: tuple[int, ...]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    passes: int


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x array<long>) of the rows whose vector is whole: x = floor(1024 c) + 100000.

    Null and empty vectors and those with null or non-finite entries go. Vectors
    have the length that most rows have (of several, the longest); others go. An
    entry whose x doesn't fit a double's 53 bits is an error.
    """
    c = F.col("v")
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("v"))
    rows = rows.filter(c.isNotNull() & (F.size(c) > 0) & F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))))
    lengths = rows.groupBy(F.size(c).alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    size = lengths[0].d if lengths else 0
    fits = lambda e: F.when(F.abs(e) < float(1 << 42), F.floor(e * float(SCALE)) + F.lit(SHIFT)).otherwise(F.raise_error(F.lit("an entry is beyond 2**42")).cast("long"))
    return rows.filter(F.size(c) == size).select("vec_id", F.transform(c, fits).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as a matrix of int64."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S/n: the numerator is exact."""
    if n * max(int(np.abs(x).max(initial=0)), 1) < LONG:
        return (n * x - sums) / n
    return (x - sums // n).astype(float) - (sums % n) / n


def _summed(rows: DataFrame, f: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """Sum over all vectors of an array of ``size`` doubles that ``f`` makes of a matrix of vectors; one partial sum a task is shuffled."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += f(_matrix(b.column(0))).ravel()
        yield rows_out({"p": (pa.list_(pa.float64()), [total.tolist()])})

    parts = by_arrow(rows.select("x"), partial, "p array<double>", ROWS).select(F.posexplode("p").alias("i", "v"))
    out = np.zeros(size)
    for r in parts.groupBy("i").agg(F.sum("v").alias("v")).collect():  # ``size`` rows
        out[r.i] = r.v
    return out


def _orthogonal(block: np.ndarray, basis: np.ndarray, width: int, scale: float, random: np.random.Generator) -> np.ndarray:
    """At most ``width`` unit columns that span what the block adds to the basis; directions that break down are replaced by random ones."""
    d, room = len(block), min(width, len(block) - basis.shape[1])
    out = np.zeros((d, 0))
    for tried in range(5):
        for _ in range(2):
            block = block - basis @ (basis.T @ block)
            block = block - out @ (out.T @ block)
        u, s, _ = np.linalg.svd(block, full_matrices=False)
        new = u[:, s > 1e-10 * scale][:, : room - out.shape[1]]
        for _ in range(2):
            new = new - basis @ (basis.T @ new)
            new = new - out @ (out.T @ new)
            new = np.linalg.qr(new)[0]
        out = np.hstack((out, new))
        if out.shape[1] >= room:
            break
        block, scale = random.standard_normal((d, room - out.shape[1])), 1.0
    return out


def block_lanczos(multiply: Callable[[np.ndarray], np.ndarray], d: int, k: int, block: int, most: int, tolerance: float = 0.0, passes: int = 500) -> tuple[np.ndarray, np.ndarray, int]:
    """(values, vectors as columns, passes): the ``k`` largest eigenpairs of a symmetric matrix that is known by its products only.

    Stops when all residuals are at most ``tolerance`` (0: rounding level) times
    the largest value, or the basis spans the space; raises when ``passes`` don't suffice.
    """
    random = np.random.default_rng(13)
    tolerance = tolerance or 8 * np.finfo(float).eps * np.sqrt(d)
    most = min(d, max(most, 3 * block))
    basis, image = np.zeros((d, 0)), np.zeros((d, 0))
    new = _orthogonal(random.standard_normal((d, block)), basis, block, 1.0, random)
    for done in range(1, passes + 1):
        basis, image = np.hstack((basis, new)), np.hstack((image, multiply(new)))
        t = basis.T @ image
        values, s = np.linalg.eigh((t + t.T) / 2)
        values, s = values[::-1], s[:, ::-1]
        wanted = min(k, basis.shape[1])
        residual = image @ s - (basis @ s) * values
        size = max(abs(values[0]), np.finfo(float).tiny)
        if basis.shape[1] == d or np.linalg.norm(residual[:, :wanted], axis=0).max() <= tolerance * size and wanted == k:
            vectors = np.linalg.qr(basis @ s[:, :wanted])[0]
            return values[:wanted], vectors * np.sign((vectors * (basis @ s[:, :wanted])).sum(axis=0)), done
        if basis.shape[1] + block > most:
            keep = s[:, : most // 2]
            basis, image = basis @ keep, image @ keep
        new = _orthogonal(residual[:, :block], basis, block, size, random)
    raise ArithmeticError(f"no convergence after {passes} passes")


def fit_whitener(x: DataFrame, k: int = COMPONENTS) -> Whitener | None:
    """Fits on all rows of a table of ``quantised`` vectors; None without rows. Components whose variance is zero to rounding are left out."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for b in batches:
            if b.num_rows:
                m = _matrix(b.column(0))
                n, total = n + len(m), [int(v) for v in m.sum(axis=0)] if total is None else [t + int(v) for t, v in zip(total, m.sum(axis=0))]
        if n:
            yield rows_out({"n": (pa.int64(), [n]), "s": (pa.list_(DECIMAL), [[Decimal(v) for v in total]])})

    parts = by_arrow(x.select("x"), sums, "n long, s array<decimal(38,0)>", ROWS).select("n", F.posexplode("s").alias("i", "v"))
    got = {r.i: (r.n, int(r.v)) for r in parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()}  # a row for each dimension
    if not got:
        return None
    n, d, total = got[0][0], len(got), tuple(got[i][1] for i in range(len(got)))
    s = np.array(total)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = sum(sum(_deviations(_matrix(b.column(0)), n, total)) for b in batches if b.num_rows)
        yield rows_out({"d": (DECIMAL, [Decimal(whole)])})

    trace = float(by_arrow(x.select("x"), spread, "d decimal(38,0)", ROWS).agg(F.sum("d")).first()[0]) / float(n) ** 3

    def multiply(block: np.ndarray) -> np.ndarray:
        def one(m: np.ndarray) -> np.ndarray:
            c = _centred(m, n, s)
            return c.T @ (c @ block)

        return _summed(x, one, block.size).reshape(block.shape) / n

    values, vectors, passes = block_lanczos(multiply, d, min(k, d), min(d, k + MORE), BASIS * k)
    real = values > max(values[0], 0) * d * 1e-14
    return Whitener(n, total, vectors[:, real], values[real], trace, passes)


def _deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int]:
    """Per row the sum over the dimensions of (n x - S)^2, exact: products of two halves of 24 bits where that can't overflow, else of Python's integers."""
    if n * int(np.abs(x).max(initial=1)) + max(map(abs, sums)) < 1 << 47 and x.shape[1] < 1 << 14:
        high, low = np.divmod(np.abs(n * x - np.array(sums)), 1 << 24)
        parts = zip((high * high).sum(axis=1).tolist(), (high * low).sum(axis=1).tolist(), (low * low).sum(axis=1).tolist())
        return [(a << 48) + (b << 25) + c for a, b, c in parts]
    return [sum((n * e - t) ** 2 for e, t in zip(row, sums)) for row in x.tolist()]


def whitened(x: DataFrame, w: Whitener) -> DataFrame:
    """(vec_id, deviation decimal, y array<double>) per row: the squared deviation and the whitened coordinates, largest component first."""
    s, axes = np.array(w.sums), w.vectors / np.sqrt(w.values)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                m = _matrix(b.column(1))
                y = _centred(m, w.n, s) @ axes
                yield rows_out({"vec_id": (pa.int64(), b.column(0).to_pylist()), "deviation": (DECIMAL, [Decimal(v) for v in _deviations(m, w.n, w.sums)]), "y": (pa.list_(pa.float64()), y.tolist())})

    return by_arrow(x.select("vec_id", "x"), f, "vec_id long, deviation decimal(38,0), y array<double>", ROWS)


def identity_error(x: DataFrame, w: Whitener) -> float:
    """Largest absolute entry of the covariance of the whitened rows less the identity, from one pass."""
    s, axes, k = np.array(w.sums), w.vectors / np.sqrt(w.values), len(w.values)

    def one(m: np.ndarray) -> np.ndarray:
        y = _centred(m, w.n, s) @ axes
        return np.concatenate((y.sum(axis=0), (y.T @ y).ravel()))

    got = _summed(x, one, k + k * k) / w.n
    return float(np.abs(got[k:].reshape(k, k) - np.outer(got[:k], got[:k]) - np.eye(k)).max(initial=0.0))


def whitening_table(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each whole row and each component.

    Rows that ``quantised`` leaves out have no result; repeated rows count and
    come as often as they occur, a null id stays. Components are numbered from
    1 by falling eigenvalue, at most ``components`` of them; those without
    variance are left out, so equal or single vectors give no rows. Other columns are ignored.
    """
    x = written(quantised(vectors, id_col, vector_col), "quantised")
    w = fit_whitener(x, components)
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if w is None or not len(w.values):
        return vectors.sparkSession.createDataFrame([], schema)
    shares = F.array(*(F.lit(float(v / w.trace)) for v in w.values))
    rows = whitened(x, w).select("vec_id", "deviation", F.posexplode("y").alias("at", "whitened"))
    return rows.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(w.n).cast("long").alias("n"), "deviation", "whitened", shares[F.col("at")].alias("explained"), F.lit(identity_error(x, w)).alias("identity_error"))
