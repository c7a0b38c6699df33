"""Whitening of vectors by shifted CholeskyQR: Gram matrices from all tasks, triangular solves, an SVD of R."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearsay.llm.common import table

GRID, RAISED = 1024.0, 100_000
LARGEST = float(1 << 51)
COMPONENTS = 8
CHUNK_ROWS = 1024  # sums of so many entries fit 64 bits
PASSES = 3
NO_SPREAD = 1e-11  # of the largest singular value
UNIT = np.finfo(np.float64).eps / 2


@dataclass(frozen=True)
class Whitening:
    """``sums`` are exact: the mean is sums / n. Components are unit vectors with a positive largest entry, by falling eigenvalue."""

    n: int
    dims: int
    sums: list[int]
    explained: list[float]
    eigenvalues: list[float]
    vectors: list[list[float]]  # a unit component each
    orthogonality: float  # largest entry of Q'Q - I before the last pass


def _rows(batch: pa.RecordBatch, dims: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which rows have a whole vector (of ``dims`` entries, if given), their lengths, and the entries of these rows in order."""
    vectors = batch["vector"]
    lengths = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten()
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null entry becomes nan
    own = np.repeat(np.arange(len(lengths)), np.maximum(lengths, 0))
    whole = lengths > 0
    whole[own[~np.isfinite(values)]] = False
    if dims is not None:
        whole &= lengths == dims
    return whole, lengths, values[whole[own]]


def gridded(values: np.ndarray) -> np.ndarray:
    """floor(1024 c) + 100000 as whole numbers; beyond 2^51 they stay at that bound."""
    return np.clip(np.floor(GRID * values), -LARGEST, LARGEST).astype(np.int64) + RAISED


def _mapped(df: DataFrame, dims: int | None, start: Callable, schema: str) -> DataFrame:
    """``start()`` gives a task a function for each chunk of its whole vectors and one for the end, or None."""

    def over(batches):
        function, at_end = start()
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK_ROWS):
                part = batch.slice(at, CHUNK_ROWS)
                whole, lengths, values = _rows(part, dims)
                if whole.any():
                    out = function(part.filter(pa.array(whole)), lengths[whole], values)
                    if out is not None:
                        yield out
        if at_end is not None:
            yield from at_end()

    return df.mapInArrow(over, schema)


def _sums(df: DataFrame, dims: int | None) -> dict[int, tuple[int, list[int]]]:
    """Per vector length the number of whole vectors and the exact sum of each of their dimensions."""

    def start():
        held: dict[int, list] = {}

        def add(_, lengths, values):
            x, size_of = gridded(values), np.repeat(lengths, lengths)
            for size in np.unique(lengths).tolist():
                rows = x[size_of == size].reshape(-1, size)
                n, sums = held.get(size, (0, np.zeros(size, dtype=object)))
                held[size] = (n + len(rows), sums + rows.sum(axis=0).astype(object))

        def end():
            for size, (n, sums) in held.items():
                yield pa.RecordBatch.from_pylist([
                    {"size": size, "d": d, "n": n, "high": int(s) >> 32, "low": int(s) & 0xFFFFFFFF} for d, s in enumerate(sums)
                ], schema=pa.schema([(c, pa.int64()) for c in ("size", "d", "n", "high", "low")]))

        return add, end

    parts = _mapped(df, dims, start, "size long, d long, n long, high long, low long")
    sums = parts.groupBy("size", "d").agg(*[F.sum(c).alias(c) for c in ("n", "high", "low")]).orderBy("size", "d")
    out: dict[int, tuple[int, list[int]]] = {}
    for r in sums.collect():  # one row a dimension
        out.setdefault(r["size"], (r["n"], []))[1].append((r["high"] << 32) + r["low"])
    return out


def _gram(df: DataFrame, dims: int, sums: list[int], n: int, solve: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Q'Q and the column sums of Q = A ``solve``, where the rows of A are x - sums / n.

    A task adds up its own rows; its matrix travels as one number a cell, and these are combined by cell before
    and after the shuffle, so that the driver sees as many numbers as the matrix has, whatever the tasks.
    """
    width = solve.shape[1]
    centred = _centred(sums, n)

    def start():
        total = np.zeros((width + 1, width))

        def add(_, __, values):
            q = centred(gridded(values).reshape(-1, dims)) @ solve
            total[:width] += q.T @ q
            total[width] += q.sum(axis=0)

        def end():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["cell", "value"])

        return add, end

    cells = _mapped(df, dims, start, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    out = np.zeros((width + 1) * width)
    for cell, value in cells:
        out[cell] = value
    out = out.reshape(width + 1, width)
    return (out[:width] + out[:width].T) / 2, out[width]


def _centred(sums: list[int], n: int) -> Callable[[np.ndarray], np.ndarray]:
    """Rows less the mean: first a whole number near it, then the rest, so that nothing cancels."""
    near = np.array([(2 * s + n) // (2 * n) for s in sums], dtype=np.int64)
    rest = np.array([(s - n * int(m)) / n for s, m in zip(sums, near, strict=True)])
    return lambda x: (x - near).astype(np.float64) - rest


def _cholesky(gram: np.ndarray, n: int, always: bool) -> np.ndarray:
    """Upper R with R'R = gram, shifted by as little as lets the factors exist."""
    d = len(gram)
    shift = 11 * (n * d + d * (d + 1)) * UNIT * np.linalg.norm(gram, 2)
    shift = min(shift, 1e-8 * np.linalg.norm(gram, 2)) or np.finfo(np.float64).tiny
    if not always:
        try:
            return np.linalg.cholesky(gram).T
        except np.linalg.LinAlgError:  # columns that depend on each other
            pass
    return np.linalg.cholesky(gram + shift * np.eye(d)).T


def _solved(r: np.ndarray) -> np.ndarray:
    """The inverse of an upper triangular matrix by back substitution."""
    d = len(r)
    out = np.zeros_like(r)
    for i in range(d - 1, -1, -1):
        out[i] = -(r[i, i + 1 :] @ out[i + 1 :])
        out[i, i] += 1.0
        out[i] /= r[i, i]
    return out


def fit(vectors: DataFrame, k: int = COMPONENTS, passes: int = PASSES) -> Whitening | None:
    """The whitening of all whole vectors of ``vectors(vector)``, or None where there are none.

    A is the matrix of the centred rows. Each pass forms the Gram matrix of Q (first A itself) over all tasks, factors
    it as R'R (the first with a shift, which makes its factor exist however ill-conditioned A is; later ones only where
    they need it), and goes on with Q R^-1, found by a triangular solve against the rows of A. The product of the
    factors is the R of A = QR with orthonormal Q, so its SVD has the singular values and right vectors of A itself:
    accuracy is that of A, not of its squared condition. Directions without spread (constant or dependent dimensions) stay out.

    Vectors that are null, empty, or hold null or non-finite entries take no part. If lengths differ, those of the length that most
    vectors have are fitted (of equally many, the shortest). The driver holds matrices of dimensions by dimensions only.
    """
    found = _sums(vectors, None)
    if not found:
        return None
    dims = max(found, key=lambda size: (found[size][0], -size))
    n, sums = found[dims]
    solve, r = np.eye(dims), np.eye(dims)
    total = off = 0.0
    for i in range(passes):
        gram, _ = _gram(vectors, dims, sums, n, solve)
        if i == 0:
            total = float(np.trace(gram))
            if total == 0.0:  # all vectors are equal
                return Whitening(n, dims, sums, [], [], [], 0.0)
        factor = _cholesky(gram, n, always=i == 0)
        solve, r = solve @ _solved(factor), factor @ r
        off = float(np.abs(gram - np.eye(dims)).max())
    _, spread, right = np.linalg.svd(r)
    rank = int((spread > spread[0] * max(4 * max(n, dims) * UNIT, NO_SPREAD)).sum())
    eigen = spread[: min(k, rank)] ** 2 / n
    right = right[: len(eigen)]
    signs = np.sign(right[np.arange(len(eigen)), np.abs(right).argmax(axis=1)])
    explained = eigen / (total / n)
    return Whitening(n, dims, sums, explained.tolist(), eigen.tolist(), (right * signs[:, None]).tolist(), off)


def identity_error(vectors: DataFrame, model: Whitening) -> float | None:
    """The largest entry of the whitened vectors' covariance less the identity, in one more pass; None without components."""
    if not model.eigenvalues:
        return None
    gram, sums = _gram(vectors, model.dims, model.sums, model.n, _projection(model))
    mean = sums / model.n
    return float(np.abs(gram / model.n - np.outer(mean, mean) - np.eye(len(mean))).max())


def _projection(model: Whitening) -> np.ndarray:
    return np.array(model.vectors).T / np.sqrt(model.eigenvalues)


def whiten(vectors: DataFrame, model: Whitening) -> DataFrame:
    """``(id, whitened array<double>, deviation decimal(38,0))`` for the fitted rows of ``vectors(id, vector)``.

    ``deviation`` is the exact sum over dimensions of (n x - sums)^2; it is worked out from x less a whole number
    near the mean, and null where it has more than 38 digits.
    """
    n, dims = model.n, model.dims
    near = [(2 * s + n) // (2 * n) for s in model.sums]
    rest = [s - n * m for s, m in zip(model.sums, near, strict=True)]
    centred, project = _centred(model.sums, n), _projection(model) if model.vectors else np.zeros((dims, 0))
    rest_squared = sum(s * s for s in rest)

    def add(part, _, values):
        x = gridded(values).reshape(-1, dims)
        y = x - np.array(near, dtype=np.int64)
        if np.abs(y).max(initial=0) < 1 << 25 and dims < 1 << 12:
            squares, cross = (y * y).sum(axis=1).tolist(), None
        else:
            squares, cross = [sum(v * v for v in row) for row in y.tolist()], None
        # y * rest may pass 64 bits; its parts of 32 bits do not where y is small
        if cross is None and np.abs(y).max(initial=0) < 1 << 18 and dims < 1 << 12:
            high, low = np.array([s >> 32 for s in rest], dtype=np.int64), np.array([s & 0xFFFFFFFF for s in rest], dtype=np.int64)
            cross = [(h << 32) + w for h, w in zip((y @ high).tolist(), (y @ low).tolist(), strict=True)]
        else:
            cross = [sum(v * s for v, s in zip(row, rest, strict=True)) for row in y.tolist()]
        deviation = [str(n * n * q - 2 * n * c + rest_squared) for q, c in zip(squares, cross, strict=True)]
        z = centred(x) @ project
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * z.shape[1], pa.int32()), pa.array(z.ravel()))
        return pa.RecordBatch.from_arrays([part["id"], lists, pa.array(deviation)], ["id", "whitened", "deviation"])

    kind = dict(vectors.dtypes)["id"]
    out = _mapped(vectors.select("id", "vector"), dims, lambda: (add, None), f"id {kind}, whitened array<double>, deviation string")
    return out.withColumn("deviation", F.col("deviation").try_cast("decimal(38,0)"))


def op12_whitening(spark: SparkSession, sf: str) -> DataFrame:
    """A row for every whole vector and component. ``deviation`` is null where it does not fit 64 bits."""
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    model = fit(rows.select("vector"))
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None or not model.eigenvalues:
        return spark.createDataFrame([], schema)
    error = identity_error(rows.select("vector"), model)
    explained = F.array(*[F.lit(x) for x in model.explained])
    long = whiten(rows, model).select("id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return long.select(
        F.col("id").alias("vec_id"), (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"),
        F.col("deviation").try_cast("long").alias("deviation"), "whitened",
        F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )


QUERIES = {"op12_whitening": op12_whitening}
ORACLES: dict[str, str] = {}
