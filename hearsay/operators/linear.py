"""Small matrices of tall ones: Gram matrices, products with a narrow matrix, orthonormal columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    """The rows of an array column without nulls, all of one length."""
    return batch[column].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def summed(df: DataFrame, shape: tuple[int, int], add: Callable[[np.ndarray, pa.RecordBatch], None]) -> np.ndarray:
    """The sum over all tasks of a matrix that each task adds up over its batches.

    Cells travel one by one and are combined on both sides of the shuffle; the driver gets one number a cell that is not 0,
    however many tasks there are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            add(total, batch)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total.ravel()[cells])], ["cell", "value"])

    cells = df.mapInArrow(run, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value"))
    out = np.zeros(shape[0] * shape[1])
    for cell, value in cells.collect():
        out[cell] = value
    return out.reshape(shape)


def gram(df: DataFrame, column: str, width: int) -> np.ndarray:
    """A'A of the matrix whose rows are ``column``."""

    def add(total, batch):
        rows = matrix(batch, column)
        total += rows.T @ rows

    return summed(df.select(column), (width, width), add)


def times(df: DataFrame, column: str, right: np.ndarray) -> DataFrame:
    """``df`` with each row of ``column`` multiplied by a small matrix."""
    width = right.shape[1]

    def run(batches):
        for batch in batches:
            rows = matrix(batch, column) @ right
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * width, pa.int32()), pa.array(rows.ravel()))
            yield batch.set_column(batch.schema.get_field_index(column), column, lists)

    schema = ", ".join(f"`{f.name}` {'array<double>' if f.name == column else f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, schema)


def orthonormal(df: DataFrame, column: str, width: int) -> DataFrame:
    """The same span with orthonormal columns; directions that hold nothing become 0."""
    values, vectors = np.linalg.eigh(gram(df, column, width))
    full = values > values[-1] * 1e-12 if values[-1] > 0 else np.zeros(width, dtype=bool)
    return times(df, column, vectors * np.where(full, 1 / np.sqrt(np.where(full, values, 1.0)), 0.0))
