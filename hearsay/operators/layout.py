"""A neighbour embedding in few dimensions: the slowest directions of a walk between rows and their nearest landmarks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearsay.operators import linear
from hearsay.session import cut_lineage

LANDMARKS = 512
NEAREST = 8
MAX_LANDMARK_BYTES = 32 << 20


def _walk(landmarks: np.ndarray, nearest: int):
    """Of every row its nearest landmarks and the chance of a step to each: a bell curve as wide as the distance to the last of them."""
    squares = (landmarks**2).sum(axis=1)

    def run(batches):
        for batch in batches:
            rows = linear.matrix(batch, "v")
            apart = np.maximum((rows**2).sum(axis=1)[:, None] - 2 * rows @ landmarks.T + squares, 0)
            at = np.argsort(apart, axis=1, kind="stable")[:, :nearest]
            near = np.take_along_axis(apart, at, axis=1)
            chance = np.exp(-2 * near / np.maximum(near[:, -1:], 1e-300))
            chance /= chance.sum(axis=1, keepdims=True)
            starts = pa.array(np.arange(len(at) + 1) * at.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch["key"], pa.ListArray.from_arrays(starts, pa.array(at.ravel())), pa.ListArray.from_arrays(starts, pa.array(chance.ravel()))],
                ["key", "at", "chance"],
            )

    return run


def spectral_layout(
    df: DataFrame, key: str, vector: str, dimensions: int = 2, landmarks: int = LANDMARKS, nearest: int = NEAREST, out: str = "reduced"
) -> DataFrame:
    """``df`` with ``out``: coordinates that keep neighbours together, however curved the sheet they lie on.

    A bounded sample of ``landmarks`` different vectors (those of least hash) stands for the places rows can be; each row walks to its ``nearest`` landmarks, and
    from there back to rows. Coordinates are the leading eigenvectors of that walk but for the constant one, each over the root of what
    it loses a step, so slow directions spread wide. The walk's matrix is landmarks by landmarks, added up over all rows;
    the driver works out its eigenvectors, and one narrow pass gives every row its coordinates. Nothing is shuffled but the cells of that matrix.

    Vectors of the commonest length with finite entries take part; other rows get null. With fewer different vectors than dimensions + 1 the
    missing coordinates are 0. Rows are kept, repeated ones too; ties of landmarks go by their hash. ``landmarks`` vectors are sent to all tasks, so
    they are cut to ``MAX_LANDMARK_BYTES``.
    """
    rows = df.withColumn("__row", F.monotonically_increasing_id())
    rows = cut_lineage(rows)
    plain = rows.select(F.col("__row").alias("key"), F.col(vector).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    plain = plain.filter(F.col("v").isNotNull() & (F.size("v") > 0) & ~bad)
    common = plain.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    if common is None:
        return df.withColumn(out, F.lit(None).cast("array<double>"))
    plain = plain.filter(F.size("v") == common["d"])
    many = max(2, min(landmarks, MAX_LANDMARK_BYTES // (8 * common["d"])))
    chosen = plain.select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(many).collect()
    places = np.array([r["v"] for r in chosen])
    n = len(places)
    walk = cut_lineage(plain.mapInArrow(_walk(places, min(nearest, n)), "key long, at array<long>, chance array<double>"))

    def add(total, batch):
        at, chance = linear.matrix(batch, "at"), linear.matrix(batch, "chance")
        both = chance[:, :, None] * chance[:, None, :]
        np.add.at(total, (at[:, :, None], at[:, None, :]), both)

    steps = linear.summed(walk.select("at", "chance"), (n, n), add)
    mass = steps.sum(axis=1)
    used = mass > 0
    root = np.sqrt(np.where(used, mass, 1.0))
    values, vectors = np.linalg.eigh(steps / root[:, None] / root[None, :])
    # the constant direction takes no part, even where others are as slow
    constant = np.where(used, root, 0.0) / np.linalg.norm(np.where(used, root, 0.0))
    basis = vectors[:, ::-1] - np.outer(constant, constant @ vectors[:, ::-1])
    turned, sizes, right = np.linalg.svd((basis * np.sqrt(np.maximum(values[::-1], 0.0))), full_matrices=False)
    slow = np.zeros((n, dimensions))
    for i in range(min(dimensions, n - 1)):
        if sizes[i] > 1e-7:
            column = turned[:, i]
            column = column * np.sign(column[np.abs(column).argmax()])
            # a row's value is the mean of its landmarks', which shrinks by the walk's eigenvalue
            slow[:, i] = column / sizes[i] / root / np.sqrt(max(1 - sizes[i] ** 2, 1e-3))

    def place(batches):
        for batch in batches:
            at, chance = linear.matrix(batch, "at"), linear.matrix(batch, "chance")
            spots = (slow[at] * chance[:, :, None]).sum(axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(spots) + 1) * dimensions, pa.int32()), pa.array(spots.ravel()))
            yield pa.RecordBatch.from_arrays([batch["key"], lists], ["__row", out])

    placed = walk.mapInArrow(place, f"__row long, `{out}` array<double>")
    return rows.join(placed, "__row", "left").drop("__row")
