"""k-means whose result follows from the rows alone: starts by distance, then Lloyd's rounds over all rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearsay.operators.linear import matrix, summed
from hearsay.operators.topics import MAX_CENTRE_BYTES, OUTLIER, _array, centroids, without_outliers
from hearsay.session import cut_lineage

ROUNDS = 20
CHUNK_BYTES = 32 << 20


def _squares(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres; by differences, so that equal points are at exactly 0."""
    return np.stack([np.einsum("ij,ij->i", d, d) for d in (rows - c for c in centres)], axis=1)


def _chunks(batch: pa.RecordBatch, centres: int):
    step = max(1, CHUNK_BYTES // (8 * max(1, centres)))
    for a in range(0, batch.num_rows, step):
        yield batch.slice(a, step)


def _rows(df: DataFrame, key: str, vector: str, weight: str | None) -> tuple[DataFrame, int]:
    """``(k, v, w, fits)`` of all rows, whether each can be placed, and the length vectors must have: that of most, the smaller on a tie."""
    v = F.transform(_array(df, vector), lambda x: x.cast("double"))
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    rows = df.select(F.col(key).alias("k"), v.alias("v"), w.alias("w"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    whole = F.coalesce((F.size("v") > 0) & F.forall("v", finite) & finite(F.col("w")) & (F.col("w") > 0), F.lit(False))
    lengths = rows.filter(whole).groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("rows"))
    most = lengths.orderBy(F.desc("rows"), "n").head()
    width = most["n"] if most else 0
    return rows.withColumn("fits", whole & (F.size("v") == width)), width


def _farthest(centres: np.ndarray):
    """Of a task's rows the one farthest from its nearest centre, the smallest key on a tie."""

    def run(batches):
        best = None
        for batch in batches:
            for part in _chunks(batch, len(centres)):
                apart = _squares(matrix(part, "v"), centres).min(axis=1)
                top = part.filter(pa.array(apart == apart.max())).sort_by("k").slice(0, 1)
                found = (-apart.max(), top["k"][0].as_py())
                if best is None or found < best[0]:
                    best = found, top
        if best:
            yield pa.RecordBatch.from_arrays([best[1]["k"], best[1]["v"], pa.array([-best[0][0]])], ["k", "v", "apart"])

    return run


def farthest_first(rows: DataFrame, k: int) -> np.ndarray:
    """Up to ``k`` rows of ``(k, v)`` as centres: that of the smallest key, then ever the one farthest from all before it.

    One pass a centre; a task sends its best row. Fewer centres where there are fewer different vectors.
    """
    kind = rows.schema["k"].dataType.simpleString()
    rows = rows.filter("k is not null")
    first = rows.select("k", "v").orderBy("k", "v").head()
    centres = [list(first["v"])] if first else []
    while 0 < len(centres) < k:
        far = rows.select("k", "v").mapInArrow(_farthest(np.array(centres)), f"k {kind}, v array<double>, apart double")
        best = far.orderBy(F.desc("apart"), "k", "v").head()
        if not best["apart"] > 0:
            break
        centres.append(list(best["v"]))
    return np.array(centres)


def rounds_of(rows: DataFrame, centres: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of ``(v, w)`` after up to ``rounds`` rounds, each one pass; it ends when none moves. A centre that loses all its rows stays.

    Tasks send sums, which combine on both sides of the shuffle; the driver holds the centres, whose size is checked.
    """
    k, width = centres.shape

    def add(now):
        def to(total, batch):
            for part in _chunks(batch, k):
                own, w = matrix(part, "v"), part["w"].to_numpy()
                mine = np.zeros((len(own), k))
                mine[np.arange(len(own)), _squares(own, now).argmin(axis=1)] = w
                total += mine.T @ np.c_[own, np.ones(len(own))]

        return to

    for _ in range(rounds):
        sums = summed(rows.select("v", "w"), (k, width + 1), add(centres))
        full = sums[:, -1] > 0
        moved = np.where(full[:, None], sums[:, :-1] / np.where(full, sums[:, -1], 1.0)[:, None], centres)
        still = np.abs(moved - centres).max() <= 1e-12 * max(1.0, np.abs(centres).max())
        centres = moved
        if still:
            break
    return centres


def _placed(centres: np.ndarray):
    def run(batches):
        for batch in batches:
            for part in _chunks(batch, len(centres)):
                apart = np.sqrt(_squares(matrix(part, "v"), centres))
                topic = apart.argmin(axis=1)
                at = np.arange(len(topic))
                own = apart[at, topic]
                apart[at, topic] = np.inf
                second = pa.array(apart.min(axis=1), mask=np.full(len(topic), len(centres) < 2))
                yield pa.RecordBatch.from_arrays(
                    [part["k"], pa.array(topic.astype(np.int32)), pa.array(own), second], ["k", "topic", "distance", "second"]
                )

    return run


def lloyd_topics(
    df: DataFrame, key: str, vector: str, k: int, rounds: int = ROUNDS, weight: str | None = None, max_distance: float | None = None
) -> DataFrame:
    """``(key, topic, distance, second)``: the topic of every row, how far its centre is and how far the next one.

    The same rows give the same topics however they lie in files and tasks: starts are picked by distance (``farthest_first``), topics are numbered in
    the order of their starts, and a row between two centres goes to the smaller number. ``weight`` counts a row so many times in the means.
    Rows farther than ``max_distance`` from their centre are outliers (-1), as are rows whose vector is null, empty, of another length than
    most or holds a null or non-finite entry, and rows of no positive finite weight; the latter kinds have no distances and move no centre.
    ``second`` is null where there is one topic. Rows that share a key are placed each. An empty table gives no rows.

    ``df`` is read about ``k`` + ``rounds`` times: write it first if it is dear to make.
    """
    every, width = _rows(df, key, vector, weight)
    if 8 * k * max(1, width) > MAX_CENTRE_BYTES:
        raise ValueError(f"{k} centres of {width} numbers are more than a task should hold")
    rows = every.filter("fits")
    starts = farthest_first(rows, k)
    nothing = F.lit(None).cast("double")
    lost = every.filter("not fits").select("k", F.lit(OUTLIER).alias("topic"), nothing.alias("distance"), nothing.alias("second"))
    if len(starts):
        kind = every.schema["k"].dataType.simpleString()
        centres = rounds_of(rows, starts, rounds)
        placed = rows.select("k", "v").mapInArrow(_placed(centres), f"k {kind}, topic int, distance double, second double")
        if max_distance is not None:
            placed = placed.withColumn("topic", F.when(F.col("distance") <= max_distance, F.col("topic")).otherwise(OUTLIER))
        lost = placed.unionByName(lost)
    return lost.withColumnRenamed("k", key)


def lloyd_areas(df: DataFrame, vector: str, k: int, topic: str = "topic", rounds: int = ROUNDS) -> DataFrame:
    """``(topic, area)``: topics grouped into up to ``k`` areas by their centres, each as heavy as it has rows; outliers have no area."""
    real = without_outliers(df, topic).filter(F.col(vector).isNotNull()).select(F.col(topic).alias("name"), F.col(vector).alias("v"))
    sizes = real.groupBy("name").agg(F.count(F.lit(1)).cast("double").alias("size"))
    # one row a topic
    centres = cut_lineage(centroids(real, "name", "v").join(sizes, "name"))
    found = lloyd_topics(centres, "name", "centroid", k, rounds, "size")
    return found.select(F.col("name").alias(topic), F.col("topic").alias("area"))
