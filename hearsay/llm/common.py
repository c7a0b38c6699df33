"""What the operators share: reading, batches, words and their hashes, global positions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearsay.session import scratch_path, stage

SLICE_BYTES = 8 << 20
COPY_CHUNK = 1 << 16
MIX = np.uint64(0x9E3779B97F4A7C15)


CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def step(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """``df`` written to the shared folder (at ``path``, if the caller wants to discard it) and read from there, its shuffle files given back at once.

    Spark else drops a shuffle when the driver's collector happens to see that nothing needs it; a job of several
    large steps would keep all of them on disk. What is read afterwards is the written table.
    """
    spark, path = df.sparkSession, path or scratch_path(df.sparkSession, name)
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEAN_UP)
        else:
            spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch cut so that each part holds about ``max_bytes`` of one text column, whole rows each."""
    if batch.num_rows == 0:
        return
    size = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(size) // max_bytes
    cuts = np.r_[0, np.flatnonzero(part[1:] != part[:-1]) + 1, batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield batch.slice(int(a), int(b - a))


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words (runs of anything but ASCII white space) of all texts in order, and how many each has."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    words = split.flatten()
    full = pc.greater(pc.binary_length(words), 0)
    if not len(words) or pc.all(full).as_py():
        return words, split.value_lengths().to_numpy().astype(np.int64)
    # white space at an end of a text leaves an empty string there
    parents = pc.list_parent_indices(split).filter(full)
    return words.filter(full), np.bincount(parents.to_numpy(), minlength=len(texts)).astype(np.int64)


def hash_strings(words: pa.Array) -> np.ndarray:
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False).astype(object), categorize=False)


def hash_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash per word, and the number of words per text."""
    words, counts = split_words(texts)
    coded = words.dictionary_encode()
    if not len(words):
        return np.zeros(0, dtype=np.uint64), counts
    return hash_strings(coded.dictionary)[coded.indices.to_numpy()], counts


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A full avalanche of 64-bit values, in wrapping arithmetic."""
    x = x + np.uint64(0x9E3779B97F4A7C15 * (salt + 1) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def roll(h: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """A hash of every run of ``k`` consecutive values; run i starts at value i."""
    if len(h) < k:
        return np.zeros(0, dtype=np.uint64)
    n = len(h) - k + 1
    out = np.full(n, salt + k, dtype=np.uint64)
    for j in range(k):
        out *= MIX
        out += h[j : n + j]
    return mix(out, salt)


def starts(counts: np.ndarray) -> np.ndarray:
    return np.r_[0, np.cumsum(counts)].astype(np.int64)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(starts(counts), pa.int32()), pa.array(values, kind))


def map_slices(function: Callable[[pa.RecordBatch], pa.RecordBatch | None], column: str, max_bytes: int = SLICE_BYTES):
    """A mapInArrow function that works on slices of bounded size."""

    def over(batches):
        for batch in batches:
            for part in slices(batch, column, max_bytes):
                out = function(part)
                if out is not None and out.num_rows:
                    yield out
                del out, part
            pa.default_memory_pool().release_unused()  # workers live on, and share the executor's memory

    return over


def global_positions(df: DataFrame, order: list[str], weight: str | None = None) -> DataFrame:
    """``df`` with ``position``: the number of rows (or the sum of ``weight``) before each row in ``order``.

    ``df`` must be narrow, and staged unless little stands between it and a table or a shuffle: it is worked out
    twice, for a sample and to be range-sorted. Every task adds up its own range, and one number per task travels to
    give each range its start. Ties must be broken by ``order``.
    """
    spark = df.sparkSession
    columns = df.columns
    amount = F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")
    ranged = (
        df.withColumn("__amount", amount)
        .repartitionByRange(parallelism(spark), *order)
        .sortWithinPartitions(*order)
        .withColumn("__part", F.spark_partition_id())
    )

    def run(batches):
        total = 0
        for batch in batches:
            amounts = batch["__amount"].to_numpy()
            upto = total + np.cumsum(amounts)
            total = int(upto[-1]) if len(upto) else total
            yield pa.RecordBatch.from_arrays(
                [batch[c] for c in [*columns, "__amount", "__part"]] + [pa.array(upto - amounts, pa.int64())],
                [*columns, "__amount", "__part", "__inside"],
            )

    schema = T.StructType(list(ranged.schema) + [T.StructField("__inside", T.LongType())])
    counted = stage(ranged.mapInArrow(run, schema), "ranged")
    sums = counted.groupBy("__part").agg(F.sum("__amount").alias("__sum"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per task of the range sort, so the window and the broadcast are as small as that number
    base = sums.select("__part", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base"))
    return counted.join(F.broadcast(base), "__part").select(
        *columns, (F.col("__base") + F.col("__inside")).alias("position")
    )


def per_copy(df: DataFrame, copies: str, out: str) -> DataFrame:
    """A row for every copy, numbered from 0; in two steps, so no row ever holds an array of all of them."""
    chunks = F.floor((F.col(copies) - 1) / COPY_CHUNK).cast("long")
    df = df.withColumn("__chunk", F.explode(F.sequence(F.lit(0).cast("long"), chunks)))
    last = F.least(F.col(copies) - F.col("__chunk") * COPY_CHUNK, F.lit(COPY_CHUNK).cast("long")) - 1
    inside = F.explode(F.sequence(F.lit(0).cast("long"), last))
    return df.withColumn("__inside", inside).withColumn(out, F.col("__chunk") * COPY_CHUNK + F.col("__inside")).drop("__chunk", "__inside")
