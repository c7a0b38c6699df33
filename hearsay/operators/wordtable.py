"""A word table of any size that tasks look words up in where their texts lie: no text, word or pair is shuffled for it."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearsay.arrays import arrays, bits_for, by_key, shard_of, write_shards
from hearsay.session import cut_lineage, scratch_path

CHECK_BITS = 52
CHECK_KEY = "hearsay-check-16"


def _hashes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each word, made apart: 64 bits to find it by and 52 more that must agree."""
    texts = words.to_numpy(zero_copy_only=False).astype(object)
    key = pd.util.hash_array(texts, categorize=False).view(np.int64)
    check = pd.util.hash_array(texts, hash_key=CHECK_KEY, categorize=False) >> np.uint64(64 - CHECK_BITS)
    return key, check.astype(np.int64)


def _keyed(batches):
    for batch in batches:
        key, check = _hashes(batch["token"])
        columns = [pa.array(key), pa.array(check), *(batch[c] for c in batch.schema.names[1:])]
        yield pa.RecordBatch.from_arrays(columns, ["key", "check", *batch.schema.names[1:]])


class WordTable:
    """Numbers of words in sorted hash arrays of the shared folder, which workers map. Words are told apart by 116 bits of hashes."""

    def __init__(self, folder: str, bits: int, fields: Sequence[str]):
        self.folder, self.bits, self.fields = folder, bits, tuple(fields)

    def find(self, words: pa.Array) -> list[np.ndarray]:
        """The values of all fields for distinct words, NaN for those not in the table."""
        key, check = _hashes(words)
        keys, back = np.unique(key, return_inverse=True)
        agreed, *values = (x[back] for x in arrays(self.folder, "words", self.bits).find(keys, ["check", *self.fields], np.nan))
        return [np.where(agreed == check, v, np.nan) for v in values]


def word_table(words: DataFrame) -> WordTable:
    """The table of ``words(token, number...)``; tokens are unique, null ones are left out."""
    spark = words.sparkSession
    fields = words.columns[1:]
    rows = words.filter(F.col("token").isNotNull()).select("token", *[F.col(c).cast("double").alias(c) for c in fields])
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("check", T.LongType()), *rows.schema[1:]])
    keyed = cut_lineage(rows.mapInArrow(_keyed, schema))
    bits, folder = bits_for(keyed.count()), scratch_path(spark, "words")
    dealt = keyed.withColumn("__shard", shard_of("key", bits)).repartition(max(1, 1 << bits), "__shard").sortWithinPartitions("__shard")
    write_shards(dealt, folder, "words", by_key).agg(F.count(F.lit(1))).collect()
    return WordTable(folder, bits, fields)


def coded(lists: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of the lists, the place of each word among them (null: -1), and where each list starts (null: empty), with the end."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    words = lists.flatten().dictionary_encode()
    sizes = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64)
    return words.dictionary, words.indices.fill_null(-1).to_numpy(), np.r_[0, np.cumsum(sizes)]


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The sum of each list's values, added in order; none is 0."""
    each = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    return np.bincount(each, weights=values, minlength=len(starts) - 1)
