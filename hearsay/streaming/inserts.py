"""Continuous insert-or-ignore from a folder of landed files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from hearsay.operators import upsert

def landed_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def insert_stream(
    stream: DataFrame, table: str, key: str, order: Sequence[Column | str], checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Insert each micro-batch where its keys are new, opening only files whose key range holds one of them.

    The stored keys are the only state: repeats are found however late they come, where a watermark
    would forget them and drop late rows unseen. A batch that is replayed after a failure finds its
    rows stored and adds nothing, so the table ends the same as after one batch insert.
    """
    reader = stream.sparkSession

    def store(batch: DataFrame, _: int) -> None:
        upsert.insert_by_ranges(batch, table, key, order)
        # the batch ran in a session of its own; the reader's may still hold the old file list
        reader.catalog.refreshTable(table)

    writer = stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
