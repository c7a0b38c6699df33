"""Session settings and the shared folder every job may write to."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


PARTITION_BYTES = 128 << 20


def shuffle_partitions_for(input_bytes: int) -> int:
    """Shuffle partitions to start from: adaptive execution merges small ones, but makes no more of them."""
    return max(200, -(-input_bytes // PARTITION_BYTES))


def build_session(
    app: str = "hearsay", master: str | None = None, input_bytes: int | None = None, **conf: str
) -> SparkSession:
    """A session with the settings the operators rely on (UTC, AQE, skew handling).

    ``input_bytes`` is the size of the largest input, from which the number of shuffle partitions follows.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
    }
    if input_bytes is not None:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions_for(input_bytes))
    settings.update({key.replace("__", "."): value for key, value in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, as the session names it.

    Only a local session may fall back to a folder of its own; a cluster without
    ``spark.checkpoint.dir`` is refused, since a machine-local folder dies with its machine.
    """
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if configured:
        return configured
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current.rsplit("/", 1)[0]
    if not context.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder shared by all executors")
    own = tempfile.mkdtemp(prefix="hearsay-")
    context.setCheckpointDir(own)
    return own


_run: ContextVar[str] = ContextVar("run", default="")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; nothing there is ever overwritten."""
    return f"{shared_dir(spark).rstrip('/')}/hearsay/{_run.get()}{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch_run(spark: SparkSession) -> Iterator[str]:
    """One folder for all that is staged while the block runs, which goes as it ends.

    Results are lazy: write or collect them within the block. Without such a block staged tables stay until the shared folder is cleared, since
    no operator can tell when its result has been read for the last time.
    """
    name = f"run-{uuid.uuid4().hex}/"
    token = _run.set(_run.get() + name)
    path = f"{shared_dir(spark).rstrip('/')}/hearsay/{_run.get()}".rstrip("/")
    try:
        yield path
    finally:
        _run.reset(token)
        discard(spark, path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows as written to the shared folder, so that lost executors cost no recomputation.

    A table rather than an RDD checkpoint: it stays columnar, prunes, counts by its footers, and
    tells the optimiser its size.
    """
    return stage(df, "step")


def discard(spark: SparkSession, path: str) -> None:
    """Remove a scratch folder, wherever the shared folder lies."""
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def staged(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """``df`` as written to the shared folder, for as long as the block runs."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    try:
        df.write.parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        discard(spark, path)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read from there."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
