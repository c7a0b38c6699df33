"""Rolling sentiment: daily sums written by the stream, rolled up to months in batch.

A month is no fixed length, so the stream writes days. Sums, not means, are kept: they add up to
the plain and the weighted mean of any longer period.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hearsay.functions.aggregates import known

SUMS = ("n", "n_known", "total", "weights", "weighted")


def daily_sums(df: DataFrame, ts: str, value: str, weight: str) -> DataFrame:
    """Per day: rows, known values, their sum, sum of weights, and weighted sum."""
    v, w = known(value), known(weight)
    stamped = df.withColumn("__ts", F.col(ts).cast("timestamp"))
    days = stamped.filter(F.col("__ts").isNotNull()).groupBy(F.window("__ts", "1 day").alias("day"))
    return days.agg(
        F.count(F.lit(1)).alias("n"),
        F.count(v).alias("n_known"),
        F.sum(v).alias("total"),
        F.sum(F.coalesce(w, F.lit(0.0))).alias("weights"),
        F.sum(v * F.coalesce(w, F.lit(0.0))).alias("weighted"),
    ).withColumn("day", F.col("day.start"))


def roll_up(days: DataFrame, period: str = "month") -> DataFrame:
    """Plain and weighted mean per period from the daily sums."""
    sums = days.groupBy(F.date_trunc(period, "day").alias(period)).agg(
        *[F.sum(c).alias(c) for c in SUMS]
    )
    plain = F.col("total") / F.nullif("n_known", F.lit(0))
    weighted = F.when(F.col("n_known") == F.col("n"), F.col("weighted") / F.col("weights"))
    return sums.select(
        period, "n", plain.alias("mean"),
        F.when(F.col("weights") > 0, weighted).otherwise(plain).alias("weighted_mean"),
    )


FAN = 8


def _files(spark: SparkSession, path: str):
    """The file system of ``path`` and its path class."""
    kind = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return kind(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), kind


def _names(spark: SparkSession, path: str) -> list[str]:
    files, kind = _files(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(kind(path))) if files.exists(kind(path)) else []


def merged_runs(spark: SparkSession, path: str) -> list[tuple[int, int, int]]:
    """``(level, first batch, last batch)`` of the merged folders that count, as the last manifest names them.

    A manifest is one empty file whose name lists its runs, so it is there whole or not at all.
    """
    listed = [n for n in _names(spark, f"{path}/_manifests") if n.startswith("v")]
    last = max(listed, default="v0~", key=lambda n: int(n[1:].split("~")[0]))
    return [tuple(map(int, run.split("-"))) for run in last.split("~", 1)[1].split("+") if run]


def open_batches(spark: SparkSession, path: str) -> list[int]:
    """Batches written whole that no merged folder holds."""
    upto = max((last for _, _, last in merged_runs(spark, path)), default=-1)
    files, kind = _files(spark, path)
    batches = [int(n.split("=")[1]) for n in _names(spark, path) if n.startswith("batch=")]
    return sorted(b for b in batches if b > upto and files.exists(kind(f"{path}/batch={b}/_SUCCESS")))


def merge_days(spark: SparkSession, path: str, before: int, fan: int = FAN) -> None:
    """Merge batches ahead of batch ``before`` so that the folders to read grow with the logarithm of the batches.

    ``fan`` folders of a level become one of the next. A merged folder is written first, then the manifest that names it in place of its parts, then the
    parts go. A crash in between loses nothing: what no manifest names is not read, is written over when the merge is done again, and
    batches that a manifest covers are not read even while their folders are still there. One writer per path; ``before`` is the batch now being
    written, which may come again, so it is left alone.
    """
    files, kind = _files(spark, path)
    runs = merged_runs(spark, path)
    while True:
        ready = [(0, b, b) for b in open_batches(spark, path) if b < before]
        groups = [[r for r in runs + ready if r[0] == level] for level in range(max([r[0] for r in runs], default=0) + 1)]
        found = next((g[:fan] for g in groups if len(g) >= fan), None)
        if found is None:
            return
        level, first, last = found[0][0] + 1, found[0][1], found[-1][2]
        summed = _added(spark.read.parquet(*[_folder(path, r) for r in found]))
        summed.coalesce(1).write.mode("overwrite").parquet(_folder(path, (level, first, last)))
        runs = sorted([r for r in runs if r not in found] + [(level, first, last)], key=lambda r: r[1])
        names = _names(spark, f"{path}/_manifests")
        number = max((int(n[1:].split("~")[0]) for n in names if n.startswith("v")), default=0) + 1
        listed = "+".join("-".join(map(str, r)) for r in runs)
        files.create(kind(f"{path}/_manifests/v{number}~{listed}"), True).close()
        for old in found:
            files.delete(kind(_folder(path, old)), True)
        for name in names:
            files.delete(kind(f"{path}/_manifests/{name}"), True)


def _folder(path: str, run: tuple[int, int, int]) -> str:
    level, first, last = run
    return f"{path}/batch={first}" if level == 0 else f"{path}/level={level}/{first}-{last}"


def _added(sums: DataFrame) -> DataFrame:
    return sums.groupBy("day").agg(*[F.sum(c).alias(c) for c in SUMS])


def store_days(stream: DataFrame, ts: str, value: str, weight: str, path: str, checkpoint: str, fan: int = FAN) -> StreamingQuery:
    """Write the daily sums of each micro-batch under its number, and merge those of earlier ones.

    There is no state and no watermark, so a row counts however late it comes. A batch that is
    replayed writes over its own sums; ``stored_days`` adds the folders up.
    """
    spark = stream.sparkSession

    def store(batch: DataFrame, number: int) -> None:
        merge_days(spark, path, number, fan)
        daily_sums(batch, ts, value, weight).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def day_folders(spark: SparkSession, path: str) -> list[str]:
    """The folders that hold all days so far."""
    return [_folder(path, r) for r in merged_runs(spark, path)] + [f"{path}/batch={b}" for b in open_batches(spark, path)]


def stored_days(spark: SparkSession, path: str) -> DataFrame:
    """All days so far, one row each."""
    return _added(spark.read.parquet(*day_folders(spark, path)))
