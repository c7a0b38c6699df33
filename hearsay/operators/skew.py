"""Joins and limits that hold when one key owns a third of all rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearsay.session import stage

# narrow rows only: half a million of them are some tens of megabytes
MAX_BROADCAST_ROWS = 500_000
TASK_GROUPS = 64


def explode_words(df: DataFrame, keep: Sequence[str], tokens: str, position: str | None = None) -> DataFrame:
    """One row per token. The outer form with a filter behind it, because Spark guards a plain
    explode with a filter on the list's size, and that works the list out a second time.
    """
    rows = F.posexplode_outer(tokens).alias(position, "token") if position else F.explode_outer(tokens).alias("token")
    return df.select(*keep, rows).filter(F.col("token").isNotNull())


def bounded(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> bool:
    """Whether ``df`` holds at most ``max_rows`` rows.

    A count, not a limit: counting sends one number per task and reads file footers where it can,
    while a limit would send up to ``max_rows`` rows of every task to a single one.
    """
    return df.count() <= max_rows


def parallelism(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def hot_keys(df: DataFrame, on: Sequence[str], parts: int) -> DataFrame:
    """Keys holding more than one ``parts``-th of all rows, with the tasks each should be cut into.

    There are fewer than ``parts`` of them, however the rows lie, so the result may be broadcast.
    """
    counts = df.groupBy(*on).agg(F.count(F.lit(1)).alias("__n"))
    # the same shuffle serves the counts and their sum
    total = counts.agg(F.sum("__n")).scalar()
    return counts.filter(F.col("__n") * parts > total).select(
        *on, F.ceil(F.col("__n") * parts / total).cast("int").alias("__cuts")
    )


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    on: str | Sequence[str],
    how: str = "left",
    spread_by: Sequence[str] | None = None,
    max_broadcast_rows: int = MAX_BROADCAST_ROWS,
    bounded_by: DataFrame | None = None,
) -> DataFrame:
    """Join many rows to a side with one row per key: left, inner, left_semi or left_anti.

    A right side of checked size is broadcast; ``bounded_by`` names a frame that is cheaper to
    count and has at least as many rows. Beyond that, keys too big for one task are cut by
    a hash of ``spread_by`` (columns that tell the left rows of a key apart), in
    proportion to their share, and only their right rows are repeated: fewer than twice the
    number of shuffle partitions in all. The result is the same either way.
    """
    on = [on] if isinstance(on, str) else list(on)
    if bounded(right if bounded_by is None else bounded_by, max_broadcast_rows):
        return left.join(F.broadcast(right), on, how)
    return salted_join(left, right, on, how, spread_by)


def salted_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str, spread_by: Sequence[str] | None = None
) -> DataFrame:
    parts = parallelism(left)
    hot = F.broadcast(hot_keys(left.select(*on), on, parts))
    no_key = reduce(Column.__or__, [F.col(c).isNull() for c in on])
    # full copies share every column, so by default the task they come from tells them apart
    spread = F.xxhash64(*spread_by) if spread_by else F.xxhash64(*left.columns, F.spark_partition_id())
    # rows without a key never match, so any task may carry them
    cuts = F.when(no_key, F.lit(parts)).otherwise(F.coalesce("__cuts", F.lit(1)))
    cut_left = left.join(hot, list(on), "left").withColumn("__cut", F.pmod(spread, cuts).cast("int"))
    cut_right = (
        right.join(hot, list(on), "left")
        .withColumn("__cut", F.explode(F.sequence(F.lit(0), F.coalesce("__cuts", F.lit(1)) - 1)))
        .drop("__cuts")
    )
    columns = left.columns + ([] if how in ("left_semi", "left_anti") else [c for c in right.columns if c not in on])
    return cut_left.join(cut_right, [*on, "__cut"], how).select(*columns)


def top_n_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """First ``n`` rows of each group by ``order``, numbered in ``rank_in_group``.

    Up to the session's window group limit Spark cuts each task's share to ``n`` before the shuffle; for a
    larger ``n`` each task's share is first cut to ``n`` on its own. Shares are then cut again by
    groups of tasks, so that a hot group's candidates meet in steps and not all at once.
    """
    limit = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold"))
    cuts = [F.pmod(F.spark_partition_id(), F.lit(TASK_GROUPS))]
    if n > limit:
        cuts.insert(0, F.spark_partition_id())
    if n * parallelism(df) > TASK_GROUPS * limit:
        tagged = df.withColumns({f"__cut{i}": c for i, c in enumerate(cuts)})
        for i in range(len(cuts)):
            inner = Window.partitionBy(*by, f"__cut{i}").orderBy(*order)
            tagged = tagged.withColumn("__rn", F.row_number().over(inner)).filter(F.col("__rn") <= n).drop("__rn")
        df = tagged.select(*df.columns)
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank_in_group", F.row_number().over(window)).filter(F.col("rank_in_group") <= n)


def first_per_key(df: DataFrame, key: str | Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first by ``order``; copies are dropped before the shuffle."""
    by = [key] if isinstance(key, str) else list(key)
    return top_n_per_group(df, by, order, 1).drop("rank_in_group")


def numbered(df: DataFrame, order: Sequence[Column], out: str) -> DataFrame:
    """Rows numbered from 0 by ``order`` (a total one), without bringing them into one task.

    The rows are range-sorted and written; each range is numbered on its own and starts where the
    ranges before it end. One number per range is broadcast.
    """
    ranged = stage(df.repartitionByRange(parallelism(df), *order).withColumn("__range", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1
    placed = ranged.withColumn("__in", inside).join(F.broadcast(base), "__range")
    return placed.select(*df.columns, (F.col("__base") + F.col("__in")).alias(out))
