"""Union, dedup, keyed insert-or-ignore and the checks between posts and comments."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearsay.operators.skew import first_per_key, lookup_join
from hearsay.session import staged
from hearsay.sources import key_ranges, tables


def safe_union(frames: Iterable[DataFrame | None]) -> DataFrame | None:
    """Union by column name; missing frames are skipped, missing columns are null."""
    present = [f for f in frames if f is not None and f.columns]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), present) if present else None


def dedup(df: DataFrame, key: str, order: Sequence[Column | str]) -> DataFrame:
    """One row per key, the first by ``order``: Spark rows have no arrival order of their own."""
    return first_per_key(df, key, [F.col(c) if isinstance(c, str) else c for c in order])


def not_stored(df: DataFrame, stored: DataFrame, key: str, stored_key: str | None = None, **options) -> DataFrame:
    """Rows whose key is not among the stored ones (stored keys are unique)."""
    known = stored.select(F.col(stored_key or key).alias(key))
    return lookup_join(df, known, key, "left_anti", **options)


@dataclass(frozen=True)
class Inserted:
    """What an insert tried and what it really added."""

    attempted: int
    added: int


def insert_or_ignore(df: DataFrame, table: str, key: str, order: Sequence[Column | str] = ()) -> Inserted:
    """Append the rows whose key is new; rows already stored win. One writer per table.

    Of rows that share a key within ``df`` the first by ``order`` is kept (without one, by a hash of
    the row), so the key stays unique and the anti join has no hot key on either side; a bucketed
    table is read where it lies. The rows are staged once in the shared folder for as long as the
    insert runs, so the sweep behind them runs once; counting them and the table then only reads
    file footers. Repeating an insert adds nothing, so a failed run may simply be run again.
    """
    spark = df.sparkSession
    first = dedup(df.filter(F.col(key).isNotNull()), key, [*order, F.xxhash64(*df.columns)])
    with staged(first, table.split(".")[-1]) as rows:
        before = spark.table(table).count()
        tables.append(rows.join(tables.keys(spark, table, key), key, "left_anti"), table)
        return Inserted(rows.count(), spark.table(table).count() - before)


def insert_by_ranges(df: DataFrame, table: str, key: str, order: Sequence[Column | str] = ()) -> Inserted:
    """As ``insert_or_ignore``, but opening only files whose key range holds one of the new keys.

    For many small inserts into a large table. Rows go in sorted by key, so that files have narrow ranges; the ranges
    of new files are noted after the files are there. Without noted ranges all files are read, and noted then: so the first such
    insert into an old table, and files that others added since, cost one reading of their keys. One writer per table.
    """
    spark = df.sparkSession
    first = dedup(df.filter(F.col(key).isNotNull()), key, [*order, F.xxhash64(*df.columns)])
    with staged(first, table.split(".")[-1]) as rows:
        picked = key_ranges.files_that_may_hold(rows.select(key), table, key)
        known = tables.keys(spark, table, key) if picked is None else key_ranges.read_files(spark, table, picked, key)
        before = set(key_ranges.stored_files(spark, table))
        # one row a key on both sides, so no key is hot
        tables.append(rows.join(known, key, "left_anti"), table, sort_by=key)
        key_ranges.add_ranges(spark, table, key, key_ranges.unnoted(spark, table))
        new = [f for f in key_ranges.stored_files(spark, table) if f not in before]
        return Inserted(rows.count(), key_ranges.read_files(spark, table, new, key).count())


def with_parent(comments: DataFrame, posts: DataFrame, **options) -> DataFrame:
    """Comments whose post exists."""
    return lookup_join(comments, posts.select("post_id"), "post_id", "left_semi", **options)


def without_parent(comments: DataFrame, posts: DataFrame, **options) -> DataFrame:
    """Comments that break the reference to posts."""
    return lookup_join(comments, posts.select("post_id"), "post_id", "left_anti", **options)


def cascade_delete(comments: DataFrame, deleted_posts: DataFrame, **options) -> DataFrame:
    """Comments left after their posts were deleted."""
    gone = deleted_posts.select("post_id")
    return lookup_join(comments, gone.distinct(), "post_id", "left_anti", bounded_by=gone, **options)


def comment_candidates(posts: DataFrame, comments: DataFrame, limit: int = 5000) -> DataFrame:
    """Posts without any stored comment, best score first.

    Comments shrink to their distinct posts map-side before anything is shuffled.
    """
    answered = comments.select("post_id").filter(F.col("post_id").isNotNull()).distinct()
    open_posts = posts.select("post_id", "score").join(answered, "post_id", "left_anti")
    return open_posts.orderBy(F.desc_nulls_last("score"), "post_id").limit(limit)


def stored_comment_counts(posts: DataFrame, comments: DataFrame, key: str = "comment_id") -> DataFrame:
    """Posts with the number of comments stored for each; comments are counted before the join."""
    counts = comments.groupBy("post_id").agg(F.count(key).alias("stored_comments"))
    return posts.join(counts, "post_id", "left").withColumn("stored_comments", F.coalesce("stored_comments", F.lit(0)))


def table_counts(**frames: DataFrame) -> DataFrame:
    """One row per table with its row count."""
    counts = [f.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, f in frames.items()]
    return reduce(DataFrame.unionByName, counts)


def key_check(df: DataFrame, key: str) -> DataFrame:
    """Rows, distinct keys, and whether they agree."""
    counts = df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(key).alias("n_keys"))
    return counts.withColumn("is_unique", F.col("n_rows") == F.col("n_keys"))


def count_delta(before: DataFrame, after: DataFrame, label: str = "") -> DataFrame:
    """Growth per table between two ``table_counts``."""
    joined = after.withColumnRenamed("n", "total").join(before.withColumnRenamed("n", "was"), "name", "left")
    return joined.select(
        "name", F.lit(label).alias("label"), (F.col("total") - F.coalesce("was", F.lit(0))).alias("added"), "total"
    )
