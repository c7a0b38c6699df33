"""Landed listings and threads, the files a collector leaves behind."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearsay import schemas
from hearsay.functions import scalars
from hearsay.operators.skew import MAX_BROADCAST_ROWS, lookup_join, top_n_per_group
from hearsay.session import cut_lineage

LISTING_LIMIT = 500


def _as_list(value: str | Sequence[str]) -> list[str]:
    return [value] if isinstance(value, str) else list(value)


def check_modes(modes: str | Sequence[str]) -> list[str]:
    listed = _as_list(modes)
    unknown = [m for m in listed if m not in schemas.LISTING_MODES]
    if unknown:
        raise ValueError(f"unknown mode {unknown[0]!r}: use {', '.join(schemas.LISTING_MODES)}")
    return listed


def read_listing(spark: SparkSession, path: str) -> DataFrame:
    """Landing zone partitioned by subreddit, mode and time_filter (time_filter only for top)."""
    return spark.read.schema(schemas.LISTING).parquet(path)


def listing(
    landed: DataFrame,
    subs: str | Sequence[str],
    modes: str | Sequence[str],
    time_filters: str | Sequence[str] = "year",
    limit: int = LISTING_LIMIT,
) -> DataFrame:
    """At most ``limit`` rows of each listing by its rank; the filters reach the partitions.

    The time filter selects among "top" listings only. Places are ranked without their texts, and the
    rows at the winning places are fetched then; rows at the very same place count as one.
    """
    subs, modes, time_filters = _as_list(subs), check_modes(modes), _as_list(time_filters)
    wanted = F.col("subreddit").isin(subs) & F.col("mode").isin(modes)
    window = (F.col("mode") != "top") | F.col("time_filter").isin(time_filters)
    chosen = landed.filter(wanted & window)
    place = ["subreddit", "mode", "time_filter", "rank", "id"]
    best = top_n_per_group(chosen.select(*place).distinct(), place[:3], [F.col("rank"), F.col("id")], limit)
    best = best.select(*[F.col(c).alias(f"best_{c}") for c in place])
    if len(subs) * len(modes) * (len(time_filters) + 1) * limit <= MAX_BROADCAST_ROWS:
        best = F.broadcast(best)
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"best_{c}")) for c in place])
    return chosen.join(best, same, "left_semi")


def shape_listing(landed: DataFrame) -> DataFrame:
    """Rows as the collector shapes them: no null texts, author always text, full permalink."""
    return landed.select(
        "id",
        "created_utc",
        scalars.listing_timestamp("created_utc").alias("created_date"),
        F.coalesce("author", F.lit("None")).alias("author"),
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("body", F.lit("")).alias("body"),
        "score",
        "num_comments",
        F.concat(F.lit(schemas.PERMALINK_HOST), F.col("permalink")).alias("permalink"),
        "subreddit",
        "mode",
        *[c for c in ("time_filter", "rank") if c in landed.columns],
    )


def read_threads(spark: SparkSession, path: str) -> DataFrame:
    """Landed threads, one JSON record per post; a bad record is kept in ``_corrupt_record``."""
    reader = spark.read.schema(schemas.thread()).option("mode", "PERMISSIVE")
    return reader.option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def bad_threads(threads: DataFrame) -> DataFrame:
    """Records that could not be read, to be reported while the rest goes on."""
    return threads.filter(F.col("_corrupt_record").isNotNull()).select("_corrupt_record")


_REPLY = ("id", "created_utc", "author", "body", "score")


def _flat_reply(reply: Column) -> Column:
    return F.struct(*[reply[c].alias(c) for c in _REPLY], F.lit(None).cast("string").alias("deeper"))


def _flat_last_reply(reply: Column) -> Column:
    return F.struct(*[reply[c].alias(c) for c in _REPLY], reply["replies"].alias("deeper"))


def _levels(comments: Column, depth: int) -> list[Column]:
    """The replies of each nesting level as arrays of one flat shape."""
    levels, current = [], comments
    for level in range(1, depth + 1):
        last = level == depth
        is_comment = F.filter(current, lambda r: ~F.coalesce(r["kind"] == "more", F.lit(False)))
        levels.append(F.transform(is_comment, _flat_reply if not last else _flat_last_reply))
        if not last:
            nested = F.transform(current, lambda r: r["replies"])
            current = F.flatten(F.filter(nested, lambda r: r.isNotNull()))
    return levels


def flatten_threads(threads: DataFrame, depth: int = schemas.THREAD_DEPTH) -> DataFrame:
    """Every comment of every thread as one flat row; stubs of kind "more" are dropped.

    One narrow pass reads ``depth`` levels. What nests deeper arrives as JSON text and is read in
    another pass, as often as there is any, so no reply is lost.
    """
    rest = threads.filter(F.col("_corrupt_record").isNull() & F.col("post_id").isNotNull())
    rest = rest.select("post_id", "permalink", "comments")
    parts = []
    while True:
        every = reduce(lambda a, b: F.concat(a, b), _levels(F.col("comments"), depth))
        # outer with a filter behind it, so that the levels are not worked out once more to be counted
        rows = rest.select("post_id", "permalink", F.explode_outer(every).alias("c")).filter(F.col("c").isNotNull())
        parts.append(rows)
        nested = F.from_json("c.deeper", T.ArrayType(schemas.thread_reply(depth)))
        # written, so that the next pass starts from the deeper replies and not from the source again
        deeper = cut_lineage(rows.filter(F.length("c.deeper") > 2).select("post_id", "permalink", "c"))
        rest = deeper.select("post_id", "permalink", nested.alias("comments"))
        if rest.isEmpty():
            break
    rows = reduce(DataFrame.unionByName, parts)
    return rows.select(
        "post_id",
        F.col("c.id").alias("comment_id"),
        "c.created_utc",
        F.coalesce("c.author", F.lit("None")).alias("author"),
        F.coalesce("c.body", F.lit("")).alias("body"),
        "c.score",
        F.concat(F.lit(schemas.PERMALINK_HOST), F.col("permalink")).alias("parent_permalink"),
    )


def comments_for_posts(landed: DataFrame, post_ids: DataFrame, **options) -> DataFrame:
    """Landed comments of the given posts; one post may own a third of them."""
    wanted = post_ids.select("post_id")
    return lookup_join(landed, wanted.distinct(), "post_id", "left_semi", bounded_by=wanted, **options)
