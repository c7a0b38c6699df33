"""Sweep listings, insert new posts, fetch and insert comments of unanswered posts."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearsay import schemas
from hearsay.operators import upsert
from hearsay.operators.normalize import normalise_comments, normalise_posts
from hearsay.sources import landing

TIME_FILTERS = ("month", "year", "all")
LIMIT_PER_LISTING = 1000


def _place(column: str, values: Sequence[str]) -> Column:
    return F.coalesce(F.array_position(F.lit(list(values)), F.col(column)), F.lit(0))


def sweep(
    landed: DataFrame,
    stored: DataFrame,
    subs: Sequence[str],
    modes: Sequence[str] = schemas.LISTING_MODES,
    time_filters: Sequence[str] = TIME_FILTERS,
    limit: int = LIMIT_PER_LISTING,
    **options,
) -> DataFrame:
    """All listings in one read, without stored posts; ``sweep_rank`` is the order of collection."""
    picked = landing.shape_listing(landing.listing(landed, subs, modes, time_filters, limit))
    order = (
        (_place("subreddit", subs) * len(modes) + _place("mode", modes)) * (len(time_filters) + 1)
        + _place("time_filter", time_filters)
    )
    ranked = picked.withColumn("sweep_rank", F.struct(order.alias("listing"), F.col("rank").alias("rank")))
    fresh = upsert.not_stored(ranked, stored, "id", "post_id", **options)
    return fresh.drop("rank", "time_filter")


def first_posts(swept: DataFrame) -> DataFrame:
    """Swept posts normalised, one row per post, the first collected."""
    return normalise_posts(upsert.dedup(swept.filter(F.col("id").isNotNull()), "id", ["sweep_rank"]))


def insert_posts(spark: SparkSession, swept: DataFrame, table: str) -> upsert.Inserted:
    return upsert.insert_or_ignore(first_posts(swept), table, "post_id")


@dataclass(frozen=True)
class Round:
    """What one sweep of a top-up brought, and how many posts are still wanted after it."""

    attempted: int
    added: int
    total: int
    wanted: int


def top_up(spark: SparkSession, sweeps: Iterable[DataFrame], table: str, target: int) -> list[Round]:
    """Insert one sweep after the other until the table holds ``target`` posts or no sweep is left.

    A sweep is inserted whole, so the table may end with more than ``target``. Sweeps are taken only when they are
    wanted: a generator may land new listings first, or end when the last ones brought nothing. A table that holds enough is left
    as it is, and no round is given; a top-up that failed is simply run again.
    """
    rounds: list[Round] = []
    total, waiting = spark.table(table).count(), iter(sweeps)
    while total < target and (swept := next(waiting, None)) is not None:
        done = insert_posts(spark, swept, table)
        total += done.added
        rounds.append(Round(done.attempted, done.added, total, max(0, target - total)))
    return rounds


def upsert_comments(
    spark: SparkSession, landed_comments: DataFrame, post_ids: DataFrame, posts_table: str, comments_table: str
) -> upsert.Inserted:
    """Comments of the given posts, with their community, inserted where new.

    Comments whose post is not stored are left out; ``upsert.without_parent`` lists them.
    """
    posts = spark.table(posts_table)
    rows = normalise_comments(landing.comments_for_posts(landed_comments, post_ids), posts)
    return upsert.insert_or_ignore(upsert.with_parent(rows, posts), comments_table, "comment_id", ["created_utc", "post_id"])
