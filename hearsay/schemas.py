"""Explicit schemas of every table boundary. Nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {"string": T.StringType(), "bigint": T.LongType(), "double": T.DoubleType(), "timestamp": T.TimestampType()}


def _struct(spec: str) -> T.StructType:
    """Schema from "name type, ..."; needs no running session."""
    pairs = [item.split() for item in spec.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


# Table columns, order and types.
POSTS = _struct(
    "post_id string, created_utc bigint, date string, author string, title string, body string, "
    "score bigint, num_comments bigint, permalink string, subreddit string, mode string"
)
COMMENTS = _struct(
    "post_id string, comment_id string, subreddit string, created_utc bigint, date string, "
    "author string, body string, score bigint, parent_permalink string"
)
LISTING = _struct(
    "id string, created_utc double, title string, body string, author string, score bigint, "
    "num_comments bigint, permalink string, rank bigint, subreddit string, mode string, time_filter string"
)
THREAD_DEPTH = 10
SARCASM_RESULT = _struct(
    "negative_prob double, neutral_prob double, positive_prob double, sarcasm_prob double, "
    "negative_raw double, neg_w_sarcasm double, full_post string, date timestamp, post_id string"
)
LISTING_MODES = ("top", "hot", "new")
PERMALINK_HOST = "https://reddit.com"
POSTS_KEY = "post_id"
COMMENTS_KEY = "comment_id"


def thread_reply(depth: int = THREAD_DEPTH) -> T.StructType:
    """Landed shape of one reply, nested ``depth`` levels; what lies deeper stays JSON text."""
    fields = [
        T.StructField("kind", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("created_utc", T.DoubleType()),
        T.StructField("author", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("score", T.LongType()),
    ]
    nested = T.ArrayType(thread_reply(depth - 1)) if depth > 1 else T.StringType()
    return T.StructType([*fields, T.StructField("replies", nested)])


def thread(depth: int = THREAD_DEPTH) -> T.StructType:
    """Landed shape of one post's thread; ``_corrupt_record`` keeps what did not parse."""
    return T.StructType(
        [
            T.StructField("post_id", T.StringType()),
            T.StructField("permalink", T.StringType()),
            T.StructField("comments", T.ArrayType(thread_reply(depth))),
            T.StructField("_corrupt_record", T.StringType()),
        ]
    )
