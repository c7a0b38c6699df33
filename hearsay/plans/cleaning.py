"""Raw tables to cleaned tables: numbers decoded, dates set, texts cleaned once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearsay.functions.scalars import epoch_to_timestamp
from hearsay.functions.text import clean_tokens
from hearsay.operators.normalize import bytes_to_numbers


def _clean(df: DataFrame, numbers: Sequence[str], texts: Sequence[str], **options) -> DataFrame:
    decoded = bytes_to_numbers(df, *numbers)
    dated = decoded.withColumn("date", epoch_to_timestamp("created_utc"))
    tokens = dated.withColumns({f"{t}_tokens": clean_tokens(t, **options) for t in texts})
    return tokens.withColumns({f"{t}_clean": F.array_join(f"{t}_tokens", " ") for t in texts})


def clean_posts(posts: DataFrame, **options) -> DataFrame:
    """Posts with title and body cleaned, as text and as tokens; raw texts stay."""
    return _clean(posts, ["score", "num_comments", "created_utc"], ["title", "body"], **options)


def clean_comments(comments: DataFrame, **options) -> DataFrame:
    return _clean(comments, ["score", "created_utc"], ["body"], **options)
