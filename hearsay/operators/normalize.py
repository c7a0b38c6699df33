"""Bring landed rows to the table schemas; project and rename results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearsay import schemas
from hearsay.functions import scalars
from hearsay.operators.skew import lookup_join

# Column names of the contract.
RENAMES = {"id": "post_id", "created_date": "date"}
# Column names of the contract.
SCORE_NAMES = {
    "neg_prob": "negative_prob",
    "neu_prob": "neutral_prob",
    "pos_prob": "positive_prob",
    "neg_raw": "negative_raw",
    "neg_effective": "neg_w_sarcasm",
    "text": "full_post",
}


def rename_present(df: DataFrame, names: dict[str, str] = RENAMES) -> DataFrame:
    """Rename the columns that are there; absent ones are no error."""
    return df.withColumnsRenamed(names)


def derive_date(df: DataFrame) -> DataFrame:
    """Add ``date`` as ISO-8601 UTC text if the frame has none."""
    if "date" in df.columns:
        return df
    source = scalars.epoch_to_iso("created_utc") if "created_utc" in df.columns else F.lit(None)
    return df.withColumn("date", source.cast("string"))


def _coerce(name: str, have: T.DataType, want: T.DataType) -> Column:
    if isinstance(want, T.LongType):
        return scalars.to_long(name, have.simpleString())
    if isinstance(have, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(name, scalars.ISO_UTC)
    return F.col(name).cast(want)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the schema's columns, in order and type; absent columns and bad numbers are null."""
    have = {f.name: f.dataType for f in df.schema}
    return df.select(
        [
            (_coerce(f.name, have[f.name], f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in schema
        ]
    )


def drop_missing(df: DataFrame, *keys: str) -> DataFrame:
    return df.dropna(subset=list(keys), how="any")


def normalise_posts(df: DataFrame) -> DataFrame:
    typed = conform(derive_date(rename_present(df)), schemas.POSTS)
    return drop_missing(typed, "post_id")


def subreddit_from_posts(comments: DataFrame, posts: DataFrame, **options) -> DataFrame:
    """Give comments the subreddit of their post if they carry none at all.

    One post may own a third of all comments, hence the skew-safe join.
    """
    if "subreddit" in comments.columns and not comments.filter(F.col("subreddit").isNotNull()).isEmpty():
        return comments
    known = posts.filter(F.col("post_id").isNotNull()).groupBy("post_id").agg(F.max("subreddit").alias("subreddit"))
    return lookup_join(comments.drop("subreddit"), known, "post_id", "left", bounded_by=posts.select("post_id"), **options)


def normalise_comments(df: DataFrame, posts: DataFrame, **options) -> DataFrame:
    typed = conform(derive_date(subreddit_from_posts(df, posts, **options)), schemas.COMMENTS)
    return drop_missing(typed, "comment_id", "post_id")


def lists_to_text(df: DataFrame) -> DataFrame:
    """Every list column as one text, items joined by a space."""
    return df.select(
        [
            F.array_join(F.col(f.name), " ").alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f.name)
            for f in df.schema
        ]
    )


def bytes_to_numbers(df: DataFrame, *columns: str, unsigned: bool = False) -> DataFrame:
    """Decode the named columns where they hold byte blobs; others pass as they are."""
    types = {f.name: f.dataType for f in df.schema}
    blobs = {c: scalars.bytes_to_long(c, unsigned) for c in columns if isinstance(types[c], T.BinaryType)}
    return df.withColumns(blobs) if blobs else df


def rename_scores(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed(SCORE_NAMES)
