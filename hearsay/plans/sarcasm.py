"""The sarcasm result table: full text, scores, clear names, joined back to the posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearsay import schemas
from hearsay.functions.text import full_text
from hearsay.operators.normalize import conform, rename_scores
from hearsay.operators.scoring import Scorer, score_column
from hearsay.operators.skew import lookup_join
from hearsay.sources import tables

RESULT_SCORES = ("negative_prob", "neutral_prob", "positive_prob", "sarcasm_prob", "negative_raw", "neg_w_sarcasm")


def _text_key(text: str) -> Column:
    # nulls match each other, as they do when frames are merged on text
    return F.coalesce(F.sha2(F.col(text), 256), F.lit("null"))


def attach_scores(posts: DataFrame, scores: DataFrame, by: str = "post_id", text: str = "full_post", **options) -> DataFrame:
    """Posts with their scores, by key or by text.

    By text, every copy of a text meets every score of that text. The k x k rows this means for k
    copies are not written out: each post appears once with the mean of its text's scores, and
    ``copies`` says how many rows it stands for, so a mean weighted by ``copies`` is the same.
    """
    if by == "post_id":
        return posts.join(scores.select("post_id", *RESULT_SCORES), "post_id", "left")
    per_text = (
        scores.withColumn("__key", _text_key(text)).groupBy("__key")
        .agg(*[F.avg(c).alias(c) for c in RESULT_SCORES], F.count(F.lit(1)).alias("copies"))
    )
    joined = lookup_join(
        posts.withColumn("__key", _text_key(text)), per_text, "__key", "left", spread_by=["post_id"], bounded_by=scores, **options
    )
    return joined.withColumn("copies", F.coalesce("copies", F.lit(1))).drop("__key")


def score_table(posts: DataFrame, sentiment: Scorer, sarcasm: Scorer) -> DataFrame:
    """Scores of every post's full text under their clear names."""
    texts = posts.select("post_id", full_text().alias("full_post"))
    return rename_scores(score_column(texts, "full_post", sentiment, sarcasm, keys=["post_id"]))


def result_table(posts: DataFrame, scores: DataFrame, by: str = "post_id", **options) -> DataFrame:
    """The table the topic job reads; by text it also carries ``copies``."""
    merged = attach_scores(posts.withColumn("full_post", full_text()), scores, by, **options)
    columns = schemas.SARCASM_RESULT.fieldNames()
    return merged.select(*columns, *(["copies"] if by == "text" else []))


def as_result(df: DataFrame) -> DataFrame:
    return conform(df, schemas.SARCASM_RESULT)


def store_result_table(posts: DataFrame, scores: DataFrame, table: str, location: str, by: str = "post_id", **options) -> DataFrame:
    """Attach the scores, replace the stored table in one step, and read it back."""
    tables.replace(as_result(result_table(posts, scores, by, **options)), table, location)
    return tables.scan(posts.sparkSession, table)
