"""Score posts and comments with a word list and label them.

Scores read the raw texts, not the cleaned ones: case and punctuation carry sentiment.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType

from hearsay.functions.lexicon import (
    MAX_DICTIONARY_ROWS,
    buckets_for,
    cased_words,
    core_compound,
    dictionary,
    lexicon_sentiment,
    lookup,
    normalise,
    sentiment_words,
    stressed,
)
from hearsay.functions.scalars import fill_weight, label_sentiment, row_mean
from hearsay.operators.skew import explode_words, lookup_join
from hearsay.operators.wordrules import core_totals, rule_totals
from hearsay.operators.wordtable import word_table

TextScorer = Callable[[DataFrame, str, str], DataFrame]


def core_scorer(valence: Callable[[Column], Column], words: Callable[[Column], Column] = sentiment_words) -> TextScorer:
    """Word valences only."""
    def score(df: DataFrame, text: str, out: str) -> DataFrame:
        return df.withColumn(out, core_compound(words(F.coalesce(F.col(text), F.lit(""))), valence))

    return score


def rules_scorer(valence: Callable[[Column], Column]) -> TextScorer:
    """Word valences under the published rules of emphasis, negation and contrast."""
    return lambda df, text, out: lexicon_sentiment(df, text, valence, out)


def lexicon_scorer(lexicon: DataFrame, rules: bool = True, max_rows: int = MAX_DICTIONARY_ROWS, **_) -> TextScorer:
    """Scorer over a (token, valence) table; the scores are the same for a table of any size.

    A table of checked size is held as one constant and each row is scored where it lies. Beyond that the
    table is written as sorted hash arrays in the shared folder, and tasks look up the words of their own
    texts there: neither texts nor words are shuffled, so keys may be null or repeated. Making the scorer
    counts the table.
    """
    words = lexicon.select("token", F.col("valence").cast("double").alias("valence"))
    size = words.count()
    if size <= max_rows:
        buckets = buckets_for(size)
        index = dictionary(words, "token", "valence", buckets)
        valence = lambda w: lookup(index, w, buckets)
        return rules_scorer(valence) if rules else core_scorer(lambda w: valence(F.lower(w)))
    table = word_table(words.groupBy("token").agg(F.max("valence").alias("valence")))
    totals = F.arrow_udf(rule_totals(table) if rules else core_totals(table), "double", ArrowUDFType.SCALAR)

    def score(df: DataFrame, text: str, out: str) -> DataFrame:
        source, total = F.coalesce(F.col(text), F.lit("")), f"__{out}_total"
        found = sentiment_words(source)
        summed = df.withColumn(total, totals(cased_words(found) if rules else F.transform(found, F.lower)))
        compound = stressed(F.col(total), source) if rules else normalise(F.col(total))
        return summed.withColumn(out, compound).drop(total)

    return score


def score_by_join(df: DataFrame, key: str, tokens: str, lexicon: DataFrame, out: str, **options) -> DataFrame:
    """Core score for a word list of any size: (key, compound), one row per key.

    A word's repeats within one text are counted in the row that holds them, and the sums
    combine map-side. Frequent words are cut by text if the list is too big to broadcast.
    """
    words = explode_words(df, [key], tokens)
    known = lexicon.groupBy("token").agg(F.max("valence").cast("double").alias("valence"))
    hits = lookup_join(words, known, "token", "inner", spread_by=[key], bounded_by=lexicon, **options)
    sums = hits.groupBy(key).agg(F.sum("valence").alias("total"))
    scored = df.select(key).join(sums, key, "left")
    return scored.select(key, F.coalesce(normalise(F.col("total")), F.lit(0.0)).alias(out))


def score_posts(posts: DataFrame, scorer: TextScorer) -> DataFrame:
    """Sentiment of body, title and both, each with its label."""
    scored = scorer(scorer(posts, "body", "sentiment_body"), "title", "sentiment_title")
    scored = scored.withColumn("sentiment_post", row_mean("sentiment_title", "sentiment_body"))
    return scored.withColumns(
        {f"sentiment_{p}_label": label_sentiment(f"sentiment_{p}") for p in ("body", "title", "post")}
    ).withColumn("score_weighted", fill_weight("score"))


def score_comments(comments: DataFrame, scorer: TextScorer) -> DataFrame:
    scored = scorer(comments, "body", "sentiment")
    return scored.withColumn("comment_sentiment_label", label_sentiment("sentiment")).withColumn(
        "score_weighted", fill_weight("score")
    )


def word_list_share(df: DataFrame, by: Sequence[str], tokens: str, lexicon: DataFrame) -> DataFrame:
    """``(*by, words, listed, share)``: how many of the words the list can score, so how much of the texts a score rests on.

    Words are counted per group before they meet the list, which may be of any size; groups without words have no row.
    """
    counts = explode_words(df, list(by), tokens).groupBy(*by, "token").agg(F.count(F.lit(1)).alias("n"))
    known = lexicon.select("token").distinct().withColumn("known", F.lit(True))
    met = lookup_join(counts, known, "token", "left", spread_by=list(by))
    listed = F.coalesce(F.sum(F.when(F.col("known"), F.col("n"))), F.lit(0))
    return met.groupBy(*by).agg(F.sum("n").alias("words"), listed.alias("listed")).withColumn("share", F.col("listed") / F.col("words"))
