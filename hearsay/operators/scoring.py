"""Class and sarcasm probabilities, and the accuracy of a labelling.

A scorer takes a frame and a text column and adds probability columns. ``PipelineScorer`` wraps a
fitted Spark ML pipeline and stays in the JVM; ``BatchScorer`` feeds Arrow batches to a model of
the user's. Texts are scored whole.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce
from typing import Protocol

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.ml.pipeline import Pipeline
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearsay.functions.scalars import effective_negativity, negativity
from hearsay.functions.text import clean_tokens, preprocess
from hearsay.session import cut_lineage

SENTIMENT_COLUMNS = ("neg_prob", "neu_prob", "pos_prob")
SARCASM_COLUMNS = ("sarcasm_prob",)
SCORE_COLUMNS = (*SENTIMENT_COLUMNS, *SARCASM_COLUMNS, "neg_raw", "neg_effective")
BATCH_SIZE = 256


class Scorer(Protocol):
    """Adds the probability columns of its task to a frame."""

    def score(self, df: DataFrame, text: str) -> DataFrame: ...


class PipelineScorer:
    """Probabilities of a fitted pipeline; ``columns`` name the last classes, in order."""

    def __init__(self, model: PipelineModel, columns: Sequence[str]):
        self.model, self.columns = model, tuple(columns)

    def score(self, df: DataFrame, text: str) -> DataFrame:
        kept = df.columns
        scored = self.model.transform(df.withColumn("__tokens", clean_tokens(text)))
        probs = scored.withColumn("__p", vector_to_array("__probability"))
        # a binary task names its positive class only
        first = F.size("__p") - len(self.columns)
        return probs.select(
            *kept, *[F.get("__p", first + i).alias(c) for i, c in enumerate(self.columns)]
        )


class BatchScorer:
    """Probabilities of a user's model, loaded once per Python worker and fed in batches."""

    def __init__(self, make_predict: Callable, columns: Sequence[str], batch_size: int = BATCH_SIZE):
        self.columns = tuple(columns)
        self.predict = predict_batch_udf(
            make_predict, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size
        )

    def score(self, df: DataFrame, text: str) -> DataFrame:
        probs = df.withColumn("__p", self.predict(F.col(text)))
        return probs.withColumns({c: F.get("__p", F.lit(i)).cast("double") for i, c in enumerate(self.columns)}).drop("__p")


def train_classifier(df: DataFrame, text: str, label: str, features: int = 4096, iterations: int = 20) -> PipelineModel:
    """Multinomial logistic regression over hashed TF-IDF of the cleaned tokens.

    The texts are read, joined and cleaned once: what both fits read is the written counts.
    """
    train = df.select(clean_tokens(text).alias("__tokens"), F.col(label).cast("double").alias("__label"))
    hashing = HashingTF(inputCol="__tokens", outputCol="__tf", numFeatures=features)
    counts = cut_lineage(hashing.transform(train).select("__tf", "__label"))
    stages = [
        IDF(inputCol="__tf", outputCol="__idf"),
        LogisticRegression(
            featuresCol="__idf", labelCol="__label", probabilityCol="__probability", rawPredictionCol="__raw",
            predictionCol="__prediction", family="multinomial", maxIter=iterations, regParam=0.01,
        ),
    ]
    return PipelineModel([hashing, *Pipeline(stages=stages).fit(counts).stages])


def score_texts(
    df: DataFrame, text: str, sentiment: Scorer, sarcasm: Scorer, preprocess_fn: Callable[[Column], Column] = preprocess
) -> DataFrame:
    """Add three class probabilities, sarcasm, raw and sarcasm-aware negativity."""
    prepared = df.withColumn("__text", preprocess_fn(F.col(text)))
    probs = sarcasm.score(sentiment.score(prepared, "__text"), "__text").drop("__text")
    return with_negativity(probs)


def with_negativity(df: DataFrame, **options) -> DataFrame:
    raw = df.withColumn("neg_raw", negativity("neg_prob", "pos_prob"))
    return raw.withColumn("neg_effective", effective_negativity("neg_raw", "sarcasm_prob", **options))


def score_column(df: DataFrame, text: str, sentiment: Scorer, sarcasm: Scorer, keys: Sequence[str] = (), **options) -> DataFrame:
    """Scores of a text column as a table: keys, ``text`` and the six scores."""
    rows = df.select(*keys, F.col(text).alias("text"))
    return score_texts(rows, "text", sentiment, sarcasm, **options).select(*keys, "text", *SCORE_COLUMNS)


def confusion(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    """Rows per pair of predicted and actual class."""
    return df.groupBy(predicted, actual).agg(F.count(F.lit(1)).alias("n"))


def accuracy(df: DataFrame, actual: str, **predictions: str) -> DataFrame:
    """Share of right answers per labelling and its gain over the first one named."""
    names = list(predictions)
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(n).alias("labelling"), (F.col(predictions[n]) == F.col(actual)).cast("int").alias("hit"))
        for i, n in enumerate(names)
    ])).alias("x")).select("x.*").filter(F.col("hit").isNotNull())
    scores = long.groupBy("i", "labelling").agg(F.count(F.lit(1)).alias("n"), F.avg("hit").alias("accuracy"))
    base = F.first("accuracy").over(Window.orderBy("i"))
    return scores.withColumn("gain", F.col("accuracy") - base).drop("i")


def _poisson(u: Column) -> Column:
    """How often a draw u in [0, 1) takes a row that is taken once on average."""
    steps, chance, below = [], math.exp(-1), 0.0
    for k in range(1, 13):
        below += chance
        steps.append((u >= F.lit(below)).cast("int"))
        chance /= k
    return reduce(Column.__add__, steps)


def gain_interval(
    df: DataFrame, key: str, actual: str, base: str, other: str, replicates: int = 200, level: float = 0.95, seed: str = "gain"
) -> DataFrame:
    """``(n, gain, low, high)``: by how much ``other`` is right more often than ``base``, and the range that holds it at ``level``.

    A paired bootstrap in one pass: in every replicate each row counts as often as a Poisson draw says, which is a digest of seed, key and
    replicate, so the result is the same wherever rows lie; both labellings are judged on the same draws. Tasks send on one row a replicate. ``low``
    and ``high`` are order statistics of the replicates' gains. Rows with a null in any of the columns are left out; rows that share a key are drawn
    together. Without rows there is one row of nulls with ``n`` 0; a replicate that draws no row at all is not counted.
    """
    hit = lambda c: (F.col(c) == F.col(actual)).cast("int")
    rows = df.select(F.col(key).cast("string").alias("key"), (hit(other) - hit(base)).alias("more")).dropna()
    each = rows.select("key", "more", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    digest = F.md5(F.concat_ws(":", F.lit(seed), "key", F.col("replicate").cast("string")))
    draw = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    weighted = each.withColumn("w", _poisson(draw)).groupBy("replicate").agg(
        F.sum("w").alias("drawn"), F.sum(F.col("w") * F.col("more")).alias("better"), F.count(F.lit(1)).alias("n"), F.sum("more").alias("all")
    )
    gains = F.sort_array(F.collect_list(F.try_divide("better", "drawn")))

    def at(share: float) -> Column:
        return F.get("gains", F.greatest(F.ceil(F.round(F.lit(share) * F.size("gains"), 6)).cast("int"), F.lit(1)) - 1)

    found = weighted.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.max(F.try_divide("all", "n")).alias("gain"), gains.alias("gains"))
    return found.select("n", "gain", at((1 - level) / 2).alias("low"), at((1 + level) / 2).alias("high"))
