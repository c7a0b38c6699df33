"""Class probabilities from word counts alone: a model that any engine can recompute."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType

from hearsay.functions.text import clean_tokens
from hearsay.operators.skew import explode_words
from hearsay.operators.wordtable import coded, sums, word_table
from hearsay.session import cut_lineage


class CountedScorer:
    """Probabilities by Bayes' rule over the words of a text, each on its own; ``columns`` name the last classes, in order.

    ``weights`` holds a row a word with the logarithms of its smoothed share of each class's words. Words outside it say nothing; a text without
    known words, or null, has the classes' shares. The weights lie as sorted hash arrays in the shared folder, where tasks look up the words of
    their own texts: scoring shuffles neither texts nor words.
    """

    def __init__(self, weights: DataFrame, priors: Sequence[float], columns: Sequence[str]):
        self.weights, self.priors, self.columns = weights, tuple(priors), tuple(columns)
        self.table = word_table(weights.select("token", *[f"w{i}" for i in range(len(self.priors))]))

    def score(self, df: DataFrame, text: str) -> DataFrame:
        classes, table = len(self.priors), self.table

        def totals(tokens: pa.Array) -> pa.Array:
            distinct, codes, starts = coded(tokens)
            each = np.stack([sums(np.r_[np.nan_to_num(w), 0.0][codes], starts) for w in table.find(distinct)], axis=1)
            return pa.ListArray.from_arrays(pa.array(np.arange(len(each) + 1) * classes, pa.int32()), pa.array(each.ravel()))

        summed = F.arrow_udf(totals, "array<double>", ArrowUDFType.SCALAR)
        rows = df.withColumn("__sums", summed(clean_tokens(text)))
        found = rows.withColumns({f"__s{i}": F.get("__sums", F.lit(i)) + F.lit(p) for i, p in enumerate(self.priors)})
        top = F.greatest(*[F.col(f"__s{i}") for i in range(classes)])
        powers = [F.exp(F.col(f"__s{i}") - top) for i in range(classes)]
        total = sum(powers[1:], powers[0])
        others, first = [c for c in df.columns if c not in self.columns], classes - len(self.columns)
        return found.select(*others, *[(powers[first + i] / total).alias(c) for i, c in enumerate(self.columns)])


def count_classifier(df: DataFrame, text: str, label: str, columns: Sequence[str], smoothing: float = 1.0) -> CountedScorer:
    """A scorer from the words of texts labelled 0, 1, 2 ...; with fewer ``columns`` than classes the last classes are named.

    Rows without a label are left out; a null text counts for its class's share only. Every word seen counts, ``smoothing`` is added to each count.
    Two classes at least are assumed, more where labels say so. Without any labelled row all classes are equally likely. Counts combine before they
    travel; the driver gets two numbers a class.
    """
    if not smoothing > 0:
        raise ValueError("smoothing must be positive")
    rows = df.select(clean_tokens(text).alias("tokens"), F.col(label).cast("int").alias("label")).filter("label >= 0")
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    classes = range(max([*sizes, len(columns) - 1, 1]) + 1)
    counts = explode_words(rows, ["label"], "tokens").groupBy("token", "label").agg(F.count(F.lit(1)).alias("n"))
    wide = cut_lineage(counts.groupBy("token").agg(
        *[F.coalesce(F.sum(F.when(F.col("label") == i, F.col("n"))), F.lit(0)).alias(f"n{i}") for i in classes]
    ))
    totals = wide.agg(F.count(F.lit(1)).alias("v"), *[F.coalesce(F.sum(f"n{i}"), F.lit(0)).alias(f"n{i}") for i in classes]).head()
    # the logarithm of a quotient of sums, each exact
    weights = wide.select("token", *[
        F.log((F.col(f"n{i}") + F.lit(smoothing)) / F.lit(totals[f"n{i}"] + smoothing * totals["v"])).alias(f"w{i}") for i in classes
    ])
    everything = sum(sizes.values()) + smoothing * len(classes)
    return CountedScorer(weights, [math.log((sizes.get(i, 0) + smoothing) / everything) for i in classes], columns)
