"""Severity of toxic texts by cumulative-link ordinal regression on sparse text features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearsay.llm.common import lists, map_slices, mix, split_words, starts, step, table

TRAINING_ROWS = 8000
PREFIXES = (4, 5, 7)
COMMON = 0.02
LIFT = 10.0
TELLS = 50.0
GRADES = (1, 4, 10)  # toxic words from which a toxic text is mild, strong, severe


def _features(chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Feature hashes of distinct words, row by row: the whole word in lower case and its beginnings, which
    endings do not change; marks at either end of a word are left out.
    """
    words = pc.utf8_lower(pc.utf8_trim(chunks, "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~«»“”‘’…¡¿"))
    size = pc.utf8_length(words).to_numpy()
    kinds, owners = [], []
    for n in (0, *PREFIXES):
        rows = np.flatnonzero(size > n) if n else np.flatnonzero(size > 0)
        part = words.take(pa.array(rows))
        part = pc.utf8_slice_codeunits(part, 0, n) if n else part
        coded = part.dictionary_encode()
        if len(rows):
            import pandas as pd

            hashes = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False).astype(object), categorize=False)
            kinds.append(mix(hashes, n)[coded.indices.to_numpy()])
            owners.append(rows)
    if not kinds:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(kinds).view(np.int64), np.concatenate(owners)


def _by_document(texts: pa.Array, wanted: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, feature, number of words, words per document) of whole texts; only ``wanted`` features (sorted) if given."""
    words, counts = split_words(texts)
    coded = words.dictionary_encode()
    features, owner = _features(coded.dictionary)
    if wanted is not None:
        at = np.minimum(np.searchsorted(wanted, features), len(wanted) - 1) if len(wanted) else np.zeros(len(features), dtype=np.int64)
        keep = wanted[at] == features if len(wanted) else np.zeros(len(features), dtype=bool)
        features, owner = features[keep], owner[keep]
    order = np.argsort(owner, kind="stable")
    features, owner = features[order], owner[order]
    per_word = np.bincount(owner, minlength=len(coded.dictionary)).astype(np.int64)
    first = starts(per_word)
    codes = coded.indices.to_numpy()
    hit = np.flatnonzero(per_word[codes] > 0) if len(codes) else np.zeros(0, dtype=np.int64)
    codes, doc = codes[hit], np.repeat(np.arange(len(counts)), counts)[hit]
    n = per_word[codes]
    upto = np.r_[0, np.cumsum(n)]
    at = np.repeat(first[codes] - upto[:-1], n) + np.arange(upto[-1])
    doc, feature = np.repeat(doc, n), features[at]
    order = np.lexsort((feature, doc))
    doc, feature = doc[order], feature[order]
    new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (feature[1:] != feature[:-1])]) if len(doc) else np.zeros(0, dtype=np.int64)
    return doc[new], feature[new], np.diff(np.r_[new, len(doc)]), counts


def _sparse(batch: pa.RecordBatch) -> pa.RecordBatch:
    doc, feature, n, _ = _by_document(batch["text"], None)
    sizes = np.bincount(doc, minlength=batch.num_rows)
    return pa.RecordBatch.from_arrays(
        [batch["toxic"], lists(feature, sizes, pa.int64()), lists(n, sizes, pa.int64())], ["toxic", "features", "counts"]
    )


@dataclass(frozen=True)
class Model:
    """One weight per feature (sorted hashes), shared by all thresholds; P(grade >= k) = sigmoid(x.w - thresholds[k - 1])."""

    features: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _loss_slopes(score: np.ndarray, grade: np.ndarray, thresholds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slopes of the negative log-likelihood by the score and by the thresholds, per row.

    P(grade = k) = P(grade >= k) - P(grade >= k + 1), with P(grade >= 0) = 1 and P(grade >= K + 1) = 0.
    """
    n, k = len(score), len(thresholds)
    above = np.column_stack([np.ones(n), _sigmoid(score[:, None] - thresholds), np.zeros(n)])
    rows = np.arange(n)
    p = np.maximum(above[rows, grade] - above[rows, grade + 1], 1e-9)
    steep = above * (1 - above)
    by_score = -(steep[rows, grade] - steep[rows, grade + 1]) / p
    by_threshold = np.zeros((n, k + 2))
    by_threshold[rows, grade] += steep[rows, grade] / p
    by_threshold[rows, grade + 1] -= steep[rows, grade + 1] / p
    return by_score, by_threshold[:, 1 : k + 1]


def fit_ordinal(
    rows: np.ndarray, columns: np.ndarray, values: np.ndarray, grade: np.ndarray, n_columns: int,
    sparsity: float = 1e-4, rounds: int = 800,
) -> tuple[np.ndarray, np.ndarray]:
    """Weights (few of them not 0) and ordered thresholds, by accelerated proximal gradient descent.

    Toxic and clean rows weigh the same together. Gaps between thresholds are kept positive.
    """
    n, k = len(grade), len(GRADES)
    share = np.where(grade > 0, 0.5 / max(1, (grade > 0).sum()), 0.5 / max(1, (grade == 0).sum()))
    v = np.random.default_rng(1).standard_normal(n_columns)
    norm = 1.0
    for _ in range(15):  # the largest curvature of the weighted squares
        score = np.bincount(rows, values * v[columns], n)
        v = np.bincount(columns, values * (score * share)[rows], n_columns)
        norm = np.linalg.norm(v) + 1e-12
        v /= norm
    pace = 1 / (0.5 * norm + 0.5)
    w, b = np.zeros(n_columns), np.arange(k, dtype=float) + 0.5
    zw, zb, t = w, b, 1.0
    for _ in range(rounds):
        by_score, by_threshold = _loss_slopes(np.bincount(rows, values * zw[columns], n), grade, zb)
        new_w = zw - pace * np.bincount(columns, values * (by_score * share)[rows], n_columns)
        new_w = np.sign(new_w) * np.maximum(np.abs(new_w) - pace * sparsity, 0)
        new_b = zb - pace * (by_threshold * share[:, None]).sum(axis=0)
        new_b = np.r_[new_b[0], np.maximum(new_b[1:], new_b[:-1] + 0.05)]
        new_b = np.maximum.accumulate(new_b)
        faster = (1 + np.sqrt(1 + 4 * t * t)) / 2
        zw, zb = new_w + (t - 1) / faster * (new_w - w), np.maximum.accumulate(new_b + (t - 1) / faster * (new_b - b))
        w, b, t = new_w, new_b, faster
    return w, b


def train(docs: DataFrame, labels: DataFrame, max_rows: int = TRAINING_ROWS) -> Model:
    """Fit the model on at most ``max_rows`` labelled documents, those of the least hash of their id.

    ``labels`` has ``doc_id`` and ``toxic`` (0 or 1); rows with a null in either, or without a document, are left out. An id labelled
    twice counts as toxic if one label says so. Labels only say whether a text is toxic, so its grade is set by
    the words that give it away: those with a feature that some toxic texts have and clean texts
    nearly never. ``GRADES`` says from how many on a text is mild, strong or severe; a toxic text
    without any is mild. Only features that ``COMMON`` of the toxic texts have, and ``LIFT`` times
    as often as clean ones, may get a weight. Without toxic labels nothing is toxic.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    sample = known.join(ids, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # the sample is bounded by ``max_rows`` ids, so it may be sent everywhere and the texts stay put
    rows = step(texts.join(F.broadcast(sample), "doc_id").select("text", "toxic").mapInArrow(
        map_slices(_sparse, "text"), "toxic int, features array<long>, counts array<long>"
    ), "features")
    n1, n0 = (x or 0 for x in rows.agg(F.count_if(F.col("toxic") > 0), F.count_if(F.col("toxic") <= 0)).first())
    if not n1 or not n0:
        return Model(np.zeros(0, dtype=np.int64), np.zeros(0), np.array([1e9, 2e9, 3e9]) if not n1 else np.array([-1.0, 1e9, 2e9]))
    # features are counted where they are, and the driver gets those that may have a weight: however many words
    # texts have, few of them are in so many toxic ones
    has = rows.select("toxic", F.explode("features").alias("feature")).groupBy("feature").agg(
        F.count_if(F.col("toxic") > 0).alias("in_toxic"), F.count_if(F.col("toxic") <= 0).alias("in_clean")
    )
    # a feature of a few texts only would learn their labels by heart, wrong ones included
    common = has.filter((F.col("in_toxic") >= max(3, COMMON * n1)) & (F.col("in_toxic") / n1 > LIFT * F.col("in_clean") / n0))
    found = sorted((r["feature"], r["in_toxic"] / n1 > TELLS * r["in_clean"] / n0) for r in common.collect())
    names = np.array([f for f, _ in found], dtype=np.int64)
    telling = np.array([t for _, t in found], dtype=bool)
    kept = rows.mapInArrow(_only(names), "toxic int, features array<long>, counts array<long>").toArrow()
    toxic = kept["toxic"].to_numpy() > 0
    column = kept["features"].combine_chunks()
    sizes = column.value_lengths().to_numpy()
    doc, feature = np.repeat(np.arange(len(sizes)), sizes), column.flatten().to_numpy()
    count = kept["counts"].combine_chunks().flatten().to_numpy()
    tells = telling[feature]
    hits = np.bincount(doc[tells], count[tells], len(sizes))
    per_word = np.maximum(1, np.bincount(doc[tells], minlength=len(sizes)))
    # a word has several features, of which those that tell are counted once each
    words = hits / np.clip(per_word, 1, len(PREFIXES) + 1)
    grade = np.where(toxic, np.maximum(1, np.searchsorted(GRADES, words, side="right")), 0)
    w, b = fit_ordinal(doc, feature, np.log1p(count), grade, len(names))
    used = w != 0
    return Model(names[used], w[used], b)


def _only(names: np.ndarray):
    """Rows with the given features alone, each by its place among them."""

    def only(batches):
        for batch in batches:
            column = batch["features"]
            own = np.repeat(np.arange(batch.num_rows), column.value_lengths().to_numpy())
            feature, count = column.flatten().to_numpy(), batch["counts"].flatten().to_numpy()
            at = np.searchsorted(names, feature)
            keep = np.flatnonzero(names[np.minimum(at, len(names) - 1)] == feature) if len(names) else np.zeros(0, dtype=np.int64)
            sizes = np.bincount(own[keep], minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch["toxic"], lists(at[keep], sizes, pa.int64()), lists(count[keep], sizes, pa.int64())], ["toxic", "features", "counts"]
            )

    return only


def _score(model: Model):
    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        doc, feature, n, _ = _by_document(batch["text"], model.features)
        x = np.bincount(doc, np.log1p(n) * model.weights[np.searchsorted(model.features, feature)], batch.num_rows)
        above = _sigmoid(x[:, None] - model.thresholds)
        return pa.RecordBatch.from_arrays(
            [batch["row"], lists(above.ravel(), np.full(len(x), above.shape[1]), pa.float64()), pa.array(above.sum(axis=1))],
            ["row", "above", "severity"],
        )

    sliced = map_slices(score, "text")

    def over(batches):  # the text comes within the row, and only once
        yield from sliced(
            pa.RecordBatch.from_arrays([b["row"], pc.struct_field(b["row"], "text").cast(pa.string())], ["row", "text"]) for b in batches
        )

    return over


def rate(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``toxicity``: ``above`` (probability of at least each grade from 1 on), ``severity`` (the
    expected grade, 0 to 3), ``grade`` (the last grade at least as likely as not) and ``toxic`` (``grade`` > 0).

    Every row is rated; a null text is an empty one, and an empty text has the severity of no evidence.
    Other columns stay as they are, whatever their names.
    """
    packed = docs.select(F.struct(*docs.columns).alias("row"))
    scored = packed.mapInArrow(
        _score(model), T.StructType([*packed.schema, T.StructField("above", T.ArrayType(T.DoubleType())), T.StructField("severity", T.DoubleType())])
    )
    grade = F.size(F.filter("above", lambda p: p >= 0.5))
    toxicity = F.struct("above", "severity", grade.alias("grade"), (grade > 0).alias("toxic")).alias("toxicity")
    return scored.select(*[F.col("row")[c].alias(c) for c in docs.columns], toxicity)


def op4_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    rated = rate(docs, train(docs, table(spark, sf, "labels")))
    return rated.select("doc_id", F.col("toxicity.severity").alias("severity"), F.col("toxicity.grade").alias("grade"), F.col("toxicity.toxic").alias("toxic"))


QUERIES = {"op4_toxicity": op4_toxicity}
ORACLES: dict[str, str] = {}
