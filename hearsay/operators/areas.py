"""Topics merged to areas, pair by pair: one tree, of which any number of areas is a cut."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearsay.operators import linear
from hearsay.operators.skew import explode_words
from hearsay.session import cut_lineage

MAX_TOPICS = 2_000
TREE = "step int, a int, b int, similarity double, size long"


def word_weights(df: DataFrame, topic: str, tokens: str) -> DataFrame:
    """``(topic, token, weight)``: class-based TF-IDF of every word, tf x log(1 + A / f)."""
    counts = cut_lineage(explode_words(df, [topic], tokens).groupBy(topic, "token").agg(F.count(F.lit(1)).alias("tf")))
    everywhere = counts.groupBy("token").agg(F.sum("tf").alias("f"))
    average = counts.agg((F.sum("tf") / F.count_distinct(topic)).alias("a")).scalar()
    return counts.join(everywhere, "token").select(topic, "token", (F.col("tf") * F.log1p(average / F.col("f"))).alias("weight"))


def similarities(weights: DataFrame, topic: str = "topic") -> tuple[list[int], np.ndarray]:
    """The topics in order and the cosines of their word weights.

    A word brings its topics and weights together, one row a word, of at most as many as there are topics. Tasks add up products of these rows, and
    the sums of cells are combined; so the words may be any number, while topics are at most ``MAX_TOPICS``.
    """
    topics = [r[0] for r in weights.select(topic).distinct().orderBy(topic).limit(MAX_TOPICS + 1).collect()]
    if len(topics) > MAX_TOPICS:
        raise ValueError(f"more than {MAX_TOPICS} topics: merge smaller ones first")
    place = F.array_position(F.array(*[F.lit(t) for t in topics]), F.col(topic)) - 1
    words = weights.groupBy("token").agg(F.collect_list(F.struct(place.alias("at"), "weight")).alias("w"))

    def add(total, batch):
        lists = batch["w"]
        size = lists.value_lengths().to_numpy()
        flat = lists.flatten()
        at, weight = flat.field("at").to_numpy(), flat.field("weight").to_numpy()
        row = np.repeat(np.arange(len(size)), size)
        for first in range(0, len(size), 4096):
            some = (row >= first) & (row < first + 4096)
            dense = np.zeros((min(4096, len(size) - first), len(topics)))
            dense[row[some] - first, at[some]] = weight[some]
            total += dense.T @ dense

    products = linear.summed(words.select("w"), (len(topics), len(topics)), add)
    length = np.sqrt(np.diag(products))
    length[length == 0] = 1.0
    return topics, products / length[:, None] / length[None, :]


def merge_tree(df: DataFrame, topic: str, tokens: str, outlier: int = -1) -> DataFrame:
    """``(step, a, b, similarity, size)``: the most similar areas a < b become one, called a, step by step, until one is left.

    Two areas are as similar as their topics are on average, each topic weighing as its documents. Ties go to the smaller numbers. ``size`` is the
    number of documents of the new area. Outliers take no part; topics without words are similar to none. Fewer than two topics give no rows.
    """
    real = df.filter(F.col(topic).isNotNull() & (F.col(topic) != outlier)).select(F.col(topic).cast("int").alias("topic"), F.col(tokens).alias("tokens"))
    counted = {r["topic"]: r["n"] for r in real.groupBy("topic").agg(F.count(F.lit(1)).alias("n")).collect()}
    named, found = similarities(word_weights(real, "topic", "tokens"))
    topics = sorted(counted)
    alike = np.zeros((len(topics), len(topics)))
    where = [topics.index(t) for t in named]
    alike[np.ix_(where, where)] = found
    size = np.array([counted[t] for t in topics], dtype=np.float64)
    np.fill_diagonal(alike, -np.inf)
    steps = []
    for step in range(len(topics) - 1):
        # equal to twelve digits is a tie, whatever order sums were added up in
        close = np.round(alike, 12)
        a, b = divmod(int(close.argmax()), len(topics))
        a, b = min(a, b), max(a, b)
        steps.append((step, topics[a], topics[b], float(alike[a, b]), int(size[a] + size[b])))
        mean = (size[a] * alike[a] + size[b] * alike[b]) / (size[a] + size[b])
        alike[a], alike[:, a] = mean, mean
        alike[a, a] = -np.inf
        alike[b], alike[:, b] = -np.inf, -np.inf
        size[a] += size[b]
    return df.sparkSession.createDataFrame(steps, TREE)


def cut(tree: DataFrame, k: int) -> DataFrame:
    """``(topic, area)`` for the ``k`` areas that are left before the last ``k`` - 1 merges; an area is called by its smallest topic."""
    if k < 1:
        raise ValueError("at least one area")
    steps = [(r["a"], r["b"]) for r in tree.orderBy("step").collect()]  # fewer than MAX_TOPICS
    area = {t: t for pair in steps for t in pair}
    for a, b in steps[: max(0, len(steps) + 1 - k)]:
        area = {t: a if x == b else x for t, x in area.items()}
    return tree.sparkSession.createDataFrame(sorted(area.items()), "topic int, area int")
