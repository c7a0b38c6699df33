"""From scored posts to named complaint topics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearsay.functions.scalars import is_complaint
from hearsay.functions.text import clean_tokens
from hearsay.operators import hierarchy, lloyd, topics
from hearsay.session import cut_lineage

CUT = 0.2


@dataclass(frozen=True)
class Complaints:
    """Results of the topic job, all of them lazy but for the vectors."""

    assigned: DataFrame
    words: DataFrame
    info: DataFrame
    docs: DataFrame


def complaints(results: DataFrame, cut: float = CUT) -> DataFrame:
    return results.filter(is_complaint("neg_w_sarcasm", cut))


def complaint_topics(
    results: DataFrame,
    key: str = "post_id",
    text: str = "full_post",
    cut: float = CUT,
    dims: int = 3,
    width: float = 0.05,
    min_cell: int = 5,
    min_topic: int = 10,
    k: int | None = None,
    vector: str | None = None,
    neighbours: int | None = None,
    rounds: int | None = None,
) -> Complaints:
    """Filter, embed, reduce, cluster and describe.

    ``vector`` names a column of ready embeddings, else texts are embedded by TF-IDF. With ``k``
    the clusters come from k-means (with ``rounds`` too from starts picked by distance, so that the same rows give the same topics), with ``neighbours`` from the density of so many neighbours in the reduced space, else from that of grid cells. The vectors are checkpointed, since the
    clustering passes over them many times.
    """
    chosen = complaints(results, cut)
    tokens = chosen.select(key, clean_tokens(text).alias("tokens"), *([F.col(vector).alias("vector")] if vector else []))
    vectors = cut_lineage(tokens if vector else topics.embed(tokens, "tokens", "vector"))
    if k and rounds:
        found = lloyd.lloyd_topics(vectors, key, "vector", k, rounds).select(key, "topic")
    elif k:
        found = topics.centroid_topics(vectors, key, "vector", k)
    else:
        reduced = cut_lineage(topics.reduce_dimensions(vectors, "vector", dims, "coords").select(key, "coords"))
        found = (
            hierarchy.neighbour_topics(reduced, key, "coords", min_topic, neighbours) if neighbours
            else topics.density_topics(reduced, key, "coords", dims, width, min_cell, min_topic)
        )
    assigned = cut_lineage(vectors.join(found, key))
    words = topics.topic_words(assigned, "topic", "tokens")
    return Complaints(
        assigned, words, topics.topic_info(assigned, words), topics.representative_docs(assigned, key, "vector")
    )
