"""Main text of web pages: boosted trees over the nodes of the page, decoded along its hierarchy."""

from __future__ import annotations

import math
import random
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearsay.llm import boosting
from hearsay.llm.common import map_slices, table
from hearsay.llm.dom import Features, Nodes, attribute_words, read
from hearsay.llm.layouts import Maker

SAMPLED_PAGES = 200
MADE_PAGES = 1000
SLICE = 4 << 20


@dataclass(frozen=True)
class Model:
    trees: boosting.Trees
    words: dict[str, float]


def _labels(nodes: Nodes) -> np.ndarray:
    """A run of text is main if it lies in the article; an element is if any run in it is."""
    parent = np.array(nodes.parent)
    main = np.array([t is not None and m for t, m in zip(nodes.text, nodes.main, strict=True)])
    for i in range(len(main) - 1, 0, -1):
        if main[i] and parent[i] >= 0:
            main[parent[i]] = True
    return main


def train(pages: DataFrame, sampled_pages: int = SAMPLED_PAGES, made_pages: int = MADE_PAGES, seed: int = 17) -> Model:
    """Fit on pages made for it: ``made_pages`` layouts filled with blocks of ``sampled_pages`` real pages.

    Which part of a made page is the article is known, so no labels are needed. The sample is bounded: the pages
    of the least hash of their id. Without any page the layouts are filled with a few stock words.
    """
    ids = pages.select(F.col("page_id").cast("long").alias("page_id")).filter("page_id is not null").distinct()
    chosen = ids.orderBy(F.xxhash64("page_id"), "page_id").limit(sampled_pages)
    sample = pages.select(F.col("page_id").cast("long").alias("page_id"), "html").join(F.broadcast(chosen), "page_id").collect()
    nodes = Nodes()
    for i, row in enumerate(sorted(sample, key=lambda r: (r.page_id, r.html or ""))):
        read(i, row.html, nodes)
    pool = sorted({t for t in nodes.text if t and len(t) >= 20})
    maker = Maker(random.Random(seed), pool)
    made = Nodes()
    for i in range(made_pages):
        read(i, maker.page(), made)
    main = _labels(made)
    yes, no = Counter(), Counter()
    for attributes, good in zip(made.attributes, main, strict=True):
        (yes if good else no).update(attribute_words(attributes))
    words = {w: math.log((yes[w] + 0.5) / (no[w] + 0.5)) for w in {*yes, *no} if yes[w] + no[w] >= 3}
    x = Features(words).of(made)
    weight = np.ones(len(main))
    return Model(boosting.fit(x.astype(np.float64), main.astype(np.float64), weight), words)


def choose(nodes: Nodes, log_odds: np.ndarray) -> np.ndarray:
    """The best set of nodes in which whatever lies in a dropped element is dropped, and whatever holds a kept one is kept.

    Worked out from the leaves up: an element is worth what it and its kept children are worth, and is dropped with all in it if that
    is below nothing. A node weighs as the square root of its text.
    """
    parent, depth = np.array(nodes.parent), np.array(nodes.depth)
    size = np.array([s[0] for s in nodes.stats], dtype=np.float64)
    leaf = np.array([t is not None for t in nodes.text])
    whole = size.copy()
    levels = [np.flatnonzero(depth == d) for d in range(int(depth.max()) + 1)]
    for rows in reversed(levels[1:]):
        np.add.at(whole, parent[rows], whole[rows])
    worth = np.where(leaf, np.sqrt(1 + size), 0.5 * np.sqrt(1 + whole)) * np.clip(log_odds, -6, 6)
    worth[depth == 0] = 0
    for rows in reversed(levels[1:]):
        np.add.at(worth, parent[rows], np.maximum(worth[rows], 0))
    kept = worth > 0
    for rows in levels[1:]:
        kept[rows] &= kept[parent[rows]] | (depth[parent[rows]] == 0)
    return kept & leaf


def _extract(model: Model):
    features = Features(model.words)

    def extract(batch: pa.RecordBatch) -> pa.RecordBatch:
        nodes = Nodes()
        for i, source in enumerate(batch["html"].to_pylist()):
            read(i, source, nodes)
        kept = choose(nodes, model.trees.log_odds(features.of(nodes)))
        texts: list[list[str]] = [[] for _ in range(batch.num_rows)]
        for i in np.flatnonzero(kept):
            if nodes.text[i]:
                texts[nodes.page[i]].append(nodes.text[i])
        out = pa.array(["\n".join(t) for t in texts], pa.string())
        return pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], out], ["page_id", "url", "text"])

    return map_slices(extract, "html", SLICE)


def extract(pages: DataFrame, model: Model) -> DataFrame:
    """``(page_id, url, text)`` for every row of ``pages(page_id, url, html)``: the blocks of the main text, one a line.

    Character references are decoded and white space within a block is one space. A null, empty or textless page
    has the empty text; a page without tags is one block. Rows with null ids or urls and repeated rows are extracted like any other;
    other columns are ignored. Narrow: whole pages, no shuffle.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extract(model), "page_id long, url string, text string")


def op9_html_text(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    return extract(pages, train(pages)).withColumn("n_chars", F.length("text").cast("long"))


QUERIES = {"op9_html_text": op9_html_text}
ORACLES: dict[str, str] = {}
