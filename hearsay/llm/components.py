"""Connected components of an edge list too large for one machine."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearsay.session import stage


def smallest(near: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest id each row reaches by links within the two blocks."""
    la, lb = a.copy(), b.copy()
    top = np.iinfo(np.int64).max
    while True:
        na = np.minimum(la, np.where(near, lb[None, :], top).min(axis=1))
        nb = np.minimum(lb, np.where(near, na[:, None], top).min(axis=0))
        if (na == la).all() and (nb == lb).all():
            return na, nb
        la, lb = na, nb


def _hooks(edges: DataFrame) -> DataFrame:
    """Each vertex with the smallest of itself and its neighbours."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p")).select(F.col("a").alias("id"), "p")


def _shortened(hooks: DataFrame) -> DataFrame:
    """Pointers moved on to where their target points."""
    target = hooks.select(F.col("id").alias("p"), F.col("p").alias("pp"))
    return hooks.join(target, "p").select("id", F.col("pp").alias("p"))


def connected(edges: DataFrame) -> DataFrame:
    """``(id, component)`` for every end of ``edges(a, b)``; the component is its smallest vertex.

    Each round hooks every vertex to its smallest neighbour, shortens the pointers, and contracts
    the graph to the vertices pointed at. Vertices of the contracted graph at least halve, so the
    rounds are logarithmic; each is written to the shared folder. Minima combine before the
    shuffle, and the joins have one row per key on one side, so that a hub is split, not gathered.
    Loops and repeated edges are allowed; null ends are left out; no edges give no rows.
    """
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    edges = stage(edges.filter("a is not null and b is not null").distinct(), "edges")
    labels = None
    while True:
        hooks = stage(_shortened(_shortened(_hooks(edges))), "hooks")
        to = hooks.select(F.col("id").alias("component"), F.col("p").alias("next"))
        if labels is None:
            labels = hooks.select("id", F.col("p").alias("component"))
        else:
            labels = labels.join(to, "component", "left").select(
                "id", F.coalesce("next", "component").alias("component")
            )
        left = hooks.select(F.col("id").alias("a"), F.col("p").alias("x"))
        right = hooks.select(F.col("id").alias("b"), F.col("p").alias("y"))
        edges = stage(
            edges.join(left, "a").join(right, "b").filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(),
            "edges",
        )
        if edges.isEmpty():
            return labels
        labels = stage(labels, "labels")
