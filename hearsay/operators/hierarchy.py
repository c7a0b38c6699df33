"""Clusters by the density of neighbours, at any density: spanning tree, merge tree, condensed tree, most stable clusters.

All steps are joins and groupings of narrow rows. What a task may hold is bounded by ``TASK_EDGES``: larger graphs are
contracted, and larger trees cut by weight, until their parts fit; the result is the same wherever that happens.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearsay.operators.neighbours import NEIGHBOURS, neighbours
from hearsay.operators.skew import lookup_join, numbered
from hearsay.session import cut_lineage

TASK_EDGES = 200_000
LEAST_DISTANCE = 1e-9
OUTLIER = -1


def follow(pointers: DataFrame) -> DataFrame:
    """``(id, to)`` with every pointer moved on to the end of its chain; ends point at themselves.

    Each round lets pointers skip to where their target points, so a chain of any length takes as many rounds as its length has
    binary digits. Targets are looked up by ``lookup_join``, since very many may share one.
    """
    pointers = cut_lineage(pointers.select("id", "to"))
    while True:
        onward = pointers.select(F.col("id").alias("to"), F.col("to").alias("onward"))
        moved = cut_lineage(lookup_join(pointers, onward, "to", "left", spread_by=["id"]).select(
            "id", F.coalesce("onward", "to").alias("to"), (F.col("onward") != F.col("to")).alias("moved")
        ))
        pointers = moved.select("id", "to")
        if moved.filter("moved").isEmpty():
            return pointers


def mutual_edges(near: DataFrame) -> DataFrame:
    """``(a, b, w)`` with a < b: neighbours by mutual reachability, the largest of their distance and both core distances.

    A row's core distance is that of the last neighbour of ``near(id, other, distance)`` it has.
    """
    cores = cut_lineage(near.groupBy("id").agg(F.max("distance").alias("core")))
    pairs = near.groupBy(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).agg(F.min("distance").alias("d"))
    a, b = cores.select(F.col("id").alias("a"), F.col("core").alias("ca")), cores.select(F.col("id").alias("b"), F.col("core").alias("cb"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", F.greatest("d", "ca", "cb").alias("w"))


class _Sets:
    """Disjoint sets of whatever ids occur."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while up.setdefault(root, root) != root:
            root = up[root]
        while up[x] != root:
            up[x], x = root, up[x]
        return root


def _kruskal(table: pa.Table) -> pa.Table:
    """The edges of a graph that is small enough for one task which its least spanning forest has."""
    order = np.lexsort([table[c].to_numpy() for c in ("b", "a", "w")])
    left, right = (table[c].to_numpy()[order].tolist() for c in ("ca", "cb"))
    sets, kept = _Sets(), []
    for i, (x, y) in enumerate(zip(left, right, strict=True)):
        x, y = sets.find(x), sets.find(y)
        if x != y:
            sets.up[y] = x
            kept.append(order[i])
    return table.select(["a", "b", "w"]).take(pa.array(kept, pa.int64()))


def spanning_forest(edges: DataFrame, task_edges: int | None = None) -> DataFrame:
    """The least spanning forest of ``edges(a, b, w)``, a < b: edges in order of (w, a, b), so there is just one.

    Rounds after Boruvka: every component takes its least edge to another, components so joined become one, and of the
    edges between two of them the least stays. Least edges combine before the shuffle, and where a component's edges are many, its new name
    is looked up by ``lookup_join``. At least half of the components go in a round. Once no more than ``task_edges`` are left, one task ends it.
    """
    task_edges = TASK_EDGES if task_edges is None else task_edges
    edges = cut_lineage(edges.select("a", "b", "w", F.col("a").alias("ca"), F.col("b").alias("cb")))
    forest = None
    while True:
        left = edges.count()
        if left <= task_edges:
            last = edges.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(_kruskal, "a long, b long, w double")
            return last if forest is None else forest.union(last)
        edge = F.struct("w", "a", "b")
        ends = edges.select(F.col("ca").alias("id"), F.col("cb").alias("to"), edge.alias("edge")).union(
            edges.select(F.col("cb").alias("id"), F.col("ca").alias("to"), edge.alias("edge"))
        )
        least = cut_lineage(ends.groupBy("id").agg(F.min(F.struct("edge", "to")).alias("m")).select("id", "m.edge", "m.to"))
        taken = least.select("edge.a", "edge.b", "edge.w").distinct()
        forest = cut_lineage(taken if forest is None else forest.union(taken))
        # of two that chose the same edge the smaller is the end of the chain
        back = least.select(F.col("id").alias("to"), F.col("to").alias("back"))
        hooks = lookup_join(least.select("id", "to"), back, "to", "left", spread_by=["id"])
        ends_at = F.when((F.col("back") == F.col("id")) & (F.col("id") < F.col("to")), F.col("id")).otherwise(F.col("to"))
        names = follow(hooks.select("id", ends_at.alias("to")))
        for side in ("ca", "cb"):
            edges = lookup_join(edges, names.select(F.col("id").alias(side), F.col("to").alias("n")), side, "left").select(
                "a", "b", "w", *[F.coalesce("n", side).alias(side) if c == side else F.col(c) for c in ("ca", "cb")]
            )
        low, high = F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb")
        edges = edges.filter("ca <> cb").groupBy(low, high).agg(F.min(F.struct("w", "a", "b")).alias("m"))
        edges = cut_lineage(edges.select("m.a", "m.b", "m.w", "ca", "cb"))


NODE, CHILD, FALL, REST = range(4)
PART = "kind int, id long, ref long, amount long, w double"


def _merge(min_size: int):
    """Merges of one part of the tree, lightest first.

    A part's ends are points or, by the node at their top, lighter parts. NODE rows tell of a merge that gives ``min_size`` points or more to which
    cluster it belongs and how many points leave the cluster there; CHILD rows which clusters a split makes; FALL rows which ends
    fall out of a cluster, and where; REST rows which small set an end is in when the part is done.
    """

    def merge(table: pa.Table) -> pa.Table:
        order = np.argsort(table["node"].to_numpy())
        columns = [table[c].to_numpy()[order].tolist() for c in ("node", "a", "b", "w", "size_a", "size_b")]
        sets, size, cluster, members, top = _Sets(), {}, {}, {}, {}
        out: list[tuple] = []

        def come(v: int, n: int) -> int:
            root = sets.find(v)
            if root not in size:
                size[root], top[root] = n, v
                cluster[root], members[root] = (v, None) if n >= min_size else (None, [v])
            return root

        for node, a, b, w, size_a, size_b in zip(*columns, strict=True):
            a, b = come(a, size_a), come(b, size_b)
            if size[a] < size[b]:
                a, b = b, a
            total = size[a] + size[b]
            if cluster[b] is not None:  # both are clusters: a split, seen from below
                out += [(CHILD, cluster[a], node, size[a], w), (CHILD, cluster[b], node, size[b], w), (NODE, node, node, total, w)]
                cluster[a] = node
            elif cluster[a] is not None:
                out.append((NODE, node, cluster[a], size[b], w))
                out += [(FALL, v, cluster[a], 1, w) for v in members.pop(b)]
            elif total >= min_size:
                out.append((NODE, node, node, total, w))
                out += [(FALL, v, node, 1, w) for v in members.pop(a) + members.pop(b)]
                cluster[a] = node
            else:
                members[a] += members.pop(b)
            sets.up[b] = a
            size[a], top[a] = total, node
        for root, own in members.items():
            if own is not None and cluster[root] is None and sets.find(root) == root:
                out += [(REST, v, top[root], 1, 0.0) for v in own if v != top[root]]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
        columns = zip(*out, strict=True) if out else [[]] * 5
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["kind", "id", "ref", "amount", "w"])

    return merge


def connected(edges: DataFrame) -> DataFrame:
    """``(id, to)``: the least end that each end of ``edges(a, b)`` reaches. As for a spanning forest, rounds halve the components."""
    forest = edges.select(F.least("a", "b").alias("ca"), F.greatest("a", "b").alias("cb")).filter("ca <> cb").distinct()
    names = None
    while True:
        forest = cut_lineage(forest)
        both = forest.select(F.col("ca").alias("id"), F.col("cb").alias("to")).union(forest.select(F.col("cb").alias("id"), F.col("ca").alias("to")))
        hooks = follow(both.groupBy("id").agg(F.min("to").alias("m")).select("id", F.least("id", "m").alias("to")))
        if names is None:
            names = hooks
        else:
            onward = hooks.select(F.col("id").alias("to"), F.col("to").alias("onward"))
            names = cut_lineage(lookup_join(names, onward, "to", "left", spread_by=["id"]).select("id", F.coalesce("onward", "to").alias("to")))
        for side in ("ca", "cb"):
            named = hooks.select(F.col("id").alias(side), F.col("to").alias("n"))
            forest = lookup_join(forest, named, side, "left").select(
                *[F.coalesce("n", side).alias(side) if c == side else F.col(c) for c in ("ca", "cb")]
            )
        forest = cut_lineage(forest.select(F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb")).filter("ca <> cb").distinct())
        if forest.isEmpty():
            return names


def merge_parts(forest: DataFrame, points: int, min_size: int, task_edges: int | None = None) -> tuple[DataFrame, int]:
    """Rows of ``PART`` for the merges of a spanning forest over points 0 to ``points`` - 1, and how many cuts it took.

    Edges are numbered in order of (w, a, b); the merge by edge r is node ``points`` + r. A part of more than ``task_edges`` edges is cut at its middle
    number: the lighter half falls into components, each a part of its own, and in the heavier half a component stands as one end, by the
    number of its last merge. All parts are cut in the same rounds, so these are as many as the number of edges halves.
    """
    task_edges = TASK_EDGES if task_edges is None else task_edges
    ranked = numbered(forest, [F.col("w"), F.col("a"), F.col("b")], "rank")
    one = F.lit(1).cast("long")
    edges = cut_lineage(ranked.select(
        F.lit(-1).cast("long").alias("part"), (F.col("rank") + points).alias("node"), "a", "b", "w", one.alias("size_a"), one.alias("size_b")
    ))
    cuts = 0
    while True:
        sizes = edges.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("node", 0.5).alias("middle"))
        large = cut_lineage(sizes.filter(F.col("n") > task_edges))
        if large.isEmpty():
            break
        cuts += 1
        marked = cut_lineage(lookup_join(edges, large.select("part", "middle"), "part", "left", spread_by=["node"]))
        light = marked.filter("node <= middle")
        names = connected(light.select("a", "b"))
        ends = light.select(F.col("a").alias("id"), F.col("size_a").alias("size")).union(light.select("b", "size_b")).distinct()
        tops = lookup_join(light.select(F.col("a").alias("id"), "node"), names, "id", "inner").groupBy("to").agg(F.max("node").alias("top"))
        whole = lookup_join(ends, names, "id", "inner").groupBy("to").agg(F.sum("size").alias("size")).join(tops, "to")
        held = cut_lineage(lookup_join(names, whole, "to", "inner", spread_by=["id"]).select("id", "top", F.col("size").alias("points")))
        lighter = lookup_join(light, held.select(F.col("id").alias("a"), "top"), "a", "inner").withColumn("part", F.col("top"))
        rest = marked.filter("middle is null or node > middle").withColumn("cut", F.col("middle").isNotNull())
        for side, size in (("a", "size_a"), ("b", "size_b")):
            named = held.select(F.col("id").alias(side), "top", "points")
            joined = lookup_join(rest, named, side, "left")
            in_cut = F.col("cut") & F.col("top").isNotNull()
            rest = joined.withColumn(side, F.when(in_cut, F.col("top")).otherwise(F.col(side))).withColumn(
                size, F.when(in_cut, F.col("points")).otherwise(F.col(size))
            ).drop("top", "points")
        columns = ["part", "node", "a", "b", "w", "size_a", "size_b"]
        edges = cut_lineage(lighter.select(*columns).union(rest.select(*columns)))
    # parts have no ends in common, so a task may take several at once
    buckets = max(1, edges.count() // max(1, task_edges))
    parts = edges.groupBy(F.pmod(F.xxhash64("part"), F.lit(buckets))).applyInArrow(_merge(min_size), PART)
    return cut_lineage(parts), cuts


def condensed(parts: DataFrame, cuts: int, points: int) -> tuple[DataFrame, DataFrame]:
    """``(cluster, parent, size, stability)`` and ``(id, cluster)``: clusters, and the cluster that each point falls out of.

    A cluster lasts from the split (or the whole) it comes from to the split that ends it, while smaller sets fall out of it. Its stability is
    the sum over its points of 1 / distance at which they leave, less that at which it came.
    """
    nodes = parts.filter(F.col("kind") == NODE)
    of = nodes.select("id", F.col("ref").alias("to"))
    falls = parts.filter(F.col("kind") == FALL).select("id", F.col("ref").alias("cluster"))
    children = parts.filter(F.col("kind") == CHILD).select(F.col("id").alias("cluster"), F.col("ref").alias("parent"), "w")
    if cuts:  # a cluster that goes on above a cut bears the number of a node below it
        of = follow(of)
        above = follow(parts.filter(F.col("kind") == REST).select("id", F.col("ref").alias("to")).union(
            falls.select(F.col("id"), F.col("id").alias("to"))
        ))
        falls = lookup_join(above, falls.withColumnRenamed("id", "to"), "to", "inner", spread_by=["id"]).filter(F.col("id") < points).select("id", "cluster")
        named = of.select(F.col("id").alias("cluster"), F.col("to").alias("own"))
        falls, children = (
            lookup_join(x, named, "cluster", "inner").withColumn("cluster", F.col("own")).drop("own") for x in (falls, children)
        )
    inverse = lambda w: 1 / F.greatest(w, F.lit(LEAST_DISTANCE))
    leave = nodes.join(of, "id").groupBy(F.col("to").alias("cluster")).agg(
        F.sum(F.col("amount") * inverse(F.col("w"))).alias("left_at"), F.sum("amount").alias("size")
    )
    clusters = leave.join(children, "cluster", "left").select(
        "cluster", "parent", "size",
        (F.col("left_at") - F.col("size") * F.coalesce(inverse(F.col("w")), F.lit(0.0))).alias("stability"),
    )
    return cut_lineage(clusters), falls


def _mass(clusters: pa.Table) -> pa.Table:
    """The clusters of a tree that fits one task which are at least as stable as the best choice below them.

    A merge has a greater number than those below it, so numbers go from the leaves to the root.
    """
    order = np.argsort(clusters["cluster"].to_numpy())
    below: dict[int, float] = {}
    kept = []
    ids, parents, values = (clusters[c].to_pylist() for c in ("cluster", "parent", "stability"))
    for i in order.tolist():
        under = below.pop(ids[i], None)
        if under is None or values[i] >= under:
            kept.append(ids[i])
        if parents[i] is not None:
            below[parents[i]] = below.get(parents[i], 0.0) + max(values[i], under or 0.0)
    return pa.table([pa.array(kept, pa.int64())], ["cluster"])


def stable_clusters(clusters: DataFrame, task_clusters: int = TASK_EDGES) -> DataFrame:
    """The clusters at least as stable as the best choice of clusters below them; several on one way to the root may be.

    A tree of clusters too large for one task is worked off from its leaves in rounds, one for each split on the longest way down.
    """
    if clusters.count() <= task_clusters:
        return clusters.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(_mass, "cluster long")
    waiting = cut_lineage(clusters.withColumn("under", F.lit(None).cast("double")))
    chosen = None
    while True:
        held = waiting.select(F.col("parent").alias("cluster")).filter("cluster is not null").distinct()
        ready = waiting.join(held, "cluster", "left_anti")
        good = F.col("under").isNull() | (F.col("stability") >= F.col("under"))
        best = F.greatest(F.col("stability"), F.coalesce("under", F.lit(0.0)))
        ready = cut_lineage(ready.select("cluster", "parent", good.alias("good"), best.alias("best")))
        now = ready.filter("good").select("cluster")
        chosen = cut_lineage(now if chosen is None else chosen.union(now))
        up = ready.groupBy(F.col("parent").alias("cluster")).agg(F.sum("best").alias("more"))
        waiting = cut_lineage(
            waiting.join(ready.select("cluster"), "cluster", "left_anti").join(up, "cluster", "left").select(
                "cluster", "parent", "size", "stability",
                F.when(F.col("more").isNull(), F.col("under")).otherwise(F.coalesce("under", F.lit(0.0)) + F.col("more")).alias("under"),
            )
        )
        if waiting.isEmpty():
            return chosen


def highest(clusters: DataFrame, chosen: DataFrame) -> DataFrame:
    """``(cluster, label)``: of the chosen clusters on the way from each cluster to the root the one nearest the root."""
    marked = clusters.join(chosen.withColumn("own", F.col("cluster")), "cluster", "left")
    ways = cut_lineage(marked.select("cluster", F.col("parent").alias("to"), F.col("own").alias("label")))
    while not ways.filter("to is not null").isEmpty():
        onward = ways.select(F.col("cluster").alias("to"), F.col("to").alias("next"), F.col("label").alias("above"))
        joined = lookup_join(ways, onward, "to", "left", spread_by=["cluster"])
        ways = cut_lineage(joined.select("cluster", F.col("next").alias("to"), F.coalesce("above", "label").alias("label")))
    return ways.filter("label is not null").select("cluster", "label")


def neighbour_topics(
    df: DataFrame, key: str, vector: str, min_topic: int = 10, k: int = NEIGHBOURS, allow_single: bool = False, **options
) -> DataFrame:
    """``(key, topic)``: the most stable clusters of a neighbour graph, numbered by size from 0 (ties by their lightest merge); the rest is -1.

    Neighbours of mutual reachability (see ``neighbours``, which takes ``options``) span a forest; heavier edges merge what lighter ones made. Sets of at
    least ``min_topic`` points that merge with another such set, or with none, are clusters; those that outlast the clusters below them, by
    stability, are topics. So topics may be of any shape, density and number of dimensions. A cluster of all rows counts only with ``allow_single``.

    Keys are unique; rows without a key are left out. Vectors (arrays) of the commonest length with finite entries take part, other rows are outliers;
    copies are near at distance 0, which counts as ``LEAST_DISTANCE``. No rows give no rows.
    """
    if min_topic < 2:
        raise ValueError("a topic has at least two rows")
    rows = df.filter(F.col(key).isNotNull()).select(key, F.col(vector).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    whole = rows.filter(F.col("v").isNotNull() & (F.size("v") > 0) & ~bad)
    common = whole.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    none = rows.select(key, F.lit(OUTLIER).alias("topic"))
    if common is None:
        return none
    whole = cut_lineage(numbered(whole.filter(F.size("v") == common["d"]), [F.col(key)], "id"))
    near = cut_lineage(neighbours(whole.select("id", "v"), k, **options))
    if near.isEmpty():
        return none
    parts, cuts = merge_parts(spanning_forest(mutual_edges(near)), common["n"], min_topic)
    clusters, falls = condensed(parts, cuts, common["n"])
    roots = clusters.filter("parent is null").count()
    eligible = clusters if allow_single or roots > 1 else clusters.filter("parent is not null")
    labels = highest(clusters, stable_clusters(clusters).join(eligible.select("cluster"), "cluster", "left_semi"))
    found = cut_lineage(lookup_join(falls, labels, "cluster", "inner", spread_by=["id"]).select("id", "label"))
    sizes = found.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    ranked = numbered(sizes, [F.desc("size"), F.col("label")], "topic").select("label", F.col("topic").cast("int").alias("topic"))
    named = lookup_join(found, ranked, "label", "inner", spread_by=["id"]).select("id", "topic")
    keyed = whole.select("id", key).join(named, "id").select(key, "topic")
    return rows.select(key).join(keyed, key, "left").select(key, F.coalesce("topic", F.lit(OUTLIER)).alias("topic"))
