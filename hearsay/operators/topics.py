"""Topics over document vectors: reduce, cluster with outliers, describe and report.

Clusters come from the density of grid cells in a reduced space, so no pair of documents is ever
formed: copies and crowded spots only raise a cell's count. Topic -1 holds the outliers.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, HashingTF, IDF, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearsay.functions.lexicon import let
from hearsay.operators.skew import explode_words, lookup_join, numbered, top_n_per_group
from hearsay.session import cut_lineage

OUTLIER = -1
SEED = 50
BLOCK_CENTRES = 1_000
MAX_CENTRE_BYTES = 64 << 20
NAME_WORDS = 4
TASK_EDGES = 100_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null if one of them is zero."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a) * dot(b, b)), F.lit(0.0))


def _vector(df: DataFrame, column: str) -> Column:
    return F.col(column) if isinstance(df.schema[column].dataType, VectorUDT) else array_to_vector(F.col(column))


def _array(df: DataFrame, column: str) -> Column:
    return vector_to_array(F.col(column)) if isinstance(df.schema[column].dataType, VectorUDT) else F.col(column)


def _centre_rows(centres: DataFrame) -> int:
    """How many centres may be broadcast: a bound in bytes, by their length."""
    width = centres.agg(F.coalesce(F.max(F.size("centroid")), F.lit(1))).first()[0]
    return max(1, MAX_CENTRE_BYTES // (8 * max(1, width)))


def embed(df: DataFrame, tokens: str, out: str = "embedding", features: int = 1024) -> DataFrame:
    """TF-IDF vectors of unit length from hashed tokens (one pass to fit the document counts).

    The vectors are sparse and stay so: a text fills few of its cells.
    """
    counted = HashingTF(inputCol=tokens, outputCol="__tf", numFeatures=features).transform(df)
    weighted = IDF(inputCol="__tf", outputCol="__idf").fit(counted).transform(counted)
    scaled = Normalizer(inputCol="__idf", outputCol="__unit").transform(weighted)
    return scaled.withColumnRenamed("__unit", out).drop("__tf", "__idf")


def reduce_dimensions(df: DataFrame, vector: str, k: int, out: str = "reduced") -> DataFrame:
    """The ``k`` principal components: a linear stand-in for a neighbour embedding, not its equal."""
    vectors = df.withColumn("__v", _vector(df, vector))
    model = PCA(k=k, inputCol="__v", outputCol="__pca").fit(vectors)
    return model.transform(vectors).withColumn(out, vector_to_array("__pca")).drop("__v", "__pca")


def grid_cells(df: DataFrame, coords: str, width: float) -> DataFrame:
    """Add the grid cell of each point."""
    return df.withColumn("cell", F.transform(coords, lambda x: F.floor(x / F.lit(width))))


def _around(cell: Column, dims: int) -> Column:
    offsets = F.array(*[F.array(*[F.lit(o).cast("bigint") for o in step]) for step in product((-1, 0, 1), repeat=dims)])
    return F.transform(offsets, lambda o: F.zip_with(cell, o, lambda a, b: a + b))


def _flood(table: pa.Table) -> pa.Table:
    """Smallest cell reachable from each, for edges that fit one task."""
    sets: dict[tuple, tuple] = {}

    def find(x: tuple) -> tuple:
        while sets.setdefault(x, x) != x:
            sets[x] = x = sets[sets[x]]
        return x

    for a, b in zip(table["cell"].to_pylist(), table["near"].to_pylist(), strict=True):
        a, b = sorted((find(tuple(a)), find(tuple(b))))
        sets[b] = a
    cells = list(sets)
    kind = pa.list_(pa.int64())
    return pa.table([pa.array(map(list, cells), kind), pa.array([list(find(c)) for c in cells], kind)], ["cell", "label"])


def _components(dense: DataFrame, dims: int) -> DataFrame:
    """Smallest cell reachable from each dense cell over touching dense cells.

    Up to ``TASK_EDGES`` touching pairs are joined in one task. Beyond that labels spread to neighbours and then jump to their label's label, so chains close in few
    rounds; it ends when a round changes nothing. Each round is checkpointed.
    """
    touching = dense.select("cell", F.explode(_around(F.col("cell"), dims)).alias("near"))
    edges = cut_lineage(touching.join(dense.select(F.col("cell").alias("near")), "near", "left_semi"))
    if edges.count() <= TASK_EDGES:
        return edges.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(_flood, "cell array<bigint>, label array<bigint>")
    labels = dense.select("cell", F.col("cell").alias("label"))
    while True:
        spread = edges.join(labels.select(F.col("cell").alias("near"), "label"), "near").groupBy("cell").agg(
            F.min("label").alias("least"), F.max(F.when(F.col("near") == F.col("cell"), F.col("label"))).alias("was")
        )
        onward = labels.select(F.col("cell").alias("least"), F.col("label").alias("onward"))
        jumped = lookup_join(spread, onward, "least", "left", spread_by=["cell"])
        labels = cut_lineage(jumped.select("cell", F.least("least", "onward").alias("label"), "was"))
        if labels.filter(F.col("label") != F.col("was")).isEmpty():
            return labels.select("cell", "label")


def density_topics(
    df: DataFrame, key: str, coords: str, dims: int, width: float, min_cell: int = 5, min_topic: int = 10
) -> DataFrame:
    """(key, topic): touching dense cells form a topic, numbered by size from 0; the rest is -1.

    A cell is dense with ``min_cell`` points. Points of a sparse cell go to the topic of the
    densest dense cell it touches. Topics of fewer than ``min_topic`` points are outliers too.
    """
    points = grid_cells(df.select(key, coords), coords, width).select(key, "cell")
    counts = cut_lineage(points.groupBy("cell").agg(F.count(F.lit(1)).alias("points")))
    dense, sparse = counts.filter(F.col("points") >= min_cell), counts.filter(F.col("points") < min_cell)
    labelled = cut_lineage(_components(dense, dims).join(dense, "cell"))
    reach = labelled.select("label", F.col("points").alias("weight"), F.explode(_around(F.col("cell"), dims)).alias("cell"))
    # the densest neighbour wins, the smaller label on a tie
    best = F.min(F.struct((-F.col("weight")).alias("order"), F.col("label"))).alias("best")
    border = reach.join(sparse, "cell").groupBy("cell", "points").agg(best)
    cells = labelled.select("cell", "points", "label").unionByName(
        border.select("cell", "points", F.col("best.label").alias("label"))
    )
    sizes = cut_lineage(cells.groupBy("label").agg(F.sum("points").alias("size")).filter(F.col("size") >= min_topic))
    ranked = numbered(sizes, [F.desc("size"), F.col("label")], "topic")
    named = lookup_join(cells, ranked.select("label", F.col("topic").cast("int").alias("topic")), "label", "inner", spread_by=["cell"])
    topics = named.select("cell", "topic")
    found = lookup_join(points, topics, "cell", "left", spread_by=[key])
    return found.select(key, F.coalesce("topic", F.lit(OUTLIER)).alias("topic"))


def centroid_topics(df: DataFrame, key: str, vector: str, k: int, min_similarity: float = 0.0) -> DataFrame:
    """(key, topic) by k-means; documents too far from their centre are outliers."""
    vectors = df.select(key, vector, _vector(df, vector).alias("features"))
    model = KMeans(k=k, seed=SEED, featuresCol="features", predictionCol="topic").fit(vectors)
    assigned = model.transform(vectors).select(key, vector, "topic")
    centres = cut_lineage(centroids(assigned, "topic", vector))
    near = lookup_join(assigned, centres, "topic", "left", spread_by=[key], max_broadcast_rows=_centre_rows(centres))
    far = F.coalesce(cosine(_array(df, vector), F.col("centroid")), F.lit(0.0)) < min_similarity
    return near.select(key, F.when(far, F.lit(OUTLIER)).otherwise(F.col("topic")).alias("topic"))


def centroids(df: DataFrame, topic: str, vector: str) -> DataFrame:
    """Mean vector per topic; sums combine map-side."""
    means = df.groupBy(topic).agg(Summarizer.mean(_vector(df, vector)).alias("m"))
    return means.select(topic, vector_to_array("m").alias("centroid"))


def topic_probabilities(df: DataFrame, vector: str, centres: DataFrame, topic: str = "topic") -> DataFrame:
    """Add ``probabilities``: softmax of the cosine to every topic's centre, by topic number.

    Centres are held as constants in blocks, so that any number of them will do; with more than one
    block the rows are written after each.
    """
    def unit(v: Column) -> Column:
        """The vector at length 1; a zero vector stays as it is."""
        return let(F.sqrt(dot(v, v)), lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0))))

    ordered = cut_lineage(centres.select(F.col(topic).alias("topic"), unit(F.col("centroid")).alias("c")))
    blocks = max(1, -(-ordered.count() // BLOCK_CENTRES))
    if blocks > 1:
        ordered = cut_lineage(numbered(ordered, [F.col("topic")], "__place"))
    else:
        ordered = ordered.withColumn("__place", F.lit(0))
    rows = df.withColumn("__own", unit(_array(df, vector))).withColumn(
        "__powers", F.array().cast("array<struct<topic:int,power:double>>")
    )
    for block in range(blocks):
        held = ordered.filter(F.floor(F.col("__place") / BLOCK_CENTRES) == block)
        text = held.agg(F.to_json(F.array_sort(F.collect_list(F.struct("topic", "c"))))).head()[0]
        packed = F.from_json(F.lit(text), "array<struct<topic:int,c:array<double>>>")
        own = F.col("__own")
        more = F.transform(packed, lambda t: F.struct(t["topic"].alias("topic"), F.exp(dot(own, t["c"])).alias("power")))
        rows = rows.withColumn("__powers", F.concat("__powers", F.coalesce(more, F.array().cast("array<struct<topic:int,power:double>>"))))
        if blocks > 1:
            rows = cut_lineage(rows)

    def shares(of: Column) -> Column:
        total = F.aggregate(of, F.lit(0.0), lambda s, p: s + p["power"])
        return let(total, lambda s: F.transform(of, lambda p: F.struct(p["topic"], (p["power"] / s).alias("prob"))))

    return rows.withColumn("probabilities", let(F.col("__powers"), shares)).drop("__own", "__powers")


def topic_words(df: DataFrame, topic: str, tokens: str, n: int = 10) -> DataFrame:
    """Best ``n`` words per topic by class-based TF-IDF: tf x log(1 + A / f).

    A is the mean number of words per topic, f a word's count over all topics. Counting per topic
    and word comes first, so even the most common word reaches the join once per topic; the counts
    are kept, so the texts are read once for the three uses of them.
    """
    counts = cut_lineage(explode_words(df, [topic], tokens).groupBy(topic, "token").agg(F.count(F.lit(1)).alias("tf")))
    everywhere = counts.groupBy("token").agg(F.sum("tf").alias("f"))
    average = counts.agg((F.sum("tf") / F.count_distinct(topic)).alias("a")).scalar()
    weights = counts.join(everywhere, "token").withColumn("weight", F.col("tf") * F.log1p(average / F.col("f")))
    return top_n_per_group(weights, [topic], [F.desc("weight"), F.col("token")], n).select(
        topic, "token", "tf", "weight", F.col("rank_in_group").alias("rank")
    )


def topic_info(assigned: DataFrame, words: DataFrame, topic: str = "topic") -> DataFrame:
    """Topics with their size and a name made of number and first words; outliers sort first."""
    counts = assigned.groupBy(topic).agg(F.count(F.lit(1)).alias("n"))
    first = words.filter(F.col("rank") <= NAME_WORDS).groupBy(topic).agg(
        F.array_sort(F.collect_list(F.struct("rank", "token"))).alias("w")
    )
    name = F.concat_ws("_", F.col(topic).cast("string"), F.transform("w", lambda x: x["token"]))
    named = counts.join(first, topic, "left").select(topic, "n", name.alias("name"))
    return named.orderBy(F.col(topic) != OUTLIER, F.desc("n"), topic)


def relabel(df: DataFrame, labels: DataFrame, default: str, topic: str = "topic", out: str = "custom_name", **options) -> DataFrame:
    """Give topics their names from a (topic, label) table; unnamed ones keep ``default``."""
    names = labels.groupBy(topic).agg(F.max("label").alias("__label"))
    return lookup_join(df, names, topic, "left", **options).withColumn(out, F.coalesce("__label", default)).drop("__label")


def without_outliers(df: DataFrame, topic: str = "topic") -> DataFrame:
    return df.filter(F.col(topic) != OUTLIER)


def top_topics(info: DataFrame, n: int = 10, topic: str = "topic") -> DataFrame:
    """Largest topics, outliers left out."""
    return without_outliers(info, topic).orderBy(F.desc("n"), topic).limit(n)


def representative_docs(df: DataFrame, key: str, vector: str, n: int = 10, topic: str = "topic") -> DataFrame:
    """The ``n`` documents closest to their topic's centre: (topic, rank, key, similarity)."""
    rows = df.select(key, topic, vector)
    centres = cut_lineage(centroids(rows, topic, vector))
    near = lookup_join(rows, centres, topic, "inner", spread_by=[key], max_broadcast_rows=_centre_rows(centres))
    scored = near.select(key, topic, cosine(_array(rows, vector), F.col("centroid")).alias("similarity"))
    best = top_n_per_group(scored, [topic], [F.desc_nulls_last("similarity"), F.col(key)], n)
    return best.select(topic, F.col("rank_in_group").alias("rank"), key, "similarity")


def representative_lists(docs: DataFrame, key: str, topic: str = "topic") -> DataFrame:
    """One list of documents per topic, in order of rank."""
    packed = F.array_sort(F.collect_list(F.struct("rank", key)))
    return docs.groupBy(topic).agg(F.transform(packed, lambda d: d[key]).alias("representative_docs"))


def merge_topics(df: DataFrame, areas: DataFrame, topic: str = "topic", **options) -> DataFrame:
    """Condense topics to areas by a (topic, area) table; unlisted topics keep their number."""
    chosen = areas.groupBy(topic).agg(F.max("area").alias("area"))
    return lookup_join(df, chosen, topic, "left", **options).withColumn("area", F.coalesce("area", topic))


def nearest_areas(df: DataFrame, vector: str, k: int, topic: str = "topic") -> DataFrame:
    """(topic, area): topics grouped into ``k`` areas by their centres, weighted by size."""
    real = without_outliers(df, topic)
    sizes = real.groupBy(topic).agg(F.count(F.lit(1)).cast("double").alias("size"))
    centres = centroids(real, topic, vector).join(sizes, topic)
    vectors = centres.select(topic, "size", array_to_vector("centroid").alias("features"))
    model = KMeans(k=k, seed=SEED, weightCol="size", predictionCol="area").fit(vectors)
    return model.transform(vectors).select(topic, "area")


def topic_trend(df: DataFrame, ts: Column, value: str, score: str, topic: str = "topic", by: Sequence[str] = ()) -> DataFrame:
    """Per topic and year: posts, mean negativity, mean score."""
    yearly = df.withColumn("year", F.year(ts)).filter(F.col("year").isNotNull())
    return yearly.groupBy(topic, *by, "year").agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("avg_negativity"), F.avg(score).alias("avg_score")
    )
