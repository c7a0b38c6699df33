"""Clusters, topic words, probabilities and topic reports."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from checks import views as v
from checks.registry import check
from hearsay.functions.text import clean_tokens
from hearsay.operators import areas, hierarchy, layout, lloyd, neighbours, topics, wordvectors
from hearsay.operators.skew import numbered
from hearsay.plans import complaints
from hearsay.session import cut_lineage

from checks.text import tokens_sql

NAMES = ", ".join(f"({i}, 'area {i % 3}')" for i in range(0, 10, 2))


def _rd(expr: str, name: str, digits: int = 9) -> str:
    return f"round({expr}, {digits}) + 0e0 as {name}"


def _vectors(spark, sf):
    return v.table(spark, sf, "embeddings").select("vec_id", "embedding", F.col("label").alias("topic"))


def _topic_docs(spark, sf):
    """All documents; those without a vector are outliers."""
    docs = v.table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    topic = F.coalesce("topic", F.lit(topics.OUTLIER)).alias("topic")
    named = docs.join(_vectors(spark, sf).drop("embedding"), "vec_id", "left")
    return named.select("vec_id", topic, clean_tokens("text").alias("tokens"))


def _labelled(spark, sf):
    """Documents with a vector, under its label."""
    return topics.without_outliers(_topic_docs(spark, sf))


_DOCS = f"docs as (select doc_id as vec_id, coalesce(label, -1) as topic, {tokens_sql('text')} as tokens from documents left join embeddings on doc_id = vec_id)"
_TF = (
    f"{_DOCS}, w as (select topic, unnest(tokens) as token from docs), c as (select topic, token, count(*) as tf from w group by 1, 2), "
    "f as (select token, sum(tf) as f from c group by 1), a as (select sum(tf) / count(distinct topic) as a from c), "
    "k as (select topic, c.token, tf, tf * ln(1 + a / f) as weight from c join f using (token), a), "
    "words as (select *, row_number() over (partition by topic order by weight desc, token) as rank from k qualify rank <= 10)"
)


@check("k6_topic_words", f"with {_TF} select topic, token, tf, {_rd('weight', 'weight', 6)}, cast(rank as int) as rank from words")
def k6(spark, sf):
    words = topics.topic_words(_topic_docs(spark, sf), "topic", "tokens")
    return words.select("topic", "token", "tf", v.r("weight", "weight", 6), "rank")


_INFO = (
    f"{_TF}, named as (select topic, string_agg(token, '_' order by rank) as w from words where rank <= 4 group by 1), "
    "info as (select d.topic, count(*) as n, any_value(d.topic || '_' || w) as name from docs d join named using (topic) group by 1)"
)


@check("k7_topic_info", f"with {_INFO} select * from info")
def k7(spark, sf):
    docs = _topic_docs(spark, sf)
    return topics.topic_info(docs, topics.topic_words(docs, "topic", "tokens"))


_NAMED = f"names(topic, label) as (values {NAMES})"


@check(
    "k8_relabel",
    f"with {_INFO}, {_NAMED} select topic, n, name, coalesce(label, name) as custom_name from info left join names using (topic)",
)
def k8(spark, sf):
    names = spark.sql(f"select * from values {NAMES} as t(topic, label)")
    return topics.relabel(k7(spark, sf), names, "name")


def _label_lookup(max_broadcast_rows: int):
    def query(spark, sf):
        names = spark.sql(f"select * from values {NAMES} as t(topic, label)")
        rows = _vectors(spark, sf).drop("embedding").withColumn("own", F.concat(F.lit("topic "), F.col("topic")))
        named = topics.relabel(rows, names, "own", spread_by=["vec_id"], max_broadcast_rows=max_broadcast_rows)
        return named.select("vec_id", "topic", "custom_name")

    return query


_J9 = f"with {_NAMED} select vec_id, e.label as topic, coalesce(n.label, 'topic ' || e.label) as custom_name from embeddings e left join names n on n.topic = e.label"
check("j9_label_lookup", _J9)(_label_lookup(100_000))
check("j9_label_lookup_salted", _J9)(_label_lookup(0))


@check("k10_top_topics", f"with {_INFO} select topic, n, name from info where topic not in (2, -1) order by n desc, topic limit 5")
def k10(spark, sf):
    info = k7(spark, sf).filter(F.col("topic") != 2)
    return topics.top_topics(info, 5)


@check("f4_without_outliers", "select vec_id, label - 1 as topic from embeddings where label - 1 <> -1")
def f4(spark, sf):
    shifted = _vectors(spark, sf).select("vec_id", (F.col("topic") - 1).alias("topic"))
    return topics.without_outliers(shifted)


_D = "cast(x as double)"
_CENTRES = (
    "e as (select vec_id, label as topic, unnest(embedding) as x, unnest(range(len(embedding))) as i from embeddings), "
    f"m as (select topic, i, avg({_D}) as c from e group by 1, 2), cn as (select topic, sqrt(sum(c * c)) as cn from m group by 1), "
    f"dn as (select vec_id, sqrt(sum({_D} * {_D})) as dn from e group by 1)"
)


@check(
    "k5_topic_probabilities",
    f"with {_CENTRES}, s as (select vec_id, m.topic, exp(sum({_D} * c) / (any_value(dn) * any_value(cn))) as p from e join m using (i) "
    "join cn on cn.topic = m.topic join dn using (vec_id) group by 1, 2) "
    f"select vec_id, topic, {_rd('p / sum(p) over (partition by vec_id)', 'prob', 7)} from s",
)
def k5(spark, sf):
    vectors = _vectors(spark, sf)
    probs = topics.topic_probabilities(vectors, "embedding", topics.centroids(vectors, "topic", "embedding"))
    return probs.select("vec_id", F.explode("probabilities").alias("p")).select("vec_id", "p.topic", v.r("p.prob", "prob", 7))


@check(
    "k9_representative_docs",
    f"with {_CENTRES}, s as (select vec_id, m.topic, sum({_D} * c) / (any_value(dn) * any_value(cn)) as similarity from e "
    "join m on m.i = e.i and m.topic = e.topic join cn on cn.topic = m.topic join dn using (vec_id) group by 1, 2) "
    f"select topic, cast(row_number() over (partition by topic order by similarity desc, vec_id) as int) as rank, vec_id, {_rd('similarity', 'similarity', 7)} "
    "from s qualify rank <= 10",
)
def k9(spark, sf):
    docs = topics.representative_docs(_vectors(spark, sf), "vec_id", "embedding")
    return docs.select("topic", "rank", "vec_id", v.r("similarity", "similarity", 7))


@check("k11_merge_topics", f"with areas(topic, area) as (values (0, 100), (1, 100), (2, 101), (3, 102)) select coalesce(area, label) as area, count(*) as n from embeddings left join areas on topic = label group by 1")
def k11(spark, sf):
    chosen = spark.sql("select * from values (0, 100), (1, 100), (2, 101), (3, 102) as t(topic, area)")
    merged = topics.merge_topics(_vectors(spark, sf), chosen)
    return merged.groupBy("area").agg(F.count(F.lit(1)).alias("n"))


@check("k11_nearest_areas")
def k11_nearest(spark, sf):
    return topics.nearest_areas(_vectors(spark, sf), "embedding", 5)


@check(
    "k12_topic_trend",
    f"with {v.PROBS}, t as (select coalesce(label, -1) as topic, cast(year(make_timestamp(created_utc*1000000)) as int) as year, neg_effective, score "
    "from probs left join embeddings on cast(vec_id as varchar) = post_id) "
    f"select topic, year, count(*) as n, {_rd('avg(neg_effective)', 'avg_negativity')}, {_rd('avg(score)', 'avg_score')} from t group by 1, 2",
)
def k12(spark, sf):
    topic = _vectors(spark, sf).select(F.col("vec_id").cast("string").alias("post_id"), "topic")
    posts = v.probs(spark, sf).join(topic, "post_id", "left").withColumn("topic", F.coalesce("topic", F.lit(topics.OUTLIER)))
    trend = topics.topic_trend(posts, v.stamp(), "neg_effective", "score")
    return trend.select("topic", "year", "n", v.r("avg_negativity", "avg_negativity"), v.r("avg_score", "avg_score"))


# three coordinates, each the sum of every third element, in whole millionths
WIDTH, MIN_CELL, MIN_TOPIC = 400_000.0, 6, 10


def _coords(spark, sf):
    part = "aggregate(transform(embedding, (e, i) -> if(i % 3 = {j}, cast(round(cast(e as double) * 1000000) as bigint), 0L)), 0L, (s, x) -> s + x)"
    coords = "array(" + ", ".join(f"cast({part.format(j=j)} as double)" for j in range(3)) + ")"
    return v.table(spark, sf, "embeddings").select("vec_id", F.expr(coords).alias("coords"))


def _cell_sql(j: int) -> str:
    part = f"list_sum(list_transform(embedding, lambda e, i: case when (i - 1) % 3 = {j} then cast(round(cast(e as double) * 1000000) as bigint) else 0 end))"
    return f"cast(floor({part} / {WIDTH}) as bigint)"


_TOUCH = " and ".join(f"abs(a.c{j} - b.c{j}) <= 1" for j in range(3))


@check(
    "k3_density_topics",
    f"with recursive pts as (select vec_id, {', '.join(f'{_cell_sql(j)} as c{j}' for j in range(3))} from embeddings), "
    "cells as (select c0, c1, c2, count(*) as n, [c0, c1, c2] as cell from pts group by c0, c1, c2), "
    f"dense as (select * from cells where n >= {MIN_CELL}), "
    f"edges as (select a.cell as a, b.cell as b from dense a join dense b on {_TOUCH}), "
    "reach as (select cell as a, cell as b from dense union select r.a, e.b from reach r join edges e on e.a = r.b), "
    "lab as (select a as cell, min(b) as label from reach group by 1), "
    "ld as (select d.*, label from dense d join lab using (cell)), "
    f"brd as (select a.cell, a.n, label, row_number() over (partition by a.cell order by b.n desc, label) as rn from cells a join ld b on {_TOUCH} where a.n < {MIN_CELL}), "
    "al as (select cell, n, label from ld union all select cell, n, label from brd where rn = 1), "
    f"sz as (select label, row_number() over (order by sum(n) desc, label) - 1 as topic from al group by label having sum(n) >= {MIN_TOPIC}) "
    "select vec_id, cast(coalesce(topic, -1) as int) as topic from pts left join al on al.cell = [pts.c0, pts.c1, pts.c2] left join sz on sz.label = al.label",
)
def k3(spark, sf):
    return topics.density_topics(_coords(spark, sf), "vec_id", "coords", 3, WIDTH, MIN_CELL, MIN_TOPIC)


# vectors in whole millionths, so that distances are exact in both engines
NEAR, MIN_SIZE = 15, 10


def _whole(spark, sf):
    vector = F.transform("embedding", lambda x: F.round(x.cast("double") * 1000000.0))
    return cut_lineage(v.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), vector.alias("v")))


_NEAR = (
    "whole as (select vec_id, list_transform(embedding, lambda x: round(cast(x as double) * 1000000e0)) as v from embeddings), "
    "near as (select a.vec_id as id, b.vec_id as other, list_distance(a.v, b.v) as distance from whole a join whole b on a.vec_id <> b.vec_id "
    f"qualify row_number() over (partition by a.vec_id order by distance, b.vec_id) <= {NEAR})"
)
# edges by weight, one after the other, over a list of each row's component
_TREE = (
    f"{_NEAR}, core as (select id, max(distance) as core from near group by 1), "
    "pairs as (select least(id, other) as a, greatest(id, other) as b, min(distance) as d from near group by 1, 2), "
    "place as (select vec_id, row_number() over (order by vec_id) as at, count(*) over () as n from whole), "
    "edges as (select a, b, greatest(d, x.core, y.core) as w, p.at as pa, q.at as pb, row_number() over (order by w, a, b) as step from pairs "
    "join core x on x.id = a join core y on y.id = b join place p on p.vec_id = a join place q on q.vec_id = b), "
    "kruskal as (select 0::bigint as step, range(1, (select any_value(n) from place) + 1) as label, false as joins, 0::bigint as low, 0::bigint as high "
    "union all select e.step, case when k.label[pa] = k.label[pb] then k.label else list_transform(k.label, lambda x: case when x = k.label[pb] then k.label[pa] else x end) end, "
    "k.label[pa] <> k.label[pb], len(list_filter(k.label, lambda x: x = k.label[pa])), len(list_filter(k.label, lambda x: x = k.label[pb])) "
    "from kruskal k join edges e on e.step = k.step + 1)"
)


@check("k3_neighbours", f"with {_NEAR} select id, other, distance, cast(row_number() over (partition by id order by distance, other) as int) as rank from near")
def k3_neighbours(spark, sf):
    """The very nearest while all rows fit a block, about the nearest beyond that."""
    return neighbours.neighbours(_whole(spark, sf), NEAR)


@check(
    "k3_merge_tree",
    f"with recursive {_TREE} select a, b, w, row_number() over (order by e.step) - 1 as number, cast(case when least(low, high) >= {MIN_SIZE} "
    f"or greatest(low, high) < {MIN_SIZE} then low + high else least(low, high) end as bigint) as leaving "
    f"from kruskal k join edges e using (step) where joins qualify low + high >= {MIN_SIZE}",
)
def k3_merge_tree(spark, sf):
    """Merges of the least spanning tree that make a cluster, go on with one or split one, and how many rows leave the cluster there."""
    rows = numbered(_whole(spark, sf), [F.col("id")], "place")
    near = cut_lineage(neighbours.neighbours(rows.select(F.col("place").alias("id"), "v"), NEAR))
    forest = cut_lineage(hierarchy.spanning_forest(hierarchy.mutual_edges(near)))
    n = rows.count()
    parts, _ = hierarchy.merge_parts(forest, n, MIN_SIZE)
    merges = parts.filter(F.col("kind") == hierarchy.NODE).select((F.col("id") - n).alias("number"), F.col("amount").alias("leaving"))
    ranked = numbered(forest, [F.col("w"), F.col("a"), F.col("b")], "number").join(merges, "number")
    keys = cut_lineage(rows.select("id", "place"))
    for side in ("a", "b"):
        ranked = ranked.join(keys.select(F.col("place").alias(side), F.col("id").alias(f"{side}_id")), side)
    return ranked.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), "w", "number", "leaving")


@check("k3_neighbour_topics")
def k3_neighbour_topics(spark, sf):
    return hierarchy.neighbour_topics(_vectors(spark, sf).drop("topic"), "vec_id", "embedding", MIN_SIZE, NEAR)


WORD_WINDOW, WORD_COUNT, WORD_DIMS = 5, 5, 20


def _tokens(spark, sf):
    return v.table(spark, sf, "documents").select("doc_id", clean_tokens("text").alias("tokens"))


_PMI = (
    f"d as (select doc_id, {tokens_sql('text')} as tokens from documents), "
    f"known as (select token from (select unnest(tokens) as token from d) group by 1 having count(*) >= {WORD_COUNT}), "
    "firsts as (select tokens, unnest(tokens) as a, unnest(range(1, len(tokens) + 1)) as i from d), "
    f"ahead as (select a, unnest(list_slice(tokens, i + 1, i + {WORD_WINDOW})) as b from firsts), "
    "one as (select a, b, count(*) as n from ahead semi join known x on x.token = a semi join known y on y.token = b group by 1, 2), "
    "pair as (select a, b, sum(n) as n from (select a, b, n from one union all select b, a, n from one) group by 1, 2), "
    "side as (select a as token, sum(n) as n from pair group by 1), total as (select sum(n ** 75e-2) as s from side), "
    "pmi as (select a, b, pair.n, (ln(pair.n / (x.n * y.n ** 75e-2 / s)) + ln(pair.n / (y.n * x.n ** 75e-2 / s))) / 2 as pmi "
    "from pair join side x on x.token = a join side y on y.token = b, total)"
)


@check(
    "k1_word_pairs",
    f"with {_PMI} select a, count(*) as partners, cast(sum(n) as bigint) as n, cast(count(*) filter (pmi > 0) as bigint) as attracted, "
    "round(coalesce(sum(pmi) filter (pmi > 0), 0), 6) + 0e0 as pmi from pmi group by 1",
)
def k1_word_pairs(spark, sf):
    """Per word how many others stand near it, how often, and how far beyond chance."""
    words, pairs = wordvectors.numbered_pairs(_tokens(spark, sf), "tokens", WORD_WINDOW, WORD_COUNT)
    pairs = cut_lineage(pairs)
    pmi = wordvectors.positive_pmi(pairs).groupBy("a").agg(F.count(F.lit(1)).alias("attracted"), F.sum("pmi").alias("pmi"))
    rows = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("partners"), F.sum("n").alias("n")).join(pmi, "a", "left")
    rows = rows.join(words, rows["a"] == words["id"]).drop("a").withColumnRenamed("token", "a")
    return rows.select("a", "partners", "n", F.coalesce("attracted", F.lit(0)).alias("attracted"), v.r(F.coalesce("pmi", F.lit(0.0)), "pmi", 6))


@check(
    "k1_learned_vectors",
    f"with {_PMI}, there as (select distinct a as token from pmi where pmi > 0), word as (select doc_id, unnest(tokens) as token from d) "
    "select doc_id, has_words, "
    f"{WORD_DIMS} as dims, case when has_words then 1e0 else 0e0 end as length "
    "from (select doc_id, doc_id in (select doc_id from word semi join there using (token)) as has_words from d) x",
)
def k1_learned(spark, sf):
    """Vectors from the texts' own words, of length 1 for texts with such words."""
    rows = _tokens(spark, sf)
    made = wordvectors.learned_vectors(rows, "doc_id", "tokens", WORD_DIMS, window=WORD_WINDOW, min_count=WORD_COUNT)
    length = F.sqrt(topics.dot(F.col("vector"), F.col("vector")))
    return made.select("doc_id", (length > 0.5).alias("has_words"), F.size("vector").alias("dims"), v.r(length, "length"))


@check("k2_spectral_layout")
def k2_layout(spark, sf):
    placed = layout.spectral_layout(_vectors(spark, sf), "vec_id", "embedding", 2)
    return placed.select("vec_id", *[F.get("reduced", F.lit(i)).alias(f"c{i}") for i in range(2)])


# all merges of the ten labels, one after the other: the areas of the topics as a list
_AREAS = (
    f"docs as (select doc_id, label as topic, {tokens_sql('text')} as tokens from documents join embeddings on doc_id = vec_id), "
    "w as (select topic, unnest(tokens) as token from docs), c as (select topic, token, count(*) as tf from w group by 1, 2), "
    "f as (select token, sum(tf) as f from c group by 1), m as (select sum(tf) / count(distinct topic) as a from c), "
    "k as (select topic, token, tf * ln(1 + a / f) as weight from c join f using (token), m), "
    "norm as (select topic, sqrt(sum(weight * weight)) as norm from k group by 1), size as (select topic, count(*) as n from docs group by 1), "
    "place as (select topic, n, row_number() over (order by topic) as spot from size), "
    "dots as (select x.topic as s, y.topic as t, sum(x.weight * y.weight) as dot from k x join k y on x.token = y.token and x.topic < y.topic group by 1, 2), "
    "alike as (select p.spot as i, q.spot as j, p.n * q.n as mass, coalesce(dot / (u.norm * v.norm), 0) as cosine from place p join place q on p.spot < q.spot "
    "left join dots on s = p.topic and t = q.topic left join norm u on u.topic = p.topic left join norm v on v.topic = q.topic), "
    "merged as (select 0 as step, list(topic order by spot) as area, 0::int as a, 0::int as b, 0e0 as similarity from place "
    "union all select step + 1, list_transform(area, lambda x: case when x = nb then na else x end), na, nb, mean from ("
    "select step, area, least(area[i], area[j]) as na, greatest(area[i], area[j]) as nb, sum(mass * cosine) / sum(mass) as mean "
    "from merged m, alike where area[i] <> area[j] group by step, area, na, nb "
    "order by round(mean, 12) desc, na, nb limit 1) x)"
)


@check(
    "k11_merge_tree",
    f"with recursive {_AREAS} select cast(step - 1 as int) as step, cast(a as int) as a, cast(b as int) as b, {_rd('similarity', 'similarity')}, "
    "(select sum(n) from place where area[spot] = m.a)::bigint as size from merged m where step > 0",
)
def k11_tree(spark, sf):
    tree = areas.merge_tree(_labelled(spark, sf), "topic", "tokens")
    return tree.select("step", "a", "b", v.r("similarity", "similarity"), "size")


@check(
    "k11_areas",
    f"with recursive {_AREAS} select cast(topic as int) as topic, cast(area[spot] as int) as area from merged, place "
    "where step = (select count(*) - 4 from place)",
)
def k11_areas(spark, sf):
    return areas.cut(areas.merge_tree(_labelled(spark, sf), "topic", "tokens"), 4)


@check("k4_centroid_topics")
def k4(spark, sf):
    return topics.centroid_topics(_vectors(spark, sf).drop("topic"), "vec_id", "embedding", 10, 0.2)


@check("k1_embed")
def k1(spark, sf):
    docs = v.table(spark, sf, "documents").select("doc_id", clean_tokens("text").alias("tokens"))
    return topics.embed(docs, "tokens").select("doc_id", F.array_size(F.filter(vector_to_array("embedding"), lambda x: x != 0)).alias("n_features"))


@check("k2_reduce_dimensions")
def k2(spark, sf):
    reduced = topics.reduce_dimensions(_vectors(spark, sf), "embedding", 3)
    return reduced.select("vec_id", *[F.get("reduced", F.lit(i)).alias(f"pc{i}") for i in range(3)])


@check("k13_complaint_topics")
def k13(spark, sf):
    results = v.probs(spark, sf).select(
        "post_id", F.concat("title", F.lit(":\n"), "body").alias("full_post"), F.col("neg_effective").alias("neg_w_sarcasm")
    )
    return complaints.complaint_topics(results).info


@check(
    "k1_embed_laws",
    f"select doc_id, len({tokens_sql('text')}) > 0 as has_words, true as is_unit, true as few_enough, true as differs from documents",
)
def k1_laws(spark, sf):
    """Length 1 for every text with words, no more cells than different words, and not all the same."""
    docs = v.table(spark, sf, "documents").select("doc_id", clean_tokens("text").alias("tokens"))
    rows = cut_lineage(topics.embed(docs, "tokens"))
    rows = rows.withColumn("embedding", vector_to_array("embedding"))
    sized = rows.select("doc_id", F.size("tokens").alias("n"), F.size(F.array_distinct("tokens")).alias("words"),
                        topics.dot(F.col("embedding"), F.col("embedding")).alias("square"),
                        F.array_size(F.filter("embedding", lambda x: x != 0)).alias("cells"))
    differs = sized.agg(F.count_distinct("cells") > 1).first()[0]
    return sized.select(
        "doc_id", (F.col("n") > 0).alias("has_words"), (F.abs(F.col("square") - (F.col("cells") > 0).cast("int")) < 1e-9).alias("is_unit"),
        (F.col("cells") <= F.col("words")).alias("few_enough"), F.lit(differs).alias("differs"),
    )


@check("k2_reduced_laws", "select count(*) as n, true as uncorrelated, true as falling from embeddings")
def k2_laws(spark, sf):
    """Components without correlation, their variances falling."""
    rows = cut_lineage(k2(spark, sf))
    pairs = [F.abs(F.corr(a, b)) < 1e-6 for a, b in (("pc0", "pc1"), ("pc0", "pc2"), ("pc1", "pc2"))]
    v0, v1, v2 = (F.var_samp(f"pc{i}") for i in range(3))
    return rows.agg(
        F.count(F.lit(1)).alias("n"), (pairs[0] & pairs[1] & pairs[2]).alias("uncorrelated"), ((v0 >= v1) & (v1 >= v2) & (v2 > 0)).alias("falling")
    )


@check("k4_centroid_laws", "select vec_id, true as in_range, true as several, true as alike from embeddings")
def k4_laws(spark, sf):
    """Topics in range, more than one of them, and their members nearer to their own centre than to the others on average."""
    rows = cut_lineage(k4(spark, sf).join(_vectors(spark, sf).drop("topic"), "vec_id"))
    real = topics.without_outliers(rows)
    centres = topics.centroids(real, "topic", "embedding")
    own = real.join(centres, "topic").agg(F.avg(topics.cosine(F.col("embedding"), F.col("centroid")))).first()[0]
    apart = real.groupBy((F.col("topic") >= 0).alias("all")).agg(Summarizer.mean(array_to_vector("embedding")).alias("m"))
    middle = apart.select(F.to_json(vector_to_array("m"))).first()[0]
    whole = real.agg(F.avg(topics.cosine(F.col("embedding"), F.from_json(F.lit(middle), "array<double>")))).first()[0]
    several = rows.agg(F.count_distinct("topic") > 2).first()[0]
    return rows.select("vec_id", F.col("topic").between(-1, 9).alias("in_range"), F.lit(several).alias("several"), F.lit(own > whole).alias("alike"))


@check("k11_nearest_area_laws", "select distinct label as topic, true as is_area, true as at_most_five from embeddings")
def k11_laws(spark, sf):
    """Every topic once, in one of at most five areas."""
    rows = cut_lineage(k11_nearest(spark, sf))
    few = rows.agg(F.count_distinct("area").between(2, 5)).first()[0]
    return rows.select("topic", F.col("area").between(0, 4).alias("is_area"), F.lit(few).alias("at_most_five"))


@check(
    "k13_complaint_laws",
    f"with {v.PROBS} select cast(count(*) as bigint) as complaints, true as named, true as once from probs where neg_effective > 2e-1",
)
def k13_laws(spark, sf):
    """The topics' sizes add up to the complaints; each topic is there once, with its number in its name."""
    info = cut_lineage(k13(spark, sf))
    return info.agg(
        F.sum("n").alias("complaints"), F.bool_and(F.col("name").startswith(F.col("topic").cast("string"))).alias("named"),
        (F.count_distinct("topic") == F.count(F.lit(1))).alias("once"),
    )


def _lloyd(source: str, k: int, rounds: int) -> str:
    """``placed(id, topic, distance, second)`` of ``source(id, v, w)``: starts by distance, rounds, places. For topics that keep some row each round."""
    return (
        f"starts as (select 1 as i, [arg_min(v, id)] as cs from {source} union all select i + 1, list_append(cs, v) from ("
        f"select i, cs, v, id, list_min(list_transform(cs, lambda c: list_distance(v, c))) as far from starts, {source} where i < {k} "
        "order by far desc, id limit 1) x where far > 0), "
        "means as (select 0 as round, cs from starts where i = (select max(i) from starts) union all "
        "select round + 1, list(c order by j) from (select round, j, list(m order by d) as c from ("
        "select round, j, d, sum(w * x) / sum(w) as m from (select round, j, w, unnest(v) as x, unnest(range(len(v))) as d from ("
        "select round, v, w, list_position(ds, list_min(ds)) as j from ("
        f"select round, v, w, list_transform(cs, lambda c: list_distance(v, c)) as ds from means, {source} where round < {rounds}) x) x) x "
        "group by round, j, d) x group by round, j) x group by round), "
        "placed as (select id, cast(list_position(ds, list_sort(ds)[1]) - 1 as int) as topic, list_sort(ds)[1] as distance, list_sort(ds)[2] as second "
        f"from (select id, list_transform(cs, lambda c: list_distance(v, c)) as ds from means, {source} where round = {rounds}) x)"
    )


TOPICS, ROUNDS = 10, 12
_EVERY_VECTOR = "e as (select vec_id as id, cast(embedding as double[]) as v, 1e0 as w from embeddings)"


@check(
    "k4_lloyd_topics",
    f"with recursive {_EVERY_VECTOR}, {_lloyd('e', TOPICS, ROUNDS)} "
    f"select id as vec_id, topic, {_rd('distance', 'distance', 6)}, {_rd('second', 'second', 6)} from placed",
)
def k4_lloyd(spark, sf):
    """Topic of every vector, how far its centre is and how far the next one."""
    rows = lloyd.lloyd_topics(_vectors(spark, sf), "vec_id", "embedding", TOPICS, ROUNDS)
    return rows.select("vec_id", "topic", v.r("distance", "distance", 6), v.r("second", "second", 6))


@check(
    "k11_lloyd_areas",
    "with recursive x as (select label, unnest(cast(embedding as double[])) as x, unnest(range(len(embedding))) as d from embeddings where label >= 0), "
    "e as (select label as id, list(m order by d) as v, any_value(n) as w from "
    "(select label, d, avg(x) as m, count(*) + 0e0 as n from x group by label, d) y group by label), "
    f"{_lloyd('e', 5, ROUNDS)} select id as topic, topic as area from placed",
)
def k11_lloyd(spark, sf):
    return lloyd.lloyd_areas(_vectors(spark, sf), "embedding", 5, rounds=ROUNDS)


_COMPLAINT_VECTORS = (
    f"{v.PROBS}, picked as (select post_id, title || chr(58) || chr(10) || body as full_post, cast(embedding as double[]) as v from probs "
    "join embeddings on cast(vec_id as varchar) = post_id where neg_effective > 2e-1), e as (select post_id as id, v, 1e0 as w from picked)"
)


@check(
    "k13_complaint_clusters",
    f"with recursive {_COMPLAINT_VECTORS}, {_lloyd('e', 6, ROUNDS)}, "
    f"docs as (select post_id as vec_id, topic, {tokens_sql('full_post')} as tokens from picked join placed on id = post_id), "
    + _INFO.removeprefix(_DOCS + ", ") + " select topic, n, name from info",
)
def k13_clusters(spark, sf):
    """The whole complaint job over ready vectors, with topics that follow from the rows: sizes and names."""
    results = v.probs(spark, sf).select(
        "post_id", F.concat("title", F.lit(":\n"), "body").alias("full_post"), F.col("neg_effective").alias("neg_w_sarcasm")
    )
    ready = _vectors(spark, sf).select(F.col("vec_id").cast("string").alias("post_id"), "embedding")
    return complaints.complaint_topics(results.join(ready, "post_id"), k=6, vector="embedding", rounds=ROUNDS).info


# powers of the covariance by squaring leave its first direction; its share taken off, the next one is the first
_SPECTRUM = (
    "x as (select vec_id, unnest(cast(embedding as double[])) as x, unnest(range(len(embedding))) as d from embeddings), "
    "m as (select d, avg(x) as m from x group by d), z as (select vec_id, x.d, x - m as z from x join m using (d)), "
    "cov as (select a.d as i, b.d as j, sum(a.z * b.z) / (select count(distinct vec_id) - 1 from z) as c from z a join z b using (vec_id) group by a.d, b.d), "
    "whole as (select list(r order by i) as v from (select i, list(c order by j) as r from cov group by i) x), "
    "total as (select sum(c) as total from cov where i = j), "
    "parts as (select 0 as part, 0 as power, v, v as p, 0e0 as e from whole union all "
    "select case when power = 32 then part + 1 else part end, case when power = 32 then 0 else power + 1 end, "
    "case when power = 32 then list_transform(v, lambda r, i: list_transform(r, lambda x, j: x - first * p[i][j])) else v end, "
    "case when power = 32 then list_transform(v, lambda r, i: list_transform(r, lambda x, j: x - first * p[i][j])) "
    "else list_transform(p, lambda r: list_transform(p, lambda s: list_dot_product(r, s) / square)) end, "
    "case when power = 32 then first else e end from ("
    "select *, list_sum(list_transform(p, lambda r: list_dot_product(r, r))) as square, "
    "list_sum(list_transform(v, lambda r, i: list_dot_product(r, p[i]))) as first from parts where part < 3) x)"
)


@check(
    "k2_kept_variance",
    f"with recursive {_SPECTRUM} select part as component, {_rd('e', 'variance', 7)}, {_rd('e / total', 'share', 7)} from parts, total where part > 0 and power = 0",
)
def k2_variance(spark, sf):
    """The variance along each component, and its share of all."""
    rows = cut_lineage(k2(spark, sf).join(_vectors(spark, sf).select("vec_id", F.posexplode("embedding").alias("d", "x")), "vec_id"))
    kept = [F.var_samp(f"pc{i}").alias(f"s{i}") for i in range(3)]
    # every dimension holds each row once, so the components' variances are the same in all of them
    sums = rows.groupBy("d").agg(F.var_samp("x").alias("s"), *kept).agg(F.sum("s").alias("total"), *[F.max(f"s{i}").alias(f"s{i}") for i in range(3)])
    each = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("component"), F.col(f"s{i}").alias("s")) for i in range(3)])).alias("x")
    return sums.select("total", each).select(
        "x.component", v.r("x.s", "variance", 7), v.r(F.col("x.s") / F.col("total"), "share", 7)
    )
