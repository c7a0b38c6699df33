import random

import pytest
from pyspark.sql import functions as F

from hearsay.operators import topics
from hearsay.plans import complaints, sarcasm


def brute_topics(points, width, min_cell, min_topic):
    """Density topics by flood fill over a dictionary of cells."""
    cell_of = {k: tuple(int(x // width) for x in p) for k, p in points.items()}
    counts = {}
    for c in cell_of.values():
        counts[c] = counts.get(c, 0) + 1
    dense = {c for c, n in counts.items() if n >= min_cell}

    def near(a, b):
        return all(abs(x - y) <= 1 for x, y in zip(a, b))

    label = {}
    for start in sorted(dense):
        if start in label:
            continue
        label[start], todo = start, [start]
        while todo:
            c = todo.pop()
            for o in dense:
                if o not in label and near(c, o):
                    label[o] = start
                    todo.append(o)
    full = dict(label)
    for c in counts:
        if c not in dense:
            around = [(-counts[d], label[d]) for d in dense if near(c, d)]
            if around:
                full[c] = min(around)[1]
    sizes = {}
    for c, n in counts.items():
        if c in full:
            sizes[full[c]] = sizes.get(full[c], 0) + n
    order = sorted((s for s in sizes if sizes[s] >= min_topic), key=lambda s: (-sizes[s], s))
    number = {s: i for i, s in enumerate(order)}
    return {k: number.get(full.get(c), -1) for k, c in cell_of.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_density_topics_match_flood_fill(spark, seed):
    rng = random.Random(seed)
    points = {i: (rng.gauss(0, 0.3), rng.gauss(0, 0.3)) for i in range(150)}
    points |= {1000 + i: (5 + i * 0.05, 5 + (i // 20) % 2) for i in range(120)}
    points |= {2000 + i: (9.0, 9.0) for i in range(40)}
    points |= {3000 + i: (rng.uniform(-20, 20), rng.uniform(-20, 20)) for i in range(60)}
    df = spark.createDataFrame([(k, [float(x) for x in p]) for k, p in points.items()], "k int, c array<double>")
    got = {r.k: r.topic for r in topics.density_topics(df, "k", "c", 2, 0.25, 4, 12).collect()}
    assert got == brute_topics(points, 0.25, 4, 12)
    assert -1 in got.values() and len(set(got.values())) > 3


def test_rounds_find_the_topics_of_one_task(spark, monkeypatch):
    rng = random.Random(3)
    points = {i: (rng.gauss(0, 0.4), rng.gauss(0, 0.4)) for i in range(200)} | {300 + i: (6 + i * 0.04, 0.0) for i in range(100)}
    df = spark.createDataFrame([(k, [float(x) for x in p]) for k, p in points.items()], "k int, c array<double>")
    monkeypatch.setattr(topics, "TASK_EDGES", 0)
    assert {r.k: r.topic for r in topics.density_topics(df, "k", "c", 2, 0.25, 3, 10).collect()} == brute_topics(points, 0.25, 3, 10)


def test_long_chain_is_one_topic(spark):
    df = spark.range(900).select(F.col("id").alias("k"), F.array((F.floor(F.col("id") / 3) + 0.5).cast("double")).alias("c"))
    assert {r.topic for r in topics.density_topics(df, "k", "c", 1, 1.0, 3, 10).collect()} == {0}


def test_no_dense_cell_means_all_outliers(spark):
    df = spark.range(20).select(F.col("id").alias("k"), F.array((F.col("id") * 10).cast("double")).alias("c"))
    assert {r.topic for r in topics.density_topics(df, "k", "c", 1, 1.0, 3, 10).collect()} == {-1}


def test_probabilities_sum_to_one(spark):
    df = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 1, [0.0, 2.0]), (3, 1, [0.1, 1.0]), (4, 1, [0.0, 0.0])], "k int, topic int, v array<double>")
    rows = topics.topic_probabilities(df, "v", topics.centroids(df, "topic", "v")).collect()
    assert all(sum(p.prob for p in r.probabilities) == pytest.approx(1.0) for r in rows)
    assert rows[0].probabilities[0].prob > rows[0].probabilities[1].prob


def test_outliers_sort_first_and_are_left_out_of_the_top(spark):
    docs = spark.createDataFrame([(-1, ["x"]), (0, ["bug", "bug", "save"]), (0, ["bug"]), (1, ["cas"])], "topic int, tokens array<string>")
    info = topics.topic_info(docs, topics.topic_words(docs, "topic", "tokens")).collect()
    assert [r.topic for r in info] == [-1, 0, 1] and info[1].name == "0_bug_save"
    assert [r.topic for r in topics.top_topics(spark.createDataFrame(info), 5).collect()] == [0, 1]


def test_representative_lists_keep_the_order(spark):
    df = spark.createDataFrame([(i, 0, [1.0, i / 10]) for i in range(9)], "k int, topic int, v array<double>")
    docs = topics.representative_docs(df, "k", "v", 3)
    assert topics.representative_lists(docs, "k").first().representative_docs == [4, 5, 3]


def test_scores_by_text_stand_for_all_pairs(spark):
    posts = spark.createDataFrame([("1", "t"), ("2", "t"), ("3", None), ("4", None), ("5", "u")], "post_id string, full_post string")
    scores = posts.withColumns({c: F.col("post_id").cast("double") for c in sarcasm.RESULT_SCORES})
    got = sarcasm.attach_scores(posts, scores, by="text")
    pairs = posts.join(scores.withColumnRenamed("post_id", "other"), posts.full_post.eqNullSafe(scores.full_post))
    assert {(r.post_id, r.copies, r.neg_w_sarcasm) for r in got.collect()} == {
        ("1", 2, 1.5), ("2", 2, 1.5), ("3", 2, 3.5), ("4", 2, 3.5), ("5", 1, 5.0)}
    assert pairs.count() == sum(r.copies for r in got.collect())
    assert sarcasm.attach_scores(posts, scores).count() == 5


def test_complaint_job_separates_two_themes(spark):
    rng = random.Random(5)
    themes = [["bread", "oven", "flour", "yeast"], ["boat", "sail", "river", "anchor"]]
    rows = [(str(i), " ".join(rng.choices(themes[i % 2], k=12)), 0.5) for i in range(80)] + [("x", "bread boat", 0.1)]
    results = spark.createDataFrame(rows, "post_id string, full_post string, neg_w_sarcasm double")
    job = complaints.complaint_topics(results, k=2)
    found = {r.post_id: r.topic for r in job.assigned.collect()}
    assert "x" not in found and len(found) == 80
    assert len({found[str(i)] for i in range(0, 80, 2)}) == 1 and found["0"] != found["1"]
    names = {r.topic: set(r.name.split("_")[1:]) for r in job.info.collect()}
    assert names[found["0"]] == set(themes[0]) and names[found["1"]] == set(themes[1])
    assert job.docs.count() == 20
    dense = complaints.complaint_topics(results, dims=2, width=0.5, min_cell=3)
    assert dense.assigned.count() == 80
    near = complaints.complaint_topics(results, dims=2, neighbours=6)
    found = {r.post_id: r.topic for r in near.assigned.collect()}
    even, odd = ({found[str(i)] for i in range(n, 80, 2)} - {-1} for n in (0, 1))
    assert len(found) == 80 and even and odd and not even & odd  # no topic holds both themes


def test_probabilities_in_blocks_are_the_same(spark, monkeypatch):
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(20)] + [(99, [0.0] * 4)], "id int, v array<double>")
    centres = spark.createDataFrame([(t, [rng.gauss(0, 1) for _ in range(4)]) for t in range(7)], "topic int, centroid array<double>")

    def run():
        rows = topics.topic_probabilities(docs, "v", centres).collect()
        return {(r.id, p.topic): round(p.prob, 12) for r in rows for p in r.probabilities}

    whole = run()
    monkeypatch.setattr(topics, "BLOCK_CENTRES", 3)
    assert run() == whole and len(whole) == 21 * 7
