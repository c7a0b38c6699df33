"""k-means by rounds against a plain loop, and what it makes of odd rows."""

import math
import random

import numpy as np
import pytest

from hearsay.operators import lloyd, topics


def plain(rows, k, rounds):
    """``rows``: (key, vector, weight); topic by key."""
    rows = sorted(rows)
    centres = [rows[0][1]]
    while len(centres) < k:
        far, _, v = min((-min(math.dist(v, c) for c in centres), key, v) for key, v, _ in rows)
        if far == 0:
            break
        centres.append(v)
    nearest = lambda v: min(range(len(centres)), key=lambda i: (math.dist(v, centres[i]), i))
    for _ in range(rounds):
        own = [[(v, w) for _, v, w in rows if nearest(v) == i] for i in range(len(centres))]
        centres = [
            [sum(v[d] * w for v, w in mine) / sum(w for _, w in mine) for d in range(len(c))] if mine else c
            for mine, c in zip(own, centres, strict=True)
        ]
    return {key: (nearest(v), sorted(math.dist(v, c) for c in centres)) for key, v, _ in rows}


def rows_of(seed, n, dims):
    r = random.Random(seed)
    spots = [[r.uniform(-3, 3) for _ in range(dims)] for _ in range(5)]
    rows = [(i, [x + r.gauss(0, 0.7) for x in r.choice(spots)], r.choice((0.5, 1.0, 4.0))) for i in range(n)]
    return rows + [(n + i, rows[3][1], 1.0) for i in range(n // 3)]  # copies


@pytest.mark.parametrize(("seed", "k", "rounds", "parts"), [(1, 5, 20, 1), (2, 5, 20, 7), (3, 9, 3, 4), (4, 1, 2, 3), (5, 6, 0, 2)])
def test_equals_a_plain_loop(spark, seed, k, rounds, parts):
    rows = rows_of(seed, 150, 4)
    df = spark.createDataFrame(rows, "id long, v array<double>, w double").repartition(parts)
    got = {r.id: r for r in lloyd.lloyd_topics(df, "id", "v", k, rounds, "w").collect()}
    want = plain(rows, k, rounds)
    assert {i: r.topic for i, r in got.items()} == {i: t for i, (t, _) in want.items()}
    for i, (_, apart) in want.items():
        assert got[i].distance == pytest.approx(apart[0], abs=1e-9)
        assert got[i].second is None if k == 1 else got[i].second == pytest.approx(apart[1], abs=1e-9)


def test_a_centre_without_rows_stays(spark):
    df = spark.createDataFrame([([0.0], 1.0), ([2.0], 3.0)], "v array<double>, w double")
    assert lloyd.rounds_of(df, np.array([[1.0], [100.0]]), 5).tolist() == [[1.5], [100.0]]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        ("a", [0.0, 0.0], 1.0, 1), ("b", [0.0, 0.1], 1.0, 1), ("c", [9.0, 9.0], 1.0, 1), ("a", [9.0, 9.1], 1.0, 1), (None, [9.0, 9.0], 1.0, 1),
        ("n", None, 1.0, 1), ("e", [], 1.0, 1), ("x", [1.0, None], 1.0, 1), ("y", [nan, 1.0], 1.0, 1), ("z", [inf, 1.0], 1.0, 1),
        ("s", [1.0], 1.0, 1), ("w", [1.0, 1.0], 0.0, 1), ("u", [1.0, 1.0], None, 1), ("t", [1.0, 1.0], nan, 1),
    ]
    df = spark.createDataFrame(rows, "k string, v array<double>, w double, topic int")
    got = sorted((str(r.k), r.topic, r.distance is None) for r in lloyd.lloyd_topics(df, "k", "v", 2, weight="w").collect())
    assert got == sorted(
        [("a", 0, False), ("b", 0, False), ("c", 1, False), ("a", 1, False), ("None", 1, False)]
        + [(k, topics.OUTLIER, True) for k in "nexyzswut"]
    )
    assert len({r.topic for r in lloyd.lloyd_topics(df.filter("k = 'c'"), "k", "v", 4).collect()}) == 1
    assert lloyd.lloyd_topics(df.filter("k = 'n'"), "k", "v", 4).collect()[0].topic == topics.OUTLIER
    assert lloyd.lloyd_topics(df.limit(0), "k", "v", 4).count() == 0


def test_far_rows_are_outliers_and_centres_are_bounded(spark):
    df = spark.createDataFrame([(i, [float(i % 2) * 10, 0.0]) for i in range(40)] + [(99, [4.0, 0.0])], "id long, v array<double>")
    got = {r.id: r.topic for r in lloyd.lloyd_topics(df, "id", "v", 2, max_distance=2.0).collect()}
    assert got.pop(99) == topics.OUTLIER and topics.OUTLIER not in got.values()
    with pytest.raises(ValueError):
        lloyd.lloyd_topics(df, "id", "v", 10_000_000)


def test_areas_weigh_topics_by_their_rows(spark):
    spots = {0: 0.0, 1: 1.0, 2: 10.0, 3: 11.0, -1: 50.0}
    df = spark.createDataFrame([(t, [x, 0.0]) for t, x in spots.items() for _ in range(t + 2)], "topic int, v array<double>")
    got = {r.topic: r.area for r in lloyd.lloyd_areas(df, "v", 2).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 1}
