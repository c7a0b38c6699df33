"""Density clusters over neighbour graphs against a plain loop over all pairs."""

import math
import random

import pytest

from hearsay.operators import hierarchy, neighbours


def brute_near(points, k):
    out = {}
    for i, p in points.items():
        out[i] = sorted((math.dist(p, q), j) for j, q in points.items() if j != i)[:k]
    return out


def brute_topics(points, k, min_size, allow_single=False):
    """Kruskal, then the merges as a tree, then the condensed tree and its most stable clusters, all by recursion."""
    near = brute_near(points, k)
    core = {i: n[-1][0] for i, n in near.items()}
    pairs = {}
    for i, n in near.items():
        for d, j in n:
            pairs[min(i, j), max(i, j)] = max(d, core[i], core[j])
    node_of = {i: ("point", i) for i in points}
    root = {i: i for i in points}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    forest = 0
    for (a, b), w in sorted(pairs.items(), key=lambda e: (e[1], e[0])):
        x, y = find(a), find(b)
        if x != y:
            node_of[x] = ("merge", forest, w, node_of[x], node_of[y])
            forest += 1
            root[y] = x
    points_of = lambda n: [n[1]] if n[0] == "point" else points_of(n[3]) + points_of(n[4])
    inverse = lambda w: 1 / max(w, hierarchy.LEAST_DISTANCE)
    clusters = []  # number of the lowest merge, stability, members, children

    def grow(node, birth):
        out, members, at = 0.0, points_of(node), node
        while True:
            _, number, w, left, right = at
            a, b = points_of(left), points_of(right)
            big = [c for c, own in ((left, a), (right, b)) if len(own) >= min_size]
            if len(big) == 1:
                out += min((a, b), key=len).__len__() * inverse(w) if len(a) != len(b) else len(a) * inverse(w)
                at = big[0]
                continue
            out += (len(a) + len(b)) * inverse(w)
            below = [grow(c, inverse(w)) for c in big]
            return (number, out - len(members) * birth, members, below)

    tops = [grow(n, 0.0) for x in points if find(x) == x for n in [node_of[x]] if n[0] == "merge" and len(points_of(n)) >= min_size]

    def best(c):
        """(value, chosen clusters) of the best antichain at or below c."""
        under = [best(b) for b in c[3]]
        total = sum(u[0] for u in under)
        return (c[1], [c]) if not under or c[1] >= total else (max(total, c[1]), [x for u in under for x in u[1]])

    chosen = []
    for c in tops:
        if len(tops) == 1 and not allow_single:
            chosen += [x for b in c[3] for x in best(b)[1]]
        else:
            chosen += best(c)[1]
    order = sorted(chosen, key=lambda c: (-len(c[2]), c[0]))
    out = dict.fromkeys(points, -1)
    for topic, c in enumerate(order):
        out.update(dict.fromkeys(c[2], topic))
    return out


def blobs(seed, dims, sizes, noise):
    r = random.Random(seed)
    points, i = {}, 0
    for size in sizes:
        centre, spread = [r.uniform(-10, 10) for _ in range(dims)], r.choice((0.2, 0.6, 1.5))
        for _ in range(size):
            points[i] = tuple(r.gauss(c, spread) for c in centre)
            i += 1
    for _ in range(noise):
        points[i] = tuple(r.uniform(-15, 15) for _ in range(dims))
        i += 1
    for _ in range(6):  # copies
        points[i] = points[r.randrange(i)]
        i += 1
    return points


def frame(spark, points):
    return spark.createDataFrame([(f"k{i:05d}", list(p), 1, "x") for i, p in points.items()], "name string, v array<double>, id int, topic string")


def found(df, *args, **options):
    return {int(r[0][1:]): r.topic for r in hierarchy.neighbour_topics(df, "name", "v", *args, **options).collect()}


@pytest.mark.parametrize(("seed", "dims", "sizes", "noise", "single"), [
    (1, 2, (60, 40, 80, 30), 40, False), (2, 5, (100, 30, 30, 20), 20, False), (3, 12, (40,) * 8, 60, True), (4, 3, (50,), 10, True), (5, 3, (50,), 10, False),
])
def test_topics_equal_plain_loop(spark, seed, dims, sizes, noise, single):
    points = blobs(seed, dims, sizes, noise)
    want = brute_topics(points, 8, 10, single)
    assert found(frame(spark, points), 10, 8, single) == want
    assert len(set(want.values())) > 1 or seed >= 4


@pytest.mark.parametrize("task_edges", [3, 40])
def test_contraction_and_cuts_change_nothing(spark, monkeypatch, task_edges):
    points = blobs(7, 3, (40, 30, 20), 15)
    want = brute_topics(points, 6, 8)
    monkeypatch.setattr(hierarchy, "TASK_EDGES", task_edges)
    rounds = []
    whole = hierarchy.stable_clusters
    monkeypatch.setattr(hierarchy, "stable_clusters", lambda c: rounds.append(1) or whole(c, 0))
    assert found(frame(spark, points), 8, 6) == want and rounds


def test_spanning_forest_has_the_least_weight(spark, monkeypatch):
    r = random.Random(2)
    edges = {(a, b): round(r.random(), 1) for a in range(60) for b in range(a + 1, 60) if r.random() < 0.1 and (a < 45) == (b < 45)}
    root, want = {i: i for i in range(60)}, set()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for w, (a, b) in sorted((w, e) for e, w in edges.items()):
        if find(a) != find(b):
            root[find(b)] = find(a)
            want.add((a, b, w))
    df = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "a long, b long, w double")
    for bound in (0, 7, 10_000):
        monkeypatch.setattr(hierarchy, "TASK_EDGES", bound)
        assert {tuple(x) for x in hierarchy.spanning_forest(df).collect()} == want
    names = {r.id: r.to for r in hierarchy.connected(df.select("a", "b")).collect()}
    assert all(names[x] == min(y for y in names if find(y) == find(x)) for x in names)


def test_neighbours_of_neighbours_find_nearly_all(spark):
    r = random.Random(4)
    points = {i: tuple(r.gauss(c, 1) for c in ((i % 30) * 2.0,) * 3 + (0.0,) * 7) for i in range(2000)}
    points |= {2000 + i: (0.5,) * 10 for i in range(100)}  # copies, far more than k
    df = spark.createDataFrame([(i, list(map(float, p))) for i, p in points.items()], "id long, v array<double>")
    got = {}
    for x in neighbours.neighbours(df, 8, block_rows=64, orders=3).collect():
        got.setdefault(x.id, []).append((x.distance, x.other, x.rank))
    want = brute_near(points, 8)
    assert set(got) == set(points) and all([n[2] for n in sorted(v, key=lambda n: n[2])] == list(range(1, 9)) for v in got.values())
    hits = sum(d <= want[i][-1][0] + 1e-9 for i, v in got.items() for d, *_ in v)
    assert hits / (8 * len(points)) > 0.97
    assert all(abs(math.dist(points[i], points[o]) - d) < 1e-9 for i, v in list(got.items())[:200] for d, o, _ in v)
    few = spark.createDataFrame([(i, [float(i)]) for i in (1, 2, 5)], "id long, v array<double>")
    assert {(x.id, x.other, x["rank"]) for x in neighbours.neighbours(few, 8).collect()} == {(1, 2, 1), (1, 5, 2), (2, 1, 1), (2, 5, 2), (5, 2, 1), (5, 1, 2)}


def test_odd_rows(spark):
    schema = "name string, v array<double>, id int, topic string"
    assert found(spark.createDataFrame([], schema), 5) == {}
    odd = [("k1", None), ("k2", []), ("k3", [None, 1.0]), ("k4", [float("nan"), 1.0]), ("k5", [1.0]), (None, [0.0, 0.0])]
    same = [(f"k{i}", [0.0, 0.0]) for i in range(10, 30)] + [(f"k{i}", [9.0, 9.0]) for i in range(30, 45)]
    df = spark.createDataFrame([(*r, 1, "x") for r in odd + same], schema)
    assert found(df, 5, 6) == {1: -1, 2: -1, 3: -1, 4: -1, 5: -1, **dict.fromkeys(range(10, 30), 0), **dict.fromkeys(range(30, 45), 1)}
    assert set(found(spark.createDataFrame([(*r, 1, "x") for r in odd], schema), 5).values()) == {-1}
    with pytest.raises(ValueError, match="two"):
        hierarchy.neighbour_topics(df, "name", "v", 1)


def test_only_nearer_pairs_travel(spark, monkeypatch):
    r = random.Random(6)
    df = spark.createDataFrame([(i, [r.gauss(0, 1) for _ in range(4)]) for i in range(600)], "id long, v array<double>").localCheckpoint()
    seen, best = [], neighbours._best

    def counted(lists, k):
        seen.append(lists.count() if "other" in lists.columns else sum(len(x.near) for x in lists.collect()))
        return best(lists, k)

    monkeypatch.setattr(neighbours, "_best", counted)
    neighbours.neighbours(df, 8, block_rows=32, orders=2, rounds=4).collect()
    # all that meet would be above a hundred pairs a row in every round
    assert seen[1] < 40 * 600 and seen[-1] < 8 * 600 and seen[-1] < seen[1]


@pytest.mark.parametrize("scale", [1.0, 1e-150, 1e160])
def test_nearest_of_a_block_by_differences(scale):
    import numpy as np

    rng = np.random.default_rng(3)
    rows = rng.integers(0, 3, (60, 3)) * scale  # many ties and copies
    ids = rng.permutation(60) - 20
    found, apart = neighbours._nearest(ids, rows, 7)
    with np.errstate(over="ignore"):
        exact = np.sqrt(((rows[:, None] - rows[None]) ** 2).sum(axis=2))
    for i in range(60):
        want = sorted((exact[i, j], int(ids[j])) for j in range(60) if j != i)[:7]
        assert [(d, o) for d, o in zip(apart[i].tolist(), found[i].tolist())] == want
    _, apart = neighbours._nearest(ids[:3], rows[:3], 7)
    assert not np.isnan(apart[:, :2]).any() and np.isnan(apart[:, 2:]).all()


def test_ids_with_several_rows_meet_row_by_row(spark):
    r = random.Random(8)
    points = [(i, [r.gauss(0, 1) for _ in range(3)]) for i in range(300)]
    df = spark.createDataFrame(points + points[:20] + [(7, [9.0, 9.0, 9.0])], "id long, v array<double>").localCheckpoint()
    got = neighbours.neighbours(df, 5, block_rows=32, orders=2).collect()
    assert {x.id for x in got if x.id == x.other} == set(range(20)) and all(x.distance == 0 for x in got if x.id == x.other)
    assert len({(x.id, x.other) for x in got}) == len(got) == 5 * 300
    with pytest.raises(ValueError, match="length"):
        neighbours.neighbours(spark.createDataFrame([(1, [1.0]), (2, None)], "id long, v array<double>"))
