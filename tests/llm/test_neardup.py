"""Near-duplicate vectors against all cosines."""

import numpy as np
import pytest

from hearsay.llm import components, neardup


def brute(ids, x, threshold=0.95):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= threshold
    np.fill_diagonal(near, False)
    label = np.array(ids)
    while True:
        new = np.minimum(label, np.where(near, label[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (new == label).all():
            return {i: (int(n), int(c), i == c) for i, n, c in zip(ids, near.sum(axis=1), label, strict=True)}
        label = new


def clusters(seed, n, dim, cosine):
    """Random vectors, some of them within a cosine of a common centre; the last cluster is large."""
    rng = np.random.default_rng(seed)
    out = [rng.standard_normal(dim) for _ in range(n // 3)]
    for size in (2, 3, 5, n // 2):
        centre = rng.standard_normal(dim)
        centre /= np.linalg.norm(centre)
        for _ in range(size):
            off = rng.standard_normal(dim)
            off -= (off @ centre) * centre
            off /= np.linalg.norm(off)
            out.append(3 * (cosine * centre + np.sqrt(1 - cosine**2) * off))
    return np.array(out, dtype=np.float32).astype(float)


def run(spark, ids, x, kind="float"):
    df = spark.createDataFrame([(i, v, 0, 0) for i, v in zip(ids, x, strict=True)], f"vec_id long, embedding array<{kind}>, n_links int, rep int")
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()}


@pytest.mark.parametrize(("dim", "cosine", "kind"), [(64, 0.99, "float"), (16, 0.985, "double")])
def test_equals_brute_force(spark, monkeypatch, dim, cosine, kind):
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 32)  # so that the large cluster is cut into blocks
    x = clusters(1, 240, dim, cosine)
    ids = [int(i) for i in np.random.default_rng(2).permutation(len(x)) * 3]
    assert run(spark, ids, x.tolist(), kind) == brute(ids, x)


def test_recall_at_the_threshold(spark):
    """Pairs whose cosine is just above the threshold are the hardest to find."""
    rng = np.random.default_rng(4)
    a = rng.standard_normal((400, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((400, 64))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    b = 0.9505 * a + np.sqrt(1 - 0.9505**2) * b
    got = run(spark, range(800), np.concatenate([a, b]).tolist())
    assert sum(got[i][0] == 1 and got[i + 400] == (1, i, False) for i in range(400)) >= 398


def test_copies_nulls_and_odd_rows(spark):
    rows = [
        (5, [1.0, 0.0]), (3, [1.0, 0.0]), (9, [1.0, 0.0]), (3, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (4, [float("nan"), 1.0]),
        (6, [1.0, None]), (7, []), (8, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (10, [2.0, 0.001]), (11, [-1.0, 0.0]), (12, [float("inf"), 0.0]),
    ]
    got = run(spark, [i for i, _ in rows], [v for _, v in rows])
    alone = {i: (0, i, True) for i in (1, 2, 4, 6, 7, 8, 11, 12)}
    assert got == alone | {3: (3, 3, True), 5: (3, 3, False), 9: (3, 3, False), 10: (3, 3, False)}


def test_empty(spark):
    assert run(spark, [], []) == {}


def test_list_decoding_finds_all_exceeding_filters():
    filters = neardup.Filters(6, 5, 0.35, tables=2)
    x = np.random.default_rng(0).standard_normal((50, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows, found = filters.decode(x)
    want = set()
    for table, (turn, (a, b)) in enumerate(zip(filters.turns, filters.words, strict=True)):
        whole = np.array([np.r_[u, v] for u in a for v in b])
        want |= {(int(i), int(j) + 25 * table) for i, j in np.argwhere((x @ turn) @ whole.T >= 0.35)}
    assert set(zip(rows.tolist(), found.tolist(), strict=True)) == want


def test_components(spark):
    path = [(i, i + 1) for i in range(30)]
    edges = [*path, (100, 90), (90, 95), (200, 200), (None, 3), (7, 3), (100, 90)] + [(500, i) for i in range(501, 560)]
    got = {r.id: r.component for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(31)} | {100: 90, 90: 90, 95: 90, 200: 200} | {i: 500 for i in range(500, 560)}
    assert got == want
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0
