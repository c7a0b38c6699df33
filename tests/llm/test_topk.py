"""Top-k search against all inner products."""

import math

import numpy as np
import pytest

from hearsay.llm import topk

SCHEMA = "vec_id long, embedding array<float>, score string, rank int, id string"


def brute(rows, every, k):
    vectors = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            vectors[i] = min(vectors[i], v) if i in vectors else v
    grid = {i: [math.floor(1024 * float(np.float32(x))) for x in v] for i, v in vectors.items()}
    out = set()
    for q in grid:
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(grid[q], v, strict=False)), i) for i, v in grid.items() if i != q)
            out |= {(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], start=1)}
    return out


def found(spark, rows, block_rows, k=10):
    df = spark.createDataFrame([(i, v, "x", 1, "y") for i, v in rows], SCHEMA)
    items = topk.quantised(df)
    out = topk.topk(items, items.filter("id % 100 = 0"), k, block_rows).collect()
    assert len(out) == len(set(out))
    return {tuple(r) for r in out}


@pytest.mark.parametrize("block_rows", [7, 4096])
def test_equals_brute_force(spark, block_rows):
    rng = np.random.default_rng(0)
    rows = [(i * 25, [float(x) for x in rng.standard_normal(6).round(1)]) for i in range(60)]
    rows += [(30, None), (31, [1.0, None]), (32, [float("nan")] * 6), (33, [float("inf")] * 6), (None, [1.0] * 6), (200, [0.0] * 6)]
    rows += [(25, rows[1][1]), (26, rows[1][1]), (27, rows[1][1]), (34, []), (35, [2.0]), (36, [0.0] * 9)]  # ties, repeats, lengths
    assert found(spark, rows, block_rows) == brute(rows, 100, 10)


def test_fewer_rows_than_k_and_none(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.9])]
    assert found(spark, rows, 4096) == {(0, 1, 1, 524288), (0, 2, 2, 524288)}
    assert found(spark, [], 4096) == set()
    assert found(spark, [(0, [1.0])], 4096) == set()


def test_repeated_terms_add_up(spark):
    df = spark.createDataFrame([(1, [3, 3], [2, 5]), (2, [3], [6]), (0, [3], [10])], "id long, terms array<int>, weights array<long>")
    out = topk.topk(df, df.filter("id = 0"), 2).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in out] == [(1, 70), (2, 60)]
