"""Threads from flat replies against walking up from every reply."""

import random

import pytest

from hearsay.operators import skew, threads


def plain(parents):
    out = {}
    for x in parents:
        way, seen = [x], {x}
        while True:
            up = parents[way[-1]]
            if up is None or up not in parents:
                out[x] = (way[-1], len(way) - 1, "ok" if up is None else "orphan", way[::-1])
                break
            if up in seen:
                out[x] = (None, None, "cycle", None)
                break
            way.append(up)
            seen.add(up)
    return out


def replies(seed):
    r = random.Random(seed)
    parents = {f"p{i}": None for i in range(5)}
    for i in range(400):
        parents[f"r{i}"] = r.choice(["p0", "p0", f"p{r.randrange(5)}", f"r{r.randrange(400)}", f"r{max(0, i - 1)}", f"gone{r.randrange(3)}"])
    parents |= {f"chain{i}": f"chain{i - 1}" if i else "p1" for i in range(130)}
    parents |= {"self": "self", "a": "c", "b": "a", "c": "b", "under": "b", "deeper": "under"}
    return parents


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_threads_equal_walking_up(spark, monkeypatch, broadcast):
    monkeypatch.setattr(skew.lookup_join, "__defaults__", ("left", None, broadcast, None))
    parents = replies(1)
    df = spark.createDataFrame([(k, p, "x", 7) for k, p in parents.items()] + [(None, "p0", "x", 7)], "id string, parent_id string, root string, depth int")
    out = threads.threads(df.repartition(6), with_path=True).collect()
    assert {r.id: (r.root, r.depth, r.status, r.path) for r in out} == plain(parents) and len(out) == len(parents)
    short = threads.threads(df)
    assert short.columns == ["id", "root", "depth", "status"]
    sizes = {r.root: (r.n, r.depth, r.widest) for r in threads.thread_sizes(short).collect()}
    walked = plain(parents)
    for root in {w[0] for w in walked.values()} - {None}:
        depths = [w[1] for w in walked.values() if w[0] == root]
        assert sizes[root] == (len(depths), max(depths), max(map(depths.count, depths)))


def test_numbers_as_keys_and_no_rows(spark):
    df = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 9)], "id long, parent_id long")
    assert {tuple(r) for r in threads.threads(df).collect()} == {(1, 1, 0, "ok"), (2, 1, 1, "ok"), (3, 1, 2, "ok"), (4, 4, 0, "orphan")}
    assert threads.threads(df.filter("id > 9"), with_path=True).count() == 0
