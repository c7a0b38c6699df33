"""Pfair mixing against a plain earliest-deadline-first run of all blocks, slot by slot."""

import math
import random
from collections import Counter
from fractions import Fraction

import pytest

from hearsay.llm import mixing

COUNTS = {"a": 333, "b": 120, "c": 41, "": 8, "e": 1}


def scheduled(flow, frame):
    """All slots, frame by frame, as tasks and driver do it."""
    ends = [(a, min(a + frame, flow.slots)) for a in range(0, flow.slots, frame)]
    late = list(mixing.states([flow.summary(*e) for e in ends], frame))
    return [row for e, early, after in zip(ends, [[], *late], late, strict=False) for row in flow.frame(*e, early, after)]


def plain(blocks, weights):
    """Windows of all blocks by flowing slot by slot in fractions, then the earliest deadline first over all slots."""
    exact, flown = [Fraction(w) for w in weights], [Fraction(0)] * len(blocks)
    release, due, slots = {}, {}, sum(blocks)
    time, passed = Fraction(0), [0] * len(blocks)
    for s, n in enumerate(blocks):
        if n:
            release[s, 0] = 0
    while any(p < n for p, n in zip(passed, blocks, strict=True)):
        live = [s for s, n in enumerate(blocks) if passed[s] < n]
        total = sum(exact[s] for s in live)
        wait = min((passed[s] + 1 - flown[s]) * total / exact[s] for s in live)
        time += wait
        for s in live:
            flown[s] += wait * exact[s] / total
            if flown[s] == passed[s] + 1:
                due[s, passed[s]] = math.ceil(time)
                passed[s] += 1
                if passed[s] < blocks[s]:
                    release[s, passed[s]] = math.floor(time)
    open_, out = set(release), []
    for t in range(slots):
        s, j = min((b for b in open_ if release[b] <= t), key=lambda b: (due[b], b))
        assert due[s, j] > t
        open_.remove((s, j))
        out.append((s, j, release[s, j], due[s, j], t))
    return out


@pytest.mark.parametrize("seed", range(8))
def test_frames_equal_windows_of_a_plain_flow(seed):
    """Random sources and weights in frames of all sizes: every block once, in its window, and the same windows as by plain flowing."""
    r = random.Random(seed)
    for _ in range(40):
        n = r.choice((1, 2, 3, 5, 12, 30))
        blocks = [r.choice((1, 1, 2, 3, 7, 20, 60)) for _ in range(n)]
        weights = [r.choice((b, b**0.5, 1.0, r.random() + 1e-6, r.choice((1e-4, 100.0)))) for b in blocks]
        flow, want = mixing.Flow(blocks, weights), plain(blocks, weights)
        for frame in {1, 2, 3, r.randint(1, 64), 64, flow.slots}:
            got = scheduled(flow, frame)
            assert [row[4] for row in got] == list(range(flow.slots))
            assert sorted(row[:4] for row in got) == sorted(row[:4] for row in want)
            assert all(release <= t < deadline for _, _, release, deadline, t in got)


def test_equal_shares_with_small_sources_by_one_frame_and_many():
    r = random.Random(1)
    blocks = [r.randint(200, 900) for _ in range(5)] + [r.randint(1, 4) for _ in range(20)]
    flow = mixing.Flow(blocks, [float(b) for b in blocks])
    for frame in (64, 4096, 10**6):
        assert Counter(row[0] for row in scheduled(flow, frame)) == dict(enumerate(blocks))


def test_large_sources_with_many_small_ones_over_many_frames():
    r = random.Random(2)
    counts = [20_000] * 20 + [r.randint(1, 4) for _ in range(300)]
    flow = mixing.Flow(counts, [n**0.5 for n in counts])
    ends = [(a, a + 4096) for a in range(0, 40_960, 4096)]
    late = list(mixing.states([flow.summary(*e) for e in ends], 4096))
    seen = set()
    for e, early, after in zip(ends, [[], *late], late, strict=False):
        rows = flow.frame(*e, early, after)
        assert all(release <= t < deadline for _, _, release, deadline, t in rows)
        seen |= {row[:2] for row in rows}
    assert len(seen) == 40_960


def test_many_small_sources_on_spark(spark):
    r = random.Random(3)
    sizes = {f"big{i}": r.randint(200, 900) for i in range(5)} | {f"small{i}": r.randint(1, 4) for i in range(20)}
    df = spark.createDataFrame([(i, "t", s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))], "doc_id long, text string, source string")
    out = mixing.mix(df, {s: float(n) for s, n in sizes.items()}, block=1).toPandas()
    assert sorted(out.position) == list(range(sum(sizes.values()))) and Counter(out.source) == sizes
    assert (out.release <= out.slot).all() and (out.slot < out.deadline).all()


def docs(spark):
    rows = [(i, f"text {i}", s) for i, s in enumerate(s for s, n in COUNTS.items() for _ in range(n))]
    rows += [(9000, None, "a"), (9001, "", None), (None, "no id", "b"), (None, None, None), (5, "text 5", "a"), (5, "other", "a")]
    return rows, spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, source string, position int, stream string")


def test_less_than_one_block_from_the_targets(spark):
    rows, df = docs(spark)
    weights = {"a": 5.0, "b": 3.0, "c": 1.0, "": 1.0, "e": 1.0}
    out = mixing.mix(df, weights, block=4, period=100).toPandas()
    named = Counter(r[2] or "" for r in rows)
    assert Counter(out.stream) == named and sorted(out.position) == list(range(len(rows)))
    assert out[out["copy"] == 1].doc_id.tolist() == [5]
    assert (out.release <= out.slot).all() and (out.slot < out.deadline).all()
    by_slot = out.drop_duplicates("slot").set_index("slot").stream
    assert sorted(by_slot.index) == list(range(len(by_slot)))
    ends = {s: out[out.stream == s].slot.max() for s in named}
    slots = mixing.shares(weights, 100)
    seen = Counter()
    for t in range(min(ends.values()) + 1):
        seen[by_slot[t]] += 1
        for s in slots:
            assert abs(seen[s] - (t + 1) * slots[s] / 100) < 1
    assert out.sort_values("position").slot.is_monotonic_increasing


def test_same_again_whatever_the_partitions(spark):
    _, df = docs(spark)
    runs = [{(r.doc_id, r.text_hash, r.copy, r.source, r.position) for r in mixing.mix(d, block=4).collect()} for d in (df.repartition(7), df.coalesce(1))]
    assert runs[0] == runs[1]


def test_many_sources_are_pooled(spark):
    rows = [(i, "t", f"s{i % 40}") for i in range(400)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), block=4, max_sources=5).toPandas()
    assert len(out) == 400 and out.stream.nunique() == 6 and sorted(out.position) == list(range(400))


def test_shares_and_errors(spark):
    assert mixing.shares({"a": 1, "b": 1, "c": 1}, 10) in ({"a": 4, "b": 3, "c": 3}, {"a": 3, "b": 4, "c": 3}, {"a": 3, "b": 3, "c": 4})
    assert sum(mixing.shares({str(i): 1e-9 + i for i in range(30)}, 31).values()) == 31
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(empty).count() == 0
    for weight in (0.0, -1.0, math.inf, math.nan):
        with pytest.raises(ValueError, match="positive"):
            mixing.mix(empty, {"a": weight, "b": 1.0})


@pytest.mark.parametrize("weights", [[1, 1, 1], [0.7, 0.2999, 0.0001], [3**0.5, 2**0.5, 5.0, 0.01]])
def test_exact_weights_however_long(weights):
    flow = mixing.Flow([20_000, *[9_000] * (len(weights) - 1)], weights)
    seen, exact = Counter(), [Fraction(w) / sum(map(Fraction, weights)) for w in weights]
    upto = int(min(flow.times))  # all sources last
    for s, j, release, deadline, t in scheduled(flow, 1000):
        assert j == seen[s] and release <= t < deadline
        seen[s] += 1
        if t < upto:
            assert all(abs(seen[i] - (t + 1) * w) < 1 for i, w in enumerate(exact))
    assert upto > 10_000 and [seen[s] for s in range(len(weights))] == flow.blocks


def test_shares_of_the_table_follow_the_weights_given(spark):
    df = spark.range(9000).selectExpr("id as doc_id", "'t' as text", "concat('s', id % 3) as source")
    out = mixing.mix(df, {"s0": 1.0, "s1": 1.0, "s2": 1.0}, block=1).toPandas().sort_values("slot")
    assert out.slot.tolist() == out.position.tolist() == list(range(9000))
    for n in (300, 3000, 6000, 8999):
        assert all(abs(c - n / 3) < 1 for c in Counter(out.source[:n]).values())


def test_every_source_has_its_own_share(spark):
    sizes = {f"s{i}": 12 if i % 2 else 3 for i in range(1100)}
    df = spark.createDataFrame([(i, "t", s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))], "doc_id long, text string, source string")
    targets = {s: 4.0 if n == 12 else 1.0 for s, n in sizes.items()}
    out = mixing.mix(df, targets, block=1).toPandas().sort_values("position")
    assert out.stream.nunique() == 1100 and (out.stream == out.source).all()
    total, seen = sum(targets.values()), Counter()
    for t, s in enumerate(out.source, 1):
        seen[s] += 1
        assert abs(seen[s] - t * targets[s] / total) < 1
        if t % 1000 == 0:
            assert all(abs(seen[s] - t * w / total) < 1 for s, w in targets.items())


def test_pool_keeps_named_sources_and_all_its_weight(spark):
    df = spark.createDataFrame([(i, "t", f"s{i % 40}") for i in range(4000)] + [(9000, "t", "rare")], "doc_id long, text string, source string")
    targets = {"rare": 2.0, **{f"s{i}": 1.0 for i in range(40)}}
    out = mixing.mix(df, {**targets, "s7": 0.5}, block=1, max_sources=5).toPandas()
    assert set(targets) == set(out.stream)
    out = mixing.mix(df, {"s0": 1.0, "rare": 1.0}, block=1, max_sources=5).toPandas().sort_values("slot")
    pool = out.stream == mixing.OTHERS
    assert (out.stream == "rare").any() and out[pool].source.nunique() == 35
    assert abs(pool[:1000].sum() - 1000 * 35 / 40) < 3  # 35 of 41 weights until "rare" is used up, then of 40
