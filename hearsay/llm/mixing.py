"""Interleaving sources to target weights by Pfair scheduling of their blocks."""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterable, Iterator, Mapping, Sequence
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearsay.llm.common import global_positions, parallelism, per_copy, step, table
from hearsay.operators import skew

BLOCK_DOCS = 16
PERIOD = 1000
FRAME_SLOTS = 4096
FRAME_BLOCKS = 64
TEMPERATURE = 0.5
OTHERS = "\u0000others"


def shares(weights: Mapping[str, float], period: int = PERIOD) -> dict[str, int]:
    """Slots per period for each source: whole numbers, at least one each, as near to the weights as can be."""
    period = max(period, len(weights))
    total = sum(weights.values())
    exact = {s: w / total * period for s, w in weights.items()}
    out = {s: max(1, int(x)) for s, x in exact.items()}
    by_rest = sorted(exact, key=lambda s: (out[s] - exact[s], s))
    i = 0
    while sum(out.values()) < period:
        out[by_rest[i % len(by_rest)]] += 1
        i += 1
    while sum(out.values()) > period:
        most = max(out, key=lambda s: (out[s] - exact[s] if out[s] > 1 else float("-inf"), s))
        out[most] -= 1
    return out


class Flow:
    """The flow of all sources by exact weights, and the schedule that stays less than one block from it.

    Each source flows at its share of the weights of the sources that are not used up, and one block flows per slot.
    Block j of a source is released in the slot in which its flow passes j, and is due before the flow has passed j + 1.
    All numbers are whole, so nothing is rounded however long it flows. The earliest deadline goes first; the flow itself
    shows that all deadlines are met: the blocks released at or after a and due by b never flow more than b - a.

    The slots are cut into frames, which tasks schedule each on its own. At a frame's end a source has at most one block
    *under way*, released but not yet due (blocks of a source overlap by no more than one slot); all others have surely come or not.
    So a state says which blocks under way have come. The states that ``states`` chooses are those of one
    earliest-deadline run over all slots, as far as it matters:

    * The blocks that must come within a frame (released and due in it, or under way before and due in it) leave some of its slots spare.
      Sets of blocks under way at its end that fit the spare slots are the independent sets of a matroid, and a set of
      as many as there are spare slots fits if the frame can be filled from the state before it.
    * Taking them by deadline, each if it still fits, leaves of every first part of that order the fewest open, compared with any set that fits.
      If the slots behind the frame can be filled after any such set, they can after this one. The first state (nothing has come) can go on, by the
      flow, so every state can, by induction; and within a frame the earliest deadline then meets all its blocks' windows.
    """

    def __init__(self, blocks: Sequence[int], weights: Sequence[float]):
        exact = [Fraction(w) for w in weights]
        scale = math.lcm(*(w.denominator for w in exact))
        self.blocks, self.weights = list(blocks), [int(w * scale) for w in exact]
        ends = [Fraction(b, w) for b, w in zip(self.blocks, self.weights, strict=True)]
        self.order = sorted(range(len(ends)), key=ends.__getitem__)
        # before the k-th source in order is used up: blocks of those that are, and the weight of the others
        self.ends, self.gone, self.going, self.times = [ends[s] for s in self.order], [], [], []
        gone, going = 0, sum(self.weights)
        for s in self.order:
            self.gone.append(gone)
            self.going.append(going)
            self.times.append(gone + going * ends[s])
            gone, going = gone + self.blocks[s], going - self.weights[s]
        self.slots = gone

    def window(self, s: int, j: int) -> tuple[int, int]:
        """The first slot in which block j of source s may come, and the slot before which it must."""
        w = self.weights[s]
        a, b = (bisect_left(self.ends, Fraction(i, w)) for i in (j, j + 1))
        return self.gone[a] + self.going[a] * j // w, self.gone[b] - (-self.going[b] * (j + 1) // w)

    def passed(self, t: int) -> tuple[list[int], set[int]]:
        """How many blocks of each source are due in the first ``t`` slots, and the sources whose next block is under way."""
        out = list(self.blocks)
        k = bisect_left(self.times, t)
        under_way = set()
        for s in self.order[k:]:
            out[s], rest = divmod(self.weights[s] * (t - self.gone[k]), self.going[k])
            if rest:
                under_way.add(s)
        return out, under_way

    def summary(self, first: int, end: int) -> tuple[list[int], list[int], list[int], int]:
        """What choosing states takes of a frame: its spare slots, the sources whose blocks are under way at its end, by
        deadline, the slot from which each may come, and how many blocks are under way at its start.
        """
        (before, at_first), (upto, at_end) = self.passed(first), self.passed(end)
        released = [
            self.window(s, j)[0] for s, n in enumerate(upto) for j in range(before[s] + (s in at_first), n)
        ]
        ranks = np.arange(len(released))
        # blocks that come as soon as they are released and a slot is free leave the spare slots
        busy = ranks + np.maximum.accumulate(np.sort(np.array(released, dtype=np.int64)) - ranks)
        spare = np.setdiff1d(np.arange(first, end), busy)
        windows = sorted((self.window(s, upto[s])[::-1], s) for s in at_end)
        return spare.tolist(), [s for _, s in windows], [release for (_, release), _ in windows], len(at_first)

    def frame(self, first: int, end: int, early: Iterable[int], late: Iterable[int]) -> list[tuple[int, int, int, int, int]]:
        """``(source, block, release, deadline, slot)`` for the slots from ``first`` to before ``end``, where the blocks
        under way of the sources ``early`` have come before it and those of ``late`` come by its end.
        """
        come, upto = self.passed(first)[0], self.passed(end)[0]
        for s in early:
            come[s] += 1
        for s in late:
            upto[s] += 1
        waiting = [(first, s, j) for s, j in enumerate(come) if j < upto[s]]
        ready: list[tuple[int, int, int, int, int]] = []
        out = []
        for t in range(first, end):
            while waiting and waiting[0][0] <= t:
                _, s, j = heapq.heappop(waiting)
                release, deadline = self.window(s, j)
                if release > t:
                    heapq.heappush(waiting, (release, s, j))
                else:
                    heapq.heappush(ready, (min(deadline, end), s, j, release, deadline))
            due, s, j, release, deadline = heapq.heappop(ready)
            if due <= t:
                raise AssertionError("a block missed its deadline")
            out.append((s, j, release, deadline, t))
            if j + 1 < upto[s]:
                heapq.heappush(waiting, (t + 1, s, j + 1))
        if ready or waiting:
            raise AssertionError("a frame has more blocks than slots")
        return out


def states(summaries: Iterable[tuple[list[int], list[int], list[int], int]], frame: int) -> Iterator[list[int]]:
    """The sources whose blocks under way have come by the end of each frame, from the frames' summaries in order."""
    come: set[int] = set()
    for number, (spare, sources, releases, at_first) in enumerate(summaries):
        first = number * frame
        old = {s for s, release in zip(sources, releases, strict=True) if release < first}
        # blocks under way at the start that have not come and are due within the frame: any slot of it will do
        taken = at_first - len(come) - len(old - come)
        free = list(range(len(spare) + 1))  # the next free spare slot from each on

        def next_free(i: int, free: list[int] = free) -> int:
            root = i
            while free[root] != root:
                root = free[root]
            while free[i] != root:
                free[i], i = root, free[i]
            return root

        for i in range(taken):
            free[i] = i + 1
        chosen = {s for s in old if s in come}
        for s, release in zip(sources, releases, strict=True):
            if s not in chosen:
                i = next_free(bisect_left(spare, release))
                if i < len(spare):
                    free[i] = i + 1
                    chosen.add(s)
                    taken += 1
        if taken != len(spare):
            raise AssertionError("a frame is not filled")
        come = chosen
        yield sorted(come)


def schedule(spark: SparkSession, counts: Sequence[int], weights: Sequence[float], block: int, frame: int | None = None) -> DataFrame:
    """``(number, block, release, deadline, slot, first_position)`` for every block of every source.

    Tasks sum up the frames, the driver goes through the sums and chooses the states between them, and tasks schedule the frames. The driver
    sees about four numbers a source and frame; a frame holds ``FRAME_BLOCKS`` blocks a source, so that is few beside the blocks.
    """
    flow = Flow([-(-n // block) for n in counts], weights)
    frame = frame or max(FRAME_SLOTS, FRAME_BLOCKS * len(counts))
    frames = -(-flow.slots // frame)

    def ends(i: int) -> tuple[int, int]:
        return i * frame, min((i + 1) * frame, flow.slots)

    def sum_up(batches):
        for batch in batches:
            for i in batch["id"].to_pylist():
                spare, sources, releases, at_first = flow.summary(*ends(i))
                yield pa.RecordBatch.from_pylist([dict(id=i, spare=spare, sources=sources, releases=releases, at_first=at_first)], sums)

    def run(batches):
        for batch in batches:
            for i, early, late in zip(*(batch[c].to_pylist() for c in ("id", "early", "late")), strict=True):
                rows = flow.frame(*ends(i), early, late)
                s, j, release, deadline, slot = zip(*rows, strict=True)
                docs = [min(block, counts[a] - b * block) for a, b in zip(s, j, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, pa.int64()) for v in (s, j, release, deadline, slot, docs)],
                    ["number", "block", "release", "deadline", "slot", "docs"],
                )

    many = pa.list_(pa.int64())
    sums = pa.schema([("id", pa.int64()), ("spare", many), ("sources", many), ("releases", many), ("at_first", pa.int64())])
    parts = max(1, min(frames, parallelism(spark)))
    kind = "id long, spare array<long>, sources array<long>, releases array<long>, at_first long"
    found = spark.range(0, frames, 1, parts).mapInArrow(sum_up, kind).collect()
    found = [(r["spare"], r["sources"], r["releases"], r["at_first"]) for r in sorted(found, key=lambda r: r["id"])]
    late = list(states(found, frame))
    between = [(i, late[i - 1] if i else [], late[i]) for i in range(frames)]
    planned = spark.createDataFrame(between, "id long, early array<long>, late array<long>").repartition(parts)
    made = planned.mapInArrow(run, "number long, block long, release long, deadline long, slot long, docs long")
    return global_positions(step(made, "blocks"), ["slot"], "docs").drop("docs").withColumnRenamed("position", "first_position")


def tempered(counts: Mapping[str, int], temperature: float = TEMPERATURE) -> dict[str, float]:
    """Target weights in proportion to a power of the sizes: 1 keeps the proportions, 0 makes all equal."""
    return {s: n**temperature for s, n in counts.items()}


def mix(
    docs: DataFrame, targets: Mapping[str, float] | None = None, block: int = BLOCK_DOCS, period: int | None = None,
    max_sources: int | None = None,
) -> DataFrame:
    """``(doc_id, text_hash, copy, source, stream, block, release, deadline, slot, position)``: where every row comes in the mixture.

    After every block, each source has had what flows from it by the exact target weights, to less than one block: its share
    of all blocks while all sources last; when a source is used up, the others go on by their weights. Blocks hold
    ``block`` documents of one source (its last one may hold fewer), in an order given by a hash of the id. Nothing is
    dropped or repeated. ``period`` rounds the weights to whole slots of so many, at least one a source.

    ``targets`` gives weights by source (those not named weigh as the least named; none, or one that is not positive and finite, is an error);
    by default weights are tempered sizes. A null source is the source "". Every source is scheduled; only a
    caller's ``max_sources`` makes one stream of all but the largest and those named, by the sum of their weights. Rows without an id take part. Rows equal in id, text and source follow one another, numbered by ``copy``.
    An empty table gives no rows.

    Only ids, hashes and sources are sorted. A source that holds a third of all rows is cut by the range
    sort like any other. The driver holds one number of rows and one weight a source, and a state per frame of slots; blocks are
    scheduled by the workers. A row that got no slot would stop the job.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_hash"),
        F.col("source").cast("string").alias("source"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("name"),
    )
    rows = step(rows.groupBy("doc_id", "text_hash", "source", "name").agg(F.count(F.lit(1)).alias("copies")), "rows")
    sizes = rows.groupBy("name").agg(F.sum("copies").alias("n"))
    counts = {r["name"]: r["n"] for r in sizes.collect()}
    weights = tempered(counts)
    if targets is not None:
        if not targets or not all(0 < w < math.inf for w in targets.values()):
            raise ValueError("target weights must be positive and finite")
        least = min(targets.values())
        weights = {s: targets.get(s, least) for s in counts}

    if max_sources is not None:
        largest = sorted(counts, key=lambda s: (-counts[s], s.encode()))
        pooled = [s for s in largest[max_sources:] if s not in (targets or {})]
    else:
        pooled = []
    own = sorted(counts.keys() - set(pooled))
    if pooled:
        counts[OTHERS] = sum(counts.pop(s) for s in pooled)
        weights[OTHERS] = math.fsum(weights.pop(s) for s in pooled)
    if period is not None and counts:
        weights = shares(weights, period)

    streams = sorted(counts, key=lambda s: s.encode())
    starts, upto = [], 0
    for s in streams:
        starts.append(upto)
        upto += counts[s]
    planned = spark.createDataFrame([(s, i, starts[i]) for i, s in enumerate(streams)], "stream string, number long, start long")
    if pooled:
        named = spark.createDataFrame([(s, s) for s in own], "name string, own string")
        rows = skew.lookup_join(rows, named, "name").withColumn("stream", F.coalesce("own", F.lit(OTHERS))).drop("own", "name")
    else:
        rows = rows.withColumnRenamed("name", "stream")
    rows = rows.withColumn("key", F.xxhash64("doc_id", F.lit("mix")))
    order = ["stream", "key", "doc_id", "text_hash", "source"]
    placed = skew.lookup_join(global_positions(rows, order, "copies"), planned, "stream", "inner")
    placed = per_copy(placed, "copies", "copy")
    inside = F.col("position") + F.col("copy") - F.col("start")
    placed = placed.withColumn("block", F.floor(inside / block).cast("long")).withColumn("within", inside % block).drop("position")
    blocks = schedule(spark, [counts[s] for s in streams], [weights[s] for s in streams], block)
    position = F.coalesce(F.col("first_position") + F.col("within"), F.raise_error(F.lit("a block has no slot")))
    return placed.join(blocks, ["number", "block"], "left").select(
        "doc_id", "text_hash", "copy", "source", "stream", "block", "release", "deadline", "slot", position.cast("long").alias("position"),
    )


def op7_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mix(table(spark, sf, "documents")).drop("text_hash", "copy", "stream")


QUERIES = {"op7_mixing": op7_mixing}
ORACLES: dict[str, str] = {}
