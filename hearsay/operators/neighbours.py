"""The nearest neighbours of every row: seeded from blocks along random directions, mended by neighbours of neighbours."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearsay.arrays import arrays, bits_for, shard_of, write_shards
from hearsay.operators.skew import top_n_per_group
from hearsay.session import cut_lineage, scratch_path

NEIGHBOURS = 15
ORDERS = 6
BLOCK_ROWS = 512
TASK_BLOCKS = 32
ROUNDS = 8
SETTLED = 0.001
SHARD_ROWS = 100_000
CHUNK_BYTES = 16 << 20
NEAR = "id long, near array<struct<distance: double, other: long>>"


class _Stored:
    """Rows by id in sorted arrays of the shared folder, where tasks look up ``fields``: lists of so many numbers of a kind each."""

    def __init__(self, rows: DataFrame, name: str, fields: dict[str, tuple[str, int]]):
        self.folder, self.name, self.fields = scratch_path(rows.sparkSession, name), name, fields
        self.bits = bits_for(rows.count(), SHARD_ROWS)
        layout = [("key", "i8"), *((f, kind, (width,)) for f, (kind, width) in fields.items())]

        def build(held):
            order = np.argsort(held["key"])
            out = np.empty(len(order), dtype=layout)
            out["key"] = held["key"][order]
            for f, (_, width) in fields.items():
                out[f] = np.stack([held[f"{f}{i}"] for i in range(width)], axis=1)[order]
            return {"": out}

        # the hash of a number is another number, so no two ids share one, and shards are even whatever the ids; copies share a shard
        wide = [F.get(f, F.lit(i)).alias(f"{f}{i}") for f, (_, width) in fields.items() for i in range(width)]
        keyed = rows.select(F.xxhash64("id").alias("key"), *wide).withColumn("__shard", shard_of("key", self.bits))
        dealt = keyed.repartition(1 << self.bits, "__shard").sortWithinPartitions("__shard")
        write_shards(dealt, self.folder, name, build).agg(F.count(F.lit(1))).collect()

    def find(self, keys: np.ndarray, field: str) -> np.ndarray:
        kind, width = self.fields[field]
        return arrays(self.folder, self.name, self.bits).matrix(keys, field, width, kind)

    def every(self, keys: np.ndarray, field: str) -> tuple[np.ndarray, np.ndarray]:
        """All rows of each key, in the order of the keys, and which key they are of."""
        return arrays(self.folder, self.name, self.bits).every(keys, field, self.fields[field][1])


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of rows to rows by their differences, so that near rows stay exact."""
    return np.sqrt(((x - y) ** 2).sum(axis=-1))


def _rough(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of all rows of each matrix by products, and how far they may be off; neither is a number where products overflow."""
    with np.errstate(over="ignore", invalid="ignore"):
        squares = (x * x).sum(axis=-1)
        length = np.sqrt(squares)
        off = (x.shape[-1] + 16) * 1e-15 * (length[..., :, None] + length[..., None, :]) ** 2
        return squares[..., :, None] + squares[..., None, :] - 2 * (x @ np.swapaxes(x, -1, -2)), off


def _blank(ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(ids[:, None], k, axis=1), np.full((len(ids), k), np.nan)


def _nearest(ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and distances of the ``k`` nearest of a block's rows to each of them, ties to the smaller id; a row with fewer has no distances at the end.

    Products tell which rows may be among them, and only for these the differences are worked out.
    """
    n = len(ids)
    rough, off = _rough(vectors)
    with np.errstate(invalid="ignore"):
        low, high = rough - off, rough + off
    own = np.arange(n)
    high[own, own] = np.inf
    most = min(k, n - 1)
    limit = np.partition(np.where(np.isnan(high), np.inf, high), most - 1, axis=1)[:, most - 1]
    may = ~(low > limit[:, None])
    may[own, own] = False
    row, col = np.nonzero(may)
    apart = np.empty(len(row))
    step = max(1, CHUNK_BYTES // (8 * vectors.shape[1])) if vectors.shape[1] else max(1, len(row))
    for a in range(0, len(row), step):
        apart[a : a + step] = _apart(vectors[row[a : a + step]], vectors[col[a : a + step]])
    order = np.lexsort((ids[col], apart, row))
    row, col, apart = row[order], col[order], apart[order]
    at = np.arange(len(row)) - np.searchsorted(row, own)[row]
    kept = at < most
    found, distances = _blank(ids, k)
    found[row[kept], at[kept]] = ids[col[kept]]
    distances[row[kept], at[kept]] = apart[kept]
    return found, distances


def _merged(one: tuple, two: tuple) -> tuple[np.ndarray, np.ndarray]:
    """The nearest of two lists for each row, each other row once."""
    k = one[0].shape[1]
    found, apart = np.concatenate([one[0], two[0]], axis=1), np.concatenate([one[1], two[1]], axis=1)
    for _ in range(2):
        order = np.lexsort((found, apart), axis=1)
        found, apart = np.take_along_axis(found, order, axis=1), np.take_along_axis(apart, order, axis=1)
        apart[:, 1:][(found[:, 1:] == found[:, :-1]) & (apart[:, 1:] == apart[:, :-1])] = np.nan
    return found[:, :k], apart[:, :k]


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch["v"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _lists(ids: np.ndarray, others: np.ndarray, distances: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """A row of ``NEAR`` for each id, which has so many of the others."""
    each = pa.StructArray.from_arrays([pa.array(distances, pa.float64()), pa.array(others, pa.int64())], ["distance", "other"])
    near = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), each)
    return pa.RecordBatch.from_arrays([pa.array(ids), near], ["id", "near"])


def _in_blocks(k: int, rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        ids, vectors, best = np.zeros(0, dtype=np.int64), None, _blank(np.zeros(0, dtype=np.int64), k)

        def block():
            merged = _merged(tuple(b[:rows] for b in best), _nearest(ids[:rows], vectors[:rows], k))
            return tuple(np.concatenate([m, b[rows:]]) for m, b in zip(merged, best, strict=True))

        def done(n):
            held = ~np.isnan(best[1][:n])
            return _lists(ids[:n], best[0][:n][held], best[1][:n][held], held.sum(axis=1))

        for batch in batches:
            new = batch["id"].to_numpy()
            ids = np.concatenate([ids, new])
            vectors = _matrix(batch) if vectors is None else np.concatenate([vectors, _matrix(batch)])
            best = tuple(np.concatenate(x) for x in zip(best, _blank(new, k), strict=True))
            while len(ids) >= 2 * rows:
                best = block()
                # half a block is met again, so that rows at an end have neighbours on both sides
                yield done(rows // 2)
                ids, vectors, best = ids[rows // 2 :], vectors[rows // 2 :], tuple(b[rows // 2 :] for b in best)
        while len(ids) > 1:
            best = block()
            if len(ids) <= rows:
                yield done(len(ids))
                break
            yield done(rows // 2)
            ids, vectors, best = ids[rows // 2 :], vectors[rows // 2 :], tuple(b[rows // 2 :] for b in best)

    return run


def _join_locally(k: int, vectors: _Stored, known: _Stored) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows that share a neighbour meet at it: each gets those of the others there which its list has not and which are no farther than its last."""

    def run(batches):
        for batch in batches:
            keys = batch["keys"]
            widest = int(keys.value_lengths().to_numpy().max()) if batch.num_rows else 0
            step = max(1, CHUNK_BYTES // (8 * max(1, widest * max(widest, vectors.fields["v"][1]))))
            for a in range(0, batch.num_rows, step):
                out = meet(batch.slice(a, step))
                if out is not None:
                    yield out

    def meet(batch):
        lists, members = batch["keys"], batch["ids"].flatten().to_numpy()
        counts = lists.value_lengths().to_numpy().astype(np.int64)
        keys, at, where = np.unique(lists.flatten().to_numpy(), return_index=True, return_inverse=True)
        ids, n = members[at], len(keys)
        owner, rows = vectors.every(keys, "v")
        lasts, sizes, has = known.find(keys, "last")[:, 0], known.find(keys, "size")[:, 0], known.find(keys, "near")
        width = int(counts.max())
        inside = np.arange(width)[None, :] < counts[:, None]
        lone = np.ones(len(counts), dtype=bool)
        pairs = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))]
        if len(owner) > n:  # ids with several rows, which meet one by one
            first, end = np.searchsorted(owner, np.arange(n)), np.cumsum(counts)
            more = np.bincount(owner, minlength=n)
            for g in np.flatnonzero(np.add.reduceat(more[where] > 1, end - counts, dtype=np.int64)):
                lone[g] = False
                own = where[end[g] - counts[g] : end[g]]
                all_rows = np.concatenate([np.arange(first[x], first[x] + more[x]) for x in own])
                found, apart = _nearest(ids[owner[all_rows]], rows[all_rows], k)
                held = ~np.isnan(apart)
                pairs.append((np.repeat(owner[all_rows], held.sum(axis=1)), found[held], apart[held]))
            rows = rows[first]
        place = np.zeros(inside.shape, dtype=np.int64)
        place[inside] = where
        rough, off = _rough(rows[place])
        with np.errstate(invalid="ignore", over="ignore"):
            may = ~(rough - off > (lasts[place] ** 2 * (1 + 1e-12))[:, :, None])
        may &= inside[:, :, None] & inside[:, None, :] & ~np.eye(width, dtype=bool) & lone[:, None, None]
        group, one, two = np.nonzero(may)
        pair = np.unique(place[group, one] * n + place[group, two])
        row, col = pair // n, pair % n
        new = np.ones(len(row), dtype=bool)
        for i in range(has.shape[1]):
            new &= (has[row, i] != ids[col]) | (sizes[row] <= i)
        row, col = row[new], col[new]
        apart = np.empty(len(row))
        some = max(1, CHUNK_BYTES // (8 * max(1, rows.shape[1])))
        for a in range(0, len(row), some):
            apart[a : a + some] = _apart(rows[row[a : a + some]], rows[col[a : a + some]])
        pairs.append((row, ids[col], apart))
        row, other, apart = (np.concatenate(x) for x in zip(*pairs, strict=True))
        near = ~(apart > lasts[row])
        row, other, apart = row[near], other[near], apart[near]
        order = np.lexsort((other, apart, row))
        row, other, apart = row[order], other[order], apart[order]
        again = np.zeros(len(row), dtype=bool)
        again[1:] = (row[1:] == row[:-1]) & (other[1:] == other[:-1]) & (apart[1:] == apart[:-1])
        row, other, apart = row[~again], other[~again], apart[~again]
        best = np.arange(len(row)) - np.searchsorted(row, row) < k
        found, held = np.unique(row[best], return_counts=True)
        return _lists(ids[found], other[best], apart[best], held) if len(found) else None

    return run


def _best(lists: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest of each row's candidates, of which there are boundedly many."""
    return lists.groupBy("id").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))), 1, k).alias("near"))


def neighbours(
    rows: DataFrame, k: int = NEIGHBOURS, orders: int = ORDERS, block_rows: int = BLOCK_ROWS, rounds: int = ROUNDS, seed: int = 50
) -> DataFrame:
    """``(id, other, distance, rank)``: about the ``k`` nearest rows to every row of ``rows(id long, v array<double>)``, at most ``k`` each.

    Rows are sorted along ``orders`` random directions and meet in blocks of ``block_rows`` neighbours of the
    order (with up to so many rows in all, that is everyone, and the result exact). Then neighbours of neighbours meet: in each round, at every row, the
    rows near it and up to ``k`` of those it is near to; each keeps its nearest. It ends after ``rounds``, or when fewer than one in a thousand of the pairs
    change. So a task holds a block, a row meets a bounded number of others, and no pair of all rows is formed. Distances are
    Euclidean; ties go to the smaller id. Ids are unique, vectors of one length and finite.

    Vectors travel once a direction. For the rounds they are written as sorted arrays in the shared folder (``hearsay.arrays``), where meetings look them up, as
    they do the lists of a round: what is shuffled are ids, and pairs nearer than those a row has. ``rows`` should be staged: it is read several times.
    """
    n, dims, most, whole = rows.agg(F.count(F.lit(1)), F.min(F.size("v")), F.max(F.size("v")), F.count("v")).first()
    if n < 2:
        return rows.sparkSession.createDataFrame([], "id long, other long, distance double, rank int")
    if dims != most or whole < n:
        raise ValueError("vectors must be of one length")
    rng = np.random.default_rng(seed)
    parts = max(1, n // (block_rows * TASK_BLOCKS))
    everyone = n <= block_rows
    found = None
    for _ in range(1 if everyone else orders):
        direction = F.array(*[F.lit(float(x)) for x in rng.standard_normal(dims)])
        along = F.aggregate(F.zip_with("v", direction, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        dealt = rows.select("id", "v", along.alias("along")).repartitionByRange(parts, "along", "id").sortWithinPartitions("along", "id")
        lists = dealt.select("id", "v").mapInArrow(_in_blocks(k, block_rows), NEAR)
        found = lists if found is None else found.union(lists)
    vectors = None if everyone else _Stored(rows, "vectors", {"v": ("f8", dims)})
    graph = cut_lineage(_best(found, k))
    for _ in range(0 if everyone else rounds):
        # a list that is not full has no last
        last = F.when(F.size("near") >= k, F.get("near.distance", F.lit(k - 1))).otherwise(F.lit(float("inf")))
        full = F.concat("near.other", F.array_repeat("id", F.lit(k) - F.size("near")))
        held = graph.select("id", F.array(last).alias("last"), F.array(F.size("near")).alias("size"), full.alias("near"))
        known = _Stored(held, "lists", {"last": ("f8", 1), "size": ("i8", 1), "near": ("i8", k)})
        back = graph.select(F.explode("near.other").alias("centre"), "id")
        # a row that is near to very many meets some of them, by a hash
        some = top_n_per_group(back, ["centre"], [F.xxhash64("centre", "id"), F.col("id")], k)
        backs = some.groupBy("centre").agg(F.collect_list("id").alias("back")).withColumnRenamed("centre", "id")
        there = F.array_union(F.concat("near.other", F.array("id")), F.coalesce("back", F.array().cast("array<bigint>")))
        met = graph.join(backs, "id", "left").select(there.alias("ids"))
        met = met.select("ids", F.transform("ids", lambda x: F.xxhash64(x)).alias("keys"))
        nearer = _best(met.mapInArrow(_join_locally(k, vectors, known), NEAR), k).withColumnRenamed("near", "more")
        merged = F.slice(F.array_sort(F.array_union("near", "more")), 1, k)
        now = F.when(F.col("more").isNull(), F.col("near")).otherwise(merged)
        changes = F.size(F.array_except("now.other", "near.other"))
        after = cut_lineage(graph.join(nearer, "id", "left").withColumn("now", now).select("id", F.col("now").alias("near"), changes.alias("changed")))
        graph = after.select("id", "near")
        if after.agg(F.sum("changed")).first()[0] <= SETTLED * n * k:
            break
    return graph.select("id", F.posexplode("near").alias("at", "n")).select(
        "id", "n.other", "n.distance", (F.col("at") + 1).alias("rank")
    )
