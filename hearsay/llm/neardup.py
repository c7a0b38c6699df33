"""Near-duplicate vectors by spherical-cap filters from structured random product codes."""

from __future__ import annotations

import math
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearsay.llm import components
from hearsay.llm.common import lists, table
from hearsay.llm.topk import whole_vector
from hearsay.session import stage

THRESHOLD = 0.95
BLOCKS = 2
TABLES = 6
BUCKET_ROWS = 48
SHARED_FILTERS = 10.0
LEAST_FILTERS = 16
BLOCK_ROWS = 256


class Filters:
    """``TABLES`` turned copies of one scheme: all concatenations of one code word per block, ``codes ** BLOCKS`` directions each.

    A vector belongs to every direction whose inner product with it reaches ``cap``. Everything follows
    from the dimension and the size, so that every task makes the same filters.
    """

    def __init__(self, dim: int, codes: int, cap: float, tables: int = TABLES, seed: int = 7):
        rng = np.random.default_rng(seed + dim)
        self.dim, self.codes, self.cap = dim, codes, cap
        self.cuts = [int(c) for c in np.linspace(0, dim, min(BLOCKS, dim) + 1)]
        self.each = codes ** (len(self.cuts) - 1)
        self.turns, self.words = [], []
        for _ in range(tables):
            self.turns.append(np.linalg.qr(rng.standard_normal((dim, dim)))[0])
            words = []
            for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True):
                word = rng.standard_normal((codes, b - a))
                words.append(word * math.sqrt((b - a) / dim) / np.linalg.norm(word, axis=1, keepdims=True))
            self.words.append(words)

    def decode(self, units: np.ndarray, least: int = 0, rows_at_once: int = 4096) -> tuple[np.ndarray, np.ndarray]:
        """Rows and the filters they exceed, in this order. Rows with fewer than ``least`` get a lower cap of their own."""
        found = []
        for start in range(0, len(units), rows_at_once):
            part = units[start : start + rows_at_once]
            some, cap = np.arange(len(part)), self.cap
            while len(some):
                tables = [self._decode(part[some] @ t, w, cap) for t, w in zip(self.turns, self.words, strict=True)]
                row = np.concatenate([r for r, _ in tables])
                code = np.concatenate([c + i * self.each for i, (_, c) in enumerate(tables)])
                enough = np.bincount(row, minlength=len(some)) >= min(least, self.each * len(tables))
                keep = enough[row]
                found.append((some[row[keep]] + start, code[keep]))
                some, cap = some[~enough], cap - 0.25 / math.sqrt(self.dim)
        if not found:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        rows, filters = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((filters, rows))
        return rows[order], filters[order]

    def _decode(self, turned: np.ndarray, words: list[np.ndarray], cap: float) -> tuple[np.ndarray, np.ndarray]:
        """Pruned enumeration, block by block: a beginning that cannot reach the cap is left."""
        parts = [turned[:, a:b] @ w.T for a, b, w in zip(self.cuts[:-1], self.cuts[1:], words, strict=True)]
        rest = np.zeros((len(parts) + 1, len(turned)))
        for k in range(len(parts) - 1, -1, -1):
            rest[k] = rest[k + 1] + parts[k].max(axis=1)
        row, code, total = np.arange(len(turned)), np.zeros(len(turned), dtype=np.int64), np.zeros(len(turned))
        step = max(1, (4 << 20) // self.codes)
        for k, part in enumerate(parts):
            rows, codes, totals = [row[:0]], [code[:0]], [total[:0]]
            for a in range(0, len(row), step):
                r = row[a : a + step]
                sums = total[a : a + step, None] + part[r]
                i, j = np.nonzero(sums + rest[k + 1][r][:, None] >= cap)
                rows.append(r[i])
                codes.append(code[a : a + step][i] * self.codes + j)
                totals.append(sums[i, j])
            row, code, total = np.concatenate(rows), np.concatenate(codes), np.concatenate(totals)
        return row, code


@lru_cache(maxsize=16)
def filters_for(dim: int, n_rows: int, threshold: float = THRESHOLD) -> Filters:
    """Filters for a number of vectors: caps of ``BUCKET_ROWS`` rows, ``SHARED_FILTERS`` shared ones.

    The cap is lowered until two vectors at exactly the threshold share that many filters on average
    over simulated pairs. Several tables make a pair that shares none far rarer than one table of as many filters.
    """
    rng = np.random.default_rng(11)
    x = rng.standard_normal((400, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((400, dim))
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-300)
    y = threshold * x + math.sqrt(1 - threshold**2) * y
    per_row = 2 * SHARED_FILTERS
    codes = max(2, math.ceil((per_row * max(n_rows, 1) / BUCKET_ROWS / TABLES) ** (1 / min(BLOCKS, dim))))
    share = min(0.5, per_row / (TABLES * codes ** min(BLOCKS, dim)))
    cap = NormalDist().inv_cdf(1 - share) / math.sqrt(dim)
    while True:
        made = Filters(dim, codes, cap)
        a, b = made.decode(x), made.decode(y)
        total = TABLES * made.each
        shared = len(np.intersect1d(a[0] * total + a[1], b[0] * total + b[1]))
        if shared >= SHARED_FILTERS * len(x) or cap <= -2:
            return made
        cap -= 0.02 / math.sqrt(dim) * 2


def _units(vectors: pa.Array, dim: int) -> np.ndarray:
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _caps(n_rows: int, threshold: float):
    def caps(batches):
        for batch in batches:
            sizes = batch["dim"].to_numpy()
            for dim in np.unique(sizes):
                part = batch.filter(pa.array(sizes == dim))
                rows, found = filters_for(int(dim), n_rows, threshold).decode(_units(part["v"], int(dim)), LEAST_FILTERS)
                counts = np.bincount(rows, minlength=part.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, lists(found, counts, pa.int64())], [*part.schema.names, "filters"]
                )

    return caps


def _earlier(a: pa.Array, b: pa.Array, key: int) -> np.ndarray:
    """For all pairs of rows, whether they share a filter before ``key``."""
    def flat(x):
        values, lengths = x.flatten().to_numpy(), x.value_lengths().to_numpy()
        rows = np.repeat(np.arange(len(x)), lengths)
        return values[values < key], rows[values < key]

    (va, ra), (vb, rb) = flat(a), flat(b)
    both = np.intersect1d(va, vb)
    hit = np.zeros((len(a), len(b)), dtype=np.float32)
    for start in range(0, len(both), 4096):
        some = both[start : start + 4096]
        left, right = (np.zeros((n, len(some)), dtype=np.float32) for n in (len(a), len(b)))
        for values, rows, side in ((va, ra, left), (vb, rb, right)):
            at = np.searchsorted(some, values)
            ok = (at < len(some)) & (some[np.minimum(at, len(some) - 1)] == values)
            side[rows[ok], at[ok]] = 1
        hit += left @ right.T
    return hit > 0


def _verify(threshold: float):
    def verify(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        key, dim = group["filter"][0].as_py(), group["dim"][0].as_py()
        side = group["block"].to_numpy()
        lo, hi = group["lo"][0].as_py(), group["hi"][0].as_py()
        a, b = (group.filter(pa.array(side == s)).combine_chunks() for s in (lo, hi))
        out_id, out_n, out_to = [], [], []
        near = np.zeros((0, 0), dtype=bool)
        if a.num_rows and b.num_rows:
            near = _units(a["v"].combine_chunks(), dim) @ _units(b["v"].combine_chunks(), dim).T >= threshold
            if lo == hi:
                np.fill_diagonal(near, False)
            some = [np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))]
            if len(some[0]):  # in most filters no pair is near
                before = [x["filters"].combine_chunks().take(pa.array(at)) for x, at in zip((a, b), some, strict=True)]
                near[np.ix_(*some)] &= ~_earlier(*before, key)
        if near.any():
            ids = [x["rep"].to_numpy() for x in (a, b)]
            copies = [x["copies"].to_numpy() for x in (a, b)]
            both = np.concatenate(ids)
            if lo == hi:
                label = components.smallest(near, ids[0], ids[0])[0]
                counts = near @ copies[0]
                both = ids[0]
            else:
                label = np.concatenate(components.smallest(near, *ids))
                counts = np.concatenate([near @ copies[1], near.T @ copies[0]])
            linked = counts > 0
            out_id, out_n, out_to = both[linked], counts[linked], label[linked]
        return pa.table(
            [pa.array(out_id, pa.int64()), pa.array(out_n, pa.int64()), pa.array(out_to, pa.int64())],
            ["rep", "n", "to"],
        )

    return verify


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD
) -> DataFrame:
    """``(id_col, n_links, component_id, kept)`` for every id: how many others are linked to it, and
    the smallest id reachable by links (cosine in double precision at or above ``threshold``).

    Vectors that are null, zero, empty or hold null or non-finite components link with nothing;
    vectors of unequal length are never linked. Rows without an id are left out. Repeated rows count
    once; of several vectors under one id the least usable one in array order stays.

    Equal vectors are one class with a number of copies. Each class is list-decoded to all filter
    directions it exceeds; classes meet per filter and every meeting pair is verified. A filter with
    many rows is cut into blocks, and each pair of blocks is a task of its own; it sends the number of
    links and one smallest link per vector, never the pairs. A pair that shares several filters counts
    at the first. Of pairs just at the threshold nearly all are found, of
    closer ones all but a vanishing share; tests hold the recall against brute force. The number of filters follows the number of vectors, so
    the work per vector stays the same.
    """
    # vectors travel as wide as they came; cosines are in double precision either way
    kind = "float" if isinstance(getattr(vectors.schema[vector_col].dataType, "elementType", None), T.FloatType) else "double"
    v = F.transform(F.col(vector_col), lambda x: x.cast(kind) + F.lit(0.0).cast(kind))
    usable = whole_vector(F.col(vector_col)) & F.exists(vector_col, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.when(usable, v).alias("v"))
    rows = rows.filter("id is not null").groupBy("id").agg(F.min("v").alias("v"))
    classes = rows.filter("v is not null").groupBy("v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    classes = stage(classes.select("rep", "copies", "v", F.size("v").alias("dim")), "vectors")
    n_rows = classes.count()
    caps = classes.mapInArrow(_caps(n_rows, threshold), f"rep long, copies long, v array<{kind}>, dim int, filters array<long>")
    caps = stage(caps, "caps")

    met = caps.select("rep", "dim", F.explode("filters").alias("filter"))
    sizes = met.groupBy("dim", "filter").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    sizes = sizes.select("dim", "filter", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("blocks"))
    dealt = met.join(sizes, ["dim", "filter"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = dealt.select("rep", F.struct("dim", "filter", "block", "blocks").alias("d"))
    dealt = dealt.groupBy("rep").agg(F.collect_list("d").alias("d"))  # as many as the vector has filters
    pairs = (
        caps.drop("dim").join(dealt, "rep")
        .select("rep", "copies", "v", "filters", F.explode("d").alias("d"))
        .select("rep", "copies", "v", "filters", "d.*")
        .withColumn("filters", F.filter("filters", lambda x: x < F.col("filter")))  # what a pair may have shared before
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("rep", "copies", "v", "filters", "dim", "filter", "block",
                F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi"))
    )
    links = stage(pairs.groupBy("dim", "filter", "lo", "hi").applyInArrow(_verify(threshold), "rep long, n long, to long"), "links")
    counts = links.groupBy("rep").agg(F.sum("n").alias("n"))
    found = components.connected(links.filter("rep <> to").select(F.col("rep").alias("a"), F.col("to").alias("b")))

    classes = (
        classes.join(counts, "rep", "left").join(found.withColumnRenamed("id", "rep"), "rep", "left")
        .select("v", "copies", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("component", "rep").alias("component"))
    )
    joined = rows.join(classes, "v", "left")
    component = F.coalesce("component", "id")
    return joined.select(
        F.col("id").alias(id_col),
        F.coalesce(F.col("n") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"),
        component.cast("long").alias("component_id"),
        (component == F.col("id")).alias("kept"),
    )


def op2_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(table(spark, sf, "embeddings"))


SQL = """
with recursive r as (
  select vec_id, min(case when embedding is not null
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
      and len(list_filter(embedding, lambda x: x <> 0)) > 0 then cast(embedding as double[]) end) as v
  from embeddings where vec_id is not null group by vec_id),
l as (
  select a.vec_id as a, b.vec_id as b from r a join r b on a.vec_id <> b.vec_id and len(a.v) = len(b.v)
  where list_cosine_similarity(a.v, b.v) >= 0.95),
reach(id, c) as (select vec_id, vec_id from r union select reach.id, l.b from reach join l on l.a = reach.c)
select r.vec_id, (select count(*) from l where l.a = r.vec_id) as n_links,
  m.c as component_id, m.c = r.vec_id as kept
from r join (select id, min(c) as c from reach group by id) m on m.id = r.vec_id"""

QUERIES = {"op2_near_duplicates": op2_near_duplicates}
ORACLES = {"op2_near_duplicates": SQL}
