"""Exact top-k search by term-at-a-time accumulation over sparse rows."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hearsay.llm.common import table

FOUND = "query_id long, vec_id long, score long"


def _postings(terms: np.ndarray, rows: np.ndarray, weights: np.ndarray):
    """Sorted terms with the rows and weights of each; entries of one term and row are added up."""
    order = np.lexsort((rows, terms))
    terms, rows, weights = terms[order], rows[order], weights[order]
    if len(terms):
        first = np.flatnonzero(np.r_[True, (terms[1:] != terms[:-1]) | (rows[1:] != rows[:-1])])
        terms, rows, weights = terms[first], rows[first], np.add.reduceat(weights, first)
    heads = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]]) if len(terms) else np.zeros(0, dtype=np.int64)
    ends = np.r_[heads[1:], len(terms)]
    return {int(terms[a]): (rows[a:b], weights[a:b]) for a, b in zip(heads, ends, strict=True)}


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    whole = column.combine_chunks()
    lengths = whole.value_lengths().to_numpy()
    return whole.flatten().to_numpy(), lengths.astype(np.int64)


def _search(k: int):
    def search(corpus: pa.Table, queries: pa.Table) -> pa.Table:
        ids = corpus["id"].to_numpy()
        terms, lengths = _flat(corpus["terms"])
        weights, _ = _flat(corpus["weights"])
        postings = _postings(terms, np.repeat(np.arange(len(ids)), lengths), weights)
        q_ids = queries["id"].to_numpy()
        q_terms, q_lengths = _flat(queries["terms"])
        q_weights, _ = _flat(queries["weights"])
        ends = np.cumsum(q_lengths)
        out = []
        for q, end, n in zip(q_ids, ends, q_lengths, strict=True):
            scores = np.zeros(len(ids), dtype=np.int64)
            for term, weight in zip(q_terms[end - n : end], q_weights[end - n : end], strict=True):
                hit = postings.get(int(term))
                if hit is not None:
                    scores[hit[0]] += weight * hit[1]
            keep = np.flatnonzero(ids != q)
            if len(keep) > k:
                least = np.partition(scores[keep], len(keep) - k)[len(keep) - k]
                keep = keep[scores[keep] >= least]
            keep = keep[np.lexsort((ids[keep], -scores[keep]))[:k]]
            out.append((np.full(len(keep), q), ids[keep], scores[keep]))
        columns = [np.concatenate(c) if out else np.zeros(0, dtype=np.int64) for c in zip(*out, strict=True)] or [
            np.zeros(0, dtype=np.int64)
        ] * 3
        return pa.table([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

    return search


def topk(corpus: DataFrame, queries: DataFrame, k: int = 10, block_rows: int = 4096) -> DataFrame:
    """The ``k`` rows of ``corpus`` with the highest inner product for every row of ``queries``.

    Both hold ``id long``, ``terms array<int>`` and ``weights array<long>`` (a sparse row; a term given
    twice counts twice). Every query meets every row but those with its own id, zero scores included;
    ties go to the smaller id; fewer than ``k`` rows give fewer results. Sums wrap beyond 64 bits.

    Both sides are cut into blocks by a hash of the id. A block of queries and a block of the corpus
    meet in one task, which scatters each query's weighted postings into a dense score array and
    keeps the best ``k``; the partial lists are then ranked per query. Memory is that of two blocks,
    and no side is broadcast or collected.
    """
    n_corpus, n_queries = corpus.count(), queries.count()
    corpus_blocks = max(1, math.ceil(n_corpus / block_rows))
    query_blocks = max(1, math.ceil(n_queries / block_rows))

    def in_blocks(df: DataFrame, own: str, blocks: int, other: str, others: int) -> DataFrame:
        return df.select(
            "id", "terms", "weights",
            F.pmod(F.xxhash64("id", F.lit(own)), F.lit(blocks)).cast("int").alias(own),
            F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other),
        )

    left = in_blocks(corpus, "corpus_block", corpus_blocks, "query_block", query_blocks)
    right = in_blocks(queries, "query_block", query_blocks, "corpus_block", corpus_blocks)
    keys = ["corpus_block", "query_block"]
    partial = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_search(k), FOUND)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        partial.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )


def whole_vector(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite."""
    inner = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(inner, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & ~bad


def quantised(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Sparse rows of floor(1024 * x), one per id.

    Vectors that are null or hold null or non-finite components, and rows without an id, take no
    part. Repeated rows count once; of several vectors under one id the least in array order stays.
    A missing component (vectors of unequal length) counts as zero.
    """
    vectors = (
        embeddings.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
        .filter(F.col("id").isNotNull() & whole_vector(F.col("v")))
        .groupBy("id").agg(F.min("v").alias("v"))
    )
    cells = F.transform("v", lambda x, i: F.struct(i.alias("t"), F.floor(x.cast("double") * 1024.0).cast("long").alias("w")))
    rows = vectors.select("id", F.filter(cells, lambda c: c["w"] != 0).alias("c"))
    return rows.select("id", F.col("c.t").alias("terms"), F.col("c.w").alias("weights"))


def op1_topk(spark: SparkSession, sf: str) -> DataFrame:
    rows = quantised(table(spark, sf, "embeddings"))
    return topk(rows, rows.filter(F.pmod("id", F.lit(100)) == 0), k=10)


SQL = """
with v as (
  select vec_id, min(list_transform(embedding, lambda x: floor(1024e0 * cast(x as double)))) as e
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
  group by vec_id),
s as (
  select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.e, c.e) as bigint) as score
  from v q join v c on c.vec_id <> q.vec_id
  where q.vec_id % 100 = 0)
select query_id, cast(rank as int) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) r
where rank <= 10"""

QUERIES = {"op1_topk": op1_topk}
ORACLES = {"op1_topk": SQL}
