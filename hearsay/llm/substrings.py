"""Repeated passages across documents: winnowed anchors as seeds, extended to maximal repeats."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearsay.llm.common import hash_words, lists, map_slices, roll, split_words, starts, step, table

LENGTH = 13
SEED_WORDS = 6
ROW = ("doc_id", "text_hash")


def _winnow(hashes: np.ndarray, counts: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The first word of every full window of ``length`` words, and of the seed that stands for it.

    A window's seed is the least-hashed run of ``seed`` words within it, so equal windows have equal
    seeds at the same place, and neighbouring windows mostly share theirs.
    """
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    grams = roll(hashes, seed)
    best, at = grams[:n].copy(), np.zeros(n, dtype=np.int64)
    for j in range(1, length - seed + 1):
        other = grams[j : j + n]
        less = other < best
        best[less] = other[less]
        at[less] = j
    doc = np.repeat(np.arange(len(counts)), counts)
    window = np.flatnonzero(doc[:n] == doc[length - 1 :])
    return window, window + at[window]


def _anchors(length: int, seed: int):
    def anchors(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, counts = hash_words(batch["text"])
        _, at = _winnow(hashes, counts, length, seed)
        at = at[np.r_[True, at[1:] != at[:-1]]] if len(at) else at  # windows come in order, and so do their seeds
        doc = np.repeat(np.arange(len(counts)), counts)[at]
        rows = pa.array(doc)
        return pa.RecordBatch.from_arrays(
            [pa.array(roll(hashes, seed)[at].view(np.int64)), *(batch[c].take(rows) for c in ROW),
             pa.array((at - starts(counts)[doc]).astype(np.int32))],
            ["anchor", *ROW, "at"],
        )

    return map_slices(anchors, "text")


def _windows(length: int, seed: int):
    def windows(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, counts = hash_words(batch["text"])
        window, at = _winnow(hashes, counts, length, seed)
        first = starts(counts)
        marked = np.zeros(len(hashes) + 1, dtype=bool)
        found = batch["seeds"]
        marked[found.flatten().to_numpy() + np.repeat(first[:-1], found.value_lengths().to_numpy())] = True
        window = window[marked[at]]
        doc = np.repeat(np.arange(len(counts)), counts)[window]
        rows = pa.array(doc)
        return pa.RecordBatch.from_arrays(
            [pa.array(roll(hashes, length)[window].view(np.int64)),
             pa.array((roll(hashes, length, salt=1)[window] >> np.uint64(32)).astype(np.uint32).view(np.int32)),
             *(batch[c].take(rows) for c in ROW), pa.array((window - first[doc]).astype(np.int32))],
            ["w1", "w2", *ROW, "at"],
        )

    return map_slices(windows, "text")


def _cut(length: int, clean_as_is: bool):
    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, counts = split_words(batch["text"])
        first = starts(counts)
        found = batch["windows"]
        sizes = pc.fill_null(found.value_lengths(), 0).to_numpy()
        steps = np.zeros(len(words) + 1, dtype=np.int64)
        begin = found.flatten().to_numpy() + np.repeat(first[:-1], sizes)
        np.add.at(steps, begin, 1)
        np.add.at(steps, begin + length, -1)
        gone = np.cumsum(steps[:-1]) > 0
        doc = np.repeat(np.arange(len(counts)), counts)
        gone |= (pc.fill_null(batch["copy"], False).to_numpy(zero_copy_only=False) & (counts >= length))[doc]
        kept = pa.ListArray.from_arrays(
            pa.array(starts(np.bincount(doc[~gone], minlength=len(counts))), pa.int32()), words.filter(pa.array(~gone))
        )
        # spans of removed words: they begin and end where the mark changes or a document does
        edge = np.r_[True, (gone[1:] != gone[:-1]) | (doc[1:] != doc[:-1])] if len(gone) else np.zeros(0, dtype=bool)
        a = np.flatnonzero(edge)
        b = np.r_[a[1:], len(gone)] if len(a) else a
        a, b = a[gone[a]], b[gone[a]]
        spans = np.bincount(doc[a], minlength=len(counts))
        removed = np.bincount(doc[gone], minlength=len(counts))
        kept = pc.binary_join(kept, " ")
        if clean_as_is:
            kept = pc.if_else(pa.array(removed == 0), batch["text"], kept)
        return pa.RecordBatch.from_arrays(
            [batch["doc_id"], pa.array(counts), pa.array(removed, pa.int64()),
             lists(a - first[doc[a]], spans, pa.int64()), lists(b - first[doc[a]], spans, pa.int64()), kept, batch["carried"]],
            ["doc_id", "n_words", "n_removed", "span_starts", "span_ends", "kept", "carried"],
        )

    return map_slices(cut, "text")


def repeats(
    docs: DataFrame, length: int = LENGTH, seed: int = SEED_WORDS, carry: tuple[str, ...] = (), clean_as_is: bool = False
) -> DataFrame:
    """Which words of which document repeat a passage of a document with a smaller id.

    Gives every row of ``docs`` (``doc_id``, ``text``) with ``n_words``, ``n_removed``, the removed spans
    (``span_starts``, ``span_ends``: word numbers, end excluded; maximal, at least ``length`` words)
    and ``kept``, the other words joined by one space. Words are runs of anything but ASCII
    white space. A null text has no words. A row without an id takes no part and keeps all its words.
    Rows of one id never remove each other's words. An empty table gives no rows. Columns named in ``carry``
    come along in the struct ``carried``; others are ignored, whatever their names. ``clean_as_is`` leaves
    texts that lose nothing as they are in ``kept``, white space included.

    Seeds that only one document has cannot belong to a repeat and are left behind: minima and maxima
    per seed combine before the shuffle. Rows of the other seeds are extended both ways to the windows they stand for,
    compared by 96 bits of hash over whole windows; overlapping windows make up the maximal repeat.
    Whole copies of a text are settled by their text alone and send no windows. No pair of documents is
    ever formed, and seeds of a passage that many documents share are split by the join.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.struct(*carry, F.lit(True).alias("there")).alias("carried"),
    ).withColumn("text_hash", F.xxhash64("text"))
    named = rows.filter("doc_id is not null").select(*ROW, "text")

    seeds = named.mapInArrow(_anchors(length, seed), "anchor long, doc_id long, text_hash long, at int")
    shared = step(
        seeds.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b").select("anchor"),
        "seeds",
    )
    marked = seeds.join(shared, "anchor").groupBy(*ROW).agg(F.collect_list("at").alias("seeds"))
    marked = step(marked, "marked")

    text_key = ["text_hash", "other_hash", "size"]
    texts = named.select(*ROW, F.xxhash64(F.lit(1), "text").alias("other_hash"), F.length("text").alias("size"))
    firsts = texts.groupBy(*text_key).agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).filter("first_id < last_id")
    copies = texts.join(firsts, text_key).filter("doc_id > first_id").select(*ROW).distinct()
    copies = step(copies.withColumn("copy", F.lit(True)), "copies")

    to_extend = marked.join(copies, list(ROW), "left_anti")
    windows = step(
        named.join(to_extend, list(ROW)).select(*ROW, "text", "seeds").mapInArrow(
            _windows(length, seed), "w1 long, w2 int, doc_id long, text_hash long, at int"
        ),
        "windows",
    )
    heads = windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    heads = step(heads.filter("first_id < last_id").select("w1", "w2", "first_id"), "heads")
    covered = windows.join(heads, ["w1", "w2"]).filter("doc_id > first_id")
    covered = step(covered.groupBy(*ROW).agg(F.collect_set("at").alias("windows")), "covered")

    found = covered.join(copies, list(ROW), "full")
    marked = rows.join(found, list(ROW), "left").select("doc_id", "text", "carried", "windows", "copy")
    kinds = T.StructType.fromDDL(
        "doc_id long, n_words long, n_removed long, span_starts array<long>, span_ends array<long>, kept string"
    )
    return marked.mapInArrow(_cut(length, clean_as_is), kinds.add(marked.schema["carried"]))


def op5_substrings(spark: SparkSession, sf: str) -> DataFrame:
    out = repeats(table(spark, sf, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


SQL = r"""
with w as (
  select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words
  from documents),
g as (
  select doc_id, unnest(range(1, len(words) - 11)) as i, words from w where len(words) >= 13),
s as (select doc_id, i, list_slice(words, i, i + 12) as gram from g),
f as (select gram, min(doc_id) as first_id from s group by gram),
c as (
  select distinct doc_id, unnest(range(i, i + 13)) as j from s join f using (gram) where doc_id > first_id),
r as (select doc_id, list(j) as gone from c group by doc_id),
k as (
  select w.doc_id, words, coalesce(gone, []) as gone from w left join r using (doc_id))
select doc_id, cast(len(words) as bigint) as n_words, cast(len(gone) as bigint) as n_removed,
  sha256(array_to_string(list_filter(words, lambda x, i: not list_contains(gone, i)), ' ')) as kept_sha256
from k"""

QUERIES = {"op5_substrings": op5_substrings}
ORACLES = {"op5_substrings": SQL}
