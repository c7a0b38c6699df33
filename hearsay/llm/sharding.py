"""Shards that each hold the mixture of all sources: proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearsay.llm.common import global_positions, parallelism, per_copy, step, table
from hearsay.operators import skew

SHARDS = 16
SEED = "shards"


def drawn(*what: Column) -> Column:
    """A seeded draw in [0, 1): 48 bits of a digest."""
    digest = F.md5(F.concat_ws(":", *what))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))


def shards(docs: DataFrame, n_shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """``(doc_id, text_hash, source, copy, size, text_crc32, shard, slot)`` for every row of ``docs``.

    The rows of each source are shuffled by a seeded digest and ranked. The row of rank r of a source with n rows has
    the fractional rank (r + u) / n, where u in [0, 1) is the source's own seeded draw, so that sources of one row do
    not all meet in the middle. All rows are sorted by fractional rank and cut into ``n_shards`` runs whose row counts
    differ by at most one. Between any two places of the order a source has its share of the rows to less than one row
    plus its share of what the other sources are off, so every shard holds the mixture; within a shard, ``slot``
    counts from 0 without gaps and keeps that order, so any stretch of it is mixed too.

    ``size`` is the number of UTF-8 bytes of the text plus 1, ``text_crc32`` the checksum of these bytes; a null text
    has none. A null source is the source "". Null ids take part. Rows equal in id, text and source are numbered by
    ``copy``; they are one row until ranks are given, so that a row repeated without end is no hot key. Rows whose ids are
    equal go by their texts. Other columns are ignored. No rows give no rows.

    Only ids, hashes and sources are sorted, never texts. Both sorts cut any source by range; the counts of the sources
    are combined before they are shuffled and joined by ``skew.lookup_join``. Three tables are staged: the rows of either
    sort, and the sources. What goes into a sort is not staged: its shuffle, or the table it reads, serves the sort's sample
    and the sort, so texts are read once, and every staged table costs each task a file.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    key = ["doc_id", "text_hash", "source", "size", "text_crc32"]
    rows = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("copies"))
    lot = drawn(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text_crc32").cast("string"))
    order = ["source", "lot", "doc_id", "text_crc32", "size", "text_hash"]
    ranked = global_positions(rows.withColumn("lot", lot), order, "copies")
    sources = ranked.groupBy("source").agg(F.min("position").alias("start"), F.sum("copies").alias("n"))
    sources = step(sources.withColumn("phase", drawn(F.lit(seed), F.lit("source"), F.col("source"))), "sources")
    placed = per_copy(skew.lookup_join(ranked, sources, "source", "inner"), "copies", "copy")
    rank = F.col("position") - F.col("start") + F.col("copy")
    fraction = (rank.cast("double") + F.col("phase")) / F.col("n").cast("double")
    narrow = placed.select(*key, "copy", "lot", fraction.alias("fraction"))
    order = ["fraction", "lot", "doc_id", "text_crc32", "size", "source", "text_hash", "copy"]
    total = sources.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    ordered = global_positions(narrow, order)
    shard = F.expr(f"(position * {n_shards}) div {max(total, 1)}")
    first = F.expr(f"(shard * {total} + {n_shards - 1}) div {n_shards}")
    return ordered.withColumn("shard", shard).withColumn("slot", F.col("position") - first).select(
        "doc_id", "text_hash", "source", "copy", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), "slot"
    )


def write_shards(docs: DataFrame, path: str, n_shards: int = SHARDS, seed: str = SEED) -> None:
    """``(doc_id, text, source, slot)`` of all rows as Parquet under ``path``, one folder ``shard=k`` a shard.

    A shard is written by several tasks, each a range of its slots in order; texts travel twice, to meet their places and to be
    sorted. Rows equal in id, text and source are written as often as they occur.
    """
    places = shards(docs, n_shards, seed).select("doc_id", "text_hash", F.col("source").alias("name"), "shard", "slot")
    texts = docs.select(
        F.col("doc_id").cast("long").alias("own_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"),
    )
    texts = texts.withColumn("own_hash", F.xxhash64(F.coalesce("text", F.lit("")))).withColumn("own_name", F.coalesce("source", F.lit("")))
    texts = texts.dropDuplicates(["own_id", "own_hash", "own_name"])
    same = F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("text_hash") == F.col("own_hash")) & (F.col("name") == F.col("own_name"))
    whole = places.join(texts, same).select("doc_id", "text", "source", "shard", "slot")
    parts = max(n_shards, parallelism(docs.sparkSession))
    whole.repartitionByRange(parts, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op11_sharding(spark: SparkSession, sf: str) -> DataFrame:
    placed = shards(table(spark, sf, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


# a checksum as in zlib: each byte is followed by eight steps (-1) of the shift register
SQL = """
with d as (
  select doc_id, coalesce(source, '') as source, coalesce(text, '') as text from documents),
h as (
  select doc_id, source, strlen(text) + 1 as size,
         cast(xor(4294967295, list_reduce(
           list_prepend(4294967295, flatten(list_transform(regexp_extract_all(hex(encode(text)), '..'),
             lambda x: [cast('0x' || x as bigint), -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda c, x: case when x >= 0 then xor(c, x) else xor(c >> 1, (c & 1) * 3988292384) end)) as bigint) as crc
  from d),
l as (
  select *, cast('0x' || md5('shards:' || coalesce(cast(doc_id as varchar), '') || ':' || crc)[1:12] as bigint) / 281474976710656e0 as lot,
         cast('0x' || md5('shards:source:' || source)[1:12] as bigint) / 281474976710656e0 as phase
  from h),
r as (
  select *, row_number() over (partition by source order by lot, doc_id nulls first, crc, size) - 1 as rank, count(*) over (partition by source) as n from l),
p as (
  select *, row_number() over (order by (rank + phase) / n, lot, doc_id nulls first, crc, size, source) - 1 as position, count(*) over () as total from r)
select doc_id, cast(size as bigint) as size, crc as text_crc32, 'rows' as law, cast(position * 16 // total as int) as shard,
       cast(position - (position * 16 // total * total + 15) // 16 as bigint) as slot, cast(null as int) as grown_shard
from p"""

QUERIES = {"op11_sharding": op11_sharding}
ORACLES = {"op11_sharding": SQL}
