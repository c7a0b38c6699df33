"""N-gram Jaccard join of documents by MinHash banding, verified on the full n-gram sets."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hearsay.llm import components
from hearsay.llm.common import hash_words, lists, map_slices, mix, roll, starts, step, table

WORDS = 5
SIMILARITY = 0.8
RECALL = 0.9995
BLOCK_GRAMS = 100_000
BLOCK_DOCS = 512


def bands_and_rows(similarity: float, recall: float, budget: int = 128) -> tuple[int, int]:
    """The most rows a band can have so that a pair at ``similarity`` still shares one of the bands
    with probability ``recall``, the bands together holding at most ``budget`` minima.
    """
    best = math.ceil(math.log(1 - recall) / math.log(1 - similarity)), 1  # whatever the budget, if no band of more rows fits it
    for rows in range(2, 17):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))
        if bands * rows <= budget:
            best = bands, rows
    return best


def _gram_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the word n-grams of each text; fewer words than ``words`` are one gram."""
    hashes, counts = hash_words(texts)
    doc = np.repeat(np.arange(len(counts)), counts)
    n = max(0, len(hashes) - words + 1)
    at = np.flatnonzero(doc[:n] == doc[words - 1 :]) if n else np.zeros(0, dtype=np.int64)
    grams, owner = roll(hashes, words)[at], doc[at]
    short = np.flatnonzero((counts > 0) & (counts < words))
    if len(short):
        first = starts(counts)
        place = np.arange(words, dtype=np.uint64)
        whole = np.array(
            [mix(np.bitwise_xor.reduce(mix(hashes[first[i] : first[i + 1]] + place[: counts[i]]), keepdims=True), 9)[0] for i in short],
            dtype=np.uint64,
        )
        grams, owner = np.concatenate([grams, whole]), np.concatenate([owner, short])
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.r_[True, (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])] if len(grams) else np.zeros(0, dtype=bool)
    return grams[new], np.bincount(owner[new], minlength=len(counts)).astype(np.int64)


def _signatures(words: int, bands: int, rows: int):
    rng = np.random.default_rng(3)
    factors = rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)

    def signatures(batch: pa.RecordBatch) -> pa.RecordBatch:
        grams, counts = _gram_sets(batch["text"], words)
        full = counts > 0
        first = starts(counts)[:-1][full]
        keys = np.zeros((len(counts), bands), dtype=np.uint64)
        whole = [np.zeros(len(counts), dtype=np.uint64) for _ in range(2)]
        if len(grams):
            for salt, out in enumerate(whole):  # sums of mixed members tell sets apart, whatever their order
                out[full] = np.add.reduceat(mix(grams, salt + 20), first)
            scratch = np.empty_like(grams)
            for band in range(bands):
                key = np.full(len(first), band + 1, dtype=np.uint64)
                for i in range(band * rows, (band + 1) * rows):
                    np.multiply(grams, factors[i], out=scratch)
                    scratch += shifts[i]
                    # the upper half of a product is well mixed
                    least = np.minimum.reduceat((scratch >> np.uint64(32)).astype(np.uint32), first)
                    key = mix(key * np.uint64(31) + least, band)
                keys[full, band] = key
        sizes = np.where(full, bands, 0)
        return pa.RecordBatch.from_arrays(
            [batch["doc_id"], batch["text_hash"], pa.array(counts),
             *(pa.array(x.view(np.int64)) for x in whole), lists(keys[full].ravel().view(np.int64), sizes, pa.int64())],
            ["doc_id", "text_hash", "grams", "set_a", "set_b", "bands"],
        )

    return map_slices(signatures, "text")


def _sets(words: int):
    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        grams, counts = _gram_sets(batch["text"], words)
        return pa.RecordBatch.from_arrays(
            [batch["rep"], lists(grams.view(np.int64), counts, pa.int64())], ["rep", "set"]
        )

    return map_slices(sets, "text")


def _overlap(a: pa.ListArray, b: pa.ListArray) -> np.ndarray:
    """How many members each set of ``a`` has in common with each of ``b``."""
    def flat(x):
        return x.flatten().to_numpy(), np.repeat(np.arange(len(x)), x.value_lengths().to_numpy())

    (va, ra), (vb, rb) = flat(a), flat(b)
    both = np.intersect1d(va, vb)
    out = np.zeros((len(a), len(b)), dtype=np.float64)
    for at in range(0, len(both), 2048):
        some = both[at : at + 2048]
        sides = []
        for values, rows, n in ((va, ra, len(a)), (vb, rb, len(b))):
            side = np.zeros((n, len(some)), dtype=np.float32)
            place = np.minimum(np.searchsorted(some, values), len(some) - 1)
            hit = some[place] == values
            side[rows[hit], place[hit]] = 1
            sides.append(side)
        out += sides[0] @ sides[1].T
    return out


def _verify(similarity: float):
    def verify(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        mine = group["mine"].to_numpy()
        same = group["lo"][0].as_py() == group["hi"][0].as_py()
        a = group.filter(pa.array(mine == 0)).combine_chunks()
        b = a if same else group.filter(pa.array(mine == 1)).combine_chunks()
        found = [np.zeros(0, dtype=np.int64)] * 3
        if a.num_rows and b.num_rows:
            sets = [x["set"].combine_chunks() for x in (a, b)]
            sizes = [s.value_lengths().to_numpy().astype(np.float64) for s in sets]
            shared = _overlap(*sets)
            # shared / union >= similarity, without a division
            near = shared >= similarity * (sizes[0][:, None] + sizes[1][None, :] - shared) - 1e-9
            ids = [x["rep"].to_numpy() for x in (a, b)]
            copies = [x["copies"].to_numpy() for x in (a, b)]
            if same:
                np.fill_diagonal(near, False)
                labels, counts, both = components.smallest(near, ids[0], ids[0])[0], near @ copies[0], ids[0]
            else:
                labels = np.concatenate(components.smallest(near, *ids))
                counts, both = np.concatenate([near @ copies[1], near.T @ copies[0]]), np.concatenate(ids)
            found = [both[counts > 0], counts[counts > 0], labels[counts > 0]]
        return pa.table([pa.array(x, pa.int64()) for x in found], ["rep", "n", "to"])

    return verify


def jaccard_groups(
    docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL
) -> DataFrame:
    """``(doc_id, rep, n_links, class_id)`` for every id: documents whose sets of word n-grams have a Jaccard
    similarity of ``similarity`` or more are linked; ``n_links`` counts the other documents linked
    directly, ``class_id`` is the smallest id reachable, ``rep`` the smallest id with the very same set.

    Words are runs of anything but ASCII white space, as they stand. A text of fewer than ``words`` words
    has one gram, its words; a null or blank text has none and is alone. Rows without an id are left out.
    Repeated rows count once; of several texts under one id, that of the least hash is taken. An
    empty table gives no rows; extra columns are ignored.

    Equal sets are one class. Band and row numbers follow from the similarity and the target
    recall. Documents meet in a band by the band's smallest member, so a bucket gives one edge a member and
    never its pairs; buckets that touch are one candidate set. The full sets of candidates are then fetched
    once and compared in blocks: a block holds a bounded number of grams, a task one pair of
    blocks, and only sets whose sizes allow the similarity meet. A task sends, per document, the number of links and
    one smallest link. Verified on 64-bit hashes of the grams.
    """
    bands, rows = bands_and_rows(similarity, recall)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.filter("doc_id is not null").withColumn("text_hash", F.xxhash64("text"))
    signed = texts.mapInArrow(
        _signatures(words, bands, rows), "doc_id long, text_hash long, grams long, set_a long, set_b long, bands array<long>"
    )
    columns = ["text_hash", "grams", "set_a", "set_b", "bands"]
    signed = signed.groupBy("doc_id").agg(F.min(F.struct(*columns)).alias("s")).select("doc_id", "s.*")
    signed = step(signed, "signatures")

    key = ["grams", "set_a", "set_b"]
    classes = signed.filter("grams > 0").groupBy(*key).agg(
        F.min(F.struct("doc_id", "text_hash", "bands")).alias("s"), F.count(F.lit(1)).alias("copies")
    )
    classes = step(classes.select(*key, F.col("s.doc_id").alias("rep"), "s.text_hash", "s.bands", "copies"), "classes")

    met = classes.select("rep", F.explode("bands").alias("band"))
    buckets = met.groupBy("band").agg(F.min("rep").alias("first"), F.max("rep").alias("last")).filter("first < last")
    edges = met.join(buckets.select("band", "first"), "band").filter("rep > first")
    sets = step(components.connected(edges.select(F.col("rep").alias("a"), F.col("first").alias("b"))), "candidates")

    members = sets.withColumnRenamed("id", "rep").join(classes.select("rep", "text_hash", "grams", "copies"), "rep")
    # sizes within a factor of 1 / similarity are at most one step apart
    level = F.floor(F.log("grams") / F.lit(math.log(1 / similarity)) + 1e-9).cast("int")
    members = members.withColumn("level", level)
    sizes = members.groupBy("component", "level").agg(F.count(F.lit(1)).alias("n"), F.sum("grams").alias("all"))
    blocks = F.greatest(F.ceil(F.col("all") / BLOCK_GRAMS), F.ceil(F.col("n") / BLOCK_DOCS)).cast("int")
    sizes = sizes.select("component", "level", blocks.alias("own"), "n")
    near_levels = Window.partitionBy("component").orderBy("level").rangeBetween(-1, 1)
    around = Window.partitionBy("component").orderBy("level")

    def beside(offset: int, name: str):
        moved = F.when(F.lead("level", offset).over(around) == F.col("level") + offset, F.lead("own", offset).over(around))
        return F.coalesce(moved, F.lit(0)).alias(name)

    # a handful of levels per candidate set, so these windows stay small
    sizes = sizes.select("component", "level", "own", F.sum("n").over(near_levels).alias("near"), beside(1, "above"), beside(-1, "below"))
    members = members.join(sizes.filter("near > 1"), ["component", "level"])
    members = members.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("own")).cast("int"))
    tag = lambda level, block: F.struct(level.alias("level"), block.alias("block"))
    me, level = tag(F.col("level"), F.col("block")), F.col("level")

    def meet(n: str, to) -> F.Column:
        return F.when(F.col(n) > 0, F.transform(F.sequence(F.lit(0), F.col(n) - 1), to)).otherwise(F.array())

    def met_with(other, mine_first):
        return F.struct(
            F.when(mine_first, me).otherwise(other).alias("lo"), F.when(mine_first, other).otherwise(me).alias("hi"),
            F.when(mine_first, F.lit(0)).otherwise(F.lit(1)).alias("mine"),
        )

    partners = F.concat(
        meet("own", lambda j: met_with(tag(level, j), F.col("block") <= j)),
        meet("above", lambda j: met_with(tag(level + 1, j), F.lit(True))),
        meet("below", lambda j: met_with(tag(level - 1, j), F.lit(False))),
    )
    members = step(members.select("component", "rep", "text_hash", "copies", partners.alias("partners")), "members")

    wanted = members.select(F.col("rep").alias("doc_id"), "text_hash")
    fetched = texts.join(wanted, ["doc_id", "text_hash"]).select(F.col("doc_id").alias("rep"), "text")
    fetched = step(fetched.mapInArrow(_sets(words), "rep long, set array<long>").dropDuplicates(["rep"]), "sets")
    dealt = fetched.join(members, "rep").select("component", "rep", "copies", "set", F.explode("partners").alias("p"))
    dealt = dealt.select("component", "rep", "copies", "set", "p.*")
    links = step(dealt.groupBy("component", "lo", "hi").applyInArrow(_verify(similarity), "rep long, n long, to long"), "links")

    counts = links.groupBy("rep").agg(F.sum("n").alias("n"))
    found = components.connected(links.filter("rep <> to").select(F.col("rep").alias("a"), F.col("to").alias("b")))
    classes = (
        classes.select(*key, "rep", "copies").join(counts, "rep", "left").join(found.withColumnRenamed("id", "rep"), "rep", "left")
        .select(*key, "rep", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "rep").alias("class"))
    )
    return signed.select("doc_id", "text_hash", *key).join(classes, key, "left").select(
        "doc_id", "text_hash", F.coalesce("rep", "doc_id").alias("rep"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("class", "doc_id").alias("class_id"),
    )


def op8_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_groups(table(spark, sf, "documents")).drop("text_hash")


SQL = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words
  from documents where doc_id is not null),
g as materialized (
  select distinct doc_id, unnest(case when len(words) >= 5
    then list_transform(range(1, len(words) - 3), lambda i: array_to_string(list_slice(words, i, i + 4), ' '))
    when len(words) > 0 then [array_to_string(words, ' ')] else [] end) as gram
  from w),
n as materialized (select doc_id, count(*) as n, md5(string_agg(gram, chr(10) order by gram)) as s from g group by doc_id),
p as materialized (
  select a.doc_id as a, b.doc_id as b, count(*) as shared
  from g a join g b on a.gram = b.gram and a.doc_id < b.doc_id group by all),
l as materialized (
  select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where shared >= 0.8 * (x.n + y.n - shared)),
e as materialized (select a, b from l union all select b, a from l),
reach(id, c) as (select doc_id, doc_id from w union select reach.id, e.b from reach join e on e.a = reach.c),
m as (select id, min(c) as class_id from reach group by id),
r as (select x.doc_id, coalesce((select min(y.doc_id) from n y where y.s = x.s), x.doc_id) as rep
  from w left join n x using (doc_id) where x.doc_id is not null)
select w.doc_id, coalesce(r.rep, w.doc_id) as rep, (select count(*) from e where e.a = w.doc_id) as n_links, m.class_id
from w join m on m.id = w.doc_id left join r on r.doc_id = w.doc_id"""

QUERIES = {"op8_jaccard_join": op8_jaccard_join}
ORACLES = {"op8_jaccard_join": SQL}
