"""Vectors of words and texts learned from the texts: co-occurrence, positive pointwise mutual information, randomised SVD."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearsay.arrays import arrays, bits_for, by_key, shard_of, write_shards
from hearsay.operators import linear
from hearsay.operators.skew import MAX_BROADCAST_ROWS, bounded, explode_words, lookup_join, numbered, parallelism
from hearsay.operators.wordtable import WordTable, coded, sums, word_table
from hearsay.session import cut_lineage, scratch_path

WINDOW = 5
MIN_COUNT = 5
DIMENSIONS = 50
SPARE = 10
PASSES = 3
RARE = 1e-3
SHARD_ROWS = 100_000
SLICE_WORDS = 2_000_000
BLOCK_CELLS = 65_536
TASK_WORDS = 10_000
# the numbers of a block of the matrix, as bytes
BLOCK = {"first": "i4", "keys": "i8", "places": "i4", "pmi": "f8"}
# two numbers a row: some fifty megabytes as a broadcast
MAX_NUMBERED = 2_000_000


def _near_pairs(table: WordTable, window: int):
    """``(a, b, n)`` with a <= b: how often the listed words of a batch's texts stand at most ``window`` words apart, by their numbers."""

    def run(batches):
        for batch in batches:
            lists = batch["tokens"]
            ends = np.cumsum(np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.float64)))
            cuts = np.unique(np.r_[0, np.searchsorted(ends, np.arange(SLICE_WORDS, ends[-1] if len(ends) else 0, SLICE_WORDS)), len(ends)])
            for first, last in zip(cuts[:-1], cuts[1:], strict=True):
                yield _pairs_of(lists.slice(int(first), int(last - first)))

    def _pairs_of(lists: pa.Array) -> pa.RecordBatch:
        distinct, codes, starts = coded(lists)
        (numbers,) = table.find(distinct)
        known = np.sort(numbers[~np.isnan(numbers)].astype(np.int64))
        # places among the batch's listed words, in order of their numbers; -1 for other words
        own = np.where(np.isnan(numbers), -1, np.searchsorted(known, np.nan_to_num(numbers).astype(np.int64)))
        at = np.r_[own, -1][codes]
        text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        keys = []
        for d in range(1, window + 1):
            x, y = at[:-d], at[d:]
            here = (x >= 0) & (y >= 0) & (text[:-d] == text[d:])
            x, y = x[here], y[here]
            keys.append(np.minimum(x, y) * len(known) + np.maximum(x, y))
        found, n = np.unique(np.concatenate(keys), return_counts=True)
        columns = [known[found // max(1, len(known))], known[found % max(1, len(known))], n] if len(found) else [np.zeros(0, dtype=np.int64)] * 3
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "b", "n"])

    return run


def _dealt(table: DataFrame, words: DataFrame) -> DataFrame:
    """``table`` of ``words``, some thousands a task: hashing them takes longer than their size tells, so Spark would leave it to too few."""
    return table.repartition(max(1, min(parallelism(words), words.count() // TASK_WORDS)), "token")


def numbered_pairs(df: DataFrame, tokens: str, window: int = WINDOW, min_count: int = MIN_COUNT) -> tuple[DataFrame, DataFrame]:
    """``(token, id)`` of the words occurring ``min_count`` times or more, and ``(a, b, n)`` of ``cooccurrences`` by their ids.

    Tasks look the words' ids up in arrays of the shared folder and count the pairs of their own texts, each pair one way; two numbers and
    a count travel, and the other way follows after the shuffle.
    """
    counts = explode_words(df, [], tokens).groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)
    words = cut_lineage(numbered(counts.select("token"), [F.col("token")], "id"))
    near = df.select(F.col(tokens).alias("tokens")).mapInArrow(_near_pairs(word_table(_dealt(words, words)), window), "a long, b long, n long")
    one = near.groupBy("a", "b").agg(F.sum("n").alias("n"))
    # a word near itself counts twice
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    same = F.array(F.struct("a", "b"))
    each = F.when(F.col("a") == F.col("b"), same).otherwise(ways)
    both = one.select(F.explode_outer(each).alias("p"), (F.col("n") * F.when(F.col("a") == F.col("b"), 2).otherwise(1)).alias("n"))
    return words, both.select("p.a", "p.b", "n")


def cooccurrences(df: DataFrame, tokens: str, window: int = WINDOW, min_count: int = MIN_COUNT) -> DataFrame:
    """``(a, b, n)``: how often words a and b, both occurring ``min_count`` times or more, stand at most ``window`` words apart, both ways.

    A word near itself counts twice, once from each side. Distances are those in the text, rare words included. Pairs are counted within each task before
    they are shuffled, so the commonest pair arrives once a task; the words of a text never meet those of another.
    """
    words, pairs = numbered_pairs(df, tokens, window, min_count)
    for side in ("a", "b"):
        named = words.select(F.col("id").alias(side), F.col("token").alias(f"{side}_word"))
        pairs = lookup_join(pairs, named, side, "inner", spread_by=["b" if side == "a" else "a"])
    return pairs.select(F.col("a_word").alias("a"), F.col("b_word").alias("b"), "n")


def _with_rows(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """``pairs`` with ``row`` and ``column``, the sums of both their words' rows, however many words there are: tasks look them up in
    the shared folder and no pair is shuffled.
    """
    folder, bits = scratch_path(pairs.sparkSession, "rows"), bits_for(rows.count())
    keyed = rows.select(F.xxhash64("a").alias("key"), "row").withColumn("__shard", shard_of("key", bits))
    dealt = keyed.repartition(1 << bits, "__shard").sortWithinPartitions("__shard")
    write_shards(dealt, folder, "rows", by_key).agg(F.count(F.lit(1))).collect()

    def run(batches):
        for batch in batches:
            sums = []
            for side in ("a_key", "b_key"):
                keys, back = np.unique(batch[side].to_numpy(), return_inverse=True)
                sums.append(arrays(folder, "rows", bits).find(keys, ["row"], -1)[0][back].astype(np.int64))
            columns = [*(batch[c] for c in ("a", "b", "n")), *map(pa.array, sums)]
            out = pa.RecordBatch.from_arrays(columns, ["a", "b", "n", "row", "column"])
            yield out.filter(pa.array((sums[0] >= 0) & (sums[1] >= 0)))

    keys = [F.xxhash64(side).alias(f"{side}_key") for side in ("a", "b")]
    return pairs.select("a", "b", "n", *keys).dropna(subset=["a", "b"]).mapInArrow(run, "a long, b long, n long, row long, column long")


def positive_pmi(pairs: DataFrame, smooth: float = 0.75) -> DataFrame:
    """``(a, b, pmi)`` of the pairs seen more often than chance: log(n N / (n_a n_b)), contexts smoothed by a power of their counts.

    Made symmetric by the mean of both directions, which the smoothing tells apart.
    """
    pairs = cut_lineage(pairs)
    rows = cut_lineage(pairs.groupBy("a").agg(F.sum("n").alias("row")))
    total, smoothed = rows.agg(F.sum("row"), F.sum(F.col("row") ** smooth)).first()
    if not total:
        return pairs.select("a", "b", F.lit(0.0).alias("pmi"))
    columns = rows.select(F.col("a").alias("b"), F.col("row").alias("column"))
    by_number = dict(pairs.dtypes)["a"] == "bigint"
    if by_number and not bounded(rows, MAX_NUMBERED):
        counted = _with_rows(pairs, rows)
    else:
        most = MAX_NUMBERED if by_number else MAX_BROADCAST_ROWS
        by_row = lookup_join(pairs, rows, "a", "inner", spread_by=["b"], max_broadcast_rows=most)
        counted = lookup_join(by_row, columns, "b", "inner", spread_by=["a"], max_broadcast_rows=most)

    def pmi(own: str, context: str) -> F.Column:
        chance = F.col(own).cast("double") * (F.col(context) ** smooth) / F.lit(float(smoothed))
        return F.log(F.col("n") / chance)

    both = (pmi("row", "column") + pmi("column", "row")) / 2
    return counted.select("a", "b", both.alias("pmi")).filter("pmi > 0")


def _random_rows(words: DataFrame, width: int, seed: int) -> DataFrame:
    """A row of normal numbers for each word, by its hash: the same wherever it is made."""

    def run(batches):
        for batch in batches:
            out = [np.random.default_rng(h).standard_normal(width) for h in batch["h"].to_numpy().view(np.uint64).tolist()]
            flat = np.concatenate(out) if out else np.zeros(0)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * width, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch["word"], lists], ["word", "v"])

    kind = words.schema["word"].dataType.simpleString()
    return words.select("word", F.xxhash64("word", F.lit(seed)).alias("h")).mapInArrow(run, f"word {kind}, v array<double>")


def _stored(vectors: DataFrame, width: int) -> tuple[str, int]:
    """The rows of ``vectors(word, v)`` as sorted arrays in the shared folder, by the hash of their word (of numbers no two share one)."""
    spark, folder = vectors.sparkSession, scratch_path(vectors.sparkSession, "vectors")
    bits = bits_for(vectors.count(), SHARD_ROWS)
    columns = [f"v{i}" for i in range(width)]

    def build(held):
        order = np.argsort(held["key"])
        out = np.empty(len(order), dtype=[("key", "i8"), ("v", "f8", (width,))])
        out["key"] = held["key"][order]
        out["v"] = np.stack([held[c] for c in columns], axis=1)[order]
        return {"": out}

    rows = vectors.select(F.xxhash64("word").alias("key"), *[F.get("v", F.lit(i)).alias(c) for i, c in enumerate(columns)])
    dealt = rows.withColumn("__shard", shard_of("key", bits)).repartition(1 << bits, "__shard").sortWithinPartitions("__shard")
    write_shards(dealt, folder, "vectors", build).agg(F.count(F.lit(1))).collect()
    return folder, bits


def _blocks(pmi: DataFrame) -> DataFrame:
    """The cells of ``pmi``, which is sorted by a, some tens of thousands in a row: every pass over the matrix then reads a few numbers a
    cell and finds what it needs sorted. A block has the words of its rows and where the cells of each begin, the different keys of
    its columns and the place of each cell's among them.
    """

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        cells = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        rows = cells["a"].dictionary_encode().indices.to_numpy()
        first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        keys, places = np.unique(cells["key"].to_numpy(), return_inverse=True)
        numbers = [first, keys, places, cells["pmi"].to_numpy()]
        words = pa.ListArray.from_arrays(pa.array([0, len(first)], pa.int32()), cells["a"].take(pa.array(first)))
        packed = [pa.array([n.astype(kind).tobytes()], pa.binary()) for n, kind in zip(numbers, BLOCK.values(), strict=True)]
        return pa.RecordBatch.from_arrays([words, *packed], ["words", *BLOCK])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= BLOCK_CELLS:
                yield block(held)
                held, n = [], 0
        if held:
            yield block(held)

    kind = pmi.schema["a"].dataType.simpleString()
    columns = ", ".join(f"{c} binary" for c in BLOCK)
    return pmi.select("a", F.xxhash64("b").alias("key"), "pmi").mapInArrow(run, f"words array<{kind}>, {columns}")


def _applied(pmi: DataFrame, vectors: DataFrame, width: int) -> DataFrame:
    """The matrix of ``pmi`` times the rows of ``vectors``, which tasks look up in the shared folder: cells of the matrix stay where they
    are, and the sums of their rows are combined before the shuffle. ``pmi`` is sorted by a, or the ``_blocks`` of such a table.
    """
    folder, bits = _stored(vectors, width)
    blocks = _blocks(pmi) if "pmi" in pmi.columns and "a" in pmi.columns else pmi
    columns = [f"v{i}" for i in range(width)]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                first, keys, places, values = (np.frombuffer(batch[c][i].as_buffer(), dtype=kind) for c, kind in BLOCK.items())
                cells = arrays(folder, "vectors", bits).matrix(keys, "v", width)[places]
                cells *= values[:, None]
                found = np.add.reduceat(cells, first, axis=0)
                yield pa.RecordBatch.from_arrays([batch["words"][i].values, *(pa.array(c) for c in found.T.copy())], ["a", *columns])

    kind = blocks.schema["words"].dataType.elementType.simpleString()
    parts = blocks.mapInArrow(run, f"a {kind}, {', '.join(f'{c} double' for c in columns)}")
    added = parts.groupBy("a").agg(*[F.sum(c).alias(c) for c in columns])
    return cut_lineage(added.select(F.col("a").alias("word"), F.array(*columns).alias("v")))


def word_vectors(pmi: DataFrame, dimensions: int = DIMENSIONS, passes: int = PASSES, seed: int = 50) -> DataFrame:
    """``(word, vector)``: the leading ``dimensions`` eigenvectors of the symmetric matrix of ``pmi``, scaled by the root of their eigenvalue.

    Randomised: the span of a random matrix of a few more columns is multiplied by the matrix and made orthonormal, ``passes`` times over; in that
    span the matrix is a small one, whose eigenvectors the driver works out. Directions of negative eigenvalues are 0.
    Vocabulary and matrix stay distributed; no row of the matrix is ever held whole. Signs are those that make each column's sum of cubes positive.
    """
    width = dimensions + SPARE
    pmi = cut_lineage(_blocks(pmi.select("a", "b", "pmi").repartition("a").sortWithinPartitions("a")))
    # words are small and their rows are not, so Spark would leave them to too few tasks
    words = pmi.select(F.explode("words").alias("word")).repartition(parallelism(pmi), "word").distinct()
    basis = cut_lineage(_random_rows(words, width, seed))
    for _ in range(passes):
        basis = cut_lineage(linear.orthonormal(_applied(pmi, basis, width), "v", width))
    image = _applied(pmi, basis, width).withColumnRenamed("v", "mv")

    def add(total, batch):
        total += linear.matrix(batch, "v").T @ linear.matrix(batch, "mv")

    both = basis.join(image, "word")
    small = linear.summed(both.select("v", "mv"), (width, width), add)
    values, turn = np.linalg.eigh((small + small.T) / 2)
    first = np.argsort(-values)[:dimensions]
    out = linear.times(basis, "v", turn[:, first] * np.sqrt(np.maximum(values[first], 0.0)))

    def cubes(total, batch):
        total += (linear.matrix(batch, "v") ** 3).sum(axis=0)

    out = cut_lineage(out)
    signs = np.where(linear.summed(out.select("v"), (1, dimensions), cubes)[0] < 0, -1.0, 1.0)
    return linear.times(out, "v", np.diag(signs)).withColumnRenamed("v", "vector")


def text_vectors(
    df: DataFrame, key: str, tokens: str, words: DataFrame, dimensions: int = DIMENSIONS, out: str = "vector", rare: float = RARE
) -> DataFrame:
    """``(key, out)``: the weighted mean of the vectors of a text's words at length 1, common words weighing less: a / (a + share).

    Texts without a known word have a zero vector. Keys are unique. Tasks look the vectors of their own texts' words up in arrays of the
    shared folder; one row a text is shuffled.
    """
    every = cut_lineage(explode_words(df, [], tokens).groupBy("token").agg(F.count(F.lit(1)).alias("f")))
    total = every.agg(F.sum("f")).scalar()
    weight = F.lit(rare) / (F.lit(rare) + F.col("f") / total)
    known = words.select(F.col("word").alias("token"), "vector").join(every, "token")
    weighted = known.select("token", *[(F.get("vector", F.lit(i)) * weight).alias(f"v{i}") for i in range(dimensions)])
    table = word_table(_dealt(weighted, words))

    def run(batches):
        for batch in batches:
            distinct, codes, starts = coded(batch["tokens"])
            each = np.stack([sums(np.r_[np.nan_to_num(v), 0.0][codes], starts) for v in table.find(distinct)], axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(each) + 1) * dimensions, pa.int32()), pa.array(each.ravel()))
            yield pa.RecordBatch.from_arrays([batch[0], lists], [key, "s"])

    kind = df.schema[key].dataType.simpleString()
    summed = df.select(key, F.col(tokens).alias("tokens")).mapInArrow(run, f"`{key}` {kind}, s array<double>")
    sums_by_key = summed.groupBy(key).agg(Summarizer.sum(array_to_vector("s")).alias("s")).select(key, vector_to_array("s").alias("s"))
    length = F.sqrt(F.aggregate("s", F.lit(0.0), lambda x, y: x + y * y))
    unit = F.transform("s", lambda x: x / length)
    found = sums_by_key.filter(length > 0).select(key, unit.alias(out))
    zero = F.array_repeat(F.lit(0.0), dimensions)
    return df.select(key).join(found, key, "left").select(key, F.coalesce(out, zero).alias(out))


def learned_vectors(df: DataFrame, key: str, tokens: str, dimensions: int = DIMENSIONS, out: str = "vector", **options) -> DataFrame:
    """Text vectors from word vectors learned on the same texts; ``options`` go to ``cooccurrences``. Texts of rare words only, or none, have a zero vector."""
    rows = cut_lineage(df.select(key, F.col(tokens).alias("tokens")))
    listed, pairs = numbered_pairs(rows, "tokens", **options)
    vectors = word_vectors(positive_pmi(pairs), dimensions).withColumnRenamed("word", "id")
    words = vectors.join(listed, "id").select(F.col("token").alias("word"), "vector")
    return text_vectors(rows, key, "tokens", cut_lineage(words), dimensions, out)
