"""Interpolated modified Kneser-Ney n-gram model, counted in Spark and read from sorted hash arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearsay.llm.arrays import Pack, arrays, batch_of, bits_for, shard_of, write_shards
from hearsay.llm.common import global_positions, map_slices, mix, hash_strings, parallelism, slices, split_words, starts, step, table
from hearsay.session import discard, scratch_path, scratch_run

ORDER = 3
END = np.uint64(0xC2D1F00DE5A3B911)
STEP = np.uint64(0x9E3779B97F4A7C15)
# words have numbers, the most frequent first, from 1 on
BEGIN, UNKNOWN = 0, 2**32 - 1
GRAMS, CONTEXTS, SEEN = 0, 1, 2
HELD_ROWS = 1_500_000
SHARD_ROWS = 1_000_000
DEALT = "kind int, shard long, rows long, data binary"


@dataclass(frozen=True)
class Model:
    """Where the arrays are, and the few numbers every look-up needs. ``discounts[n - 1]`` has D1, D2, D3+ of order n."""

    folder: str
    order: int
    bits: dict[str, int]
    discounts: tuple[tuple[float, float, float], ...]
    tokens: int
    types: int
    continuations: int
    frequent: int


def _coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the different lower-cased words and of the end, the place there of each word and end of all texts, and how many each text has."""
    words, counts = split_words(pc.ascii_lower(pc.fill_null(texts, "")))
    coded = words.dictionary_encode()
    distinct = hash_strings(coded.dictionary) if len(words) else np.zeros(0, dtype=np.uint64)
    codes = np.insert(coded.indices.to_numpy().astype(np.int64), np.cumsum(counts), len(distinct))
    return np.r_[distinct, END], codes, counts + 1


def _sequence(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of each text and its end, one text after the other."""
    distinct, codes, counts = _coded(texts)
    return distinct[codes], counts


def _before(words: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """The word ``n`` places before each; begin marks stand in front of a text."""
    inside = np.arange(len(words)) - np.repeat(starts(counts)[:-1], counts)
    return np.where(inside >= n, np.r_[np.zeros(n, dtype=words.dtype), words][: len(words)], words.dtype.type(BEGIN))


def _contexts(words: list[np.ndarray], frequent: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hash of the first n of ``words``, of which the nearest comes first, for every n, and whether all n are frequent."""
    out, key, all_frequent = [], np.uint64(0), True
    for n, word in enumerate(words, start=1):
        key, all_frequent = mix(key * STEP + word.astype(np.uint64), n), all_frequent & (word <= frequent)
        out.append((key, all_frequent))
    return out


def gram_key(context: np.ndarray, spread: np.ndarray | bool, word: np.ndarray, bits: int) -> np.ndarray:
    """The key of an n-gram of the hash of its context and its last word's number.

    Its highest ``bits`` are the context's, so that a shard has all that follows a context; contexts of frequent words, which
    could outgrow a shard, are ``spread`` over all of them.
    """
    key = context ^ mix(word.astype(np.uint64))
    low = np.uint64(2 ** (64 - bits) - 1)
    return np.where(spread, key, (key & low) | (context & ~low))


def _keys(kind: int, words: list[np.ndarray], frequent: int, bits: int) -> np.ndarray:
    """The keys of contexts or n-grams, whose words come in the order of the text."""
    if kind == CONTEXTS:
        return _contexts(words[::-1], frequent)[-1][0].view(np.int64)
    before = _contexts(words[-2::-1], frequent) if len(words) > 1 else [(np.uint64(0), True)]
    return gram_key(*before[-1], words[-1], bits).view(np.int64)


def _packed(columns: list[np.ndarray]) -> bytes:
    """Sorted columns in one compressed value, byte by byte of their numbers: most bytes equal those of the row before."""
    return pa.compress(b"".join(c.view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns), codec="zstd", asbytes=True)


def _unpacked(data: pa.Scalar, rows: int, kinds: list[type]) -> list[np.ndarray]:
    sizes = [np.dtype(kind).itemsize for kind in kinds]
    raw = np.frombuffer(pa.decompress(data.as_buffer(), rows * sum(sizes), codec="zstd"), dtype=np.uint8)
    cuts = starts(np.array(sizes) * rows)
    return [
        np.ascontiguousarray(raw[a:b].reshape(size, rows).T).view(kind).ravel()
        for a, b, size, kind in zip(cuts[:-1], cuts[1:], sizes, kinds, strict=True)
    ]


def _dealt(kind: int, bits: int, frequent: int, words: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
    """A row for each shard that has some, with the counts of equal neighbours added up."""
    keys = _keys(kind, words, frequent, bits)
    shard = keys >> np.int64(64 - bits) if bits else np.zeros(len(keys), dtype=np.int64)
    # by shard, last word and the ones before it, as far as they fit 64 bits: neighbours pack well, and equal ones mostly meet
    by, left, width = shard.astype(np.uint64) << np.uint64(64 - bits) if bits else shard.astype(np.uint64), 64 - bits, max(int(w.max()) for w in words).bit_length()
    for w in words[::-1]:
        left -= width
        by |= w.astype(np.uint64) << np.uint64(left) if left >= 0 else w.astype(np.uint64) >> np.uint64(min(-left, 63))
        if left <= 0:
            break
    by = np.argsort(by)
    shard, words = shard[by], [w[by] for w in words]
    new = np.r_[True, shard[1:] != shard[:-1]]
    for w in words:
        new[1:] |= w[1:] != w[:-1]
    first = np.flatnonzero(new)
    columns = [*(w[first] for w in words), *(np.add.reduceat(c[by], first, dtype=c.dtype) for c in counts)]
    shard = shard[first]
    cuts = np.r_[0, np.flatnonzero(shard[1:] != shard[:-1]) + 1, len(shard)]
    data = [_packed([c[a:b] for c in columns]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(data), kind, dtype=np.int32)), pa.array(shard[cuts[:-1]]), pa.array(np.diff(cuts)), pa.array(data, pa.binary())],
        ["kind", "shard", "rows", "data"],
    )


class _Held:
    """Rows held until there are enough of them to be added up and sent on; a task holds no more than that."""

    def __init__(self, kind: int, bits: int, frequent: int):
        self.kind, self.bits, self.frequent, self.parts, self.rows = kind, bits, frequent, [], 0

    def add(self, words: list[np.ndarray], counts: list[np.ndarray]):
        if len(words[0]):
            self.parts.append((words, counts))
            self.rows += len(words[0])
        if self.rows >= HELD_ROWS:
            yield from self.sent()

    def sent(self):
        if self.parts:
            words, counts = ([np.concatenate(c) for c in zip(*side, strict=True)] for side in zip(*self.parts, strict=True))
            self.parts, self.rows = [], 0
            yield _dealt(self.kind, self.bits, self.frequent, words, counts)


def _words():
    """Counts of the words of a slice."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        distinct, codes, _ = _coded(batch["text"])
        return batch_of({"key": distinct.view(np.int64), "c": np.bincount(codes, minlength=len(distinct))})

    return map_slices(count, "text")


def _count(order: int, folder: str, bits: dict[str, int], frequent: int):
    """Counts of the n-grams of a task's texts."""

    def count(batches):
        held = _Held(GRAMS, bits[f"grams{order}"], frequent)
        for batch in batches:
            for part in slices(batch, "text"):
                distinct, codes, counts = _coded(part["text"])
                (number,) = _each(distinct, ["number"], arrays(folder, "words", bits["words"]))
                number = number.astype(np.uint32)[codes]
                words = [*(_before(number, counts, n) for n in range(order - 1, 0, -1)), number]
                yield from held.add(words, [np.ones(len(number), dtype=np.int32)])
        yield from held.sent()
        pa.default_memory_pool().release_unused()

    return count


def _narrow(columns: dict[str, np.ndarray]) -> np.ndarray:
    """Columns of whole numbers from 0 on as one array, each in as many bytes as its largest needs."""
    out = np.empty(len(next(iter(columns.values()))), dtype=[(f, np.min_scalar_type(int(c.max(initial=0)))) for f, c in columns.items()])
    for field, c in columns.items():
        out[field] = c
    return out


def _tables(kind: int, key: np.ndarray, counts: list[np.ndarray]) -> dict[str, np.ndarray]:
    """Sorted keys, and beside them what was counted; of most keys one thing was seen once, and they are kept without counts."""
    once = counts[0] == 1
    fields = ["n"] if kind == GRAMS else ["n", "once", "twice", "more"]
    return {"": key[~once], "-values": _narrow({f: c[~once] for f, c in zip(fields, counts, strict=True)}), "-once": key[once]}


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of ``key``, and where there each of its values begins."""
    by = np.argsort(key)
    key = key[by]
    return by, np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, dtype=np.int64)


def _fold(n: int, folder: str, bits: dict[str, int], frequent: int):
    """Adds up the counts of n-grams and writes their arrays and those of their contexts.

    On go the n-grams without their first words, and the contexts that are spread, whose sums the next fold makes. A task
    holds one shard at a time, and writes those it gets to one file.
    """

    def fold(batches):
        seen = np.zeros(6, dtype=np.int64)
        on = {k: _Held(k, bits[name], frequent) for k, name in ((CONTEXTS, f"contexts{n}"), (GRAMS, f"grams{n - 1}"))} if n > 1 else {}

        pack = None

        def saved(kind, shard, key, counts, name):
            for ending, rows in _tables(kind, key, counts).items():
                pack.add(f"{name}{ending}", shard, rows)

        def added(kind, shard, parts):
            columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
            parts.clear()
            key = _keys(kind, columns[:n], frequent, bits[f"grams{n}"])
            by, first = _runs(key)
            counts, at = [np.add.reduceat(c[by], first, dtype=np.int64) for c in columns[n:]], by[first]
            saved(kind, shard, key[at], counts, f"contexts{n + 1}" if kind == CONTEXTS else f"grams{n}")
            if kind == CONTEXTS:
                return
            (c,) = counts
            seen[:] += [c.sum(), *((c == i).sum() for i in range(1, 5)), len(c)]
            if not on:
                return
            words = [w[at] for w in columns[:n]]
            yield from on[GRAMS].add(words[1:], [np.ones(len(c), dtype=np.int32)])
            context, spread = _contexts(words[-2::-1], frequent)[-1]
            follow = [c, c == 1, c == 2, c > 2]
            yield from on[CONTEXTS].add([w[spread] for w in words[:-1]], [x[spread].astype(np.int64) for x in follow])
            own, follow = context[~spread].view(np.int64), [x[~spread] for x in follow]
            by, first = _runs(own)
            if len(own):
                saved(CONTEXTS, shard, own[by[first]], [np.add.reduceat(x[by], first, dtype=np.int64) for x in follow], f"contexts{n}")

        group, parts = None, []
        for batch in batches:
            kinds, shards, rows = (batch[c].to_numpy() for c in ("kind", "shard", "rows"))
            for i in range(batch.num_rows):
                if (now := (int(kinds[i]), int(shards[i]))) != group:
                    if parts:
                        yield from added(*group, parts)
                    group, parts = now, []
                    # no other task of this fold has the group
                    pack = pack or Pack(folder, f"{n}~{group[0]}-{group[1]}")
                counts = [np.int32] if now[0] == GRAMS else [np.int64] * 4
                parts.append(_unpacked(batch["data"][i], int(rows[i]), [np.uint32] * n + counts))
        if parts:
            yield from added(*group, parts)
            pack.close()
        for held in on.values():
            yield from held.sent()
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(6, SEEN, dtype=np.int32)), pa.array(np.arange(6)), pa.array(seen), pa.array([b""] * 6, pa.binary())],
            ["kind", "shard", "rows", "data"],
        )
        pa.default_memory_pool().release_unused()

    return fold


def _discounts(seen: list[int]) -> tuple[float, float, float]:
    """D1, D2, D3+ from the numbers of n-grams seen once to four times; defined where some are missing."""
    n1, n2, n3, n4 = (float(x) for x in seen)
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
    raw = (1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(max(d, 0.05), limit) for d, limit in zip(raw, (0.95, 1.95, 2.95), strict=True))


def _bits(spark: SparkSession, rows: int) -> int:
    """Shard bits of n-grams: by their number, and a shard a task at least."""
    return max(bits_for(rows, SHARD_ROWS), int(np.ceil(np.log2(parallelism(spark)))))


def _vocabulary(texts: DataFrame, folder: str) -> tuple[int, int, int, int]:
    """Number the words of ``texts``, the most frequent first, and write their counts and numbers by hash.

    Gives the number of shard bits, of all words, of different ones and of frequent ones: contexts with another word are
    followed by too few to fill a quarter of a shard.
    """
    spark = texts.sparkSession
    words = texts.mapInArrow(_words(), "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))
    words = step(words.withColumn("less", -F.col("c")), "words")
    n, v = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    if v >= UNKNOWN:
        raise ValueError(f"{v} different words; their numbers have 32 bits")
    frequent = words.filter(F.col("c") > n // 2 ** _bits(spark, n) // 4).count()
    bits = bits_for(v)
    numbered = global_positions(words, ["less", "key"]).select("key", "c", (F.col("position") + 1).alias("number"))
    dealt = numbered.withColumn("__shard", shard_of("key", bits)).repartition(parallelism(spark), "__shard").sortWithinPartitions("__shard")

    def beside(columns: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        by = np.argsort(columns["key"])
        return {"": columns["key"][by], "-values": _narrow({f: columns[f][by] for f in ("c", "number")})}

    write_shards(dealt, folder, "words", beside).agg(F.count(F.lit(1))).collect()
    return bits, n, v, frequent


def train(docs: DataFrame, order: int = ORDER) -> Model:
    """Count the n-grams of ``docs(text)`` and write the arrays; ``order`` is 2 or more.

    Tokens are lower-cased (A-Z) runs of anything but ASCII white space, and an end for every text. A null
    text is an empty one. No texts give a model that knows nothing: every token is equally likely.

    Words are numbered first, so that n-grams travel as small numbers: each task adds up those of its texts and sends
    one compressed value for every shard. A shard has all that follows a context, but contexts of frequent words are
    spread over all shards, and frequent pairs with them. Of every order the arrays have the counts of its n-grams and
    what follows its contexts; lower orders count the different words seen before, and come from the order above. All
    statistics cover all texts.
    """
    spark = docs.sparkSession
    folder = scratch_path(spark, "lm")
    texts = docs.select(F.col("text").cast("string").alias("text"))
    with scratch_run(spark):
        word_bits, n_tokens, n_types, frequent = _vocabulary(texts, folder)
    bits = {"words": word_bits}
    for n in range(1, order + 1):
        # shards only have to follow the number of n-grams, so a bound will do
        bits[f"grams{n}"] = bits[f"contexts{n}"] = _bits(spark, n_types if n == 1 else n_tokens >> (order - n))
    counted, path, seen = texts.mapInArrow(_count(order, folder, bits, frequent), DEALT), None, {}
    for n in range(order, 0, -1):
        tasks = max(parallelism(spark), 2 ** bits[f"grams{n}"] // 8)
        dealt = counted.repartition(tasks, "kind", "shard").sortWithinPartitions("kind", "shard")
        before, path = path, scratch_path(spark, f"grams{n}")
        out = step(dealt.mapInArrow(_fold(n, folder, bits, frequent), DEALT), f"grams{n}", path)
        if before:
            discard(spark, before)
        found = {r["shard"]: r["n"] for r in out.filter(F.col("kind") == SEEN).groupBy("shard").agg(F.sum("rows").alias("n")).collect()}
        seen[n] = [found.get(i, 0) for i in range(6)]
        counted = out.filter(F.col("kind") != SEEN)
    discard(spark, path)
    discounts = tuple(_discounts(seen[n][1:5]) for n in range(1, order + 1))
    total, once, twice, *_, types = seen[1]
    spare = sum(d * k for k, d in zip((once, twice, types - once - twice), discounts[0], strict=True)) / total if total else 1.0
    return Model(folder, order, bits, (*discounts, (spare, 0.0, 0.0)), n_tokens, n_types, total, frequent)


def _take_off(counts: np.ndarray, discounts: tuple[float, ...]) -> np.ndarray:
    steps = np.array([0.0, *discounts[:3]])
    return np.maximum(counts - steps[np.minimum(counts, 3).astype(np.int64)], 0)


def _each(values: np.ndarray, fields: list[str], found) -> list[np.ndarray]:
    """Look-ups of every value through its distinct sorted ones."""
    distinct, back = np.unique(values.view(np.int64), return_inverse=True)
    return [x[back] for x in found.find(distinct, fields)]


def _seen(model: Model, name: str, keys: np.ndarray, fields: list[str]) -> list[np.ndarray]:
    """What was counted for every key: ``fields[0]`` is 1, and so is "once", where one thing was seen once."""
    distinct, back = np.unique(keys.view(np.int64), return_inverse=True)
    out = arrays(model.folder, name, model.bits[name]).find(distinct, fields)
    (once,) = arrays(model.folder, f"{name}-once", model.bits[name]).find(distinct, [""])
    return [(x + once if field in ("n", "once") else x)[back] for x, field in zip(out, fields, strict=True)]


def score_words(model: Model, distinct: np.ndarray, codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of each token by the model, and its count in training; token i is ``distinct[codes[i]]``."""
    known, number = _each(distinct, ["c", "number"], arrays(model.folder, "words", model.bits["words"]))
    words = np.where(known > 0, number, UNKNOWN).astype(np.uint32)
    (after,) = _seen(model, "grams1", gram_key(np.uint64(0), True, words, model.bits["grams1"]), ["n"])
    spare = model.discounts[-1][0]
    p = (_take_off(after, model.discounts[0]) / max(model.continuations, 1) + spare / (model.types + 1))[codes]
    words = words[codes]
    contexts = _contexts([_before(words, counts, i) for i in range(1, model.order)], model.frequent)
    for n, (context, spread) in enumerate(contexts, start=2):
        total, *seen = _seen(model, f"contexts{n}", context, ["n", "once", "twice", "more"])
        (own,) = _seen(model, f"grams{n}", gram_key(context, spread, words, model.bits[f"grams{n}"]), ["n"])
        d = model.discounts[n - 1]
        spare = sum(x * k for x, k in zip(d, seen, strict=True))
        p = np.where(total > 0, (_take_off(own, d) + spare * p) / np.maximum(total, 1), p)
    return p, known[codes]


def score_tokens(model: Model, tokens: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of each token by the model, and its count in training."""
    distinct, codes = np.unique(tokens, return_inverse=True)
    return score_words(model, distinct, codes, counts)


def _score(model: Model):
    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        distinct, codes, counts = _coded(batch["text"])
        p, known = score_words(model, distinct, codes, counts)
        first = starts(counts)[:-1]
        base = np.log10((known + 0.5) / (model.tokens + 0.5 * (model.types + 1)))
        return pa.RecordBatch.from_arrays(
            [batch["doc_id"], batch["held_out"], pa.array(counts), pa.array(np.add.reduceat((known > 0).astype(np.int64), first)),
             pa.array(np.full(len(counts), model.tokens)), pa.array(np.add.reduceat(base, first)),
             pa.array(np.add.reduceat(np.log10(p), first))],
            ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    return map_slices(score, "text")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs(doc_id, text, held_out)`` with token counts, an add-half unigram score and the model's score (both log10).

    Every row is scored, those with a null id or text too (an empty text is its end alone). Workers map the shards of the
    arrays they need; nothing is broadcast but the handful of numbers in ``model``.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.coalesce("held_out", F.lit(False)).alias("held_out"))
    return rows.mapInArrow(
        _score(model),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    ).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def op6_lm_score(spark: SparkSession, sf: str) -> DataFrame:
    """A row without an id is not held out."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    docs = docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False)))
    return score(docs, train(docs.filter(~F.col("held_out"))))


QUERIES = {"op6_lm_score": op6_lm_score}
ORACLES: dict[str, str] = {}
