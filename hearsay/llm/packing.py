"""Packing along a space-filling curve: neighbours in the projected space share a sequence."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearsay.llm.common import global_positions, map_slices, mix, starts, table
from hearsay.llm.encode import encoder
from hearsay.session import stage

SEQUENCE = 2048
END_ID = 1
HASHED = 256
DIMENSIONS = 4
BITS = 12


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of integer points (rows) with ``bits`` bits per dimension."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the excess work, highest bit first
        p = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(on, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Hilbert keys of documents given by their ids: signed feature hashing, damped counts, projection."""
    n = len(counts)
    hashed = mix(np.arange(int(ids.max()) + 1 if len(ids) else 1, dtype=np.uint64))
    # of every id its cell, and whether it adds to the cell or takes from it
    cell = ((hashed % np.uint64(HASHED)) * np.uint64(2) + ((hashed >> np.uint64(40)) & np.uint64(1))).astype(np.int32)
    out = np.zeros((n, HASHED))
    step = 2048
    first = starts(counts)
    for a in range(0, n, step):
        b = min(n, a + step)
        at = np.repeat(np.arange(b - a, dtype=np.int32) * (2 * HASHED), counts[a:b])
        at += cell[ids[first[a] : first[b]]]
        both = np.bincount(at, minlength=(b - a) * 2 * HASHED).reshape(b - a, HASHED, 2)
        out[a:b] = both[:, :, 0] - both[:, :, 1]
    out = np.sign(out) * np.sqrt(np.abs(out))
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
    directions = np.random.default_rng(5).standard_normal((HASHED, DIMENSIONS))
    points = 0.5 + 0.5 * np.tanh(0.8 * (out @ directions))
    return hilbert(np.minimum((points * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)


def _encode(path: str):
    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, counts = encoder(path).encode(batch["text"], END_ID)
        keys = curve_keys(ids, counts)
        kind = encoder(path).kind
        squeeze = zstandard.ZstdCompressor(level=1)
        raw = memoryview(ids).cast("B")
        at = starts(counts) * np.dtype(kind).itemsize
        packed = [squeeze.compress(raw[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        return pa.RecordBatch.from_arrays(
            [batch["row"], batch["doc_id"], batch["segment"], pa.array(keys, pa.int64()), pa.array(counts, pa.int64()), pa.array(packed, pa.binary())],
            ["row", "doc_id", "segment", "key", "tokens", "ids"],
        )

    sliced = map_slices(encode, "text", 8 << 20)

    def over(batches):
        yield from sliced(batches)
        encoder(path).rest()

    return over


def _cut(sequence: int, path: str):

    def cut(batches):
        expand, kind = zstandard.ZstdDecompressor(), encoder(path).kind
        for batch in batches:
            docs, tokens, at = (batch[c].to_numpy(zero_copy_only=False) for c in ("doc_id", "tokens", "position"))
            index = []
            pieces = ([], [], [], [], [])
            held = 0
            for i, blob in enumerate(batch["ids"]):
                whole = np.frombuffer(expand.decompress(blob.as_py()), dtype=kind).astype("<u4")
                first = np.arange(at[i] // sequence, (at[i] + tokens[i] - 1) // sequence + 1)
                begin = np.maximum(first * sequence, at[i]) - at[i]
                end = np.minimum((first + 1) * sequence, at[i] + tokens[i]) - at[i]
                for values, column in zip((begin, end - begin, first, (begin + at[i]) % sequence), pieces, strict=False):
                    column.append(values)
                pieces[4].extend(whole[a:b].tobytes() for a, b in zip(begin, end, strict=True))
                index.append(np.full(len(begin), i))
                held += len(whole)
                if held > 2_000_000 or i == batch.num_rows - 1:
                    rows = np.concatenate(index)
                    longs = [np.concatenate(c) for c in pieces[:4]]
                    yield pa.RecordBatch.from_arrays(
                        [batch["doc_id"].take(pa.array(rows)), *(pa.array(c, pa.int64()) for c in longs[:2]),
                         pa.array(tokens[rows], pa.int64()), *(pa.array(c, pa.int64()) for c in longs[2:]),
                         pa.array(pieces[4], pa.binary())],
                        ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
                    )
                    index, pieces, held = [], ([], [], [], [], []), 0

    return cut


PIECE = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def pack(docs: DataFrame, tokenizer_path: str, sequence: int = SEQUENCE, segment: Column | None = None) -> DataFrame:
    """Pieces of all documents laid end to end along the curve and cut every ``sequence`` ids.

    ``docs`` has ``doc_id`` and ``text``; other columns are ignored. A null text is empty and has one id, the end.
    A row without an id is packed too (``doc_id`` null), and repeated rows are packed each. An empty
    table gives no piece. ``ids`` holds the ids of a piece as little-endian unsigned 32-bit numbers. Only
    the last sequence may fall short of ``sequence`` ids.

    Texts are encoded once and kept as compressed ids. Documents are sorted by the Hilbert key of
    their hashed, projected term vectors (ties by id); only keys and lengths are sorted, and the sum
    of lengths before a document is its place. The ids join their places by row, whatever a source's share.
    With ``segment`` (a number over the columns of ``docs``) the curve starts anew in each segment, and segments follow one another.
    """
    part = F.lit(0) if segment is None else segment
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), part.cast("long").alias("segment")
    )
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    encoded = stage(
        rows.mapInArrow(_encode(tokenizer_path), "row long, doc_id long, segment long, key long, tokens long, ids binary"), "encoded"
    )
    places = global_positions(encoded.select("segment", "key", "doc_id", "row", "tokens"), ["segment", "key", "doc_id", "row"], "tokens")
    placed = encoded.select("row", "doc_id", "tokens", "ids").join(places.select("row", "position"), "row")
    return placed.select("doc_id", "tokens", "ids", "position").mapInArrow(_cut(sequence, tokenizer_path), PIECE)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_packing(spark: SparkSession, sf: str) -> DataFrame:
    return digest(pack(table(spark, sf, "documents"), tokenizer_path()))


QUERIES = {"op3_packing": op3_packing}
ORACLES: dict[str, str] = {}
