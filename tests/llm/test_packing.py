"""Packing: every id in one piece, sequences without gaps, and a curve that moves one step at a time."""

import zlib

import numpy as np
import pytest

from hearsay.llm import packing
from hearsay.llm.encode import Encoder


def test_hilbert_visits_every_cell_step_by_step():
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        order = np.argsort(packing.hilbert(cells, bits))
        assert sorted(packing.hilbert(cells, bits)) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[order], axis=0)).sum(axis=1) == 1).all()


TEXTS = [
    "", None, "Hello, World.", "don't  stop\tnow!!! 3.14 café CAFÉ ét", "word " * 700, "many different words here " * 90, " \n ", "ÀÉ x,y. a.b, İstanbul ΣΑΣ",
    "%%% $$$ !! ?? --", "no break", "x" * 5000, "the the the,", "Grün über, straße. ŒUVRE ñ,",
]


def test_encoder_equals_whole_text_encoding():
    import pyarrow as pa
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.tokenizer_path())
    encoder = Encoder(packing.tokenizer_path())
    for _ in range(2):  # the second time from memory
        ids, counts = encoder.encode(pa.array(TEXTS, pa.string()), 1)
        at = np.r_[0, np.cumsum(counts)]
        for text, a, b in zip(TEXTS, at[:-1], at[1:], strict=True):
            assert ids[a:b].tolist() == [*whole.encode(text or "", add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("sequence", [64, 2048])
def test_round_trip(spark, sequence):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.tokenizer_path())
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(None, "no id", "x", 1), (3, TEXTS[3], "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, position int")
    pieces = packing.pack(docs, packing.tokenizer_path(), sequence).toPandas().sort_values(["sequence_id", "offset"])
    checks = packing.digest(packing.pack(docs, packing.tokenizer_path(), sequence)).toPandas()
    assert sorted(checks.ids_crc32) == sorted(zlib.crc32(bytes(b)) for b in pieces.ids)
    total = 0
    for n, group in pieces.groupby("sequence_id"):
        assert group.offset.tolist() == np.r_[0, np.cumsum(group.length)[:-1]].tolist()
        assert group.length.sum() == sequence or n == pieces.sequence_id.max()
        total += group.length.sum()
    assert sorted(pieces.sequence_id.unique()) == list(range(-(-total // sequence)))
    texts = {}
    for (doc, _), group in pieces.assign(doc=pieces.doc_id.fillna(-1)).groupby(["doc", "doc_tokens"]):
        texts[doc] = np.concatenate([np.frombuffer(b, "<u4") for b in group.sort_values("start").ids])
    for i, text, *_ in rows:
        want = [*whole.encode(text or "", add_special_tokens=False).ids, 1]
        got = texts[-1 if i is None else i].tolist()
        assert got == want if rows.count((i, text, "x", 1)) == 1 else sorted(got) == sorted(want * 2)


def test_empty_table_and_neighbours(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(none, packing.tokenizer_path()).count() == 0
    a = [(i, "alpha beta gamma delta " * 5 + str(i)) for i in range(0, 40, 2)]
    b = [(i, "uno dos tres cuatro cinco " * 5 + str(i)) for i in range(1, 40, 2)]
    pieces = packing.pack(spark.createDataFrame(a + b, "doc_id long, text string"), packing.tokenizer_path(), 64).toPandas()
    kinds = [i % 2 for i in pieces.sort_values(["sequence_id", "offset"]).doc_id]
    assert sum(x != y for x, y in zip(kinds[:-1], kinds[1:], strict=True)) <= 5  # like lies beside like
