"""Token ids of whole texts by a given word-level BPE, with the ids of seen words kept."""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from hearsay.llm.common import split_words

KEPT_WORDS = 500_000
RESTING_ENTRIES = 120_000
# words of these letters change neither by composition nor in number of characters by lower-casing
PLAIN = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$"


class Encoder:
    """Encodes word by word: no token crosses white space, so a word's ids never depend on its
    neighbours, and the ids of a word are looked up rather than worked out again.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        # every word is cut once, so the model's own memory of words would only cost time
        self.whole.model._resize_cache(0)
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {i: as_bytes.pre_tokenize_str(chr(i))[0][0] for i in range(0xC0, 0x100)}
        self.kind = np.uint16 if self.whole.get_vocab_size() <= 1 << 16 else np.uint32
        self.pool = np.zeros(1 << 20, dtype=self.kind)
        self._forget()

    def _slow(self, words: list[str]) -> list[list[int]]:
        return [x.ids for x in self.whole.encode_batch_fast(words, add_special_tokens=False)]

    def _forget(self) -> None:
        """Entry 0 holds no id; entries 1 and 2 are the marks a plain word may end in."""
        self.first, self.sizes, self.used = np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 16, dtype=np.int64), 0
        self.entries, self.words, self.others = 0, {}, {}
        self._add(*_flat([[], *self._slow([",", "."])]))

    def rest(self) -> None:
        """Keep only what was learned first, which are the frequent words: the worker may have other work next."""
        if self.entries > RESTING_ENTRIES:
            self.entries, self.used = RESTING_ENTRIES, int(self.first[RESTING_ENTRIES])
            self.words = {w: n for w, n in self.words.items() if n < RESTING_ENTRIES}
            self.others = {w: n for w, n in self.others.items() if n < RESTING_ENTRIES}
            self.pool = self.pool[: max(1 << 16, self.used)].copy()
            self.first, self.sizes = (x[:RESTING_ENTRIES].copy() for x in (self.first, self.sizes))

    def _add(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Numbers of the new entries that hold ``ids``, cut by ``sizes``."""
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while self.entries + len(sizes) > len(self.first):
            self.first, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.sizes))
        self.pool[self.used : self.used + len(ids)] = ids
        numbers = np.arange(self.entries, self.entries + len(sizes))
        self.first[numbers] = self.used + np.cumsum(sizes) - sizes
        self.sizes[numbers] = sizes
        self.used += len(ids)
        self.entries += len(sizes)
        return numbers

    def _learn(self, words: list[str]) -> None:
        """Entries of lower-case words of plain letters: one token each for the model to cut, nothing to normalise."""
        cut, letters = self.whole.model.tokenize, self.letters
        ids = [[t.id for t in cut(w if w.isascii() else w.translate(letters))] for w in words]
        self.words.update(zip(words, self._add(*_flat(ids)).tolist(), strict=True))

    def _entries(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """For distinct words as written: the entry of each, and of the mark behind it (0 for none)."""
        if len(self.words) + len(self.others) > KEPT_WORDS:
            self._forget()
        comma, dot = pc.ends_with(chunks, ","), pc.ends_with(chunks, ".")
        raw = chunks.cast(pa.binary())
        stem = pc.if_else(pc.or_(comma, dot), pc.binary_slice(raw, 0, -1), raw).cast(pa.string())
        plain = pc.match_substring_regex(stem, PLAIN).to_numpy(zero_copy_only=False)
        marks = np.where(plain, comma.to_numpy(zero_copy_only=False) + 2 * dot.to_numpy(zero_copy_only=False), 0)
        entries = np.empty(len(chunks), dtype=np.int64)
        lower = pc.utf8_lower(stem.filter(pa.array(plain))).dictionary_encode()
        words = lower.dictionary.to_pylist()
        known = self.words
        self._learn([w for w in words if w not in known])
        entries[plain] = np.array([known[w] for w in words], dtype=np.int64)[lower.indices.to_numpy()]
        odd = chunks.filter(pa.array(~plain)).to_pylist()
        fresh = [w for w in odd if w not in self.others]
        if fresh:
            self.others.update(zip(fresh, self._add(*_flat(self._slow(fresh))).tolist(), strict=True))
        entries[~plain] = [self.others[w] for w in odd]
        return entries, marks

    def encode(self, texts: pa.Array, last: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other (with ``last`` behind each text), and how many each has."""
        words, counts = split_words(texts)
        coded = words.dictionary_encode()
        of_word, of_mark = self._entries(coded.dictionary)
        codes = coded.indices.to_numpy()
        entries = np.empty(2 * len(codes), dtype=np.int64)
        entries[0::2] = of_word[codes]
        entries[1::2] = of_mark[codes]
        ends = 2 * np.cumsum(counts)
        if last is not None:
            final = self._add(np.array([last], dtype=self.kind), np.array([1]))[0]
            entries = np.insert(entries, ends, final)
            ends = ends + np.arange(1, len(ends) + 1)
        each = self.sizes[entries]
        upto = np.zeros(len(each) + 1, dtype=np.int64)
        np.cumsum(each, out=upto[1:])
        at = np.repeat((self.first[entries] - upto[:-1]).astype(np.int32), each)
        at += np.arange(len(at), dtype=np.int32)
        return np.take(self.pool, at), np.diff(np.r_[0, upto[ends]])


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([i for x in ids for i in x], dtype=np.uint32), np.array([len(x) for x in ids], dtype=np.int64)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
