"""The lexicon rules over a batch of texts at once, for a word table too big to be held as a constant.

The same rules in the same order as ``hearsay.functions.lexicon``, word by word there and array by array here.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from hearsay.functions import lexicon as lx
from hearsay.operators.wordtable import WordTable, coded, sums

REACH = 3


def core_totals(table: WordTable) -> Callable[[pa.Array], pa.Array]:
    """Sum of the valences of each list of words."""
    def run(words: pa.Array) -> pa.Array:
        distinct, codes, starts = coded(words)
        return pa.array(sums(np.r_[np.nan_to_num(table.find(distinct)[0]), 0.0][codes], starts))

    return run


def rule_totals(table: WordTable) -> Callable[[pa.Array], pa.Array]:
    """Sum of the valences of each list of ``cased_words`` after the neighbours had their say."""
    def run(words: pa.Array) -> pa.Array:
        flat = words.flatten()
        lows = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(words.value_lengths().to_numpy())], pa.int32()), flat.field("low"))
        distinct, codes, starts = coded(lows)
        return pa.array(sums(_scores(distinct, codes, starts, flat.field("caps").to_numpy(zero_copy_only=False), table.find(distinct)[0]), starts))

    return run


def _scores(distinct: pa.Array, codes: np.ndarray, starts: np.ndarray, caps: np.ndarray, valence: np.ndarray) -> np.ndarray:
    """The score of each word of each text, already weighed by where the text's "but" stands."""
    sizes = np.diff(starts)
    text, pos = np.repeat(np.arange(len(sizes)), sizes), np.arange(len(codes)) - np.repeat(starts[:-1], sizes)
    listed = lambda words: pc.is_in(distinct, pa.array(words, pa.string())).to_numpy(zero_copy_only=False)
    # facts of each distinct word; the last entry stands for places outside the text
    val = np.r_[valence, np.nan]
    softer = listed(lx.SOFTENERS)
    boost = np.r_[np.where(listed(lx.STRENGTHENERS), lx.BOOST_STEP, np.where(softer, -lx.BOOST_STEP, np.nan)), np.nan]
    neg = np.r_[listed(lx.NEGATIONS) | pc.match_substring(distinct, "n't").to_numpy(zero_copy_only=False), False]
    plain = np.r_[np.isnan(valence), False]
    named = {}

    def word(name: str) -> int:
        if name not in named:
            at = pc.index(distinct, name).as_py()
            named[name] = at if at >= 0 else -2
        return named[name]

    some = np.bincount(text, weights=caps, minlength=len(sizes))
    mixed = ((some > 0) & (some < sizes))[text]
    after = np.append(codes[1:], -1)
    after[np.cumsum(sizes)[sizes > 0] - 1] = -1
    sounding = ~np.isnan(val[codes]) & np.isnan(boost[codes]) & ~((codes == word("kind")) & (after == word("of")))
    at = np.flatnonzero(sounding)
    near, shout = {}, {}
    for k in range(-REACH, REACH):
        inside = (pos[at] + k >= 0) & (pos[at] + k < sizes[text[at]])
        there = np.where(inside, at + k, 0)
        near[k] = np.where(inside, codes[there], -1)
        shout[k] = inside & caps[there] & mixed[at]

    def low(k: int, *names: str) -> np.ndarray:
        return np.isin(near[k], [word(n) for n in names]) if len(names) > 1 else near[k] == word(names[0])

    v = val[near[0]]
    after_no = low(-1, "no") | low(-2, "no") | (low(-3, "no") & low(-1, "or", "nor"))
    v = np.where(after_no, v * lx.NEGATION_FACTOR, np.where(low(0, "no") & ~np.isnan(val[near[1]]), 0.0, v))
    v = v + np.where(shout[0], np.where(v > 0, lx.CAPS_STEP, -lx.CAPS_STEP), 0.0)
    for d in range(1, REACH + 1):
        step, loud = boost[near[-d]], np.where(shout[-d], lx.CAPS_STEP, 0.0)
        sized = np.where(v < 0, -step, step) + np.where(v > 0, loud, -loud)
        v = np.where(plain[near[-d]], v + np.where(np.isnan(sized), 0.0, sized) * lx.DISTANCE_DAMPING[d - 1], v)
        factor = np.where(neg[near[-d]], lx.NEGATION_FACTOR, 1.0)
        if d > 1:
            doubt = low(-1, "doubt") if d == 2 else low(-1, "doubt") | low(-2, "doubt")
            factor = np.where(low(-d, "without") & doubt, 1.0, factor)
            stressed = low(-d, "never") & low(1 - d, "so", "this")
            stressed = stressed | low(-1, "so", "this") if d == 3 else stressed
            factor = np.where(stressed, lx.NEVER_FACTOR, factor)
        v = np.where(plain[near[-d]], v * factor, v)

    def phrase(places: tuple[int, ...], words: str) -> np.ndarray:
        parts = words.split(" ")
        if len(parts) != len(places):
            return np.zeros(len(at), dtype=bool)
        return np.logical_and.reduce([low(k, p) for k, p in zip(places, parts, strict=True)])

    found = v
    for places in reversed(lx.IDIOM_PLACES):
        for words, value in lx.IDIOMS.items():
            found = np.where(phrase(places, words), value, found)
    for places in lx.SOFT_PLACES:
        soft = np.logical_or.reduce([phrase(places, p) for p in lx.SOFT_PHRASES])
        found = found - np.where(soft, lx.BOOST_STEP, 0.0)
    v = np.where(plain[near[-REACH]], found, v)
    least = low(-1, "least") & plain[near[-1]] & ~low(-2, "at", "very")
    v = np.where(least, v * lx.NEGATION_FACTOR, v)
    turn = np.full(len(sizes), -1)
    buts = np.flatnonzero(codes == word("but"))[::-1]
    turn[text[buts]] = pos[buts]  # the first one is written last
    own, here = turn[text[at]], pos[at]
    weight = np.where(here < own, lx.BEFORE_BUT, np.where(here > own, lx.AFTER_BUT, 1.0))
    scores = np.zeros(len(codes))
    scores[at] = np.where(own < 0, v, v * weight)
    return scores
