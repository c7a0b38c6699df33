"""The Jaccard join against all pairs of full shingle sets."""

import random
import re

import pytest

from hearsay.llm import jaccard


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(docs, similarity=0.8):
    sets = {i: shingles(t) for i, t in docs if i is not None}
    links = {i: set() for i in sets}
    for i in sets:
        for j in sets:
            if i < j and sets[i] and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                links[i].add(j)
                links[j].add(i)
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for i in sets:
            low = min([label[i], *(label[j] for j in links[i])])
            changed |= low < label[i]
            label[i] = low
    rep = {i: min(j for j in sets if sets[j] == sets[i]) if sets[i] else i for i in sets}
    return {i: (rep[i], len(links[i]), label[i]) for i in sets}


def corpus(seed, n, copies):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 3)))
    docs = []
    for _ in range(n):
        base = [word() for _ in range(r.choice((1, 3, 4, 5, 6, 30, 80, 150)))]
        docs.append(base)
        for _ in range(r.choice((0, 0, 1, 3))):
            other = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 25))):
                other[r.randrange(len(other))] = word()
            docs.append(other)
    hot = [word() for _ in range(120)]
    for _ in range(copies):
        other = list(hot)
        for _ in range(r.randint(0, 3)):
            other[r.randrange(len(other))] = word()
        docs.append(other)
    ids = list(range(len(docs)))
    r.shuffle(ids)
    return [(i, r.choice((" ", "\n", "  ")).join(d)) for i, d in zip(ids, docs, strict=True)]


@pytest.mark.parametrize("blocks", [(100_000, 512), (2000, 16)])
def test_equals_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(jaccard, "BLOCK_GRAMS", blocks[0])
    monkeypatch.setattr(jaccard, "BLOCK_DOCS", blocks[1])
    docs = corpus(3, 60, 70)
    docs += [(900, None), (901, ""), (902, " "), (None, docs[0][1]), (None, None), docs[5], (904, "dog cat"), (905, "dog  cat"), (906, "cat dog")]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, rep int, band string")
    rows = jaccard.jaccard_groups(df).collect()
    assert len(rows) == len({r.doc_id for r in rows})
    assert {r.doc_id: (r.rep, r.n_links, r.class_id) for r in rows} == brute(docs)


def test_bands_follow_the_recall():
    for recall in (0.9, 0.99, 0.9995):
        bands, rows = jaccard.bands_and_rows(0.8, recall)
        assert 1 - (1 - 0.8**rows) ** bands >= recall and bands * rows <= 128


def test_empty(spark):
    assert jaccard.jaccard_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
