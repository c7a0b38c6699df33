"""Repeated passages against all windows of all documents."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from hearsay.llm import substrings


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(docs, length):
    first = {}
    for i, text in docs:
        w = split(text)
        for j in range(len(w) - length + 1):
            if i is not None:
                gram = tuple(w[j : j + length])
                first[gram] = min(first.get(gram, i), i)
    out = []
    for i, text in docs:
        w = split(text)
        gone = set()
        for j in range(len(w) - length + 1):
            if i is not None and first[tuple(w[j : j + length])] < i:
                gone |= set(range(j, j + length))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed, n):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["é,", " x", "A.B"]
    passages = [" ".join(r.choice(vocabulary) for _ in range(r.randint(5, 40))) for _ in range(8)]
    docs = []
    for i in range(n):
        parts = [" ".join(r.choice(vocabulary) for _ in range(r.randint(0, 30))) for _ in range(r.randint(1, 4))]
        parts += [r.choice(passages) for _ in range(r.randint(0, 3))]
        r.shuffle(parts)
        docs.append((i * 7 % 101, r.choice(" \n\t").join(parts)))
    docs += [(300 + i, docs[i][1]) for i in range(0, n, 5)]  # whole copies
    docs += [(400, None), (401, ""), (402, " \n "), (403, "one"), (None, docs[0][1]), (None, None), docs[3], (405, "a b " * 60)]
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    docs = corpus(seed, 60)
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, anchor string, windows int")
    out = substrings.repeats(df).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256))
    assert sorted((tuple(r) for r in out.collect()), key=repr) == brute(docs, 13)


def test_spans_carried_columns_and_clean_texts(spark):
    shared = " ".join(f"s{i}" for i in range(15))
    docs = [(1, f"a b {shared} c"), (2, f"x\n{shared}\ny  z"), (3, "only\nmine  here"), (4, f"{shared} {shared}")]
    df = spark.createDataFrame([(*d, f"src{d[0]}") for d in docs], "doc_id long, text string, source string")
    rows = {r.doc_id: r for r in substrings.repeats(df, carry=("source",), clean_as_is=True).collect()}
    assert (rows[2].span_starts, rows[2].span_ends, rows[2].kept) == ([1], [16], "x y z")
    assert (rows[4].span_starts, rows[4].span_ends, rows[4].kept) == ([0], [30], "")
    assert rows[1].kept == docs[0][1] and rows[3].kept == docs[2][1] and rows[3].carried.source == "src3"


def test_empty(spark):
    assert substrings.repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
