"""Ordinal severity: the fit, held-out accuracy on labelled texts, and odd rows."""

import random

import numpy as np
import pytest

from hearsay.llm import toxicity

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    seen = labels.filter("doc_id % 3 <> 0")
    model = toxicity.train(docs, seen)
    rated = toxicity.rate(docs.join(labels.filter("doc_id % 3 = 0"), "doc_id"), model).select("toxic", "toxicity.grade").toPandas()
    assert ((rated.grade > 0) == (rated.toxic == 1)).mean() > 0.98
    # some labels of this table are drawn at random: a few toxic ones have no toxic word
    assert ((rated.grade > 0) & (rated.toxic == 1)).sum() >= 0.92 * (rated.toxic == 1).sum()
    assert ((rated.grade > 0) & (rated.toxic == 0)).sum() <= 0.015 * (rated.toxic == 0).sum()


def made(spark):
    r = random.Random(1)
    clean = [f"w{i}" for i in range(60)]
    bad = ["foulword", "foulwords,", "Vileness!", "vile"]
    docs, labels = [], []
    for i in range(400):
        words = [r.choice(clean) for _ in range(r.randint(10, 60))]
        n = r.choice((0, 0, 1, 2, 5, 14))
        for _ in range(n):
            words.insert(r.randrange(len(words)), r.choice(bad))
        docs.append((i, " ".join(words), "x", 0.5))
        labels.append((i, int(n > 0), None))
    schema = "doc_id long, text string, above string, severity double"
    return spark.createDataFrame(docs, schema), spark.createDataFrame(labels, "doc_id long, toxic int, quality int"), schema


def test_grades_are_ordered_and_columns_survive(spark):
    docs, labels, schema = made(spark)
    model = toxicity.train(docs, labels)
    assert (np.diff(model.thresholds) > 0).all()
    texts = ["w1 w2 w3 w4 w5", "w1 w2 vile w3", "vile " * 5 + "w1 foulword vile", "foulword vile " * 20, "", None, "FOULWORDS w1"]
    odd = spark.createDataFrame([(i if i else None, t, "kept", 0.25) for i, t in enumerate(texts)] + [(1, texts[1], "kept", 0.25)], schema)
    out = toxicity.rate(odd, model)
    assert out.columns == ["doc_id", "text", "above", "severity", "toxicity"]
    rows = out.collect()
    assert len(rows) == 8 and all(r.above == "kept" and r.severity == 0.25 for r in rows)
    grade = {r.text: r.toxicity.grade for r in rows}
    assert [grade[t] for t in texts] == [0, 1, grade[texts[2]], 3, 0, 0, 1] and 1 <= grade[texts[2]] <= 3
    severity = [next(r.toxicity.severity for r in rows if r.text == t) for t in texts[:4]]
    assert severity == sorted(severity) and 0 <= severity[0] < 0.5 and 2.5 < severity[3] <= 3
    for r in rows:
        assert list(r.toxicity.above) == sorted(r.toxicity.above, reverse=True)
        assert r.toxicity.severity == pytest.approx(sum(r.toxicity.above)) and r.toxicity.toxic == (r.toxicity.grade > 0)


def test_slopes_are_those_of_the_likelihood():
    rng = np.random.default_rng(0)
    score, grade, thresholds = rng.standard_normal(40), rng.integers(0, 4, 40), np.array([-0.5, 0.4, 1.3])

    def loss(s, b):
        above = np.column_stack([np.ones(40), 1 / (1 + np.exp(-(s[:, None] - b))), np.zeros(40)])
        return -np.log(above[np.arange(40), grade] - above[np.arange(40), grade + 1])

    by_score, by_threshold = toxicity._loss_slopes(score, grade, thresholds)
    h = 1e-6
    assert np.allclose((loss(score + h, thresholds) - loss(score - h, thresholds)) / (2 * h), by_score, atol=1e-5)
    for k in range(3):
        e = np.eye(3)[k] * h
        assert np.allclose((loss(score, thresholds + e) - loss(score, thresholds - e)) / (2 * h), by_threshold[:, k], atol=1e-5)


def test_no_labels_and_no_rows(spark):
    docs, labels, schema = made(spark)
    for some in (labels.limit(0), labels.filter("toxic = 0"), spark.createDataFrame([(None, 1), (3, None), (999, 1)], "doc_id long, toxic int")):
        assert toxicity.rate(docs, toxicity.train(docs, some)).filter("toxicity.toxic").isEmpty()
    none = spark.createDataFrame([], schema)
    assert toxicity.rate(none, toxicity.train(none, labels)).count() == 0
