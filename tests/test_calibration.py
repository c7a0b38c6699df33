"""Reliability, pooled maps and word-count probabilities against plain versions."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hearsay.operators import calibration, counted
from hearsay.plans import sentiment


def min_max(counts, hits):
    """Isotonic shares by the formula of runs."""
    share = lambda a, b: sum(hits[a : b + 1]) / sum(counts[a : b + 1])
    n = len(counts)
    return [max(min(share(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]


@pytest.mark.parametrize("seed", range(20))
def test_pooling_equals_the_formula_of_runs(seed):
    r = random.Random(seed)
    counts = [r.randint(1, 9) for _ in range(r.randint(1, 25))]
    hits = [r.choice((0, c, r.randint(0, c))) for c in counts]
    assert calibration.pooled(counts, hits) == pytest.approx(min_max(counts, hits))


def test_held_out_error_falls(spark):
    r = random.Random(5)
    rows = []
    for i in range(6000):
        x = r.gauss(0, 1)
        rows.append((i, 1 / (1 + math.exp(-4 * x)), r.random() < 1 / (1 + math.exp(-x))))  # four times too sure
    df = spark.createDataFrame(rows, "id int, p double, hit boolean")
    fitted = calibration.fit(df.filter("id % 2 = 0"), "p", "hit", 64)
    held = df.filter("id % 2 = 1").withColumn("q", fitted.apply(F.col("p")))
    error = lambda c: calibration.expected_error(calibration.reliability(held, c, "hit", 20)).head()
    assert error("p")["error"] > 0.12 > 0.04 > error("q")["error"] and error("p")["n"] == 3000
    loss = lambda c: calibration.log_loss(held, c, "hit").head()["loss"]
    assert loss("q") < loss("p")
    assert list(fitted.shares) == sorted(fitted.shares)


def test_odd_probabilities(spark):
    nan = float("nan")
    rows = [(0.1, 1), (-3.0, 0), (7.0, 1), (1.0, 1), (None, 1), (nan, 1), (0.5, None)]
    df = spark.createDataFrame(rows, "p double, hit int")
    got = {r.bin: (r.n, r.share) for r in calibration.reliability(df, "p", "hit", 4).collect()}
    assert got == {0: (2, 0.5), 3: (2, 1.0)}
    fitted = calibration.fit(df, "p", "hit", 4)
    assert fitted.shares == (0.5, 0.5, 0.5, 1.0)
    assert [r.q for r in df.select(fitted.apply(F.col("p")).alias("q")).collect()] == [0.5, 0.5, 1.0, 1.0, None, None, 0.5]
    assert calibration.log_loss(df, "p", "hit").head()["n"] == 4
    none = df.limit(0)
    assert calibration.fit(none, "p", "hit", 2).shares == (0.25, 0.75)
    assert tuple(calibration.expected_error(calibration.reliability(none, "p", "hit")).head()) == (0, None, None)
    with pytest.raises(ValueError):
        calibration.reliability(df, "p", "hit", 0)


class Fixed:
    def score(self, df, text):
        return df.withColumns({"a": F.length(text) / 10, "b": 1 - F.length(text) / 10})


def test_classes_add_up_again(spark):
    df = spark.createDataFrame([("x" * n, n % 2) for n in range(1, 10)], "text string, __total int").withColumnRenamed("__total", "hit")
    scorer = calibration.calibrated(Fixed(), df, "text", {"a": F.col("hit") == 1, "b": F.col("hit") == 0}, 8)
    rows = scorer.score(df, "text").collect()
    assert all(r.a + r.b == pytest.approx(1) for r in rows) and rows[0].asDict().keys() == {"text", "hit", "a", "b"}
    never = calibration.Calibration((0.0, 0.0))
    kept = calibration.CalibratedScorer(Fixed(), {"a": never, "b": never}).score(df, "text").first()
    assert (kept.a, kept.b) == (0.1, 0.9)


def bayes(train, texts, classes, smoothing=1.0):
    labelled = [(t or "", l) for t, l in train if l is not None and l >= 0]
    counts = [Counter(w for t, l in labelled for w in t.split() if l == c) for c in range(classes)]
    words = set().union(*counts)
    out = []
    for text in texts:
        logs = []
        for c in range(classes):
            size = sum(l == c for _, l in labelled)
            s = math.log((size + smoothing) / (len(labelled) + smoothing * classes))
            total = sum(counts[c].values()) + smoothing * len(words)
            logs.append(s + sum(math.log((counts[c][w] + smoothing) / total) for w in (text or "").split() if w in words))
        top = max(logs)
        out.append([math.exp(x - top) / sum(math.exp(y - top) for y in logs) for x in logs])
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_counts_equal_a_plain_bayes(spark, seed):
    r = random.Random(seed)
    vocabulary = ["harbour", "lantern", "granite", "meadow", "copper", "thistle", "orchard", "violet"]
    text = lambda: " ".join(r.choice(vocabulary[:6]) for _ in range(r.randint(0, 12)))
    train = [(text(), r.randint(0, 2)) for _ in range(60)] + [(None, 1), ("granite", None), ("meadow", -1)]
    texts = [text() + " violet" for _ in range(40)] + [None, "", "violet", "harbour " * 5000] + ["copper copper thistle"] * 9
    model = counted.count_classifier(spark.createDataFrame(train, "body string, label int"), "body", "label", ("p0", "p1", "p2"))
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "id int, tokens string, tf int").repartition(5)
    got = {x.id: x for x in model.score(df, "tokens").collect()}
    assert len(got) == len(texts)
    for i, want in enumerate(bayes(train, texts, 3)):
        assert [got[i].p0, got[i].p1, got[i].p2] == pytest.approx(want, abs=1e-9)
        assert got[i].tf == 1


def test_two_classes_name_the_last(spark):
    train = spark.createDataFrame([("glad harbour", 0), ("sour lantern", 1)], "t string, l int")
    model = counted.count_classifier(train, "t", "l", ("p",))
    df = spark.createDataFrame([("lantern", 0.5), ("harbour", 0.5)], "t string, p double")
    got = {r.t: r.p for r in model.score(df, "t").collect()}
    assert got["lantern"] > 0.5 > got["harbour"]
    assert model.score(df.limit(0), "t").count() == 0
    empty = counted.count_classifier(train.limit(0), "t", "l", ("p",))
    assert {r.p for r in empty.score(df, "t").collect()} == {0.5}


def test_word_list_share(spark):
    df = spark.createDataFrame([("a", ["x", "x", "y"]), ("a", ["z"]), ("b", ["y"]), ("c", []), (None, ["x"])], "g string, t array<string>")
    words = spark.createDataFrame([("x", 1.0), ("x", 2.0), ("q", 1.0)], "token string, valence double")
    got = {r.g: (r.words, r.listed, r.share) for r in sentiment.word_list_share(df, ["g"], "t", words).collect()}
    assert got == {"a": (4, 2, 0.5), "b": (1, 0, 0.0), None: (1, 1, 1.0)}


def test_scoring_shuffles_neither_texts_nor_words(spark):
    train = spark.createDataFrame([("good fine day", 1), ("bad day", 0), (None, 1)], "t string, l int")
    scored = counted.count_classifier(train, "t", "l", ("p",)).score(train.union(train), "t")
    assert "Exchange" not in scored._jdf.queryExecution().executedPlan().toString()
    got = [r.p for r in scored.collect()]
    assert got[:3] == got[3:] and got[0] > 0.5 > got[1]
